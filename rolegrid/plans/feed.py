"""A posting feed and its page dump, derived from the orders and customer tables.

The text is plain SQL that Spark and other ANSI engines read alike. One source,
and one company, hold a third of all rows each; every tenth event delivers an
earlier posting again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-02-01 00:00:00"
BASE_URL = "https://board.example"


def pick(expr: str, *values: str) -> str:
    """CASE over expr % n."""
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE ({expr}) % {len(values)} {arms} END"


_BASE = """
SELECT o_orderkey AS k, o_custkey AS cust, CAST(floor(o_totalprice) AS BIGINT) AS p,
       CAST(floor(o_orderkey / 3) AS BIGINT) AS k3, CAST(floor(o_custkey / 5) AS BIGINT) AS firm,
       c_nationkey AS nat, o_orderdate AS d
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
"""

_COMPANY = (
    "CASE WHEN k % 3 = 1 THEN " + pick("k3", "PT Mega Karya", "PT. Mega Karya, Tbk",
                                       "Mega  Karya (Persero)")
    + " ELSE " + pick("k", "PT ", "PT. ", "CV ", "") + " || 'Customer ' || CAST(firm AS STRING) || "
    + pick("k3", "", " Tbk", ", Tbk.", " (Persero)", "  ") + " END")
_TITLE = (
    pick("k", "Senior ", "Junior ", "Lead ", "Intern - ", "Magang: ", "") + " || "
    + pick("k3", "Backend Engineer", "Frontend Developer", "Data Engineer", "Mobile Developer",
           "DevOps Engineer", "QA Analyst", "Product Designer") + " || ' ' || "
    + pick("k", "Payments", "Payment", "Search", "Research", "Growth", "Growth II", "Growth III",
           "Data Platform", "Data Platforms", "Core", "Core Banking", "Logistics", "Logistic",
           "(Golang)", "Go", "React Native", "C++") + " || "
    + pick("k", " (Remote)", " (Hybrid)", "", " ( onsite )", " "))
_SALARY = """CASE k % 10
 WHEN 0 THEN CAST(p % 20 + 3 AS STRING) || '-' || CAST(p % 20 + 9 AS STRING) || ' jt/bulan'
 WHEN 1 THEN 'Rp ' || CAST(p % 9 + 4 AS STRING) || '.500.000 - Rp ' || CAST(p % 7 + 6 AS STRING) || '.000.000'
 WHEN 2 THEN 'up to ' || CAST(p % 30 + 5 AS STRING) || ' juta'
 WHEN 3 THEN 'mulai dari ' || CAST(p % 10 + 3 AS STRING) || ',5jt'
 WHEN 4 THEN 'IDR ' || CAST(p % 90 + 5 AS STRING) || ',000,000 per month'
 WHEN 5 THEN 'Gaji: Negotiable'
 WHEN 6 THEN 'USD ' || CAST(p % 900 AS STRING) || ' - ' || CAST(p % 900 + 100 AS STRING)
 WHEN 7 THEN ''
 WHEN 8 THEN CAST(p % 800 AS STRING) || ' ribu s/d ' || CAST(p % 5 + 1 AS STRING) || '.25 juta'
 ELSE '1..' || CAST(p % 9 AS STRING) || ' hingga ' || CAST(p % 9 + 1 AS STRING) || ' juta' END"""
_LOCATION = (
    "CASE WHEN k % 13 = 0 THEN '' ELSE "
    + pick("nat", "Jakarta", "Bandung", "Surabaya", "Kota Yogyakarta", "Denpasar ")
    + " || CASE WHEN k % 17 = 0 THEN '' ELSE ', Indonesia' END || "
    + pick("k3", " (Remote)", " (Hybrid)", "", "", "") + " END")
_DESCRIPTION = (
    "'<div class=\"text a\"><p>We build R&amp;D tools.&nbsp;' || "
    + pick("k3", "Join us", "Work from home twice a week", "2 hari WFO", "We go on-site", "Hi",
           "Join   us", "Grow with us")
    + " || '</p>' || CASE WHEN k % 29 = 0 THEN '<script>var t = \"<li>Docker\";</script>' ELSE '' END"
    + " || '<ul>' || chr(10) || '<li>Knows <b>' || "
    + pick("k", "Python", "Java", "JavaScript", "Node.js", "Go", "golang", "Rust", "React",
           "React Native", "C#", "Kotlin")
    + " || '</b> and <i>' || "
    + pick("k", "PostgreSQL", "MySQL", "Redis", "k8s", "Kafka", "AWS", "Google Cloud", "Spring Boot",
           "spring time", "SQL Server", "GitHub Actions", "git", "plain js", "Vue.js", "ASP.NET",
           "reactive", "Hyper-V")
    + " || '</i></li>' || CASE WHEN k % 19 = 0 THEN '<li>Doc<b>ker</b> &copy; help</li>' ELSE '' END"
    + " || '<li>' || "
    + pick("k", "3-5 years of experience", "1 year of experience", "at least 2 years here",
           "7+ years building things", "25+ years old", "Minimal 4 tahun", "min. 1 tahun",
           "6 tahun pengalaman", "no numbers at all", "3 year''s experiences", "pengalaman kerja 5 tahun")
    + " || '</li></ul>' || chr(10) || '<!-- seen -->Apply<br>now</div>'")

FEED_SQL = f"""
SELECT k AS ingest_seq, CAST(k % 3 + 1 AS INT) AS source_id,
  {_TITLE} AS title, {_COMPANY} AS company, {_SALARY} AS salary_raw, {_LOCATION} AS location,
  {_DESCRIPTION} AS description,
  '{BASE_URL}/jobs/' || CAST(CASE WHEN k % 10 = 9 THEN k - 3 ELSE k END AS STRING) AS source_url,
  CAST(CASE WHEN k % 10 = 9 THEN k - 3 ELSE k END AS STRING) AS source_job_id,
  CASE WHEN k % 11 = 0 THEN NULL ELSE d END AS posted_at
FROM ({_BASE}) base
"""

SOURCES_SQL = """
SELECT CAST(n_nationkey + 1 AS INT) AS id, lower(n_name) AS slug, n_name AS name,
       'https://' || lower(n_name) || '.example' AS base_url, n_nationkey % 5 <> 4 AS is_active,
       CAST(NULL AS TIMESTAMP) AS last_run_at
FROM {nation}
"""

# One job of a page payload, as columns; page = 15 jobs, feed = 20 pages.
PAGE_JOBS_SQL = f"""
SELECT 'kw ' || CAST(CAST(floor(k / 300) AS BIGINT) AS STRING) AS keyword,
  CAST(floor(k / 300) AS BIGINT) AS feed_no,
  CAST(floor((k % 300) / 15) AS INT) + 1 AS page_no, k AS id,
  {_TITLE} AS name, {_COMPANY} AS company_name, 'c' || CAST(cust AS STRING) AS code,
  'slug-' || CAST(k % 97 AS STRING) AS slug, {_DESCRIPTION} AS description,
  CASE WHEN k % 4 = 0 THEN '' ELSE '<p>Quals ' || CAST(k % 10 AS STRING) || '</p>' END AS qualifications,
  CASE WHEN k % 4 IN (0, 1) THEN p END AS base_salary,
  CASE WHEN k % 4 IN (0, 2) THEN p + 1000 END AS maximum_salary,
  {pick("k", "IDR", "USD", "")} AS currency, {pick("k3", "month", "year", "")} AS salary_interval,
  k % 5 <> 0 AS shown, k % 6 = 0 AS hybrid, k % 7 = 0 AS wfh,
  CASE WHEN k % 17 = 0 THEN 'soon' ELSE CAST(CAST(d AS DATE) AS STRING) || 'T03:04:05.'
    || lpad(CAST(k % 1000000 AS STRING), 6, '0') || '+07:00' END AS activated,
  k % 13 = 0 AS no_place, {pick("nat", "Jakarta", "Bandung", "", "Solo", "Makati")} AS city,
  CASE nat % 5 WHEN 4 THEN 'Philippines' WHEN 2 THEN {pick("k", "", "Singapore", "Indonesia")}
    ELSE 'Indonesia' END AS country
FROM ({_BASE}) base
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _over_orders(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    # joined by shuffle: the text work that follows then has the tasks of the
    # shuffle, whatever the files of the table
    return spark.sql(sql, orders=table(spark, sf_dir, "orders"),
                     customer=table(spark, sf_dir, "customer").hint("shuffle_hash"))


def posting_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over_orders(spark, sf_dir, FEED_SQL)


def source_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(SOURCES_SQL, nation=table(spark, sf_dir, "nation"))
    return rows.withColumn("last_run_at", F.col("last_run_at").cast("timestamp_ntz"))


def page_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """keyword, page, url, html: the feed as crawled pages.

    By feed number modulo 4: 1 repeats page 7 as page 8, 2 has an empty page
    12, 3 reports a total of 100. Some pages miss the payload or hold a broken
    one. A page gathers the 15 jobs the SQL numbers into it, never more.
    """
    c = F.col
    jobs = _over_orders(spark, sf_dir, PAGE_JOBS_SQL)
    job = F.struct(
        "id", "name", c("company_name").alias("companyName"), F.struct("code").alias("company"),
        "slug", "description", "qualifications", c("base_salary").alias("baseSalary"),
        c("maximum_salary").alias("maximumSalary"), c("currency").alias("salaryCurrency"),
        c("salary_interval").alias("salaryInterval"), c("shown").alias("salaryShown"),
        c("hybrid").alias("isHybrid"), c("wfh").alias("isWorkFromHome"),
        c("activated").alias("createdAt"), c("activated").alias("activationDate"),
        F.when(~c("no_place"), F.struct(F.struct("city", "country").alias("addressComponents")))
        .alias("googleLocation"))
    shapes = (jobs.groupBy("keyword", "feed_no", "page_no")
              .agg(F.sort_array(F.collect_list(job)).alias("jobs")))
    repeated = shapes.withColumn("page", F.explode(
        F.when((c("feed_no") % 4 == 1) & (c("page_no") == 7), F.array(F.lit(7), F.lit(8)))
        .when((c("feed_no") % 4 == 1) & (c("page_no") == 8), F.array().cast("array<int>"))
        .otherwise(F.array("page_no"))))
    shown = F.when((c("feed_no") % 4 == 2) & (c("page") == 12), F.slice("jobs", 1, 0)).otherwise(c("jobs"))
    total = F.when(c("feed_no") % 4 == 3, 100).otherwise(300)
    # "<\\/" keeps a closing tag inside a JSON string from ending the script
    payload = F.replace(F.to_json(F.struct(F.struct(F.struct(
        total.alias("count"), shown.alias("jobs")).alias("pageProps")).alias("props"))),
        F.lit("</"), F.lit("<\\/"))
    number = c("feed_no") * 20 + c("page")
    body = (F.when(number % 37 == 0, "<p>moved</p>")
            .when(number % 41 == 0, F.concat(F.lit('<script id="__NEXT_DATA__">'),
                                             F.substring(payload, 1, 40), F.lit("</script>")))
            .otherwise(F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">'),
                                payload, F.lit("</script>"))))
    return repeated.select(
        "keyword", "page",
        F.concat(F.lit(BASE_URL + "/id-ID/job-board/te/"), F.replace("keyword", F.lit(" "), F.lit("%20")),
                 F.lit("/"), c("page").cast("string")).alias("url"),
        F.concat(F.lit('<html><head><script>var a = 1;</script></head><body>'), body,
                 F.lit("</body></html>")).alias("html"))
