"""Page dumps: find the embedded payload, flatten it, trim page runs, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolegrid.functions.text import bind, trim_white
from rolegrid.schemas import DEFAULT_MAX_PAGES, MAX_PAGES_CAP, PAGE_PAYLOAD

# Where the payload sits, and the country a page should list.
PAYLOAD_SCRIPT = r"""(?is)<script(?=[^>]*[\s]id\s*=\s*["']?__NEXT_DATA__["'\s>])[^>]*>(.*?)</script"""
EXPECTED_COUNTRY = "Indonesia"
ERR_NO_PAYLOAD = "payload script not found"
ERR_BAD_PAYLOAD = "payload is not valid JSON"


def clamp_max_pages(n: Column) -> Column:
    """0 and below mean the default, anything above the cap means the cap."""
    return (F.when(n.isNull() | (n <= 0), F.lit(DEFAULT_MAX_PAGES))
            .when(n > MAX_PAGES_CAP, F.lit(MAX_PAGES_CAP)).otherwise(n).cast("int"))


def crawl_plan(keywords: DataFrame, base_url: str, keyword: str = "keyword",
               max_pages: str = "max_pages", prefix: str = "/id-ID") -> DataFrame:
    """One row per page to fetch: keyword, page, url."""
    path = F.replace(F.url_encode(F.col(keyword)), F.lit("+"), F.lit("%20"))
    return (keywords
            .select(F.col(keyword).alias("keyword"),
                    F.explode(F.sequence(F.lit(1), clamp_max_pages(F.col(max_pages))))
                    .alias("page"), path.alias("path"))
            .select("keyword", "page",
                    F.concat(F.lit(base_url + prefix + "/job-board/te/"), F.col("path"),
                             F.lit("/"), F.col("page").cast("string")).alias("url")))


def parse_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """Decode each page's payload next to its other columns.

    Adds ``count``, ``jobs`` and ``error``. A page without payload or with a
    broken one is an error row, never an empty page.
    """
    # a second scan only where the first one found nothing
    script = bind(F.regexp_extract(F.col(html), PAYLOAD_SCRIPT, 1), lambda s: (
        F.when(s != "", s).when(F.rlike(F.col(html), F.lit(PAYLOAD_SCRIPT)), s)))
    payload = F.from_json(F.col("__script"), PAGE_PAYLOAD,
                          {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    props = "__payload.props.pageProps"
    broken = F.col("__payload").isNull() | F.col("__payload._bad").isNotNull()
    return (pages
            .withColumn("__script", script)
            .withColumn("__payload", payload)
            .withColumn("error", F.when(F.col("__script").isNull(), ERR_NO_PAYLOAD)
                        .when(broken, ERR_BAD_PAYLOAD))
            .withColumn("count", F.when(F.col("error").isNull(),
                                        F.coalesce(F.col(f"{props}.count"), F.lit(0))))
            .withColumn("jobs", F.when(F.col("error").isNull(),
                                       F.coalesce(F.col(f"{props}.jobs"), F.array())))
            .drop("__script", "__payload", html))


def page_errors(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("error").isNotNull()).drop("count", "jobs")


def salary_text(job: Column) -> Column:
    """What the board itself shows: nothing for a hidden or empty salary."""
    low, high = job["baseSalary"], job["maximumSalary"]
    currency = F.coalesce(F.nullif(job["salaryCurrency"], F.lit("")), F.lit("IDR"))
    interval = F.nullif(job["salaryInterval"], F.lit(""))
    per = F.when(interval.isNull(), "").otherwise(F.concat(F.lit("/"), interval))
    shown = F.coalesce(job["salaryShown"], F.lit(False))
    text = (
        F.when(low.isNotNull() & high.isNotNull(),
               F.concat(currency, F.lit(" "), low.cast("string"), F.lit(" - "),
                        high.cast("string"), per))
        .when(high.isNotNull(), F.concat(F.lit("up to "), currency, F.lit(" "),
                                         high.cast("string"), per))
        .when(low.isNotNull(), F.concat(F.lit("from "), currency, F.lit(" "),
                                        low.cast("string"), per)))
    return F.when(shown, F.coalesce(text, F.lit(""))).otherwise("")


def location_text(job: Column) -> Column:
    """"city, country" plus a work-mode tag; empty without a location object."""
    place = job["googleLocation"]["addressComponents"]
    name = F.concat_ws(", ", F.nullif(place["city"], F.lit("")),
                       F.nullif(place["country"], F.lit("")))
    tag = (F.when(F.coalesce(job["isWorkFromHome"], F.lit(False)), " (Remote)")
           .when(F.coalesce(job["isHybrid"], F.lit(False)), " (Hybrid)").otherwise(""))
    return F.when(job["googleLocation"].isNull(), "").otherwise(F.concat(name, tag))


def raw_postings(parsed: DataFrame, base_url: str, *keep: str) -> DataFrame:
    """One raw posting per job of every good page, in page order.

    ``pos`` is the place on the page; ``keep`` names page columns to carry.
    """
    job = F.col("job")
    text = lambda name: F.coalesce(job[name], F.lit(""))
    number = F.coalesce(job["id"], F.lit(0)).cast("string")
    code = F.coalesce(job["company"]["code"], F.lit(""))
    # explode_outer plus a test on the row itself: plain explode would add a
    # size() filter that decodes every payload a second time
    rows = (parsed.select(*keep, F.posexplode_outer("jobs").alias("pos", "job"))
            .where(F.col("pos").isNotNull()))
    return rows.select(
        *keep, "pos",
        text("name").alias("title"), text("companyName").alias("company"),
        salary_text(job).alias("salary_raw"), location_text(job).alias("location"),
        trim_white(F.concat(text("description"), F.lit("\n\n"), text("qualifications")))
        .alias("description"),
        F.concat(F.lit(base_url + "/c/"), code, F.lit("/jobs/"), number, F.lit("/"),
                 text("slug")).alias("source_url"),
        number.alias("source_job_id"),
        F.try_to_timestamp(job["activationDate"]).alias("posted_at"),
    )


def trim_page_runs(parsed: DataFrame, *feed: str, page: str = "page",
                   max_pages: int | None = None) -> DataFrame:
    """Pages of each feed up to the point where a crawl would have stopped.

    ``feed`` names the columns that tell one crawl of one keyword from the
    others (default ``keyword``); a dump with several crawls needs the crawl
    among them, or their pages would interleave.

    Stops before an empty page, before a page that only repeats ids of the
    page just before it, before an error page, and after the page that brings
    the collected rows up to the reported total. Repeats inside kept pages
    stay. Pages already held are not cut by the crawl plan's limit; a caller
    may give ``max_pages``. A window holds the pages of one crawl of one
    keyword.
    """
    ordered = Window.partitionBy(*(feed or ("keyword",))).orderBy(page)
    ids = F.transform("jobs", lambda j: j["id"])
    previous = F.lag("__ids").over(ordered)
    repeats = previous.isNotNull() & (F.size(F.array_except("__ids", previous)) == 0)
    so_far = F.sum("__n").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    stop_before = (F.col("error").isNotNull() | (F.col("__n") == 0) | repeats
                   | ((F.col("__seen_total") >= 0)
                      & (F.col("__before") >= F.col("__seen_total"))))
    held = parsed if max_pages is None else parsed.where(F.col(page) <= max_pages)
    return (held.where(F.col(page) >= 1)
            .withColumn("__ids", ids).withColumn("__n", F.size("__ids"))
            .withColumn("__before", so_far)
            .withColumn("__seen_total", F.lag("count").over(ordered))
            .withColumn("__stop", stop_before)
            .withColumn("__stopped", F.max(F.coalesce("__stop", F.lit(False)))
                        .over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
            .where(~F.col("__stopped"))
            .drop("__ids", "__n", "__before", "__seen_total", "__stop", "__stopped"))


def country_audit(parsed: DataFrame, *keep: str,
                  expected: str = EXPECTED_COUNTRY) -> DataFrame:
    """Pages that list jobs of another country; unknown countries do not count.

    Evaluated inside each page row: no explode and no shuffle.
    """
    country = lambda j: j["googleLocation"]["addressComponents"]["country"]
    seen = F.filter(F.transform("jobs", country),
                    lambda c: c.isNotNull() & (c != "") & (c != expected))
    return (parsed.select(
                *keep, F.size("jobs").alias("total_jobs"), seen.alias("__seen"))
            .select(*keep, "total_jobs", F.size("__seen").alias("wrong_country_jobs"),
                    F.array_sort(F.array_distinct("__seen")).alias("countries_seen"))
            .where(F.col("wrong_country_jobs") > 0))
