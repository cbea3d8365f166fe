"""Table shapes, closed value sets and seed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Closed sets of the labelled columns.
SALARY_CONFIDENCE = ("exact", "range", "estimated", "unknown")
WORK_MODES = ("onsite", "remote", "hybrid", "unknown")
EXPERIENCE_LEVELS = ("intern", "junior", "mid", "senior", "lead", "unknown")
RUN_STATUS = ("pending", "running", "success", "failed")

# Limits of the listing, the crawl and the sweep.
DEFAULT_PAGE_SIZE = 20
MAX_PAGE_SIZE = 100
DEFAULT_MAX_PAGES = 3
MAX_PAGES_CAP = 20
DEFAULT_STALE_DAYS = 7

# The seed rows of the sources table (id, slug, name, base_url).
SEED_SOURCES = (
    (1, "dealls", "Dealls", "https://dealls.com"),
    (2, "kalibrr", "Kalibrr", "https://www.kalibrr.com"),
)

_str, _long, _int, _bool, _ts = (
    T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampType(),
)


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, null) for n, t, null in fields])


SOURCES = _struct(
    ("id", _int, False), ("slug", _str, False), ("name", _str, False),
    ("base_url", _str, False), ("is_active", _bool, False),
    ("last_run_at", _ts, True), ("created_at", _ts, False),
)

COMPANIES = _struct(
    ("id", _str, False), ("name", _str, False), ("name_normalized", _str, False),
    ("logo_url", _str, True), ("created_at", _ts, False),
)

RAW_POSTINGS = _struct(
    ("ingest_seq", _long, False), ("source_id", _int, False), ("title", _str, True),
    ("company", _str, True), ("salary_raw", _str, True), ("location", _str, True),
    ("description", _str, True), ("source_url", _str, False),
    ("source_job_id", _str, True), ("posted_at", _ts, True),
)

# The columns a re-delivery replaces, in table order; search_text follows from
# title, stack and description.
POSTING_CONTENT = (
    "title", "title_normalized", "company_id", "description", "salary_min", "salary_max",
    "salary_conf", "salary_raw", "stack", "location", "location_city", "mode", "level",
    "source_job_id", "fingerprint", "posted_at", "search_text",
)

# ``first_seq`` is ours: it breaks first_seen_at ties inside one batch.
POSTINGS = _struct(
    ("id", _str, False), ("title", _str, False), ("title_normalized", _str, False),
    ("company_id", _str, False), ("description", _str, True),
    ("salary_min", _long, True), ("salary_max", _long, True),
    ("salary_currency", _str, False), ("salary_conf", _str, False),
    ("salary_raw", _str, True), ("stack", T.ArrayType(_str, False), False),
    ("location", _str, True), ("location_city", _str, True),
    ("mode", _str, False), ("level", _str, False),
    ("source_id", _int, False), ("source_url", _str, False),
    ("source_job_id", _str, True), ("fingerprint", _str, False),
    ("canonical_job_id", _str, True), ("search_text", _str, False), ("posted_at", _ts, True),
    ("first_seen_at", _ts, False), ("last_seen_at", _ts, False),
    ("is_active", _bool, False), ("first_seq", _long, False),
)

SCRAPE_RUNS = _struct(
    ("id", _str, False), ("source_id", _int, False), ("status", _str, False),
    ("jobs_found", _long, False), ("jobs_new", _long, False),
    ("jobs_duplicate", _long, False), ("jobs_failed", _long, False),
    ("deactivated", _long, False), ("error_message", _str, True),
    ("started_at", _ts, False), ("finished_at", _ts, True),
)

RUN_ERRORS = _struct(
    ("run_id", _str, False), ("ingest_seq", _long, False), ("source_url", _str, True),
    ("error", _str, False),
)

# pos 0 without a token marks a document whose rows these are
SEARCH_TOKENS = _struct(("doc_id", _str, False), ("pos", _int, False), ("token", _str, True))

POSTING_COUNTS = _struct(("part", _str, False), ("name", _str, False), ("n", _long, False))

ALERTS = _struct(
    ("id", _str, False), ("email", _str, False),
    ("filter_stack", T.ArrayType(_str, False), True), ("filter_salary_min", _long, True),
    ("filter_mode", _str, True), ("filter_level", _str, True), ("filter_city", _str, True),
    ("is_verified", _bool, False), ("verify_token", _str, True),
    ("unsubscribe_token", _str, False), ("last_notified_at", _ts, True),
    ("created_at", _ts, False),
)

PAGE_JOB = T.StructType([
    T.StructField("id", _long), T.StructField("name", _str),
    T.StructField("companyName", _str),
    T.StructField("company", T.StructType([T.StructField("code", _str)])),
    T.StructField("slug", _str), T.StructField("description", _str),
    T.StructField("qualifications", _str),
    T.StructField("baseSalary", _long), T.StructField("maximumSalary", _long),
    T.StructField("salaryCurrency", _str), T.StructField("salaryInterval", _str),
    T.StructField("salaryShown", _bool), T.StructField("isHybrid", _bool),
    T.StructField("isWorkFromHome", _bool),
    T.StructField("createdAt", _str), T.StructField("activationDate", _str),
    T.StructField("googleLocation", T.StructType([
        T.StructField("addressComponents", T.StructType([
            T.StructField("city", _str), T.StructField("country", _str)]))])),
])

PAGE_PAYLOAD = T.StructType([
    T.StructField("props", T.StructType([
        T.StructField("pageProps", T.StructType([
            T.StructField("count", _long),
            T.StructField("jobs", T.ArrayType(PAGE_JOB)),
        ])),
    ])),
    T.StructField("_bad", _str),
])


def seed_sources(spark: SparkSession, as_of) -> DataFrame:
    rows = [(*row, True, None, as_of) for row in SEED_SOURCES]
    return spark.createDataFrame(rows, SOURCES)
