"""Every registered query: (spark, sf_dir) -> DataFrame over the whole tables."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolegrid.functions.keys import company_key, fingerprint, title_key
from rolegrid.functions.tags import DEFAULT_DICTIONARY, text_tags
from rolegrid.functions.text import html_to_text, search_form
from rolegrid.operators import audit, dedup, search, stats, upsert
from rolegrid.operators.normalize import left_out, normalize_postings, put_back, remade, with_remade
from rolegrid.operators.replay import replay
from rolegrid.operators.components import connected_components
from rolegrid.operators.similarity import pair_similarity, similar_pairs, spanning_edges
from rolegrid.operators.tagging import dictionary_tags
from rolegrid.operators.token_index import current_tokens, token_changes, with_markers
from rolegrid.plans.feed import AS_OF, BASE_URL, page_dump, posting_feed, source_table, table
from rolegrid.plans.ingest import Run, ingest, run_feed
from rolegrid.schemas import POSTING_CONTENT, RAW_POSTINGS, seed_sources
from rolegrid.session import checkpoint_root, stage, staging
from rolegrid.sources import pages as page_source
from rolegrid.sources.archive import read_archive
from rolegrid.sources.feeds import FeedRegistry, arrival_order, error_text, union_feeds
from rolegrid.sources.tables import TABLES, SnapshotStore
from rolegrid.streaming.ingest import raw_posting_stream, start_ingest, without_repeats

FIRST_RUN = "2024-01-22 00:00:00"  # ten days before AS_OF
QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The structured feed; a query computes only the columns it uses."""
    return normalize_postings(posting_feed(spark, sf_dir))


_SEQS = ("first_seq", "last_seq", "deliveries")
_ELECTED_BY = ("id", *upsert.KEY, "fingerprint", "posted_at")


def latest(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Latest version per key: ``columns`` (default: all) and those that elections read.

    Made from the tables by every query that asks for it, and written on the
    way, so that filters on derived text are filters on stored columns. A query
    names the columns it reads; the text behind the others is left alone.
    """
    last = upsert.latest_events(posting_feed(spark, sf_dir), upsert.KEY, "ingest_seq")
    wanted = {*_ELECTED_BY, *(columns or ("company_name", "company_normalized", *POSTING_CONTENT))}
    # the search text takes a pattern over the whole text: it is read more often than it is written
    again = {c: parts for c, (parts, _) in remade().items() if c in wanted and c != "search_text"}
    stored = (wanted - set(again)).union(*again.values())
    rows = normalize_postings(last, more=_SEQS)
    names = [c for c in rows.columns if c in wanted]
    rows = stage(rows.select(*[c for c in rows.columns if c in stored], *_SEQS), "latest")
    return with_remade(rows, *again).select(*names, *_SEQS).withColumn(
        "first_seen_at", _as_of() - F.make_dt_interval(F.col("first_seq") % 30))


def postings(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """``latest`` with an exact-copy canonical; every ninth inactive."""
    seen = latest(spark, sf_dir, *columns)
    winners = dedup.elect_canonical(seen, "fingerprint").drop("members")
    return (seen.join(winners, "fingerprint")
            .withColumns({
                "canonical_job_id": F.when(F.col("id") != F.col("canonical_id"), F.col("canonical_id")),
                "last_seen_at": F.greatest("first_seen_at",
                                           _as_of() - F.make_dt_interval(F.col("last_seq") % 15)),
                "is_active": F.col("first_seq") % 9 != 0,
                "salary_currency": F.lit("IDR")})
            .drop("canonical_id"))


def _by_url(rows: DataFrame) -> DataFrame:
    """Postings with their address for id, in the pointers too."""
    to = rows.select(F.col("id").alias("canonical_job_id"), F.col("source_url").alias("__to"))
    return (rows.join(to, "canonical_job_id", "left").drop("canonical_job_id")
            .withColumnRenamed("__to", "canonical_job_id").withColumn("id", F.col("source_url")))


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = upsert.latest_per_key(normalized(spark, sf_dir), ("company_normalized",), "ingest_seq",
                                 "company_id", "company_name")
    return rows.select(F.col("company_id").alias("id"), F.col("company_name").alias("name"),
                       F.col("company_normalized").alias("name_normalized"))


def _tags(name: str = "stack"):
    return F.array_join(name, ",").alias(name)


# --- text jobs ---------------------------------------------------------------

@query
def normalized_postings(spark, sf_dir):
    """Every text column of every raw posting, structured in one projection."""
    return normalize_postings(posting_feed(spark, sf_dir)).select(
        "ingest_seq", "source_id", "source_url", "title", "title_normalized", "company_name",
        "company_normalized", "description", "salary_min", "salary_max", "salary_conf",
        "salary_raw", _tags(), "location", "location_city", "mode", "level", "source_job_id",
        "fingerprint", "posted_at")


@query
def clean_pages(spark, sf_dir):
    """Readable text of every web page."""
    return (table(spark, sf_dir, "pages")
            .select("page_id", F.octet_length("html").cast("long").alias("bytes_in"),
                    html_to_text(F.col("html")).alias("text"))
            .withColumn("bytes_out", F.octet_length("text").cast("long")))


@query
def clean_page_totals(spark, sf_dir):
    """Size reduction over all pages."""
    return clean_pages(spark, sf_dir).agg(
        F.count("*").alias("n_pages"), F.sum("bytes_in").alias("bytes_in"),
        F.sum("bytes_out").alias("bytes_out"))


@query
def salary_profile(spark, sf_dir):
    """Confidence of the parsed salaries per source, with totals of both bounds."""
    return normalized(spark, sf_dir).groupBy("source_id", "salary_conf").agg(
        F.count("*").alias("n"), F.sum("salary_min").alias("sum_min"),
        F.sum("salary_max").alias("sum_max"), F.count("salary_min").alias("n_min"),
        F.count("salary_max").alias("n_max"))


@query
def document_tags(spark, sf_dir):
    """Technology tags of the whole text of every document."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(text_tags(F.lit(""), F.col("text")), ",").alias("tags"))


@query
def user_dictionary_tags(spark, sf_dir):
    """Part names tagged with a dictionary that is itself a table."""
    part = table(spark, sf_dir, "part")
    words = (part.where(F.col("p_partkey") % 10 == 0)
             .select(F.substring_index("p_name", " ", 1).alias("alias")).distinct())
    tags = dictionary_tags(part, "p_partkey", "p_name", words.withColumn("tag", F.upper("alias")))
    return tags.select("p_partkey", F.array_join("tags", ",").alias("tags"))


@query
def dictionary_rows_tags(spark, sf_dir):
    """Tags of every posting event by the curated dictionary given as rows, guards included."""
    rows = spark.createDataFrame([(a.tag, a.alias, a.kind, a.not_after, a.not_before) for a in DEFAULT_DICTIONARY],
                                 "tag string, alias string, kind string, not_after string, not_before string")
    texts = stage(normalized(spark, sf_dir).select("ingest_seq", F.concat_ws("\n", "title", "description").alias("text")), "texts")
    return dictionary_tags(texts, "ingest_seq", "text", rows).select("ingest_seq", F.array_join("tags", ",").alias("tags"))


@query
def posting_tags(spark, sf_dir):
    """Long form: one row per posting event and tag."""
    return stats.tag_rows(normalized(spark, sf_dir), "ingest_seq")


@query
def mode_counts(spark, sf_dir):
    return normalized(spark, sf_dir).groupBy("mode").agg(F.count("*").alias("n"))


@query
def level_counts(spark, sf_dir):
    return normalized(spark, sf_dir).groupBy("level").agg(F.count("*").alias("n"))


@query
def city_counts(spark, sf_dir):
    return (normalized(spark, sf_dir).where(F.col("location_city").isNotNull())
            .groupBy("location_city").agg(F.count("*").alias("n")))


@query
def company_keys(spark, sf_dir):
    """Spellings and postings per company key."""
    return normalized(spark, sf_dir).groupBy("company_normalized").agg(
        F.countDistinct("company_name").alias("spellings"), F.count("*").alias("n"))


@query
def title_keys(spark, sf_dir):
    return normalized(spark, sf_dir).groupBy("title_normalized").agg(
        F.countDistinct("title").alias("spellings"), F.count("*").alias("n"))


@query
def fingerprint_groups(spark, sf_dir):
    """Exact-copy groups with their canonical posting."""
    rows = latest(spark, sf_dir, *_ELECTED_BY)
    return (dedup.elect_canonical(rows, "fingerprint").where(F.col("members") > 1)
            .join(rows.select(F.col("id").alias("canonical_id"), "source_url"), "canonical_id")
            .select("fingerprint", "members", F.col("source_url").alias("canonical_url")))


@query
def document_copies(spark, sf_dir):
    """Fingerprint groups over the whole text of every document."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", fingerprint(company_key(F.col("lang")), title_key(F.col("text"))).alias("fingerprint"))
    return (docs.groupBy("fingerprint")
            .agg(F.count("*").alias("members"), F.min("doc_id").alias("first_doc"))
            .where(F.col("members") > 1))


@query
def search_tokens(spark, sf_dir):
    """Search token table of the documents, summed up per token."""
    tokens = search.search_tokens(table(spark, sf_dir, "documents"), "doc_id",
                                  search_form(F.col("text")))
    return tokens.groupBy("token").agg(F.count("*").alias("n"), F.max("pos").cast("long").alias("max_pos"))


# --- page dumps ---------------------------------------------------------------

def parsed_pages(spark, sf_dir):
    return page_source.parse_pages(page_dump(spark, sf_dir))


@query
def crawl_plan(spark, sf_dir):
    """Pages to fetch per keyword: part names with wanted page counts."""
    words = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("keyword")).agg(
        (F.min("p_size") - 2).alias("max_pages"))
    return page_source.crawl_plan(words, BASE_URL)


@query
def page_postings(spark, sf_dir):
    """Raw postings of all good pages."""
    rows = page_source.raw_postings(parsed_pages(spark, sf_dir), BASE_URL, "keyword", "page")
    return rows.withColumn("pos", F.col("pos").cast("long")).withColumn(
        "posted_at", F.unix_micros(F.col("posted_at").cast("timestamp")))


@query
def page_errors(spark, sf_dir):
    """Pages without a readable payload."""
    return page_source.page_errors(parsed_pages(spark, sf_dir)).select("keyword", "page", "url", "error")


@query
def page_trim(spark, sf_dir):
    """Pages that each of two crawls would have kept, with the rows they bring.

    The second crawl holds every third keyword again.
    """
    number = F.substring_index("keyword", " ", -1).cast("long")
    twice = parsed_pages(spark, sf_dir).withColumn("crawl", F.explode(
        F.when(number % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    kept = page_source.trim_page_runs(twice, "crawl", "keyword")
    return kept.select("crawl", "keyword", "page", F.size("jobs").cast("long").alias("n_jobs"))


@query
def country_audit(spark, sf_dir):
    """Pages listing jobs of an unexpected country."""
    return page_source.country_audit(parsed_pages(spark, sf_dir), "keyword", "page").select(
        "keyword", "page", F.col("total_jobs").cast("long").alias("total_jobs"),
        F.col("wrong_country_jobs").cast("long").alias("wrong_country_jobs"),
        F.array_join("countries_seen", ",").alias("countries_seen"))


@query
def feed_union(spark, sf_dir):
    """Rows per feed when one of three feeds fails."""
    def broken():
        raise OSError("connection reset")

    feed = posting_feed(spark, sf_dir)
    rows, errors = union_feeds(spark, {
        "board": lambda: feed.select("source_url", "title"),
        "broken": broken,
        "parts": lambda: table(spark, sf_dir, "part").select(F.col("p_name").alias("title"))})
    counts = rows.groupBy("feed").agg(F.count("*").alias("n"), F.count("source_url").alias("n_urls"))
    return counts.join(errors, "feed", "full_outer").select(
        "feed", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_urls", F.lit(0)).alias("n_urls"),
        "error")


@query
def feed_errors(spark, sf_dir):
    """The errors of all feeds as one text; a feed per nation, every fifth of which fails."""
    def feed(key):
        def read():
            if key % 5 == 3:
                raise OSError(f"nation {key} does not answer")
            return table(spark, sf_dir, "supplier").where(F.col("s_nationkey") == key).select(F.col("s_name").alias("title"))
        return read

    keys = [r.n_nationkey for r in table(spark, sf_dir, "nation").select("n_nationkey").collect()]  # one row per feed
    rows, errors = union_feeds(spark, {f"n{k:02d}": feed(k) for k in keys})
    return error_text(errors).withColumn("n_rows", F.lit(rows.count()))


@query
def archived_pages(spark, sf_dir):
    """Pages archived in eight files, one of which is cut off in the middle: rows kept and errors per file."""
    root = f"{checkpoint_root(spark)}/archive-{uuid.uuid4().hex}"
    number = F.col("page_id")
    line = F.to_json(F.struct("page_id", "url", "html"))
    broken = F.when(number % 8 == 3, F.when(number < 83, line).when(number == 83, F.substring(line, 1, 40))).otherwise(line)
    (table(spark, sf_dir, "pages").select((number % 8).alias("part"), "page_id", broken.alias("value")).where("value IS NOT NULL")
     .repartition(8, "part").sortWithinPartitions("part", "page_id").select("part", "value")
     .write.partitionBy("part").text(root))
    rows, errors = read_archive(spark, root, "page_id long, url string, html string")
    kept = rows.groupBy((number % 8).alias("part")).agg(
        F.count("*").alias("n"), F.max("page_id").alias("last_page"), F.sum(F.length("html")).alias("chars"))
    failed = errors.count()  # at most one per file
    return kept.select("part", "n", "last_page", "chars", F.lit(failed).cast("long").alias("n_errors"))


@query
def seeded_sources(spark, sf_dir):
    """The seed rows beside the sources there are; a seed whose id is taken does not replace it."""
    have = source_table(spark, sf_dir).where(F.col("id") != 1).select("id", "slug")
    seeds = seed_sources(spark, dt.datetime(2024, 1, 1)).select("id", "slug")
    return have.unionByName(seeds.join(have, "id", "left_anti"))


# --- listing -------------------------------------------------------------------

@query
def tag_stats(spark, sf_dir):
    """Active canonical postings per technology, most common first."""
    return stats.tag_stats(postings(spark, sf_dir, "stack"))


@query
def active_count(spark, sf_dir):
    return stats.active_count(postings(spark, sf_dir, *_ELECTED_BY))


@query
def source_stats(spark, sf_dir):
    """Active canonical postings per source, sources without any included."""
    return stats.source_stats(source_table(spark, sf_dir), postings(spark, sf_dir, *_ELECTED_BY))


@query
def supplier_stats(spark, sf_dir):
    """Zero-preserving counts over nation and supplier."""
    heads = table(spark, sf_dir, "nation")
    counts = (table(spark, sf_dir, "supplier").where(F.col("s_acctbal") > 5000)
              .groupBy("s_nationkey").agg(F.count("*").alias("n")))
    return (heads.join(counts, heads["n_nationkey"] == counts["s_nationkey"], "left")
            .select("n_nationkey", "n_name", F.coalesce("n", F.lit(0)).alias("n")))


@query
def stats_bundle(spark, sf_dir):
    """Total, per-source and per-tag counts as one long table."""
    parts = stats.stats_bundle(source_table(spark, sf_dir), postings(spark, sf_dir, "stack"))
    return (parts["total"].select(F.lit("total").alias("part"), F.lit("").alias("name"),
                                  F.col("active_jobs").alias("n"))
            .unionAll(parts["by_source"].select(F.lit("source"), "slug", "active_jobs"))
            .unionAll(parts["by_tag"].select(F.lit("tag"), "tag", "job_count")))


@query
def kept_stats(spark, sf_dir):
    """The statistics after a change, from counts kept before and the changed postings alone.

    Every fourth posting is closed or opened, every sixth moves to the next source.
    """
    rows, seq = postings(spark, sf_dir, "stack"), F.col("first_seq")
    was = rows.where((seq % 4 == 1) | (seq % 6 == 2))
    now = was.withColumns({"is_active": F.when(seq % 4 == 1, ~F.col("is_active")).otherwise(F.col("is_active")),
                           "source_id": F.when(seq % 6 == 2, F.col("source_id") % 25 + 1).otherwise(F.col("source_id"))})
    counts = stage(stats.add_changes(stats.stat_changes(rows.limit(0), rows)), "counts")
    kept = stats.kept_bundle(source_table(spark, sf_dir), stats.add_changes(counts, stats.stat_changes(was, now)))
    return (kept["total"].select(F.lit("total").alias("part"), F.lit("").alias("name"), F.col("active_jobs").alias("n"))
            .unionAll(kept["by_source"].select(F.lit("source"), "slug", "active_jobs"))
            .unionAll(kept["by_tag"].select(F.lit("tag"), "tag", "job_count")))


_SHOWN = ("source_id", "source_url", "title", "salary_max", "mode", "level", "location_city",
          "posted_at")


@query
def list_filters(spark, sf_dir):
    """All postings passing every listing filter at once."""
    tests = search.listing_filters(stack=["Go", "Python", "React"], salary_min=5_000_000,
                                   mode="remote", city="%a_arta")
    rows = postings(spark, sf_dir, *_SHOWN, "stack").where(search.active_canonical())
    for test in tests:
        rows = rows.where(test)
    return rows.select(*_SHOWN, _tags())


@query
def list_page(spark, sf_dir):
    """First page of the senior postings that mention a phrase."""
    page = search.list_postings(
        postings(spark, sf_dir, *_SHOWN, "stack", "search_text").withColumn("id", F.col("source_url")), limit=50, level="senior",
        text={"all_of": ["tools", "build r d"], "any_of": ["java", "data platform"],
              "none_of": ["kafka"]})
    return page.select(*_SHOWN, _tags())


@query
def keyset_page(spark, sf_dir):
    """A page behind a cursor over the orders, unknown dates last."""
    return search.keyset_page(_orders(spark, sf_dir), 100, (_cursor_date(), 5000),
                              "posted_at", "o_orderkey")


@query
def keyset_page_unknown(spark, sf_dir):
    """A page behind a cursor whose own date is unknown."""
    return search.keyset_page(_orders(spark, sf_dir), 100, (None, 9000), "posted_at", "o_orderkey")


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderdate")).alias("posted_at"))


def _cursor_date():
    # the orders carry dates without a zone; the literal has the same type
    return F.lit("1997-03-04").cast("timestamp_ntz")


@query
def page_boundaries(spark, sf_dir):
    """Cursors of all full pages of the orders."""
    return search.page_boundaries(_orders(spark, sf_dir), 20, "posted_at", "o_orderkey")


@query
def next_cursors(spark, sf_dir):
    """For pages of 20 of the orders of each day in one week: the cursor behind the first page, if it is full."""
    found = []
    for day in range(1, 8):
        date = f"1997-03-{day:02d}"
        rows = _orders(spark, sf_dir).where(F.to_date("posted_at") == date)
        page = search.keyset_page(rows, 20, None, "posted_at", "o_orderkey")
        cursor = search.next_cursor(page, 20, "posted_at", "o_orderkey")
        found.append((date, None if cursor is None else cursor[1]))
    return spark.createDataFrame(found, "day string, last_key long")


@query
def text_search(spark, sf_dir):
    """Documents by terms, alternatives, exclusions and a phrase."""
    form = search_form(F.col("text"))
    hit = search.text_matches(form, all_of=["the", "of the"], any_of=["that", "with"],
                              none_of=["license"])
    return table(spark, sf_dir, "documents").where(hit).select("doc_id", "lang", "source")


@query
def token_search(spark, sf_dir):
    """Documents holding every asked token, by the token table."""
    tokens = search.search_tokens(table(spark, sf_dir, "documents"), "doc_id",
                                  search_form(F.col("text")))
    return search.search_by_tokens(tokens, ["the", "and", "That"])


@query
def token_terms(spark, sf_dir):
    """Documents by terms, alternatives, exclusions and phrases, by the token table."""
    tokens = search.search_tokens(table(spark, sf_dir, "documents"), "doc_id", search_form(F.col("text")))
    return search.search_by_tokens(tokens, all_of=["the", "of the"], any_of=["that", "with the"],
                                   none_of=["license", "and of the"])


@query
def token_index_search(spark, sf_dir):
    """Terms and a phrase by a token table that two changes kept current.

    First every seventh document gets another sentence, then every eleventh
    goes and some come back to what they were.
    """
    number = F.col("doc_id")
    forms = lambda df, text: df.select("doc_id", search_form(text).alias("form"))
    docs = table(spark, sf_dir, "documents")
    longer = F.concat_ws(" ", "text", F.lit("Seen again at"), "source")
    first = forms(docs, F.col("text"))
    second = forms(docs, F.when(number % 7 == 0, longer).otherwise(F.col("text")))
    third = forms(docs.where(number % 11 != 0), F.when((number % 7 == 0) & (number % 3 != 0), longer).otherwise(F.col("text")))
    tokens = current_tokens(stage(with_markers(first), "tokens"), stage(token_changes(first, second), "tokens"),
                            stage(token_changes(second, third, whole=True), "tokens"))
    return search.search_by_tokens(tokens, all_of=["the"], any_of=["again at src1", "that"], none_of=["again at src2"])


@query
def posting_lookup(spark, sf_dir):
    """Posting by key in any state, and its source by slug."""
    rows = search.by_id(postings(spark, sf_dir, "title"), f"{BASE_URL}/jobs/54", "source_url")
    src = search.by_id(source_table(spark, sf_dir), "nation_0", "slug")
    slugs = src.select(F.col("id").alias("source_id"), "slug")
    return rows.join(slugs, "source_id").select("source_url", "title", "is_active", "slug")


@query
def company_lookup(spark, sf_dir):
    """Companies of the active remote postings (membership join)."""
    ids = (postings(spark, sf_dir, "mode", "company_id").where(search.active_canonical() & (F.col("mode") == "remote"))
           .select(F.col("company_id").alias("id")))
    return search.by_ids(companies(spark, sf_dir), ids).select("name", "name_normalized")


@query
def posting_companies(spark, sf_dir):
    """Display name of every active canonical posting."""
    rows = postings(spark, sf_dir, "company_id").where(search.active_canonical())
    return search.with_company(rows, companies(spark, sf_dir)).select("source_id", "source_url", "company")


@query
def posting_json(spark, sf_dir):
    """Public JSON of every active canonical posting."""
    rows = postings(spark, sf_dir, *(c for c in POSTING_CONTENT if c != "search_text")).where(search.active_canonical())
    named = search.with_company(rows, companies(spark, sf_dir)).withColumn("id", F.col("source_url"))
    return search.public_json(named)


@query
def posting_detail(spark, sf_dir):
    """Every fiftieth posting asked for, with the listings merged into it."""
    rows = _by_url(postings(spark, sf_dir, "title", "company_id"))
    asked = rows.where(F.col("first_seq") % 50 == 4).select("id")
    return search.details(rows, companies(spark, sf_dir), asked).select(
        "asked_id", "role", "source_url", "title", "company", "first_seq")


@query
def canonical_duplicates(spark, sf_dir):
    """Every duplicate next to its canonical posting."""
    rows = postings(spark, sf_dir, "title")
    urls = rows.select(F.col("id").alias("canonical_id"), F.col("source_url").alias("canonical_url"))
    return (dedup.duplicates_of(rows).join(urls, "canonical_id")
            .select("canonical_url", "canonical_title", "source_url", "title"))


# --- duplicates ------------------------------------------------------------------

@query
def trigram_pairs(spark, sf_dir):
    """Trigram similarity of every part's name and its size class with the name."""
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_name").alias("a"),
        F.concat_ws(" ", "p_type", F.substring_index("p_name", " ", -1)).alias("b"))
    return pair_similarity(parts, "a", "b").withColumns({
        "shared": F.col("shared").cast("long"), "total": F.col("total").cast("long")})


@query
def near_duplicates(spark, sf_dir):
    """Similar titles of one company in the feed."""
    pairs = similar_pairs(normalized(spark, sf_dir), "company_normalized", "title_normalized")
    return pairs.select("block", "text_a", "text_b", F.col("shared").cast("long").alias("shared"),
                        F.col("total").cast("long").alias("total"))


@query
def part_near_duplicates(spark, sf_dir):
    """Similar part names of one brand: few blocks, nearly all names distinct."""
    name = F.concat_ws(" ", "p_name", "p_type", F.col("p_size").cast("string"))
    parts = table(spark, sf_dir, "part").select("p_brand", title_key(name).alias("name"))
    return similar_pairs(parts, "p_brand", "name").select(
        "block", "text_a", "text_b", F.col("shared").cast("long").alias("shared"),
        F.col("total").cast("long").alias("total"))


@query
def part_name_groups(spark, sf_dir):
    """Part names of one brand that any chain of similar names links, with the group's first name."""
    name = title_key(F.concat_ws(" ", "p_name", "p_type", F.col("p_size").cast("string")))
    parts = (table(spark, sf_dir, "part").select("p_brand", name.alias("name"))
             .withColumn("node", F.concat_ws("/", "p_brand", "name")))
    groups = connected_components(spanning_edges(parts, "p_brand", "name", "node"))
    return groups.select("node", "component")


@query
def duplicate_groups(spark, sf_dir):
    """Duplicate groups over exact and similar titles, one row per key."""
    groups = dedup.duplicate_groups(
        latest(spark, sf_dir, *dedup.NODE).withColumn("id", F.col("source_url")))
    return groups.select("fingerprint", "title_normalized", "members", "component", "canonical_id")


@query
def canonical_pointers(spark, sf_dir):
    """Resolved pointer of every posting, NULL for canonical ones."""
    rows = (latest(spark, sf_dir, *dedup.NODE).withColumn("canonical_job_id", F.lit(None).cast("string"))
            .withColumn("id", F.col("source_url")))
    return dedup.resolve(rows)


@query
def reparented(spark, sf_dir):
    """Pointers after every canonical of one source moved to a new one."""
    flat = _by_url(postings(spark, sf_dir, *_ELECTED_BY))
    moved = (flat.where(F.col("canonical_job_id").isNull() & (F.col("source_id") == 2))
             .select(F.col("id").alias("old_id"), F.concat(F.col("id"), F.lit("#new")).alias("new_id")))
    return dedup.reparent(flat, moved).where(F.col("canonical_job_id").isNotNull()).select(
        "id", "canonical_job_id")


@query
def settled_moves(spark, sf_dir):
    """Followers of moved customers: chains of up to 49 moves; in every seventh fifty they go round.

    Orders are postings that point at customers, the last of each fifty is where a chain ends.
    """
    key = F.col("c_custkey")
    moves = (table(spark, sf_dir, "customer").where((key % 50 != 0) | (F.floor((key - 1) / 50) % 7 == 0))
             .select(key.alias("old_id"), F.when(key % 50 == 0, key - 49).otherwise(key + 1).alias("new_id")))
    settled, _ = dedup.settle_moves(moves)
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("canonical_job_id"))
    return dedup.reparent(orders, settled).select("id", "canonical_job_id")


@query
def rejected_moves(spark, sf_dir):
    """Moves of the same kind that run into a cycle."""
    key = F.col("p_partkey")
    moves = (table(spark, sf_dir, "part").where((key % 20 != 0) | (F.floor((key - 1) / 20) % 3 == 0))
             .select(key.alias("old_id"), F.when(key % 20 == 0, key - 13).otherwise(key + 1).alias("new_id")))
    return dedup.settle_moves(moves)[1]


@query
def manual_merges(spark, sf_dir):
    """Hand-made merges: accepted pointers, the last one per posting, and rejected ones."""
    rows = (latest(spark, sf_dir, *_ELECTED_BY).withColumn("canonical_job_id", F.lit(None).cast("string"))
            .withColumn("id", F.col("source_url")))
    first = F.col("first_seq") - F.col("first_seq") % 50
    url = lambda n: F.concat(F.lit(f"{BASE_URL}/jobs/"), n.cast("string"))
    merges = (rows.where(F.col("first_seq") % 50 < 2)
              .select(F.col("id").alias("job_id"), F.lit(1).alias("seq"), url(first).alias("canonical_id"))
              .unionAll(rows.where(F.col("first_seq") % 50 == 1)
                        .select("id", F.lit(2), url(first + 52))))
    merged, rejected = dedup.manual_merge(rows, merges, "seq")
    done = merged.where(F.col("canonical_job_id").isNotNull()).select(
        "id", "canonical_job_id", F.lit(None).cast("string").alias("error"))
    return done.unionAll(rejected.select("job_id", "canonical_id", "error"))


# --- table maintenance --------------------------------------------------------------

@query
def company_upsert(spark, sf_dir):
    """Companies after a batch met a table that knows part of them."""
    batch = normalized(spark, sf_dir)
    old = (batch.where(F.col("ingest_seq") % 4 == 0).groupBy("company_normalized")
           .agg(F.min("company_name").alias("name"))
           .select(F.concat(F.lit("old-"), F.col("company_normalized")).alias("id"), "name",
                   F.col("company_normalized").alias("name_normalized"),
                   F.lit(None).cast("string").alias("logo_url"), _as_of().alias("created_at")))
    merged = upsert.upsert_companies(old, batch, _as_of())
    return merged.select("name_normalized", "name", F.startswith("id", F.lit("old-")).alias("kept_id"))


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", "value", "ts")


@query
def latest_events(spark, sf_dir):
    """Last version per (user, type) of the event stream."""
    return upsert.latest_per_key(_events(spark, sf_dir), ("user_id", "event_type"), "event_id",
                                 "value", "ts")


@query
def posting_upsert(spark, sf_dir):
    """Postings after the second half of the feed met a table of the first half."""
    rows = normalized(spark, sf_dir)
    half = F.col("ingest_seq") % 10 != 9
    first = upsert.latest_events(rows.where(half), upsert.KEY, "ingest_seq")
    old_time = _as_of() - F.make_dt_interval(F.lit(30))
    target = first.withColumns({
        "salary_currency": F.lit("IDR"), "canonical_job_id": F.when(F.col("first_seq") % 5 == 0, F.lit("kept")),
        "first_seen_at": old_time, "last_seen_at": old_time, "is_active": F.lit(False)})
    batch = upsert.latest_events(
        rows.where(~half).unionByName(rows.where(half & (F.col("ingest_seq") % 50 == 0))
                                      .withColumn("source_url", F.concat("source_url", F.lit("/b")))),
        upsert.KEY, "ingest_seq")
    out = upsert.upsert_postings(target, batch, _as_of())
    return out.select("source_id", "source_url", "title", "salary_max", "posted_at", "canonical_job_id",
                      "first_seen_at", "last_seen_at", "is_active", "first_seq")


@query
def event_outcomes(spark, sf_dir):
    """Inserted or refreshed, per event."""
    return upsert.event_outcomes(_events(spark, sf_dir), ("user_id", "event_type"), "event_id").select(
        "event_id", "was_inserted")


@query
def run_counters(spark, sf_dir):
    """Found, new, duplicate and failed events per day."""
    rows = (upsert.event_outcomes(_events(spark, sf_dir), ("user_id", "event_type"), "event_id")
            .withColumns({"failed": F.col("value") > 300, "is_duplicate": F.col("value") < 5,
                          "day": F.to_date("ts")}))
    return upsert.run_counters(rows, "day")


@query
def run_ledger(spark, sf_dir):
    """One ledger row per source run, with status and error text."""
    rows = (upsert.event_outcomes(normalized(spark, sf_dir), upsert.KEY, "ingest_seq")
            .withColumns({"failed": F.col("ingest_seq") % 101 == 0, "is_duplicate": F.lit(False)}))
    counts = upsert.run_counters(rows, "source_id")
    sources = source_table(spark, sf_dir).select(F.col("id").alias("source_id"))
    source_failed = F.col("source_id").isin(3, 4)
    found = F.coalesce("jobs_found", F.lit(0))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("jobs_found", "jobs_new", "jobs_duplicate", "jobs_failed")}
    return (sources.join(counts, "source_id", "left")
            .withColumn("status", upsert.run_status(found, source_failed))
            .withColumns(zero)
            .withColumn("error_message", F.nullif(F.concat_ws(
                "\n", F.when(source_failed, "source error"),
                F.when(F.col("jobs_failed") > 0, F.concat(F.col("jobs_failed").cast("string"),
                                                          F.lit(" failed rows")))), F.lit(""))))


@query
def source_last_run(spark, sf_dir):
    """Sources stamped by the runs of the feed."""
    ran = normalized(spark, sf_dir).select("source_id")
    return upsert.stamp_sources(source_table(spark, sf_dir), ran, _as_of()).select(
        "id", "slug", "last_run_at")


@query
def stale_sweep(spark, sf_dir):
    """Latest events per key that a seven-day sweep deactivates."""
    latest = upsert.latest_per_key(_events(spark, sf_dir), ("user_id", "event_type"), "event_id", "ts")
    rows = latest.withColumnRenamed("ts", "last_seen_at").withColumn("is_active", F.col("user_id") % 10 != 0)
    return upsert.sweep(rows, F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")).select(
        "user_id", "event_type", "is_active", "was_stale")


@query
def constraint_audit(spark, sf_dir):
    """Violations over the order tables."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    customers, events = table(spark, sf_dir, "customer"), table(spark, sf_dir, "events")
    return audit.violations(
        audit.duplicate_keys(lines, "line is unique", "l_orderkey", "l_linenumber"),
        audit.orphans(lines, "order exists", "l_orderkey", orders.where(F.col("o_orderkey") % 97 != 0), "o_orderkey"),
        audit.orphans(orders, "customer exists", "o_custkey", customers, "c_custkey"),
        audit.outside_set(events, "event type", "event_type", ("view", "click", "purchase")),
        audit.missing(_orders(spark, sf_dir), "required value", "o_orderkey", "posted_at"))


@query
def posting_audit(spark, sf_dir):
    """Violations over the posting tables with some damage done to them."""
    rows = postings(spark, sf_dir)
    damaged = rows.withColumns({
        "id": F.col("source_url"), "company_id": F.col("company_normalized"),
        "source_id": F.when(F.col("first_seq") % 500 == 1, 99).otherwise(F.col("source_id")),
        "mode": F.when(F.col("first_seq") % 300 == 2, "moon").otherwise(F.col("mode")),
        "level": F.when(F.col("first_seq") % 400 == 3, None).otherwise(F.col("level")),
        "canonical_job_id": F.when(F.col("first_seq") % 40 == 4, F.concat(
            F.lit(f"{BASE_URL}/jobs/"), (F.col("first_seq") + 40).cast("string")))})
    firms = companies(spark, sf_dir).withColumn("id", F.col("name_normalized")).where(
        F.col("name_normalized") != "customer 7")
    return audit.audit_postings(damaged, firms, source_table(spark, sf_dir))


# --- whole runs -----------------------------------------------------------------

def _sources(spark, sf_dir):
    return source_table(spark, sf_dir).withColumns({
        "last_run_at": F.col("last_run_at").cast("timestamp"), "created_at": F.lit("2024-01-01").cast("timestamp")})


def _damaged_feed(spark, sf_dir):
    """The feed with texts, addresses and sources that cannot be stored."""
    seq = F.col("ingest_seq")
    return posting_feed(spark, sf_dir).withColumns({
        "title": F.when(seq % 101 == 0, F.concat("title", F.lit("\x00"))).otherwise(F.col("title")),
        "source_url": F.when(seq % 107 != 0, F.col("source_url")),
        "source_id": F.when(seq % 103 == 0, 99).otherwise(F.col("source_id"))})


def _ingested(spark, sf_dir):
    """One run of the whole feed into empty tables; every source counts as one."""
    empty = {n: spark.createDataFrame([], t) for n, t in TABLES.items()}
    return ingest(_damaged_feed(spark, sf_dir), empty["companies"], empty["jobs"],
                  _sources(spark, sf_dir), Run("feed", 1, AS_OF))


def _run_jobs(spark, outcome, *columns: str) -> DataFrame:
    """``columns`` of the jobs a run leaves, with the address of their canonical posting.

    They are written once, what the run staged behind its normalized batch
    goes, and only postings with a canonical one look it up.
    """
    _ = outcome.errors  # read from the normalized batch, which stays
    with staging(spark):
        jobs = outcome.jobs.select("id", *upsert.KEY, "canonical_job_id", *columns)
        jobs = stage(left_out(jobs, "id"), "jobs", outer=True)
    to = put_back(jobs, "id").select(dedup.pack(F.col("id")).alias("__to"), F.col("source_url").alias("canonical_url"))
    moved = F.col("canonical_job_id").isNotNull()
    found = jobs.where(moved).withColumn("__to", dedup.pack(F.col("canonical_job_id"))).join(to, "__to", "left").drop("__to")
    return found.unionByName(jobs.where(~moved).withColumn("canonical_url", F.lit(None).cast("string"))).drop("id", "canonical_job_id")


@query
def ingest_jobs(spark, sf_dir):
    """Stored postings after a run, with the address of their canonical posting."""
    return _run_jobs(spark, _ingested(spark, sf_dir), "title", "salary_min", "first_seq", "is_active").select(
        "source_id", "source_url", "title", "canonical_url", "salary_min", "first_seq", "is_active")


@query
def ingest_ledger(spark, sf_dir):
    """Counters, status and error text of that run."""
    return _ingested(spark, sf_dir).run.select(
        "id", "status", "jobs_found", "jobs_new", "jobs_duplicate", "jobs_failed", "error_message")


@query
def ingest_errors(spark, sf_dir):
    """Rows the run could not store."""
    return _ingested(spark, sf_dir).errors.select("ingest_seq", "source_url", "error")


def _second_run(spark, sf_dir):
    """A second run against the tables a first one left ten days before.

    The first run holds all first deliveries. Since then every seventh posting
    was closed, and every second one was seen five days ago. The second run
    refreshes some postings and brings others with an earlier date under a new
    address.
    """
    feed = posting_feed(spark, sf_dir).withColumn("posted_at", F.col("posted_at").cast("timestamp"))
    seq, as_of = F.col("ingest_seq"), F.lit(AS_OF).cast("timestamp")
    empty = {n: spark.createDataFrame([], t) for n, t in TABLES.items()}
    before = ingest(feed.where(seq % 10 != 9), empty["companies"], empty["jobs"], _sources(spark, sf_dir),
                    Run("first", 1, FIRST_RUN))
    jobs = stage(before.jobs.withColumns({
        "is_active": F.col("first_seq") % 7 != 0,
        "last_seen_at": F.when(F.col("first_seq") % 2 == 0, as_of - F.make_dt_interval(F.lit(5)))
        .otherwise(F.col("last_seen_at"))}), "first-jobs")
    companies_before = stage(before.companies.drop("was_touched"), "first-companies")
    copies = feed.where(seq % 50 == 0).withColumns({
        "source_url": F.concat("source_url", F.lit("/b")), "ingest_seq": seq + 1_000_000_000,
        "posted_at": F.col("posted_at") - F.make_dt_interval(F.lit(400))})
    batch = feed.where(seq % 10 == 9).unionByName(copies)
    return ingest(batch, companies_before, jobs, before.sources, Run("second", 1, AS_OF))


@query
def ingest_second_run(spark, sf_dir):
    """Stored postings after a second run: refreshes, displaced canonicals, reopened and stale postings."""
    return _run_jobs(spark, _second_run(spark, sf_dir), "title", "first_seq", "is_active").select(
        "source_id", "source_url", "title", "canonical_url", "first_seq", "is_active")


@query
def ingest_second_ledger(spark, sf_dir):
    """Counters of that second run."""
    return _second_run(spark, sf_dir).run.select(
        "id", "status", "jobs_found", "jobs_new", "jobs_duplicate", "jobs_failed", "deactivated")


@query
def pages_ingest(spark, sf_dir):
    """From a page dump to stored postings: decode, trim, flatten, one run of the feed's source."""
    store = SnapshotStore(spark, f"{checkpoint_root(spark)}/pages-{uuid.uuid4().hex}")
    store.write("sources", _sources(spark, sf_dir))

    def dump(s, max_pages):
        parsed = page_source.trim_page_runs(stage(parsed_pages(s, sf_dir), "parsed"))
        rows = page_source.raw_postings(parsed, BASE_URL, "keyword", "page")
        return arrival_order(rows, "keyword", "page", "pos")

    run_feed(store, FeedRegistry({"nation_1": dump}), "nation_1", "pages", AS_OF)
    jobs = store.read("jobs")
    to = jobs.select(F.col("id").alias("canonical_job_id"), F.col("source_url").alias("canonical_url"))
    return jobs.join(to, "canonical_job_id", "left").select(
        "source_id", "source_url", "title", "salary_min", "salary_max", "mode", "location_city", "canonical_url")


@query
def stream_ingest(spark, sf_dir):
    """The feed as a folder of files, ingested by a stream in two runs over one checkpoint."""
    root = f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"
    feed = posting_feed(spark, sf_dir)
    raw = feed.select(*[F.col(f.name).cast(f.dataType) for f in RAW_POSTINGS])
    # first everything, then the latest version of some postings again: a refresh
    # leaves content, pointers and groups as they are
    again = raw.where(F.col("ingest_seq") % 10 == 9).withColumn("ingest_seq", F.col("ingest_seq") + 1_000_000_000)
    store = SnapshotStore(spark, f"{root}/store")
    store.write("sources", _sources(spark, sf_dir))
    name = f"feed-{uuid.uuid4().hex}"
    for part in (raw, again):  # the stream goes on from its checkpoint
        part.write.mode("append").parquet(f"{root}/raw")
        start_ingest(raw_posting_stream(spark, f"{root}/raw"), store, 1, name, lambda: AS_OF).awaitTermination()
    jobs = store.read("jobs")
    to = jobs.select(F.col("id").alias("canonical_job_id"), F.col("source_url").alias("canonical_url"))
    return jobs.join(to, "canonical_job_id", "left").select("source_id", "source_url", "title", "canonical_url")


@query
def stream_repeats(spark, sf_dir):
    """Deliveries per source that pass a stream which drops repeats: some come again at once, some with another title."""
    root = f"{checkpoint_root(spark)}/repeats-{uuid.uuid4().hex}"
    raw = posting_feed(spark, sf_dir).select(*[F.col(f.name).cast(f.dataType) for f in RAW_POSTINGS])
    seq = F.col("ingest_seq")
    again = raw.where(seq % 3 == 0)
    renamed = raw.where(seq % 5 == 0).withColumn("title", F.concat("title", F.lit(" II")))
    for part in (raw, again.unionAll(renamed)):
        part.write.mode("append").parquet(f"{root}/raw")
        (without_repeats(spark, f"{root}/raw").writeStream.format("parquet").option("path", f"{root}/out")
         .option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(f"{root}/out").groupBy("source_id").agg(F.count("*").alias("n"))


@query
def replay_pointers(spark, sf_dir):
    """Pointers that the whole feed leaves when taken one event after the other."""
    events = normalized(spark, sf_dir).select(
        F.col("ingest_seq").alias("seq"), F.col("source_url").alias("id"), *dedup.NODE, "posted_at",
        _as_of().alias("first_seen_at"), F.col("ingest_seq").alias("first_seq"))
    return replay(events)[1]
