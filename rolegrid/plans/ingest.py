"""One ingestion run over a batch of raw postings, as set operations.

normalize -> companies -> postings -> duplicates -> counters -> ledger ->
stamp -> stale sweep. A bad row is recorded and never stops the run.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegrid.functions.tags import DEFAULT_DICTIONARY
from rolegrid.operators import dedup, stats, upsert
from rolegrid.operators.normalize import left_out, normalize_postings, put_back, remade, with_remade
from rolegrid.operators.token_index import token_changes
from rolegrid.schemas import (DEFAULT_STALE_DAYS, POSTING_CONTENT, POSTINGS, RAW_POSTINGS,
                              RUN_ERRORS, SCRAPE_RUNS, SOURCES)
from rolegrid.session import stage, staging, use_skew_settings
from rolegrid.sources.feeds import FeedRegistry, UnknownFeed, arrival_order
from rolegrid.sources.tables import SnapshotStore

NULL_TEXT = "text holds a null character"
NO_URL = "posting has no address"
NO_SOURCE = "source does not exist"
_STORED_TEXT = ("title", "description", "salary_raw", "location", "location_city",
                "source_url", "source_job_id", "company_name")
_HASHES = ("id", "fingerprint", "company_id")


@dataclass(frozen=True)
class Run:
    """Identity of a run: ``as_of`` is its one clock reading."""

    run_id: str
    source_id: int
    as_of: str  # UTC timestamp text
    source_error: str | None = None
    stale_days: int = DEFAULT_STALE_DAYS

    def clock(self) -> Column:
        return F.lit(self.as_of).cast("timestamp")


def _has_null_char(name: str) -> Column:
    return F.coalesce(F.contains(F.col(name), F.lit("\x00")), F.lit(False))


def split_bad_rows(normalized: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows the tables accept, and the others with their error."""
    null_char = reduce(lambda a, b: a | b, [_has_null_char(c) for c in _STORED_TEXT])
    known = sources.select(F.col("id").alias("source_id"), F.lit(True).alias("__source")).distinct()
    checked = (normalized.join(known, "source_id", "left")
               .withColumn("error", F.when(null_char, NULL_TEXT)
                           .when(F.col("source_url").isNull() | (F.col("source_url") == ""), NO_URL)
                           .when(F.col("__source").isNull(), NO_SOURCE)).drop("__source"))
    return (checked.where(F.col("error").isNull()).drop("error"),
            checked.where(F.col("error").isNotNull()).select("ingest_seq", "source_url", "error"))


class Outcome:
    """State of the tables after a run, each part made when it is first asked for.

    ``was_touched`` of companies tells the rows that differ from before, jobs
    come as ``changed`` and ``unchanged``, ``tokens`` and ``counts`` are the
    changes of the search token table and of the statistics. What a part does
    not need is not made for it: the errors stand once the batch is normalized.
    Hashes are not staged where their parts are (``normalize.left_out``).
    """

    def __init__(self, events: DataFrame, companies: DataFrame, jobs: DataFrame, sources: DataFrame,
                 run: Run, dictionary):
        self._events, self._companies, self._jobs, self._sources = events, companies, jobs, sources
        self._run, self._dictionary, self._as_of = run, dictionary, run.clock()

    @cached_property
    def _normalized(self) -> DataFrame:
        raw = self._events.select(*[F.col(f.name).cast(f.dataType) for f in RAW_POSTINGS])
        return stage(normalize_postings(raw, self._dictionary).drop(*remade()), "normalized")

    @cached_property
    def _split(self) -> tuple[DataFrame, DataFrame]:
        good, bad = split_bad_rows(self._normalized, self._sources)
        return good.withColumn("version", F.xxhash64(*good.columns)), bad

    @cached_property
    def companies(self) -> DataFrame:
        # a company is kept even if its posting fails
        named = with_remade(self._normalized.where(~_has_null_char("company_name")), "company_id")
        return upsert.upsert_companies(self._companies, named, self._as_of)

    @cached_property
    def _batch(self) -> DataFrame:
        # narrow columns decide what changes; whole rows are read for changes alone
        ids = self.companies.select(F.col("name_normalized").alias("company_normalized"), F.col("id").alias("company_id"))
        content = tuple(c for c in upsert.STATE if c in POSTING_CONTENT and c not in remade())
        rows = upsert.latest_per_key(self._split[0], upsert.KEY, "ingest_seq", "version", "company_normalized", *content)
        rows = stage(left_out(rows.join(ids, "company_normalized"), "company_id"), "batch")
        return rows.withColumns({c: F.lit(None).cast("string") for c in ("id", "fingerprint")})

    @cached_property
    def _states(self) -> DataFrame:
        """Every posting after the batch, its hashes left out: they are put back behind the shuffles."""
        return upsert.posting_states(left_out(self._jobs, "id"), self._batch, self._as_of, ("company_normalized", "last_seq", "version"))

    @cached_property
    def _open_rows(self) -> DataFrame:
        # stored canonicals were compared with each other when they came: only the
        # touched ones are compared again, with all open postings of their company
        rows = put_back(
            self._states.where(F.col("canonical_job_id").isNull())
            .select("id", *upsert.KEY, *dedup.NODE, "company_normalized", "posted_at", "first_seen_at", "first_seq",
                    "was_added", F.col("was_touched").alias("changed")), *_HASHES)
        found = rows.where("changed")  # a touched posting has its company in the batch
        if self._jobs.take(1):
            found = found.unionByName(dedup.related(rows.where(~F.col("changed")), put_back(self._batch, *_HASHES)))
        return stage(left_out(found, *_HASHES), "open")

    @property
    def _open(self) -> DataFrame:
        return put_back(self._open_rows, *_HASHES)

    @cached_property
    def _members(self) -> DataFrame:
        """The open postings that share a group with others."""
        rows = self._open_rows  # outlives the block, unlike what the groups take on the way
        with staging(rows.sparkSession):
            groups = stage(dedup.shared_prints(self._open.drop(*upsert.KEY, "company_normalized"), packed=True), "groups", outer=True)
        prints = rows.withColumn("print", dedup.pack(F.coalesce("fingerprint", remade()["fingerprint"][1])))
        met = put_back(prints.join(groups, "print").drop("print"), *_HASHES)
        return met.withColumn("canonical_id", dedup.unpack(F.col("canonical_id")))

    @cached_property
    def _changes_left(self) -> DataFrame:
        pointers = self._members.select("id", F.when(F.col("id") != F.col("canonical_id"), F.col("canonical_id"))
                                        .alias("canonical_id"))
        pointed = dedup.apply_pointers(self._states, pointers, F.coalesce("id", remade()["id"][1]))
        moved = upsert.sweep(pointed, self._as_of, self._run.stale_days)
        changes = moved.where("was_touched or was_moved or was_stale")
        # the other hashes of a touched posting are those of its batch row, of the others those stored
        return stage(changes.drop("fingerprint", "title_normalized", "posted_at", "company_normalized"), "changes")

    @property
    def _changes(self) -> DataFrame:
        return put_back(self._changes_left, "id")

    @property
    def _known(self) -> DataFrame:
        """The changes of postings that were stored before."""
        return self._changes.where(~F.col("was_added"))

    @cached_property
    def _touched(self) -> DataFrame:
        """Whole rows of the postings that the batch holds: their state beside the text of the last delivery."""
        version = [*upsert.KEY, "ingest_seq", "version"]
        states = self._changes_left.where("was_touched").withColumnRenamed("last_seq", "ingest_seq")
        rows = self._split[0].join(states, version).dropDuplicates(version)  # a row delivered twice is one row
        return with_remade(put_back(rows, "id", "company_id"), "fingerprint", "search_text")

    @cached_property
    def changed(self) -> DataFrame:
        return upsert.changed_postings(self._jobs, self._touched, self._changes)

    @cached_property
    def unchanged(self) -> DataFrame:
        return self._jobs.join(self._known.select("id"), "id", "left_anti").select(POSTINGS.fieldNames())

    @property
    def jobs(self) -> DataFrame:
        return self.unchanged.unionByName(self.changed)

    @cached_property
    def sources(self) -> DataFrame:
        ran = self._events.sparkSession.createDataFrame([(self._run.source_id,)], "source_id int")
        return upsert.stamp_sources(self._sources, ran, self._as_of).select(SOURCES.fieldNames())

    @cached_property
    def errors(self) -> DataFrame:
        return self._split[1].withColumn("run_id", F.lit(self._run.run_id)).select(RUN_ERRORS.fieldNames())

    @cached_property
    def run(self) -> DataFrame:
        arrivals = self._members.withColumn("component", F.col("canonical_id")).withColumn(
            "arrival", F.when(F.col("was_added"), F.col("first_seq") + 1).otherwise(F.lit(0)))
        late = dedup.duplicate_on_arrival(arrivals).where(F.col("was_added") & F.col("arrived_duplicate"))
        added = self._open.where(F.col("was_added") & F.col("title_normalized").isNotNull())
        return _ledger(self._run, _counters(self._run, self._normalized, self._split[1], added, late, self._changes))

    @cached_property
    def tokens(self) -> DataFrame:
        touched = self._touched.select(F.col("id").alias("doc_id"), F.col("search_text").alias("form"))
        stored = (self._jobs.join(self._known.where("was_touched").select("id"), "id", "left_semi")
                  .select(F.col("id").alias("doc_id"), F.col("search_text").alias("form")))
        return token_changes(stored, touched)

    @cached_property
    def counts(self) -> DataFrame:
        was = self._jobs.join(self._known.select("id"), "id", "left_semi").select(*stats.COUNTED)
        return stats.stat_changes(was, self.changed.select(*stats.COUNTED))


def ingest(events: DataFrame, companies: DataFrame, jobs: DataFrame, sources: DataFrame,
           run: Run, dictionary=DEFAULT_DICTIONARY) -> Outcome:
    """New state of every table after one run; nothing is written but intermediates."""
    use_skew_settings(events.sparkSession)
    return Outcome(events, companies, jobs, sources, run, dictionary)


_KINDS = {"null_text": NULL_TEXT, "no_url": NO_URL, "no_source": NO_SOURCE}


def _counters(run: Run, events: DataFrame, bad: DataFrame, added: DataFrame, late: DataFrame,
              swept: DataFrame) -> DataFrame:
    """One row of counters: every part is counted on its own and then summed.

    New are the added postings but those that came after a preferred one of their group.
    """
    parts = {"jobs_found": events, "jobs_failed": bad, "added": added, "late": late,
             "deactivated": swept.where(F.col("was_stale")),
             **{part: bad.where(F.col("error") == text) for part, text in _KINDS.items()}}
    long = reduce(lambda a, b: a.unionByName(b), [
        df.agg(F.count("*").alias("n")).withColumn("part", F.lit(name)) for name, df in parts.items()])
    return long.groupBy(F.lit(run.run_id).alias("id")).agg(*[
        F.sum(F.when(F.col("part") == p, F.col("n")).otherwise(0)).alias(p) for p in parts]
    ).withColumn("jobs_new", F.col("added") - F.col("late"))


def _ledger(run: Run, counters: DataFrame) -> DataFrame:
    """The closed ledger row. Row errors are counted here by kind and listed one by
    one in ``run_errors``, which may grow with the data as one text must not."""
    failed_rows = [F.when(F.col(part) > 0, F.concat(F.col(part).cast("string"), F.lit(f" rows failed: {text}")))
                   for part, text in _KINDS.items()]
    message = F.concat_ws("\n", F.lit(run.source_error).cast("string"), *failed_rows)
    return (counters.withColumns({
        "source_id": F.lit(run.source_id).cast("int"),
        "status": upsert.run_status(F.col("jobs_found"), F.lit(run.source_error is not None)),
        "jobs_duplicate": F.col("jobs_found") - F.col("jobs_failed") - F.col("jobs_new"),
        "error_message": F.nullif(message, F.lit("")),
        "started_at": run.clock(), "finished_at": run.clock(),
    }).select(SCRAPE_RUNS.fieldNames()))


def open_run(spark, run: Run) -> DataFrame:
    """The ledger row of a run that has begun; a run that dies leaves it behind."""
    return spark.range(1).select(
        F.lit(run.run_id).alias("id"), F.lit(run.source_id).cast("int").alias("source_id"),
        F.lit("running").alias("status"),
        *[F.lit(0).cast("long").alias(c) for c in ("jobs_found", "jobs_new", "jobs_duplicate", "jobs_failed", "deactivated")],
        F.lit(None).cast("string").alias("error_message"), run.clock().alias("started_at"),
        F.lit(None).cast("timestamp").alias("finished_at"))


def run_into_store(store: SnapshotStore, events: DataFrame, run: Run,
                   dictionary=DEFAULT_DICTIONARY) -> bool:
    """Ingest and publish the changed rows; a finished run id in the ledger is a no-op.

    The ledger row is opened first. Everything the run changes, the closed
    ledger row included, is one commit: a run that dies half-way changed
    nothing and is simply run again. What was staged on the way is removed.
    """
    sources = store.read("sources")
    if not sources.where(F.col("id") == run.source_id).take(1):
        raise UnknownFeed(run.source_id)
    known = store.read("scrape_runs").where(F.col("id") == run.run_id).select("status").take(1)
    if known and known[0].status != "running":
        return False
    if not known:
        store.add("scrape_runs", open_run(store.spark, run))
    with staging(store.spark):
        out = ingest(events, store.read("companies"), store.read("jobs"), sources, run, dictionary)
        store.commit(
            write={"sources": out.sources,
                   "posting_counts": stats.add_changes(store.read("posting_counts"), out.counts)},
            add={"run_errors": out.errors, "companies": out.companies.where("was_touched"),
                 "jobs": out.changed, "search_tokens": out.tokens, "scrape_runs": out.run})
    return True


def run_feed(store: SnapshotStore, registry: FeedRegistry, slug: str, run_id: str, as_of: str,
             max_pages: int = 0, stale_days: int = DEFAULT_STALE_DAYS) -> bool:
    """One run of the feed registered for a source.

    All rows get the run's source, in arrival order. A feed that fails is a
    run with that error; a feed may also give rows and a table of errors
    (``feed, error``), whose texts become the run's error while the rows stay.
    """
    source = store.read("sources").where(F.col("slug") == slug).select("id").take(1)
    if not source or not registry.has(slug):
        raise UnknownFeed(slug)
    with staging(store.spark):
        rows, error = registry.collect(store.spark, slug, max_pages)
        events = stage(arrival_order(rows).withColumn("source_id", F.lit(source[0].id).cast("int")), "events")
        return run_into_store(store, events, Run(run_id, source[0].id, as_of, error, stale_days))
