"""Runs end to end: counters, partial failure, sweep, duplicates, stream."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from rolegrid import schemas
from rolegrid.operators import search, stats
from rolegrid.plans.ingest import NO_SOURCE, NO_URL, Run, run_feed, run_into_store
from rolegrid.sources.feeds import FeedRegistry, UnknownFeed
from rolegrid.sources.tables import SnapshotStore
from rolegrid.streaming.ingest import checkpoint_folder, raw_posting_stream, start_ingest, without_repeats

DAY = dt.datetime(2026, 3, 1)


def raw(seq, url, title="Backend Engineer", company="Acme", posted=None, description="Text.", **more):
    row = dict(ingest_seq=seq, source_id=1, title=title, company=company, salary_raw="",
               location="Medan, Indonesia", description=description, source_url=url,
               source_job_id=url, posted_at=posted)
    row.update(more)
    return tuple(row[f] for f in schemas.RAW_POSTINGS.fieldNames())


@pytest.fixture
def store(spark, tmp_path):
    s = SnapshotStore(spark, str(tmp_path / "store"))
    s.write("sources", schemas.seed_sources(spark, DAY))
    return s


def go(spark, store, rows, run_id="r1", as_of="2026-03-02 00:00:00", **more):
    events = spark.createDataFrame(rows, schemas.RAW_POSTINGS)
    return run_into_store(store, events, Run(run_id, 1, as_of, **more))


def ledger(store, run_id="r1"):
    return store.read("scrape_runs").where(F.col("id") == run_id).first()


def pointers(store):
    """url -> url of the canonical posting, None if canonical."""
    jobs = store.read("jobs")
    to = jobs.select(F.col("id").alias("canonical_job_id"), F.col("source_url").alias("to"))
    return {r.source_url: r.to for r in jobs.join(to, "canonical_job_id", "left").collect()}


def test_plain_run(spark, store):
    html = "<ul><li>Knows <b>Doc</b>ker</li></ul>"
    assert go(spark, store, [raw(1, "u1", description=html), raw(2, "u2", "Data Analyst", "Widgets")])
    row = ledger(store)
    assert (row.status, row.jobs_found, row.jobs_new, row.jobs_duplicate, row.jobs_failed,
            row.error_message) == ("success", 2, 2, 0, 0, None)
    job = store.read("jobs").where("source_url = 'u1'").first()
    assert (job.description, job.stack, job.salary_currency, job.mode) == ("- Knows Docker", ["Docker"], "IDR", "onsite")
    assert job.canonical_job_id is None and job.is_active and job.salary_min is None and job.salary_raw is None
    stamped = {r.slug: r.last_run_at for r in store.read("sources").collect()}
    assert stamped["dealls"] is not None and stamped["kalibrr"] is None
    # the same run id again changes nothing
    assert not go(spark, store, [raw(3, "u3")])
    assert store.read("jobs").count() == 2


def test_same_event_twice_is_one_new_and_one_duplicate(spark, store):
    go(spark, store, [raw(1, "u1"), raw(2, "u1", title="Backend Engineer II")])
    row = ledger(store)
    assert (row.jobs_found, row.jobs_new, row.jobs_duplicate) == (2, 1, 1)
    assert [r.title for r in store.read("jobs").collect()] == ["Backend Engineer II"]


def test_refresh_keeps_identity_and_pointer(spark, store):
    go(spark, store, [raw(1, "u1"), raw(2, "u2")])
    before = {r.source_url: r for r in store.read("jobs").collect()}
    assert pointers(store) == {"u1": None, "u2": "u1"}
    go(spark, store, [raw(1, "u2", title="Something Else", company="ACME")], "r2", "2026-03-03 00:00:00")
    after = {r.source_url: r for r in store.read("jobs").collect()}
    assert after["u2"].title == "Something Else"
    assert after["u2"].id == before["u2"].id and after["u2"].first_seen_at == before["u2"].first_seen_at
    assert after["u2"].last_seen_at > before["u2"].last_seen_at
    assert after["u2"].canonical_job_id == before["u1"].id
    assert [(r.name, r.name_normalized) for r in store.read("companies").collect()] == [("ACME", "acme")]
    row = ledger(store, "r2")
    assert (row.jobs_new, row.jobs_duplicate) == (0, 1)


def test_earliest_posted_wins_and_followers_move(spark, store):
    late, early = dt.datetime(2026, 1, 10), dt.datetime(2026, 1, 1)
    go(spark, store, [raw(1, "a", posted=late)])
    go(spark, store, [raw(1, "c", title="Backend Engineers", posted=dt.datetime(2026, 1, 20))], "r2")
    assert pointers(store) == {"a": None, "c": "a"}
    go(spark, store, [raw(1, "b", posted=early)], "r3")
    assert pointers(store) == {"a": "b", "b": None, "c": "b"}
    row = ledger(store, "r3")
    assert (row.jobs_new, row.jobs_duplicate) == (1, 0)  # b was no duplicate when it came


def test_known_date_beats_unknown_and_ties_go_to_the_first(spark, store):
    day = dt.datetime(2026, 1, 1)
    go(spark, store, [raw(1, "u"), raw(2, "k", posted=day), raw(3, "t", posted=day)])
    assert pointers(store) == {"u": "k", "k": None, "t": "k"}
    row = ledger(store)
    assert (row.jobs_new, row.jobs_duplicate) == (2, 1)


def test_other_company_never_merges_on_title_alone(spark, store):
    go(spark, store, [raw(1, "u1"), raw(2, "u2", company="Widgets")])
    assert pointers(store) == {"u1": None, "u2": None}


def test_bad_row_is_recorded_and_others_stay(spark, store):
    go(spark, store, [raw(1, "g1"), raw(2, "bad", "Broken", "Void", description="a\x00b"),
                      raw(3, "g2", "Data Analyst")])
    row = ledger(store)
    assert (row.status, row.jobs_found, row.jobs_new, row.jobs_failed) == ("success", 3, 2, 1)
    assert row.error_message == "1 rows failed: text holds a null character"
    assert [(r.source_url, r.ingest_seq) for r in store.read("run_errors").collect()] == [("bad", 2)]
    assert store.read("jobs").count() == 2
    # its company was stored before the posting failed
    assert {r.name for r in store.read("companies").collect()} == {"Acme", "Void"}


def test_source_errors(spark, store):
    go(spark, store, [], source_error="scrape: boom")
    assert (ledger(store).status, ledger(store).error_message) == ("failed", "scrape: boom")
    go(spark, store, [raw(1, "u1")], "r2", source_error="scrape: boom")
    assert (ledger(store, "r2").status, ledger(store, "r2").jobs_new) == ("success", 1)


def test_stale_sweep_and_reactivation(spark, store):
    go(spark, store, [raw(1, "old")], as_of="2026-03-01 00:00:00")
    go(spark, store, [raw(1, "edge", "Data Analyst")], "r2", "2026-03-08 00:00:00")
    assert ledger(store, "r2").deactivated == 0  # exactly seven days is not stale
    go(spark, store, [raw(1, "new", "QA Analyst")], "r3", "2026-03-08 00:00:01")
    assert ledger(store, "r3").deactivated == 1
    go(spark, store, [raw(1, "old")], "r4", "2026-03-08 00:00:02")
    assert store.read("jobs").where("is_active").count() == 3


def test_unknown_source_and_feed(spark, store):
    with pytest.raises(UnknownFeed):
        run_into_store(store, spark.createDataFrame([], schemas.RAW_POSTINGS), Run("x", 77, "2026-03-01 00:00:00"))
    assert store.read("scrape_runs").count() == 0
    registry = FeedRegistry()
    seen = []
    registry.register("board", lambda s, pages: seen.append(pages))
    registry.read(spark, "board", 17)
    assert seen == [17] and registry.has("board")
    with pytest.raises(UnknownFeed):
        registry.read(spark, "other")


def test_rows_of_unknown_sources_and_without_address(spark, store):
    events = spark.createDataFrame([raw(1, "ok"), raw(2, "lost", source_id=99), raw(3, "")], schemas.RAW_POSTINGS)
    nameless = events.limit(0).unionByName(spark.createDataFrame(
        [raw(4, "gone")], schemas.RAW_POSTINGS).withColumn("source_url", F.lit(None).cast("string")))
    assert run_into_store(store, events.unionByName(nameless), Run("r1", 1, "2026-03-02 00:00:00"))
    assert [r.source_url for r in store.read("jobs").collect()] == ["ok"]
    assert {(r.ingest_seq, r.error) for r in store.read("run_errors").collect()} == {(2, NO_SOURCE), (3, NO_URL), (4, NO_URL)}
    row = ledger(store)
    assert (row.jobs_found, row.jobs_failed) == (4, 3)
    assert row.error_message == f"2 rows failed: {NO_URL}\n1 rows failed: {NO_SOURCE}"


def test_a_run_that_dies_leaves_an_open_row_and_nothing_else(spark, store):
    broken = spark.createDataFrame([raw(1, "u1")], schemas.RAW_POSTINGS).withColumn(
        "title", F.raise_error(F.lit("executor gone")).cast("string"))
    with pytest.raises(Exception, match="executor gone"):
        run_into_store(store, broken, Run("r1", 1, "2026-03-02 00:00:00"))
    assert (ledger(store).status, ledger(store).finished_at) == ("running", None)
    assert store.read("jobs").count() == 0 and store.read("companies").count() == 0
    assert go(spark, store, [raw(1, "u1")])  # run again under the same id
    assert (ledger(store).status, ledger(store).jobs_new) == ("success", 1)
    assert store.read("scrape_runs").count() == 1


def test_run_of_a_registered_feed(spark, store):
    def feed(s, pages):
        rows = s.createDataFrame([raw(9, f"u{i}", f"Title {i}", source_id=7) for i in range(pages)], schemas.RAW_POSTINGS)
        return rows.drop("ingest_seq", "source_id"), s.createDataFrame([("b", "page 7 is broken")], "feed string, error string")

    def down(s, pages):
        raise OSError("board is down")

    registry = FeedRegistry({"dealls": feed, "kalibrr": down})
    assert run_feed(store, registry, "dealls", "r1", "2026-03-02 00:00:00", max_pages=3)
    assert {(r.source_id, r.source_url) for r in store.read("jobs").collect()} == {(1, "u0"), (1, "u1"), (1, "u2")}
    assert (ledger(store).status, ledger(store).error_message) == ("success", "page 7 is broken")
    assert run_feed(store, registry, "kalibrr", "r2", "2026-03-02 00:00:00")
    assert (ledger(store, "r2").status, ledger(store, "r2").error_message) == ("failed", "scrape: board is down")
    with pytest.raises(UnknownFeed):
        run_feed(store, registry, "nobody", "r3", "2026-03-02 00:00:00")


def test_stream_that_lost_its_checkpoint(spark, store, tmp_path):
    folder, day = str(tmp_path / "raw"), lambda: "2026-03-05 00:00:00"
    def deliver(*rows):
        spark.createDataFrame(rows, schemas.RAW_POSTINGS).coalesce(1).write.mode("append").parquet(folder)
        start_ingest(raw_posting_stream(spark, folder, 1), store, 1, "s", day).awaitTermination()
    deliver(raw(1, "a"))
    lost = checkpoint_folder(store, "s")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(lost)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    deliver(raw(2, "b", "Data Analyst"))
    assert pointers(store) == {"a": None, "b": None}  # the new file is stored, the old one repeated harmlessly
    assert store.read("scrape_runs").count() == 3


def test_stream(spark, store, tmp_path):
    folder = str(tmp_path / "raw")
    for i, rows in enumerate([[raw(1, "a"), raw(2, "b", "Data Analyst")], [raw(3, "a"), raw(4, "c")]]):
        spark.createDataFrame(rows, schemas.RAW_POSTINGS).coalesce(1).write.mode("append").parquet(folder)
    stream = raw_posting_stream(spark, folder, files_per_batch=1)
    for _ in range(2):  # a second start finds nothing new
        start_ingest(stream, store, 1, "s", lambda: "2026-03-05 00:00:00").awaitTermination()
    assert pointers(store) == {"a": None, "b": None, "c": "a"}
    runs = store.read("scrape_runs")
    assert runs.agg(F.sum("jobs_found"), F.sum("jobs_new"), F.sum("jobs_duplicate")).first()[:] == (4, 2, 2)


def test_token_table_after_runs_equals_a_rebuild(spark, store):
    go(spark, store, [raw(1, "u1", "Data Engineer", description="Kafka and streams"), raw(2, "u2", "Designer", "Widgets"),
                      raw(3, "u3", "QA Analyst", "Other", description="")])
    go(spark, store, [raw(4, "u1", "Data Engineer", description="Batch work"), raw(5, "u4", "Data Analyst", "New")], "r2",
       "2026-03-03 00:00:00")
    go(spark, store, [raw(6, "u1", "Data Engineer", description="Kafka again"), raw(7, "u2", "Designer", "Widgets")], "r3",
       "2026-03-04 00:00:00")
    jobs = store.read("jobs")
    rebuilt = search.search_tokens(jobs, "id", F.col("search_text"))
    kept = store.read("search_tokens")
    tokens = lambda df: sorted((r.doc_id, r.pos, r.token) for r in df.where("token IS NOT NULL").collect())
    assert tokens(kept) == tokens(rebuilt)
    urls = {r.id: r.source_url for r in jobs.collect()}
    found = lambda *a, **q: sorted(urls[r.doc_id] for r in search.search_by_tokens(kept, *a, **q).collect())
    assert found(["kafka"]) == ["u1"] and found(["batch"]) == [] and found(["data"]) == ["u1", "u4"]
    # the statistics were kept by the same changes
    sources = store.read("sources")
    kept_parts, parts = stats.kept_bundle(sources, store.read("posting_counts")), stats.stats_bundle(sources, jobs)
    for part in parts:
        assert kept_parts[part].collect() == parts[part].collect()
    # a refresh without a new text adds no rows
    last = spark.read.parquet(store.state()[1]["search_tokens"][-1])
    assert {urls[r.doc_id] for r in last.collect()} == {"u1"}
    # the asked tokens are filtered in the scans
    plan = kept.where("token = 'kafka'")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EqualTo(token,kafka)") >= 2


def test_a_stream_drops_repeats_and_keeps_refreshes(spark, store, tmp_path):
    folder, state, out = (str(tmp_path / n) for n in ("raw", "state", "out"))

    def deliver(hour, *rows):
        before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
        spark.createDataFrame(rows, schemas.RAW_POSTINGS).coalesce(1).write.mode("append").parquet(folder)
        for name in set(os.listdir(folder)) - before:
            os.utime(f"{folder}/{name}", (hour * 3600, hour * 3600))
        (without_repeats(spark, folder).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination())
        return sorted(r.ingest_seq for r in spark.read.parquet(out).collect())

    assert deliver(1000, raw(1, "u1"), raw(2, "u1"), raw(3, "u2")) in ([1, 3], [2, 3])
    # half an hour later: u1 again, u2 with another text
    assert len(deliver(1000.5, raw(4, "u1"), raw(5, "u2", description="New text."))) == 3
    # five hours later the same contents are refreshes
    assert {6, 7} <= set(deliver(1005, raw(6, "u1"), raw(7, "u2", description="New text.")))
    # a file from before that time is late
    assert 8 not in deliver(1001, raw(8, "u9"))
    assert 9 in deliver(1005.5, raw(9, "u9"))
