"""Snapshot store: changes, compaction, failed and competing writers; plan shapes."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rolegrid import schemas
from rolegrid.operators import search, upsert
from rolegrid.operators.normalize import normalize_postings
from rolegrid.sources.tables import SnapshotStore, export_json

DAY = dt.datetime(2026, 1, 1)


def firms(spark, *rows):
    return spark.createDataFrame([(i, n, n.lower(), None, DAY) for i, n in rows], schemas.COMPANIES)


def names(store):
    return sorted((r.id, r.name) for r in store.read("companies").collect())


def test_changes_replace_rows_and_compact(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    assert names(store) == []
    store.add("companies", firms(spark, ("1", "A"), ("2", "B")))
    store.add("companies", firms(spark, ("2", "B2"), ("3", "C")))
    for i in range(20):  # nothing is rewritten on its own
        store.add("companies", firms(spark, ("2", f"B{i + 3}")))
    assert len(store.state()[1]["companies"]) == 22
    want = [("1", "A"), ("2", "B22"), ("3", "C")]
    assert names(store) == want
    before = store.read("companies")
    store.compact("companies")
    assert len(store.state()[1]["companies"]) == 1 and names(store) == want
    assert before.count() == 3  # older readers keep their folders until a vacuum
    assert store.vacuum() > 22 and store.vacuum() == 0 and names(store) == want
    store.write("companies", firms(spark, ("9", "Z")))
    assert names(store) == [("9", "Z")]


def test_several_tables_appear_at_once(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    bad = spark.range(1).select(F.raise_error(F.lit("no")).cast("string").alias("id"), *[
        F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.COMPANIES.fields[1:]])
    errors = spark.createDataFrame([("r", 1, "u", "e")], schemas.RUN_ERRORS)
    with pytest.raises(Exception, match="no"):
        store.commit(add={"run_errors": errors, "companies": bad})
    assert store.state() == (0, {}) and store.read("run_errors").count() == 0
    store.commit(write={"companies": firms(spark, ("1", "A"))}, add={"run_errors": errors})
    assert store.state()[0] == 1 and names(store) == [("1", "A")] and store.read("run_errors").count() == 1


def test_second_writer_fails(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    store.write("companies", firms(spark, ("1", "A")))
    with pytest.raises(RuntimeError):
        store._publish(1, {"companies": ["elsewhere"]})
    assert names(store) == [("1", "A")]


def test_errors_of_a_repeated_run_are_stored_once(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    errors = spark.createDataFrame([("r", 1, "u", "e")], schemas.RUN_ERRORS)
    store.add("run_errors", errors)
    store.add("run_errors", errors)
    assert store.read("run_errors").count() == 1


def test_export_json(spark, tmp_path):
    path = str(tmp_path / "out")
    export_json(spark.createDataFrame([('{"a":1}',)], "json string"), path)
    assert [r.value for r in spark.read.text(path).collect()] == ['{"a":1}']


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_listing_reads_narrow_and_pushes_filters(spark, tmp_path):
    path = str(tmp_path / "jobs")
    spark.createDataFrame([], schemas.POSTINGS).write.parquet(path)
    jobs = spark.read.schema(schemas.POSTINGS).parquet(path)
    page = search.list_postings(jobs, salary_min=5, mode="remote", cursor=(DAY, "x")).select("id", "title", "posted_at")
    text = plan(page)
    assert "TakeOrderedAndProject" in text and "Exchange" not in text
    pushed = text[text.index("PushedFilters"):]
    for part in ("IsNull(canonical_job_id)", "EqualTo(is_active,true)", "EqualTo(mode,remote)",
                 "GreaterThanOrEqual(salary_max,5)", "LessThan(posted_at"):
        assert part in pushed
    schema = text[text.index("ReadSchema"):]
    assert "description" not in schema and "stack" not in schema


def test_normalizing_neither_shuffles_nor_leaves_the_jvm(spark):
    raw = spark.createDataFrame([], schemas.RAW_POSTINGS)
    text = plan(normalize_postings(raw))
    assert not any(x in text for x in ("Exchange", "EvalPython", "InPandas", "Generate"))


def posting_rows(spark, n):
    one = {f.name: F.lit("x") if f.dataType.simpleString() == "string" else F.lit(None).cast(f.dataType) for f in schemas.POSTINGS}
    one |= {"id": F.sha2(F.col("n").cast("string"), 256), "source_id": F.lit(1), "source_url": F.concat(F.lit("u"), F.col("n")),
            "is_active": F.lit(True), "first_seq": F.col("n"), "description": F.repeat(F.lit("text "), 100),
            "stack": F.array(F.lit("Go"))}
    return spark.range(n).withColumnRenamed("id", "n").select(*[one[f.name].alias(f.name) for f in schemas.POSTINGS])


def test_small_batch_does_not_shuffle_the_stored_table(spark, tmp_path):
    posting_rows(spark, 20_000).write.parquet(str(tmp_path / "jobs"))
    target = spark.read.schema(schemas.POSTINGS).parquet(str(tmp_path / "jobs"))
    # a run stages its batch, so that its size is known
    posting_rows(spark, 50).select(*upsert.KEY, "id", *schemas.POSTING_CONTENT, "first_seq").write.parquet(str(tmp_path / "batch"))
    batch = spark.read.parquet(str(tmp_path / "batch"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")  # the stored table is above it
    try:
        text = plan(upsert.upsert_postings(target, batch, F.lit(DAY)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in text and "BroadcastHashJoin" in text and "hashpartitioning" not in text
