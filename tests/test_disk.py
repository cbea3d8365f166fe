"""What queries write on the way: narrow rows, freed shuffles, no copies of titles per trigram."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from rolegrid.operators import dedup, upsert
from rolegrid.operators.components import connected_components
from rolegrid.operators.normalize import left_out, put_back, remade, with_remade
from rolegrid.operators.similarity import similar_pairs, spanning_edges
from rolegrid.operators.tagging import dictionary_tags
from rolegrid.plans import catalog
from rolegrid.session import checkpoint_root, stage

SF_DIR = "/root/testdata/sf0.001"


def written(spark, name):
    return set(glob.glob(f"{checkpoint_root(spark)}/staged/{name}-*"))


def components(edges):
    return {(r.node, r.component) for r in connected_components(edges).collect()}


@pytest.mark.parametrize("block_rows", [0, 7, 128])
def test_small_and_large_blocks_have_the_same_components(spark, block_rows):
    rnd = random.Random(5)
    words = ["data", "engineer", "backend", "platform", "payments", "payment", "qa", "1"]
    rows = [(rnd.choice("abcde"), "".join(rnd.choices(words, k=rnd.randint(0, 4))), rnd.random() < .6) for _ in range(150)]
    df = spark.createDataFrame(rows, "c string, t string, changed boolean").withColumn("id", F.concat_ws("-", "c", "t"))
    df = df.groupBy("c", "t", "id").agg(F.max("changed").alias("changed"))
    pairs = similar_pairs(df, "c", "t", ident="id", changed="changed")
    want = components(pairs.select(F.col("id_a").alias("u"), F.col("id_b").alias("v")))
    assert components(spanning_edges(df, "c", "t", "id", changed="changed", block_rows=block_rows)) == want and want


def test_small_blocks_write_no_row_per_trigram(spark):
    rows = [(f"f{i}", f"c{i % 40}", f"backendengineer{i % 9}", f"n{i}") for i in range(400)]
    nodes = spark.createDataFrame(rows, "fingerprint string, company_id string, title_normalized string, node string")
    before = written(spark, "entries"), written(spark, "codes")
    groups = components(dedup.match_edges(nodes))
    assert len(groups) == 360  # nine titles a company, of which copies collapse
    assert (written(spark, "entries"), written(spark, "codes")) == before


def test_components_leave_one_folder(spark):
    before = written(spark, "edges")
    chain = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert len(components(chain)) == 201
    assert len(written(spark, "edges") - before) == 1


def test_staged_rows_leave_no_shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    stage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "warm")
    before = manager.shuffleStatuses().size()
    for _ in range(3):
        assert stage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts").count() == 7
    assert manager.shuffleStatuses().size() <= before + 3  # those of the counts read here


def test_latest_events_equal_latest_per_key(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice([None, "a", "b", "c"]), rnd.randrange(3), i, f"t{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "k string, s int, seq long, t string")
    want = upsert.latest_per_key(df, ("k", "s"), "seq", "t")
    got = upsert.latest_events(df, ("k", "s"), "seq").select(want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_a_query_writes_only_the_columns_it_reads(spark):
    before = written(spark, "latest")
    rows = catalog.active_count(spark, SF_DIR).collect()
    (folder,) = written(spark, "latest") - before
    assert len(rows) == 1 and not {"description", "search_text", "stack"} & set(spark.read.parquet(folder).columns)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_a_run_writes_texts_once(spark):
    before = written(spark, "batch")
    assert catalog.ingest_ledger(spark, SF_DIR).count() == 1
    (folder,) = written(spark, "batch") - before
    assert not {"description", "search_text", "title"} & set(spark.read.parquet(folder).columns)


def test_moves_send_no_table_through_the_driver(spark):
    moves = spark.range(1, 300).select(F.col("id").alias("old_id"), (F.col("id") + 1).alias("new_id"))
    before = written(spark, "moves")
    settled, rejected = dedup.settle_moves(moves)
    postings = spark.range(300).select("id", F.col("id").alias("canonical_job_id"))
    pointers = dedup.reparent(postings, settled)
    for df in (settled, rejected, pointers):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert {r.canonical_job_id for r in pointers.where("id > 0").collect()} == {300} and rejected.count() == 0
    assert len(written(spark, "moves") - before) == 1


def test_packed_keys_come_back_and_differ(spark):
    sha = "0f" * 32
    texts = ["", "a", sha, sha.upper(), sha[:-1], sha + "\n", "\x01" + sha, bytes.fromhex("41" * 32).decode(), "é", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("p", dedup._packed(F.col("t")))
    got = rows.select("t", "p", dedup._unpacked(F.col("p")).alias("back")).collect()
    assert [r.back for r in got] == texts and len({r.p and bytes(r.p) for r in got}) == len(texts)
    assert {r.t: len(r.p) for r in got if r.t}[sha] == 33


def test_groups_store_keys_in_half_their_length(spark):
    rows = spark.createDataFrame([(f"u{i}", f"c{i % 7}", f"title{i % 5}", i) for i in range(60)], "id string, c string, title_normalized string, first_seq long")
    rows = rows.select("id", F.sha2(F.concat("c", "title_normalized"), 256).alias("fingerprint"), F.sha2("c", 256).alias("company_id"),
                       "title_normalized", F.lit(None).cast("timestamp").alias("posted_at"), F.lit(None).cast("timestamp").alias("first_seen_at"), "first_seq")
    before = written(spark, "nodes")
    groups = dedup.duplicate_groups(rows).collect()
    (folder,) = written(spark, "nodes") - before
    kinds = dict(spark.read.parquet(folder).dtypes)
    assert kinds["fingerprint"] == kinds["company_id"] == "binary"
    assert {r.fingerprint for r in groups} == {r.fingerprint for r in rows.collect()}
    firsts = {(min((f"u{i + 35 * j}" for j in range(2) if i + 35 * j < 60)), f"u{i}") for i in range(35)}
    assert sum(r.members for r in groups) == 60 and {(r.component, r.canonical_id) for r in groups} == firsts


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_hashes_are_made_again_not_stored(spark):
    before = written(spark, "latest"), written(spark, "normalized")
    rows = catalog.latest(spark, SF_DIR, "company_id")
    want = catalog.normalized(spark, SF_DIR).select("id", "fingerprint", "company_id").distinct()
    assert rows.select("id", "fingerprint", "company_id").exceptAll(want).isEmpty()
    assert catalog.ingest_jobs(spark, SF_DIR).count() > 0
    for name, old in zip(("latest", "normalized"), before, strict=True):
        (folder,) = written(spark, name) - old
        assert not {"id", "fingerprint", "company_id"} & set(spark.read.parquet(folder).columns)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_search_text_made_again_is_the_same(spark):
    rows = catalog.normalized(spark, SF_DIR).select("title", "stack", "description", "search_text")
    again = with_remade(rows.withColumnRenamed("search_text", "was"), "search_text")
    assert again.where("NOT (was <=> search_text)").isEmpty()


def test_texts_give_out_only_words_of_a_short_dictionary(spark):
    texts = spark.createDataFrame([(1, "Zig, zed c++ a.b"), (2, "nothing"), (3, None), (4, "ZED zed_ zigzag")], "i int, t string")
    words = spark.createDataFrame([("Zig", "zig"), ("Zed", "ZED"), ("Sign", "+"), ("Dot", "a.b"), ("X", None)], "tag string, alias string")
    got = [dictionary_tags(texts, "i", "t", words, limit, named) for limit, named in ((100, 100), (0, 100), (100, 0), (0, 0))]
    want = {1: ["Dot", "Sign", "Zed", "Zig"], 2: [], 3: [], 4: ["Zed"]}
    assert [{r.i: r.tags for r in df.collect()} for df in got] == [want] * 4
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in got]
    assert ["array_intersect" in p for p in plans] == [True, True, False, False]


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_the_errors_of_a_run_need_no_groups(spark):
    before = {name: written(spark, name) for name in ("normalized", "batch", "open", "nodes", "changes")}
    assert catalog.ingest_errors(spark, SF_DIR).count() > 0
    new = {name: len(written(spark, name) - old) for name, old in before.items()}
    assert new == {"normalized": 1, "batch": 0, "open": 0, "nodes": 0, "changes": 0}


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_a_run_stages_no_hash_it_can_make_again(spark):
    before = {name: written(spark, name) for name in ("open", "changes", "nodes", "groups")}
    assert catalog.ingest_ledger(spark, SF_DIR).count() == 1
    new = {name: list(written(spark, name) - old) for name, old in before.items()}
    assert len(new["groups"]) == 1 and not new["nodes"]  # what the groups were made from is gone
    rows = spark.read.parquet(*new["open"])
    assert rows.count() > 0 and rows.where("coalesce(id, fingerprint, company_id) IS NOT NULL").isEmpty()
    rows = spark.read.parquet(*new["changes"])
    assert rows.count() > 0 and rows.where("coalesce(id, company_id) IS NOT NULL").isEmpty()


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_jobs_of_a_run_are_written_once_and_its_parts_go(spark):
    parts = ("batch", "open", "nodes", "groups", "changes")
    before = {name: written(spark, name) for name in ("jobs", *parts)}
    assert catalog.ingest_jobs(spark, SF_DIR).where("canonical_url IS NOT NULL").count() > 0
    new = {name: len(written(spark, name) - old) for name, old in before.items()}
    assert new == {"jobs": 1, **dict.fromkeys(parts, 0)}
    (folder,) = written(spark, "jobs") - before["jobs"]
    assert spark.read.parquet(folder).where("id IS NOT NULL").isEmpty()


def test_pointers_find_postings_whose_ids_are_left_out(spark):
    rows = spark.createDataFrame([(1, "u", None), (2, "v", None), (3, "w", "own")], "source_id int, source_url string, canonical_job_id string")
    rows = with_remade(rows, "id")
    ids = {r.source_url: r.id for r in rows.collect()}
    pointers = spark.createDataFrame([(ids["v"], ids["u"]), ("own", ids["u"]), (ids["u"], None)], "id string, canonical_id string")
    want = {"u": (None, False), "v": (ids["u"], True), "w": (ids["u"], True)}
    for df, made in ((rows, None), (left_out(rows, "id"), F.coalesce("id", remade()["id"][1]))):
        got = dedup.apply_pointers(df, pointers, made).collect()
        assert {r.source_url: (r.canonical_job_id, r.was_moved) for r in got} == want


def test_hashes_left_out_come_back_and_others_stay(spark):
    rows = spark.createDataFrame([(1, "u", "c", "t"), (2, "v", None, "t"), (3, "w", "c", "x")],
                                 "source_id int, source_url string, company_normalized string, title_normalized string")
    rows = with_remade(rows, "id", "fingerprint", "company_id")
    rows = rows.withColumns({"id": F.when(F.col("source_id") == 3, "own").otherwise(F.col("id")),
                             "fingerprint": F.coalesce("fingerprint", F.lit("kept"))})
    out = left_out(rows, "id", "fingerprint", "company_id")
    assert [(r.id, r.fingerprint, r.company_id) for r in out.orderBy("source_id").collect()] == [
        (None, None, None), (None, "kept", None), ("own", None, None)]
    assert sorted(map(str, put_back(out, "id", "fingerprint", "company_id").collect())) == sorted(map(str, rows.collect()))


def test_prints_of_groups_with_several_postings(spark):
    rows = [("a", "f1", "c", "backendengineer"), ("b", "f1", "c", "backendengineer"), ("c", "f2", "c", "backendengineers"),
            ("d", "f3", "c", "qaanalyst"), ("e", "f4", "d", "backendengineer"), ("f", None, "d", None)]
    df = spark.createDataFrame(rows, "id string, fingerprint string, company_id string, title_normalized string").withColumns(
        {"posted_at": F.lit(None).cast("timestamp"), "first_seen_at": F.lit(None).cast("timestamp"), "first_seq": F.lit(1)})
    groups = {(r.fingerprint, r.canonical_id) for r in dedup.duplicate_groups(df).collect() if r.component == "a"}
    assert {tuple(r) for r in dedup.shared_prints(df).select("fingerprint", "canonical_id").collect()} == groups == {("f1", "a"), ("f2", "a")}
