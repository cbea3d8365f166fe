"""Listing filters, keyset pages, search, statistics, audit, JSON."""

import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F

from rolegrid import schemas
from rolegrid.operators import audit, search, stats, token_index, upsert
from rolegrid.functions.salary import stored_bounds
from rolegrid.functions.text import search_form, search_text
from rolegrid.session import stage

DAY = dt.datetime(2026, 1, 1)


def posting(i, **more):
    row = {f.name: None for f in schemas.POSTINGS}
    row.update(id=f"{i:03d}", title=f"T{i}", title_normalized=f"t{i}", company_id="c1", salary_currency="IDR",
               salary_conf="unknown", stack=[], mode="unknown", level="unknown", source_id=1, source_url=f"u{i}",
               fingerprint=f"f{i}", first_seen_at=DAY, last_seen_at=DAY, is_active=True, first_seq=i)
    row.update(more)
    words = " ".join([row["title"], *row["stack"], row["description"] or ""]).lower()
    row["search_text"] = " " + " ".join(re.findall(r"\w+", words)) + " "
    return tuple(row[f.name] for f in schemas.POSTINGS)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.POSTINGS)


def ids(df):
    return [r.id for r in df.collect()]


def test_filters(spark):
    df = frame(
        spark,
        posting(1, stack=["Go", "Redis"], salary_max=20, mode="remote", level="senior", location_city="Bandung"),
        posting(2, stack=["PHP"], salary_max=5, mode="onsite", location_city="Bandar"),
        posting(3, salary_min=50, location_city="bandung"),
        posting(4, is_active=False, stack=["Go"]),
        posting(5, canonical_job_id="001", stack=["Go"]))
    assert ids(search.list_postings(df, stack=["Go", "x"])) == ["001"]
    assert ids(search.list_postings(df, stack=["go"])) == [] and ids(search.list_postings(df, stack=[])) == []
    assert ids(search.list_postings(df, salary_min=10)) == ["001"]  # unknown upper bounds never match
    assert ids(search.list_postings(df, salary_min=0)) == ["002", "001"]
    assert ids(search.list_postings(df, city="BANDUNG")) == ["003", "001"]
    assert ids(search.list_postings(df, city="band%")) == ["003", "002", "001"]
    assert ids(search.list_postings(df, mode="remote", level="senior", city="bandung")) == ["001"]
    assert ids(search.list_postings(df)) == ["003", "002", "001"]
    for bad in ({"mode": "moon"}, {"level": "x"}, {"salary_min": -1}):
        with pytest.raises(ValueError):
            search.list_postings(df, **bad)


def test_paging_covers_every_row_once_with_unknown_dates_last(spark):
    rows = [posting(i, posted_at=DAY + dt.timedelta(days=(i * 7) % 5)) for i in range(9)]
    df = frame(spark, *rows, posting(20), posting(21)).cache()
    want = ids(df.orderBy(F.desc_nulls_last("posted_at"), F.desc("id")))
    got, cursor, pages = [], None, 0
    while True:
        page = search.list_postings(df, limit=4, cursor=cursor)
        got += ids(page)
        pages += 1
        cursor = search.next_cursor(page, 4)
        if cursor is None:
            break
    assert got == want and pages == 3 and got[-2:] == ["021", "020"]
    bounds = search.page_boundaries(df, 4).orderBy("page").collect()
    assert [(r.page, r.id) for r in bounds] == [(1, want[3]), (2, want[7])]
    assert [search.clamp_limit(x) for x in (None, 0, -1, 7, 500)] == [20, 20, 20, 7, 100]
    # an exactly full last page gives one more, empty page
    last = search.list_postings(df.where("id < '008'"), limit=4, cursor=search.next_cursor(
        search.list_postings(df.where("id < '008'"), limit=4), 4))
    empty = search.list_postings(df.where("id < '008'"), limit=4, cursor=search.next_cursor(last, 4))
    assert ids(empty) == [] and search.next_cursor(empty, 4) is None


def test_text_search(spark, tmp_path):
    df = frame(
        spark,
        posting(1, title="Go Engineer", stack=["Go"], description="Build data pipelines."),
        posting(2, title="Data Engineer", stack=["Kafka"], description="Pipelines of data"),
        posting(3, title="Designer", description="going places"))
    find = lambda **q: sorted(ids(search.list_postings(df, text=q)))
    assert find(all_of=["engineer"]) == ["001", "002"]
    assert find(all_of=["data pipelines"]) == ["001"]
    assert find(all_of=["engineer kafka"]) == ["002"]  # a phrase may cross title and tags
    assert find(any_of=["go", "designer"]) == ["001", "003"]
    assert find(all_of=["engineer"], none_of=["KAFKA"]) == ["001"]
    assert find(all_of=["!!"]) == [] and find() == []
    made = df.withColumn("made", search_text(F.col("title"), F.col("stack"), F.col("description")))
    assert made.where("made <> search_text").count() == 0
    search.save_token_table(search.search_tokens(df, "id", F.col("search_text")), str(tmp_path / "tokens"))
    tokens = spark.read.parquet(str(tmp_path / "tokens"))
    assert [(r.pos, r.token) for r in tokens.where("doc_id = '001'").orderBy("pos").collect()] == list(
        enumerate("go engineer go build data pipelines".split(), 1))
    by_tokens = lambda *a, **q: sorted(r.doc_id for r in search.search_by_tokens(tokens, *a, **q).collect())
    assert by_tokens(["data", "Kafka"]) == ["002"]
    assert by_tokens(["data pipelines"]) == ["001"] and by_tokens(["pipelines data"]) == []
    assert by_tokens(any_of=["go", "designer"]) == ["001", "003"]
    assert by_tokens(["engineer"], ["build", "of data"], ["KAFKA"]) == ["001"]
    assert by_tokens(["engineer"], none_of=["data engineer"]) == ["001"]
    assert by_tokens(["!!"]) == [] and by_tokens() == []


def test_lookups_and_json(spark):
    df = frame(spark, posting(1, description="", salary_min=3, posted_at=DAY, stack=["Go"]),
               posting(2, canonical_job_id="001", company_id="c9", is_active=False, first_seen_at=DAY + dt.timedelta(1)),
               posting(3, canonical_job_id="001", first_seen_at=DAY))
    firms = spark.createDataFrame([("c1", "Acme")], "id string, name string")
    assert search.one(search.by_id(df, "002")).is_active is False
    with pytest.raises(search.NotFound):
        search.one(search.by_id(df, "zzz"), "posting")
    got = {r.id: json.loads(r.json) for r in search.public_json(search.with_company(df, firms)).collect()}
    assert got["001"] == dict(
        id="001", title="T1", company="Acme", salary_min=3, salary_confidence="unknown", stack=["Go"], mode="unknown",
        level="unknown", source_url="u1", posted_at="2026-01-01T00:00:00Z", first_seen_at="2026-01-01T00:00:00Z",
        last_seen_at="2026-01-01T00:00:00Z", is_active=True)
    assert got["002"]["company"] == "" and got["002"]["stack"] == [] and "posted_at" not in got["002"]
    rows = search.detail(df, firms, "001").collect()
    assert [(r.role, r.id) for r in rows] == [("job", "001"), ("duplicate", "003"), ("duplicate", "002")]


def test_stats(spark):
    df = frame(spark, posting(1, stack=["Go", "Docker"]), posting(2, stack=["Go", "Kafka"]), posting(3),
               posting(4, stack=["Go"], is_active=False), posting(5, stack=["Go"], canonical_job_id="001", source_id=2))
    sources = schemas.seed_sources(spark, DAY)
    parts = stats.stats_bundle(sources, df)
    assert parts["total"].first()[0] == 3
    assert [(r.slug, r.active_jobs) for r in parts["by_source"].collect()] == [("dealls", 3), ("kalibrr", 0)]
    assert [tuple(r) for r in parts["by_tag"].collect()] == [("Go", 2), ("Docker", 1), ("Kafka", 1)]


def test_stored_salary_bounds(spark):
    rows = [(0, 0, "unknown"), (10, 10, "exact"), (8, 12, "range"), (0, 15, "estimated"), (8, 0, "estimated")]
    low, high = stored_bounds(F.col("lo"), F.col("hi"), F.col("conf"))
    got = [tuple(r) for r in spark.createDataFrame(rows, "lo long, hi long, conf string").select(low, high).collect()]
    assert got == [(None, None), (10, 10), (8, 12), (None, 15), (8, None)]


def test_audit(spark):
    df = frame(spark, posting(1), posting(2, source_url="u1"), posting(3, company_id="zz", source_id=9),
               posting(4, mode="moon", canonical_job_id="005"), posting(5, canonical_job_id="001"), posting(6, canonical_job_id="nope"))
    firms = spark.createDataFrame([("c1", "Acme", "acme"), ("c2", "ACME", "acme")], "id string, name string, name_normalized string")
    got = {(r.check, r.key, r.n) for r in audit.audit_postings(df, firms, schemas.seed_sources(spark, DAY)).collect()}
    assert got == {
        ("company name is unique", "acme", 2), ("source url is unique", "1|u1", 2), ("company exists", "zz", 1),
        ("source exists", "9", 1), ("mode value", "moon", 1), ("canonical exists", "nope", 1),
        ("pointer target is not canonical", "005", 1)}


def test_latest_per_key_and_outcomes(spark):
    ev = spark.createDataFrame([(1, "a", "x"), (2, "b", None), (3, "a", "y"), (4, "b", "z")], "seq long, k string, v string")
    got = {r.k: (r.v, r.first_seq, r.last_seq, r.deliveries) for r in upsert.latest_per_key(ev, ("k",), "seq", "v").collect()}
    assert got == {"a": ("y", 1, 3, 2), "b": ("z", 2, 4, 2)}
    target = spark.createDataFrame([("b",)], "k string")
    out = upsert.event_outcomes(ev, ("k",), "seq", target).orderBy("seq").collect()
    assert [r.was_inserted for r in out] == [True, False, False, False]


def test_search_form_is_whole_text(spark):
    long = "word " * 50_000 + "needle"
    df = spark.createDataFrame([(long,)], "t string")
    assert df.where(search.text_matches(search_form(F.col("t")), all_of=["needle"])).count() == 1


def test_exclusions_alone_by_tokens_find_every_other_document(spark):
    df = frame(spark, posting(1, title="Go Engineer"), posting(2, title="Data Engineer"), posting(3, title="Designer"))
    tokens, docs = search.search_tokens(df, "id", F.col("search_text")), df.select(F.col("id").alias("doc_id"))
    for out in (["engineer"], ["data engineer"], ["!!"], ["go", "designer", "!!"], ["absent"]):
        want = sorted(r.id for r in df.where(search.text_matches(F.col("search_text"), none_of=out)).collect())
        assert sorted(r.doc_id for r in search.search_by_tokens(tokens, none_of=out, documents=docs).collect()) == want
    with pytest.raises(ValueError):
        search.search_by_tokens(tokens, none_of=["engineer"])


def test_phrases_and_term_lists_of_any_length(spark):
    words = [f"w{i}" for i in range(90)]
    df = spark.createDataFrame([("a", " ".join(words)), ("b", " ".join(words[:64] + words[65:])), ("c", "w1 w0")], "id string, t string")
    tokens = search.search_tokens(df, "id", search_form(F.col("t")))
    found = lambda *a, **q: sorted(r.doc_id for r in search.search_by_tokens(tokens, *a, **q).collect())
    assert found([" ".join(words[:65])]) == ["a"] and found([" ".join(words[:64])]) == ["a", "b"]
    assert found(words[:80]) == ["a"] and found(words[:64]) == ["a", "b"]
    assert found(["w0"], none_of=words[64:70] + ["w1 w2"]) == ["c"]
    assert found(any_of=words[3:75]) == ["a", "b"]


def test_tokens_after_changes(spark):
    forms = lambda rows: spark.createDataFrame(rows, "doc_id long, form string")
    states = [[(1, " a b "), (2, " c "), (3, None), (4, " a ")], [(1, " a b "), (2, " c d "), (3, " e "), (4, None)],
              [(1, " b "), (3, None), (4, " a "), (5, " f ")]]
    changes = [stage(token_index.token_changes(forms(a), forms(b), whole=True), "change") for a, b in zip(states, states[1:])]
    got = token_index.current_tokens(token_index.with_markers(forms(states[0])), *changes)
    want = {(i, p, t) for i, f in states[-1] for p, t in enumerate((f or "").split(), 1)}
    assert {tuple(r) for r in got.collect()} == want
    assert {r.doc_id for r in changes[0].collect()} == {2, 3, 4}
