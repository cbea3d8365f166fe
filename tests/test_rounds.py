"""Work that is done once, however many slices, blocks or texts there are."""

import re

import pytest
from pyspark.sql import functions as F

from rolegrid.functions import patterns as P
from rolegrid.functions.text import html_to_text, trim_white
from rolegrid.operators import replay, similarity

EVENTS = ("seq long, id string, fingerprint string, company_id string, title_normalized string, posted_at timestamp, "
          "first_seen_at timestamp, first_seq long")


def events(spark, n):
    titles = ["backendengineer", "backendengineers", "productdesigner", "qa", "backendengine"]
    rows = [(i, f"u{i * 7 % 40}", f"p{i % 3}{titles[i % 5]}", f"c{i % 3}", titles[i % 5], None, None, i) for i in range(n)]
    return spark.createDataFrame(rows, EVENTS)


def test_components_of_a_replay_are_found_once_for_all_slices(spark, monkeypatch):
    calls = []
    whole = [sorted(map(tuple, df.collect())) for df in replay.replay(events(spark, 60))]
    monkeypatch.setattr(replay, "connected_components", lambda e, f=replay.connected_components: calls.append(1) or f(e))
    cut = [sorted(map(tuple, df.collect())) for df in replay.replay(events(spark, 60), slice_rows=7)]
    assert cut == whole and whole[1] and len(calls) == 1


def test_compared_titles_are_forgotten_without_other_results(monkeypatch):
    rows = [(i, f"u{i}", f"p{i}", "c", t) for i, t in enumerate(["backendengineer", "productdesigner", "backendengineers", "qa"] * 5)]

    def outcomes():
        state = replay._Component()
        return [state.take(*row, (False, 0, 0, row[0])) for row in rows], sorted(state.pointers()), state

    *kept, state = outcomes()
    assert state.pairs <= 12  # titles met again are not compared again
    monkeypatch.setattr(replay, "KNOWN_PAIRS", 2)
    *forgotten, _ = outcomes()
    assert forgotten == kept


@pytest.mark.parametrize("strip", [128, 2])
def test_a_block_is_compared_in_python_and_tied_as_a_forest(spark, monkeypatch, strip):
    monkeypatch.setattr(similarity, "BLOCK_ROWS", strip)
    words = ["backend engineer", "backend engineers", "qa", "", "--", "qa", "backend engineer x", "product designer", "product designers"]
    u, v = similarity._block_ties(words, [True] * 9, 7)
    assert {frozenset(p) for p in zip(u, v)} <= {frozenset(p) for p in [(0, 1), (0, 6), (1, 6), (2, 5), (7, 8)]}
    assert len(u) == 4  # 9 texts in 5 components
    assert similarity._block_ties(words, [False] * 9, 7) == ([], [])
    texts = spark.createDataFrame([("a", "qa one", 1, True), ("a", "qa ones", 2, True)], "block string, text string, id int, changed boolean")
    edges = similarity._small_block_edges(texts, 3)
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "REPARTITION_BY_NUM" in plan  # few bytes are not few tasks
    assert {frozenset(e) for e in edges.collect()} == {frozenset([1, 2])}


def test_blocks_go_on_from_batch_to_batch(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        texts = spark.createDataFrame([(b, f"title number {b}{i}", f"{b}{i}", True) for b in "abc" for i in range(5)],
                                      "block string, text string, id string, changed boolean").repartition(1)
        edges = [tuple(e) for e in similarity._small_block_edges(texts, 3).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(edges) == 12 and all(u[0] == v[0] for u, v in edges)


def test_boundaries_look_at_one_side_and_mean_the_same():
    both = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
    texts = [f"{a}{w}{b}" for w in ("negotiable", "TBK", "rp", "per month", "max", "senior", "on-site", "remotely", "interns", "min. 2 tahun", "USD")
             for a in ("", " ", "x", "_", "é", "-", "9") for b in ("", " ", "x", "_", "é", ".", "9")]
    named = [P.TBK, P.LEGAL_FORM, P.TITLE_SENIORITY, P.SALARY_VAGUE, P.SALARY_FOREIGN, P.SALARY_CURRENCY, P.SALARY_PERIOD, P.SALARY_MAX_WORD,
             P.SALARY_MIN_WORD, *P.YEARS_PATTERNS, *[p for _, p in P.MODE_PATTERNS + P.LEVEL_PATTERNS]]
    for pattern in named:
        old = pattern.replace(r"\b", both)
        for text in texts:
            assert [m.span() for m in re.finditer(P.jvm(pattern), text)] == [m.span() for m in re.finditer(old, text)], (pattern, text)
    assert both not in P.jvm(P.TBK)


def test_white_space_and_ampersands_take_the_short_way(spark):
    texts = [" \t a \x0b\r\n", "\xa0a\u3000", "\x1ca\x1c", "", "   ", "é ", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(trim_white(F.col("t")).alias("t")).collect()
    assert [r.t for r in rows] == ["a", "a", "\x1ca\x1c", "", "", "é", None]
    html = ["R&amp;D", "&amp;lt;", "&amp;&lt;b&gt;", "a & b", "&amp", "a\x0b \t b", "<P>x<br/>\n\n <LI a='>'>y</LI><!--<p>--><h1 >z"]
    rows = spark.createDataFrame([(t,) for t in html], "t string").select(html_to_text(F.col("t")).alias("t")).collect()
    assert [r.t for r in rows] == ["R&D", "&lt;", "&<b>", "a & b", "&amp", "a b", "x\n\n- y\nz"]
    plan = spark.range(1).select(trim_white(F.col("id").cast("string")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert "octet_length" in plan
