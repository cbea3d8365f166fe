"""Duplicate resolution against plain one-by-one models."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rolegrid.operators import dedup
from rolegrid.operators.components import connected_components
from rolegrid.operators.replay import replay
from rolegrid.operators.similarity import similar_pairs, spanning_edges

DAY = dt.datetime(2026, 1, 1)
SCHEMA = ("id string, fingerprint string, company_id string, title_normalized string, "
          "posted_at timestamp, first_seen_at timestamp, first_seq long")


def grams(t):
    p = f"  {t} "
    return {p[i:i + 3] for i in range(len(p) - 2)} if t else set()


def similar(a, b):
    x, y = grams(a), grams(b)
    return bool(x | y) and 10 * len(x & y) > 7 * len(x | y)


def matches(a, b):
    return a["fingerprint"] == b["fingerprint"] or (
        a["company_id"] == b["company_id"] and similar(a["title_normalized"], b["title_normalized"]))


def pref(r):
    p = r["posted_at"]
    return (p is None, p or DAY, r["first_seen_at"], r["first_seq"])


def one_by_one(events, rows=None):
    """The store's own procedure on plain dictionaries."""
    rows, pointer, out = dict(rows or {}), {}, []
    for e in events:
        old = rows.get(e["id"])
        row = dict(e)
        if old:
            row.update(first_seen_at=old["first_seen_at"], first_seq=old["first_seq"])
        rows[e["id"]] = row
        if e["id"] in pointer:
            out.append((e["seq"], False, True))
            continue
        group = [row] + [r for k, r in rows.items() if k != e["id"] and k not in pointer and matches(row, r)]
        best = min(group, key=pref)
        for loser in group:
            if loser is not best:
                pointer[loser["id"]] = best["id"]
                for k, v in pointer.items():
                    if v == loser["id"]:
                        pointer[k] = best["id"]
        out.append((e["seq"], old is None, best is not row))
    return pointer, out


TITLES = ["backendengineer", "backendengineers", "backendengineersx", "backendengineersxy", "qaanalyst",
          "qaanalysts", "designer", "backendengineerjakarta", ""]


def random_events(rnd, n, start=0):
    events = []
    for seq in range(start, start + n):
        company, title = rnd.choice("ab"), rnd.choice(TITLES)
        events.append(dict(
            seq=seq, id=f"p{rnd.randrange(n)}", company_id=company, title_normalized=title,
            # made of both keys, as the rule says; one title has the same in all companies
            fingerprint="shared" if title == "designer" else company + title,
            posted_at=rnd.choice([None, DAY + dt.timedelta(days=rnd.randrange(4))]),
            first_seen_at=DAY, first_seq=seq))
    return events


def frame(spark, events):
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return spark.createDataFrame([(e["seq"], *[e[n] for n in names]) for e in events], "seq long, " + SCHEMA)


@pytest.mark.parametrize("seed,slice_rows", [(1, 10_000), (2, 25), (3, 40)])
def test_replay_equals_one_by_one(spark, seed, slice_rows):
    rnd = random.Random(seed)
    # many independent batches at once: company and fingerprint keep them apart
    events, want_ptr, want_out, n = [], {}, [], 0
    for b in range(12):
        batch = random_events(rnd, 9, n)
        n += 9
        for e in batch:
            for k in ("id", "company_id", "fingerprint"):
                e[k] = f"{b}-{e[k]}"
        ptr, out = one_by_one(batch)
        events += batch
        want_ptr.update(ptr)
        want_out += out
    outcomes, pointers = replay(frame(spark, events), slice_rows=slice_rows)
    assert {r.id: r.canonical_id for r in pointers.collect()} == want_ptr
    got = sorted((r.seq, r.was_inserted, r.is_duplicate) for r in outcomes.collect())
    assert got == sorted(want_out)


def test_order_matters_for_a_bridge(spark):
    def event(seq, key, title):
        return dict(seq=seq, id=key, company_id="a", title_normalized=title, fingerprint=key,
                    posted_at=None, first_seen_at=DAY, first_seq=seq)
    a, b, bridge = "backendengineer", "backendengineerxyzwvutsr", "backendengineerxyzw"
    assert similar(a, bridge) and similar(b, bridge) and not similar(a, b)
    first = [event(0, "a", a), event(1, "c", bridge), event(2, "b", b)]
    second = [event(0, "a", a), event(1, "b", b), event(2, "c", bridge)]
    for events, want in ((first, {"c": "a"}), (second, {"b": "a", "c": "a"})):
        assert one_by_one(events)[0] == want
        assert {r.id: r.canonical_id for r in replay(frame(spark, events))[1].collect()} == want
        # as sets, the bridge always joins all three
        rows = frame(spark, events).withColumn("canonical_job_id", F.lit(None).cast("string"))
        got = {r.id: r.canonical_id for r in dedup.resolve(rows).collect()}
        assert got == {"a": None, "b": "a", "c": "a"}


def test_replay_against_stored_rows(spark):
    stored = dict(seq=-1, id="s", company_id="a", title_normalized="qaanalyst", fingerprint="f",
                  posted_at=DAY + dt.timedelta(days=5), first_seen_at=DAY, first_seq=0)
    new = dict(stored, seq=1, id="n", first_seq=1, first_seen_at=DAY + dt.timedelta(days=9), posted_at=DAY)
    rows = frame(spark, [stored]).drop("seq")
    outcomes, pointers = replay(frame(spark, [new]), rows)
    assert [(r.id, r.canonical_id) for r in pointers.collect()] == [("s", "n")]
    assert [(r.was_inserted, r.is_duplicate) for r in outcomes.collect()] == [(True, False)]
    again = dict(stored, seq=1)
    outcomes, pointers = replay(frame(spark, [again]), rows)
    assert [(r.was_inserted, r.is_duplicate) for r in outcomes.collect()] == [(False, False)]
    assert pointers.count() == 0


@pytest.mark.parametrize("slice_rows", [1, 3, 20_000])
def test_similar_pairs_equal_brute_force(spark, slice_rows):
    rnd = random.Random(7)
    words = ["data", "engineer", "backend", "senior", "platform", "qa", "x", "payments", "payment", "1"]
    items = [("hot" if rnd.random() < .5 else rnd.choice("abc"), "".join(rnd.choices(words, k=rnd.randint(0, 5))))
             for _ in range(250)]
    want = sorted((p, a, b) for p, a in set(items) for q, b in set(items) if p == q and a < b and similar(a, b))
    got = similar_pairs(spark.createDataFrame(items, "c string, t string"), "c", "t", slice_rows=slice_rows)
    rows = got.collect()
    assert sorted((r.block, r.text_a, r.text_b) for r in rows) == want and len(want) > 10
    assert all(r.shared == len(grams(r.text_a) & grams(r.text_b))
               and r.total == len(grams(r.text_a) | grams(r.text_b)) for r in rows)


def test_components(spark):
    rnd = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)]
    edges += [(rnd.randrange(200, 300), rnd.randrange(200, 300)) for _ in range(60)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        parent[hi] = lo
    linked = {x for a, b in edges if a != b for x in (a, b)}
    rnd.shuffle(edges)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in linked}


def test_arrival_duplicates_equal_running_minimum(spark):
    rnd = random.Random(11)
    rows = [(str(i), "g%d" % rnd.randrange(3), rnd.choice([None, DAY + dt.timedelta(days=rnd.randrange(9))]), DAY, i, i + 1)
            for i in range(200)]
    want = {}
    best = {}
    for r in rows:
        k = (r[2] is None, r[2] or DAY, r[3], r[4])
        want[r[0]] = r[1] in best and best[r[1]] < k
        best[r[1]] = min(best.get(r[1], k), k)
    df = spark.createDataFrame(rows, "id string, component string, posted_at timestamp, first_seen_at timestamp, first_seq long, arrival long")
    for span in (7, 100_000):
        assert {r.id: r.arrived_duplicate for r in dedup.duplicate_on_arrival(df, span).collect()} == want


def test_manual_merge_and_reparent(spark):
    rows = spark.createDataFrame([("a", None), ("b", "a"), ("c", None), ("d", "c")], "id string, canonical_job_id string")
    wanted = [("a", "d", 1), ("a", "c", 2), ("c", "c", 1), ("b", "zzz", 3), ("q", "a", 1)]
    merged, rejected = dedup.manual_merge(
        rows, spark.createDataFrame(wanted, "job_id string, canonical_id string, seq int"), "seq")
    got = [(r.id, r.canonical_job_id) for r in merged.orderBy("id").collect()]
    assert got == [("a", "c"), ("b", "a"), ("c", None), ("d", "c")]  # the last merge counts, no row is doubled
    assert {(r.job_id, r.error) for r in rejected.collect()} == {
        ("c", dedup.SELF_MERGE), ("b", dedup.UNKNOWN_TARGET), ("q", dedup.UNKNOWN_POSTING)}
    moved = spark.createDataFrame([("a", "d"), ("a", "c")], "old_id string, new_id string")
    after = dedup.reparent(rows, moved).collect()
    assert len(after) == 4 and {r.id: r.canonical_job_id for r in after}["b"] == "c"


def test_tiny_blocks_are_not_replicated(spark):
    """A trigram that is frequent over many blocks, but in none of them."""
    items = spark.range(3000).select(F.col("id").cast("string").alias("c"), F.lit("backendengineer").alias("t"))
    pairs = similar_pairs(items, "c", "t", slice_rows=10)
    assert pairs.count() == 0
    made = pairs._jdf.queryExecution().executedPlan().toString()
    assert "slices" in made  # from the table of frequent (block, trigram) keys, which is empty here


def test_changed_side_finds_the_pairs_of_changed_texts(spark):
    rnd = random.Random(9)
    words = ["data", "engineer", "backend", "platform", "payments", "payment"]
    items = {(rnd.choice("ab"), "".join(rnd.choices(words, k=rnd.randint(1, 4)))) for _ in range(120)}
    rows = [(b, t, rnd.random() < .2, f"{b}-{t}") for b, t in items]
    new = {(b, t) for b, t, changed, _ in rows if changed}
    df = spark.createDataFrame(rows, "c string, t string, changed boolean, id string")
    everything = {(r.block, r.text_a, r.text_b) for r in similar_pairs(df, "c", "t").collect()}
    got = similar_pairs(df, "c", "t", ident="id", changed="changed", slice_rows=5).collect()
    assert len(got) == len({(r.block, r.text_a, r.text_b) for r in got})
    assert {(r.block, r.text_a, r.text_b) for r in got} == {
        p for p in everything if (p[0], p[1]) in new or (p[0], p[2]) in new}
    assert all((r.id_a, r.id_b) == (f"{r.block}-{r.text_a}", f"{r.block}-{r.text_b}") for r in got) and got


def component_sets(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        parent[find(a)] = find(b)
    groups = {}
    for x in parent:
        groups.setdefault(find(x), set()).add(x)
    return sorted(map(sorted, (g for g in groups.values() if len(g) > 1)))


@pytest.mark.parametrize("sizes, share", [({}, 1), ({"slice_rows": 2, "plain_rows": 2}, .3)])
def test_spanning_edges_have_the_components_of_all_pairs(spark, sizes, share):
    rnd = random.Random(13)
    words = ["data", "engineer", "backend", "senior", "platform", "qa", "x", "payments", "payment", "1", "23"]
    items = {("hot" if rnd.random() < .6 else rnd.choice("abc"), "".join(rnd.choices(words, k=rnd.randint(0, 5))))
             for _ in range(250)} | {("hot", f"platformengineerpayments{i}") for i in range(60)}
    rows = [(b, t, rnd.random() < share, f"{b}-{t}") for b, t in items]
    df = spark.createDataFrame(rows, "c string, t string, changed boolean, id string")
    want = [(p[3], q[3]) for p in rows for q in rows
            if p[0] == q[0] and p[1] < q[1] and (p[2] or q[2]) and similar(p[1], q[1])]
    got = [tuple(r) for r in spanning_edges(df, "c", "t", "id", changed="changed", **sizes).collect()]
    assert {tuple(sorted(e)) for e in got} <= {tuple(sorted(e)) for e in want}
    assert component_sets(got) == component_sets(want) and len(want) > 60


def test_near_equal_titles_need_few_edges(spark):
    """One company with 3000 titles that are all similar: some edges a title, not a thousand."""
    items = spark.range(3000).select(F.lit("hot").alias("c"), F.concat(
        F.lit("seniorbackendplatformengineerpaymentsteam"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("t"))
    edges = spanning_edges(items, "c", "t", "t").collect()
    assert len(edges) < 12 * 3000
    assert [len(g) for g in component_sets([tuple(e) for e in edges])] == [3000]


def test_moves_that_follow_each_other(spark):
    chain = [(f"a{i:02d}", f"a{i + 1:02d}") for i in range(50)]
    ring = [("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("into", "r2"), ("self", "self")]
    odd = [("two", "z"), ("two", "a49"), (None, "x"), ("x", None)]
    settled, rejected = dedup.settle_moves(spark.createDataFrame(chain + ring + odd, "old_id string, new_id string"))
    assert {tuple(r) for r in settled.collect()} == {(a, "a50") for a, _ in chain} | {("two", "a50")}
    assert {(r.old_id, r.new_id) for r in rejected.collect()} == set(ring)
    assert {r.error for r in rejected.collect()} == {dedup.MOVE_IN_CYCLE}
    none = spark.createDataFrame([], "old_id string, new_id string")
    assert [df.count() for df in dedup.settle_moves(none)] == [0, 0]
