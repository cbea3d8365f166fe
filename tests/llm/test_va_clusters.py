import hashlib
import math
import random

import numpy as np
import pytest

from rolegrid.llm import va_clusters as va

TABLE = "vec_id long, embedding array<float>, label int, cluster string, row_no long"


def brute(rows, k=8, rounds=10):
    """Plain Python version: ``(vec_id, cluster, distance)`` and centroids."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: ((1, "") if r[0] is None else (0, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest()), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for j, g in groups.items():
            centroids[j] = [sum(c) // len(g) for c in zip(*g, strict=True)]
    return [(i, nearest(v)[1], nearest(v)[0]) for i, v in kept], centroids


def vectors(seed, n, spread=0.15, centres=5):
    rng = np.random.RandomState(seed)
    base = rng.normal(0, 0.1, (centres, 64))
    return [(i, [float(np.float32(x)) for x in base[rng.randint(centres)] + rng.normal(0, spread, 64)]) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], TABLE)


def check(spark, rows, **options):
    want, centroids = brute(rows)
    got = va.report(frame(spark, rows), **options).collect()
    text = lambda rs: sorted(tuple(map(str, r)) for r in rs)
    assert text((r.vec_id, r.cluster, r.distance) for r in got) == text(want)
    sums = {}
    for _, j, d in want:
        sums[j] = sums.get(j, 0) + d
    for r in got:
        assert (r.cluster_inertia, r.inertia) == (sums[r.cluster], sum(sums.values()))
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()


@pytest.mark.parametrize("bits", [8, 3])
def test_equals_plain_rounds(spark, bits):
    rows = vectors(1, 700)
    rows += [(None, rows[3][1]), (5, rows[5][1]), (5, rows[5][1]), (5, rows[6][1]), (900, None), (901, []), (902, [1.0] * 63),
             (903, [1.0] * 65), (904, [math.nan] + [0.0] * 63), (905, [math.inf] + [0.0] * 63), (906, [None] + [0.0] * 63)]
    check(spark, rows, bits=bits, bucket_rows=150)


def test_copies_and_ties(spark):
    """A third of the rows are one vector; whole grids of equal distances."""
    rng = random.Random(2)
    rows = [(i, [0.25] * 64) for i in range(100)]
    rows += [(i, [rng.choice((-0.5, 0.5))] * 32 + [rng.choice((-0.5, 0.5))] * 32) for i in range(100, 300)]
    check(spark, rows)


def test_far_vectors_are_exact(spark):
    rows = [(i, [float(np.float32((-1) ** i * 2.0 ** (i % 18) + i))] * 64) for i in range(60)]
    check(spark, rows)


def test_distance_beyond_64_bits_is_null(spark):
    rows = [(i, [float(2.0 ** 38 * (i % 9))] * 64) for i in range(27)]
    want = {i: j for i, j, _ in brute(rows)[0]}
    got = va.report(frame(spark, rows)).collect()
    assert {r.vec_id: r.cluster for r in got} == want
    assert any(r.distance is None for r in got) and all(r.inertia is None for r in got)


def test_few_rows_and_none(spark):
    check(spark, vectors(3, 3))
    assert va.report(frame(spark, [])).collect() == []
    assert va.report(frame(spark, [(1, None)])).collect() == []


def test_known_centroids_are_right_and_most_vectors_stay_unread(spark):
    rng = np.random.RandomState(5)
    x = np.floor(1024 * rng.normal(0, 0.125, (4000, 64))).astype(np.int64)
    centroids = x[:8] // 4
    grid = va.Grid(tuple(x.min(0)), tuple(x.max(0)), 8)
    cells = grid.cells(x)
    low, high = grid.borders()
    assert (low[np.arange(64), cells] <= x).all() and (x <= high[np.arange(64), cells]).all()
    best, sure = va.known(cells.astype(np.int64), grid.tables(centroids))
    assert (va.distances(x, centroids).argmin(1) == best)[sure].all() and sure.mean() > 0.6


def test_a_round_fetches_few_full_vectors(spark):
    table = frame(spark, vectors(7, 2000, 0.05))
    stored = va.bucketed(va.kept(table, "embedding", 64, 1024), 4)
    ranges = va.value_ranges(stored.select("v"), 64, 1024)
    grid = va.Grid(tuple(r[0] for r in ranges), tuple(r[1] for r in ranges), 8)
    cells = va.approximations(stored, grid, 64, 1024)
    first = va.start(stored, 8, 1024)
    asked = va.wanted(cells, grid, first, first)
    assert cells.count() == 2000 and asked.count() < 1000
    plan = stored.join(asked.hint("shuffle_hash"), "row_no", "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange") == 1  # the row numbers travel, no vector
