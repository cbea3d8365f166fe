import random

import brute
import numpy as np
import pytest

from rolegrid.llm import minhash


def rows(spark, docs, **kw):
    return minhash.near_duplicates(spark.createDataFrame(docs, brute.DOCS), **kw).collect()


@pytest.mark.parametrize("size", [2, 5])
def test_components_match_all_pairs(spark, size):
    docs = brute.corpus()
    want = brute.components(docs, size)
    got = rows(spark, docs, shingle=size)
    assert len(got) == len(docs)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
            assert r.kept == (r.doc_id == r.component_id)


def test_chain_of_near_copies_is_one_component(spark):
    """Ends of a chain are too far apart for a link but belong together."""
    rng = random.Random(5)
    words = brute.prose(rng, 120, 5000).split()
    docs = []
    for i in range(12):
        docs.append(brute.doc(i, " ".join(words)))
        for j in range(3):
            words[(i * 9 + j * 3) % 120] = f"new{i}{j}"
    want = brute.components(docs, 2)
    assert {v[1] for v in want.values()} == {0}
    assert {r.component_id for r in rows(spark, docs, shingle=2)} == {0}


def test_small_sets_at_the_threshold(spark):
    docs = [brute.doc(1, "a b c d e f"), brute.doc(2, "a b c d e"), brute.doc(3, "a b c d"), brute.doc(4, "x y")]
    want = brute.components(docs, 2)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows(spark, docs, shingle=2)} == want


def test_registers_estimate_similarity():
    rng = np.random.RandomState(1)
    for size in (40, 4000):
        a = np.unique(rng.randint(0, 2 ** 63, size).astype(np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[: size * 4 // 5], rng.randint(0, 2 ** 63, size // 10).astype(np.uint64)]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        same = (minhash.registers(a) == minhash.registers(b)).mean()
        estimate = (same - minhash.COLLISION) / (1 - minhash.COLLISION)
        assert abs(estimate - true) < 6 * (true * (1 - true) / min(size, minhash.BUCKETS)) ** 0.5


def test_empty_table_and_keep_one(spark):
    assert rows(spark, []) == []
    docs = [brute.doc(2, "a b c d e f"), brute.doc(1, "a b c d e f"), brute.doc(1, "a b c d e f"),
            brute.doc(3, None), brute.doc(None, "x")]
    df = spark.createDataFrame([(*d, 7, True) for d in docs], brute.DOCS + ", n_shingles long, kept boolean")
    kept = minhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3]
