import brute
import numpy as np

from rolegrid.llm import substrings


def test_removal_matches_brute_force(spark):
    docs = brute.corpus(8, 40)
    df = spark.createDataFrame([(*d, "x") for d in docs], brute.DOCS + ", digest string")
    got = sorted(map(tuple, substrings.dedup(df).collect()), key=repr)
    want = sorted(brute.substring_dedup(docs), key=repr)
    assert got == want
    assert sum(r[2] > 0 for r in want) > 12


def test_small_window_and_kept_words(spark):
    docs = [brute.doc(5, "a b c d e f g a b c d"), brute.doc(3, "z b c d e q"), brute.doc(3, "z b c d e q"),
            brute.doc(9, "b c d e b c d e"), brute.doc(None, "b c d e")]
    got = sorted(map(tuple, substrings.dedup(spark.createDataFrame(docs, brute.DOCS), window=4).collect()), key=repr)
    assert got == sorted(brute.substring_dedup(docs, 4), key=repr)


def test_empty_table(spark):
    assert substrings.dedup(spark.createDataFrame([], brute.DOCS)).collect() == []


def test_rolling_hash_depends_on_words_only():
    words = np.arange(1, 301, dtype=np.uint64) % np.uint64(100)
    h = substrings.rolling(words, 50)
    assert len(h) == 251 and (h[:100] == h[100:200]).all() and len(set(h[:100].tolist())) == 100
    x = np.random.RandomState(0).randint(0, 1000, 200)
    for width in (1, 2, 5, 41):
        assert substrings.sliding_min(x, width).tolist() == [x[i:i + width].min() for i in range(200 - width + 1)]
