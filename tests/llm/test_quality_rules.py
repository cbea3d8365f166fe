import random

import brute
import numpy as np

from rolegrid.llm import quality_rules as q


def clean(rng, i):
    lines = [brute.prose(rng, rng.randrange(15, 60), 5000) for _ in range(rng.randrange(4, 9))]
    return brute.doc(i, "\n".join(lines), "en", "s0")


def test_counts_match_brute_force(spark):
    docs = brute.corpus(9, 40) + [brute.doc(1, "a a a a a a"), brute.doc(2, "a b c x a b c a b c a"),
                                  brute.doc(3, "# * $% a|b <i>\n\n x \nx \n x ")]
    df = spark.createDataFrame([(*d, 1) for d in docs], brute.DOCS + ", n_words long")
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
           for r in q.judge(df).collect()]
    assert sorted(got, key=repr) == sorted(((d[0], *brute.quality_counts(d[1])) for d in docs), key=repr)


def test_outliers_go_and_clean_texts_stay(spark):
    rng = random.Random(4)
    docs = [clean(rng, i) for i in range(150)]
    junk = [brute.doc(900 + i, " ".join(w + "%%%" for w in clean(rng, 0)[1].split())) for i in range(20)]
    few = [brute.doc(950 + i, clean(rng, 0)[1] + " *** ", "xx", None) for i in range(5)]
    scattered = [brute.doc(1000 + i, clean(rng, 0)[1], "yy", f"t{i % 20}") for i in range(100)]
    lost = [brute.doc(1200 + i, junk[i][1], "yy", f"t{i}") for i in range(4)]
    rows = {r.doc_id: r for r in q.judge(spark.createDataFrame(docs + junk + few + scattered + lost, brute.DOCS)).collect()}
    assert all(rows[d[0]].kept for d in docs)
    assert not any(rows[d[0]].kept for d in junk)
    assert all(rows[d[0]].kept and rows[d[0]].distance is None for d in few)  # too few for an estimate
    assert all(rows[d[0]].kept for d in scattered) and not any(rows[d[0]].kept for d in lost)  # small sources together


def test_each_share_can_reject_alone(spark):
    """Lines that nearly all repeat, and words of which half repeat, in a group where nothing does."""
    rng = random.Random(5)
    docs = [clean(rng, i) for i in range(100)]
    few = [f"word{c}" for c in "abcdefghijkl"]
    triples = [(a, b, c) for a in few for b in few for c in few]
    lines, seen = few[:2], set()
    while len(lines) < 220:  # twelve lines in an order in which no three neighbours come again
        lines.append(next(c for a, b, c in rng.sample(triples, len(triples)) if (a, b) == tuple(lines[-2:]) and (a, b, c) not in seen))
        seen.add(tuple(lines[-3:]))
    words = [f"w{rng.randrange(10**5)}x{i}" for i in range(165)]
    odd = [brute.doc(900, "\n".join(lines), "en", "s0"), brute.doc(901, " ".join(words + words[:52]), "en", "s0")]
    rows = {r.doc_id: r for r in q.judge(spark.createDataFrame(docs + odd, brute.DOCS)).collect()}
    assert (rows[900].n_repeat_words, rows[901].n_dup_lines) == (0, 0) and rows[900].n_dup_lines > 190 and rows[901].n_repeat_words == 104
    assert all(rows[d[0]].kept for d in docs) and not any(rows[i].kept or rows[i].base_failed for i in (900, 901))


def test_distance_is_that_of_the_covariance(spark):
    """Cholesky columns against numpy on the same moments."""
    rng = random.Random(6)
    stats = q.statistics(spark.createDataFrame([clean(rng, i) for i in range(80)], brute.DOCS))
    vectors = stats.select(*q._GROUP, "doc_id", q.F.array(*q._vector()).alias("x"))
    model = q._factor(q._estimate(vectors))
    x = np.array([r.x for r in vectors.orderBy("doc_id").collect()], float)
    factor = q.H / q.chi2_cdf(q.chi2_quantile(q.H, q.DIM), q.DIM + 2)
    cov = np.cov(x.T) * factor + np.diag(np.array(q.FLOOR, float) ** 2)
    d = x - x.mean(axis=0)
    want = np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)
    got = [r.distance for r in q._with_distance(vectors, model).orderBy("doc_id").collect()]
    assert np.allclose(got, want)


def test_chi_square_tables():
    assert abs(q.chi2_quantile(0.95, 5) - 11.0705) < 1e-3 and abs(q.chi2_cdf(18.3070, 10) - 0.95) < 1e-5


def test_keep_good_and_empty_table(spark):
    docs = brute.corpus(9, 20)
    df = spark.createDataFrame([(*d, 1.0) for d in docs], brute.DOCS + ", distance double")
    for limit in (q.BROADCAST_IDS, 0):
        kept = q.keep_good(df, limit)
        assert kept.columns == df.columns
        good = [r for r in kept.collect()]
        assert good and all(not brute.quality_counts(r.text)[-1] for r in good)
    assert q.judge(spark.createDataFrame([], brute.DOCS)).collect() == []
    assert q.keep_good(spark.createDataFrame([], brute.DOCS)).collect() == []
