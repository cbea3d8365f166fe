import random
import zlib

import brute
import numpy as np

from rolegrid.llm import toxicity as t

LABELS = "doc_id long, quality int, toxic int"
BAD = ["snarlword", "grubface", "mudhead", "vilething"]


def tables(n=500):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(n):
        words = brute.prose(rng, rng.randrange(20, 120)).split()
        toxic = i % 6 == 0
        for _ in range(rng.randrange(1, 4) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", "s", "ness"]))
        docs.append(brute.doc(i, " ".join(words)))
        if i % 5 < 3:
            labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_folds(spark):
    docs, labels = tables()
    docs += brute.odd_docs() + [docs[6]]
    df = spark.createDataFrame([(*d, 0.5) for d in docs], brute.DOCS + ", score double")
    got = t.classify(df, spark.createDataFrame(labels + [(None, 1, 1), (3, None, None)], LABELS)).collect()
    assert len(got) == len(docs)
    truth = [(r.predicted, int(r.doc_id % 6 == 0)) for r in got if r.doc_id is not None and r.doc_id < 500 and r.held_out]
    assert len(truth) > 60
    assert np.mean([p == y for p, y in truth]) >= 0.97
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert not any(r.predicted for r in got if r.doc_id in (9001, 9002, 9003))


def test_labels_of_the_held_out_fold_change_nothing(spark):
    docs, labels = tables(200)
    df = spark.createDataFrame(docs, brute.DOCS)
    other = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, q, y in labels]
    a, b = (sorted(map(tuple, t.classify(df, spark.createDataFrame(x, LABELS)).collect())) for x in (labels, other))
    assert a == b


def test_no_positive_example_and_empty_tables(spark):
    docs, labels = tables(40)
    df = spark.createDataFrame(docs, brute.DOCS)
    none = spark.createDataFrame([], LABELS)
    assert all(r.score < 0.5 for r in t.classify(df, none).collect())
    assert t.classify(spark.createDataFrame([], brute.DOCS), none).collect() == []


def test_negative_part_of_the_risk_is_held_back():
    """With few unlabelled texts, all of them positive, the model must not call positives negative."""
    pos = [np.array([1, 2], np.int32)] * 40
    unl = [np.array([1, 2], np.int32)] * 5 + [np.array([3], np.int32)] * 45
    model = t.train_nnpu(pos, unl, 0.1)
    assert model.raw([1, 2]) > 0 > model.raw([3])
