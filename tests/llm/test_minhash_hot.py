"""Groups of near copies: all links are found without all pairs."""

import random

import brute

from rolegrid.llm import minhash


def test_copies_of_one_text_with_and_without_it(spark):
    rng = random.Random(8)
    docs = []
    for base in range(3):
        words = [f"b{base}w{i}" for i in range(90)]
        if base:
            docs.append(brute.doc(1000 * base, " ".join(words)))
        for k in range(40):
            new = list(words)
            for j in rng.sample(range(90), rng.randrange(1, 9)):
                new[j] = f"n{base}x{k}x{j}"
            docs.append(brute.doc(1000 * base + 1 + k, " ".join(new)))
    want = brute.components(docs, 2)
    got = minhash.near_duplicates(spark.createDataFrame(docs, brute.DOCS), shingle=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert 3 < len({v[1] for v in want.values()}) < len(docs)
