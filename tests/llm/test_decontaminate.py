import random

import brute
import pytest

from rolegrid.llm import decontaminate

ITEMS = "item_id long, text string"


def tables():
    rng = random.Random(11)
    items = [(i, brute.prose(rng, n, 5000)) for i, n in enumerate([5, 12, 13, 14, 30, 40, 40])]
    items += [(90, None), (91, ""), (92, "..!"), (3, items[3][1]), (None, items[5][1]), (10, items[4][1].upper())]
    docs = brute.corpus(4, 20)
    for i, (_, text) in enumerate(items[:7]):
        w = text.split()
        docs += [brute.doc(2000 + i, brute.prose(rng, 30) + "; " + ", ".join(w).upper() + "! " + brute.prose(rng, 9)),
                 brute.doc(2100 + i, brute.prose(rng, 300) + " " + " ".join(w[:13]) + " é " + " ".join(w[1:])),
                 brute.doc(2200 + i, " ".join(w[:12]) + " x " + " ".join(w[12:]))]
    return docs, items


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 400])
def test_hits_match_brute_force(spark, block_bytes):
    docs, items = tables()
    got = decontaminate.verdicts(spark.createDataFrame(docs, brute.DOCS), spark.createDataFrame(items, ITEMS),
                                 block_bytes=block_bytes).collect()
    spelled = [("" if i is None else i, t) for i, t in items]
    want = sorted(((d[0] is None, d[0], *brute.contamination(d[1], spelled)) for d in docs), key=repr)
    assert sorted(((r.doc_id is None, r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in got), key=repr) == want
    texts = {}
    for d in docs:
        texts.setdefault(d[0], d[1])
    assert any(r.contaminated for r in got) and not all(r.contaminated for r in got)
    for r in got:
        assert r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words)
        if r.spans:  # offsets are those of the original text
            hit = [brute.PLAIN.findall(texts[r.doc_id][s.start:s.end].translate(brute.AZ)) for s in r.spans]
            assert sum(map(len, hit)) == r.n_hit


def test_empty_tables(spark):
    docs, items = tables()
    none = spark.createDataFrame([], ITEMS)
    got = decontaminate.verdicts(spark.createDataFrame(docs, brute.DOCS), none).collect()
    assert len(got) == len(docs) and not any(r.contaminated for r in got)
    assert decontaminate.verdicts(spark.createDataFrame([], brute.DOCS),
                                  spark.createDataFrame(items, ITEMS)).collect() == []
