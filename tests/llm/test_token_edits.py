import random

import brute
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rolegrid.llm import token_edits as t

PATH = public_tokenizers.path("byte_bpe_50k.json")


def tokens(text):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return len(tokenizer.encode(text, add_special_tokens=False).ids)


def edited(text, edits):
    for start, deleted, inserted in edits:
        start = min(max(start, 0), len(text))
        text = text[:start] + (inserted or "") + text[start + max(deleted, 0):]
    return text


def random_edits(rng, length, n):
    glue = ["", " ", "  ", "\n", "'s", "l", "7", ".", " x", "\x1c", "\u3000", "\x85", "word word", "é!", "\n\n "]
    return [(rng.randrange(-2, length + 20), rng.choice([0, 0, 1, 2, 5, 30]), rng.choice(glue)) for _ in range(n)]


def test_tree_equals_a_full_recount():
    rng = random.Random(4)
    cut, counts = t._cutter(), t.Counts(PATH)
    for case in range(250):
        text = "".join(rng.choice(["word", " the", " ", "'s", "  ", "\n", "12", ",", "é", " a.b", "'", "\t"])
                       for _ in range(rng.choice([0, 3, 60, 400])))
        pieces = cut.findall(text)
        tree = t.TokenTree(list(map(len, pieces)), [counts[p] for p in pieces])
        for start, deleted, inserted in random_edits(rng, len(text), 6):
            want = edited(text, [(start, deleted, inserted)])
            text, fresh = tree.edit(text, start, deleted, inserted, cut, counts)
            assert text == want
            pieces = cut.findall(text)
            assert [s for c in tree.chunks for s in c[0]] == list(map(len, pieces)), (case, text, start, deleted, inserted)
            assert tree.total == sum(counts[p] for p in pieces)


def test_only_the_touched_region_is_counted():
    cut, counts = t._cutter(), t.Counts(PATH)
    text = " ".join(f"word{i}" for i in range(20000))
    pieces = cut.findall(text)
    tree = t.TokenTree(list(map(len, pieces)), [counts[p] for p in pieces])
    for place in (0, 40000, len(text)):
        text, fresh = tree.edit(text, place, 3, " new ", cut, counts)
        assert fresh <= 8
    assert tree.total == sum(counts[p] for p in cut.findall(text))


def test_counts_after_edits(spark):
    rng = random.Random(6)
    docs = brute.corpus(5, 20)
    rows = [(*d, 5, random_edits(rng, len(d[1] or ""), rng.randrange(0, 9)) if d[0] != 9004 else [(1, 0, "x")]) for d in docs]
    rows[0] = (*rows[0][:-1], None)
    df = spark.createDataFrame(rows, f"{brute.DOCS}, sizes int, edits {t.EDITS}")
    got = t.recount(t.build(df, PATH), PATH, keep_trees=True).collect()
    assert len(got) == len(rows)
    by_id = {r[0]: r for r in rows}
    for r in got:
        if r.doc_id is None:
            continue
        text, edits = by_id[r.doc_id][1] or "", by_id[r.doc_id][-1] or []
        after = edited(text, edits)
        assert r.text == after and r.n_edits == len(edits)
        assert (r.n_tokens_before, r.n_tokens) == (tokens(text), tokens(after))
        assert sum(r.tokens) == r.n_tokens and len(r.sizes) == r.n_pretokens


def test_edits_of_a_table_and_empty_tables(spark):
    docs = spark.createDataFrame([brute.doc(1, "one two"), brute.doc(2, "x"), brute.doc(None, "y")], brute.DOCS)
    edits = spark.createDataFrame([(1, 2, 0, 3, None), (1, 1, 7, 0, " three"), (None, 1, 0, 0, "z")],
                                  "doc_id long, seq long, start long, deleted long, inserted string")
    got = {r.doc_id: r for r in t.recount(t.build(t.attach_edits(docs, edits), PATH), PATH, True).collect()}
    assert got[1].text == " two three" and got[2].n_edits == 0 and got[None].text == "y"
    none = docs.limit(0).withColumn("edits", F.lit(None).cast(t.EDITS))
    assert t.recount(t.build(none, PATH), PATH).collect() == []
