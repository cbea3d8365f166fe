import random
import re
from collections import Counter

import brute
import numpy as np
import pytest

from rolegrid.llm import collocations as co

PIECE, WORD = re.compile(r"[.,;:!?\x0A-\x0D]"), re.compile(r"[^\x20\x09]+")


def plain(docs, least=10, percent=50, top=2000):
    f, n = {}, Counter()
    for _, text, lang, *_ in docs:
        for piece in PIECE.split((text or "").translate(brute.AZ)):
            w = WORD.findall(piece)
            n[lang or "und"] += len(w)
            for size in (1, 2, 3):
                f.setdefault(lang or "und", Counter()).update(tuple(w[i:i + size]) for i in range(len(w) - size + 1))
    rows = []
    for lang, c in f.items():
        long = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in long.items():
            if len(p) == 2 and any(100 * b >= percent * a and p in (q[:2], q[1:]) for q, b in long.items() if len(q) == 3):
                continue
            cuts = [(10**6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1):
            rows.append((lang, rank, p.decode(), -a, x, y, n[lang], -s))
    return sorted(rows)


def texts(seed, n, langs=("en", "de", None)):
    rng = random.Random(seed)
    fixed = ["red hot iron", "New York", "so far so good", "a a a a", "é ñ", "x\x00y z"]
    out = []
    for i in range(n):
        words = [rng.choice(fixed) if rng.random() < 0.2 else f"w{int(rng.paretovariate(0.8))}" for _ in range(rng.randrange(120))]
        sep = lambda: rng.choice([" "] * 12 + ["  ", "\t", ". ", ",", "\n", "!? ", "\x0b"])
        out.append(brute.doc(i, "".join(w + sep() for w in words), rng.choice(langs)))
    return out


def run(spark, docs, **options):
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], brute.DOCS + ", rank int, phrase string")
    return sorted(tuple(r) for r in co.collocations(df, **options).collect())


@pytest.mark.parametrize("sizes", [{}, {"shard_words": 700, "block_windows": 60, "range_windows": 400},
                                   {"shard_words": 500, "block_windows": 40, "range_windows": 300, "fan": 3}])
def test_equals_plain_counts(spark, sizes):
    docs = texts(1, 500) + brute.odd_docs()
    want = plain(docs)
    assert len(want) > 60 and {r[0] for r in want} >= {"en", "de", "und"}
    assert run(spark, docs, **sizes) == want


def test_small_top_ties_and_empty(spark):
    docs = texts(2, 300, ("en",))
    assert run(spark, docs, top=7, least=3) == plain(docs, 3, 50, 7)
    assert run(spark, [brute.doc(1, "a b c"), brute.doc(2, None, None)]) == []
    assert run(spark, []) == []


def test_hot_first_word_spreads_over_ranges(spark):
    rng = random.Random(3)
    docs = [brute.doc(i, " ".join("the w%d" % rng.randrange(300) for _ in range(60)), "en") for i in range(300)]
    assert run(spark, docs, shard_words=2000, block_windows=50, range_windows=300) == plain(docs)


def test_long_text_in_parts(spark, monkeypatch):
    text = " ".join(f"x{i % 37} y{i % 11}" for i in range(6000))
    docs = [brute.doc(1, text), brute.doc(2, text + "z")]
    monkeypatch.setattr(co, "PART_BYTES", 500)
    parts = [w for p in co._parts(text.encode()) for w in co.words_and_ends(p)]
    assert parts == co.words_and_ends(text.encode())
    shard, whole = co.Shard(), co.Shard()
    whole.add(parts)
    halves = []
    for at in range(0, len(parts), 1001):
        shard.add(parts[at:at + 1001])
        halves.append(shard.windows(False))
        last, shard = shard.last, co.Shard()
        shard.add(last)
    got, want = co.unite([*halves, shard.windows()]), whole.windows()
    assert got.words == want.words and (got.paths == want.paths).all() and (got.weights == want.weights).all()
    assert run(spark, docs, shard_words=1500) == plain(docs)


def test_automaton_round_trip_union_and_composition():
    rng = np.random.RandomState(4)
    words = [b"%c%c" % (97 + i // 26, 97 + i % 26) for i in range(80)]

    def some(n):
        p = rng.randint(1, 81, (n, 3))
        p[rng.rand(n) < 0.2, 2] = 0
        p[rng.rand(n) < 0.1, 1:] = 0
        return co.Automaton.of(words, p, rng.randint(1, 3, n))

    def as_dict(a):
        return dict(zip(a.phrases(), a.weights.tolist(), strict=True))

    a, b = some(4000), some(3000)
    back = co.Automaton.from_bytes(a.to_bytes())
    assert back.words == a.words and (back.paths == a.paths).all() and (back.weights == a.weights).all()
    assert list(as_dict(a)) == sorted(as_dict(a), key=lambda p: p.split())
    both = Counter(as_dict(a)) + Counter(as_dict(b))
    assert as_dict(co.unite([a, b])) == dict(both)
    at, f = a.look_up(b)
    asked = b.phrases()
    assert {asked[i]: w for i, w in zip(at.tolist(), f.tolist(), strict=True)} == {
        p: w for p, w in as_dict(a).items() if p in set(asked)}
    for k in (1, 2, 3):
        paths, sums = a.prefix_sums(k)
        want = Counter()
        for p, w in as_dict(a).items():
            if len(p.split()) >= k:
                want[tuple(p.split()[:k])] += w
        assert {tuple(a.words[i - 1] for i in q[:k]): s for q, s in zip(paths.tolist(), sums.tolist(), strict=True)} == want
    empty = co.Automaton.of([], np.zeros((0, 3), np.int64), np.zeros(0, np.int64))
    assert len(co.Automaton.from_bytes(empty.to_bytes()).paths) == 0


def test_equal_states_are_written_once():
    words = [b"w%03d" % i for i in range(200)]
    grid = np.array([(i, j, k) for i in range(1, 60) for j in range(1, 60) for k in (5, 9, 200)], np.int64)
    many = co.Automaton.of(words, grid, np.ones(len(grid), np.int64))
    starts = many.pair_starts()
    state, kept = co._equal_states(many.paths[:, 2], many.weights, starts, np.diff(np.r_[starts, len(many.paths)]))
    assert len(kept) == 1 and set(state.tolist()) == {0}
