import random

import brute
import public_tokenizers
import pytest
import tiktoken

from rolegrid.llm import byte_bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN

TEXTS = [None, "", " ", "  ", "a", " a", "a ", "it's  we'll'S 'd\n\n\nx \t y", "word,word. 12,5 x.", "\n a", "a\x1c\x1d b",
         "a\x85b\xa0c d　e", "<|endoftext|> end", "naïve Ünï 中文、日本語のテキスト。 ok", "🎉🎉 👩‍👩‍👧 x", "ab" * 3000,
         "Ab1-c'd" * 2000, "。，" * 3000 + "語。" * 3000, "aaaaaaa" * 50, "͸\U000e0101 é", "٣٤ ²½ Ⅷ"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})


def test_ids_equal_merging_by_ranks(library):
    rng = random.Random(4)
    signs = "ab ,.'sS1é\n\t\x1c\x85 　中。語ñ🎉٣²"
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(signs) for _ in range(60)) for _ in range(1500)]
    texts += ["".join(rng.choice(signs) for _ in range(9000)).replace(" ", "") for _ in range(3)]
    encoder = byte_bpe.Encoder(PATH, PATTERN)
    for text, ids in zip(texts, encoder.ids(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text), repr(text[:80])
    long = " ".join(texts)
    assert len(long) > byte_bpe.LONG_TEXT // 16
    byte_bpe.LONG_TEXT, kept = 5000, byte_bpe.LONG_TEXT
    assert encoder.ids([long])[0].tolist() == library.encode_ordinary(long)
    byte_bpe.LONG_TEXT = kept


def test_every_code_point(library):
    encoder = byte_bpe.Encoder(PATH, PATTERN)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or c % 17 == 0)]
    for at in range(0, len(points), 64):
        text = "".join(f"a{chr(c)}1{chr(c)} {chr(c)}.{chr(c)}" for c in points[at:at + 64])
        assert encoder.ids([text])[0].tolist() == library.encode_ordinary(text), hex(points[at])


def test_last_pair_of_each_token():
    ranks = {b"a": 0, b"b": 1, b"aa": 2, b"ab": 3, b"aab": 4, b"aaab": 5, b"ba": 6, b"bb": 7, b"zz": 8}
    assert byte_bpe.last_pair(b"aab", ranks) == (b"aa", b"b")
    assert byte_bpe.last_pair(b"aaab", ranks) == (b"aa", b"ab")
    assert byte_bpe.last_pair(b"bbbb", ranks) == (b"bb", b"bb")
    assert byte_bpe.last_pair(b"azzz", ranks) is None


def test_places_of_tokens(spark, library):
    docs = brute.corpus(3, 12) + [brute.doc(50000 + i, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame([(*d, [1], "x") for d in docs], brute.DOCS + ", ids array<int>, window string")
    texts = {d[0]: d[1] or "" for d in docs}
    rows = byte_bpe.encode(df, PATH, PATTERN).collect()
    assert len(rows) == len(docs)
    split = 0
    for r in (r for r in rows if r.doc_id is not None):
        ids, spans = library.encode_ordinary(texts[r.doc_id]), []
        assert r.ids == ids
        raw, at = texts[r.doc_id], 0
        for i in ids:
            spans.append(at)
            at += len(library.decode_single_token_bytes(i))
        begins = [0]
        for c in raw:
            begins.append(begins[-1] + len(c.encode()))
        for char, inner, at in zip(r.chars, r.inner, spans, strict=True):
            assert begins[char] + inner == at < begins[char + 1]
            split += inner > 0
    assert split > 0


def test_bytes_and_windows_come_back(spark):
    docs = [brute.doc(i, t) for i, t in enumerate(TEXTS)] + [brute.doc(3, TEXTS[3]), brute.doc(None, "naïve 🎉")]
    df = spark.createDataFrame(docs, brute.DOCS)
    tokens = byte_bpe.encode(df, PATH, PATTERN, keep_places=False)
    want = sorted((str(d[0]), (d[1] or "").encode()) for d in docs)
    assert sorted((str(r.doc_id), bytes(r.bytes)) for r in byte_bpe.decode(tokens, PATH, PATTERN).collect()) == want
    parts = {}
    for r in byte_bpe.decode_windows(tokens.dropDuplicates(["doc_id"]), PATH, PATTERN, 1).collect():
        parts.setdefault(r.doc_id, []).append((r.window, r.text))
    for d in docs:
        got = [t for _, t in sorted(parts.get(d[0], []))]
        assert "".join(got) == (d[1] or "") and "�" not in "".join(got)


def test_odd_ids_and_empty_tables(spark):
    rows = byte_bpe.decode(spark.createDataFrame([(1, [5, None, -1, 10**6]), (2, None)], "doc_id long, ids array<int>"),
                           PATH, PATTERN).collect()
    assert [len(r.bytes) for r in sorted(rows)] == [1, 0]
    empty = spark.createDataFrame([], brute.DOCS)
    assert byte_bpe.decode_windows(byte_bpe.encode(empty, PATH, PATTERN), PATH, PATTERN).collect() == []


def test_query_digests(spark, tmp_path, library):
    import hashlib

    from rolegrid.llm.queries import op11_byte_bpe

    docs = brute.corpus(5, 20) + [brute.doc(50000 + i, t) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(docs, brute.DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op11_byte_bpe(spark, str(tmp_path)).collect()}
    for d in (d for d in docs if d[0] is not None):
        ids, r = library.encode_ordinary(d[1] or ""), got[d[0]]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((d[1] or "").encode()).hexdigest()
