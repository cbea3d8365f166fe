import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rolegrid.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


TEXTS = ["", " ", "a", " a", "a ", "  a  b ", "it's  we'll\n\n\nx \t y", "word,word. 12,5 x.", "\n a", "a \n",
         "<|endoftext|> end", "naïve Ünï 中文 、 ok", "a  b   c", "tab\tx ,. , .", " 's 'S ' s", "emoji 🎉🎉 x"]


def test_encoder_equals_the_tokenizer(tokenizer):
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice("ab, .'\n\t1é ") for _ in range(40)) for _ in range(400)]
    encoder = packing.Encoder(PATH)
    for text in texts:
        want = np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert encoder.ids(text) == want, repr(text)


def test_tightest_window_is_taken():
    rng = np.random.RandomState(3)
    lengths = rng.randint(1, 65, 500)
    window, offset = packing.best_fit(lengths, 64)
    rooms, place = [], {}
    for i in np.argsort(-lengths, kind="stable"):
        fits = [(r, w) for w, r in enumerate(rooms) if r >= lengths[i]]
        if not fits:
            rooms.append(64)
            fits = [(64, len(rooms) - 1)]
        r = min(fits)[0]
        place.setdefault(r, 0)
        rooms[min(fits)[1]] -= lengths[i]
    used = np.bincount(window, weights=lengths)
    assert len(used) == len(rooms) and sorted(used) == sorted(64 - np.array(rooms))
    assert used.max() <= 64


def check(got, docs, tokenizer, capacity):
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
    for doc_id, text in {d[0]: d[1] for d in docs if d[0] is not None}.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        copies = sum(d[0] == doc_id for d in docs)
        own = sorted(pieces[doc_id], key=lambda r: r.start)[::copies]
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]]
        for r in own:
            assert r.doc_tokens == len(ids)
            assert zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32
            if hasattr(r, "ids"):
                assert bytes(r.ids) == ids[r.start:r.start + r.length].tobytes()
        assert own[-1].start + own[-1].length == len(ids)
    windows = {}
    for r in got:
        windows.setdefault(r.sequence_id, []).append(r)
    for rows in windows.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == [0, *np.cumsum([r.length for r in rows])[:-1]]
        assert rows[-1].offset + rows[-1].length <= capacity
    return windows


@pytest.mark.parametrize("bins", [packing.BIN_PIECES, 20])
def test_every_id_in_one_piece(spark, tokenizer, bins):
    docs = brute.corpus(6, 30) + [brute.doc(7000 + i, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame([(*d, "x") for d in docs], brute.DOCS + ", piece string")
    got = packing.pack(df, PATH, 128, keep_ids=bins == 20, bin_pieces=bins).collect()
    windows = check(got, docs, tokenizer, 128)
    filled = sum(r.length for r in got) / (128 * len(windows))
    assert filled > (0.95 if bins > 20 else 0.8)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], brute.DOCS), PATH).collect() == []
