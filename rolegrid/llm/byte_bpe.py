"""Byte-level BPE over Arrow batches: ids, their places in the text, and back.

The vocabulary is a rank file: one line per token, its bytes in base64 and its
rank. The ``tokenizers`` library does the merging. It wants printable tokens
and a list of merges, so

* every byte is spelled as one printable character (``BYTE_CHARS``), and
* the merge that makes a token is the last pair that the ranks themselves leave
  of its bytes. A stretch of bytes that ends up as a token went through exactly
  that pair wherever it stands, so one merge per token gives what merging by
  ranks gives; a pre-token that is a token as it stands is taken whole.

A text is cut before white space that follows a visible character; no match of
the splitting pattern reaches over such a border. Each piece is encoded once
and remembered; the new pieces of a batch go to the library together.

``encode`` gives, beside the ids, the code point in which each token starts and
how many bytes of that code point belong to tokens before it, so a character
that is split over tokens can be found. ``decode`` reverses the byte table.
``decode_windows`` cuts the ids into windows and gives each the characters that
start in it, so that the windows' texts joined are the text, whole.

A null text is the empty text: no ids. Rows are independent, so repeated rows
and null keys stay as they are; other columns do not matter. An empty table
yields an empty table. A worker holds one Arrow batch and, while it encodes,
parts of a text of about ``LONG_TEXT`` characters; a single run of letters, of digits or of other
signs is one pre-token, which no encoder can cut.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolegrid.llm.common import map_rows, values

# Pieces handed to the library at once; sizes from which a piece and a text are cut further.
SLICE = 1024
LONG_PIECE = 4096
LONG_TEXT = 1 << 20
# Pieces a worker remembers before it starts afresh.
MEMO_PIECES = 500_000

# White space as the splitting pattern knows it.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PIECES = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_CHAINED = re.compile(f"[{_SPACE}].*[^{_SPACE}]\\Z", re.DOTALL)
_BORDER = re.compile(f"[^{_SPACE}](?=[{_SPACE}])")
# A letter before a sign or digit and a digit before another sign always end a pre-token.
_SIGNS = "\\u3001\\u3002\\uff01\\uff0c\\uff1a\\uff1b\\uff1f"
_INNER = re.compile(
    f"(?<=[A-Za-z\\u3041-\\u3096\\u30a1-\\u30fa\\u4e00-\\u9fa5\\uac00-\\ud7a3])(?=[\\x00-@\\[-`{{-\\x7f{_SIGNS}])"
    f"|(?<=[0-9])(?=[\\x00-/:-\\x7f{_SIGNS}])")


def byte_chars() -> list[str]:
    """The printable character that spells each byte: itself, or one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


BYTE_CHARS = byte_chars()


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def last_pair(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts left of ``token`` before its last merge; None if its bytes end up in more."""
    parts = [token[i:i + 1] for i in range(len(token))]
    while len(parts) > 2:
        rank, at = min((ranks.get(a + b, len(ranks) + 256), i)
                       for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank >= len(ranks) + 256:
            return None
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str):
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks = read_ranks(path)
    spell = lambda token: "".join(map(BYTE_CHARS.__getitem__, token))
    pairs = [last_pair(t, ranks) for t in sorted(ranks, key=ranks.get) if len(t) > 1]
    made = Tokenizer(models.BPE({spell(t): r for t, r in ranks.items()},
                                [(spell(p[0]), spell(p[1])) for p in pairs if p], ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), "isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return made


@lru_cache(maxsize=2)
def token_bytes(path: str, pattern: str) -> list[bytes]:
    """The bytes of every id, by the byte table reversed; ids without a token are empty."""
    back = {c: b for b, c in enumerate(BYTE_CHARS)}
    vocab = tokenizer(path, pattern).get_vocab()
    table = [b""] * (max(vocab.values(), default=-1) + 1)
    for spelled, i in vocab.items():
        table[i] = bytes(map(back.__getitem__, spelled))
    return table


class Encoder:
    """Ids of texts; the pieces met before are remembered."""

    def __init__(self, path: str, pattern: str):
        self._batch = tokenizer(path, pattern).encode_batch_fast
        self._lengths = np.array([len(t) for t in token_bytes(path, pattern)])
        self._known: dict[str, bytes] = {}  # little-endian ids

    def _learn(self, pieces: Iterable[str]) -> None:
        """Encode new pieces: those with white space before and none after in one string.

        Behind each other they are cut where they begin, so the ids of the string
        fall apart into those of the pieces.
        """
        new = set(pieces).difference(self._known)
        row = [p for p in new if _CHAINED.match(p)]
        for piece in new.difference(row):
            self._known[piece] = self._encode([piece])
        for at in range(0, len(row), SLICE):
            part = row[at:at + SLICE]
            ids = self._encode(part)
            ends = 4 * np.searchsorted(np.cumsum(self._lengths[np.frombuffer(ids, "<i4")]),
                                       np.cumsum([len(p.encode()) for p in part]), side="left") + 4
            self._known.update(zip(part, map(ids.__getitem__, map(slice, [0, *ends], ends)), strict=True))

    def _encode(self, pieces: list[str]) -> bytes:
        return np.array(self._batch(["".join(pieces)], add_special_tokens=False)[0].ids, "<i4").tobytes()

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; the new pieces of all are learnt together."""
        cut = [[self._pieces(part) for part in ([t] if len(t) < LONG_TEXT else _parts(t))] for t in texts]
        self._learn(chain.from_iterable(chain.from_iterable(cut)))
        found = [np.frombuffer(b"".join(map(self._known.__getitem__, chain.from_iterable(parts))), "<i4") for parts in cut]
        if len(self._known) > MEMO_PIECES:
            self._known.clear()
        return found

    @staticmethod
    def _pieces(part: str) -> list[str]:
        pieces = _PIECES.findall(part)
        if len(part) >= LONG_PIECE and max(map(len, pieces)) >= LONG_PIECE:
            return [p for piece in pieces for p in _INNER.split(piece)]
        return pieces


def _parts(text: str) -> Iterator[str]:
    """A long text in parts, cut where a piece begins if one does in reach."""
    start = 0
    while start < len(text):
        border = _BORDER.search(text, min(start + LONG_TEXT, len(text)))
        end = border.start() + 1 if border else len(text)
        yield text[start:end]
        start = end


def places(text: str, ids: np.ndarray, table: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The code point each token starts in and the bytes of it that lie before the token."""
    raw = np.frombuffer(text.encode(), np.uint8)
    lengths = np.fromiter(map(len, map(table.__getitem__, ids.tolist())), np.int64, len(ids))
    at = np.cumsum(lengths) - lengths
    first = (raw & 0xC0) != 0x80  # the bytes that begin a code point
    char = np.cumsum(first)[at] - 1 if len(ids) else at
    return char.astype(np.int32), (at - np.flatnonzero(first)[char] if len(ids) else at).astype(np.int32)


def _lists(parts: Iterable[np.ndarray]) -> pa.ListArray:
    parts = list(parts)
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts), pa.int32()))


def encode(docs: DataFrame, path: str, pattern: str, keep_places: bool = True) -> DataFrame:
    """``doc_id, ids`` and, with ``keep_places``, ``chars, inner`` of ``docs(doc_id, text)``.

    ``chars[i]`` is the code point in which token ``i`` starts, ``inner[i]`` the
    number of its bytes that belong to earlier tokens (0: the token starts it).
    """
    def run(it):
        encoder, table = Encoder(path, pattern), token_bytes(path, pattern)
        for batch in it:
            keys, texts = batch.column(0), batch.column(1)
            sizes = np.cumsum(pc.utf8_length(texts).fill_null(0).to_numpy())
            start = 0
            while start < batch.num_rows:  # as many texts as fit, at least one
                stop = max(start + 1, int(np.searchsorted(sizes, LONG_TEXT + (sizes[start - 1] if start else 0))))
                some = [t or "" for t in texts[start:stop].to_pylist()]
                ids = encoder.ids(some)
                columns = [ids]
                if keep_places:
                    columns += zip(*[places(t, i, table) for t, i in zip(some, ids, strict=True)], strict=True)
                yield pa.RecordBatch.from_arrays([keys[start:stop], *map(_lists, columns)], names=names)
                start = stop

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = ["doc_id", "ids", *(["chars", "inner"] if keep_places else [])]
    return map_rows(docs, run, "doc_id long, " + ", ".join(f"{n} array<int>" for n in names[1:]))


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids, bytes`` of ``tokens(doc_id, ids)``: the bytes that the ids stand for.

    Ids outside the vocabulary and null ids stand for nothing. The bytes need not
    be whole characters when the ids are a part of a text's.
    """
    def run(it):
        table = [*token_bytes(path, pattern)]
        # an id outside the vocabulary is read from the empty end of the table
        table.append(b"")
        for batch in it:
            column = batch.column(1)
            ids = column.flatten().fill_null(-1).to_numpy()
            ids = np.where((ids < 0) | (ids >= len(table)), len(table) - 1, ids).tolist()
            ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy()).tolist()
            out = [b"".join(map(table.__getitem__, ids[a:b])) for a, b in zip([0, *ends], ends, strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=["doc_id", "ids", "bytes"])

    return map_rows(tokens.select("doc_id", F.col("ids").cast("array<int>").alias("ids")), run,
                    "doc_id long, ids array<int>, bytes binary")


def decode_windows(tokens: DataFrame, path: str, pattern: str, window: int = 1024) -> DataFrame:
    """``doc_id, window, ids, text``: one row per ``window`` ids of each row of ``tokens``.

    A character whose bytes are split over windows is given whole to the window
    in which it starts, so a later window may begin behind it. Bytes that are no
    character in the whole sequence either become U+FFFD.
    """
    def run(it):
        table = token_bytes(path, pattern)
        for batch in it:
            for key, ids in zip(values(batch, "doc_id"), values(batch, "ids"), strict=True):
                ids = [i for i in ids or () if i is not None and 0 <= i < len(table)]
                cuts = [ids[at:at + window] for at in range(0, len(ids), window)]
                raw = [b"".join(map(table.__getitem__, cut)) for cut in cuts]
                whole = b"".join(raw)
                end, start, texts = 0, 0, []
                for part in raw:
                    end += len(part)
                    stop = max(end, start)
                    while stop < len(whole) and whole[stop] & 0xC0 == 0x80:
                        stop += 1
                    texts.append(whole[start:stop].decode("utf-8", "replace"))
                    start = stop
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": pa.array([key] * len(cuts), pa.int64()), "window": pa.array(range(len(cuts)), pa.int64()),
                     "ids": pa.array(cuts, pa.list_(pa.int32())), "text": pa.array(texts, pa.string())})

    return map_rows(tokens.select("doc_id", F.col("ids").cast("array<int>").alias("ids")), run,
                    "doc_id long, window long, ids array<int>, text string")
