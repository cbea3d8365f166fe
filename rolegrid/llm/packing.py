"""Packing documents into fixed token windows by best fit, decreasing.

A document is its token ids and one end id (0). It is cut into full windows of
``capacity`` ids and a rest. Rests are dealt evenly to bins of bounded size;
inside a bin they are placed longest first, each into the open window with the
least remaining room that still holds it. Open windows hang on a segment tree
over the remaining room, so a placement takes O(log capacity) steps.

Only piece records (a few numbers) are shuffled, never ids. Every piece keeps
its place in the document; ids themselves come with ``keep_ids=True``.

A null text is the empty text and yields the end id alone; repeated rows are
packed as often as they occur; an empty table yields no piece.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolegrid.llm.common import MEMO_WORDS, map_rows, values, write_once

CAPACITY = 1024
BIN_PIECES = 200_000
END = np.zeros(1, "<u4").tobytes()

_ODD_SPACE = re.compile(r" (?:\s|\Z)|\A ")
_BEFORE_WORD = re.compile(r" (?=\S)")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


@lru_cache(maxsize=2)
def _merger(path: str):
    """A faster encoder made from the vocabulary of ``path``; same ids.

    The vocabulary file spells bytes as printable characters; ids after the
    256 bytes are in merge order, which is what the encoder needs.
    """
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelled = {chr(b): b for b in printable}
    spelled |= {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(printable)))}
    specials = {t.content for t in _tokenizer(path).get_added_tokens_decoder().values()}
    ranks = {bytes(spelled[c] for c in token): i for token, i in vocab.items() if token not in specials}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


# Fixed value: how byte-level BPE of this vocabulary cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder(dict):
    """Little-endian ids of text pieces, remembered by piece.

    A blank before a visible character always starts a pre-token, so a text may
    be cut there and the ids of the pieces concatenated.
    """

    def __init__(self, path: str):
        super().__init__()
        self._encode = _merger(path).encode_ordinary

    def __missing__(self, piece: str) -> bytes:
        word, mark = piece[:-1], piece[-1:]
        if mark in ",." and word[1:].isalpha() and (word[0] == " " or word[0].isalpha()):
            ids = self[word] + self[mark]  # letters end before the mark
        else:
            ids = np.array(self._encode(piece), "<u4").tobytes()
        self[piece] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        pieces = _BEFORE_WORD.split(text) if _ODD_SPACE.search(text) else text.split(" ")
        head = self[pieces[0]] if pieces[0] else b""
        return head + b"".join([self[" " + p] for p in pieces[1:]])

    def trim(self) -> None:
        if len(self) > MEMO_WORDS:
            self.clear()


class OpenWindows:
    """Open windows by remaining room; a segment tree finds the tightest fit."""

    def __init__(self, capacity: int):
        self.leaves = 1
        while self.leaves <= capacity:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)
        self.windows = [[] for _ in range(capacity + 1)]

    def add(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        node = room + self.leaves
        while node:
            self.count[node] += 1
            node //= 2

    def take(self, length: int) -> tuple[int, int] | None:
        """The window with the least room of at least ``length``, or None."""
        node = length + self.leaves
        if not self.count[node]:
            # climb to the first right-hand neighbour that has a window, then descend to its left
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node //= 2
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        while node:
            self.count[node] -= 1
            node //= 2
        return room, self.windows[room].pop()


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each piece, placed longest first."""
    window = np.zeros(len(lengths), np.int64)
    offset = np.zeros(len(lengths), np.int64)
    free, made = OpenWindows(capacity), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        found = free.take(length)
        if found is None:
            found, made = (capacity, made), made + 1
        room, window[i] = found
        offset[i] = capacity - room
        if room > length:
            free.add(room - length, int(window[i]))
    return window, offset


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY,
           keep_ids: bool = False) -> DataFrame:
    """Full windows and rests of each document, with a checksum of their ids."""

    def cut(it):
        encoder = Encoder(tokenizer_path)
        step = 4 * capacity
        for batch in it:
            out = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")}
            for doc_id, text in zip(values(batch, "doc_id"), values(batch, "text"), strict=True):
                ids = encoder.ids(text or "") + END
                for at in range(0, len(ids), step):
                    piece = ids[at:at + step]
                    out["doc_id"].append(doc_id)
                    out["start"].append(at // 4)
                    out["length"].append(len(piece) // 4)
                    out["ids_crc32"].append(zlib.crc32(piece))
                    out["doc_tokens"].append(len(ids) // 4)
                    out["ids"].append(piece)
            encoder.trim()
            if not keep_ids:
                del out["ids"]
            yield pa.RecordBatch.from_pydict(
                {k: pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in out.items()})

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), cut,
                    schema + (", ids binary" if keep_ids else ""))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY,
         keep_ids: bool = False, bin_pieces: int = BIN_PIECES) -> DataFrame:
    """Every piece of ``docs(doc_id, text)`` with its ``sequence_id`` and ``offset``."""
    cut = write_once(pieces(docs, tokenizer_path, capacity, keep_ids), "pieces")
    bins = max(1, -(-cut.count() // bin_pieces))
    # rows are dealt in turn, so no key decides the size of a bin
    cut = cut.withColumn("piece", F.monotonically_increasing_id())
    place = cut.select("piece", "length", F.pmod("piece", F.lit(bins)).alias("bin"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("piece", ignore_index=True)
        window, offset = best_fit(pdf["length"].to_numpy(), capacity)
        return pd.DataFrame({"piece": pdf["piece"], "sequence_id": pdf["bin"] + window * bins,
                             "offset": offset})

    placed = place.groupBy("bin").applyInPandas(fit, "piece long, sequence_id long, offset long")
    return cut.join(placed, "piece").drop("piece")
