"""Removal of word runs that already stand in an earlier document.

Every window of ``window`` words gets a Rabin-Karp hash (a polynomial over
64-bit word hashes modulo 2**64, rolled over the text as prefix sums). Windows
are counted in Spark; where a window also starts in a document with a smaller
``doc_id`` its words go, and overlapping windows merge into maximal intervals.

Counting all windows would shuffle a row per word. Equal windows have equal
minimizers (the smallest hash of the ten-word runs inside), so a window whose
minimizer occurs in one document only cannot repeat. Minimizers are counted
first, about one for twenty windows; only windows whose minimizer stands in
several documents are counted themselves. Nothing else is left out. Documents
with the same word sequence are settled by their checksum before that.

Defined results: null and empty texts have no words; texts shorter than a
window keep all words; rows without ``doc_id`` are neither removed from nor
removed by; rows with the same ``doc_id`` never remove from each other, and
repeated rows all stay in the result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolegrid.llm.common import WordHashes, map_rows, mix, only_ids, raw_texts, values, write_once

WINDOW = 50
GRAM = 10

_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1024, 2 * n)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(steps)
    return have[:n]


def rolling(words: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of every run of ``width`` word hashes."""
    n = len(words)
    if n < width:
        return np.zeros(0, np.uint64)
    inverse = pow(_BASE, -1, 2 ** 64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * _powers(inverse, n), out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * _powers(_BASE, n - width + 1))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, by doubling."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def minimizers(words: np.ndarray, window: int) -> np.ndarray:
    """The minimizer of every window."""
    gram = min(GRAM, window)
    grams = rolling(words, gram)
    return sliding_min(grams, window - gram + 1) if len(words) >= window else grams[:0]


def _words(raw: bytes | None) -> list[bytes]:
    return (raw or b"").split()


def _profile(docs: DataFrame, window: int) -> DataFrame:
    def profile(it):
        memo = WordHashes()
        for batch in it:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            sizes, digests, found = [], [], []
            for raw, known in zip(raw_texts(batch), ids.is_valid().to_pylist(), strict=True):
                words = _words(raw)
                sizes.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).digest())
                found.append(np.unique(minimizers(memo.of(words), window)).view(np.int64)
                             if known and len(words) >= window else None)
            memo.trim()
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(found, pa.list_(pa.int64()))], ["doc_id", "n_words", "digest", "minimizers"])

    return map_rows(docs, profile, "doc_id long, n_words long, digest binary, minimizers array<long>")


def _windows(docs: DataFrame, hot: DataFrame, window: int) -> DataFrame:
    """Hashes and places of the windows whose minimizer is in ``hot`` (doc_id, hot)."""

    def emit(it):
        memo = WordHashes()
        for batch in it:
            for doc_id, raw, keys in zip(values(batch, "doc_id"), raw_texts(batch),
                                         values(batch, "hot"), strict=True):
                words = _words(raw)
                if len(words) < window:
                    continue
                hashes = memo.of(words)
                least = minimizers(hashes, window).view(np.int64)
                at = np.flatnonzero(np.isin(least, np.array(keys, np.int64)))
                digest = hashlib.sha256(b" ".join(words)).digest()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rolling(hashes, window)[at].view(np.int64)), pa.array(least[at]),
                     pa.array(np.full(len(at), doc_id, np.int64)),
                     pa.array([digest], pa.binary()).take(pa.array(np.zeros(len(at), np.int64))),
                     pa.array(at.astype(np.int32))], ["w", "m", "doc_id", "digest", "pos"])
            memo.trim()

    return map_rows(docs.join(hot, "doc_id"), emit,
                    "w long, m long, doc_id long, digest binary, pos int")


def removals(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, digest, whole, places`` per row of ``docs(doc_id, text)``.

    ``digest`` is the sha256 of the words joined by one blank. ``whole``: an
    earlier document has the same words, so all go. ``places``: sorted starts
    of the windows to remove, null if there are none.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = write_once(_profile(docs, window), "profiles")
    long = rows.where(F.col("minimizers").isNotNull())
    first = long.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    own = long.join(first, "digest").where(F.col("doc_id") == F.col("first_id"))

    seen = own.select("doc_id", F.explode("minimizers").alias("m"))
    several = (seen.groupBy("m").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
               .where("lo < hi").select("m"))
    hot = write_once(seen.join(several, "m").groupBy("doc_id").agg(F.collect_set("m").alias("hot")), "hot")
    found = write_once(_windows(only_ids(docs, hot.select("doc_id")), hot, window), "windows")
    lowest = (found.groupBy("w", "m").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
              .where("lo < hi").select("w", "m", "lo"))
    places = (found.join(lowest, ["w", "m"]).where(F.col("doc_id") > F.col("lo"))
              .groupBy("doc_id", "digest").agg(F.sort_array(F.collect_set("pos")).alias("places")))
    out = rows.select("doc_id", "n_words", "digest").join(first, "digest", "left").join(
        places, ["doc_id", "digest"], "left")
    return out.select("doc_id", "n_words", "digest", "places",
                      F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)).alias("whole"))


def removed_words(places: list[int], window: int) -> list[tuple[int, int]]:
    """Maximal intervals of words covered by windows at sorted ``places``."""
    out: list[list[int]] = []
    for at in places:
        if out and at <= out[-1][1]:
            out[-1][1] = at + window
        else:
            out.append([at, at + window])
    return [tuple(x) for x in out]


def kept_texts(docs: DataFrame, found: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, digest, n_removed, kept`` of the documents that lose single windows."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cut = write_once(found.where(F.col("places").isNotNull() & ~F.col("whole"))
                     .select("doc_id", "digest", "places").dropDuplicates(["doc_id", "digest"]), "cuts")

    def keep(it):
        for batch in it:
            out = {"doc_id": [], "digest": [], "n_removed": [], "kept": []}
            for doc_id, raw, digest, places in zip(values(batch, "doc_id"), raw_texts(batch),
                                                   values(batch, "digest"), values(batch, "places"),
                                                   strict=True):
                words = _words(raw)
                if hashlib.sha256(b" ".join(words)).digest() != digest:
                    continue  # another text under the same id
                kept, at = [], 0
                for start, end in removed_words(places, window):
                    kept += words[at:start]
                    at = end
                kept += words[at:]
                out["doc_id"].append(doc_id)
                out["digest"].append(digest)
                out["n_removed"].append(len(words) - len(kept))
                out["kept"].append(b" ".join(kept))
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["doc_id"], pa.int64()), pa.array(out["digest"], pa.binary()),
                 pa.array(out["n_removed"], pa.int64()), pa.array(out["kept"], pa.binary()).cast(pa.string())],
                list(out))

    texts = only_ids(docs, cut.select("doc_id").distinct())
    return map_rows(texts.join(cut, "doc_id"), keep,
                    "doc_id long, digest binary, n_removed long, kept string").dropDuplicates(
                        ["doc_id", "digest"])


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` per row."""
    found = write_once(removals(docs, window), "removals")
    cut = (kept_texts(docs, found, window)
           .select("doc_id", "digest", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("sha")))
    empty = hashlib.sha256(b"").hexdigest()
    return (found.select("doc_id", "n_words", "digest", "whole").join(cut, ["doc_id", "digest"], "left")
            .select("doc_id", "n_words",
                    F.when(F.col("whole"), F.col("n_words"))
                    .otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
                    F.when(F.col("whole"), F.lit(empty))
                    .otherwise(F.coalesce("sha", F.lower(F.hex("digest")))).alias("kept_sha256")))
