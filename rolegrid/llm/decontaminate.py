"""Benchmark decontamination with one Aho-Corasick automaton over word ids.

Texts and items are normalised alike: A-Z to lower case, every other ASCII
character that is no letter or digit to a blank. An item's patterns are its
runs of ``window`` words (the whole item if it is shorter). The automaton's
letters are word ids of the benchmark's vocabulary, so one pass over a text's
words finds all patterns; byte positions survive normalisation, which maps
hits back to the original text.

The benchmark is collected for the automaton in blocks of at most
``block_bytes`` text; a benchmark above that bound is scanned block by block
and the hits of a document are merged.

Null texts have no words and no hits; null or empty items have no pattern;
an item without id is spelled as the empty string; repeated rows stay.
"""

from __future__ import annotations

import re
import uuid
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolegrid.llm.common import map_rows, raw_texts, values

WINDOW = 13
SHARE = 20  # contaminated: one word in SHARE or more is hit
BLOCK_BYTES = 32 << 20

_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
                for c in range(256))
_WORD = re.compile(rb"[^ ]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


class Patterns:
    """Automaton over the windows of benchmark items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        import ahocorasick

        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text))
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(ids[i:i + window], set()).add(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for ids, names in found.items():
            self.automaton.add_word(ids, (len(ids), names))
        if found:
            self.automaton.make_automaton()
        self.empty = not found

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word intervals of all hits, and the items they come from."""
        spans, items = [], set()
        if words and not self.empty:
            for end, (size, names) in self.automaton.iter(tuple(map(self.vocabulary.get, words, repeat(0)))):
                spans.append((end - size + 1, end + 1))
                items |= names
        return spans, items


_BUILT: dict = {}


def _patterns(shared, window: int) -> Patterns:
    """The automaton of a broadcast block, built once in a worker."""
    key = (shared.value["key"], window)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Patterns(shared.value["items"], window)
    return _BUILT[key]


def merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(s) for s in out]


def _in_text(raw: bytes, spans) -> list[tuple[int, int]]:
    """Word intervals as code point offsets of the original text."""
    at = [m.span() for m in _WORD.finditer(raw.translate(_NORMAL))]
    chars = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)  # code points up to a byte
    return [(int(chars[at[a][0]]) - 1, int(chars[at[b - 1][1] - 1])) for a, b in spans]


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[list[tuple[str, bytes]]]:
    """Benchmark items, collected block by block; each block's size is bounded."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
                             F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + F.octet_length("item") + 64)).first()[0] or 0
    n = -(-2 * total // block_bytes) if total > block_bytes else 1
    block = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    return [[(r["item"], r["text"].encode()) for r in items.where(block == i).collect()] for i in range(n)]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
         block_bytes: int = BLOCK_BYTES, keep_key: bool = False) -> DataFrame:
    """``doc_id, n_words, n_hit, item_ids, spans`` per row of ``docs(doc_id, text)``.

    ``item_ids`` are sorted strings; ``spans`` are code point ranges of the
    original text. ``keep_key`` adds ``key``, the ``xxhash64`` of the text.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key"))
    shared = [spark.sparkContext.broadcast({"key": uuid.uuid4().hex, "items": b})
              for b in item_blocks(benchmark, block_bytes)]

    def scanner(block, every):
        def run(it):
            patterns = _patterns(block, window)
            for batch in it:
                out = {k: [] for k in ("doc_id", "key", "n_words", "n_hit", "item_ids", "spans")}
                for doc_id, raw, key in zip(values(batch, "doc_id"), raw_texts(batch), values(batch, "key"), strict=True):
                    words = words_of(raw or b"")
                    spans, items = patterns.scan(words)
                    if not (spans or every):
                        continue
                    spans = merged(spans)
                    out["doc_id"].append(doc_id)
                    out["key"].append(key)
                    out["n_words"].append(len(words))
                    out["n_hit"].append(sum(b - a for a, b in spans))
                    out["item_ids"].append(sorted(items))
                    out["spans"].append([dict(start=a, end=b) for a, b in
                                         (_in_text(raw, spans) if spans else [])])
                yield pa.RecordBatch.from_pydict(
                    {k: pa.array(v, _SPANS if k == "spans" else pa.list_(pa.string()) if k == "item_ids"
                                 else pa.int64()) for k, v in out.items()})
        return run

    schema = ("doc_id long, key long, n_words long, n_hit long, item_ids array<string>, "
              "spans array<struct<start:long,end:long>>")
    parts = [map_rows(docs, scanner(b, i == 0), schema) for i, b in enumerate(shared)]
    found = parts[0] if len(parts) == 1 else _merge_blocks(docs, parts, schema)
    return found if keep_key else found.drop("key")


def _merge_blocks(docs: DataFrame, parts: list[DataFrame], schema: str) -> DataFrame:
    """Hits of all blocks per document; rows stay as often as they occur."""
    rows = parts[0].withColumn("rows", F.lit(1))
    for part in parts[1:]:
        rows = rows.unionByName(part.withColumn("rows", F.lit(0)))
    joined = rows.groupBy("doc_id", "key").agg(
        F.max("n_words").alias("n_words"), F.sum("rows").alias("rows"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
        F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))

    def unite(it):
        for batch in it:
            spans = [[dict(start=a, end=b) for a, b in merged((s["start"], s["end"]) for s in row)]
                     for row in values(batch, "spans")]
            hits = []
            for raw, row in zip(raw_texts(batch), spans, strict=True):
                text = (raw or b"").decode()
                hits.append(sum(len(words_of(text[s["start"]:s["end"]].encode())) for s in row))
            cols = {name: batch.column(batch.schema.get_field_index(name))
                    for name in ("doc_id", "key", "n_words", "item_ids")}
            yield pa.RecordBatch.from_pydict({**cols, "n_hit": pa.array(hits, pa.int64()),
                                              "spans": pa.array(spans, _SPANS)}).select(
                ["doc_id", "key", "n_words", "n_hit", "item_ids", "spans"])

    texts = docs.select(F.col("doc_id").alias("text_id"), F.col("key").alias("text_key"), "text").dropDuplicates(
        ["text_key", "text_id"])
    once = joined.join(texts, (F.col("key") == F.col("text_key")) & F.col("doc_id").eqNullSafe(F.col("text_id")))
    once = once.select("doc_id", "key", "n_words", "item_ids", "spans", "text",
                       F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("copy"))
    return map_rows(once, unite, schema)


def verdicts(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE,
             block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """:func:`scan` with ``contaminated``: hit words make one word in ``share`` or more."""
    return scan(docs, benchmark, window, block_bytes).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE,
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the contaminated rows; all columns pass through.

    The verdicts of a benchmark of several blocks are joined back by id and
    text hash.
    """
    blocks = item_blocks(benchmark, block_bytes)
    if len(blocks) > 1:
        bad = (scan(docs, benchmark, window, block_bytes, keep_key=True)
               .where((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))
               .select(F.col("doc_id").alias("bad_id"), F.col("key").alias("bad_key")).distinct())
        same = (F.xxhash64("text") == F.col("bad_key")) & F.col("doc_id").cast("long").eqNullSafe(F.col("bad_id"))
        return docs.join(bad, same, "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast({"key": uuid.uuid4().hex, "items": blocks[0]})

    def run(it):
        patterns = _patterns(shared, window)
        for batch in it:
            keep = []
            for raw in raw_texts(batch):
                words = words_of(raw or b"")
                hit = sum(b - a for a, b in merged(patterns.scan(words)[0]))
                keep.append(not (hit and hit * share >= len(words)))
            yield batch.filter(pa.array(keep))

    return map_rows(docs, run, docs.schema)
