"""Near-duplicate classes by HyperMinHash registers, banding and exact tests.

A text's shingles are hashed to 64 bits. The hash range is cut into
``BUCKETS`` equal buckets; a register keeps the smallest hash of its bucket as
a leading-zero count (6 bits) and a mantissa (10 bits). An empty bucket
borrows the register of the filled bucket that comes first in a fixed random
order of its own, so that two sets agree in a register with a probability
equal to their similarity also when they are small.

Runs of ``BAND_ROWS`` compressed registers are the bucket keys of the search.
Two sets with similarity 0.8 share none of the 32 bands with a probability of
3e-6. Every pair that meets in a band is either already in one component or
is tested: first by the similarity estimated from the registers, corrected for
chance collisions and given ``ROOM`` standard deviations of room, then on the
full sets. Pairs inside a group of copies are not enumerated: members of a band
bucket are compared with a hub, the member with the fewest shingles of its own
(the text that the others were made from, if it is there), then those apart
from it with a second hub. What is still in different components meets on the
rarest shingles of each set (prefix and position filter, which lose no pair).

Results: identical sets share a class; a text without a word has no set and
no link; a row without ``doc_id`` is linked with nothing and kept; repeated
rows all stay in the result of :func:`near_duplicates` with the same values.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolegrid.llm.common import (
    WordHashes, gram_hashes, map_rows, only_ids, raw_texts, values, write_once,
)
from rolegrid.operators.components import connected_components

BUCKETS, BANDS, BAND_ROWS = 160, 32, 5
MANTISSA_BITS = 10
# Chance that two different minima share zero count and mantissa:
# sum over counts of 4**-count, over 2**MANTISSA_BITS mantissas.
COLLISION = 1 / 3 / 2 ** MANTISSA_BITS
HUB_ROUNDS = 2
ROOM = 4.5

_EDGES = np.array([math.ceil(i * 2 ** 64 / BUCKETS) for i in range(BUCKETS)], np.uint64)
_SPAN = 2 ** 64 / BUCKETS
# Row i: order in which an empty bucket i looks for a lender.
_LENDERS = np.argsort(np.random.RandomState(20).rand(BUCKETS, BUCKETS), axis=1).argsort(axis=1)


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes; a shorter text is one shingle."""
    return np.unique(gram_hashes(words, min(size, len(words)))) if len(words) else words


def registers(shingles: np.ndarray) -> np.ndarray:
    """Compressed registers of a sorted, non-empty shingle set."""
    at = np.searchsorted(shingles, _EDGES)
    low = shingles[np.minimum(at, len(shingles) - 1)]
    filled = (at < len(shingles)) & (np.append(at[1:], len(shingles)) > at)
    # position of the minimum inside its bucket, as a fraction of the bucket
    part = np.where(filled, (low - _EDGES).astype(np.float64) / _SPAN, 0.5)
    mantissa, exponent = np.frexp(np.maximum(part, 2.0 ** -63))
    value = (-exponent).clip(0, 63) << MANTISSA_BITS
    value |= ((mantissa * 2 - 1) * 2 ** MANTISSA_BITS).astype(np.int64)
    lenders = np.flatnonzero(filled)
    if len(lenders) < BUCKETS:
        lent = lenders[_LENDERS[:, lenders].argmin(axis=1)]
        lent[lenders] = lenders
        value = value[lent]
    return value.astype(np.uint16).view(np.int16)


def _smallest(percent: int) -> int | None:
    """Size from which two different sets can be similar enough."""
    return None if percent >= 100 else -(-percent // (100 - percent))


def signatures(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``doc_id, n_shingles, cls, registers`` per row; cls names the set."""
    least = _smallest(percent)

    def sign(it):
        memo = WordHashes()
        for batch in it:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            sizes, classes, regs = [], [], []
            for text, known in zip(raw_texts(batch), ids.is_valid().to_pylist(), strict=True):
                s = shingle_set(memo.of((text or b"").lower().split()), shingle)
                sizes.append(len(s))
                classes.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) and known else None)
                regs.append(registers(s) if known and least and len(s) >= least else None)
            memo.trim()
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()),
                 pa.array(regs, pa.list_(pa.int16()))], ["doc_id", "n_shingles", "cls", "registers"])

    return map_rows(docs.select("doc_id", "text"), sign,
                    "doc_id long, n_shingles long, cls binary, registers array<short>")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    def sets(it):
        memo = WordHashes()
        for batch in it:
            classes, arrays = [], []
            for text in raw_texts(batch):
                s = shingle_set(memo.of((text or b"").lower().split()), shingle)
                classes.append(xxhash.xxh3_128_digest(s.tobytes()))
                arrays.append(s.view(np.int64))
            memo.trim()
            yield pa.RecordBatch.from_arrays(
                [pa.array(classes, pa.binary()), pa.array(arrays, pa.list_(pa.int64()))],
                ["cls", "shingles"])

    return map_rows(docs.select("text"), sets, "cls binary, shingles array<long>")


def _fits(left, right, percent: int):
    """Sizes of two sets that can reach the threshold."""
    return F.least(left, right) * 100 >= F.greatest(left, right) * percent


def _promising(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs whose estimated similarity does not rule the threshold out."""
    side = lambda c: reps.select(F.col("cls").alias(c), F.col("registers").alias(f"r{c}"),
                                 F.col("n_shingles").alias(f"n{c}"))
    same = F.aggregate(F.zip_with("ra", "rb", lambda x, y: (x == y).cast("int")), F.lit(0),
                       lambda total, x: total + x)
    estimate = (same / BUCKETS - COLLISION) / (1 - COLLISION)
    t = percent / 100
    room = ROOM * F.sqrt(F.lit(t * (1 - t)) / F.least("na", "nb", F.lit(BUCKETS)))
    return (pairs.join(side("a"), "a").join(side("b"), "b")
            .where(estimate >= t - room).select("a", "b"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the threshold."""
    side = lambda c: sets.select(F.col("cls").alias(c), F.col("shingles").alias(f"s{c}"))
    common = F.size(F.array_intersect("sa", "sb"))
    return (pairs.join(side("a"), "a").join(side("b"), "b")
            .withColumn("common", common)
            .where(F.col("common") * 100 >= (F.size("sa") + F.size("sb") - F.col("common")) * percent)
            .select("a", "b"))


def _ranked(sets: DataFrame, percent: int) -> DataFrame:
    """``cls, n, own, prefix``: size, shingles no other set has, rarest shingles first.

    The prefix is long enough to hold a shingle of every partner that reaches
    the threshold; rarity is counted over ``sets``.
    """
    each = sets.select("cls", F.explode("shingles").alias("shingle"))
    common = write_once(each.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1"), "frequent")
    ranked = (each.join(common, "shingle", "left").groupBy("cls")
              .agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "shingle"))).alias("all")))
    n = F.size("all")
    return write_once(ranked.select(
        "cls", n.cast("long").alias("n"),
        F.size(F.filter("all", lambda s: s["df"] == 1)).cast("long").alias("own"),
        F.slice("all.shingle", F.lit(1), n - F.ceil(n * percent / 100).cast("int") + 1).alias("prefix")), "ranked")


def _meeting(open_classes: DataFrame, ranked: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that the prefix and position filters allow."""
    side = lambda c: (ranked.join(open_classes, "cls")
                      .select(F.posexplode("prefix").alias(f"p{c}", "shingle"), F.col("cls").alias(c),
                              F.col("n").alias(f"n{c}"), F.col("root").alias(f"root_{c}")))
    rest = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    return (side("a").join(side("b"), "shingle")
            .where((F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")))
            .where(rest * (100 + percent) >= (F.col("na") + F.col("nb")) * percent)
            .select("a", "b"))


def class_components(docs: DataFrame, signed: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``cls, root`` of every class that is linked with another class."""
    reps = write_once(signed.where(F.col("registers").isNotNull())
                      .dropDuplicates(["cls"]).select("cls", "n_shingles", "registers"), "reps")
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(
        i, F.slice("registers", i * BAND_ROWS + 1, BAND_ROWS)))
    rows = reps.select(F.explode(keys).alias("key"), "cls")
    shared = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key")
    rows = write_once(rows.join(shared, "key"), "bands")

    wanted = rows.select("cls").distinct()
    holders = write_once(signed.join(wanted, "cls", "left_semi")
                         .groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
                         .select("doc_id").distinct(), "holders")
    sets = write_once(_sets(only_ids(docs, holders), shingle).join(wanted, "cls", "left_semi")
                      .dropDuplicates(["cls"]), "sets")
    ranked = _ranked(sets, percent)
    rows = write_once(rows.join(ranked.select("cls", "n", "own"), "cls"), "members")

    def links(pairs):
        return write_once(_verified(_promising(pairs.distinct(), reps, percent), sets, percent), "links")

    def settle(edges):
        return write_once(connected_components(edges, "a", "b")
                          .select(F.col("node").alias("cls"), F.col("component").alias("root")), "roots")

    def star(members):
        """Each member of a bucket with the bucket's hub."""
        hubs = members.groupBy("key").agg(F.min(F.struct("own", "cls", "n")).alias("hub"))
        return (members.join(hubs, "key").where(F.col("cls") != F.col("hub.cls"))
                .where(_fits(F.col("n"), F.col("hub.n"), percent))
                .select(F.least("hub.cls", "cls").alias("a"), F.greatest("hub.cls", "cls").alias("b")))

    edges = links(star(rows))
    roots = settle(edges)
    for last in [False] * (HUB_ROUNDS - 1) + [True]:
        labelled = (rows.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls")))
        sizes = (labelled.groupBy("key", "root").agg(F.count("*").alias("size"))
                 .groupBy("key").agg(F.max(F.struct("size", "root")).alias("most"), F.count("*").alias("roots"))
                 .where("roots > 1").select("key", F.col("most.root").alias("most")))
        apart = labelled.join(sizes, "key")
        if last:
            found = _meeting(write_once(apart.select("cls", "root").distinct(), "open"), ranked, percent)
        else:
            found = star(apart.where(F.col("root") != F.col("most")))
        edges = edges.unionByName(links(found))
        roots = settle(edges)
    return roots


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row of ``docs(doc_id, text)``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = write_once(signatures(docs, shingle, percent), "signatures")
    first = signed.where(F.col("cls").isNotNull()).groupBy("cls").agg(F.min("doc_id").alias("first_id"))
    roots = class_components(docs, signed, shingle, percent)
    member = (first.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls")))
    smallest = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = write_once(member.join(smallest, "root").select("cls", "component_id"), "classes")
    return (signed.select("doc_id", "n_shingles", "cls").join(named, "cls", "left")
            .select("doc_id", "n_shingles",
                    F.coalesce("component_id", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without all but the smallest ``doc_id`` of each component.

    Repeated rows of a kept id become one row; rows without id stay.
    """
    verdict = write_once(near_duplicates(docs, shingle, percent)
                         .where(F.col("doc_id").isNotNull())
                         .groupBy("doc_id").agg(F.min("kept").alias("kept"), F.count("*").alias("n")),
                         "verdicts")
    drop = verdict.where(~F.col("kept")).select("doc_id")
    repeated = verdict.where("kept and n > 1").select("doc_id")
    once = only_ids(docs, drop.unionByName(repeated), how="left_anti").select(*docs.columns)
    if not repeated.take(1):
        return once
    again = only_ids(docs, repeated).dropDuplicates(["doc_id"]).select(*docs.columns)
    return once.unionByName(again)
