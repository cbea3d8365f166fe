"""Clustering around centroids with a vector-approximation file.

Vectors become whole numbers (``floor(scale * x)``), are stored once, and once
more as an approximation: one cell of ``2 ** bits`` per dimension, one byte
each. A round looks at the approximations alone. A lookup table per centroid
holds, for each dimension and cell, the least and the greatest part the cell
can have in the distance; the 64 entries of a vector sum up to an interval per
centroid. All intervals are reduced by the distance to one common point, which
does not change their order but makes them narrow: what is left is linear in
the vector. If one interval lies wholly below the others, the centroid is known.

A round asks for the full vector only where intervals overlap, under the
centroids before or after the last move, or where the known centroid changed.
Centroid sums are kept as differences: who moved is taken from one sum and added
to the other, so vectors that stay are not read. All arithmetic is exact: sums
and their floors are Python integers on the driver (centroids x dimensions), and
distances are integers.

The full vectors are bucketed by a row number that is stored with them; a round
sends the wanted row numbers to the buckets and never shuffles a vector.

Kept are vectors of exactly ``dims`` components, all finite, with whole values
below 2^53 in size. Null vectors, other lengths, nulls, NaN and infinities
inside are left out. A null ``vec_id`` is an id like others, started from last.
Repeated rows count as often as they occur; equal start hashes are ordered by
components. Ties go to the smaller centroid. Fewer vectors than centroids give
as many centroids as vectors; an empty table gives no row. A distance beyond 64
bits is null, and so are the sums that contain it; its cluster is still right.
Other columns do not matter.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegrid.llm.common import write_once
from rolegrid.session import checkpoint_root

DIMS = 64
CENTROIDS = 8
ROUNDS = 10
SCALE = 1024
BITS = 8
# Vectors of one bucket, and vectors worked on at once in a task.
BUCKET_ROWS = 400_000
CHUNK = 2048
# Whole values below this keep 64 squared differences inside 64 bits; and those whose
# products sum up exactly in doubles.
SAFE = 1 << 27
FLOAT_SAFE = 1 << 22


def start_key(vec_id: Column) -> Column:
    """The hash by which the first centroids are chosen."""
    return F.sha2(F.concat(F.lit("3:"), vec_id.cast("string")).cast("binary"), 256)


def kept(table: DataFrame, vector: str, dims: int, scale: int) -> DataFrame:
    """``vec_id, v`` of the rows with a usable vector."""
    bound = float(2**53 / scale)
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < bound))
    kind = table.schema[vector].dataType.simpleString()
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"),
                        F.col(vector).cast("array<float>" if kind == "array<float>" else "array<double>").alias("v"))
    return rows.where((F.size("v") == dims) & usable)


def whole(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    """Rows of whole numbers of an Arrow column of vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(values.reshape(-1, dims) * scale).astype(np.int64)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, vectors by centroids; Python integers if 64 bits are too few."""
    most = max(abs(int(a.max(initial=0))) for a in (x, -x, centroids, -centroids)) if len(x) else 0
    if most >= SAFE:
        x, centroids = x.astype(object), centroids.astype(object)
        return np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)
    if most >= FLOAT_SAFE:
        return np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)
    xf, cf = x.astype(np.float64), centroids.astype(np.float64)  # every sum stays below 2^53
    return ((xf * xf).sum(1)[:, None] - 2.0 * (xf @ cf.T) + (cf * cf).sum(1)[None]).astype(np.int64)


@dataclass(frozen=True)
class Grid:
    """Cells of equal width per dimension between the least and the greatest value."""

    low: tuple[int, ...]
    high: tuple[int, ...]
    bits: int

    @property
    def usable(self) -> bool:
        return max(map(abs, self.low + self.high)) < SAFE

    def cells(self, x: np.ndarray) -> np.ndarray:
        low = np.array(self.low, np.int64)
        return (((x - low) << self.bits) // (np.array(self.high, np.int64) - low + 1)).astype(np.uint8)

    def borders(self) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest value of each cell, dimensions by cells."""
        low = np.array(self.low, np.int64)[:, None]
        width = np.array(self.high, np.int64)[:, None] - low + 1
        cut = -((-np.arange((1 << self.bits) + 1) * width) >> self.bits) + low
        return cut[:, :-1], np.maximum(cut[:, 1:] - 1, cut[:, :-1])

    def tables(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lookup tables (dimensions x cells, centroids) of least and greatest parts."""
        at_least, at_most = self.borders()
        centre = centroids.sum(0) // len(centroids)
        slope = -2 * (centroids - centre)
        a, b = slope[:, :, None] * at_least[None], slope[:, :, None] * at_most[None]
        fixed = centroids**2 - centre**2
        low, high = np.minimum(a, b) + fixed[:, :, None], np.maximum(a, b) + fixed[:, :, None]
        spread = lambda t: np.ascontiguousarray(t.transpose(1, 2, 0).reshape(-1, len(centroids)))
        return spread(low), spread(high)


def known(cells: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The centroid with the lowest upper end, and whether its interval meets no other."""
    at = cells + (np.arange(cells.shape[1]) * (len(tables[0]) // cells.shape[1]))
    low, high = tables[0][at].sum(1), tables[1][at].sum(1)
    best = high.argmin(1)
    rows = np.arange(len(cells))
    end = high[rows, best]
    low[rows, best] = np.iinfo(np.int64).max
    return best, low.min(1) > end


def value_ranges(vectors: DataFrame, dims: int, scale: int) -> list[tuple[int, int]]:
    """Least and greatest whole value of each dimension; empty without vectors."""
    def ends(it):
        low = high = None
        for batch in it:
            x = whole(batch.column(0), dims, scale)
            if len(x):
                low = x.min(0) if low is None else np.minimum(low, x.min(0))
                high = x.max(0) if high is None else np.maximum(high, x.max(0))
        if low is not None:
            yield pa.RecordBatch.from_pydict({"dim": pa.array(range(dims), pa.int32()), "low": low, "high": high})

    found = (vectors.select("v").mapInArrow(ends, "dim int, low long, high long")
             .groupBy("dim").agg(F.min("low"), F.max("high")).orderBy("dim").collect())
    return [(r[1], r[2]) for r in found]


def bucketed(vectors: DataFrame, buckets: int) -> DataFrame:
    """Vectors with a stored row number, bucketed by it in the shared folder."""
    spark, name = vectors.sparkSession, f"vectors_{uuid.uuid4().hex}"
    (vectors.withColumn("row_no", F.monotonically_increasing_id()).repartition(buckets, "row_no")
     .write.option("path", f"{checkpoint_root(spark)}/staged/llm-{name}")
     .bucketBy(buckets, "row_no").saveAsTable(name))
    stored = spark.read.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay; the name is not needed any more
    return stored


def approximations(vectors: DataFrame, grid: Grid, dims: int, scale: int) -> DataFrame:
    """``row_no, cells``: one byte per dimension."""
    def cut(it):
        for batch in it:
            raw = grid.cells(whole(batch.column(1), dims, scale)).reshape(-1)
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * dims)
            cells = pa.BinaryArray.from_buffers(pa.binary(), batch.num_rows,
                                                [None, ends.buffers()[1], pa.py_buffer(raw.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), cells], names=["row_no", "cells"])

    return write_once(vectors.select("row_no", "v").mapInArrow(cut, "row_no long, cells binary"), "cells")


def wanted(cells: DataFrame, grid: Grid, before: np.ndarray, after: np.ndarray) -> DataFrame:
    """Row numbers of the vectors that a round has to fetch."""
    def pick(it):
        old, new = grid.tables(before), grid.tables(after)
        for batch in it:
            raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1).astype(np.int64)
            keep = []
            for at in range(0, batch.num_rows, CHUNK):
                was, sure_was = known(raw[at:at + CHUNK], old)
                now, sure_now = known(raw[at:at + CHUNK], new)
                keep.append(~sure_was | ~sure_now | (was != now))
            if keep:
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(np.concatenate(keep)))], names=["row_no"])

    return cells.select("row_no", "cells").mapInArrow(pick, "row_no long")


def moves(vectors: DataFrame, before: np.ndarray | None, after: np.ndarray, dims: int, scale: int):
    """What each centroid's sum and count gain between two states (all, if ``before`` is None)."""
    k = len(after)

    def gain(it):
        sums, counts = np.zeros((k, dims), object), np.zeros(k, np.int64)
        for batch in it:
            x = whole(batch.column(0), dims, scale)
            now = distances(x, after).argmin(1)
            was = None if before is None else distances(x, before).argmin(1)
            part = np.zeros((k, dims), object)
            for j in range(k):
                into = (now == j) if was is None else (now == j) & (was != j)
                part[j] = _column_sums(x[into])
                counts[j] += int(into.sum())
                if was is not None:
                    out = (was == j) & (now != j)
                    part[j] = part[j] - _column_sums(x[out])
                    counts[j] -= int(out.sum())
            sums = sums + part
        yield pa.RecordBatch.from_pydict({
            "cluster": pa.array(np.repeat(np.arange(k), dims), pa.int32()),
            "dim": pa.array(np.tile(np.arange(dims), k), pa.int32()),
            "gain": pa.array([_decimal(int(s)) for s in sums.reshape(-1)], pa.decimal128(38, 0)),
            "n": pa.array(np.repeat(counts, dims), pa.int64())})

    rows = (vectors.select("v").mapInArrow(gain, "cluster int, dim int, gain decimal(38,0), n long")
            .groupBy("cluster", "dim").agg(F.sum("gain").cast("decimal(38,0)").alias("gain"), F.sum("n").alias("n")).collect())
    sums, counts = [[0] * dims for _ in range(k)], [0] * k
    for r in rows:
        sums[r.cluster][r.dim], counts[r.cluster] = int(r.gain), int(r.n)
    return sums, counts


def _column_sums(x: np.ndarray) -> np.ndarray:
    if len(x) and max(int(x.max()), -int(x.min())) >= (1 << 40):
        return x.astype(object).sum(0)
    return x.sum(0).astype(object)  # an Arrow batch has far fewer than 2^22 rows


def _decimal(value: int):
    from decimal import Decimal

    return Decimal(value)


def assigned(vectors: DataFrame, centroids: np.ndarray, dims: int, scale: int) -> DataFrame:
    """``vec_id, cluster, distance`` of every vector."""
    def near(it):
        for batch in it:
            d = distances(whole(batch.column(1), dims, scale), centroids)
            best = d.argmin(1)
            least = d[np.arange(len(d)), best].tolist()
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column(0), "cluster": pa.array(best, pa.int32()),
                "distance": pa.array([x if x < 2**63 else None for x in least], pa.int64())})

    return vectors.select("vec_id", "v").mapInArrow(near, "vec_id long, cluster int, distance long")


def start(vectors: DataFrame, centroids: int, scale: int) -> np.ndarray:
    """The vectors with the smallest hashes of their ids, in that order."""
    rows = (vectors.select("vec_id", F.transform("v", lambda x: F.floor(x.cast("double") * scale)).alias("w"))
            .orderBy(start_key(F.col("vec_id")).asc_nulls_last(), "w").limit(centroids).collect())
    return np.array([r.w for r in rows], np.int64)


def cluster(table: DataFrame, vector: str = "embedding", centroids: int = CENTROIDS, rounds: int = ROUNDS,
            dims: int = DIMS, scale: int = SCALE, bits: int = BITS,
            bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, np.ndarray]:
    """Assignments after ``rounds`` rounds, ``vec_id, cluster, distance``, and the centroids."""
    if not 1 <= bits <= 8:
        raise ValueError("a cell takes 1 to 8 bits")
    chosen = kept(table, vector, dims, scale)
    ranges = value_ranges(chosen, dims, scale)
    if not ranges:
        return assigned(chosen, np.zeros((1, dims), np.int64), dims, scale), np.zeros((0, dims), np.int64)
    vectors = bucketed(chosen, max(1, -(-chosen.count() // bucket_rows)))
    grid = Grid(tuple(r[0] for r in ranges), tuple(r[1] for r in ranges), bits)
    cells = approximations(vectors, grid, dims, scale) if grid.usable else None
    before, after = None, start(vectors, centroids, scale)
    sums = counts = None
    for _ in range(rounds):
        asked = vectors
        if before is not None and cells is not None:
            asked = vectors.join(wanted(cells, grid, before, after).hint("shuffle_hash"), "row_no", "left_semi")
        gained, joined = moves(asked, before, after, dims, scale)
        if before is None:
            sums, counts = gained, joined
        else:
            sums = [[a + b for a, b in zip(s, g, strict=True)] for s, g in zip(sums, gained, strict=True)]
            counts = [a + b for a, b in zip(counts, joined, strict=True)]
        before = after
        after = np.array([[s // n for s in row] if n else list(old)
                          for row, n, old in zip(sums, counts, before.tolist(), strict=True)], np.int64)
    return assigned(vectors, after, dims, scale), after


def report(table: DataFrame, **options) -> DataFrame:
    """Every vector with its cluster, distances summed, and a digest of its centroid."""
    rows, centroids = cluster(table, **options)
    rows = write_once(rows, "clusters")
    # one row per centroid comes to the driver and goes back to the tasks
    sums = {r.cluster: r.s for r in rows.groupBy("cluster").agg(
        F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(38,0)"))).alias("s")).collect()}
    fits = lambda s: int(s) if s is not None and s < 2**63 else None
    every = None if None in sums.values() else sum(sums.values())
    facts = table.sparkSession.createDataFrame(
        [(j, fits(sums[j]), fits(every), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())
         for j, c in enumerate(centroids.tolist()) if j in sums],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
