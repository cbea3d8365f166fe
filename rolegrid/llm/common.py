"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolegrid.session import stage

# Ids up to this many are sent to every task as a filter (16 bytes each);
# beyond it the tables are joined by shuffle.
BROADCAST_IDS = 1_000_000
# Texts of one Arrow batch: bounds a Python worker's memory with long texts.
BATCH_ROWS = 256
# Words a worker remembers before it starts afresh.
MEMO_WORDS = 300_000


def write_once(df: DataFrame, name: str) -> DataFrame:
    """Write below ``spark.checkpoint.dir`` and read back; cuts the lineage."""
    return stage(df, f"llm-{name}")


def forget(df: DataFrame) -> None:
    """Remove a table of ``write_once`` whose last reader has been written."""
    files = df.inputFiles()
    if files:
        jvm = df.sparkSession.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        if not folder.getName().startswith("llm-"):
            raise ValueError(f"{folder} is not a table written by write_once")
        folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def map_rows(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with batches small enough for very long texts."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(fn, schema)


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    """The texts of a batch as UTF-8 bytes."""
    col = batch.column(batch.schema.get_field_index(column))
    return col.cast(pa.binary() if pa.types.is_string(col.type) else pa.large_binary()).to_pylist()


def values(batch: pa.RecordBatch, column: str) -> list:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


class WordHashes(dict):
    """64-bit hash of each word, remembered."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))

    def trim(self) -> None:
        if len(self) > MEMO_WORDS:
            self.clear()


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` word hashes."""
    count = len(words) - n + 1
    h = np.zeros(max(count, 0), np.uint64)
    for i in range(n if count > 0 else 0):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[i:i + count])
    return h


def only_ids(df: DataFrame, ids: DataFrame, key: str = "doc_id",
             limit: int = BROADCAST_IDS, how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose key is in ``ids`` (distinct, written).

    Up to ``limit`` ids the filter is broadcast and the texts stay where they
    are; beyond it both sides are shuffled by the key. ``how="left_anti"``
    gives the other rows.
    """
    few = ids.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(ids) if few else ids.hint("shuffle_merge"), key, how)


def batches(rows: list[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_pylist(rows, schema=schema)
