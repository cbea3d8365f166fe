"""Stored tables: parquet folders with explicit schemas, committed together."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolegrid import schemas
from rolegrid.operators.token_index import IS_MARKER
from rolegrid.session import freed_shuffles

TABLES: dict[str, T.StructType] = {
    "sources": schemas.SOURCES, "companies": schemas.COMPANIES, "jobs": schemas.POSTINGS,
    "scrape_runs": schemas.SCRAPE_RUNS, "run_errors": schemas.RUN_ERRORS,
    "alerts": schemas.ALERTS, "search_tokens": schemas.SEARCH_TOKENS,
    "posting_counts": schemas.POSTING_COUNTS,
}
# rows of these tables change; a change replaces the row with the same key
KEYED = {"search_tokens": ("doc_id",), "jobs": ("id",), "companies": ("id",), "scrape_runs": ("id",), "run_errors": ("run_id", "ingest_seq")}
# a key may have many rows, but one of this kind in each change
MARKED = {"search_tokens": IS_MARKER}
# rows are sorted in ranges by these, so that files can be skipped
SORTED = {"search_tokens": ("token", "doc_id")}
# jobs are read by "active and canonical" nearly always
PARTITIONS = {"jobs": ["is_active"]}


class SnapshotStore:
    """Tables as immutable parquet folders below one root, shared by all executors.

    A table is a base folder plus folders of changed rows; reading takes the
    base rows that no change replaces and the latest change of every other
    row. One small numbered file lists the folders of *all* tables, so what a
    run stores in several tables appears at once or not at all. The file gets
    its number by a rename that fails if the number is taken: of two writers at
    once one fails. That needs a file system with such a rename, as HDFS has.

    Nothing is rewritten or removed on its own: ``compact`` writes a table
    anew as one base folder, ``vacuum`` removes what the current state does not
    list.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # --- the list of folders ---

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return jvm, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def state(self) -> tuple[int, dict[str, list[str]]]:
        """Number of the current state and each table's folders, base first."""
        jvm, fs = self._fs()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.root}/_states")
        if not fs.exists(folder):
            return 0, {}
        last = max((s.getPath().getName() for s in fs.listStatus(folder)), default="0")
        if last == "0":
            return 0, {}
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(folder, last))
        try:
            return int(last), json.loads(stream.readUTF())
        finally:
            stream.close()

    def _publish(self, number: int, folders: dict[str, list[str]]) -> None:
        jvm, fs = self._fs()
        fresh = jvm.org.apache.hadoop.fs.Path(f"{self.root}/_new-{uuid.uuid4().hex}")
        stream = fs.create(fresh, False)
        stream.writeUTF(json.dumps(folders))
        stream.close()
        target = jvm.org.apache.hadoop.fs.Path(f"{self.root}/_states/{number:012d}")
        fs.mkdirs(target.getParent())
        if fs.exists(target) or not fs.rename(fresh, target):
            raise RuntimeError(f"another writer committed state {number} first")

    def _save(self, table: str, df: DataFrame) -> str:
        folder = f"{self.root}/{table}/v-{uuid.uuid4().hex}"
        df = df.select(TABLES[table].fieldNames())
        if table in SORTED:
            df = df.repartitionByRange(*SORTED[table]).sortWithinPartitions(*SORTED[table])
        writer = df.write.mode("errorifexists").option("compression", "zstd")
        if table in PARTITIONS:
            writer = writer.partitionBy(*PARTITIONS[table])
        with freed_shuffles(self.spark):
            writer.parquet(folder)
        return folder

    def _load(self, table: str, *folders: str) -> DataFrame:
        schema = TABLES[table]
        parts = [self.spark.read.schema(schema).parquet(f).select(schema.fieldNames()) for f in folders]
        return reduce(lambda a, b: a.unionAll(b), parts)

    # --- tables ---

    def read(self, table: str) -> DataFrame:
        folders = self.state()[1].get(table, [])
        if not folders:
            return self.spark.createDataFrame([], TABLES[table])
        key = KEYED.get(table)
        if key is None or len(folders) == 1:
            return self._load(table, *folders)
        base, *changes = folders
        names = TABLES[table].fieldNames()
        versions = reduce(lambda a, b: a.unionAll(b), [
            self._load(table, f).withColumn("__v", F.lit(i)) for i, f in enumerate(changes)])
        # only keys and numbers are aggregated; the rows follow by key and number
        marks = versions.where(MARKED[table]) if table in MARKED else versions
        last = marks.groupBy(*key).agg(F.max("__v").alias("__v"))
        latest = versions.join(last, [*key, "__v"], "left_semi").select(names)
        kept = self._load(table, base).join(last.select(*key), list(key), "left_anti").select(names)
        return kept.unionByName(latest)

    def commit(self, write: dict[str, DataFrame] | None = None, add: dict[str, DataFrame] | None = None) -> None:
        """Store several tables at once: ``write`` replaces tables, ``add`` adds rows.

        In keyed tables added rows replace the rows with their keys; a key may
        occur once in what is added.
        """
        number, folders = self.state()
        new = dict(folders)
        for table, df in (write or {}).items():
            new[table] = [self._save(table, df)]
        for table, df in (add or {}).items():
            new[table] = [*new.get(table, []), self._save(table, df)]
        self._publish(number + 1, new)

    def write(self, table: str, df: DataFrame) -> None:
        self.commit(write={table: df})

    def add(self, table: str, df: DataFrame) -> None:
        self.commit(add={table: df})

    def compact(self, table: str) -> None:
        """Write a table anew as one folder."""
        if len(self.state()[1].get(table, [])) > 1:
            self.write(table, self.read(table))

    def vacuum(self) -> int:
        """Remove folders and lists the current state does not need; returns how many.

        Run it when nobody reads or writes an older state.
        """
        number, folders = self.state()
        jvm, fs = self._fs()
        used = {f.rsplit("/", 1)[1] for fs_ in folders.values() for f in fs_}
        gone = []
        for table in TABLES:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
            if fs.exists(path):
                gone += [s.getPath() for s in fs.listStatus(path) if s.getPath().getName() not in used]
        states = jvm.org.apache.hadoop.fs.Path(f"{self.root}/_states")
        if fs.exists(states):
            gone += [s.getPath() for s in fs.listStatus(states) if int(s.getPath().getName()) != number]
        for path in gone:
            fs.delete(path, True)
        return len(gone)


def export_json(df: DataFrame, path: str, column: str = "json") -> None:
    """Write a column of JSON documents as text lines."""
    df.select(F.col(column).alias("value")).write.mode("errorifexists").text(path)
