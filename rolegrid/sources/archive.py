"""A feed archived as JSON lines, read by a Python data source that keeps what it could read.

A crawl leaves files of JSON lines, plain or gzipped. Reading them with the
engine's own reader is all or nothing: a file cut off in the middle fails the
feed. Here every file is a partition; a file that breaks gives the rows before
the break, then one row whose ``error`` says where and why, and the other files
do not notice.

    spark.dataSource.register(LineArchive)
    spark.read.format("line_archive").option("columns", "page_id long, url string").load(path)

Result: ``part`` (file name), ``line`` (from 1), the asked columns, ``error``.
A missing field is null; a value that does not fit its column is an error and
ends the file like a broken line. Blank lines are passed over.
"""

from __future__ import annotations

import gzip
import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

BATCH_LINES = 256


@dataclass
class ArchiveFile(InputPartition):
    path: str

    @property
    def name(self) -> str:
        return self.path.rsplit("/", 1)[-1]


class LineArchive(DataSource):
    """Data source ``line_archive``; options ``path`` and ``columns`` (a DDL string)."""

    @classmethod
    def name(cls) -> str:
        return "line_archive"

    def schema(self) -> str:
        return f"part string, line long, {self.options['columns']}, error string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArchiveReader(self.options["path"], schema)


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.full, self.arrow = path, schema, None
        self.columns = [f for f in schema.fields if f.name not in ("part", "line", "error")]

    def partitions(self) -> list[ArchiveFile]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (
            fs.LocalFileSystem(), self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        names = sorted(i.path for i in found if i.type == fs.FileType.File and not i.base_name.startswith(("_", ".")))
        scheme = self.path.split("://", 1)[0] + "://" if "://" in self.path else ""
        return [ArchiveFile(scheme + n if scheme and not n.startswith(scheme) else n) for n in names]

    def read(self, partition: ArchiveFile) -> Iterator:
        """Arrow batches of the readable lines; the break, if any, is the last row."""
        rows: list[dict] = []
        number = 0
        failed = None
        try:
            for number, raw in enumerate(self._lines(partition.path), 1):
                if raw.strip():
                    rows.append(self._row(partition.name, number, json.loads(raw)))
                    if len(rows) == BATCH_LINES:
                        good, failed = self._typed(rows)
                        if failed:
                            rows = good
                            break
                        yield self._batch(good)
                        rows = []
        except (OSError, EOFError, ValueError, TypeError) as exc:
            failed = self._failure(partition.name, number, exc)
        good, mistyped = self._typed(rows)
        failed = mistyped or failed
        if good or failed:
            yield self._batch([*good, *([failed] if failed else [])])

    def _typed(self, rows: list[dict]) -> tuple[list[dict], dict | None]:
        """The rows before the first whose values do not fit their columns, and its error."""
        try:
            self._batch(rows)
            return rows, None
        except (ValueError, TypeError):
            for i, row in enumerate(rows):
                try:
                    self._batch([row])
                except (ValueError, TypeError) as exc:
                    return rows[:i], self._failure(row["part"], row["line"], exc)
            raise

    @staticmethod
    def _failure(part: str, number: int, exc: Exception) -> dict:
        return {"part": part, "line": number, "error": f"{type(exc).__name__}: {(str(exc).splitlines() or [''])[0]}"}

    @staticmethod
    def _lines(path: str) -> Iterator[str]:
        from pyarrow import fs

        system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        with system.open_input_stream(name, compression=None) as stream:
            source = gzip.GzipFile(fileobj=stream) if name.endswith(".gz") else stream
            yield from io.TextIOWrapper(io.BufferedReader(source) if source is stream else source, encoding="utf-8", newline="\n")

    def _row(self, part: str, number: int, value) -> dict:
        if not isinstance(value, dict):
            raise ValueError("the line is no JSON object")
        return {"part": part, "line": number, **{f.name: value.get(f.name) for f in self.columns}}

    def _batch(self, rows: list[dict]):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        if self.arrow is None:
            self.arrow = to_arrow_schema(self.full)
        return pa.RecordBatch.from_pylist(rows, schema=self.arrow)


def read_archive(spark: SparkSession, path: str, columns: str) -> tuple[DataFrame, DataFrame]:
    """Rows of an archive and its errors, ``feed, error``: what a feed function returns.

    ``feed`` is the file. Both read the archive; a run stages the rows first.
    """
    spark.dataSource.register(LineArchive)
    found = spark.read.format("line_archive").option("columns", columns).load(path)
    errors = found.where(F.col("error").isNotNull()).select(
        F.col("part").alias("feed"), F.format_string("%s, line %d: %s", "part", "line", "error").alias("error"))
    return found.where(F.col("error").isNull()).drop("error"), errors
