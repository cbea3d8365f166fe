"""Continuous ingestion: a folder of raw postings, one run per micro-batch."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rolegrid.plans.ingest import Run, run_into_store
from rolegrid.schemas import RAW_POSTINGS
from rolegrid.sources.tables import SnapshotStore


def utc_now() -> str:
    return dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")


def raw_posting_stream(spark: SparkSession, folder: str,
                       files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(RAW_POSTINGS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


# States per source of ``without_repeats``; fixed for a checkpoint.
BUCKETS = 2048
_STATE = "urls array<string>, contents array<long>, times array<long>"
CONTENT = ("title", "company", "salary_raw", "location", "description", "source_job_id", "posted_at")


def without_repeats(spark: SparkSession, folder: str, minutes: float = 60, files_per_batch: int | None = None) -> DataFrame:
    """The stream of a folder without deliveries of what was just delivered.

    A crawler that retries writes the same posting twice within a short time. The
    stream keeps, by source, address and content, when a delivery last passed.
    Many of them share one of ``BUCKETS`` states per source, so that a call into
    Python takes thousands of rows and not one; what is ``minutes`` older than the
    watermark leaves its bucket. Arrival is the time its file was written. A delivery passes if that is
    ``minutes`` or longer ago, or never was: another content passes, and the same
    content later on is a refresh, which keeps the posting alive. (Spark's own
    ``dropDuplicatesWithinWatermark`` would also drop a refresh that comes in the
    batch in which its state is due to go.) A file that is ``minutes`` older than
    the newest one of the batches before is late; its rows are not in the stream.
    """
    content = F.xxhash64(*CONTENT)
    rows = (raw_posting_stream(spark, folder, files_per_batch)
            .select("*", F.col("_metadata.file_modification_time").alias("arrived"))
            .withColumns({"content": content, "ms": F.unix_millis("arrived"),
                          "bucket": F.pmod(F.xxhash64("source_url", content), F.lit(BUCKETS))}))
    span = int(minutes * 60_000)
    names = RAW_POSTINGS.fieldNames()

    def first_of_each_span(_key, parts, state):
        if state.hasTimedOut:
            state.remove()
            return
        last = {}
        if state.exists:
            urls, contents, times = state.get
            last = dict(zip(zip(urls, contents), times))
        rows = pd.concat(list(parts)).sort_values(["ms", "ingest_seq"])
        keep = []
        for url, content, ms in zip(rows["source_url"].tolist(), rows["content"].tolist(), rows["ms"].tolist()):
            before = last.get((url, content))
            keep.append(before is None or ms - before >= span)
            if keep[-1]:
                last[url, content] = ms
        yield rows[names][keep]
        due = state.getCurrentWatermarkMs() - span
        kept = [(url, content, ms) for (url, content), ms in last.items() if ms > due]
        if kept:
            state.update(tuple(map(list, zip(*kept))))
            state.setTimeoutTimestamp(max(ms for _, _, ms in kept) + span)
        elif state.exists:
            state.remove()

    return (rows.withWatermark("arrived", f"{span} milliseconds").groupBy("source_id", "bucket")
            .applyInPandasWithState(first_of_each_span, RAW_POSTINGS, _STATE, "append", "EventTimeTimeout"))


def checkpoint_folder(store: SnapshotStore, name: str) -> str:
    """The stream's own state lies beside the tables it feeds, and goes with them."""
    return f"{store.root}/_streams/{name}"


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark stores in a checkpoint when it is made."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def start_ingest(stream: DataFrame, store: SnapshotStore, source_id: int, name: str,
                 clock: Callable[[], str] = utc_now) -> StreamingQuery:
    """Ingest everything available and stop.

    The run id is the stream's name, the id stored in its checkpoint, and the
    batch id. Spark may deliver a batch again after a failure; its run id is
    then in the ledger and the batch is skipped, or it is not and the keyed
    upserts make the repetition harmless. A stream that lost its checkpoint
    has a new id: it reads all files again as new runs, and no batch is taken
    for one that was stored before. ``without_repeats`` gives a stream that drops
    repeated deliveries but keeps refreshes.
    """
    spark = stream.sparkSession
    checkpoint = checkpoint_folder(store, name)

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        run_id = f"{name}-{stream_id(spark, checkpoint)}-{batch_id}"
        run_into_store(store, batch, Run(run_id, source_id, clock()))

    return (stream.writeStream.foreachBatch(one_batch).queryName(name)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
