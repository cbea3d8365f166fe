"""Many addresses and contents share one state of the stream that drops repeats."""

import os

from rolegrid import schemas
from rolegrid.streaming import ingest


def test_addresses_of_one_bucket_stay_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "BUCKETS", 1)
    folder, state, out = (str(tmp_path / n) for n in ("raw", "state", "out"))

    def deliver(hour, *rows):
        before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
        names = schemas.RAW_POSTINGS.fieldNames()
        full = [tuple({**dict.fromkeys(names), **r}.get(n) for n in names) for r in rows]
        spark.createDataFrame(full, schemas.RAW_POSTINGS).coalesce(1).write.mode("append").parquet(folder)
        for name in set(os.listdir(folder)) - before:
            os.utime(f"{folder}/{name}", (hour * 3600, hour * 3600))
        (ingest.without_repeats(spark, folder).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination())
        return sorted(r.ingest_seq for r in spark.read.parquet(out).collect())

    def raw(seq, source, url, title):
        blank = {f.name: "" for f in schemas.RAW_POSTINGS if f.dataType.simpleString() == "string"}
        return {**blank, "ingest_seq": seq, "source_id": source, "source_url": url, "title": title}

    first = [raw(i, 1 + i % 2, f"u{i}", "a") for i in range(40)]
    assert deliver(1000, *first) == list(range(40))
    again = [raw(100 + i, 1 + i % 2, f"u{i}", "a") for i in range(40)]  # repeats: none passes
    other = [raw(200 + i, 1 + i % 2, f"u{i}", "b") for i in range(40)]  # another title: all pass
    assert deliver(1000.5, *again, *other) == [*range(40), *range(200, 240)]
    # later on the same contents are refreshes
    assert {300, 301} <= set(deliver(1005, raw(300, 1, "u0", "a"), raw(301, 2, "u1", "b")))
