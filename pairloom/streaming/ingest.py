"""Incremental ingest, ring-buffer state and event windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def ingest_documents(spark: SparkSession, source: str, sink: str, checkpoint: str, schema: str, files_per_batch: int = 20_000) -> StreamingQuery:
    """New JSON documents, at most so many files a batch, appended as Parquet exactly once; a rerun goes on where it stopped."""
    docs = spark.readStream.schema(schema).options(multiLine="true", maxFilesPerTrigger=str(files_per_batch), recursiveFileLookup="true").json(source)
    return docs.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ring_buffer_stream(rows: DataFrame, key: str, order: str, value: str, capacity: int) -> DataFrame:
    """For each key and batch, the last ``capacity`` values by order: key, order, value.

    A key's state holds ``capacity`` entries at most; use several keys (shards) for a
    buffer that one task should not hold.
    """

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        orders, values = state.get if state.exists else ([], [])
        held = list(zip(orders, values, strict=True))
        for pdf in batches:
            held = sorted(held + list(zip(pdf["o"].tolist(), pdf["v"].tolist(), strict=True)))[-capacity:]
        state.update(([o for o, _ in held], [v for _, v in held]))
        yield pd.DataFrame({"key": [k[0]] * len(held), "o": [o for o, _ in held], "v": [v for _, v in held]})

    source = rows.select(F.col(key).cast("long").alias("key"), F.col(order).cast("long").alias("o"), F.col(value).cast("double").alias("v"))
    return source.groupBy("key").applyInPandasWithState(update, "key long, o long, v double", "orders array<long>, vals array<double>", "update", GroupStateTimeout.NoTimeout)


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events by window and type; works on tables and on streams."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n_events"), F.round(F.sum("value"), 4).alias("total"))
        .select(F.col("w.start").alias("window_start"), "event_type", "n_events", "total")
    )


def sliding_counts(events: DataFrame, width: str = "1 hour", slide: str = "30 minutes", late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, slide).alias("w")).agg(F.count(F.lit(1)).alias("n_events")).select(F.col("w.start").alias("window_start"), "n_events")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    return (
        events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n_events"))
        .select("user_id", F.col("w.start").alias("session_start"), "n_events")
    )


def first_of_each(events: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """One row per key, late repeats within the watermark left out (streams only)."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
