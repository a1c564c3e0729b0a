"""Streams of trace events: windowed counts with a watermark, and segments kept across batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.session import shared_dir, ship


def windowed_counts(events: DataFrame, at: str, by: list[str], width: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """(window_start, by..., n): rows per window and key, of a stream or a table.

    On a stream, rows that are later than ``lateness`` behind the newest are dropped, and
    the state of a window goes once no row can fall in it any more.
    """
    late = events.withWatermark(at, lateness) if events.isStreaming else events
    return late.groupBy(F.window(at, width).alias("_w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("_w.start").alias("window_start"), *by, "n")


def running_segments(events: DataFrame, key: str, order: str, marker: str) -> DataFrame:
    """(key, segments, rows): markers and rows seen so far of each key, one row per key and batch, of a stream.

    The state is two counters for each key, so it grows with the keys and not with the
    rows; a key's rows arrive in bounded Arrow batches. ``marker`` names a boolean column;
    null counts as no marker. Order within a batch does not matter to the counters.
    """
    ship(events.sparkSession)
    kind = events.schema[key].dataType.simpleString()

    def count(group: tuple[Any, ...], batches: Iterator[Any], state: Any) -> Iterator[Any]:
        import pandas as pd

        segments, rows = state.get if state.exists else (0, 0)
        for batch in batches:
            segments += int(batch[marker].fillna(False).astype(bool).sum())
            rows += len(batch)
        state.update((segments, rows))
        yield pd.DataFrame({key: [group[0]], "segments": [segments], "rows": [rows]})

    return events.select(key, order, marker).groupBy(key).applyInPandasWithState(count, f"{key} {kind}, segments long, rows long", "segments long, rows long", "update", "NoTimeout")


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now, and return what it wrote.

    Rows go to Parquet in the shared folder with their checkpoint beside them, so a run
    that lost its driver goes on where it was. With mode ``update`` all versions of a
    row are kept, each with the number of its batch in ``_batch``.
    """
    spark: SparkSession = stream.sparkSession
    top = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{top}/state").trigger(availableNow=True)
    if mode == "update":
        # Overwriting a batch's own folder makes a repeated batch harmless.
        writer = writer.outputMode("update").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{top}/rows/_batch={n}"))
    else:
        writer = writer.outputMode("append").format("parquet").option("path", f"{top}/rows")
    writer.start().awaitTermination()
    batch = [T.StructField("_batch", T.IntegerType())] if mode == "update" else []
    return spark.read.schema(T.StructType([*stream.schema.fields, *batch])).parquet(f"{top}/rows")
