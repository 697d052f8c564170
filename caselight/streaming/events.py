"""Streaming extension: windows, sessions, de-duplication and per-key state on event streams.

The other operators are batch programs; these are built on Structured Streaming for event feeds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight.session import ship_package


def read_events(spark: SparkSession, path: str, schema: str, time: str = "ts", files: int = 8) -> DataFrame:
    """A stream of Parquet files; the time becomes a timestamp, which watermarks need."""
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return df.withColumn(time, F.col(time).cast("timestamp"))


def tumbling(df: DataFrame, time: str, key: str, value: str, size: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Counts and sums a key and window; events later than the watermark are left out."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    out = df.withWatermark(time, late).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), key, "n", "total")


def sessions(df: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of a key: runs of events no further apart than the gap."""
    out = df.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def once(df: DataFrame, time: str, key: str, late: str = "2 hours") -> DataFrame:
    """The first row of each key within the watermark."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def running_totals(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, n, total after each batch, kept as state of the key."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    ship_package(df.sparkSession)
    kind = dict(df.dtypes)[key]

    def step(k: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for part in rows:
            n, total = n + len(part), total + float(part[value].sum())
        state.update((n, total))
        yield pd.DataFrame({key: [k[0]], "n": [n], "total": [total]})

    return df.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


def to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs the stream over what is there now and writes it as Parquet, each batch once."""
    df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
