"""Running counts of a change stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from rowtide.operators.aggregates import ops_by_interval
from rowtide.streaming.changes import buffered


def ops_metrics(stream: DataFrame, secs: int, path: str, checkpoint: str, ts: str = "ts", gap: str | None = None) -> StreamingQuery:
    """Changes per kind and tumbling window, kept as one small table of counts per micro-batch.

    A late change counts in its own window, whenever it comes; a micro-batch that runs again replaces its own counts.
    """

    def add(batch: DataFrame, number: int) -> None:
        ops_by_interval(batch, secs, ts).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return buffered(stream, checkpoint, gap).foreachBatch(add).start()


def read_ops_metrics(spark: SparkSession, path: str) -> DataFrame:
    """All windows with what has been counted so far."""
    counts = spark.read.parquet(path)
    names = [c for c in counts.columns if c not in ("window_start", "batch")]
    return counts.groupBy(F.col("window_start").cast("timestamp_ntz").alias("window_start")).agg(*[F.sum(c).alias(c) for c in names])
