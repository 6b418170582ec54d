"""Applying a change stream to tables.

A target is a folder of batches, each with the last change of each of its keys and that change's log place; deleted keys stay
as tombstones. A micro-batch writes only its own folder and replaces it when it runs again; the last place of a key wins on
reading, however often and in whatever order batches come, and a snapshot taken at some place ignores earlier events by itself.
``fold`` is an ordinary job that writes the last rows of all batches to a new folder, to go on with.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from rowtide.operators.changes import after_position, net_changes
from rowtide.operators.images import IMAGE_SCHEMA, known_tables, reduced_log, route_tables, statements_of
from rowtide.operators.ordered import POSITION, keep_last
from rowtide.sources.sinks import has_parquet
from rowtide.streaming.changes import buffered

KEYS = ["tbl", "pk"]


def _put(rows: DataFrame, path: str, number: int) -> None:
    """A batch's rows, sorted so that readers of some tables or keys skip the rest; an empty batch still has its columns."""
    rows.sortWithinPartitions(*[c for c in KEYS if c in rows.columns]).write.mode("overwrite").parquet(f"{path}/batch={number}")


def write_snapshot(snapshot: DataFrame, path: str, at: tuple[int, int] = (-1, -1)) -> None:
    """Start a target from a snapshot taken at a log place."""
    place = {"file_no": F.lit(at[0]).cast("bigint"), "pos": F.lit(at[1]).cast("bigint"), "seq": F.lit(2**62).cast("bigint")}
    _put(snapshot.withColumns({"deleted": F.lit(False), **place}), path, -1)


def merge_batch(batch: DataFrame, path: str, images: list[str], number: int, compat: bool = False) -> None:
    """Add one batch to the target; under the same number it replaces itself."""
    _put(net_changes(batch, KEYS, images, compat=compat), path, number)


def read_target(spark: SparkSession, path: str) -> DataFrame:
    """The target with tombstones and log places: the last row of each key over all batches."""
    return keep_last(spark.read.parquet(path).drop("batch"), KEYS, POSITION)


def live_rows(spark: SparkSession, path: str, cols: list[str]) -> DataFrame:
    """The rows of the target."""
    return read_target(spark, path).filter(~F.col("deleted")).select(*cols)


def fold(spark: SparkSession, path: str, new_path: str, forget: tuple[int, int] | None = None) -> None:
    """All batches as one, in a new folder; run it while no stream writes, and go on there with the same checkpoint.

    X12: with ``forget``, tombstones up to that log place are left out. No event up to it must come any more.
    """
    rows = read_target(spark, path)
    _put(rows if forget is None else rows.filter(~F.col("deleted") | after_position(*forget)), new_path, -1)


def start_apply(stream: DataFrame, path: str, checkpoint: str, images: list[str], gap: str | None = None, compat: bool = False) -> StreamingQuery:
    """Apply the stream to all tables at once; order inside a table is kept by log place."""

    def add(batch: DataFrame, number: int) -> None:
        merge_batch(batch, path, images, number, compat)

    return buffered(stream, checkpoint, gap).foreachBatch(add).start()


def start_routing(
    stream: DataFrame, path: str, checkpoint: str, targets: Mapping[str, DataFrame], keys: Mapping[str, list[str]],
    load: Callable[[str], DataFrame] | None = None, gap: str | None = None, compat: bool = False,
) -> StreamingQuery:
    """Keep the effect of a log of many tables with their own keys, row changes and schema changes alike.

    ``stream`` has rows of ``IMAGE_SCHEMA``. Each micro-batch is reduced to one event per key, by the schemas known so
    far, and keeps its statements; of a table whose key columns come from a statement that is still to be read it keeps all
    events. ``routed_tables`` gives the tables. Of ``targets`` only the columns are used here.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        said = statements_of(batch)
        said.write.mode("overwrite").parquet(f"{path}/statements/batch={number}")
        known = spark.read.parquet(f"{path}/statements").filter(F.col("batch") <= number)
        info, unkeyed = known_tables(targets, known, keys, load)
        reduced_log(batch, info, compat, unkeyed).write.mode("overwrite").parquet(f"{path}/log/batch={number}")

    return buffered(stream, checkpoint, gap).foreachBatch(add).start()


def routed_tables(
    spark: SparkSession, path: str, targets: Mapping[str, DataFrame], keys: Mapping[str, list[str]], load: Callable[[str], DataFrame] | None = None
) -> dict[str, DataFrame]:
    """The tables as ``start_routing`` has followed them, from ``targets`` as they were before the log."""
    if not has_parquet(spark, f"{path}/log"):
        return dict(targets)
    return route_tables(targets, spark.read.schema(f"{IMAGE_SCHEMA}, batch int").parquet(f"{path}/log").drop("batch"), keys, load)
