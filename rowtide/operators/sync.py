"""Batch sync of one table (Y1-Y8, Y19). Functions return the new target; ``sync_month_target`` writes it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rowtide.functions.timing import cutoff, moment_for
from rowtide.operators.filters import recent
from rowtide.session import scratch_path
from rowtide.sources.sinks import even_files, has_parquet, rewrite_partitions, with_month, write_month_partitioned


def _outside(df: DataFrame, ts: str, start: datetime) -> DataFrame:
    return df.filter((F.col(ts) < moment_for(df, ts, start)) | F.col(ts).isNull())


def without_keys(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Target rows whose key isn't among ``rows``; a null in a key equals a null."""
    gone = rows.select(*[F.col(k).alias(f"_gone_{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_gone_{k}")) for k in keys])
    return target.join(gone, same, "left_anti").select(*target.columns)


def init_load(source: DataFrame, target: DataFrame | None) -> DataFrame:
    """Copy everything if the target is missing or empty; else leave it as it is."""
    if target is None or target.isEmpty():
        return source
    return target


def full_refresh(source: DataFrame, target: DataFrame) -> DataFrame:
    """Y2: no increment column, so the target becomes a copy of the source."""
    return source.select(*target.columns)


def window_replace(
    source: DataFrame, target: DataFrame, keys: list[str], ts: str, n: int, unit: str, as_of: datetime
) -> DataFrame:
    """Drop the target's window and the keys of the source's window, then add the source's window."""
    fresh = recent(source, ts, n, unit, as_of)
    kept = without_keys(_outside(target, ts, cutoff(as_of, n, unit)), fresh, keys)
    return kept.unionByName(fresh.select(*target.columns))


def window_upsert(source: DataFrame, target: DataFrame, keys: list[str], ts: str, n: int, unit: str, as_of: datetime) -> DataFrame:
    """Replace by key only; target rows the source has lost stay."""
    fresh = recent(source, ts, n, unit, as_of)
    return without_keys(target, fresh, keys).unionByName(fresh.select(*target.columns))


def window_replace_nokey(source: DataFrame, target: DataFrame, ts: str, n: int, unit: str, as_of: datetime) -> DataFrame:
    """A keyless table loses its window and gets the source's."""
    fresh = recent(source, ts, n, unit, as_of)
    return _outside(target, ts, cutoff(as_of, n, unit)).unionByName(fresh.select(*target.columns))


def window_replace_surrogate(
    source: DataFrame, target: DataFrame, surrogate: str, ts: str, n: int, unit: str, as_of: datetime
) -> DataFrame:
    """As Y6 for a target with its own surrogate key: new rows are numbered after the highest number in use."""
    from rowtide.operators.numbering import number_rows

    fresh = recent(source, ts, n, unit, as_of).drop(surrogate)
    kept = _outside(target, ts, cutoff(as_of, n, unit))
    highest = target.agg(F.coalesce(F.max(surrogate), F.lit(0)).alias("m")).scalar()
    numbered = number_rows(fresh, list(fresh.columns), surrogate).withColumn(surrogate, F.col(surrogate) + highest)
    return kept.unionByName(numbered.select(*target.columns))


def merge_actions(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """What a merge does with each source row: update if its key exists, else insert."""
    marks = target.select(*keys).distinct().withColumn("_hit", F.lit(1))
    return source.join(marks, keys, "left").withColumn("action", F.when(F.col("_hit").isNull(), "insert").otherwise("update")).drop("_hit")


def merge_counts(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Rows updated and inserted."""
    return merge_actions(source, target, keys).groupBy("action").agg(F.count(F.lit(1)).alias("rows"))


def merge_rows(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """The target after the merge."""
    return without_keys(target, source, keys).unionByName(source.select(*target.columns))


def delete_orphans(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Only target rows whose key the source still has."""
    return target.join(source.select(*keys), keys, "left_semi").select(*target.columns)


def transfer(source: DataFrame, target: DataFrame, where: str | Column | None = None) -> DataFrame:
    """Copy all, or replace the rows under a condition; rows where it is unknown are not deleted."""
    if where is None or where == "":
        return source.select(*target.columns)
    cond = F.expr(where) if isinstance(where, str) else where
    kept = target.filter(~F.coalesce(cond, F.lit(False)))
    return kept.unionByName(source.filter(cond).select(*target.columns))


def touched_months(
    source: DataFrame, target: DataFrame, keys: list[str], ts: str, n: int, unit: str, as_of: datetime
) -> list[str | None]:
    """Months a window replace changes: the window on both sides, and where moved rows were kept before (None for
    rows that had no time)."""
    fresh = recent(source, ts, n, unit, as_of)
    months = recent(target, ts, n, unit, as_of).select("yyyymm").union(with_month(fresh, ts).select("yyyymm"))
    if keys:
        months = months.union(target.join(fresh.select(*keys), keys, "left_semi").select("yyyymm"))
    return sorted((r[0] for r in months.distinct().toLocalIterator()), key=lambda m: m or "")


def read_month_target(spark: SparkSession, path: str, like: DataFrame | None = None) -> DataFrame:
    """A month-partitioned target with its partition column as text. One that has lost its last month is empty, with the columns of
    ``like``."""
    if like is not None and not has_parquet(spark, path):
        return like.limit(0).select("*", F.lit(None).cast("string").alias("yyyymm")) if "yyyymm" not in like.columns else like.limit(0)
    df = spark.read.parquet(path)
    return df.withColumn("yyyymm", F.col("yyyymm").cast("string"))


def rewrite_months(target: DataFrame, path: str, ts: str, months: list[str | None], make: Callable[[DataFrame], DataFrame]) -> None:
    """Replace the given months (None: rows without a time) of a month-partitioned target by ``make(their rows)``."""

    def inside(month: Column) -> Column:
        listed = month.isin(*[m for m in months if m])
        return listed | month.isNull() if None in months else listed

    new = with_month(make(target.filter(inside(F.col("yyyymm"))).drop("yyyymm")), ts).filter(inside(F.col("yyyymm")))  # no other month may be overwritten
    rewrite_partitions(even_files(new, "yyyymm"), path, "yyyymm", months)


def sync_month_target(
    source: DataFrame, path: str, keys: list[str], ts: str, n: int, unit: str, as_of: datetime, upsert: bool = False, staged: bool = False
) -> list[str | None]:
    """Y1 then Y3, Y4 or (without keys) Y6 on a month-partitioned target, rewriting only the months that change.

    Gives back the rewritten months; running it again with the same input changes nothing. ``staged`` says that the
    source is the window already, as written files.
    """
    spark = source.sparkSession
    if not has_parquet(spark, path):
        write_month_partitioned(source, path, ts, keys or source.columns)
        return ["*"]
    target = read_month_target(spark, path)
    if not staged:  # the source is read once: a row that comes in meanwhile waits for the next run
        place = scratch_path(spark, "window")
        recent(source, ts, n, unit, as_of).write.parquet(place)
        source = spark.read.parquet(place)
    months = touched_months(source, target, keys, ts, n, unit, as_of)
    if not months:
        return []

    def new(held: DataFrame) -> DataFrame:
        if not keys:
            return window_replace_nokey(source, held, ts, n, unit, as_of)
        return (window_upsert if upsert else window_replace)(source, held, keys, ts, n, unit, as_of)

    rewrite_months(target, path, ts, months, new)
    return months
