"""More that is done to a month-partitioned target in place: surrogate keys, orphans, days that differ."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from rowtide.operators.joins import null_safe
from rowtide.operators.numbering import number_rows
from rowtide.operators.reconcile import reconcile_days, repair_days
from rowtide.operators.sync import read_month_target, rewrite_months, touched_months, window_replace_nokey
from rowtide.session import scratch_path
from rowtide.sources.sinks import with_month


def _months(df: DataFrame) -> list[str | None]:
    return sorted((r[0] for r in df.select("yyyymm").distinct().toLocalIterator()), key=lambda m: m or "")


def surrogate_month_target(source: DataFrame, path: str, surrogate: str, ts: str, n: int, unit: str, as_of: datetime) -> list[str | None]:
    """The window's rows give way to the source's, numbered after the highest number in use; ``source`` is the window, as written files."""
    target = read_month_target(source.sparkSession, path)
    months = touched_months(source, target, [], ts, n, unit, as_of)
    if months:
        highest = target.agg(F.coalesce(F.max(surrogate), F.lit(0))).first()[0]
        plain = source.drop(surrogate)
        fresh = number_rows(plain, list(plain.columns), surrogate).withColumn(surrogate, F.col(surrogate) + highest)
        rewrite_months(target, path, ts, months, lambda held: window_replace_nokey(fresh, held, ts, n, unit, as_of))
    return months


def orphans_month_target(source: DataFrame, path: str, keys: list[str], ts: str) -> list[str | None]:
    """Rows whose key the source no longer has leave the target; only months that hold one are rewritten.

    The whole tables meet once: the keys that must leave are written aside, and the months are rewritten without them.
    """
    spark = source.sparkSession
    target, there, place = read_month_target(spark, path), source.select(*keys), scratch_path(spark, "orphans")
    target.join(there, null_safe(target, there, keys), "left_anti").select(*dict.fromkeys([*keys, "yyyymm"])).write.parquet(place)
    gone = read_month_target(spark, place)
    months = _months(gone)
    if months:
        rewrite_months(target, path, ts, months, lambda held: held.join(gone, null_safe(held, gone, keys), "left_anti"))
    return months


def repair_month_target(source: DataFrame, path: str, keys: list[str], ts: str, n: int, as_of: datetime, delete_only_if_extra: bool = False) -> list[str | None]:
    """Y9 then Y10: days whose row counts differ are repaired; only their months, and those that held their keys, are rewritten."""
    target, rows = read_month_target(source.sparkSession, path), with_month(source, ts)
    bad = [r["day"] for r in reconcile_days(source, target, ts, n, as_of).filter("status = 'differ'").select("day").collect()]  # n + 1 days at most
    if not bad:
        return []
    fresh = rows.filter(F.to_date(ts).isin(*bad))
    held = target.join(fresh.select(*keys), keys, "left_semi")
    months = sorted({*[f"{d:%Y%m}" for d in bad], *_months(held)}, key=lambda m: m or "")
    part = rows.filter(F.col("yyyymm").isin(*[m for m in months if m])).drop("yyyymm")
    rewrite_months(target, path, ts, months, lambda old: repair_days(part, old, keys, ts, n, as_of, delete_only_if_extra))
    return months
