"""Moving old rows out of a table."""

from __future__ import annotations

import time
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowtide.functions.timing import cutoff, moment, moment_for
from rowtide.operators.joins import null_safe
from rowtide.operators.sync import read_month_target, without_keys
from rowtide.sources.sinks import even_files, finish_replacing, has_parquet, partition_files, replace_files, rewrite_partitions


def archive_window(source: DataFrame, ts: str, n: int, unit: str, as_of: datetime) -> DataFrame:
    """The range to archive, from the first row to ``as_of - n units``, both inclusive, with its row count."""
    end = cutoff(as_of, n, unit)
    return source.agg(
        F.min(ts).alias("window_start"),
        moment(end, source.schema[ts].dataType).alias("window_end"),
        F.count_if(F.col(ts) <= moment_for(source, ts, end)).alias("rows"),
    )


def archive_rows(df: DataFrame, ts: str, n: int, unit: str, as_of: datetime) -> DataFrame:
    """The rows of the archive window."""
    return df.filter(F.col(ts) <= moment_for(df, ts, cutoff(as_of, n, unit)))


def archive_check(
    source: DataFrame, target: DataFrame | None, keys: list[str], ts: str, n: int, unit: str, as_of: datetime,
    cover: bool, ordered_cols: list[str],
) -> DataFrame:
    """First failed check, or ok: key known, time column laid out for ranges, rows to move, target window free."""
    moving = archive_rows(source, ts, n, unit, as_of).agg(F.count(F.lit(1)).alias("source_rows"))
    checked = moving
    if target is not None:
        there = archive_rows(target, ts, n, unit, as_of).agg(F.count(F.lit(1)).alias("n")).scalar()
        checked = moving.withColumn("target_rows", there)
    else:
        checked = moving.withColumn("target_rows", F.lit(0).cast("bigint"))
    status = (
        F.when(F.lit(not keys), "no_key")
        .when(F.lit(ts not in ordered_cols), "time_column_not_ordered")
        .when(F.col("source_rows") == 0, "no_rows")
        .when(F.lit(not cover and target is not None) & (F.col("target_rows") > 0), "target_not_empty")
        .otherwise("ok")
    )
    return checked.withColumn("status", status)


def archive_purge(df: DataFrame, ts: str, n: int, unit: str, as_of: datetime) -> DataFrame:
    """Rows that stay when everything before ``as_of - n units`` is deleted."""
    return df.filter((F.col(ts) >= moment_for(df, ts, cutoff(as_of, n, unit))) | F.col(ts).isNull())


def archive_move(
    source: DataFrame, target: DataFrame, keys: list[str], ts: str, n: int, unit: str, as_of: datetime, cover: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept source, new archive, log row). With ``cover`` rows of the same key are replaced in the archive."""
    moving = archive_rows(source, ts, n, unit, as_of)
    kept = source.filter((F.col(ts) > moment_for(source, ts, cutoff(as_of, n, unit))) | F.col(ts).isNull())
    there = without_keys(target, moving, keys) if cover else target
    log = archive_window(source, ts, n, unit, as_of).withColumn("percent", F.lit(100.0))
    return kept, there.unionByName(moving.select(*target.columns)), log


def archive_month_target(
    spark: SparkSession, source_path: str, archive_path: str, keys: list[str], ts: str, n: int, unit: str, as_of: datetime, cover: bool = True
) -> int:
    """Y17 on month-partitioned folders: copy, count the copy, and only then delete from the source. Gives the rows moved.

    The move is about the files that are there when it begins, of months up to the end of the window: rows that arrive
    during the move come in other files, which stay for the next one. A copy that differs in rows leaves the source
    alone; null keys are keys like others. With ``cover``, rows replace their own keys in the archive, so a run that died
    half-way can be started again; without, the archive must be free of them (``archive_check`` tells).
    """
    end = cutoff(as_of, n, unit)
    finish_replacing(spark, source_path)
    by_month = partition_files(spark, source_path, "yyyymm") if has_parquet(spark, source_path) else {}
    files = {m: own for m, own in by_month.items() if m <= end.strftime("%Y%m") and own}
    if not files:
        return 0

    def of(months) -> DataFrame:
        rows = spark.read.option("basePath", source_path).parquet(*[f for m in months for f in files[m]])
        return rows.withColumn("yyyymm", F.col("yyyymm").cast("string"))

    moving = archive_rows(of(files), ts, n, unit, as_of)
    per_month = {r["yyyymm"]: r["n"] for r in moving.groupBy("yyyymm").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
    if not per_month:
        return 0
    months = sorted(per_month)
    moving, counted = archive_rows(of(months), ts, n, unit, as_of), sum(per_month.values())
    its_keys = moving.select(*keys).distinct()
    moved, touched = moving, months
    if has_parquet(spark, archive_path):
        archived = read_month_target(spark, archive_path)
        # a key that was archived before under another month leaves that month
        held = archived.join(its_keys, null_safe(archived, its_keys, keys), "left_semi").select("yyyymm").distinct() if cover else archived.limit(0)
        touched = sorted({*months, *(r["yyyymm"] for r in held.toLocalIterator())})
        there = archived.filter(F.col("yyyymm").isin(*touched))
        moved = (without_keys(there, moving, keys) if cover else there).unionByName(moving)
    rewrite_partitions(even_files(moved, "yyyymm"), archive_path, "yyyymm", touched)
    copied = read_month_target(spark, archive_path)
    if copied.join(its_keys, null_safe(copied, its_keys, keys), "left_semi").count() != counted:
        raise RuntimeError("archive copy has a different number of rows; source left as it is")
    stays = of(months).filter(F.col(ts) > moment_for(moving, ts, end))
    replace_files(even_files(stays, "yyyymm"), source_path, "yyyymm", [f for m in months for f in files[m]])
    return counted


_JOB_LOG = "tag string, status string, source_rows bigint, target_rows bigint, moved bigint, window_end timestamp_ntz, seconds double, started_at timestamp_ntz"


def archive_job(
    spark: SparkSession, source_path: str, archive_path: str, keys: list[str], ts: str, n: int, unit: str, as_of: datetime, cover: bool = False, tag: str = "archive"
) -> DataFrame:
    """Y15-Y18 as a job: the checks of Y16 first, then the move; one row for the run log, whatever comes of it.

    Nothing moves unless all checks hold: without ``cover``, an archive that has rows of the window stops the job.
    """
    began = time.monotonic()
    finish_replacing(spark, source_path)
    status, there, found, moved = "no_rows", 0, 0, 0
    if has_parquet(spark, source_path):
        source = read_month_target(spark, source_path)
        target = read_month_target(spark, archive_path) if has_parquet(spark, archive_path) else None
        checked = archive_check(source, target, keys, ts, n, unit, as_of, cover, [ts]).first()
        status, found, there = checked["status"], checked["source_rows"], checked["target_rows"]
    if status == "ok":
        moved = archive_month_target(spark, source_path, archive_path, keys, ts, n, unit, as_of, cover)
    row = (tag, status, found, there, moved, cutoff(as_of, n, unit), time.monotonic() - began, as_of)
    return spark.createDataFrame([row], _JOB_LOG)
