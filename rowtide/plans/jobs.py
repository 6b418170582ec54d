"""Whole jobs: from a list of table specs to written targets and a run log."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from rowtide.functions.rows import normalise_values
from rowtide.operators.filters import recent
from rowtide.operators.load import loaded, ranged_load, reading_plan
from rowtide.operators.months import orphans_month_target, repair_month_target, surrogate_month_target
from rowtide.operators.numbering import add_surrogate_key
from rowtide.operators.sync import sync_month_target
from rowtide.session import scratch_path
from rowtide.sources.scan import project_synced, scan_table
from rowtide.sources.sinks import has_parquet, remove_path, write_month_partitioned
from rowtide.specs import SyncSpec, TableCatalog

RUN_LOG = "tag string, tbl string, moved bigint, seconds double, started_at timestamp_ntz"


def _first_load(spark: SparkSession, rows: DataFrame, path: str, keys: list[str], ts: str, parts: int) -> int:
    """The whole table, range by range, so that a load that died goes on; then by month."""
    place = f"{path}-loading"
    ranged_load(spark, rows.where, lambda: reading_plan(rows, keys, ts, parts), place)
    whole = loaded(spark, place)
    write_month_partitioned(whole, path, ts, keys or rows.columns)
    remove_path(spark, place)
    remove_path(spark, f"{place}-ledger")
    return spark.read.parquet(path).count()


def sync_table(
    spark: SparkSession, source: TableCatalog, spec: SyncSpec, target_dir: str, as_of: datetime, allow: str | None = None, normalise: bool = False,
    modes: tuple[str, ...] = (), parts: int = 8,
) -> tuple[int, float]:
    """One table of a sync job. Gives rows moved, as written, and seconds.

    Without a time column it is a full copy (Y2). A target that isn't there is loaded in ranges (Y1). Else the window is
    replaced by key (Y3), or without keys as a whole (Y6); ``modes`` may say ``upsert`` (Y4), ``surrogate:<column>`` (Y5), and,
    after that, ``orphans`` (Y8) and ``repair:<days>`` (Y9, Y10).
    """
    unknown = [m for m in modes if m.partition(":")[0] not in ("upsert", "surrogate", "orphans", "repair")]
    if unknown:
        raise ValueError(f"unknown modes {unknown} of {spec.table}")
    began, path = time.monotonic(), f"{target_dir}/{spec.table}"
    rows = project_synced(scan_table(spark, source, spec.table), allow)
    rows = normalise_values(rows) if normalise else rows
    if not spec.time_col:
        rows.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path).count(), time.monotonic() - began
    keys, ts = list(source.keys.get(spec.table, ())), spec.time_col
    said = dict(m.partition(":")[::2] for m in modes)
    if not has_parquet(spark, path):
        if "surrogate" in said:  # numbered once, as files that lie in the order of the numbers: a range reads its part of them
            place = scratch_path(spark, "numbered")
            add_surrogate_key(rows, said["surrogate"]).write.parquet(place)
            rows, keys = spark.read.parquet(place), [said["surrogate"]]
        return _first_load(spark, rows, path, keys, ts, parts), time.monotonic() - began
    place = scratch_path(spark, "window")
    recent(rows, ts, spec.window, spec.unit, as_of).write.parquet(place)
    window = spark.read.parquet(place)
    if "surrogate" in said:
        surrogate_month_target(window, path, said["surrogate"], ts, spec.window, spec.unit, as_of)
    else:
        sync_month_target(window, path, keys, ts, spec.window, spec.unit, as_of, "upsert" in said, staged=True)
    if "orphans" in said:
        orphans_month_target(rows, path, keys, ts)
    if "repair" in said:
        repair_month_target(rows, path, keys, ts, int(said["repair"]), as_of)
    return window.count(), time.monotonic() - began


def sync_tables(
    spark: SparkSession, source: TableCatalog, specs: list[SyncSpec], target_dir: str, as_of: datetime,
    allow: dict[str, str] | None = None, tag: str = "sync", at_once: int = 4, modes: dict[str, tuple[str, ...]] | None = None,
) -> DataFrame:
    """A sync job over its tables, ``at_once`` of them side by side; the run log has one row per table (E15 and E16 total it)."""

    def one(spec: SyncSpec) -> tuple:
        return (tag, spec.table, *sync_table(spark, source, spec, target_dir, as_of, (allow or {}).get(spec.table), modes=(modes or {}).get(spec.table, ())), as_of)

    with ThreadPoolExecutor(at_once) as pool:
        log = list(pool.map(one, specs))
    return spark.createDataFrame(log, RUN_LOG)
