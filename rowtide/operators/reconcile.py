"""Comparing and repairing two copies of a table."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from rowtide.functions.rows import marked_text, row_hash
from rowtide.functions.timing import midnight, moment, moment_for
from rowtide.operators.filters import between_days, recent
from rowtide.operators.ordered import keep_last
from rowtide.operators.sync import without_keys
from rowtide.session import scratch_path


def reconcile_days(source: DataFrame, target: DataFrame, ts: str, n: int, as_of: datetime) -> DataFrame:
    """Row counts per day on both sides for the ``n + 1`` days up to ``as_of``.

    Both sides go through one aggregation, so each input partition sends at most one row per day.
    """
    first = as_of - timedelta(days=n)

    def side(df: DataFrame, is_source: int) -> DataFrame:
        return between_days(df, ts, first, as_of).select(F.to_date(ts).alias("day"), F.lit(is_source).alias("_src"))

    counts = (
        side(source, 1).unionByName(side(target, 0)).groupBy("day")
        .agg(F.count_if(F.col("_src") == 1).alias("source_rows"), F.count_if(F.col("_src") == 0).alias("target_rows"))
    )
    same = F.col("source_rows") == F.col("target_rows")
    return counts.withColumn("status", F.when(same, "equal").otherwise("differ"))


def repair_days(
    source: DataFrame, target: DataFrame, keys: list[str], ts: str, n: int, as_of: datetime, delete_only_if_extra: bool = False
) -> DataFrame:
    """Bring the differing days of the target back in line.

    The day is replaced; with ``delete_only_if_extra`` it is cleared only where the target has more rows, and
    upserted by key elsewhere.
    """
    # n + 1 days at most: they are worked out once and become a plain filter that reaches the scans
    bad = reconcile_days(source, target, ts, n, as_of).filter("status = 'differ'").collect()
    if not bad:
        return target
    days = [str(r["day"]) for r in bad]
    cleared = [str(r["day"]) for r in bad if r["target_rows"] > r["source_rows"]] if delete_only_if_extra else days

    def on(which: list[str]) -> Column:
        return F.coalesce(F.to_date(ts).isin(*[date.fromisoformat(day) for day in which]), F.lit(False))

    # one range that the scan can use, above it a set of days
    first, last = midnight(date.fromisoformat(min(days))), midnight(date.fromisoformat(max(days)) + timedelta(days=1))
    inside = (F.col(ts) >= moment_for(source, ts, first)) & (F.col(ts) < moment_for(source, ts, last))
    fresh = source.filter(inside & on(days))
    kept = target.filter(~on(cleared)) if cleared else target
    return without_keys(kept, fresh, keys).unionByName(fresh.select(*target.columns))


def _same_types(source: DataFrame, target: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with one type per column: where they differ, the type that a union of the two gives."""
    rows = source.limit(0).unionByName(target.limit(0).select(*source.columns))

    def cast(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in rows.schema.fields])

    return cast(source), cast(target)


def row_status(source: DataFrame, target: DataFrame, keys: list[str], md5: bool = False) -> DataFrame:
    """Per key whether the row is missing, extra, changed or the same.

    Only the key and one hash per row are shuffled, and hash aggregation needs no sort. Hashes tell nulls from empty texts and
    where each value ends; both sides are cast to one type. A key that repeats is the same only if both sides have the
    same rows as often: counts and two sums over the hashes are compared.
    """
    rest = [c for c in source.columns if c not in keys]
    source, target = _same_types(source, target)
    mark = F.xxhash64(F.md5(F.concat(F.lit(""), *[marked_text(c) for c in rest]))) if md5 else row_hash(rest)
    wide = "decimal(38,0)"

    def side(df: DataFrame, is_source: int) -> DataFrame:
        return df.select(*keys, mark.alias("_h"), F.lit(is_source).alias("_side"))

    def sums(is_source: int) -> list[Column]:
        mine = F.col("_side") == is_source
        return [
            F.count_if(mine), F.sum(F.when(mine, F.col("_h").cast(wide))),
            F.sum(F.when(mine, F.xxhash64("_h").cast(wide))),
        ]

    merged = side(source, 1).unionByName(side(target, 0)).groupBy(*keys).agg(F.struct(*sums(1)).alias("_s"), F.struct(*sums(0)).alias("_t"))
    status = (
        F.when(F.col("_t.col1") == 0, "missing").when(F.col("_s.col1") == 0, "extra")
        .when(~F.col("_s").eqNullSafe(F.col("_t")), "changed").otherwise("same")
    )
    return merged.select(*keys, status.alias("status"))


def reconcile_rows(source: DataFrame, target: DataFrame, keys: list[str], md5: bool = False) -> DataFrame:
    """How many rows are missing, extra, changed and the same."""
    return row_status(source, target, keys, md5).groupBy("status").agg(F.count(F.lit(1)).alias("rows"))


def recent_errors(errors: DataFrame, as_of: datetime, days: int = 3) -> DataFrame:
    return recent(errors, "create_time", days, "day", as_of)


def repair_by_key_list(source: DataFrame, target: DataFrame, errors: DataFrame, col: str, keys: list[str], as_of: datetime, days: int = 3) -> DataFrame:
    """Replace the rows that carry one of the recent error values; ``errors`` has (val, flag, repair_time, create_time)."""
    values = recent_errors(errors, as_of, days).select(F.col("val").alias("_val")).distinct()
    fresh = source.join(values, F.col(col).cast("string") == F.col("_val"), "left_semi")
    return without_keys(target, fresh, keys).unionByName(fresh.select(*target.columns))


def repair_tables(
    pairs: dict[str, tuple[DataFrame, DataFrame, str, list[str]]], errors: DataFrame, as_of: datetime, days: int = 3
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Repair a list of tables by the same error values: by name (source, target, column with the value, keys).

    Gives the new targets and the error list, flagged and timed. The values are worked out once; each source is read once,
    for the rows that carry one.
    """
    values = _kept(recent_errors(errors, as_of, days).select(F.col("val").alias("_val")).distinct(), "error-values")
    new = {}
    for name, (source, target, col, keys) in pairs.items():
        fresh = _kept(source.join(values, F.col(col).cast("string") == F.col("_val"), "left_semi"), "repaired")
        new[name] = without_keys(target, fresh, keys).unionByName(fresh.select(*target.columns))
    return new, flag_repaired(errors, as_of, days)


def _kept(df: DataFrame, name: str) -> DataFrame:
    place = scratch_path(df.sparkSession, name)
    df.write.parquet(place)
    return df.sparkSession.read.parquet(place)


def flag_repaired(errors: DataFrame, as_of: datetime, days: int = 3) -> DataFrame:
    """The error list with the recent entries flagged and timed."""
    since = moment(as_of - timedelta(days=days))
    hit = F.coalesce(F.col("create_time") >= since, F.lit(False))
    return errors.withColumn("flag", F.when(hit, "1").otherwise(F.col("flag"))).withColumn(
        "repair_time", F.when(hit, moment(as_of)).otherwise(F.col("repair_time"))
    )


def dedupe_max(df: DataFrame, group: list[str], id_col: str, cond: str, compat: bool = False) -> DataFrame:
    """Of the rows under ``cond`` keep the lowest id of each group; ``compat`` only drops the highest of a repeated group.

    Extremes are aggregated per group first; the rows then meet them on (group, id), which spreads a hot group.
    """
    inside = F.coalesce(F.expr(cond), F.lit(False))
    if compat:
        worst = df.filter(inside).groupBy(*group).agg(F.max(id_col).alias(id_col), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
        return df.join(worst.select(id_col), id_col, "left_anti").select(*df.columns)
    best = df.filter(inside).groupBy(*group).agg(F.min(id_col).alias(id_col)).select(id_col)
    return df.filter(~inside).unionByName(df.filter(inside).join(best, id_col, "left_semi").select(*df.columns))


def compact_latest(df: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """The last version of every key."""
    return keep_last(df, keys, version)


def run_log(previous: DataFrame, new: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """Run metrics with one row per key, the latest run winning."""
    return compact_latest(previous.unionByName(new), keys, version)
