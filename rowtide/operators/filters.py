"""Row filters (C1-C12). Each keeps the filtered column bare so Parquet and JDBC can push it down."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rowtide.functions.timing import cutoff, midnight, moment, moment_for, seconds_between

# fixed values: session commands that never count as running statements
IDLE_COMMANDS = ("Sleep", "Binlog Dump", "Daemon", "Connect", "Binlog Dump GTID")


def recent(df: DataFrame, ts: str | None, n: int, unit: str, as_of: datetime, month_col: str | None = None) -> DataFrame:
    """Rows of the last ``n`` units before ``as_of``; without a time column every row counts.

    ``month_col`` names a ``yyyyMM`` partition column (A12); the derived bound prunes whole partitions.
    """
    if not ts:
        return df
    start = cutoff(as_of, n, unit)
    kept = df.filter(F.col(ts) >= moment_for(df, ts, start))
    if month_col:
        kept = kept.filter(F.col(month_col) >= F.lit(start.strftime("%Y%m")))
    return kept


def recent_tz(df: DataFrame, ts: str | None, n: int, unit: str, as_of: datetime, offset_hours: int = 8) -> DataFrame:
    """As C1 with the clock moved from the server's zone to the data's."""
    return recent(df, ts, n, unit, as_of + timedelta(hours=offset_hours))


def on_day(df: DataFrame, ts: str, day: date, compat: bool = False) -> DataFrame:
    """Rows of one day, half-open; ``compat`` ends at 23:59:59 and so loses its fractions."""
    start = midnight(day)
    t = F.col(ts)
    if compat:
        return df.filter(t.between(moment_for(df, ts, start), moment_for(df, ts, start + timedelta(seconds=86399))))
    return df.filter((t >= moment_for(df, ts, start)) & (t < moment_for(df, ts, start + timedelta(days=1))))


def between_days(df: DataFrame, ts: str, first: date, last: date) -> DataFrame:
    """Rows from the start of ``first`` to the end of ``last``."""
    t = F.col(ts)
    end = midnight(last) + timedelta(days=1)
    return df.filter((t >= moment_for(df, ts, midnight(first))) & (t < moment_for(df, ts, end)))


def last_days(spark: SparkSession, n: int, as_of: date) -> DataFrame:
    """C4: the ``n + 1`` days up to ``as_of``, oldest first."""
    end = F.lit(str(as_of)[:10]).cast("date")
    return spark.range(1).select(F.explode(F.sequence(F.date_sub(end, n), end)).alias("day"))


def where_text(df: DataFrame, cond: str | None) -> DataFrame:
    """A condition given by the user as SQL text."""
    return df.where(cond) if cond and cond.strip() else df


def keys_equal(df: DataFrame, col: str, keys: DataFrame) -> DataFrame:
    """Rows whose ``col`` is one of the values in ``keys``."""
    return df.join(keys.select(F.col(keys.columns[0]).alias(col)).distinct(), col, "left_semi")


def in_csv(col: Column, csv: str | Column, substring: bool = False) -> Column:
    """Membership in a comma list. ``substring`` is the plain text search ('1' is found in '12')."""
    text = F.lit(csv) if isinstance(csv, str) else csv
    value = col.cast("string")
    if substring:
        return F.instr(text, value) > 0
    return F.array_contains(F.split(text, ","), value)


def not_like(df: DataFrame, col: str, pattern: str) -> DataFrame:
    """Leave out rows whose text matches a LIKE pattern."""
    return df.filter(~F.col(col).like(pattern))


def after_high_water(df: DataFrame, ts: str, last: datetime) -> DataFrame:
    """Rows later than the stored mark."""
    return df.filter(F.col(ts) > moment_for(df, ts, last))


def high_water(df: DataFrame, ts: str, last: datetime) -> DataFrame:
    """The next mark; the old one stays when nothing new was seen."""
    old = moment_for(df, ts, last)
    return df.agg(F.greatest(F.max(ts), old).alias("high_water"))


def select_events(
    df: DataFrame, ops: list[str], tables: list[str] | None = None, schemas: list[str] | None = None
) -> DataFrame:
    """Change events of the wanted kinds, for the listed tables (``schema.table``) or schemas."""
    kept = df.filter(F.col("op").isin(list(ops)))
    if tables:
        kept = kept.filter(F.col("tbl").isin(list(tables)))
    if schemas:
        kept = kept.filter(F.substring_index("tbl", ".", 1).isin(list(schemas)))
    return kept


def age_and_threshold(df: DataFrame, ts: str, as_of: datetime, max_age: int, micros: str, limit_ms: float) -> DataFrame:
    """C11: commands no older than ``max_age`` seconds that took longer than ``limit_ms``."""
    ms = F.round(F.col(micros) / 1000, 2)
    first = as_of - timedelta(seconds=max_age)
    return (
        df.filter((F.col(ts) >= moment_for(df, ts, first)) & (F.col(ts) <= moment_for(df, ts, as_of)))
        .withColumn("duration_ms", ms)
        .filter(F.col("duration_ms") > limit_ms)
    )


def running_statements(processes: DataFrame, min_secs: int, marker: str | None = None) -> DataFrame:
    """Statements at work for at least ``min_secs``, longest first; ``marker`` leaves out our own queries."""
    busy = processes.filter(~F.col("command").isin(*IDLE_COMMANDS) & (F.col("secs") >= min_secs))
    if marker:
        busy = busy.filter(F.instr("info", marker) == 0)
    return busy.orderBy(F.desc("secs"), "id")


def with_age(df: DataFrame, ts: str, as_of: datetime, name: str = "age_secs") -> DataFrame:
    return df.withColumn(name, seconds_between(F.col(ts), moment(as_of)))
