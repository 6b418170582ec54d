"""Counts, totals and rankings (E1-E18, L1-L3, S1-S3). All combine on the map side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def row_count(df: DataFrame, where: str | None = None) -> DataFrame:
    """Number of rows, under a condition if given."""
    return (df.where(where) if where else df).agg(F.count(F.lit(1)).alias("row_count"))


def key_bounds(df: DataFrame, key: str, ts: str | None = None) -> DataFrame:
    """Lowest and highest key, their distance and the first time."""
    aggs = [F.min(key).alias("min_key"), F.max(key).alias("max_key"), (F.max(key) - F.min(key)).alias("span")]
    if ts:
        aggs.append(F.min(ts).alias("min_time"))
    return df.agg(*aggs)


def pending_by_table(log: DataFrame, after: int, tables: int, cap: int | None = None) -> DataFrame:
    """Tables with the most waiting changes; with ``cap``, among the first ``cap`` waiting rows only."""
    waiting = log.filter(F.col("seq") > after)
    if cap is not None:
        waiting = waiting.orderBy("seq").limit(cap)
    return waiting.groupBy("tbl").agg(F.count(F.lit(1)).alias("pending")).orderBy(F.desc("pending"), "tbl").limit(tables)


def command_summary(df: DataFrame, keys: list[str], value: str, ts: str) -> DataFrame:
    """Average duration, first and last time per command."""
    return df.groupBy(*keys).agg(
        F.round(F.avg(value), 2).alias("avg_duration"), F.min(ts).alias("first_time"), F.max(ts).alias("last_time")
    )


def distinct_tuples(df: DataFrame, cols: list[str], ts: str) -> DataFrame:
    """E5: number of distinct value combinations (rows with a null member do not count) and the time range."""
    return df.agg(F.count_distinct(*cols).alias("tuples"), F.min(ts).alias("first_time"), F.max(ts).alias("last_time"))


def concat_group(
    df: DataFrame, keys: list[str], col: str, order: str | None = None, sep: str = ",", distinct: bool = False, chunk: Column | None = None, bounded: bool = False
) -> DataFrame:
    """The values of a group as one text. Distinct values are reduced before they meet in the group.

    A group needs ``chunk``, a step of the order: the text then comes in parts, one row per chunk (``part``), whose order is
    the order of the text; no task holds the whole group. One text per group is made only of distinct values or where
    ``bounded`` says that groups have a bound.
    """
    if chunk is None and not (distinct or bounded):
        raise ValueError("say how the text is cut (chunk), or that groups are bounded")
    rows = df.select(*keys, F.col(col).cast("string").alias("_v"), F.col(order or col).alias("_o"), *([chunk.alias("part")] if chunk is not None else []))
    groups = [*keys, "part"] if chunk is not None else keys
    if distinct:
        rows = rows.groupBy(*groups, "_v").agg(F.min("_o").alias("_o"))
    quoted = sep.replace("'", "''")
    agg = F.expr(f"listagg(_v, '{quoted}') within group (order by _o, _v)").alias("joined")
    return rows.groupBy(*groups).agg(agg) if groups else rows.agg(agg)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def duplicate_key_count(df: DataFrame, keys: list[str]) -> DataFrame:
    """How many keys occur more than once."""
    return duplicate_keys(df, keys).agg(F.count(F.lit(1)).alias("duplicate_keys"))


def priority_tier(total: Column, avg: Column, execs: Column, compat: bool = False) -> Column:
    """Five tiers by total time, average time and executions."""
    second = (total == 100) if compat else (total >= 100)
    # fixed values: tier limits
    return (
        F.when((total >= 600) | (avg >= 200) | (execs >= 60), 5)
        .when((total >= 400) | (avg >= 100) | (execs >= 30), 4)
        .when((total >= 200) | (avg >= 50) | (execs >= 10), 3)
        .when(second | (avg >= 30) | (execs >= 5), 2)
        .otherwise(1)
    )


def _exact(name: str) -> Column:
    """Sum of a measure in decimals: the same whatever order the rows are added in, for values below 10^22."""
    return F.sum(F.col(name).cast("decimal(28,6)"))


def statement_stats(stats: DataFrame, compat: bool = False) -> DataFrame:
    """Totals per database, user and statement over the snapshots that ran it at least once."""
    per_snap = (
        stats.groupBy("dbid", "username", "sql_id", "snap")
        .agg(
            F.sum("executions").alias("executions"),
            *[_exact(m).alias(m) for m in ("elapsed_s", "rows_processed", "disk_reads")],
        )
        .filter("executions > 0")
    )

    def whole(total: Column) -> Column:
        return F.round(total, 0).cast("double")

    seconds = F.sum("elapsed_s").cast("double")
    return (
        per_snap.groupBy("dbid", "username", "sql_id")
        .agg(
            F.min("snap").alias("first_time"),
            F.max("snap").alias("last_time"),
            F.sum("executions").alias("executions"),
            whole(F.sum("elapsed_s")).alias("total_time"),
            F.round(F.try_divide(seconds, F.sum("executions")), 0).alias("avg_time"),
            whole(F.sum("rows_processed")).alias("rows_processed"),
            whole(F.sum("disk_reads")).alias("disk_reads"),
        )
        .withColumn("priority", priority_tier(F.col("total_time"), F.col("avg_time"), F.col("executions"), compat))
    )


def usage_ratio(totals: DataFrame, free: DataFrame, key: str) -> DataFrame:
    """Used share in percent from total and free space, each summed per key."""
    t = totals.groupBy(key).agg(F.sum("total").alias("total"))
    f = free.groupBy(key).agg(F.sum("free").alias("free"))
    used = F.try_divide(F.col("total") - F.col("free"), F.col("total"))
    return t.join(f, key).select(key, (F.round(used, 4) * 100).alias("usage"))


def ops_by_interval(changes: DataFrame, secs: int, ts: str = "ts") -> DataFrame:
    """Changes per kind and time interval, which begin at full multiples of ``secs`` since 1970; changes without a
    time are counted under a null interval."""
    def kind(name: str) -> Column:
        return F.count_if(F.col("op") == name).alias(f"{name}_amount")

    zero = F.lit("1970-01-01 00:00:00Z").cast("timestamp") if changes.schema[ts].dataType.typeName() == "timestamp" else F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    step = secs * 1_000_000
    micros = F.timestamp_diff("MICROSECOND", zero, F.col(ts))
    start = F.timestamp_add("MICROSECOND", micros - F.pmod(micros, F.lit(step)), zero)
    return changes.groupBy(start.alias("window_start")).agg(F.count(F.lit(1)).alias("event_amount"), kind("insert"), kind("update"), kind("delete"), kind("ddl"))


def group_as_distinct(df: DataFrame, cols: list[str], created: str) -> DataFrame:
    """Distinct rows with the latest time each was recorded."""
    return df.groupBy(*cols).agg(F.max(created).alias(created))


def max_map_value(json_col: Column) -> Column:
    """The largest value of a JSON map."""
    return F.array_max(F.map_values(F.from_json(json_col, "map<string,double>")))


def effect_range(pairs: DataFrame, id_col: str, flag: str) -> DataFrame:
    """Per id the text ``class:count`` of the jobs that touch it."""
    counts = pairs.groupBy(id_col, flag).agg(F.count(F.lit(1)).alias("times"))
    part = F.concat_ws(":", F.col(flag).cast("string"), F.col("times").cast("string"))
    return concat_group(counts.withColumn("_part", part), [id_col], "_part", bounded=True).withColumnRenamed("joined", "effect")


def run_totals(details: DataFrame, tag: str = "tag") -> DataFrame:
    """Rows moved and seconds spent per job."""
    return details.groupBy(tag).agg(F.sum("moved").alias("amount"), F.sum("seconds").alias("duration"))


def progress(done: Column, total: Column) -> Column:
    """Percent done; a total of zero counts as one."""
    return F.round(done / F.greatest(total, F.lit(1)) * 100, 2)


def rate_from_uptime(counters: DataFrame, key: str) -> DataFrame:
    """Transactions and statements per second of uptime, from (key, counter, value) rows."""
    # fixed values: names of the counters
    names = ["uptime", "commits", "rollbacks", "questions"]
    wide = counters.groupBy(key).pivot("counter", names).agg(F.sum("value"))
    tps = F.try_divide(F.coalesce("commits", F.lit(0)) + F.coalesce("rollbacks", F.lit(0)), F.col("uptime"))
    qps = F.try_divide(F.col("questions"), F.col("uptime"))
    return wide.select(key, F.round(tps, 2).alias("tps"), F.round(qps, 2).alias("qps"))


def opcounter_rate(counters: DataFrame, key: str) -> DataFrame:
    """E17, document stores: inserts, updates and deletes per second of uptime, and queries per second."""
    wide = counters.groupBy(key).pivot("counter", ["uptime", "insert", "update", "delete", "query"]).agg(F.sum("value"))
    written = F.coalesce("insert", F.lit(0)) + F.coalesce("update", F.lit(0)) + F.coalesce("delete", F.lit(0))
    return wide.select(
        key,
        F.round(F.try_divide(written, F.col("uptime")), 2).alias("tps"),
        F.round(F.try_divide(F.col("query"), F.col("uptime")), 2).alias("qps"),
    )


def connection_counts(processes: DataFrame, key: str) -> DataFrame:
    """All sessions and those at work, per instance."""
    return processes.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_connect"), F.count_if(F.col("command") != "Sleep").alias("active_connect")
    )


def top_statements(stats: DataFrame, n: int = 20) -> DataFrame:
    """L1: slowest statements by average time, then disk reads; keys break ties."""
    return stats.orderBy(F.desc("avg_time"), F.desc("disk_reads"), "dbid", "username", "sql_id").limit(n)


def top_sessions(sessions: DataFrame, n: int = 20, compat: bool = False) -> DataFrame:
    """L2: longest running sessions first; ``compat`` lists the shortest first."""
    first = F.asc("secs") if compat else F.desc("secs")
    return sessions.orderBy(first, F.desc("physical_io"), "id").limit(n)


def next_batch(log: DataFrame, after: int, n: int) -> DataFrame:
    """L3: the next ``n`` waiting log rows."""
    return log.filter(F.col("seq") > after).orderBy("seq").limit(n)


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of ``left`` that ``right`` does not have."""
    return left.subtract(right)


def union_keys(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """The keys of several frames, one after the other; repeats stay."""
    merged = frames[0].select(*keys)
    for frame in frames[1:]:
        merged = merged.unionByName(frame.select(*keys))
    return merged


def distinct_schemas(log: DataFrame) -> DataFrame:
    """S3: schemas that occur in a change log."""
    return log.select(F.substring_index("tbl", ".", 1).alias("schema_name")).distinct()
