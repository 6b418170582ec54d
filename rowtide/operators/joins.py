"""Lookups and key tests (D1-D13) as set joins; Catalyst and AQE choose the strategy from real sizes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from rowtide.functions.timing import moment
from rowtide.operators.filters import IDLE_COMMANDS


def job_config(jobs: DataFrame, lookups: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Inner joins of a job list with the tables it points to, given as (table, job column, table key)."""
    joined = jobs
    for table, left, right in lookups:
        joined = joined.join(table, F.col(left) == F.col(right), "inner")
    return joined


def left_lookup(df: DataFrame, table: DataFrame, left: str, right: str) -> DataFrame:
    """Optional lookup; rows without a partner stay."""
    return df.join(table, F.col(left) == F.col(right), "left")


def code_lookup(df: DataFrame, codes: DataFrame, col: str, code_class: str, name: str) -> DataFrame:
    """D3: readable name of a code; ``codes`` has (code_class, code, label)."""
    picked = codes.filter(F.col("code_class") == code_class).select(F.col("code").alias("_code"), F.col("label").alias(name))
    return df.join(picked, F.col(col).cast("string") == F.col("_code"), "left").drop("_code")


def _at_highest(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Rows at the highest value of ``col`` within their key.

    The rank filter is also applied before the shuffle, so each input partition sends on only its own candidates;
    a join with the aggregated maxima would shuffle the whole table.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc(col))
    return df.filter(F.col(col).isNotNull()).withColumn("_rank", F.rank().over(w)).filter("_rank = 1").drop("_rank")


def latest_per_key_semi(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Rows at the latest time of their key; ties stay, rows without a key match nothing."""
    return _at_highest(df.na.drop(subset=keys), keys, ts)


def latest_by_max_id(df: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """The row with the highest id of every key combination."""
    return _at_highest(df, keys, id_col)


def not_whitelisted(df: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Rows whose (dbid, command) has no active whitelist entry."""
    active = whitelist.filter("status = '1'").select("dbid", "command").na.drop()
    return df.join(active, ["dbid", "command"], "left_anti")


def orphan_keys(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Target keys the source no longer has."""
    return target.select(*keys).join(source.select(*keys), keys, "left_anti")


def big_transactions(processes: DataFrame, trx: DataFrame, min_secs: int) -> DataFrame:
    """Busy sessions with an open transaction, longest first."""
    busy = processes.filter(~F.col("command").isin(*IDLE_COMMANDS) & (F.col("secs") >= min_secs))
    return (
        busy.join(trx, busy.id == trx.thread_id)
        .select("id", "host", "usr", "secs", "trx_id", "trx_state", "started", "info")
        .orderBy(F.desc("secs"), "id")
    )


def lock_waits(
    processes: DataFrame, trx: DataFrame, locks: DataFrame, waits: DataFrame, as_of: datetime, min_secs: int, part: Column | None = None
) -> DataFrame:
    """Transactions that hold or wait for locks, with whom they wait for.

    Those a transaction waits for come as one text where ``part`` is not given: for sources that bound how many there are. With
    ``part``, a step of the time ``_since``, a waiter has a row for each part of the text, in their order.
    """
    holders = trx.select(F.col("trx_id").alias("blocking_trx_id"), F.col("started").alias("_since"))
    step = [part.alias("part")] if part is not None else []
    waiters = (
        waits.join(holders, "blocking_trx_id")
        .groupBy("requesting_trx_id", *step)
        .agg(F.expr("listagg(cast(blocking_trx_id as string), '|') within group (order by _since, blocking_trx_id)").alias("_by"))
    )
    blocked = F.col("requesting_trx_id").isNotNull()
    open_secs = F.timestamp_diff("SECOND", F.col("started"), moment(as_of))
    return (
        processes.join(trx, processes.id == trx.thread_id)
        .join(locks, "trx_id")
        .join(waiters, F.col("trx_id") == F.col("requesting_trx_id"), "left")
        .withColumn("duration", F.when(blocked, F.col("secs")).otherwise(open_secs))
        .filter(F.col("duration") >= min_secs)
        .select(
            "trx_id",
            "id",
            "host",
            "usr",
            F.coalesce("_by", F.lit("")).alias("blocked_by"),
            *(["part"] if part is not None else []),
            "started",
            "duration",
            F.when(blocked, "BLOCKING").otherwise("RUNNING").alias("trx_status"),
            "tab",
            "lock_mode",
        )
        .distinct()
    )


def outer_apply(sessions: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """Sessions with their statement text where one is known."""
    return sessions.join(texts, key, "left")


def snapshot_join(stats: DataFrame, snapshots: DataFrame, users: DataFrame, texts: DataFrame) -> DataFrame:
    """Statement statistics with snapshot time, user name and text."""
    return stats.join(snapshots, ["dbid", "snap_id"]).join(users, "user_id").join(texts, ["dbid", "sql_id"])


def either_key(jobs: DataFrame, ids: DataFrame, left: str, right: str, id_col: str) -> DataFrame:
    """Pairs of (id, job) where the id is either end of the job.

    Both ends are unfolded and matched by equality; an OR condition would compare every pair.
    """
    ends = F.array_distinct(F.array(F.col(left).cast("bigint"), F.col(right).cast("bigint")))
    unfolded = jobs.withColumn("_end", F.explode(ends))
    return unfolded.join(ids, unfolded["_end"] == ids[id_col].cast("bigint")).drop("_end")


def exists_key(source: DataFrame, target: DataFrame, keys: list[str], name: str = "in_target") -> DataFrame:
    """Mark source rows whose key the target already has."""
    marks = target.select(*keys).distinct().withColumn("_hit", F.lit(True))
    return source.join(marks, keys, "left").withColumn(name, F.coalesce("_hit", F.lit(False))).drop("_hit")


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Key equality that also matches null parts."""
    cond = left[keys[0]].eqNullSafe(right[keys[0]])
    for key in keys[1:]:
        cond = cond & left[key].eqNullSafe(right[key])
    return cond
