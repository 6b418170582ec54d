"""Metric checks and the alert state."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rowtide.functions.timing import minutes_between, moment, seconds_between
from rowtide.operators.joins import latest_by_max_id, latest_per_key_semi
from rowtide.operators.ordered import streaks
from rowtide.session import sql_over
from rowtide.specs import SERVER_RULE, AlertRule


def availability(samples: DataFrame, as_of: datetime, mins: int = 3, key: str = "server_id", ts: str = "ts") -> DataFrame:
    """M1: '0' for a server whose latest sample is older than ``mins`` minutes, else '100'."""
    last = latest_per_key_semi(samples.select(key, ts), [key], ts)
    late = minutes_between(F.col(ts), moment(as_of)) > mins
    return last.select(key, ts, F.lit("server_available").alias("index_code"), F.when(late, "0").otherwise("100").alias("index_value"))


def unpivot_metrics(samples: DataFrame, ids: list[str], metrics: dict[str, str]) -> DataFrame:
    """One row per sample and metric; ``metrics`` maps column to index code."""
    wide = samples.select(*ids, *[F.col(c).cast("double").alias(code) for c, code in metrics.items()])
    return wide.unpivot(ids, list(metrics.values()), "index_code", "index_value")


def with_breach(values: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Mark values above ``threshold * 100``; an index without a threshold is held against zero."""
    joined = values.join(thresholds, "index_code", "left")
    limit = F.coalesce("index_threshold", F.lit(0.0)) * 100
    return joined.withColumn("breach", F.coalesce(F.col("index_value") > limit, F.lit(False))).drop("index_threshold")


def breaches(samples: DataFrame, thresholds: DataFrame, metrics: dict[str, str], key: str = "server_id", ts: str = "ts") -> DataFrame:
    """M2: the latest values of every server that are above their threshold."""
    last = latest_per_key_semi(samples, [key], ts)
    return with_breach(unpivot_metrics(last, [key, ts], metrics), thresholds).filter("breach").drop("breach")


def sent_times(fails: Column, rule: AlertRule) -> Column:
    """Notifications sent in a streak of this length: the first after ``rule.first`` failures, then the repeats."""
    start = rule.first + 1
    repeats = F.floor(fails / rule.every) - (rule.first // rule.every)
    first_is_repeat = 1 if start % rule.every == 0 else 0
    total = repeats + 1 - first_is_repeat
    return F.when(fails < start, 0).otherwise(F.least(total, F.lit(rule.cap + 1))).cast("bigint")


def alert_state(
    samples: DataFrame, keys: list[str], ok: Column, order: list[str], ts: str, rule: AlertRule = SERVER_RULE, chunk: Column | None = None,
    since: DataFrame | None = None,
) -> DataFrame:
    """M3-M5: state of every check after each sample, and what it sends (``emit``: alert, recovery or null).

    Failures and successes are runs of equal results, and everything the state holds follows from the lengths of
    the current and the last run; so the state machine is a prefix scan, not a fold in one task per key. ``since``
    is the last row per key of the samples before these.
    """
    if rule.recover_at != 1:
        raise ValueError("rules that recover later than the first success are followed by the stream's keyed state only")
    run = streaks(samples, keys, ok, order, ts, chunk, since).filter("recorded")
    fails = F.col("fail_times")
    sends = (fails == rule.first + 1) | ((fails > rule.first + 1) & (fails % rule.every == 0) & (sent_times(fails - 1, rule) <= rule.cap))
    recovers = F.col("ok") & (F.col("succ_times") == 1) & (F.col("ended_streak") > rule.first)
    return (
        run.withColumn("is_send_alt_mail", F.when(fails > rule.first, "Y").otherwise("N"))
        .withColumn("is_send_alt_mail_times", F.when(F.col("ok"), F.lit(0)).otherwise(sent_times(fails, rule)).cast("bigint"))
        .withColumn("emit", F.when(~F.col("ok") & sends, "alert").when(recovers, "recovery"))
        .withColumn("is_send_rcv_mail", F.when(F.col("ended_streak") > rule.first, "Y").otherwise("N"))
        .drop("recorded")
    )


def alert_emit(state: DataFrame) -> DataFrame:
    """M4: the notifications."""
    return state.filter("emit = 'alert'")


def alert_recover(state: DataFrame) -> DataFrame:
    """M5: the recoveries."""
    return state.filter("emit = 'recovery'")


def sends_each_failure(fails_before: Column, limit: int = 3) -> Column:
    """M4, database form: a failure notifies while fewer than ``limit`` were counted before it."""
    return fails_before.between(0, limit - 1)


def service_status(services: DataFrame, envs: DataFrame, as_of: datetime, network_secs: int = 300) -> DataFrame:
    """M6: faults in 'flag@db@time,...' texts: a production service that is down, or a state too old to trust."""
    parts = services.select("server_id", F.explode(F.split("service_service", ",")).alias("_s")).select(
        "server_id", F.split("_s", "@").alias("_p")
    )
    rows = parts.select(
        "server_id", F.col("_p")[0].alias("flag"), F.col("_p")[1].alias("db_id"), F.try_to_timestamp(F.col("_p")[2], F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz").alias("seen_at")
    )
    age = seconds_between(F.col("seen_at"), moment(as_of))
    fault = F.when((F.col("flag") == "0") & (F.col("db_env") == "1"), "service").when((F.col("flag") == "1") & (age > network_secs), "network")
    return rows.join(envs, "db_id", "left").withColumn("fault", fault).filter("fault is not null").select("server_id", "db_id", "seen_at", "fault")


def api_silence(log: DataFrame, as_of: datetime, keys: list[str], id_col: str, ts: str, mins: int = 3) -> DataFrame:
    """M7: 500 for an interface whose latest row is at least ``mins`` minutes old, else 200."""
    last = latest_by_max_id(log.select(*keys, id_col, ts), keys, id_col)
    late = minutes_between(F.col(ts), moment(as_of)) >= mins
    return last.select(*keys, id_col, ts, F.when(late, "500").otherwise("200").alias("api_status"))


def probe_status(probes: DataFrame, limit_ms: float, keys: list[str], attempt: str = "attempt", most: int | None = None) -> DataFrame:
    """M8: recorded status of each probe. Slow answers become 408 and may be tried again, ``most`` times if given.

    ``probes`` has ``code`` (text of the answer's code, null if unreachable) and ``ms``; attempts behind the first
    answer that was not slow do not happen.
    """
    code = F.expr("try_cast(code as int)")
    slow = F.coalesce((code == 200) & (F.col("ms") > limit_ms), F.lit(False))
    status = F.when(F.col("code").isNull(), 202).when(code.isNull(), 201).when(slow, 408).otherwise(code)
    tried = probes if most is None else probes.filter(F.col(attempt) <= most)
    rated = tried.withColumn("_slow", slow).withColumn("api_status", status)
    settled = rated.filter(~F.col("_slow")).groupBy(*keys).agg(F.min(attempt).alias("_settled"))
    return rated.join(settled, keys, "left").filter(F.col("_settled").isNull() | (F.col(attempt) <= F.col("_settled"))).select(
        *keys, attempt, "api_status", F.when(F.col("api_status").isin(201, 202), 0.0).otherwise(F.col("ms")).alias("response_time")
    )


def sql_check(spark: SparkSession, sql: str, views: dict[str, DataFrame]) -> DataFrame:
    """The rows of a check query as texts joined by ' | ' under their header line; no rows give 'no data'."""
    result = sql_over(spark, sql, views)
    line = F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in result.columns])
    rows = result.select(F.lit(" | ".join(result.columns)).alias("header"), line.alias("line"))
    empty = spark.range(1).filter(~rows.select(F.lit(1)).limit(1).exists()).select(F.lit("").alias("header"), F.lit("no data").alias("line"))
    return rows.unionByName(empty)


def route_alert(alerts: DataFrame, servers: DataFrame, receivers: DataFrame) -> DataFrame:
    """The receiver of each alert, by the project of its server."""
    return alerts.join(servers.select("server_id", "project"), "server_id").join(receivers.select("project", "receiver"), "project", "left")


def template_items(items: DataFrame, template: DataFrame) -> DataFrame:
    """Active metrics of a template; ``items`` has index_code and status, ``template`` index_code."""
    return items.filter("status = '1'").join(template.select("index_code"), "index_code", "left_semi")
