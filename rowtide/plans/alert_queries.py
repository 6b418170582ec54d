"""Queries for metric checks and alerts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from rowtide.functions.timing import readable_duration
from rowtide.operators import alerts
from rowtide.plans import inputs
from rowtide.plans.inputs import EVENTS_AS_OF, base, with_inputs
from rowtide.plans.registry import query
from rowtide.plans.relational_queries import STREAKS_SQL
from rowtide.session import scratch_path
from rowtide.specs import SERVER_RULE, AlertRule, api_rule
from rowtide.streaming import alerts as streaming
from rowtide.streaming.changes import buffer_changes

NIGHT = datetime(2024, 1, 30, 23, 59)


@query(
    "m1_availability",
    with_inputs("samples") + ", l as (select server_id, max(ts) as ts from samples group by 1) select server_id, ts, 'server_available' as index_code,"
    " case when trunc(epoch(timestamp '2024-01-30 23:59:00' - ts) / 60) > 180 then '0' else '100' end as index_value from l",
)
def m1(spark, d):
    return alerts.availability(inputs.samples(spark, d), NIGHT, 180)


def _thresholds(spark):
    return spark.createDataFrame([("cpu_total_usage", 0.3), ("disk_usage", 0.6)], "index_code string, index_threshold double")


def _wide(spark, d):
    from rowtide.operators.aggregates import max_map_value

    return inputs.samples(spark, d).select("server_id", "ts", "cpu", (F.col("cpu") / 2).alias("mem"), max_map_value(F.col("disk_json")).alias("disk"))


@query(
    "m2_breaches",
    with_inputs("samples") + ", l as (select * from samples where (server_id, ts) in (select server_id, max(ts) from samples group by 1)),"
    " v as (select server_id, ts, 'cpu_total_usage' as index_code, cpu as index_value, 0.3 as t from l union all select server_id, ts, 'mem_usage', cpu / 2, 0 from l"
    " union all select server_id, ts, 'disk_usage', cast(json_extract(disk_json, '$.k') as double), 0.6 from l)"
    " select server_id, ts, index_code, index_value from v where index_value > t * 100",
)
def m2(spark, d):
    metrics = {"cpu": "cpu_total_usage", "mem": "mem_usage", "disk": "disk_usage"}
    return alerts.breaches(_wide(spark, d), _thresholds(spark), metrics)


# a failing check is one above 40; the rule is kept short so that repeats, the cap and recoveries all occur
RULE = AlertRule(first=1, every=2, cap=2)
_STATE = (
    ", r as (select * from t where recorded), q as (select *, case when fail_times < 2 then 0 else least(fail_times // 2, 3) end as sent, case when fail_times < 3 then 0 else least((fail_times - 1) // 2, 3) end as sent_before from r)"
    ", state as (select sample_id, server_id, ts, ok, fail_times, succ_times, first_failure_time, case when fail_times > 1 then 'Y' else 'N' end as is_send_alt_mail,"
    " case when ok then 0 else sent end as is_send_alt_mail_times, case when not ok and (fail_times = 2 or (fail_times > 2 and fail_times % 2 = 0 and sent_before <= 2)) then 'alert'"
    " when ok and succ_times = 1 and ended_streak > 1 then 'recovery' end as emit, case when ended_streak > 1 then 'Y' else 'N' end as is_send_rcv_mail from q)"
)


STATE = ["sample_id", "server_id", "ts", "ok", "fail_times", "succ_times", "first_failure_time", "is_send_alt_mail", "is_send_alt_mail_times", "emit", "is_send_rcv_mail"]


def _state(spark, d, rule=RULE):
    samples = inputs.samples(spark, d).select("sample_id", "server_id", "ts", "cpu")
    return alerts.alert_state(samples, ["server_id"], F.col("cpu") <= 40, ["ts", "sample_id"], "ts", rule).select(*STATE)


@query("m3_alert_state", STREAKS_SQL + _STATE + " select * from state")
def m3(spark, d):
    return _state(spark, d)


@query("m3_alert_state_stream", STREAKS_SQL + _STATE + " select * from state")
def m3_stream(spark, d):
    """The same rows from the stateful stream."""
    return _streamed(spark, d, RULE)


@query("m3_alert_state_batches", STREAKS_SQL + _STATE + " select * from state")
def m3_batches(spark, d):
    """The same rows from a stream whose batches are followed in even pieces."""
    return _followed(spark, _samples(spark, d), RULE)


def _followed(spark, stream, rule):
    path = scratch_path(spark, "alerting")
    streaming.start_alerts(stream, ["server_id"], "ts", "sample_id", rule, path, f"{path}-ck").awaitTermination()
    return streaming.read_alerts(spark, path, ["server_id"], "sample_id").select(*STATE)


def _late_samples(spark, d):
    """The samples as three files read one by one: some days, the days after them, and last what comes late from all days."""
    path, rows = scratch_path(spark, "sample-files"), inputs.samples(spark, d).select("sample_id", "server_id", "ts", "cpu")
    late = F.col("sample_id") % 23 == 0
    for part in (~late & (F.dayofmonth("ts") <= 12), ~late & (F.dayofmonth("ts") > 12), late):
        rows.filter(part).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return stream.withColumn("ok", F.col("cpu") <= 40)


@query("m3_alert_state_late", STREAKS_SQL + _STATE + " select * from state")
def m3_late(spark, d):
    """The same rows although every 23rd sample comes days late: what follows from it is worked out again."""
    return _followed(spark, _late_samples(spark, d), RULE)


def _samples(spark, d):
    schema = base(spark, d, "events").schema
    # as a pattern the path may be a file or a folder
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(f"{d}/events.parque[t]")
    return events.selectExpr(*inputs.SAMPLES).withColumn("ok", F.col("cpu") <= 40)


def _streamed(spark, d, rule):
    before = streaming.use_rocksdb(spark)
    out = scratch_path(spark, "alerts")
    state = streaming.alert_stream(_samples(spark, d), ["server_id"], "ts", "sample_id", rule)
    buffer_changes(state, out, f"{out}-ck").awaitTermination()
    spark.conf.set(streaming.STATE_STORE_CONF, before)
    return spark.read.parquet(out)


@query("m4_alert_emit", STREAKS_SQL + _STATE + " select server_id, sample_id, fail_times, is_send_alt_mail_times from state where emit = 'alert'")
def m4(spark, d):
    return alerts.alert_emit(_state(spark, d)).select("server_id", "sample_id", "fail_times", "is_send_alt_mail_times")


@query("m4_database_emit", STREAKS_SQL + " select server_id, sample_id, fail_times from t where not ok and fail_times - 1 between 0 and 2")
def m4_database(spark, d):
    state = _state(spark, d, SERVER_RULE)
    return state.filter(~F.col("ok") & alerts.sends_each_failure(F.col("fail_times") - 1)).select("server_id", "sample_id", "fail_times")


@query("m5_alert_recover", STREAKS_SQL + _STATE + " select server_id, sample_id, ts from state where emit = 'recovery'")
def m5(spark, d):
    return alerts.alert_recover(_state(spark, d)).select("server_id", "sample_id", "ts")


@query(
    "m6_service_status",
    "with e as (select event_id, user_id % 20 as server_id, case when event_type = 'error' then '0' else '1' end as flag, cast(user_id % 25 as varchar) as db_id, date_trunc('second', ts)::timestamp as seen_at from events),"
    " x as (select e.*, case when n_nationkey % 2 = 0 then '1' else '2' end as db_env from e join nation on db_id = cast(n_nationkey as varchar)),"
    " f as (select *, case when flag = '0' and db_env = '1' then 'service' when flag = '1' and timestamp '2024-01-30 23:59:00' - seen_at > interval 20 day then 'network' end as fault from x)"
    " select server_id, db_id, seen_at, fault from f where fault is not null",
)
def m6(spark, d):
    flag = F.when(F.col("event_type") == "error", "0").otherwise("1")
    part = F.concat_ws("@", flag, (F.col("user_id") % 25).cast("string"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    services = base(spark, d, "events").select((F.col("user_id") % 20).alias("server_id"), F.concat(part).alias("service_service"))
    envs = base(spark, d, "nation").selectExpr("cast(n_nationkey as string) as db_id", "case when n_nationkey % 2 = 0 then '1' else '2' end as db_env")
    return alerts.service_status(services, envs, NIGHT, 20 * 86400)


@query(
    "m7_api_silence",
    with_inputs("calls") + ", l as (select * from calls where id in (select max(id) from calls group by market_id, server_id, api_interface))"
    " select market_id, server_id, api_interface, id, update_time, case when trunc(epoch(timestamp '2024-01-30 23:59:00' - update_time) / 60) >= 1440 then '500' else '200' end as api_status from l",
)
def m7(spark, d):
    return alerts.api_silence(inputs.calls(spark, d), NIGHT, ["market_id", "server_id", "api_interface"], "id", "update_time", 1440)


_PROBES = (
    "p as (select cast(floor(event_id / 4.0) as bigint) as probe, event_id % 4 + 1 as attempt, case when event_type = 'error' then 'x' when event_type = 'signup' then null when event_type = 'click' then '500' else '200' end as code, value * 10 as ms from events)"
)


@query(
    "m8_probe_status",
    f"with {_PROBES}, r as (select *, coalesce(code = '200' and ms > 300, false) as slow from p), s as (select probe, min(attempt) as s from r where not slow group by 1)"
    " select r.probe, attempt, case when code is null then 202 when code = 'x' then 201 when slow then 408 else cast(code as integer) end as api_status,"
    " case when code is null or code = 'x' then 0.0 else ms end as response_time from r left join s on r.probe = s.probe where s.s is null or attempt <= s.s",
)
def m8(spark, d):
    probes = base(spark, d, "events").selectExpr(
        "cast(floor(event_id / 4.0) as bigint) as probe", "event_id % 4 + 1 as attempt",
        "case when event_type = 'error' then 'x' when event_type = 'signup' then null when event_type = 'click' then '500' else '200' end as code", "value * 10 as ms",
    )
    return alerts.probe_status(probes, 300, ["probe"])


# the state machine step by step: one recursion per sample of a server
_API_FOLD = (
    with_inputs("samples").replace("with ", "with recursive ", 1)
    + ", o as (select sample_id, server_id, ts, cpu <= 40 as ok, row_number() over (partition by server_id order by ts, sample_id) as rn from samples),"
    " f as (select server_id, 0::bigint as rn, null::bigint as sample_id, null::timestamp as ts, true as ok, 0::bigint as fails, 0::bigint as succs, null::timestamp as began, false as sent, 0::bigint as times,"
    " false as known, false as recovered, null::varchar as emit from (select distinct server_id from o)"
    " union all select o.server_id, o.rn, o.sample_id, o.ts, o.ok, case when o.ok then 0 else fails + 1 end, case when o.ok and known then succs + 1 else 0 end,"
    " case when not o.ok then coalesce(began, o.ts) end, case when o.ok then sent and succs + 1 <> 2 else sent or fails + 1 > 1 end,"
    " case when o.ok then 0 when (not sent and fails + 1 > 1) or (sent and (fails + 1) % 3 = 0 and times <= 10) then times + 1 else times end, known or not o.ok,"
    " case when o.ok then known and sent and succs + 1 = 2 else recovered end,"
    " case when o.ok and known and sent and succs + 1 = 2 then 'recovery' when not o.ok and ((not sent and fails + 1 > 1) or (sent and (fails + 1) % 3 = 0 and times <= 10)) then 'alert' end"
    " from f join o on o.server_id = f.server_id and o.rn = f.rn + 1)"
    " select server_id, sample_id, ts, ok, fails as fail_times, succs as succ_times, began as first_failure_time, case when sent then 'Y' else 'N' end as is_send_alt_mail,"
    " times as is_send_alt_mail_times, case when recovered then 'Y' else 'N' end as is_send_rcv_mail, emit from f where known"
)


@query("m9_api_alert_stream", _API_FOLD)
def m9(spark, d):
    """API rule: a recovery needs two successes, so one good answer does not end an alert."""
    return _streamed(spark, d, api_rule(200))


@query("m9_api_alert_late", _API_FOLD)
def m9_late(spark, d):
    """The API rule over several batches with late samples, no key in one worker."""
    return _followed(spark, _late_samples(spark, d), api_rule(200))


@query(
    "m10_sql_check",
    "select 'status | n | total' as header, o_orderstatus || ' | ' || cast(count(*) as varchar) || ' | ' || cast(cast(sum(o_custkey) as bigint) as varchar) as line from orders group by o_orderstatus"
    " union all select '', 'no data'",
)
def m10(spark, d):
    orders = {"checked_orders": base(spark, d, "orders")}
    found = alerts.sql_check(spark, "select o_orderstatus as status, count(*) as n, sum(o_custkey) as total from checked_orders group by 1", orders)
    return found.unionByName(alerts.sql_check(spark, "select o_orderkey from checked_orders where o_orderkey < 0", orders))


@query(
    "m11_readable_duration",
    "with s as (select event_id, cast(trunc(epoch(timestamp '2024-01-31' - ts)) as bigint) as s from events) select event_id, cast(s // 3600 as varchar) || 'h' || cast(s % 3600 // 60 as varchar) || 'm' || cast(s % 60 as varchar) || 's' as text from s",
)
def m11(spark, d):
    from rowtide.operators.filters import with_age

    return with_age(base(spark, d, "events"), "ts", EVENTS_AS_OF).select("event_id", readable_duration(F.col("age_secs")).alias("text"))


@query(
    "m12_route_alert",
    with_inputs("samples") + " select sample_id, server_id, n_nationkey % 5 as project, case when n_nationkey % 5 < 4 then r_name end as receiver from samples join nation on server_id = n_nationkey join region on n_nationkey % 5 = r_regionkey where cpu > 90",
)
def m12(spark, d):
    hot = inputs.samples(spark, d).filter("cpu > 90").select("sample_id", "server_id")
    servers = base(spark, d, "nation").selectExpr("cast(n_nationkey as bigint) as server_id", "n_nationkey % 5 as project")
    receivers = base(spark, d, "region").filter("r_regionkey < 4").selectExpr("r_regionkey as project", "r_name as receiver")
    return alerts.route_alert(hot, servers, receivers)


@query("m13_template_items", "select p_partkey, p_brand as index_code, '1' as status from part where p_size % 2 = 1 and p_brand in (select p_brand from part where p_size = 50)")
def m13(spark, d):
    parts = base(spark, d, "part")
    items = parts.selectExpr("p_partkey", "p_brand as index_code", "case when p_size % 2 = 1 then '1' else '0' end as status")
    return alerts.template_items(items, parts.filter("p_size = 50").selectExpr("p_brand as index_code"))
