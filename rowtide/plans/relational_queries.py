"""Queries for joins, aggregates, ordered operators, rankings and set operations (D, E, W, L, S)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rowtide.operators import aggregates as agg, joins, ordered
from rowtide.operators.numbering import number_rows
from rowtide.plans import inputs
from rowtide.plans.inputs import EVENTS_AS_OF, base, with_inputs
from rowtide.plans.registry import query
from rowtide.sources.scan import choose_time_column
from rowtide.sources.sinks import with_month


# ---- joins

@query(
    "d1_job_config",
    "select o_orderkey, c_name, n_name, r_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey",
)
def d1(spark, d):
    lookups = [(base(spark, d, "customer"), "o_custkey", "c_custkey"), (base(spark, d, "nation"), "c_nationkey", "n_nationkey"), (base(spark, d, "region"), "n_regionkey", "r_regionkey")]
    return joins.job_config(base(spark, d, "orders"), lookups).select("o_orderkey", "c_name", "n_name", "r_name")


@query("d2_left_lookup", "select l_orderkey, l_linenumber, l_partkey, p_name from lineitem left join (select * from part where p_size < 20) on l_partkey = p_partkey")
def d2(spark, d):
    small = base(spark, d, "part").filter("p_size < 20")
    return joins.left_lookup(base(spark, d, "lineitem"), small, "l_partkey", "p_partkey").select("l_orderkey", "l_linenumber", "l_partkey", "p_name")


_CODES = "select 'nation' as code_class, cast(n_nationkey as varchar) as code, n_name as label from nation union all select 'region', cast(r_regionkey as varchar), r_name from region"


@query("d3_code_lookup", f"with codes as ({_CODES}) select c_custkey, (select label from codes where code_class = 'nation' and code = cast(c_nationkey as varchar)) as nation_name from customer")
def d3(spark, d):
    nations = base(spark, d, "nation").selectExpr("'nation' as code_class", "cast(n_nationkey as string) as code", "n_name as label")
    regions = base(spark, d, "region").selectExpr("'region' as code_class", "cast(r_regionkey as string) as code", "r_name as label")
    return joins.code_lookup(base(spark, d, "customer"), nations.unionByName(regions), "c_nationkey", "nation", "nation_name").select("c_custkey", "nation_name")


@query("d4_latest_per_key_semi", with_inputs("samples") + "select server_id, ts, cpu from samples where (server_id, ts) in (select server_id, max(ts) from samples group by server_id)")
def d4(spark, d):
    return joins.latest_per_key_semi(inputs.samples(spark, d).select("server_id", "ts", "cpu"), ["server_id"], "ts")


@query("d5_latest_by_max_id", with_inputs("calls") + "select * from calls where id in (select max(id) from calls group by market_id, server_id, api_interface)")
def d5(spark, d):
    return joins.latest_by_max_id(inputs.calls(spark, d), ["market_id", "server_id", "api_interface"], "id")


# whitelist entries, drawn from the commands themselves; one in seven is switched off
_WHITELIST = "select distinct dbid, command, case when (dbid + length(command)) % 3 = 0 then '1' else '0' end as status from commands"


def _whitelist(spark, d):
    return inputs.commands(spark, d).selectExpr("dbid", "command", "case when (dbid + length(command)) % 3 = 0 then '1' else '0' end as status").distinct()


@query(
    "d6_not_whitelisted",
    with_inputs("commands") + f", wl as ({_WHITELIST}) select id, dbid, command from commands a where command not in (select command from wl b where b.dbid = a.dbid and b.status = '1')",
)
def d6(spark, d):
    return joins.not_whitelisted(inputs.commands(spark, d).select("id", "dbid", "command"), _whitelist(spark, d))


@query("d7_orphan_keys", with_inputs("orders_tgt") + "select order_id from orders_tgt where order_id not in (select order_id from orders_src)")
def d7(spark, d):
    return joins.orphan_keys(inputs.orders_tgt(spark, d), inputs.orders_src(spark, d), ["order_id"])


# transactions, locks and waits drawn from the sessions
_TRX = "trx as (select id + 1000000 as trx_id, id as thread_id, 'RUNNING' as trx_state, last_batch as started from processes where id % 3 = 0)"
_LOCKS = "locks as (select trx_id, 't' || cast(trx_id % 5 as varchar) as tab, case when trx_id % 2 = 0 then 'X' else 'S' end as lock_mode from trx)"
_WAITS = "waits as (select trx_id as requesting_trx_id, trx_id - 15 as blocking_trx_id from trx where trx_id % 2 = 0 union all select trx_id, trx_id - 30 from trx where trx_id % 4 = 0)"


def _trx(spark, d):
    return inputs.processes(spark, d).filter("id % 3 = 0").selectExpr("id + 1000000 as trx_id", "id as thread_id", "'RUNNING' as trx_state", "last_batch as started")


@query(
    "d8_big_transactions",
    with_inputs("processes") + f", {_TRX} select id, host, usr, secs, trx_id, trx_state, started, info from processes join trx on id = thread_id"
    " where command not in ('Sleep', 'Binlog Dump', 'Daemon', 'Connect', 'Binlog Dump GTID') and secs >= 20",
)
def d8(spark, d):
    return joins.big_transactions(inputs.processes(spark, d), _trx(spark, d), 20)


@query(
    "d9_lock_waits",
    with_inputs("processes") + f", {_TRX}, {_LOCKS}, {_WAITS}, e as (select requesting_trx_id, string_agg(cast(blocking_trx_id as varchar), '|' order by started, blocking_trx_id) as b"
    " from waits join trx on blocking_trx_id = trx_id group by 1),"
    " j as (select trx_id, id, host, usr, coalesce(b, '') as blocked_by, started, case when b is not null then secs else cast(floor(epoch(timestamp '2024-01-31' - started)) as bigint) end as duration,"
    " case when b is not null then 'BLOCKING' else 'RUNNING' end as trx_status, tab, lock_mode"
    " from processes join trx on id = thread_id join locks using (trx_id) left join e on trx_id = requesting_trx_id) select distinct * from j where duration >= 30",
)
def d9(spark, d):
    trx = _trx(spark, d)
    locks = trx.selectExpr("trx_id", "concat('t', cast(trx_id % 5 as string)) as tab", "case when trx_id % 2 = 0 then 'X' else 'S' end as lock_mode")
    waits = trx.filter("trx_id % 2 = 0").selectExpr("trx_id as requesting_trx_id", "trx_id - 15 as blocking_trx_id").unionByName(
        trx.filter("trx_id % 4 = 0").selectExpr("trx_id as requesting_trx_id", "trx_id - 30 as blocking_trx_id")
    )
    return joins.lock_waits(inputs.processes(spark, d), trx, locks, waits, EVENTS_AS_OF, 30)


@query("d10_outer_apply", with_inputs("processes") + "select id, usr, case when id % 4 = 0 then info end as text from processes")
def d10(spark, d):
    sessions = inputs.processes(spark, d)
    return joins.outer_apply(sessions.select("id", "usr"), sessions.filter("id % 4 = 0").selectExpr("id", "info as text"), "id")


@query(
    "d11_snapshot_join",
    "with s as (select l_suppkey % 3 as dbid, l_suppkey % 7 as user_id, l_partkey as sql_id, l_linenumber as snap_id, l_quantity as elapsed_s from lineitem),"
    " n as (select distinct dbid, snap_id, 'snap' || cast(snap_id as varchar) as begun from s), u as (select n_nationkey as user_id, n_name as username from nation),"
    " t as (select distinct dbid, sql_id, 'select ' || cast(sql_id as varchar) as sql_text from s)"
    " select dbid, sql_id, begun, username, sql_text, elapsed_s from s join n using (dbid, snap_id) join u using (user_id) join t using (dbid, sql_id)",
)
def d11(spark, d):
    stats = base(spark, d, "lineitem").selectExpr("l_suppkey % 3 as dbid", "l_suppkey % 7 as user_id", "l_partkey as sql_id", "l_linenumber as snap_id", "l_quantity as elapsed_s")
    snaps = stats.selectExpr("dbid", "snap_id", "concat('snap', cast(snap_id as string)) as begun").distinct()
    users = base(spark, d, "nation").selectExpr("cast(n_nationkey as bigint) as user_id", "n_name as username")
    texts = stats.selectExpr("dbid", "sql_id", "concat('select ', cast(sql_id as string)) as sql_text").distinct()
    return joins.snapshot_join(stats, snaps, users, texts).select("dbid", "sql_id", "begun", "username", "sql_text", "elapsed_s")


_JOBS = "jobs as (select o_orderkey as job, o_custkey % 25 as sour_db_id, o_orderkey % 25 as desc_db_id, o_orderpriority as flag from orders)"


def _jobs(spark, d):
    return base(spark, d, "orders").selectExpr("o_orderkey as job", "o_custkey % 25 as sour_db_id", "o_orderkey % 25 as desc_db_id", "o_orderpriority as flag")


@query("d12_either_key", f"with {_JOBS} select cast(n_nationkey as bigint) as db_id, job from jobs join nation on sour_db_id = n_nationkey or desc_db_id = n_nationkey")
def d12(spark, d):
    ids = base(spark, d, "nation").selectExpr("cast(n_nationkey as bigint) as db_id")
    return joins.either_key(_jobs(spark, d), ids, "sour_db_id", "desc_db_id", "db_id").select("db_id", "job")


@query("d13_exists_key", with_inputs("orders_tgt") + "select order_id, order_id in (select order_id from orders_tgt) as in_target from orders_src")
def d13(spark, d):
    return joins.exists_key(inputs.orders_src(spark, d).select("order_id"), inputs.orders_tgt(spark, d), ["order_id"])


# ---- aggregates

@query("e1_row_count", "select count(*) as row_count from lineitem where l_returnflag = 'R'")
def e1(spark, d):
    return agg.row_count(base(spark, d, "lineitem"), "l_returnflag = 'R'")


@query("e2_key_bounds", "select min(o_orderkey) as min_key, max(o_orderkey) as max_key, max(o_orderkey) - min(o_orderkey) as span, min(o_orderdate) as min_time from orders")
def e2(spark, d):
    return agg.key_bounds(base(spark, d, "orders"), "o_orderkey", "o_orderdate")


@query(
    "e3_pending_by_table",
    with_inputs("changes") + "select tbl, count(*) as pending from (select * from changes where seq > 300) group by tbl order by 2 desc, 1 limit 2",
)
def e3(spark, d):
    return agg.pending_by_table(inputs.changes(spark, d), 300, 2)


@query(
    "e4_command_summary",
    with_inputs("commands") + "select dbid, batch_id, command, round(avg(micros), 2) as avg_duration, min(start_time) as first_time, max(start_time) as last_time from commands group by 1, 2, 3",
)
def e4(spark, d):
    return agg.command_summary(inputs.commands(spark, d), ["dbid", "batch_id", "command"], "micros", "start_time")


@query(
    "e5_distinct_tuples",
    with_inputs("commands") + ", t as (select dbid, nullif(command, 'view') as command, duration, start_time from commands)"
    " select (select count(*) from (select distinct dbid, command, duration from t where command is not null)) as tuples, min(start_time) as first_time, max(start_time) as last_time from t",
)
def e5(spark, d):
    rows = inputs.commands(spark, d).withColumn("command", F.expr("nullif(command, 'view')"))
    return agg.distinct_tuples(rows, ["dbid", "command", "duration"], "start_time")


@query(
    "e6_concat_group",
    "select o_custkey, string_agg(distinct o_orderstatus, ';' order by o_orderstatus) as states from orders group by 1",
)
def e6(spark, d):
    return agg.concat_group(base(spark, d, "orders"), ["o_custkey"], "o_orderstatus", sep=";", distinct=True).withColumnRenamed("joined", "states")


@query(
    "e6_concat_group_ordered",
    "select o_custkey, cast(year(o_orderdate) as integer) as part, string_agg(cast(o_orderkey as varchar), ',' order by o_orderdate, cast(o_orderkey as varchar)) as keys from orders group by 1, 2",
)
def e6_ordered(spark, d):
    """All orders of a customer in time order, in parts of one year."""
    joined = agg.concat_group(base(spark, d, "orders"), ["o_custkey"], "o_orderkey", order="o_orderdate", chunk=F.year("o_orderdate"))
    return joined.withColumnRenamed("joined", "keys")


@query("e7_duplicate_keys", "select l_orderkey, l_linenumber, count(*) as copies from lineitem group by 1, 2 having count(*) > 1")
def e7(spark, d):
    return agg.duplicate_keys(base(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("e7_duplicate_key_count", "select count(*) as duplicate_keys from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1)")
def e7_count(spark, d):
    return agg.duplicate_key_count(base(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


_TIER = (
    "case when total_time >= 600 or avg_time >= 200 or executions >= 60 then 5 when total_time >= 400 or avg_time >= 100 or executions >= 30 then 4"
    " when total_time >= 200 or avg_time >= 50 or executions >= 10 then 3 when {second} or avg_time >= 30 or executions >= 5 then 2 else 1 end"
)
STATEMENT_STATS_SQL = (
    with_inputs("stats") + ", p as (select dbid, username, sql_id, snap, sum(executions) as executions, sum(cast(elapsed_s as decimal(20,6))) as total_time,"
    " sum(cast(rows_processed as decimal(20,6))) as rows_processed, sum(cast(disk_reads as decimal(20,6))) as disk_reads from stats group by 1, 2, 3, 4 having sum(executions) > 0),"
    " g as (select dbid, username, sql_id, cast(min(snap) as timestamp) as first_time, cast(max(snap) as timestamp) as last_time, cast(sum(executions) as bigint) as executions,"
    " cast(round(sum(total_time), 0) as double) as total_time, round(cast(sum(total_time) as double) / sum(executions), 0) as avg_time,"
    " cast(round(sum(rows_processed), 0) as double) as rows_processed, cast(round(sum(disk_reads), 0) as double) as disk_reads from p group by 1, 2, 3)"
)


@query("e8_statement_stats", STATEMENT_STATS_SQL + f" select *, {_TIER.format(second='total_time >= 100')} as priority from g")
def e8(spark, d):
    return agg.statement_stats(inputs.stats(spark, d))


@query("e9_priority_tier", STATEMENT_STATS_SQL + f" select {_TIER.format(second='total_time = 100')} as priority, count(*) as n from g group by 1")
def e9(spark, d):
    return agg.statement_stats(inputs.stats(spark, d), compat=True).groupBy("priority").agg(F.count(F.lit(1)).alias("n"))


@query(
    "e10_usage_ratio",
    "with t as (select l_suppkey as k, sum(l_quantity) as total from lineitem group by 1), f as (select l_suppkey as k, sum(l_quantity) as free from lineitem where l_returnflag = 'R' group by 1)"
    " select k, round((total - free) / total, 4) * 100 as usage from t join f using (k)",
)
def e10(spark, d):
    lines = base(spark, d, "lineitem")
    total = lines.selectExpr("l_suppkey as k", "l_quantity as total")
    return agg.usage_ratio(total, lines.filter("l_returnflag = 'R'").selectExpr("l_suppkey as k", "l_quantity as free"), "k")


@query(
    "e11_ops_by_interval",
    with_inputs("changes") + "select date_trunc('hour', ts)::timestamp as window_start, count(*) as event_amount, count(*) filter (op = 'insert') as insert_amount,"
    " count(*) filter (op = 'update') as update_amount, count(*) filter (op = 'delete') as delete_amount, count(*) filter (op = 'ddl') as ddl_amount from changes group by 1",
)
def e11(spark, d):
    return agg.ops_by_interval(inputs.changes(spark, d), 3600)


@query("e12_group_as_distinct", with_inputs("commands") + "select dbid, command, duration, max(create_time)::timestamp as create_time from commands group by 1, 2, 3")
def e12(spark, d):
    return agg.group_as_distinct(inputs.commands(spark, d), ["dbid", "command", "duration"], "create_time")


@query("e13_max_map_value", "select event_id, cast(json_extract(props, '$.k') as double) as largest from events")
def e13(spark, d):
    return base(spark, d, "events").select("event_id", agg.max_map_value(F.col("props")).alias("largest"))


@query(
    "e14_effect_range",
    f"with {_JOBS}, p as (select cast(n_nationkey as bigint) as db_id, flag, count(*) as times from jobs join nation on sour_db_id = n_nationkey or desc_db_id = n_nationkey group by 1, 2)"
    " select db_id, string_agg(flag || ':' || cast(times as varchar), ',' order by flag || ':' || cast(times as varchar)) as effect from p group by 1",
)
def e14(spark, d):
    ids = base(spark, d, "nation").selectExpr("cast(n_nationkey as bigint) as db_id")
    return agg.effect_range(joins.either_key(_jobs(spark, d), ids, "sour_db_id", "desc_db_id", "db_id"), "db_id", "flag")


@query("e15_run_totals", "select o_orderpriority as tag, cast(sum(o_custkey) as bigint) as amount, cast(sum(o_orderkey % 60) as bigint) as duration from orders group by 1")
def e15(spark, d):
    return agg.run_totals(base(spark, d, "orders").selectExpr("o_orderpriority as tag", "o_custkey as moved", "o_orderkey % 60 as seconds"))


@query("e16_progress", "select o_orderkey, round((o_orderkey % 7) / greatest(o_custkey % 9, 1) * 100, 2) as percent from orders")
def e16(spark, d):
    return base(spark, d, "orders").select("o_orderkey", agg.progress(F.expr("o_orderkey % 7"), F.expr("o_custkey % 9")).alias("percent"))


_RAW_COUNTERS = (
    "select user_id % 20 as server_id, case event_id % 4 when 0 then 'uptime' when 1 then 'commits' when 2 then 'rollbacks' else 'questions' end as counter, event_id % 1000 + 1 as value from events"
)


@query(
    "e17_rate_from_uptime",
    f"with c as ({_RAW_COUNTERS}), w as (select server_id, sum(value) filter (counter = 'uptime') as u, sum(value) filter (counter = 'commits') as c, sum(value) filter (counter = 'rollbacks') as r,"
    " sum(value) filter (counter = 'questions') as q from c group by 1)"
    " select server_id, round((coalesce(c, 0) + coalesce(r, 0)) / u, 2) as tps, round(q / u, 2) as qps from w",
)
def e17(spark, d):
    return agg.rate_from_uptime(base(spark, d, "events").selectExpr(*_columns(_RAW_COUNTERS)), "server_id")


_RAW_OPS = (
    "select user_id % 20 as server_id, case event_id % 5 when 0 then 'uptime' when 1 then 'insert' when 2 then 'update' when 3 then 'delete' else 'query' end as counter, event_id % 1000 + 1 as value from events"
)


@query(
    "e17_opcounter_rate",
    f"with c as ({_RAW_OPS}), w as (select server_id, sum(value) filter (counter = 'uptime') as u, coalesce(sum(value) filter (counter in ('insert', 'update', 'delete')), 0) as w,"
    " sum(value) filter (counter = 'query') as q from c group by 1) select server_id, round(w / u, 2) as tps, round(q / u, 2) as qps from w",
)
def e17_opcounter(spark, d):
    return agg.opcounter_rate(base(spark, d, "events").selectExpr(*_columns(_RAW_OPS)), "server_id")


def _columns(select: str) -> list[str]:
    body = select[len("select "): select.rindex(" from ")]
    return [c.strip() for c in body.split(", ")]


@query("e18_connection_counts", with_inputs("processes") + "select usr, count(*) as total_connect, count(*) filter (command <> 'Sleep') as active_connect from processes group by 1")
def e18(spark, d):
    return agg.connection_counts(inputs.processes(spark, d), "usr")


# ---- ordered operators

@query(
    "w1_number_rows",
    with_inputs("commands") + "select row_number() over (order by dbid, command, duration) as xh, * from (select dbid, command, duration, max(create_time)::timestamp as create_time from commands group by 1, 2, 3)",
)
def w1(spark, d):
    listed = agg.group_as_distinct(inputs.commands(spark, d), ["dbid", "command", "duration"], "create_time")
    return number_rows(listed, ["dbid", "command", "duration"], "xh", unique=True)


@query(
    "w2_last_change_per_key",
    with_inputs("changes") + "select tbl, op, pk, file_no, pos, seq, val, kind, merged, first_id from (select *, row_number() over (partition by tbl, op, pk order by file_no desc, pos desc, seq desc) as rn,"
    " count(*) over (partition by tbl, op, pk) as merged, min(seq) over (partition by tbl, op, pk) as first_id from changes) where rn = 1",
)
def w2(spark, d):
    return ordered.last_change_per_key(inputs.changes(spark, d), ["tbl", "op", "pk"]).select("tbl", "op", "pk", "file_no", "pos", "seq", "val", "kind", "merged", "first_id")


@query(
    "w3_runs",
    with_inputs("changes") + ", m as (select *, case when lag(op) over w is not distinct from op then 0 else 1 end as c from changes window w as (partition by tbl order by file_no, pos, seq)),"
    " r as (select *, sum(c) over (partition by tbl order by file_no, pos, seq rows unbounded preceding) as run_no from m),"
    " g as (select tbl, cast(run_no as bigint) as run_no, op, count(*) as n, min(seq) as first_id, max(seq) as last_id from r group by 1, 2, 3)"
    " select tbl, run_no, 0 as part, case when op = 'update' then 'delete' else op end as statement, n, first_id, last_id from g"
    " union all select tbl, run_no, 1, 'insert', n, first_id, last_id from g where op = 'update'",
)
def w3(spark, d):
    return ordered.runs(inputs.changes(spark, d))


@query(
    "w4_counter_delta",
    with_inputs("counters") + ", l as (select *, bytes - lag(bytes) over w as g, ts - lag(ts) over w as dt from counters window w as (partition by server_id order by sample_id))"
    " select server_id, ts, sample_id, bytes, case when g >= 0 then g end as delta, case when g >= 0 then g / nullif(cast(trunc(epoch(dt)) as bigint), 0) end as per_second from l",
)
def w4(spark, d):
    return ordered.counter_delta(inputs.counters(spark, d), ["server_id"], "bytes", ["sample_id"], "ts", chunk=F.expr("cast(floor(sample_id / 500.0) as bigint)"))


STREAKS_SQL = (
    with_inputs("samples") + ", o as (select sample_id, server_id, ts, cpu <= 40 as ok from samples),"
    " n as (select *, row_number() over (partition by server_id order by ts, sample_id) as rn from o),"
    " s as (select *, coalesce(max(case when ok then rn end) over w, 0) as lo, max(case when not ok then rn end) over w as lf,"
    " coalesce(max(case when ok then rn end) over (partition by server_id order by rn rows between unbounded preceding and 1 preceding), 0) as lob"
    " from n window w as (partition by server_id order by rn rows unbounded preceding)),"
    " e as (select *, max(case when ok then lob end) over (partition by server_id order by rn rows unbounded preceding) as l2 from s),"
    " t as (select sample_id, server_id, ts, ok, lf is not null as recorded, case when ok then 0 else rn - lo end as fail_times, case when ok then coalesce(rn - lf, 0) else 0 end as succ_times,"
    " case when not ok then min(ts) over (partition by server_id, lo, ok) end as first_failure_time,"
    " case when lo > 0 then lo - 1 - l2 else 0 end as ended_streak from e)"
)


# a back-fill: a third of all samples has one time
_BACKFILL = "case when sample_id % 3 = 0 then timestamp '2024-01-09 00:00:00' else ts end as ts"


def _backfilled(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ts", F.when(F.col("sample_id") % 3 == 0, F.lit("2024-01-09 00:00:00").cast("timestamp_ntz")).otherwise(F.col("ts")))


@query(
    "w4_even_chunks",
    with_inputs("counters") + f", b as (select * replace ({_BACKFILL}) from counters), l as (select *, bytes - lag(bytes) over w as g, ts - lag(ts) over w as dt from b window w as (partition by server_id order by ts, sample_id))"
    " select server_id, ts, sample_id, bytes, case when g >= 0 then g end as delta, case when g >= 0 then g / nullif(cast(trunc(epoch(dt)) as bigint), 0) end as per_second from l",
)
def w4_even(spark, d):
    order = ["ts", "sample_id"]
    pieces = ordered.even_chunks(_backfilled(inputs.counters(spark, d)), ["server_id"], order, "piece")
    return ordered.counter_delta(pieces, ["server_id"], "bytes", order, "ts", chunk=F.col("piece")).drop("piece")


@query("w5_even_chunks", STREAKS_SQL.replace("ts, cpu <= 40 as ok from samples", _BACKFILL + ", cpu <= 40 as ok from samples") + " select * from t")
def w5_even(spark, d):
    order = ["ts", "sample_id"]
    samples = _backfilled(inputs.samples(spark, d).select("sample_id", "server_id", "ts", "cpu"))
    pieces = ordered.even_chunks(samples, ["server_id"], order, "piece")
    return ordered.streaks(pieces, ["server_id"], F.col("cpu") <= 40, order, "ts", chunk=F.col("piece")).drop("cpu", "piece")


@query("w5_fail_streak", STREAKS_SQL + " select * from t")
def w5(spark, d):
    samples = inputs.samples(spark, d).select("sample_id", "server_id", "ts", "cpu")
    return ordered.streaks(samples, ["server_id"], F.col("cpu") <= 40, ["ts", "sample_id"], "ts").drop("cpu")


# ---- rankings and sets

@query("l1_top_statements", STATEMENT_STATS_SQL + " select dbid, username, sql_id, avg_time, disk_reads from g order by avg_time desc, disk_reads desc, dbid, username, sql_id limit 20")
def l1(spark, d):
    return agg.top_statements(agg.statement_stats(inputs.stats(spark, d))).select("dbid", "username", "sql_id", "avg_time", "disk_reads")


@query(
    "l2_top_sessions",
    with_inputs("processes") + ", s as (select id, secs, id % 13 as physical_io from processes)"
    " select * from (select 'longest' as form, * from s order by secs desc, physical_io desc, id limit 20) union all select * from (select 'shortest', * from s order by secs, physical_io desc, id limit 20)",
)
def l2(spark, d):
    sessions = inputs.processes(spark, d).selectExpr("id", "secs", "id % 13 as physical_io")
    longest = agg.top_sessions(sessions).withColumn("form", F.lit("longest"))
    return longest.unionByName(agg.top_sessions(sessions, compat=True).withColumn("form", F.lit("shortest")))


@query("l3_next_batch", with_inputs("changes") + "select seq, tbl, op, pk from changes where seq > 400 order by seq limit 250")
def l3(spark, d):
    return agg.next_batch(inputs.changes(spark, d), 400, 250).select("seq", "tbl", "op", "pk")


@query("l4_first_datetime_column", "select 'update_time' as time_column, strftime(o_orderdate, '%Y%m') as yyyymm, count(*) as rows from orders where o_orderkey % 3 <> 0 group by 2")
def l4(spark, d):
    """No time column is free of nulls here, so the first indexed one by name is taken."""
    late = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate"))
    df = base(spark, d, "orders").select(late.alias("closed_at"), late.alias("update_dt"), late.alias("update_time"), late.alias("create_time"))
    chosen = choose_time_column(df.schema, {"closed_at", "update_dt", "update_time"})
    kept = with_month(df.filter(F.col(chosen).isNotNull()), chosen)
    return kept.groupBy(F.lit(chosen).alias("time_column"), "yyyymm").agg(F.count(F.lit(1)).alias("rows"))


@query("s1_difference", with_inputs("orders_tgt") + "select order_id, status, amount from orders_src except select order_id, status, amount from orders_tgt")
def s1(spark, d):
    cols = ["order_id", "status", "amount"]
    return agg.difference(inputs.orders_src(spark, d).select(*cols), inputs.orders_tgt(spark, d).select(*cols))


@query("s2_union_keys", with_inputs("changes") + "select tbl, pk from changes where op = 'insert' union all select tbl, pk from changes where op = 'delete'")
def s2(spark, d):
    log = inputs.changes(spark, d)
    return agg.union_keys([log.filter("op = 'insert'"), log.filter("op = 'delete'")], ["tbl", "pk"])


@query("s3_distinct_schemas", with_inputs("changes") + "select distinct split_part(case when seq % 2 = 0 then tbl else 'crm' || substring(tbl, 4) end, '.', 1) as schema_name from changes")
def s3(spark, d):
    log = inputs.changes(spark, d).withColumn("tbl", F.expr("case when seq % 2 = 0 then tbl else concat('crm', substring(tbl, 4)) end"))
    return agg.distinct_schemas(log)
