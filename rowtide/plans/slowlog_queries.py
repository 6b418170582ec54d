"""Queries for slow statement logs and reports."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, functions as F

from rowtide.functions.timing import report_range
from rowtide.operators import slowlog
from rowtide.operators.aggregates import statement_stats
from rowtide.operators.numbering import number_rows
from rowtide.plans import inputs
from rowtide.plans.inputs import EVENTS_AS_OF, base, with_inputs
from rowtide.plans.registry import query
from rowtide.plans.relational_queries import STATEMENT_STATS_SQL, _WHITELIST, _whitelist
from rowtide.plans.reports import report_log, run_report
from rowtide.session import scratch_path
from rowtide.specs import ReportSpec

_SECS = "cast(value as decimal(12,2))"


def render_blocks(events: DataFrame) -> DataFrame:
    """Each event as one record of a slow log; every seventh record is cut short, every fifth spans lines."""
    secs = F.col("value").cast("decimal(12,2)").cast("string")
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    stmt = F.concat(F.lit("select *  from t where"), F.when(F.col("event_id") % 5 == 0, F.lit("\n  id = ")).otherwise(F.lit(" id = ")), F.col("event_id").cast("string"), F.lit(" and név = 'x'"))
    head = F.concat(
        F.lit("# Time: "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z\n# User@Host: "), user, F.lit("["), user, F.lit("] @ 10.0.0."), (F.col("user_id") % 250).cast("string"),
        F.lit(":3306[]\n# Query_time: "), secs, F.lit(" Lock_time: 0.10 Rows_sent: "), (F.col("user_id") % 10).cast("string"),
        F.lit(" Rows_examined: "), F.col("event_id").cast("string"),
    )
    whole = F.concat(head, F.lit("\nuse app"), (F.col("user_id") % 3).cast("string"), F.lit(";\n"), stmt, F.lit(";"))
    return events.select(F.when(F.col("event_id") % 7 == 6, head).otherwise(whole).alias("value"))


def _slow_log(spark, d) -> str:
    path = scratch_path(spark, "slow")
    render_blocks(base(spark, d, "events")).write.text(path)
    return path


def _parsed(spark, d):
    return slowlog.parse_slow_blocks(slowlog.read_records(spark, _slow_log(spark, d), slowlog.BLOCK_MARK), 3, 8)


_SLOW = (
    "slow as (select date_trunc('second', ts)::timestamp as finish_time, 'u' || cast(user_id as varchar) as user, '10.0.0.' || cast(user_id % 250 as varchar) as host,"
    f" cast({_SECS} as double) as query_time, 0.10::double as lock_time, user_id % 10 as rows_sent, event_id as rows_examined, 'app' || cast(user_id % 3 as varchar) as db,"
    " 'select * from t where id = ' || cast(event_id as varchar) || ' and név = ''x'';' as sql_text from events where event_id % 7 <> 6)"
)


@query(
    "q1_parse_slow_blocks",
    f"with {_SLOW} select *, cast(octet_length(encode(sql_text)) as bigint) as bytes, md5(sql_text) as sql_id, 3 as inst_id, 8 as db_id from slow",
)
def q1(spark, d):
    return slowlog.accepted(_parsed(spark, d))


@query("q1_rejected_blocks", "select count(*) as n from events where event_id % 7 = 6")
def q1_rejected(spark, d):
    return slowlog.rejected(_parsed(spark, d)).agg(F.count(F.lit(1)).alias("n"))


@query("c9_slow_log_increment", f"with {_SLOW} select sql_text, finish_time from slow where finish_time > timestamp '2024-01-25 12:00:00'")
def c9_slow(spark, d):
    return slowlog.accepted(_parsed(spark, d), datetime(2024, 1, 25, 12)).select("sql_text", "finish_time")


def render_dump(events: DataFrame) -> DataFrame:
    """Each event as one key => value record of a digest tool."""
    i, u = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    text = F.concat(
        F.lit("$VAR1 = {\n  Lock_time => '0.10',\n  Query_time => '"), F.col("value").cast("decimal(12,2)").cast("string"), F.lit("',\n  Rows_examined => '"), i,
        F.lit("',\n  Rows_sent => '"), (F.col("user_id") % 10).cast("string"), F.lit("',\n  Thread_id => '"), u,
        F.lit("',\n  arg => 'select  a, b from t where id = "), i, F.lit(" and c = \\'x\\'',\n  bytes => "), F.length(i).cast("string"),
        F.lit(",\n  cmd => 'Query',\n  db => 'app',\n  fingerprint => 'select a, b from t where id = ? and c = ?',\n  host => 'h"), u,
        F.lit("',\n  ip => '10.0.0.1',\n  pos_in_log => "), i, F.lit(",\n  ts => '"), F.date_format("ts", "yyMMdd HH:mm:ss"), F.lit("',\n  user => 'u"), u, F.lit("'\n};"),
    )
    return events.select(text.alias("value"))


@query(
    "q2_parse_digest_dump",
    "select date_trunc('second', ts)::timestamp as finish_time, 'u' || cast(user_id as varchar) as user, 'h' || cast(user_id as varchar) as host, '10.0.0.1' as ip, 'app' as db, 'Query' as cmd,"
    f" cast({_SECS} as double) as query_time, 0.10::double as lock_time, user_id % 10 as rows_sent, event_id as rows_examined, user_id as thread_id, length(cast(event_id as varchar)) as bytes, event_id as pos_in_log,"
    " 'select a, b from t where id = ' || cast(event_id as varchar) || ' and c = ''x''' as sql_text, 'select a, b from t where id = ? and c = ?' as finger,"
    " md5('select a, b from t where id = ' || cast(event_id as varchar) || ' and c = ''x''') as sql_id, md5('select a, b from t where id = ? and c = ?') as templete_id, 3 as inst_id, 8 as db_id from events",
)
def q2(spark, d):
    path = scratch_path(spark, "dump")
    render_dump(base(spark, d, "events")).write.text(path)
    return slowlog.accepted(slowlog.parse_digest_dump(slowlog.read_records(spark, path, slowlog.DUMP_MARK), 3, 8))


@query(
    "q3_fingerprint",
    "select case event_id % 3 when 0 then 'select * from t where id = ? and name in(?+)' when 1 then 'insert into t' || cast(user_id as varchar) || ' values(?+)' else 'update t set a = ? where b = ?' end as finger, count(*) as n from events group by 1",
)
def q3(spark, d):
    i, u = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    text = (
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("SELECT *  FROM t\nWHERE id = "), i, F.lit(" AND name IN ('a', 'it\\'s', "), u, F.lit(")")))
        .when(F.col("event_id") % 3 == 1, F.concat(F.lit("insert into t"), u, F.lit(" values ("), i, F.lit(", 'x'), ("), u, F.lit(", 'y')")))
        .otherwise(F.concat(F.lit("update t set a = 1.5 where b = \""), u, F.lit("\"")))
    )
    return base(spark, d, "events").groupBy(slowlog.fingerprint(text).alias("finger")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "q4_slow_summary",
    f"with {_SLOW} select db, user, count(*) as times, round(sum(query_time), 2) as sum_time, round(avg(query_time), 2) as avg_time, max(query_time) as max_time, cast(sum(rows_examined) as bigint) as rows_examined,"
    " cast(sum(rows_sent) as bigint) as rows_sent from slow group by 1, 2",
)
def q4(spark, d):
    return slowlog.slow_summary(slowlog.accepted(_parsed(spark, d)), ["db", "user"])


@query(
    "q5_upsert_statement",
    STATEMENT_STATS_SQL + " select dbid, username, sql_id, executions + 1 as executions from g where sql_id % 3 = 0 union all select dbid, username, sql_id, executions from g where sql_id % 3 <> 0",
)
def q5(spark, d):
    stats = statement_stats(inputs.stats(spark, d)).select("dbid", "username", "sql_id", "executions")
    new = stats.filter("sql_id % 3 = 0").withColumn("executions", F.col("executions") + 1)
    return slowlog.upsert_statement(stats.filter("sql_id % 3 <> 0 or sql_id % 2 = 0"), new)


@query(
    "q6_command_slowlog",
    with_inputs("commands") + f", wl as ({_WHITELIST}), x as (select dbid, start_time, duration, command, max(create_time)::timestamp as create_time from commands a where start_time between timestamp '2024-01-29' and timestamp '2024-01-31'"
    " and command not in (select command from wl b where b.dbid = a.dbid and b.status = '1') group by 1, 2, 3, 4)"
    " select row_number() over (order by start_time, dbid, command, duration) as xh, * from x",
)
def q6(spark, d):
    listed = slowlog.command_slowlog(inputs.commands(spark, d), _whitelist(spark, d), EVENTS_AS_OF, 2 * 1440)
    return number_rows(listed, ["start_time", "dbid", "command", "duration"], "xh", unique=True)


@query(
    "q6_command_summary",
    with_inputs("commands") + f", wl as ({_WHITELIST}) select dbid, batch_id, command, round(avg(duration), 2) as avg_duration, min(start_time) as first_time, max(start_time) as last_time from commands a"
    " where start_time between timestamp '2024-01-29' and timestamp '2024-01-31' and command not in (select command from wl b where b.dbid = a.dbid and b.status = '1') group by 1, 2, 3",
)
def q6_summary(spark, d):
    return slowlog.command_slowlog_summary(inputs.commands(spark, d), _whitelist(spark, d), EVENTS_AS_OF, 2 * 1440)


@query(
    "q7_active_sessions",
    with_inputs("processes") + "select id, cast(trunc(epoch(timestamp '2024-01-31' - last_batch)) as bigint) as query_time, last_batch + to_seconds(cast(trunc(epoch(timestamp '2024-01-31' - last_batch)) as bigint)) as end_time"
    " from processes where trunc(epoch(timestamp '2024-01-31' - last_batch)) > 100000",
)
def q7(spark, d):
    return slowlog.active_sessions(inputs.processes(spark, d), EVENTS_AS_OF, 100000).select("id", "query_time", "end_time")


@query("q8_day_slice_stats", "select l_orderkey, l_linenumber, l_shipdate from lineitem where l_shipdate >= timestamp '2000-03-05' and l_shipdate < timestamp '2000-03-06'")
def q8(spark, d):
    return slowlog.day_slice(base(spark, d, "lineitem"), "l_shipdate", date(2000, 3, 5)).select("l_orderkey", "l_linenumber", "l_shipdate")


_REPORT = ReportSpec(
    preprocess=(
        ("report_orders", "select * from all_orders where o_orderdate >= :begin and o_orderdate <= :end"),
        ("report_states", "select o_orderstatus, count(*) as n, count(distinct o_custkey) as buyers from report_orders group by o_orderstatus"),
    ),
    query="select o_orderstatus, n, buyers, substring(:begin, 1, 10) as since from report_states",
    headers=("state", "orders", "buyers", "since"),
)


@query(
    "r1_run_report",
    "select o_orderstatus as state, cast(count(*) as varchar) as orders, cast(count(distinct o_custkey) as varchar) as buyers, '2000-01-01' as since from orders"
    " where o_orderdate >= timestamp '2000-01-01' and o_orderdate <= timestamp '2000-06-30 23:59:59' group by 1",
)
def r1(spark, d):
    return run_report(spark, _REPORT, date(2000, 1, 1), date(2000, 6, 30), {"all_orders": base(spark, d, "orders")})


@query("r2_report_range", "select o_orderstatus, '2000-01-01 0:0:0 - 2000-06-30 23:59:59' as covers, count(*) as n from orders where o_orderdate >= timestamp '2000-01-01' and o_orderdate < timestamp '2000-07-01' group by 1")
def r2(spark, d):
    from rowtide.operators.filters import between_days

    rows = between_days(base(spark, d, "orders"), "o_orderdate", date(2000, 1, 1), date(2000, 6, 30))
    return rows.groupBy("o_orderstatus", report_range(date(2000, 1, 1), date(2000, 6, 30)).alias("covers")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "r3_report_log",
    "select o_orderpriority || '/' || cast(o_custkey as varchar) as tag, max(o_orderdate) as started_at, count(*) > 0 as logged from orders group by 1",
)
def r3(spark, d):
    runs = base(spark, d, "orders").selectExpr("concat(o_orderpriority, '/', cast(o_custkey as string)) as tag", "o_orderdate as started_at", "true as logged", "o_orderkey")
    return report_log(runs.filter("o_orderkey % 2 = 0").drop("o_orderkey"), runs.filter("o_orderkey % 2 = 1").drop("o_orderkey"))
