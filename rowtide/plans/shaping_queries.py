"""Queries for schemas, values and filters."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from rowtide.functions import rows
from rowtide.operators import filters, schema
from rowtide.operators.numbering import add_surrogate_key
from rowtide.plans import inputs
from rowtide.plans.inputs import EVENTS_AS_OF, base, with_inputs
from rowtide.plans.registry import query

# a column listing as large as the events table: one described column per event
_DESCRIBED = (
    "select event_id, case event_id % 11 when 0 then 'tinyint' when 1 then 'int' when 2 then 'bigint' when 3 then 'varchar' when 4 then 'timestamp'"
    " when 5 then 'datetime' when 6 then 'date' when 7 then 'longtext' when 8 then 'double' when 9 then 'decimal' else 'time' end as data_type,"
    " case when user_id % 2 = 0 then 'NO' else 'YES' end as is_nullable, cast(user_id % 3 * 3 as int) as datetime_precision from events"
)


def _described(spark, d):
    df = base(spark, d, "events")
    names = ["tinyint", "int", "bigint", "varchar", "timestamp", "datetime", "date", "longtext", "double", "decimal", "time"]
    kind = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("event_id") % 11 + 1).cast("int"))
    return df.select(
        "event_id", kind.alias("data_type"), F.when(F.col("user_id") % 2 == 0, "NO").otherwise("YES").alias("is_nullable"),
        (F.col("user_id") % 3 * 3).cast("int").alias("datetime_precision"),
    )


@query(
    "b1_map_schema_clickhouse",
    f"with c as ({_DESCRIBED}), t as (select *, case data_type when 'tinyint' then 'Int16' when 'int' then 'Int32' when 'bigint' then 'Int64'"
    " when 'timestamp' then 'DateTime' when 'datetime' then case when datetime_precision = 6 then 'DateTime64' else 'DateTime' end"
    " when 'date' then 'Date' when 'double' then 'Float64' else 'String' end as b from c)"
    " select data_type, is_nullable, datetime_precision, case when is_nullable = 'NO' then b else 'Nullable(' || b || ')' end as target_type, count(*) as n from t group by all",
)
def b1_clickhouse(spark, d):
    mapped = schema.map_schema(_described(spark, d), "clickhouse")
    return mapped.groupBy("data_type", "is_nullable", "datetime_precision", "target_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "b1_map_schema_doris",
    f"with c as ({_DESCRIBED}) select data_type, case data_type when 'varchar' then 'String' when 'timestamp' then 'datetime' when 'longtext' then 'text' else data_type end as stream_type,"
    " case when data_type in ('varchar', 'longtext', 'time') then 'String' when data_type = 'tinyint' then 'int' when data_type = 'timestamp' then 'datetime' else data_type end as batch_type,"
    " count(*) as n from c group by all",
)
def b1_doris(spark, d):
    cols = _described(spark, d)
    stream = schema.map_schema(cols, "doris").withColumnRenamed("target_type", "stream_type")
    both = schema.map_schema(stream, "doris_batch").withColumnRenamed("target_type", "batch_type")
    return both.groupBy("data_type", "stream_type", "batch_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "b1_map_schema_postgres",
    "with c as (select case l_linenumber when 1 then 'integer' when 2 then 'real' when 3 then 'date' when 4 then 'timestamp without time zone' when 5 then 'text' when 6 then 'uuid' else 'bytea' end as data_type from lineitem)"
    " select data_type, case data_type when 'integer' then 'int' when 'real' then 'numeric(20,2)' when 'date' then 'date' when 'text' then 'varchar(100)'"
    " when 'uuid' then 'varchar(50)' when 'bytea' then 'varchar(500)' else 'datetime' end as target_type, count(*) as n from c group by all",
)
def b1_postgres(spark, d):
    names = ["integer", "real", "date", "timestamp without time zone", "text", "uuid", "bytea"]
    cols = base(spark, d, "lineitem").select(F.element_at(F.array(*[F.lit(n) for n in names]), F.col("l_linenumber")).alias("data_type"))
    return schema.map_schema(cols, "postgres").groupBy("data_type", "target_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "b1_map_schema_sqlserver",
    "with c as (select case l_linenumber when 1 then 'nvarchar(50)' when 2 then 'varchar(-1)' when 3 then 'datetime2(27)' when 4 then 'money(19)' when 5 then 'timestamp(8)' when 6 then 'bit(1)' else 'int identity(1,1)' end as data_type from lineitem)"
    " select data_type, case data_type when 'nvarchar(50)' then 'varchar(50)' when 'varchar(-1)' then 'longtext' when 'datetime2(27)' then 'datetime' when 'money(19)' then 'decimal(19)'"
    " when 'timestamp(8)' then 'varchar(50)' when 'bit(1)' then 'varchar(1)' else 'int' end as target_type, count(*) as n from c group by all",
)
def b1_sqlserver(spark, d):
    names = ["nvarchar(50)", "varchar(-1)", "datetime2(27)", "money(19)", "timestamp(8)", "bit(1)", "int identity(1,1)"]
    cols = base(spark, d, "lineitem").select(F.element_at(F.array(*[F.lit(n) for n in names]), F.col("l_linenumber")).alias("data_type"))
    return schema.map_schema(cols, "sqlserver").groupBy("data_type", "target_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "b2_apply_ddl",
    "select c_custkey, c_name as full_name, try_cast(c_nationkey as varchar) as c_nationkey, c_acctbal, cast(null as integer) as level from customer",
)
def b2(spark, d):
    return schema.apply_ddl(
        base(spark, d, "customer"),
        ["alter table app.customer add column `LEVEL` int, drop column c_mktsegment", "alter table customer change c_name full_name varchar(25), change c_nationkey C_NATIONKEY varchar(10)"],
    )


@query("b3_add_missing_columns", "select c_custkey, c_name, cast(null as integer) as c_nationkey, cast(null as double) as c_acctbal, cast(null as varchar) as c_mktsegment from customer")
def b3(spark, d):
    source = base(spark, d, "customer")
    return schema.add_missing_columns(source.select("c_custkey", "c_name"), source)


# (statement text around the table name, kind, whether it is kept as a schema change)
_STATEMENTS = [
    ("create table `app`.`t{}` (id int)", "CREATE_TABLE"), ("drop table app.t{}", "DROP_TABLE"), ("truncate table t{}", "TRUNCATE_TABLE"),
    ("alter table app.t{} add column c int", "ALTER_TABLE_ADD"), ("ALTER TABLE app.t{} DROP COLUMN c", "ALTER_TABLE_DROP"),
    ("alter  table t{} change a b int", "ALTER_TABLE_CHANGE"), ("insert into app.t{}(id) values (1)", "INSERT"), ("update t{} set a = 1", "UPDATE"),
    ("delete from `t{}` where id = 1", "DELETE"), ("create database t{}", "CREATE_DATABASE"), ("select * from t{}", None),
]
_STATEMENT_SQL = "case event_id % 11 " + " ".join(
    f"when {i} then '{t.split('{}')[0]}' || cast(user_id as varchar) || '{t.split('{}')[1]}'" for i, (t, _) in enumerate(_STATEMENTS)
) + " end"


def _statements(spark, d):
    heads = F.array(*[F.lit(t.split("{}")[0]) for t, _ in _STATEMENTS])
    tails = F.array(*[F.lit(t.split("{}")[1]) for t, _ in _STATEMENTS])
    i = (F.col("event_id") % 11 + 1).cast("int")
    text = F.concat(F.element_at(heads, i), F.col("user_id").cast("string"), F.element_at(tails, i))
    return base(spark, d, "events").select("event_id", text.alias("statement"))


@query(
    "b4_classify_statement",
    f"select event_id, {_STATEMENT_SQL} as statement, case event_id % 11 "
    + " ".join(f"when {i} then '{op}'" for i, (_, op) in enumerate(_STATEMENTS) if op)
    + " end as op, case when event_id % 11 <> 10 then 't' || cast(user_id as varchar) end as object from events",
)
def b4(spark, d):
    return schema.classify_statement(_statements(spark, d))


@query("b5_keep_ddl", f"select event_id, {_STATEMENT_SQL} as statement from events where event_id % 11 in (0, 1, 2, 3, 4, 5)")
def b5(spark, d):
    return schema.keep_ddl(_statements(spark, d))


@query(
    "b6_carry_comments",
    "select column_name, comment, n from (values ('c_custkey', null), ('c_name', 'name of the customer'), ('c_mktsegment', 'own')) as t(column_name, comment), (select count(*) as n from customer)",
)
def b6(spark, d):
    """The comments that the target's columns have afterwards, beside the number of its rows."""
    df = base(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    source = schema.with_comments(df.select("c_custkey", F.col("c_name").alias("C_NAME")), {"C_NAME": "name of the customer"})
    target = schema.carry_comments(source, schema.with_comments(df, {"c_mktsegment": "own"}))
    found = F.array(*[F.struct(F.lit(f.name).alias("column_name"), F.lit(f.metadata.get("comment")).cast("string").alias("comment")) for f in target.schema.fields])
    return target.agg(F.count(F.lit(1)).alias("n")).select(F.explode(found).alias("f"), "n").select("f.column_name", "f.comment", "n")


@query(
    "b7_find_key",
    "select 'lineitem' as tbl, 0 as priority, 'l_orderkey,l_linenumber' as candidate, (select max(n) = 1 from (select count(*) as n from lineitem group by l_orderkey, l_linenumber)) as is_key"
    " union all select 'orders', 0, 'o_custkey', (select max(n) = 1 from (select count(*) as n from orders group by o_custkey))"
    " union all select 'orders', 1, 'o_orderkey', (select max(n) = 1 from (select count(*) as n from orders group by o_orderkey))",
)
def b7(spark, d):
    lines = schema.key_candidates(base(spark, d, "lineitem"), [["l_orderkey", "l_linenumber"]]).withColumn("tbl", F.lit("lineitem"))
    return lines.unionByName(schema.key_candidates(base(spark, d, "orders"), [["o_custkey"], ["o_orderkey"]]).withColumn("tbl", F.lit("orders")))


@query(
    "b8_add_surrogate_key",
    "select row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey) as pkid, l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem",
)
def b8(spark, d):
    return add_surrogate_key(base(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))


@query("b9_add_constants", "select o_orderkey, o_custkey, '7' as market_id, 'm' || cast(o_orderkey as varchar) || '_' || cast(o_custkey as varchar) as row_tag from orders")
def b9(spark, d):
    return rows.add_constants(base(spark, d, "orders").select("o_orderkey", "o_custkey"), {"market_id": "7", "row_tag": "m$PK$"}, ["o_orderkey", "o_custkey"])


@query(
    "b10_normalise_values",
    "select event_id, date_trunc('second', ts)::timestamp as ts, cast(value > 50 as integer) as high, cast(null as varchar) as version from events",
)
def b10(spark, d):
    df = base(spark, d, "events").select("event_id", "ts", (F.col("value") > 50).alias("high"), F.col("props").alias("version"))
    return rows.normalise_values(df, ["version"])


@query("b11_key_string", "select distinct l_orderkey, l_linenumber, cast(l_orderkey as varchar) || '^^^' || cast(l_linenumber as varchar) as key from lineitem")
def b11(spark, d):
    return base(spark, d, "lineitem").select("l_orderkey", "l_linenumber", rows.key_string(["l_orderkey", "l_linenumber"]).alias("key")).distinct()


@query("b12_map_table_name", with_inputs("changes") + "select replace(tbl, '.', '_') as target_table, count(*) as n from changes group by 1")
def b12(spark, d):
    return inputs.changes(spark, d).groupBy(rows.map_table_name(F.col("tbl")).alias("target_table")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "b13_post_load_rewrite",
    "select o_orderkey, o_orderstatus, case o_orderstatus when 'F' then '234' else '164' end as market_id from orders where o_orderstatus in ('F', 'O')",
)
def b13(spark, d):
    return schema.post_load_rewrite(base(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", {"F": "234", "O": "164"}, "market_id")


_ROW_TEXT = "cast(order_id as varchar) || ',' || cast(cust_id as varchar) || ',' || coalesce(nullif(status, 'O'), '') || ',' || strftime(updated_at, '%Y-%m-%d')"


@query("b14_row_fingerprint", with_inputs("orders_src") + f"select order_id, {_ROW_TEXT} as row_text, md5({_ROW_TEXT}) as fingerprint from orders_src")
def b14(spark, d):
    df = inputs.orders_src(spark, d).select("order_id", "cust_id", F.expr("nullif(status, 'O')").alias("status"), F.to_date("updated_at").alias("day"))
    cols = ["order_id", "cust_id", "status", "day"]
    return df.select("order_id", rows.row_text(cols).alias("row_text"), rows.row_fingerprint(cols).alias("fingerprint"))


@query(
    "b15_rename_schema",
    with_inputs("changes") + ", c as (select case seq % 3 when 0 then 'app' when 1 then 'crm' else 'old' end as s, tbl from changes)"
    " select s || substring(tbl, 4) as tbl, case s when 'app' then 'ods_app' when 'crm' then 'ods_sales' else 'test' end as dest_schema, count(*) as n from c group by 1, 2",
)
def b15(spark, d):
    name = F.element_at(F.array(F.lit("app"), F.lit("crm"), F.lit("old")), (F.col("seq") % 3 + 1).cast("int"))
    events = inputs.changes(spark, d).withColumn("tbl", F.concat(name, F.expr("substring(tbl, 4)")))
    return schema.rename_schema(events, {"app": "auto", "crm": "sales"}, "ods_").groupBy("tbl", "dest_schema").agg(F.count(F.lit(1)).alias("n"))


@query("b16_keys_first", "select l_orderkey, l_linenumber, l_quantity, l_tax, cast(l_orderkey as varchar) || '_' || cast(l_linenumber as varchar) as src_key from lineitem")
def b16(spark, d):
    df = base(spark, d, "lineitem").select("l_quantity", "l_linenumber", "l_tax", "l_orderkey")
    return rows.keys_first(df, ["l_orderkey", "l_linenumber"], {"src_key": "$PK$"})


@query("c1_recent", "select event_id, ts from events where ts >= timestamp '2024-01-31 00:00:00' - interval 36 hour")
def c1(spark, d):
    return filters.recent(base(spark, d, "events").select("event_id", "ts"), "ts", 36, "hour", EVENTS_AS_OF)


@query("c2_recent_tz", "select event_id, ts from events where ts >= timestamp '2024-01-31 08:00:00' - interval 3 day")
def c2(spark, d):
    return filters.recent_tz(base(spark, d, "events").select("event_id", "ts"), "ts", 3, "day", EVENTS_AS_OF)


@query(
    "c3_on_day",
    "select 'half-open' as form, event_id from events where ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-11'"
    " union all select 'closed', event_id from events where ts between timestamp '2024-01-10 00:00:00' and timestamp '2024-01-10 23:59:59'",
)
def c3(spark, d):
    df = base(spark, d, "events").select("event_id", "ts")
    day = date(2024, 1, 10)
    return filters.on_day(df, "ts", day).select(F.lit("half-open").alias("form"), "event_id").unionByName(
        filters.on_day(df, "ts", day, compat=True).select(F.lit("closed").alias("form"), "event_id")
    )


@query(
    "c4_last_days",
    "select cast(d as date) as day, (select count(*) from orders where o_orderdate >= d and o_orderdate < d + interval 1 day) as rows"
    " from generate_series(timestamp '2001-07-02', timestamp '2001-08-01', interval 1 day) g(d)",
)
def c4(spark, d):
    days = filters.last_days(spark, 30, inputs.ORDERS_AS_OF.date())
    counts = base(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("rows"))
    return days.join(counts, "day", "left").select("day", F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows"))


@query("c5_where_text", "select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' and o_totalprice > 100000")
def c5(spark, d):
    return filters.where_text(base(spark, d, "orders"), "o_orderstatus = 'F' and o_totalprice > 100000").select("o_orderkey", "o_totalprice")


@query("c6_keys_equal", "select l_orderkey, l_linenumber, l_quantity from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus = 'P')")
def c6(spark, d):
    keys = base(spark, d, "orders").filter("o_orderstatus = 'P'").select("o_orderkey")
    return filters.keys_equal(base(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey", keys)


@query(
    "c7_in_csv",
    "select c_custkey, c_nationkey in (1, 12, 3) as exact, instr('1,12,3', cast(c_nationkey as varchar)) > 0 as loose from customer",
)
def c7(spark, d):
    nation = F.col("c_nationkey")
    return base(spark, d, "customer").select(
        "c_custkey", filters.in_csv(nation, "1,12,3").alias("exact"), filters.in_csv(nation, "1,12,3", substring=True).alias("loose")
    )


@query("c8_not_like", "select s_suppkey, s_name from supplier where s_name not like '%1'")
def c8(spark, d):
    return filters.not_like(base(spark, d, "supplier").select("s_suppkey", "s_name"), "s_name", "%1")


@query("c9_after_high_water", "select event_id, ts, (select max(ts) from events) as next_mark from events where ts > timestamp '2024-01-29 12:00:00'")
def c9(spark, d):
    last = datetime(2024, 1, 29, 12)
    fresh = filters.after_high_water(base(spark, d, "events").select("event_id", "ts"), "ts", last)
    return fresh.withColumn("next_mark", filters.high_water(fresh, "ts", last).scalar())


@query("c10_select_events", with_inputs("changes") + "select seq, tbl, op from changes where op in ('insert', 'delete') and tbl in ('app.t0', 'app.t2')")
def c10(spark, d):
    return filters.select_events(inputs.changes(spark, d), ["insert", "delete"], ["app.t0", "app.t2"], ["app"]).select("seq", "tbl", "op")


@query(
    "c11_age_and_threshold",
    with_inputs("commands") + "select id, round(micros / 1000, 2) as duration_ms from commands where start_time >= timestamp '2024-01-29 00:00:00'"
    " and start_time <= timestamp '2024-01-30 00:00:00' and round(micros / 1000, 2) > 2",
)
def c11(spark, d):
    slow = filters.age_and_threshold(inputs.commands(spark, d), "start_time", datetime(2024, 1, 30), 86400, "micros", 2)
    return slow.select("id", "duration_ms")


@query(
    "c12_running_statements",
    with_inputs("processes") + "select id, host, usr, command, secs, state, info from processes where command not in ('Sleep', 'Binlog Dump', 'Daemon', 'Connect', 'Binlog Dump GTID')"
    " and secs >= 20 and instr(info, '99') = 0",
)
def c12(spark, d):
    return filters.running_statements(inputs.processes(spark, d), 20, "99").select("id", "host", "usr", "command", "secs", "state", "info")

