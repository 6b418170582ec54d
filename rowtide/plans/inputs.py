"""Inputs of the registered queries, derived from the base tables (the same select lists serve both engines)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

ORDERS_AS_OF = datetime(2001, 8, 1)
EVENTS_AS_OF = datetime(2024, 1, 31)

ORDERS_SRC = [
    "o_orderkey as order_id", "o_custkey as cust_id", "o_orderstatus as status", "o_totalprice as amount",
    "o_orderpriority as priority", "o_orderdate as updated_at",
]
CHANGES = [
    "event_id as seq",
    "cast(floor(event_id / 200.0) as bigint) + 8 as file_no",
    "(event_id % 200) * 37 + 4 as pos",
    "concat('app.t', cast(user_id % 3 as string)) as tbl",
    "case event_type when 'signup' then 'insert' when 'error' then 'delete' else 'update' end as op",
    "user_id as before_pk",
    "case when event_type not in ('signup','error') and event_id % 50 = 0 then user_id + 1000 else user_id end as pk",
    "value as val", "event_type as kind", "ts",
]
# the changed tables as they were before the log begins
CHANGED = ["concat('app.t', cast(c_custkey % 3 as string)) as tbl", "c_custkey as pk", "c_acctbal as val", "c_mktsegment as kind",
           "timestamp_ntz '2023-12-31 00:00:00' as ts"]
SAMPLES = ["event_id as sample_id", "user_id % 20 as server_id", "ts", "least(value, 100.0) as cpu", "props as disk_json"]
STATS = [
    "l_suppkey % 3 as dbid", "concat('u', cast(l_suppkey % 7 as string)) as username", "l_partkey as sql_id",
    "date_trunc('month', l_shipdate) as snap", "l_linenumber - 1 as executions", "l_quantity as elapsed_s",
    "l_extendedprice as rows_processed", "l_tax * 100 as disk_reads",
]
PROCESSES = [
    "event_id as id", "concat('10.0.', cast(user_id % 4 as string), '.', cast(user_id as string)) as host",
    "concat('u', cast(user_id % 7 as string)) as usr",
    "case event_type when 'view' then 'Sleep' when 'signup' then 'Binlog Dump' else 'Query' end as command",
    "cast(floor(value) as bigint) as secs", "event_type as state", "concat('select ', cast(event_id as string)) as info", "ts as last_batch",
]
COMMANDS = [
    "event_id as id", "user_id % 5 as dbid", "cast(floor(event_id / 100.0) as bigint) as batch_id", "event_type as command",
    "ts as start_time", "value * 100 as micros", "round(value, 1) as duration", "date_trunc('hour', ts) as create_time",
]
CALLS = ["event_id as id", "user_id % 4 as market_id", "user_id % 20 as server_id", "event_type as api_interface", "value as response_time", "ts as update_time"]

# a byte counter per server that starts again at zero now and then
COUNTERS = ["user_id % 20 as server_id", "ts", "event_id as sample_id", "(event_id * 37) % 5000 as bytes"]


def _sql(cols: list[str], table: str, where: str = "") -> str:
    text = f"select {', '.join(cols)} from {table}{' where ' + where if where else ''}"
    return text.replace("timestamp_ntz '", "timestamp '")


ORDERS_TGT_SQL = (
    "select order_id, cust_id, status, case when order_id % 89 = 0 then amount + 1.0 else amount end as amount, priority, updated_at"
    " from orders_src where order_id % 97 <> 0 union all"
    " select order_id + 1000000, cust_id, status, amount, priority, updated_at from orders_src where order_id % 101 = 0"
)
# common table expressions that put the oracle on the same inputs
WITH = {
    "orders_src": _sql(ORDERS_SRC, "orders"),
    "orders_tgt": ORDERS_TGT_SQL,
    "changes": _sql(CHANGES, "events"),
    "changed": _sql(CHANGED, "customer"),
    "samples": _sql(SAMPLES, "events"),
    "stats": _sql(STATS, "lineitem"),
    "processes": _sql(PROCESSES, "events"),
    "commands": _sql(COMMANDS, "events"),
    "calls": _sql(CALLS, "events"),
    "counters": _sql(COUNTERS, "events"),
}
_NEEDS = {"orders_tgt": ["orders_src"]}


def with_inputs(*names: str) -> str:
    """``with a as (...), b as (...)`` for the named inputs and what they are derived from."""
    wanted: list[str] = []
    for name in names:
        for each in [*_NEEDS.get(name, []), name]:
            if each not in wanted:
                wanted.append(each)
    return "with " + ", ".join(f"{n} as ({WITH[n]})" for n in wanted) + " "


def base(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def orders_src(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir, "orders").selectExpr(*ORDERS_SRC)


def orders_tgt(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = orders_src(spark, sf_dir)
    amount = F.when(F.col("order_id") % 89 == 0, F.col("amount") + 1.0).otherwise(F.col("amount"))
    kept = src.filter("order_id % 97 <> 0").withColumn("amount", amount)
    return kept.unionByName(src.filter("order_id % 101 = 0").withColumn("order_id", F.col("order_id") + 1000000))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir, "events").selectExpr(*CHANGES)


def changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir, "customer").selectExpr(*CHANGED)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir, "events").selectExpr(*SAMPLES)


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir, "lineitem").selectExpr(*[c.replace("date_trunc('month', l_shipdate)", "cast(date_trunc('month', l_shipdate) as timestamp_ntz)") for c in STATS])


def processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir, "events").selectExpr(*PROCESSES)


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = [c.replace("date_trunc('hour', ts)", "cast(date_trunc('hour', ts) as timestamp_ntz)") for c in COMMANDS]
    return base(spark, sf_dir, "events").selectExpr(*cols)


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir, "events").selectExpr(*CALLS)


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir, "events").selectExpr(*COUNTERS)
