"""Queries for sources and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from rowtide.functions.timing import moment
from rowtide.plans.inputs import EVENTS_AS_OF, base, orders_src, orders_tgt, with_inputs
from rowtide.plans.registry import query
from rowtide.session import scratch_path
from rowtide.sources import scan, sinks, splits
from rowtide.specs import SyncSpec

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
KEYS = {"customer": ("c_custkey",), "supplier": ("s_suppkey",), "orders": ("o_orderkey",), "nation": ("n_nationkey",)}


def _catalog(sf_dir: str, tables: list[str] = TABLES):
    return scan.catalog_of(sf_dir, tables, KEYS)


@query("a1_scan_table", "select l_orderkey, l_quantity, l_shipdate from lineitem")
def a1(spark, d):
    return scan.scan_table(spark, _catalog(d), "lineitem", ["l_orderkey", "l_quantity", "l_shipdate"])


@query(
    "a2_scan_query",
    "select cast(o_orderpriority as varchar) as priority, cast(count(*) as varchar) as n, '' as nothing from orders where o_orderstatus = 'O' group by 1",
)
def a2(spark, d):
    sql = "select o_orderpriority as priority, count(*) as n, nullif(max('x'), 'x') as nothing from orders where o_orderstatus = 'O' group by 1"
    return scan.scan_query(spark, _catalog(d, ["orders"]), sql, blank_nulls=True)


_PROFILED = {
    "nation": [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")],
    "events": [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"), ("value", "double"), ("props", "string")],
}


@query(
    "a3_list_columns",
    " union all ".join(
        f"select '{t}' as table_name, '{c}' as column_name, '{k}' as data_type, {i} as ordinal, count({c}) as filled from {t}"
        for t, cols in _PROFILED.items()
        for i, (c, k) in enumerate(cols, 1)
    ),
)
def a3(spark, d):
    """The column listing with how many rows fill each column."""
    out = []
    for table in _PROFILED:
        df = base(spark, d, table)
        filled = df.agg(*[F.count(c).alias(c) for c in df.columns]).unpivot([], df.columns, "column_name", "filled")
        out.append(scan.list_columns(spark, _catalog(d), table).join(filled, "column_name"))
    return reduce(DataFrame.unionByName, out)


@query(
    "a4_incremental_candidates",
    "select 'o_orderdate' as column_name, min(o_orderdate) as min_value, max(o_orderdate) as max_value, count(o_orderdate) as non_null from orders",
)
def a4(spark, d):
    return scan.candidate_bounds(base(spark, d, "orders"))


@query(
    "a5_resolve_tables",
    " union all ".join(
        f"select 'app' as schema_name, '{t}' as table_name, '{dest}' as dest_schema, count(*) as rows from {t}"
        for t, dest in [("customer", "ods"), ("orders", "ods"), ("supplier", "ods"), ("nation", "app")]
    ),
)
def a5(spark, d):
    cat = _catalog(d)
    specs = scan.resolve_tables("app.*er*.ts$ods,app.lineitem.l_shipdate$ods,app.nation.ts$auto", cat)
    parts = [
        scan.scan_table(spark, cat, s.table).agg(
            F.lit(s.schema).alias("schema_name"), F.lit(s.table).alias("table_name"), F.lit(s.dest_schema).alias("dest_schema"), F.count(F.lit(1)).alias("rows")
        )
        for s in specs
    ]
    return reduce(DataFrame.unionByName, parts)


@query("a6_project_synced", "select c_custkey, c_name, c_acctbal from customer")
def a6(spark, d):
    return scan.project_synced(base(spark, d, "customer"), "C_ACCTBAL#c_name#c_custkey#unknown")


@query(
    "a7_key_ranges",
    "with q as (select quantile_disc(o_orderkey, [0.125,0.25,0.375,0.5,0.625,0.75,0.875]) as c from orders),"
    " t as (select o_orderkey as k, (select len(list_filter(c, lambda x: x < o_orderkey)) from q) as r from orders)"
    " select cast(r as integer) as range_no, min(k) as lo, max(k) as hi, count(*) as rows from t group by 1",
)
def a7(spark, d):
    return splits.key_ranges(base(spark, d, "orders"), "o_orderkey", 8, accuracy=100)


@query(
    "a8_key_blocks",
    "select cast(floor((l_orderkey - 1) / 1000.0) as bigint) as block_no, cast(floor((l_orderkey - 1) / 1000.0) as bigint) * 1000 + 1 as start_id,"
    " cast(floor((l_orderkey - 1) / 1000.0) as bigint) * 1000 + 1000 as stop_id, count(*) as rows from lineitem where l_orderkey >= 1 group by 1, 2, 3",
)
def a8(spark, d):
    return splits.key_blocks(base(spark, d, "lineitem"), "l_orderkey", 1, 1000)


@query(
    "a9_day_slices",
    "select date_trunc('day', ts)::timestamp as slice_start, count(*) as rows, date_trunc('day', ts)::timestamp + interval 1 day as slice_end from events group by 1, 3",
)
def a9(spark, d):
    return splits.day_slices(base(spark, d, "events"), "ts")


@query(
    "a10_choose_split",
    "select count(*) as rows, max(l_orderkey) - min(l_orderkey) as span,"
    " case when count(*) >= 1000 and max(l_orderkey) - min(l_orderkey) > 3 * count(*) then 'date' else 'id' end as split from lineitem",
)
def a10(spark, d):
    return splits.choose_split(base(spark, d, "lineitem"), "l_orderkey", floor=1000)


@query(
    "a11_choose_time_column",
    "select 'create_time' as time_column, strftime(o_orderdate, '%Y%m') as yyyymm, count(*) as rows from orders group by 2",
)
def a11(spark, d):
    """Time columns that hold no null count as fixed; the chosen one gives the partitions of the target."""
    df = base(spark, d, "orders").select(
        F.col("o_orderdate").alias("paid_at"), F.col("o_orderdate").alias("create_time"), F.col("o_orderdate").alias("update_time"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate")).alias("create_dt"),
    )
    times = scan.incremental_candidates(df.schema)
    gaps = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in times]).first()
    fixed = T.StructType([T.StructField(f.name, f.dataType, bool(gaps[f.name])) for f in df.schema.fields])
    chosen = scan.choose_time_column(fixed)
    return sinks.with_month(df, chosen).groupBy(F.lit(chosen).alias("time_column"), "yyyymm").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "a12_write_month_partitioned",
    "select strftime(o_orderdate, '%Y%m') as yyyymm, count(*) as rows, min(o_orderkey) as lo, max(o_orderkey) as hi from orders"
    " where o_orderdate >= timestamp '2000-01-01' group by 1",
)
def a12(spark, d):
    path = scratch_path(spark, "months")
    sinks.write_month_partitioned(base(spark, d, "orders"), path, "o_orderdate", ["o_orderkey"])
    back = spark.read.parquet(path).withColumn("yyyymm", F.col("yyyymm").cast("string")).filter("yyyymm >= '200001'")
    return back.groupBy("yyyymm").agg(F.count(F.lit(1)).alias("rows"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))


@query("a13_append", "select o_orderstatus, 2 * count(*) as rows from orders group by 1")
def a13(spark, d):
    path = scratch_path(spark, "append")
    orders = base(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    sinks.append(orders, path)
    sinks.append(orders, path)
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "a14_full_or_incremental",
    with_inputs("orders_src")
    + ", i as (select * from orders_src where updated_at >= timestamp '2001-07-01')"
    " select 'empty' as target, 'full' as mode, count(*) as rows from orders_src union all select 'filled', 'incremental', count(*) from i"
    " union all select 'no column', 'truncate', count(*) from orders_src",
)
def a14(spark, d):
    src, tgt = orders_src(spark, d), orders_tgt(spark, d)
    incr = src.filter(F.col("updated_at") >= moment("2001-07-01 00:00:00"))
    out = []
    for label, target, col in [("empty", tgt.limit(0), "updated_at"), ("filled", tgt, "updated_at"), ("no column", tgt, None)]:
        mode, rows = sinks.full_or_incremental(target, src, incr, col)
        out.append(rows.agg(F.lit(label).alias("target"), F.lit(mode).alias("mode"), F.count(F.lit(1)).alias("rows")))
    return reduce(DataFrame.unionByName, out)


@query(
    "a15_rows_to_move",
    "select 'filled' as target, count(*) as rows_to_move from orders where o_orderstatus = 'F' union all select 'empty', count(*) from orders",
)
def a15(spark, d):
    src, tgt = base(spark, d, "orders"), orders_tgt(spark, d)
    filled = sinks.rows_to_move(src, "o_orderstatus = 'F'", tgt).withColumn("target", F.lit("filled"))
    return filled.unionByName(sinks.rows_to_move(src, "o_orderstatus = 'F'", tgt.filter("order_id < 0")).withColumn("target", F.lit("empty")))


@query(
    "a16_file_set_increment",
    "with o as (select event_id, concat('pics/', event_type, '/a_', strftime(ts, '%Y%m%d%H%M%S'), '.jpg') as object_name,"
    " strptime(strftime(ts, '%Y%m%d%H%M%S'), '%Y%m%d%H%M%S') as made from events)"
    " select object_name, event_id from o where epoch(timestamp '2024-01-31 00:00:00') - epoch(made) <= 48 * 3600"
    " and object_name not in (select object_name from o where event_id % 10 = 0)",
)
def a16(spark, d):
    listing = base(spark, d, "events").select(
        "event_id", F.concat(F.lit("pics/"), "event_type", F.lit("/a_"), F.date_format("ts", "yyyyMMddHHmmss"), F.lit(".jpg")).alias("object_name")
    )
    return sinks.file_set_increment(listing, listing.filter("event_id % 10 = 0"), 48, "hour", moment(EVENTS_AS_OF))


@query(
    "a17_export_report",
    "select cast(o_orderkey as varchar) as order_no, coalesce(nullif(o_orderstatus, 'O'), '') as state, strftime(o_orderdate, '%Y-%m-%d') as day_text from orders",
)
def a17(spark, d):
    df = base(spark, d, "orders").select("o_orderkey", F.expr("nullif(o_orderstatus, 'O')").alias("s"), F.to_date("o_orderdate").alias("day"))
    return sinks.export_report(df, ["order_no", "state", "day_text"], scratch_path(spark, "report"))


@query(
    "a18_export_with_manifest",
    "with x as (select 'nation' as item, count(*) as rows from nation union all select 'customer', count(*) from customer union all select 'orders', count(*) from orders)"
    " select item, rows, 'ok' as status from x union all select 'TOTAL', cast(sum(rows) as bigint), 'ok' from x",
)
def a18(spark, d):
    tables = {t: base(spark, d, t) for t in ("nation", "customer", "orders")}
    return sinks.export_with_manifest(spark, tables, scratch_path(spark, "export"), "nightly").select("item", "rows", "status")


@query(
    "a18_export_with_failures",
    "select 'nation' as item, count(*) as rows, 'ok' as status from nation union all select 'broken', null, 'failed' union all select 'nothing', 0, 'empty'"
    " union all select 'orders', count(*), 'ok' from orders union all select 'TOTAL', (select count(*) from nation) + (select count(*) from orders), 'failed'",
)
def a18_failed(spark, d):
    """A table that breaks while it is written leaves the others as they are."""
    orders = base(spark, d, "orders")
    broken = orders.select(F.when(F.col("o_orderkey") > 0, F.raise_error(F.lit("broken row"))).alias("c"))
    tables = {"nation": base(spark, d, "nation"), "broken": broken, "nothing": orders.filter("o_orderkey < 0"), "orders": orders}
    return sinks.export_with_manifest(spark, tables, scratch_path(spark, "export"), "nightly").select("item", "rows", "status")


@query(
    "a19_select_databases",
    "with l as (select concat('db_', lower(c_mktsegment)) as db from customer union all select case when s_suppkey % 2 = 0 then 'mysql' else 'sys' end from supplier)"
    " select 'list' as how, db, count(*) as n from l where db in ('db_building', 'db_machinery') group by 2"
    " union all select 'word', db, count(*) from l where instr(db, 'hold') > 0 group by 2"
    " union all select 'all', db, count(*) from l where db not in ('mysql', 'sys') group by 2",
)
def a19(spark, d):
    customers = base(spark, d, "customer").select(F.concat(F.lit("db_"), F.lower("c_mktsegment")).alias("db"))
    system = base(spark, d, "supplier").select(F.when(F.col("s_suppkey") % 2 == 0, "mysql").otherwise("sys").alias("db"))
    listing = customers.unionByName(system)
    parts = [
        sinks.select_databases(listing, wanted).groupBy(F.lit(how).alias("how"), "db").agg(F.count(F.lit(1)).alias("n"))
        for how, wanted in [("list", "db_building,db_machinery,mysql"), ("word", "hold"), ("all", None)]
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "a20_write_hash_buckets",
    with_inputs("orders_tgt") + "select count(*) as rows, count(distinct order_id) as keys, 1::bigint as buckets_per_key from orders_tgt",
)
def a20(spark, d):
    path = scratch_path(spark, "buckets")
    sinks.write_hash_buckets(orders_tgt(spark, d), path, ["order_id"], 8)
    per_key = spark.read.parquet(path).groupBy("order_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("bucket").alias("b"))
    return per_key.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("keys"), F.max("b").alias("buckets_per_key"))


@query("a21_page", "select o_orderkey, o_custkey, o_orderstatus from orders order by o_orderkey limit 50 offset 100")
def a21(spark, d):
    return scan.page(base(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_orderkey"], 100, 50)


@query("a21_deep_page", "select l_orderkey, l_linenumber, l_quantity from lineitem order by l_orderkey, l_linenumber limit 70 offset (select count(*) * 9 // 10 from lineitem)")
def a21_deep(spark, d):
    lines = base(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return scan.page(lines, ["l_orderkey", "l_linenumber"], lines.count() * 9 // 10, 70)


@query(
    "a0_sync_list",
    "select 'orders' as table_name, count(*) as rows from orders where o_orderdate >= timestamp '2001-07-02' union all select 'nation', count(*) from nation",
)
def a0(spark, d):
    """A sync list decides per table how much is read."""
    from rowtide.operators.filters import recent
    from rowtide.plans.inputs import ORDERS_AS_OF

    parts = []
    for spec in SyncSpec.parse_list("orders:o_orderdate:30,nation::"):
        rows = recent(base(spark, d, spec.table), spec.time_col, spec.window or 0, spec.unit, ORDERS_AS_OF)
        parts.append(rows.agg(F.lit(spec.table).alias("table_name"), F.count(F.lit(1)).alias("rows")))
    return reduce(DataFrame.unionByName, parts)
