"""Queries for batch sync, reconciliation, repair and archive."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from rowtide.functions.timing import moment
from rowtide.operators import archive, load, reconcile, sync
from rowtide.operators.numbering import add_surrogate_key
from rowtide.plans import inputs
from rowtide.plans.inputs import ORDERS_AS_OF, base, with_inputs
from rowtide.plans.jobs import sync_tables
from rowtide.plans.registry import query
from rowtide.session import scratch_path
from rowtide.sources import sinks
from rowtide.sources.scan import catalog_of
from rowtide.specs import SyncSpec

PAIR = with_inputs("orders_tgt")
KEY, TS = ["order_id"], "updated_at"
# the window of the sync queries: 90 days up to the as-of time
WINDOW = (90, "day", ORDERS_AS_OF)
START = "timestamp '2001-05-03'"


def _pair(spark, d):
    return inputs.orders_src(spark, d), inputs.orders_tgt(spark, d)


@query(
    "y0_sync_job",
    "select 'orders' as tbl, count(*) filter (o_orderdate >= timestamp '2001-05-03') as moved, count(*) as held from orders union all select 'lineitem', count(*) filter (l_shipdate >= timestamp '2001-05-03'), count(*) from lineitem"
    " union all select 'nation', count(*), count(*) from nation",
)
def y0(spark, d):
    """A whole job: a keyed, a keyless and a full table, run twice; the second run finds the first one's targets."""
    target = scratch_path(spark, "job")
    source = catalog_of(d, ["orders", "lineitem", "nation"], {"orders": ("o_orderkey",), "nation": ("n_nationkey",)})
    specs = SyncSpec.parse_list("orders:o_orderdate:90,lineitem:l_shipdate:90,nation::")
    sync_tables(spark, source, specs, target, ORDERS_AS_OF)
    log = sync_tables(spark, source, specs, target, ORDERS_AS_OF, allow={"nation": "n_name#n_nationkey"})
    held = [spark.read.parquet(f"{target}/{s.table}").agg(F.lit(s.table).alias("tbl"), F.count(F.lit(1)).alias("held")) for s in specs]
    return log.select("tbl", "moved").join(reduce(DataFrame.unionByName, held), "tbl")


# a second state of the source: rows changed, moved to other days, new and gone
_NEXT = (
    "next as (select order_id, cust_id, status, amount + case when order_id % 7 = 0 then 1 else 0 end as amount, priority, updated_at - to_days(case when order_id % 50 = 0 then 40 else 0 end) as updated_at"
    " from orders_src where order_id % 61 <> 0)"
)


def _next(spark, d) -> DataFrame:
    rows = inputs.orders_src(spark, d).filter("order_id % 61 <> 0")
    moved = F.col(TS) - F.when(F.col("order_id") % 50 == 0, F.expr("interval 40 days")).otherwise(F.expr("interval 0 days"))
    return rows.withColumn("amount", F.col("amount") + F.when(F.col("order_id") % 7 == 0, 1).otherwise(0)).withColumn(TS, moved)


_TOTALS = "count(*) as rows, cast(sum(order_id) as bigint) as keys, cast(sum(cast(amount as decimal(18,2))) as decimal(38,2)) as amount"
_DIFFER = "(select day from (select cast(updated_at as date) as day, count(*) as n from next where updated_at >= timestamp '2001-05-03' and updated_at < timestamp '2001-08-02' group by 1) full outer join (select cast(updated_at as date) as day, count(*) as m from u where updated_at >= timestamp '2001-05-03' and updated_at < timestamp '2001-08-02' group by 1) using (day) where n is distinct from m)"


@query(
    "y0_sync_job_modes",
    with_inputs("orders_src") + f", {_NEXT}, w as (select * from next where updated_at >= {START}), u as (select * from orders_src where order_id not in (select order_id from w) union all select * from w),"
    f" g as (select * from u where order_id in (select order_id from next)), b as {_DIFFER}, f as (select * from next where cast(updated_at as date) in (select day from b)),"
    " r as (select * from u where cast(updated_at as date) not in (select day from b) and order_id not in (select order_id from f) union all select * from f),"
    " s as (select row_number() over (order by order_id, cust_id, status, amount, priority, updated_at) as pkid, * from orders_src),"
    f" z as (select * from s where updated_at < {START} union all select row_number() over (order by order_id, cust_id, status, amount, priority, updated_at) + (select max(pkid) from s), * from w)"
    f" select 'upsert' as mode, (select count(*) from w) as moved, {_TOTALS}, 0::bigint as numbers from u union all select 'orphans', (select count(*) from w), {_TOTALS}, 0 from g"
    f" union all select 'repair', (select count(*) from w), {_TOTALS}, 0 from r union all select 'surrogate', (select count(*) from w), {_TOTALS}, cast(sum(pkid) as bigint) from z",
)
def y0_modes(spark, d):
    """Four targets loaded from one state of a table and brought on from the next one: by upsert, then without orphans, then with differing days repaired, and with numbers of their own."""
    place = scratch_path(spark, "job")
    inputs.orders_src(spark, d).write.parquet(f"{place}/one/orders.parquet")
    _next(spark, d).write.parquet(f"{place}/two/orders.parquet")

    def run(mode: tuple[str, ...]) -> DataFrame:
        name = mode[-1].partition(":")[0]
        spec = SyncSpec.parse_list(f"orders:{TS}:90")
        for state in ("one", "two"):
            log = sync_tables(spark, catalog_of(f"{place}/{state}", ["orders"], {"orders": tuple(KEY)}), spec, f"{place}/{name}", ORDERS_AS_OF, modes={"orders": mode})
        held = sync.read_month_target(spark, f"{place}/{name}/orders")
        numbers = F.sum("pkid").cast("bigint") if name == "surrogate" else F.lit(0).cast("bigint")
        total = F.sum(F.col("amount").cast("decimal(18,2)")).cast("decimal(38,2)")
        sums = held.agg(F.count(F.lit(1)).alias("rows"), F.sum("order_id").cast("bigint").alias("keys"), total.alias("amount"), numbers.alias("numbers"))
        return sums.select(F.lit(name).alias("mode"), F.lit(log.first()["moved"]).cast("bigint").alias("moved"), "*")

    modes = [("upsert",), ("upsert", "orphans"), ("upsert", "repair:90"), ("surrogate:pkid",)]
    with ThreadPoolExecutor(len(modes)) as pool:  # each has a target of its own
        return reduce(DataFrame.unionByName, list(pool.map(run, modes)))


@query("y1_init_load", PAIR + "select 'empty' as target, * from orders_src union all select 'filled', * from orders_tgt")
def y1(spark, d):
    src, tgt = _pair(spark, d)
    loaded = sync.init_load(src, tgt.limit(0)).withColumn("target", F.lit("empty"))
    return loaded.unionByName(sync.init_load(src, tgt).withColumn("target", F.lit("filled")))


@query(
    "y1_ranged_load",
    with_inputs("orders_src") + "select 'stopped' as run, 3::bigint as done, false as whole, 0::bigint as rows, 0::bigint as keys union all select 'resumed', 9, true, count(*), cast(sum(order_id) as bigint) from orders_src"
    " union all select 'composite', 5, true, count(*), cast(sum(l_orderkey * 10 + l_linenumber) as bigint) from lineitem",
)
def y1_ranges(spark, d):
    """A load by key ranges that stops after three of them and goes on; and one by the first part of a composite key."""
    src, lines, parts = inputs.orders_src(spark, d), base(spark, d, "lineitem"), []

    def note(run, ledger, path, key):
        whole = load.load_left(spark, path) == 0
        total = load.loaded(spark, path).agg(F.count(F.lit(1)), F.sum(key).cast("bigint")).first() if whole else (0, 0)
        parts.append((run, ledger.count(), whole, *total))

    path = scratch_path(spark, "loaded")
    for run, most in (("stopped", 3), ("resumed", None)):
        note(run, load.ranged_load(spark, src.where, lambda: load.reading_plan(src, KEY, TS, 8), path, most=most), path, "order_id")
    path = scratch_path(spark, "loaded")
    ledger = load.ranged_load(spark, lines.where, lambda: load.reading_plan(lines, ["l_orderkey", "l_linenumber"], None, 4), path)
    note("composite", ledger, path, F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return spark.createDataFrame(parts, "run string, done bigint, whole boolean, rows bigint, keys bigint")


@query("y2_full_refresh", "select n_nationkey, n_name, n_regionkey from nation union all select cast(o_custkey % 25 as integer), o_orderpriority, cast(null as integer) from orders")
def y2(spark, d):
    source = base(spark, d, "nation").unionByName(
        base(spark, d, "orders").selectExpr("cast(o_custkey % 25 as int) as n_nationkey", "o_orderpriority as n_name", "cast(null as int) as n_regionkey")
    )
    path = scratch_path(spark, "refresh")
    base(spark, d, "nation").write.parquet(path)
    fresh = sync.full_refresh(source, spark.read.parquet(path))
    fresh.write.mode("overwrite").parquet(f"{path}-new")
    return spark.read.parquet(f"{path}-new")


@query(
    "y3_window_replace",
    PAIR + f", w as (select * from orders_src where updated_at >= {START}) select * from orders_tgt where updated_at < {START} and order_id not in (select order_id from w) union all select * from w",
)
def y3(spark, d):
    src, tgt = _pair(spark, d)
    return sync.window_replace(src, tgt, KEY, TS, *WINDOW)


@query(
    "y3_window_replace_written",
    PAIR + f", w as (select * from orders_src where updated_at >= {START}), n as (select * from orders_tgt where updated_at < {START} and order_id not in (select order_id from w) union all select * from w)"
    " select strftime(updated_at, '%Y%m') as yyyymm, count(*) as rows, cast(sum(order_id) as bigint) as keys, cast(sum(cast(amount as decimal(18,2))) as decimal(38,2)) as amount from n group by 1",
)
def y3_written(spark, d):
    """The same on a month-partitioned target: only the months of the window are rewritten, twice to the same end."""
    src, tgt = _pair(spark, d)
    path = scratch_path(spark, "target")
    sinks.write_month_partitioned(tgt, path, TS, KEY)
    for _ in range(2):
        sync.sync_month_target(src, path, KEY, TS, *WINDOW)
    total = F.sum(F.col("amount").cast("decimal(18,2)")).cast("decimal(38,2)")
    back = sync.read_month_target(spark, path)
    return back.groupBy("yyyymm").agg(F.count(F.lit(1)).alias("rows"), F.sum("order_id").alias("keys"), total.alias("amount"))


@query(
    "y4_window_upsert",
    PAIR + f", w as (select * from orders_src where updated_at >= {START}) select * from orders_tgt where order_id not in (select order_id from w) union all select * from w",
)
def y4(spark, d):
    src, tgt = _pair(spark, d)
    return sync.window_upsert(src, tgt, KEY, TS, *WINDOW)


LINES = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate"]
_COLS = ", ".join(LINES)


@query(
    "y5_window_replace_surrogate",
    f"with t as (select row_number() over (order by {_COLS}) as pkid, {_COLS} from lineitem where l_linenumber < 4), m as (select max(pkid) as m from t)"
    " select * from t where l_shipdate < timestamp '2001-05-03'"
    f" union all select row_number() over (order by {_COLS}) + (select m from m), {_COLS} from lineitem where l_shipdate >= timestamp '2001-05-03'",
)
def y5(spark, d):
    lines = base(spark, d, "lineitem").select(*LINES)
    target = add_surrogate_key(lines.filter("l_linenumber < 4"))
    return sync.window_replace_surrogate(lines, target, "pkid", "l_shipdate", *WINDOW)


@query(
    "y6_window_replace_nokey",
    f"select {_COLS} from lineitem where l_linenumber < 4 and l_shipdate < timestamp '2001-05-03' union all select {_COLS} from lineitem where l_shipdate >= timestamp '2001-05-03'",
)
def y6(spark, d):
    lines = base(spark, d, "lineitem").select(*LINES)
    return sync.window_replace_nokey(lines, lines.filter("l_linenumber < 4"), "l_shipdate", *WINDOW)


@query("y7_merge_counts", PAIR + "select case when order_id in (select order_id from orders_tgt) then 'update' else 'insert' end as action, count(*) as rows from orders_src group by 1")
def y7(spark, d):
    return sync.merge_counts(*_pair(spark, d), KEY)


@query("y7_merge_rows", PAIR + "select * from orders_tgt where order_id not in (select order_id from orders_src) union all select * from orders_src")
def y7_rows(spark, d):
    return sync.merge_rows(*_pair(spark, d), KEY)


@query("y8_delete_orphans", PAIR + "select * from orders_tgt where order_id in (select order_id from orders_src)")
def y8(spark, d):
    return sync.delete_orphans(*_pair(spark, d), KEY)


# four months up to the as-of day
DAYS = 122
_DAYS = (
    PAIR + ", s as (select cast(updated_at as date) as day, count(*) as n from orders_src where updated_at >= timestamp '2001-04-01' and updated_at < timestamp '2001-08-02' group by 1),"
    " t as (select cast(updated_at as date) as day, count(*) as n from orders_tgt where updated_at >= timestamp '2001-04-01' and updated_at < timestamp '2001-08-02' group by 1),"
    " r as (select coalesce(s.day, t.day) as day, coalesce(s.n, 0) as source_rows, coalesce(t.n, 0) as target_rows, case when coalesce(s.n, 0) = coalesce(t.n, 0) then 'equal' else 'differ' end as status"
    " from s full outer join t on s.day = t.day)"
)


@query("y9_reconcile_days", _DAYS + " select * from r")
def y9(spark, d):
    return reconcile.reconcile_days(*_pair(spark, d), TS, DAYS, ORDERS_AS_OF)


_FRESH = ", f as (select * from orders_src where cast(updated_at as date) in (select day from r where status = 'differ'))"


@query(
    "y10_repair_days",
    _DAYS + _FRESH + " select * from orders_tgt where cast(updated_at as date) not in (select day from r where status = 'differ') and order_id not in (select order_id from f) union all select * from f",
)
def y10(spark, d):
    return reconcile.repair_days(*_pair(spark, d), KEY, TS, DAYS, ORDERS_AS_OF)


@query(
    "y10_repair_days_upsert",
    _DAYS + _FRESH + " select * from orders_tgt where cast(updated_at as date) not in (select day from r where status = 'differ' and target_rows > source_rows)"
    " and order_id not in (select order_id from f) union all select * from f",
)
def y10_upsert(spark, d):
    return reconcile.repair_days(*_pair(spark, d), KEY, TS, DAYS, ORDERS_AS_OF, delete_only_if_extra=True)


_ROW_STATUS = (
    PAIR + ", j as (select coalesce(s.order_id, t.order_id) as order_id, case when t.order_id is null then 'missing' when s.order_id is null then 'extra'"
    " when (s.cust_id, s.status, s.amount, s.priority, s.updated_at) is distinct from (t.cust_id, t.status, t.amount, t.priority, t.updated_at) then 'changed' else 'same' end as status"
    " from orders_src s full outer join orders_tgt t on s.order_id = t.order_id)"
)


@query("y11_reconcile_rows", _ROW_STATUS + " select status, count(*) as rows from j group by 1")
def y11(spark, d):
    return reconcile.reconcile_rows(*_pair(spark, d), KEY)


@query("y11_row_status", _ROW_STATUS + " select * from j where status <> 'same'")
def y11_status(spark, d):
    return reconcile.row_status(*_pair(spark, d), KEY, md5=True).filter("status <> 'same'")


# error values drawn from the customers
_ERRORS = (
    "errors as (select cast(c_custkey as varchar) as val, '0' as flag, cast(null as timestamp) as repair_time,"
    " timestamp '2001-08-01' - to_hours(cast(c_custkey % 200 as integer)) as create_time from customer where c_custkey % 7 = 0)"
)


def _errors(spark, d):
    return base(spark, d, "customer").filter("c_custkey % 7 = 0").selectExpr(
        "cast(c_custkey as string) as val", "'0' as flag", "cast(null as timestamp_ntz) as repair_time",
        "timestamp_ntz '2001-08-01 00:00:00' - make_dt_interval(0, cast(c_custkey % 200 as int)) as create_time",
    )


@query(
    "y12_repair_by_key_list",
    PAIR + f", {_ERRORS}, v as (select val from errors where create_time >= timestamp '2001-07-29'), f as (select * from orders_src where cast(cust_id as varchar) in (select val from v))"
    " select * from orders_tgt where order_id not in (select order_id from f) union all select * from f",
)
def y12(spark, d):
    src, tgt = _pair(spark, d)
    return reconcile.repair_by_key_list(src, tgt, _errors(spark, d), "cust_id", KEY, ORDERS_AS_OF)


@query(
    "y12_repair_tables",
    PAIR + f", {_ERRORS}, v as (select val from errors where create_time >= timestamp '2001-07-29'), f as (select * from orders_src where cast(cust_id as varchar) in (select val from v)),"
    " t as (select order_id, cust_id as id from orders_tgt where order_id not in (select order_id from f) union all select order_id, cust_id from f),"
    " c as (select c_custkey as id, case when cast(c_custkey as varchar) in (select val from v) then c_name else 'old' end as name from customer)"
    " select 'orders' as tbl, count(*) as rows, cast(sum(order_id) as bigint) as keys, count(*) filter (cast(id as varchar) in (select val from v)) as repaired from t"
    " union all select 'customer', count(*), cast(sum(id) as bigint), count(*) filter (name <> 'old') from c union all select 'errors', count(*), null, count(*) filter (create_time >= timestamp '2001-07-29') from errors",
)
def y12_tables(spark, d):
    """Two tables repaired by one list of error values, which is flagged afterwards."""
    src, tgt = _pair(spark, d)
    people = base(spark, d, "customer").selectExpr("c_custkey as id", "c_name as name")
    pairs = {"orders": (src, tgt, "cust_id", KEY), "customer": (people, people.withColumn("name", F.lit("old")), "id", ["id"])}
    new, errors = reconcile.repair_tables(pairs, _errors(spark, d), ORDERS_AS_OF)
    values = errors.filter("flag = '1'").select(F.col("val").alias("_val"))
    orders = new["orders"].join(values, F.col("cust_id").cast("string") == F.col("_val"), "left").agg(F.lit("orders").alias("tbl"), F.count(F.lit(1)).alias("rows"), F.sum("order_id").cast("bigint").alias("keys"), F.count("_val").alias("repaired"))
    held = new["customer"].agg(F.lit("customer").alias("tbl"), F.count(F.lit(1)).alias("rows"), F.sum("id").cast("bigint").alias("keys"), F.count_if(F.col("name") != "old").alias("repaired"))
    listed = errors.agg(F.lit("errors").alias("tbl"), F.count(F.lit(1)).alias("rows"), F.lit(None).cast("bigint").alias("keys"), F.count_if((F.col("flag") == "1") & F.col("repair_time").isNotNull()).alias("repaired"))
    return orders.unionByName(held).unionByName(listed)


@query(
    "y12_flag_repaired",
    f"with {_ERRORS} select val, case when create_time >= timestamp '2001-07-29' then '1' else flag end as flag,"
    " case when create_time >= timestamp '2001-07-29' then timestamp '2001-08-01' end as repair_time, create_time from errors",
)
def y12_flag(spark, d):
    return reconcile.flag_repaired(_errors(spark, d), ORDERS_AS_OF)


@query(
    "y13_dedupe_max",
    "with t as (select event_id, user_id, event_type, value > 20 as c from events)"
    " select 'first' as keep, event_id from t where not c union all select 'first', min(event_id) from t where c group by user_id, event_type"
    " union all select 'one less', event_id from t where event_id not in (select max(event_id) from t where c group by user_id, event_type having count(*) > 1)",
)
def y13(spark, d):
    rows = base(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    group = ["user_id", "event_type"]
    first = reconcile.dedupe_max(rows, group, "event_id", "value > 20").select(F.lit("first").alias("keep"), "event_id")
    less = reconcile.dedupe_max(rows, group, "event_id", "value > 20", compat=True).select(F.lit("one less").alias("keep"), "event_id")
    return first.unionByName(less)


@query(
    "y14_compact_latest",
    "select user_id, event_type, event_id, ts, value from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1",
)
def y14(spark, d):
    rows = base(spark, d, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return reconcile.compact_latest(rows, ["user_id", "event_type"], ["ts", "event_id"])


# everything older than 600 days is archived; a hundredth of the old rows is already there
OLD = (600, "day", ORDERS_AS_OF)
END = "timestamp '1999-12-10'"
ARCHIVED = "archived as (select * from orders_src where order_id % 100 = 0 and updated_at < timestamp '1997-01-01')"


def _archived(spark, d):
    return inputs.orders_src(spark, d).filter((F.col("order_id") % 100 == 0) & (F.col(TS) < moment("1997-01-01 00:00:00")))


@query("y15_archive_window", with_inputs("orders_src") + f"select min(updated_at) as window_start, {END} as window_end, count(*) filter (updated_at <= {END}) as rows from orders_src")
def y15(spark, d):
    return archive.archive_window(inputs.orders_src(spark, d), TS, *OLD)


@query(
    "y16_archive_check",
    with_inputs("orders_src") + f", {ARCHIVED}, n as (select (select count(*) from orders_src where updated_at <= {END}) as s, (select count(*) from archived where updated_at <= {END}) as t)"
    " select 'plain' as kind, s as source_rows, t as target_rows, 'target_not_empty' as status from n union all select 'cover', s, t, 'ok' from n union all select 'no key', s, t, 'no_key' from n"
    " union all select 'unordered', s, t, 'time_column_not_ordered' from n union all select 'purge', s, 0, 'ok' from n"
    " union all select 'nothing', (select count(*) from orders_src where updated_at <= timestamp '1990-01-01'), 0, 'no_rows'",
)
def y16(spark, d):
    src, old = inputs.orders_src(spark, d), _archived(spark, d)
    early = datetime(1991, 8, 24)
    cases = [
        ("plain", old, KEY, False, [TS], ORDERS_AS_OF), ("cover", old, KEY, True, [TS], ORDERS_AS_OF), ("no key", old, [], False, [TS], ORDERS_AS_OF),
        ("unordered", old, KEY, False, ["order_id"], ORDERS_AS_OF), ("purge", None, KEY, False, [TS], ORDERS_AS_OF), ("nothing", None, KEY, False, [TS], early),
    ]
    out = [
        archive.archive_check(src, tgt, key, TS, 600, "day", as_of, cover, ordered).withColumn("kind", F.lit(kind))
        for kind, tgt, key, cover, ordered, as_of in cases
    ]
    return reduce(DataFrame.unionByName, out)


@query(
    "y17_archive_move",
    with_inputs("orders_src") + f", {ARCHIVED}, m as (select * from orders_src where updated_at <= {END})"
    f" select 'kept' as part, * from orders_src where updated_at > {END} union all select 'archive', * from m union all select 'archive', * from archived where order_id not in (select order_id from m)",
)
def y17(spark, d):
    kept, moved, _ = archive.archive_move(inputs.orders_src(spark, d), _archived(spark, d), KEY, TS, *OLD, cover=True)
    return kept.withColumn("part", F.lit("kept")).unionByName(moved.withColumn("part", F.lit("archive")))


@query(
    "y17_archive_move_written",
    with_inputs("orders_src") + f"select case when updated_at <= {END} then 'archive' else 'kept' end as part, strftime(updated_at, '%Y%m') as yyyymm, count(*) as rows, cast(sum(order_id) as bigint) as keys from orders_src group by 1, 2",
)
def y17_written(spark, d):
    """The same on month-partitioned folders; the second run finds nothing left to move."""
    path = scratch_path(spark, "archive")
    sinks.write_month_partitioned(inputs.orders_src(spark, d), f"{path}/live", TS, KEY)
    for _ in range(2):
        archive.archive_month_target(spark, f"{path}/live", f"{path}/old", KEY, TS, *OLD)
    kept = sync.read_month_target(spark, f"{path}/live").withColumn("part", F.lit("kept"))
    both = kept.unionByName(sync.read_month_target(spark, f"{path}/old").withColumn("part", F.lit("archive")))
    return both.groupBy("part", "yyyymm").agg(F.count(F.lit(1)).alias("rows"), F.sum("order_id").alias("keys"))


# some keys are null; rows of old times come in after the first run
_LIVE = "live as (select case when order_id % 500 = 0 then null else order_id end as id, amount, updated_at from orders_src)"


@query(
    "y17_archive_job",
    with_inputs("orders_src") + f", {_LIVE}, late as (select id + 2000000 as id, amount, updated_at from live where id % 300 = 1 and updated_at <= {END}),"
    f" n as (select (select count(*) from live where updated_at <= {END}) as old, (select count(*) from late) as late, (select count(*) from live where updated_at > {END}) as kept)"
    " select 1 as run, 'ok' as status, old as source_rows, 0 as target_rows, old as moved, kept as live_rows, old as archived, (select count(*) from live where id is null and updated_at <= timestamp '1999-12-10') as null_keys from n"
    " union all select 2, 'target_not_empty', late, old, 0, kept + late, old, (select count(*) from live where id is null and updated_at <= timestamp '1999-12-10') from n"
    " union all select 3, 'ok', late, old, late, kept, old + late, (select count(*) from live where id is null and updated_at <= timestamp '1999-12-10') from n",
)
def y17_job(spark, d):
    """An archive job run three times: the move, one that its checks stop, and one with cover for rows that came late; some keys are null."""
    path = scratch_path(spark, "archive-job")
    rows = inputs.orders_src(spark, d).select(F.when(F.col("order_id") % 500 != 0, F.col("order_id")).alias("id"), "amount", TS)
    sinks.write_month_partitioned(rows, f"{path}/live", TS, ["id"])
    late = rows.filter((F.col("id") % 300 == 1) & (F.col(TS) <= moment("1999-12-10 00:00:00"))).withColumn("id", F.col("id") + 2000000)
    parts = []
    for run, cover in ((1, False), (2, False), (3, True)):
        if run == 2:
            sinks.write_month_partitioned(late, f"{path}/live", TS, ["id"], mode="append")
        log = archive.archive_job(spark, f"{path}/live", f"{path}/old", ["id"], TS, *OLD, cover=cover).select("status", "source_rows", "target_rows", "moved")
        held, old = sync.read_month_target(spark, f"{path}/live").count(), sync.read_month_target(spark, f"{path}/old")
        nulls = old.filter("id is null").count()
        parts.append(log.select(F.lit(run).alias("run"), "*", F.lit(held).cast("bigint").alias("live_rows"), F.lit(old.count()).cast("bigint").alias("archived"), F.lit(nulls).cast("bigint").alias("null_keys")))
    return reduce(DataFrame.unionByName, parts)


@query("y18_archive_purge", with_inputs("orders_src") + f"select * from orders_src where updated_at >= {END}")
def y18(spark, d):
    return archive.archive_purge(inputs.orders_src(spark, d), TS, *OLD)


@query(
    "y19_transfer",
    PAIR + "select 'part' as form, * from orders_tgt where not coalesce(nullif(status, 'P') = 'F', false) union all select 'part', * from orders_src where status = 'F' union all select 'all', * from orders_src",
)
def y19(spark, d):
    src, tgt = _pair(spark, d)
    part = sync.transfer(src, tgt, "nullif(status, 'P') = 'F'").withColumn("form", F.lit("part"))
    return part.unionByName(sync.transfer(src, tgt).withColumn("form", F.lit("all")))


_RUNS = "runs as (select o_orderpriority as tag, o_orderstatus as tbl, o_orderdate as started_at, o_orderkey as rows from orders)"


@query("y20_run_log", f"with {_RUNS} select * from runs qualify row_number() over (partition by tag, tbl order by started_at desc, rows desc) = 1")
def y20(spark, d):
    runs = base(spark, d, "orders").selectExpr("o_orderpriority as tag", "o_orderstatus as tbl", "o_orderdate as started_at", "o_orderkey as rows")
    return reconcile.run_log(runs.filter("rows % 2 = 0"), runs.filter("rows % 2 = 1"), ["tag", "tbl"], ["started_at", "rows"])
