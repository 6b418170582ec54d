"""Laws and golden cases of sync, repair, archive, numbering and schema operators."""

import datetime as dt
import random

import pytest
from pyspark.sql import Row, functions as F, types as T

from rowtide.functions import rows as rowfn
from rowtide.operators import aggregates as agg, archive, filters, joins, months, reconcile, schema, slowlog, sync
from rowtide.operators.numbering import add_surrogate_key, number_rows
from rowtide.plans import inputs, jobs
from rowtide.session import scratch_path
from rowtide.sources import scan, sinks, splits
from rowtide.specs import CdcSpec, SyncSpec, TableCatalog

AS_OF = dt.datetime(2001, 8, 1)
WINDOW = (90, "day", AS_OF)
KEY, TS = ["order_id"], "updated_at"


@pytest.fixture(scope="module")
def pair(spark, sf):
    return inputs.orders_src(spark, sf).persist(), inputs.orders_tgt(spark, sf).persist()


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_window_replace_twice_is_once(pair):
    src, tgt = pair
    once = sync.window_replace(src, tgt, KEY, TS, *WINDOW)
    assert same(once, sync.window_replace(src, once, KEY, TS, *WINDOW))


def test_rows_without_a_time_stay(spark):
    cols = "order_id int, updated_at timestamp_ntz"
    tgt = spark.createDataFrame([(1, None), (2, dt.datetime(2001, 7, 30))], cols)
    src = spark.createDataFrame([(3, dt.datetime(2001, 7, 31))], cols)
    assert sorted(r[0] for r in sync.window_replace(src, tgt, KEY, TS, *WINDOW).collect()) == [1, 3]
    assert sorted(r[0] for r in archive.archive_purge(tgt, TS, 1, "day", AS_OF).collect()) == [1]


def test_sync_then_orphan_delete_leaves_no_difference_in_the_window(pair):
    src, tgt = pair
    synced = sync.delete_orphans(src, sync.window_replace(src, tgt, KEY, TS, *WINDOW), KEY)
    left, right = filters.recent(src, TS, *WINDOW), filters.recent(synced, TS, *WINDOW)
    assert {r["status"] for r in reconcile.reconcile_rows(left, right, KEY).collect()} == {"same"}


def test_repair_makes_all_days_equal(pair):
    src, tgt = pair
    for only_extra in (False, True):
        fixed = reconcile.repair_days(src, tgt, KEY, TS, 122, AS_OF, only_extra)
        assert reconcile.reconcile_days(src, fixed, TS, 122, AS_OF).filter("status = 'differ'").isEmpty()


def test_archive_splits_the_source(pair):
    src, _ = pair
    kept, moved, log = archive.archive_move(src, src.limit(0), KEY, TS, 600, "day", AS_OF)
    assert same(kept.unionByName(moved), src)
    assert log.first()["rows"] == moved.count()


def test_month_target_rewrites_only_changed_months(spark, pair):
    src, tgt = pair
    path = scratch_path(spark, "months")
    sinks.write_month_partitioned(tgt, path, TS, KEY)
    files = lambda: {r["path"] for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").collect()}
    before = files()
    months = sync.sync_month_target(src, path, KEY, TS, *WINDOW)
    gone = {p.split("yyyymm=")[1][:6] for p in before - files()}
    assert gone == set(months) and len(months) < 10
    want = sync.window_replace(src, tgt, KEY, TS, *WINDOW)
    assert same(sync.read_month_target(spark, path).select(*want.columns), want)


def test_a_month_that_loses_its_last_row_disappears(spark):
    cols = "order_id int, updated_at timestamp_ntz"
    old = spark.createDataFrame([(1, dt.datetime(2001, 6, 3)), (2, dt.datetime(2001, 7, 3))], cols)
    path = scratch_path(spark, "months")
    sinks.write_month_partitioned(old, path, TS, KEY)
    sync.sync_month_target(spark.createDataFrame([(1, dt.datetime(2001, 7, 9))], cols), path, KEY, TS, *WINDOW)
    assert [(r["order_id"], r["yyyymm"]) for r in sync.read_month_target(spark, path).collect()] == [(1, "200107")]


def test_archive_in_two_steps_keeps_the_boundary_month(spark):
    cols = "order_id int, updated_at timestamp_ntz"
    days = [(i, dt.datetime(2001, 5, 1) + dt.timedelta(days=i)) for i in range(60)]
    path = scratch_path(spark, "arch")
    sinks.write_month_partitioned(spark.createDataFrame(days, cols), f"{path}/live", TS, KEY)
    for n in (75, 60, 45):
        archive.archive_month_target(spark, f"{path}/live", f"{path}/old", KEY, TS, n, "day", AS_OF)
    old = sorted(r["order_id"] for r in sync.read_month_target(spark, f"{path}/old").collect())
    live = sorted(r["order_id"] for r in sync.read_month_target(spark, f"{path}/live").collect())
    assert old + live == list(range(60)) and days[old[-1]][1] <= AS_OF - dt.timedelta(days=45) < days[live[0]][1]


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_numbering_with_a_hot_group_of_copies(spark, partitions):
    rng = random.Random(1)
    data = [(1, "x")] * 400 + [(rng.randrange(50), rng.choice("ab")) for _ in range(600)] + [(None, "n")] * 5
    got = number_rows(spark.createDataFrame(data, "k int, s string"), ["k", "s"], partitions=partitions).collect()
    got.sort(key=lambda r: r["row_num"])
    assert [r["row_num"] for r in got] == list(range(1, len(data) + 1))
    want = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(r["k"], r["s"]) for r in got] == want


def test_copies_are_spread_over_blocks(spark, monkeypatch):
    from rowtide.operators import numbering

    monkeypatch.setattr(numbering, "_COPIES_PER_BLOCK", 7)
    got = add_surrogate_key(spark.createDataFrame([(1,)] * 100 + [(2,)] * 3, "k int")).collect()
    assert sorted((r["pkid"], r["k"]) for r in got) == [(i, 1) for i in range(1, 101)] + [(i, 2) for i in range(101, 104)]


def test_row_hash_tells_nulls_apart(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "a", None)], "k int, x string, y string")
    assert df.select(rowfn.row_hash(["x", "y"])).distinct().count() == 2


def test_row_status_sees_null_changes(spark):
    cols = "k int, v string"
    a = spark.createDataFrame([(1, None), (2, "x"), (3, None)], cols)
    b = spark.createDataFrame([(1, None), (2, None), (4, "y")], cols)
    got = {r["k"]: r["status"] for r in reconcile.row_status(a, b, ["k"]).collect()}
    assert got == {1: "same", 2: "changed", 3: "missing", 4: "extra"}


def test_key_ranges_cover_everything_with_hot_keys(spark):
    keys = [5] * 500 + list(range(1000))
    got = splits.key_ranges(spark.createDataFrame([(k,) for k in keys], "id bigint"), "id", 5).orderBy("lo").collect()
    assert sum(r["rows"] for r in got) == len(keys)
    assert all(a["hi"] < b["lo"] for a, b in zip(got, got[1:]))
    preds = splits.range_predicates(spark.createDataFrame([(1, 4), (5, 9)], "lo int, hi int"), "id")
    assert preds == ["id < 5", "id >= 5", "id is null"]


def test_choose_split(spark):
    sparse = spark.range(0, 4000, 4)
    assert splits.choose_split(sparse, "id", floor=100).first()["split"] == "date"
    assert splits.choose_split(sparse, "id", floor=5000).first()["split"] == "id"
    assert splits.choose_split(sparse, "id").first()["split"] == "date"
    assert splits.choose_split(sparse.limit(0), "id").first()["split"] == "id"


def test_day_predicates(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 2, 5),), (dt.datetime(2024, 1, 2, 9),)], "ts timestamp_ntz")
    assert splits.day_predicates(splits.day_slices(df, "ts"), "ts") == ["ts is not null", "ts is null"]


def test_specs():
    assert SyncSpec.parse_list("a:ts:7,b::") == [SyncSpec("a", "ts", 7), SyncSpec("b")]
    cat = TableCatalog({"t_a": "", "t_b": "", "x": ""}, {"t_a": ("id",), "x": ("id",)}, "db")
    assert scan.resolve_tables("db.t*.ts$auto,db.x.ts$ods,other.x.ts$ods,db.t_b.ts$ods", cat) == [CdcSpec("db", "t_a", "ts", "db"), CdcSpec("db", "x", "ts", "ods")]


def test_time_column_choice():
    ts = T.TimestampNTZType()
    make = lambda *fields: T.StructType([T.StructField(n, ts, null) for n, null in fields])
    assert scan.choose_time_column(make(("paid", False), ("update_time", False), ("create_dt", False))) == "create_dt"
    assert scan.choose_time_column(make(("create_time", True), ("paid", False))) == "paid"
    assert scan.choose_time_column(make(("create_time", True))) is None
    assert scan.incremental_candidates(T.StructType([T.StructField("d", T.DateType()), T.StructField("i", T.IntegerType())])) == ["d"]


def test_jdbc_options():
    assert scan.jdbc_options("jdbc:x", table="t", fetch_size=5) == {"url": "jdbc:x", "fetchsize": "5", "dbtable": "t"}
    assert scan.jdbc_options("jdbc:x", query="select 1")["query"] == "select 1"
    with pytest.raises(ValueError):
        scan.jdbc_options("jdbc:x")


def test_ddl(spark):
    df = spark.createDataFrame([(1, "7", "x")], "id int, n string, gone string")
    out = schema.apply_ddl(df, ["alter table db.t add `Price` decimal(10,2), change n n int", "ALTER TABLE t DROP COLUMN gone, change id ID2 bigint", "alter table t add price int"])
    assert out.dtypes == [("id2", "int"), ("n", "int"), ("price", "decimal(10,2)")]
    assert out.first() == Row(id2=1, n=7, price=None)
    assert schema.apply_ddl(df, ["alter table t change gone gone int"]).first()["gone"] is None


def test_statement_kinds(spark):
    texts = ["create unique index `i1` on t(a)", "DROP TABLE IF EXISTS db.t", "alter table t rename to x", "", "create view v as select 1", "insert into `a`.`b` values (1)", " delete  from\n t where 1"]
    got = schema.classify_statement(spark.createDataFrame([(t,) for t in texts], "statement string")).collect()
    assert [(r["op"], r["object"]) for r in got] == [(None, "i1"), ("DROP_TABLE", "t"), (None, "t"), (None, None), (None, "v"), ("INSERT", "b"), ("DELETE", "t")]


def test_type_maps(spark):
    cols = spark.createDataFrame([("datetime", "YES", 6), ("decimal", "NO", 0), ("TINYINT", "NO", None)], "data_type string, is_nullable string, datetime_precision int")
    assert [r["target_type"] for r in schema.map_schema(cols, "clickhouse").collect()] == ["Nullable(DateTime64)", "String", "Int16"]
    assert schema.target_struct([("a", "decimal(12,3)", True), ("b", "datetime", False)]).simpleString() == "struct<a:decimal(12,3),b:timestamp_ntz>"
    assert schema.target_struct([("a", "decimal(12,3)", True)], legacy_types=True).simpleString() == "struct<a:string>"


def test_comments_and_keys(spark):
    src = schema.with_comments(spark.range(1).toDF("ID"), {"ID": "the key"})
    assert schema.carry_comments(src, spark.range(1)).schema["id"].metadata == {"comment": "the key"}
    df = spark.createDataFrame([(1, None, 1), (1, 2, 2)], "a int, b int, c int")
    assert schema.find_key(df, [["a"], ["b"], ["c"]]) == ["c"]
    assert schema.find_key(df, [["a"], ["b"]]) is None


def test_dedupe_keeps_rows_outside_the_condition(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, "a", 1), (4, "a", 0), (5, "b", 1), (6, "b", None)], "id int, g string, flag int")
    ids = lambda compat: sorted(r["id"] for r in reconcile.dedupe_max(df, ["g"], "id", "flag = 1", compat).collect())
    assert ids(False) == [1, 4, 5, 6]
    assert ids(True) == [1, 2, 4, 5, 6]


def test_filters_golden(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 23, 59, 59, 500000)), (2, dt.datetime(2024, 1, 2)), (3, None)], "id int, ts timestamp_ntz")
    ids = lambda d: sorted(r["id"] for r in d.collect())
    assert ids(filters.on_day(df, "ts", dt.date(2024, 1, 1))) == [1]
    assert ids(filters.on_day(df, "ts", dt.date(2024, 1, 1), compat=True)) == []
    assert ids(filters.recent(df, None, 1, "day", AS_OF)) == [1, 2, 3]
    assert ids(filters.where_text(df, " ")) == [1, 2, 3]
    assert filters.high_water(df.limit(0), "ts", AS_OF).first()[0] == AS_OF
    keys = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    assert ids(filters.keys_equal(df, "id", keys)) == [1]
    assert [r["day"].day for r in filters.last_days(spark, 2, dt.date(2024, 1, 3)).collect()] == [1, 2, 3]


def test_latest_rows_keep_ties_and_drop_missing_keys(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, 4, "c"), (None, 9, "d"), (2, None, "e")], "k int, t int, v string")
    assert sorted(r["v"] for r in joins.latest_per_key_semi(df, ["k"], "t").collect()) == ["a", "b"]
    assert sorted(r["v"] for r in joins.latest_by_max_id(df, ["k"], "t").collect()) == ["a", "b", "d"]


def test_whitelist_with_nulls_is_no_trap(spark):
    log = spark.createDataFrame([(1, "get"), (1, "set"), (2, "get")], "dbid int, command string")
    wl = spark.createDataFrame([(1, "get", "1"), (1, None, "1"), (2, "get", "0")], "dbid int, command string, status string")
    assert sorted(map(tuple, joins.not_whitelisted(log, wl).collect())) == [(1, "set"), (2, "get")]


def test_either_key_counts_a_self_job_once(spark):
    jobs = spark.createDataFrame([(1, 7, 7), (2, 7, 8), (3, None, 8)], "job int, a int, b int")
    ids = spark.createDataFrame([(7,), (8,)], "db_id bigint")
    assert sorted((r["db_id"], r["job"]) for r in joins.either_key(jobs, ids, "a", "b", "db_id").collect()) == [(7, 1), (7, 2), (8, 2), (8, 3)]


def test_parts_of_a_long_text_join_to_the_whole(spark):
    df = spark.createDataFrame([("g", i % 97, i) for i in range(500)], "g string, v int, o int")
    whole = agg.concat_group(df, ["g"], "v", order="o", bounded=True).first()["joined"]
    parts = agg.concat_group(df, ["g"], "v", order="o", chunk=F.floor(F.col("o") / 60)).orderBy("part").collect()
    assert ",".join(r["joined"] for r in parts) == whole and len(parts) == 9


def test_progress_of_nothing(spark):
    assert spark.range(1).select(agg.progress(F.lit(0), F.lit(0))).first()[0] == 0.0
    stats = spark.createDataFrame([(1, "u", 1, AS_OF, 0, 5.0, 1.0, 1.0)], "dbid int, username string, sql_id int, snap timestamp_ntz, executions int, elapsed_s double, rows_processed double, disk_reads double")
    assert agg.statement_stats(stats).isEmpty()


def test_slow_blocks(spark):
    text = (
        "# Time: 2024-01-01T00:00:07Z\n# User@Host: u3[u3] @ 10.0.0.8:3306[]\n# Query_time: 6.55 Lock_time: 0.10 Rows_sent: 3 Rows_examined: 120\nuse app;\nselect *\n  from t  where né = 8;\n"
        "# Time: nonsense\nselect 1;\n# Time: 2024-01-01T00:00:09Z\n# User@Host: root[root] @ localhost []\n# Query_time: 1 Lock_time: 0 Rows_sent: 0 Rows_examined: 0\nuse app;\n\n"
    )
    path = scratch_path(spark, "slow")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    parsed = slowlog.parse_slow_blocks(slowlog.read_records(spark, path, slowlog.BLOCK_MARK), 1, 2)
    good = slowlog.accepted(parsed).collect()
    assert len(good) == 1 and slowlog.rejected(parsed).count() == 2
    row = good[0]
    assert (row["user"], row["host"], row["query_time"], row["rows_examined"], row["db"]) == ("u3", "10.0.0.8", 6.55, 120, "app")
    assert row["sql_text"] == "select * from t where né = 8;" and row["bytes"] == len(row["sql_text"].encode())
    assert slowlog.accepted(parsed, dt.datetime(2024, 1, 1, 0, 0, 7)).isEmpty()


def test_fingerprint(spark):
    cases = {
        "SELECT  a FROM t1 WHERE b='x''y' and c = -1.5": "select a from t1 where b=? and c = -?",
        "select * from t where id in (1, 2,3) and n in ('a')": "select * from t where id in(?+) and n in(?+)",
        "insert into t values (1,'a'), (2,'b')": "insert into t values(?+)",
    }
    got = spark.createDataFrame([(k,) for k in cases], "q string").select(slowlog.fingerprint(F.col("q"))).collect()
    assert [r[0] for r in got] == list(cases.values())


def test_upsert_statement(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "sql_id int, t string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "sql_id int, t string")
    assert sorted(map(tuple, slowlog.upsert_statement(old, new).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_file_increment(spark):
    names = ["p/a_20240130120000.jpg", "p/a_20240128120000.jpg", "p/x.jpg", "p/b_20240130130000_20240130230000.png"]
    listing = spark.createDataFrame([(n,) for n in names], "object_name string")
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    picked = lambda n, unit: sorted(r[0] for r in sinks.file_set_increment(listing, listing.limit(0), n, unit, as_of).collect())
    assert picked(13, "hour") == [names[0], names[3]]
    assert picked(60, "min") == [names[3]]
    assert len(picked(None, "all")) == 4


def test_report_rows_blank_nulls(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert sinks.report_rows(df, ["x", "y"]).first().asDict() == {"x": "1", "y": ""}


def test_very_long_statements_are_taken_whole(spark):
    values = ", ".join(["'it\\\\'s'"] * 40_000)
    arg = f"select * from t where v in ({values})"
    path = scratch_path(spark, "long")
    record = "$VAR1 = {\n  Query_time => '1.5',\n  arg => '" + arg.replace("'", "\\'") + "',\n  db => 'app',\n  ts => '240101 00:00:07',\n  user => 'u db => x'\n};"
    block = f"# Time: 2024-01-01T00:00:07Z\n# User@Host: u[u] @ h []\n# Query_time: 6.55 Lock_time: 0.10 Rows_sent: 3 Rows_examined: 120\nuse app;\n{arg};"
    spark.createDataFrame([(record,)], "value string").coalesce(1).write.text(f"{path}/dump")
    spark.createDataFrame([(block,)], "value string").coalesce(1).write.text(f"{path}/blocks")
    dump = slowlog.accepted(slowlog.parse_digest_dump(slowlog.read_records(spark, f"{path}/dump", slowlog.DUMP_MARK))).first()
    assert len(dump["sql_text"]) > 300_000 and (dump["db"], dump["user"], dump["host"]) == ("app", "u db => x", None)
    block = slowlog.accepted(slowlog.parse_slow_blocks(slowlog.read_records(spark, f"{path}/blocks", slowlog.BLOCK_MARK))).first()
    assert block["sql_text"] == arg + ";"
    made = spark.createDataFrame([(arg.replace("\\\\", "\\"),), ("insert into t values " + ", ".join(["(1, 'a')"] * 50_000),)], "q string").select(slowlog.fingerprint(F.col("q"))).collect()
    assert [r[0] for r in made] == ["select * from t where v in(?+)", "insert into t values(?+)"]


def test_listing_and_indexed_time_column(spark, sf):
    cat = scan.catalog_of(sf, ["nation", "Region"])
    assert sorted(r[0] for r in scan.list_tables(spark, cat).collect()) == ["nation", "region"]
    ts = T.TimestampNTZType()
    made = T.StructType([T.StructField("closed", T.DateType()), T.StructField("update_dt", ts), T.StructField("create_time", ts)])
    assert scan.choose_time_column(made, {"closed", "update_dt"}) == "update_dt"
    assert scan.choose_time_column(made, {"closed"}) == "closed"
    assert scan.choose_time_column(made) is None


def test_a_row_without_a_time_that_gets_one_moves_to_its_month(spark):
    cols = "order_id int, updated_at timestamp_ntz"
    for others in ([], [(2, None)]):
        path = scratch_path(spark, "nulls")
        sinks.write_month_partitioned(spark.createDataFrame([(1, None), (3, dt.datetime(2001, 1, 1)), *others], cols), path, TS, KEY)
        sync.sync_month_target(spark.createDataFrame([(1, dt.datetime(2001, 7, 9))], cols), path, KEY, TS, *WINDOW)
        got = {r["order_id"]: r["yyyymm"] for r in sync.read_month_target(spark, path).collect()}
        assert got == {1: "200107", 3: "200101", **{k: None for k, _ in others}}


def test_keyless_month_target(spark):
    cols = "v int, updated_at timestamp_ntz"
    old, new = (1, dt.datetime(2001, 1, 1)), (2, dt.datetime(2001, 7, 9))
    path = scratch_path(spark, "keyless")
    sinks.write_month_partitioned(spark.createDataFrame([old, old, new], cols), path, TS, ["v"])
    sync.sync_month_target(spark.createDataFrame([old, new, new, new], cols), path, [], TS, *WINDOW)
    assert sorted(r["v"] for r in sync.read_month_target(spark, path).collect()) == [1, 1, 2, 2, 2]


def test_buckets_are_found_without_a_walk_over_all_marks(spark):
    df = spark.createDataFrame([(k,) for k in (None, -1, 0, 3, 4, 5, 9, 10, 99)], "k bigint")
    for marks in ([], [3], [0, 4, 9], list(range(0, 90, 2)), list(range(200))):
        placed = df.select("k", splits.bucket_of("k", marks).alias("b"))
        assert {r["k"]: r["b"] for r in placed.collect()} == {r["k"]: None if r["k"] is None else sum(m < r["k"] for m in marks) for r in df.collect()}
        assert len(marks) > 100 or "lambda" not in placed._jdf.queryExecution().executedPlan().toString()


def test_rows_are_numbered_once_before_a_load_in_ranges(spark, sf, monkeypatch):
    inputs.orders_src(spark, sf).write.parquet(f"{(place := scratch_path(spark, 'numbers'))}/orders.parquet")
    seen, first = [], jobs._first_load
    monkeypatch.setattr(jobs, "_first_load", lambda s, rows, *rest: (seen.append(rows._jdf.queryExecution().executedPlan().toString()), first(s, rows, *rest))[1])
    source = scan.catalog_of(place, ["orders"], {"orders": ("order_id",)})
    moved, _ = jobs.sync_table(spark, source, SyncSpec.parse_list(f"orders:{TS}:90")[0], f"{place}/to", AS_OF, modes=("surrogate:pkid",))
    assert "FileScan parquet" in seen[0] and "Exchange" not in seen[0]
    back = spark.read.parquet(f"{place}/to/orders")
    assert sorted(r["pkid"] for r in back.select("pkid").collect()) == list(range(1, moved + 1))


def test_orphans_leave_with_null_and_repeated_keys(spark):
    day = dt.datetime(2001, 7, 1)
    held = spark.createDataFrame([(1, "a", day), (1, None, day), (2, "b", dt.datetime(2001, 5, 1)), (2, "b", day), (None, None, day), (3, "c", None)], "k int, s string, at timestamp_ntz")
    sinks.write_month_partitioned(held, (path := scratch_path(spark, "held")), "at", ["k"])
    source = spark.createDataFrame([(1, None), (1, None), (2, "b")], "k int, s string").withColumn("at", F.lit(day).cast("timestamp_ntz"))
    assert months.orphans_month_target(source, path, ["k", "s"], "at") == [None, "200107"]
    assert sorted((r["k"], r["s"] or "") for r in spark.read.parquet(path).collect()) == [(1, ""), (2, "b"), (2, "b")]
    assert months.orphans_month_target(source, path, ["k", "s"], "at") == []
