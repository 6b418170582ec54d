"""Nothing is dropped or doubled: late files, null keys, moved keys, empty folders, other schemas."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowtide.operators import aggregates, archive, changes as cdc, images, load, ordered, reconcile, schema, sync
from rowtide.sources import scan, sinks, splits
from rowtide.streaming import changes as streams, metrics, seen

AS_OF = dt.datetime(2001, 8, 1)


def test_predicates_cover_every_row_once(spark):
    rows = [(i if i % 3 else None, f"k'{i % 7}" if i % 5 else None, dt.datetime(2024, 1, 1 + i % 9, i % 24) if i % 4 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, name string, ts timestamp_ntz")
    later = df.unionByName(spark.createDataFrame([(-5, "", dt.datetime(2023, 1, 1)), (10_000, "zzz", dt.datetime(2025, 1, 1)), (77, "k'35", dt.datetime(2024, 1, 5))], df.schema))
    for made in (
        splits.range_predicates(splits.key_ranges(df, "id", 6), "id"), splits.range_predicates(splits.key_blocks(df, "id", 0, 50), "id"),
        splits.day_predicates(splits.day_slices(df, "ts"), "ts"), splits.day_predicates(splits.day_slices(df, "ts"), "ts", 3),
        splits.range_predicates(df.groupBy("name").agg(F.min("name").alias("lo"), F.max("name").alias("hi")), "name"),
    ):
        hits = [F.coalesce(F.expr(p).cast("int"), F.lit(0)) for p in made]
        assert later.select(sum(hits, F.lit(0)).alias("n")).distinct().collect() == [(1,)]


@pytest.mark.parametrize("md5", [False, True])
def test_row_status_tells_nulls_borders_repeats_and_types(spark, md5):
    cols = "k int, a string, b string, n int"
    src = spark.createDataFrame([(1, None, "x", 5), (2, "a,b", "c", 5), (3, "p", "q", 5), (3, "p", "q", 6), (4, "s", "t", 1), (4, "s", "t", 1), (None, "u", "v", 1)], cols)
    tgt = spark.createDataFrame([(1, "", "x", 5), (2, "a", "b,c", 5), (3, "p", "q", 6), (4, "s", "t", 1), (4, "s", "t", 1), (None, "u", "v", 1)], cols.replace("n int", "n bigint"))
    got = {r["k"]: r["status"] for r in reconcile.row_status(src, tgt, ["k"], md5).collect()}
    assert got == {1: "changed", 2: "changed", 3: "changed", 4: "same", None: "same"}


def test_upsert_twice_adds_a_null_key_once(spark):
    src = spark.createDataFrame([(None, "a", dt.datetime(2001, 7, 31)), (1, "b", dt.datetime(2001, 7, 31))], "k int, v string, ts timestamp_ntz")
    once = sync.window_upsert(src, src.limit(0), ["k"], "ts", 5, "day", AS_OF)
    assert sync.window_upsert(src, once, ["k"], "ts", 5, "day", AS_OF).count() == 2


def _old(spark, rows):
    return spark.createDataFrame([(k, dt.datetime(*ts)) for k, ts in rows], "k int, ts timestamp_ntz")


def test_archive_moves_a_key_out_of_the_month_it_was_in(spark, tmp_path):
    live, old = str(tmp_path / "live"), str(tmp_path / "old")
    sinks.write_month_partitioned(_old(spark, [(1, (2000, 1, 5)), (2, (2000, 3, 5))]), old, "ts", ["k"])
    sinks.write_month_partitioned(_old(spark, [(1, (2000, 3, 9)), (5, (2001, 7, 9))]), live, "ts", ["k"])
    assert archive.archive_month_target(spark, live, old, ["k"], "ts", 30, "day", AS_OF) == 1
    assert sorted((r["k"], r["yyyymm"]) for r in sync.read_month_target(spark, old).collect()) == [(1, "200003"), (2, "200003")]


def test_a_row_that_arrives_during_the_move_stays_in_the_source(spark, tmp_path, monkeypatch):
    live, old = str(tmp_path / "live"), str(tmp_path / "old")
    sinks.write_month_partitioned(_old(spark, [(1, (2000, 1, 5)), (2, (2000, 1, 6)), (None, (2000, 1, 7)), (None, (2000, 1, 7)), (5, (2001, 7, 1)), (6, (2001, 7, 30))]), live, "ts", ["k"])
    rewrite = archive.rewrite_partitions

    def meanwhile(*args):
        rewrite(*args)
        sinks.write_month_partitioned(_old(spark, [(99, (2000, 1, 6)), (98, (2001, 7, 1))]), live, "ts", ["k"], mode="append")

    monkeypatch.setattr(archive, "rewrite_partitions", meanwhile)
    held = lambda path: sorted((r["k"] for r in sync.read_month_target(spark, path).collect()), key=repr)
    assert archive.archive_month_target(spark, live, old, ["k"], "ts", 30, "day", AS_OF) == 5
    monkeypatch.undo()
    assert held(live) == [6, 98, 99] and held(old) == [1, 2, 5, None, None]
    assert archive.archive_month_target(spark, live, old, ["k"], "ts", 30, "day", AS_OF) == 2
    assert held(live) == [6] and held(old) == [1, 2, 5, 98, 99, None, None]


@pytest.mark.parametrize("dies_in", ["remove_path", "mark_folder", "finish_replacing"])
def test_a_move_that_dies_goes_on(spark, tmp_path, monkeypatch, dies_in):
    live, old = str(tmp_path / "live"), str(tmp_path / "old")
    sinks.write_month_partitioned(_old(spark, [(1, (2000, 1, 5)), (5, (2001, 7, 1)), (6, (2001, 7, 30))]), live, "ts", ["k"])
    with monkeypatch.context() as m:
        module = sinks
        called = []

        def die(*args):
            called.append(args)
            raise OSError("gone")

        if dies_in == "finish_replacing":
            m.setattr(module, "finish_replacing", die)
        else:
            m.setattr(module, dies_in, die)
        with pytest.raises(OSError):
            archive.archive_month_target(spark, live, old, ["k"], "ts", 30, "day", AS_OF)
    assert archive.archive_month_target(spark, live, old, ["k"], "ts", 30, "day", AS_OF) == 0
    assert [r["k"] for r in sync.read_month_target(spark, live).collect()] == [6]
    assert sorted(r["k"] for r in sync.read_month_target(spark, old).collect()) == [1, 5]


def test_a_load_goes_on_where_it_died(spark, tmp_path):
    path = str(tmp_path / "loaded")
    df = spark.createDataFrame([(i if i % 9 else None, dt.datetime(2024, 1, 1 + i % 5)) for i in range(300)], "k int, ts timestamp_ntz")
    asked = []

    def read(predicate):
        asked.append(predicate)
        if len(asked) == 3:
            raise OSError("lost")
        return df.where(predicate)

    make = lambda: load.reading_plan(df, ["k"], "ts", 4)
    with pytest.raises(OSError):
        load.ranged_load(spark, read, make, path, at_once=1)
    left, tried = load.load_left(spark, path), len(asked)
    assert 1 <= left <= 3 and load.loaded(spark, path).count() < 300
    ledger = load.ranged_load(spark, read, lambda: pytest.fail("planned twice"), path, at_once=1)
    assert len(asked) == tried + left and load.load_left(spark, path) == 0
    assert ledger.agg(F.sum("rows")).first()[0] == load.loaded(spark, path).count() == 300
    load.ranged_load(spark, read, make, path)
    assert len(asked) == tried + left
    sparse = spark.createDataFrame([(i * 1000, dt.datetime(2024, 1, 1 + i % 5)) for i in range(50)], "k int, ts timestamp_ntz")
    assert len(load.reading_plan(sparse, ["k"], "ts", 5, floor=0)) == 6  # five days and rows without one
    assert len(load.reading_plan(sparse, [], "ts", 2)) == 3 and load.reading_plan(sparse, [], None, 2) == ["true"]


def test_archive_of_everything_leaves_a_target_that_syncs(spark, tmp_path):
    live, old = str(tmp_path / "live"), str(tmp_path / "old")
    rows = _old(spark, [(1, (2000, 1, 5)), (2, (2000, 3, 5))])
    sinks.write_month_partitioned(rows, live, "ts", ["k"])
    assert archive.archive_month_target(spark, live, old, ["k"], "ts", 30, "day", AS_OF) == 2
    assert archive.archive_month_target(spark, live, old, ["k"], "ts", 30, "day", AS_OF) == 0
    assert sync.read_month_target(spark, live, like=rows).count() == 0
    fresh = _old(spark, [(7, (2001, 7, 20))])
    assert sync.sync_month_target(fresh, live, ["k"], "ts", 30, "day", AS_OF) == ["*"]
    assert sync.sync_month_target(fresh, live, ["k"], "ts", 30, "day", AS_OF) == ["200107"]
    assert [r["k"] for r in sync.read_month_target(spark, live).collect()] == [7]


def test_ddl_of_other_schemas_and_any_case(spark):
    rows = [("alter table crm.t0 drop column val", "crm.x"), ("ALTER  TABLE `app`.`t0` ADD COLUMN note varchar(5)", "app.t0"), ("Alter Table t0 add other int", "app.t0"), ("alter table t0 add wrong int", "crm.t0")]
    log = spark.createDataFrame([(1, i, 0, tbl, "query", text) for i, (text, tbl) in enumerate(rows)], "file_no long, pos long, seq long, tbl string, op string, statement string")
    assert [r["statement"] for r in images.statements_of(log).filter("tbl = 'app.t0'").orderBy("pos").collect()] == [rows[1][0], rows[2][0]]
    assert schema.keep_ddl(log).count() == 4


def test_clauses_that_change_no_column_are_skipped(spark):
    steps = schema.ddl_steps("alter table t add index ix (c), add primary key (id), drop index ix, add unique(c), add (a int, b decimal(4,2)), modify c bigint, add constraint f foreign key (a) references o (x), change x y int, add d varchar(3) default 'a,b'")
    assert steps == [("add", "a", None, "int"), ("add", "b", None, "decimal(4,2)"), ("retype", "c", None, "bigint"), ("rename", "x", "y", None), ("add", "d", None, "varchar(3)")]
    with pytest.raises(ValueError):
        schema.ddl_steps("alter table t add lonely")


def test_statements_are_read_by_clauses(spark):
    text = """ALTER TABLE `app`.`t` /* both, here */ ADD COLUMN IF NOT EXISTS c decimal(10, 2) unsigned DEFAULT '1,5' COMMENT 'it''s (new), first' FIRST,
        modify a decimal( 12 , 4 ) not null after `odd``name`, drop column if exists gone, -- a comment, with a comma
        change "b" `B` varchar (20) charset utf8 default "x", rename column d to e, rename to other, engine = InnoDB, alter column a set default 3, add (x int, y enum('a,b', 'c)'), key (x)), drop primary key;"""
    steps = schema.alter_steps(text)
    assert steps == [
        ("add", "c", None, "decimal(10,2) unsigned", ""), ("retype", "a", None, "decimal(12,4)", "odd`name"), ("drop", "gone", None, None, None),
        ("retype", "b", None, "varchar(20)", None), ("rename", "d", "e", None, None), ("add", "x", None, "int", None), ("add", "y", None, "enum('a,b','c)')", None),
    ]
    df = spark.createDataFrame([(1.25, "7", 2)], "a double, b string, gone int")
    got = schema.apply_ddl(df, ["alter table t add column if not exists c decimal(10, 2) first, add n int unsigned after a", "alter table t drop column if exists gone, drop column if exists never, modify a decimal(12, 4), change b b int"])
    assert got.schema.simpleString() == "struct<c:decimal(10,2),a:decimal(12,4),n:bigint,b:int>" and str(got.first()["a"]) == "1.2500"
    for wrong in ("alter table t add lonely", "alter table t frobnicate c int", "alter table t add c decimal(10", "alter table t rename column a b", "create table t (c int)"):
        with pytest.raises(ValueError):
            schema.alter_steps(wrong)


def test_the_first_of_repeated_inserts_counts(spark):
    rows = spark.createDataFrame([(1, "late", 2, 9, 1), (1, "first", 2, 3, 1), (None, "n", 1, 1, 1), (2, "there", 1, 1, 1)], "k int, v string, file_no long, pos long, seq long")
    target = spark.createDataFrame([(2, "old")], "k int, v string")
    got = cdc.idempotent_insert(target, rows, ["k"])
    assert sorted(((r["k"], r["v"]) for r in got.collect()), key=repr) == sorted([(1, "first"), (2, "old"), (None, "n")], key=repr)


def _event(spark, seq, day):
    return spark.createDataFrame([(seq, seq // 10, seq % 10, "app.t", "insert", 1, 1, 0.5, "x", dt.datetime(2024, 1, day, 5))], "seq long, file_no long, pos long, tbl string, op string, before_pk long, pk long, val double, kind string, ts timestamp_ntz")


def test_late_files_are_kept_and_counted(spark, tmp_path):
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    for seq, day in ((31, 20), (12, 2), (31, 20), (5, 1)):  # each run sees one more file, older and older
        streams.write_change_files(_event(spark, seq, day), log)
        seen.dedupe_stream(streams.read_changes(spark, log), out, f"{out}-ck").awaitTermination()
        metrics.ops_metrics(streams.read_changes(spark, log), 86400, f"{out}-m", f"{out}-mck").awaitTermination()
    assert sorted(r["seq"] for r in spark.read.parquet(out).collect()) == [5, 12, 31]
    counted = {r["window_start"].day: r["event_amount"] for r in metrics.read_ops_metrics(spark, f"{out}-m").collect()}
    assert counted == {20: 2, 2: 1, 1: 1}


@pytest.mark.parametrize("seed", range(4))
def test_places_seen_are_kept_exactly(seed):
    rng = np.random.default_rng(seed)
    known, seen_places = np.zeros((0, 2), np.int64), set()
    for _ in range(20):
        places = np.stack([rng.integers(0, 40, 30), rng.integers(-3, 4, 30)], axis=1)
        fresh, known = seen.unseen(known, places)
        want = []
        for p in map(tuple, places.tolist()):
            want.append(p not in seen_places)
            seen_places.add(p)
        assert fresh.tolist() == want
        known = seen.unpack(seen.pack(known))
    assert known.tolist() == sorted(map(list, seen_places))


def test_repeats_are_found_without_reading_the_log(spark, tmp_path):
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    columns = "seq long, file_no long, pos long, tbl string, op string, before_pk long, pk long, val double, kind string, ts timestamp_ntz"
    for run in range(3):  # every run delivers the events before it again; blocks and places at their borders, and one without a place
        rows = [(i, 9, i * 40_000, "app.t", "insert", 1, 1, 0.5, "x", None) for i in range(10 * (run + 1))] + [(None, None, None, "app.t", "insert", 1, run, 0.5, "x", None)]
        streams.write_change_files(spark.createDataFrame(rows, columns), f"{log}/{run}")
        query = seen.dedupe_stream(streams.read_changes(spark, f"{log}/*"), out, f"{out}-ck")
        query.awaitTermination()
        assert f"{out}/" not in query._jsq.explainInternal(False)
    got = spark.read.parquet(out).collect()
    assert sorted(r["seq"] for r in got if r["seq"] is not None) == list(range(30))
    assert sorted(r["pk"] for r in got if r["seq"] is None) == [0, 1, 2]


def test_small_log_files_share_blocks_and_folders(spark, tmp_path):
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    columns = "seq long, file_no long, pos long, tbl string, op string, before_pk long, pk long, val double, kind string, ts timestamp_ntz"
    rows = [(0, f, 4, "app.t", "insert", 1, 1, 0.5, "x", None) for f in range(100)]  # told apart by the log file alone
    for _ in range(2):
        streams.write_change_files(spark.createDataFrame(rows + rows[:50], columns), log)
        query = seen.dedupe_stream(streams.read_changes(spark, log), out, f"{out}-ck")
        query.awaitTermination()
    assert sorted(r["file_no"] for r in spark.read.parquet(out).collect()) == list(range(100))
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 4
    assert not list((tmp_path / "out").glob("batch=*/file_no=*"))


def test_changes_without_time_are_counted(spark, tmp_path):
    times = [None, dt.datetime(2024, 1, 1, 0, 59, 59, 999999), dt.datetime(2024, 1, 1, 1), None, dt.datetime(1969, 12, 31, 23, 59, 59, 500000)]
    rows = spark.createDataFrame([(t, "insert") for t in times], "ts timestamp_ntz, op string")
    got = {r["window_start"]: r["event_amount"] for r in aggregates.ops_by_interval(rows, 3600).collect()}
    assert got == {None: 2, dt.datetime(2024, 1, 1): 1, dt.datetime(2024, 1, 1, 1): 1, dt.datetime(1969, 12, 31, 23): 1}


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_cuts_are_exact_whatever_the_sketch_says(spark, accuracy):
    rng = random.Random(1)
    keys = [7] * 700 + [rng.randrange(-500, 500) for _ in range(1300)] + [None] * 50
    df = spark.createDataFrame([(k,) for k in keys], "k int").repartition(5)
    held = sorted(k for k in keys if k is not None)
    want = [held[(i * len(held) + 7) // 8 - 1] for i in range(1, 8)]
    assert splits.exact_cuts(df, "k", 8, accuracy) == want
    assert splits.exact_cuts(df.limit(0), "k", 8, accuracy) == []
    assert splits.key_ranges(df, "k", 8, accuracy).agg(F.sum("rows")).first()[0] == len(keys)


@pytest.mark.parametrize("order", [["k", "s"], ["s", "k", "i"], ["t", "i"]])
def test_deep_pages(spark, order):
    rng = random.Random(2)
    rows = [(i, None if i % 11 == 0 else 5 if i % 3 == 0 else rng.randrange(300), f"s{i % 400:03d}", dt.datetime(2024, 1, 1) + dt.timedelta(days=i % 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "i int, k int, s string, t timestamp_ntz").repartition(6)
    want = [tuple(r) for r in df.orderBy(*order, "i").collect()]
    for offset, n in ((0, 5), (1000, 7), (2700, 300), (2995, 50), (5000, 5)):
        got = [tuple(r) for r in scan.page(df, [*order, "i"], offset, n).collect()]
        assert sorted(got, key=repr) == sorted(want[offset : offset + n], key=repr)


def test_rows_without_a_place_stay(spark):
    t = dt.datetime(2024, 1, 1)
    samples = spark.createDataFrame([(1, t, 5), (None, t, 6), (1, None, 7), (1, t + dt.timedelta(minutes=1), 65)], "k int, ts timestamp_ntz, v long")
    got = {r["v"]: (r["delta"], r["per_second"]) for r in ordered.counter_delta(samples, ["k"], "v", ["ts", "v"], "ts").collect()}
    assert got == {5: (None, None), 6: (None, None), 7: (None, None), 65: (60, 1.0)}
    assert sorted(r["v"] for r in ordered.rejected_samples(samples, ["k"], "ts").collect()) == [6, 7]
    log = spark.createDataFrame([(1, 1, 1, "a", "insert"), (1, 2, 2, None, "insert"), (None, 3, 3, "a", "delete")], "file_no long, pos long, seq long, tbl string, op string")
    assert {r["seq"]: r["run_no"] for r in ordered.label_runs(log).collect()} == {1: 1, 2: None, 3: None}
    assert ordered.runs(log).agg(F.sum("n")).first()[0] == 3
