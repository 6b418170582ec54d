"""Golden cases and laws of the change log operators."""

import random

import pytest

from rowtide.operators import changes as cdc, images, ordered
from rowtide.operators.changes import CHANGE_SCHEMA
from rowtide.session import scratch_path
from rowtide.streaming import apply as applying, changes as streams

KEYS, IMAGES = ["tbl", "pk"], ["val", "kind", "ts"]
COLS = ["tbl", "pk", "val", "kind", "ts"]
TARGET = "tbl string, pk bigint, val double, kind string, ts timestamp_ntz"


def log(spark, rows):
    """rows of (file, pos, op, before, pk, val)"""
    full = [(i, f, p, "app.t", op, b, k, v, "k", None) for i, (f, p, op, b, k, v) in enumerate(rows)]
    return spark.createDataFrame(full, CHANGE_SCHEMA)


def target(spark, rows):
    return spark.createDataFrame([("app.t", k, v, "k", None) for k, v in rows], TARGET)


def live(df):
    return {r["pk"]: r["val"] for r in df.collect()}


def fold(start, rows, compat=False):
    state = dict(start)
    for _, _, op, before, pk, val in sorted(rows, key=lambda r: (r[0], r[1])):
        if op == "delete":
            state.pop(pk, None)
        else:
            if op == "update" and before != pk and not compat:
                state.pop(before, None)
            state[pk] = val
    return state


def random_log(seed, n=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        op = rng.choice(["insert", "update", "update", "delete"])
        pk = rng.choice([1, 1, 1, rng.randrange(30)])
        before = rng.randrange(30) if op == "update" and rng.random() < 0.3 else pk
        rows.append((8 + i // 40, 4 + i % 40 * 37, op, before, pk, float(i)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("compat", [False, True])
def test_apply_is_the_fold_of_the_log(spark, seed, compat):
    rows, start = random_log(seed), {k: -1.0 for k in range(0, 40, 2)}
    shuffled = rows[:]
    random.Random(seed).shuffle(shuffled)
    got = cdc.apply_changes(target(spark, start.items()), log(spark, shuffled), KEYS, IMAGES, compat=compat)
    assert live(got) == fold(start, rows, compat)


def test_any_split_into_batches_in_any_order_gives_the_same_target(spark):
    rows, start = random_log(7), {k: -1.0 for k in range(0, 40, 2)}
    path = scratch_path(spark, "split")
    applying.write_snapshot(target(spark, start.items()), path)
    cuts = [rows[:40], rows[200:], rows[40:130], rows[130:200], rows[200:260]]  # out of order, one part twice
    for number, part in enumerate(cuts):
        applying.merge_batch(log(spark, part), path, IMAGES, number)
    assert live(applying.live_rows(spark, path, COLS)) == fold(start, rows)
    applying.merge_batch(log(spark, cuts[2]), path, IMAGES, 2)  # a batch that runs again replaces itself
    assert live(applying.live_rows(spark, path, COLS)) == fold(start, rows)
    applying.fold(spark, path, f"{path}-new")
    applying.merge_batch(log(spark, [(99, 1, "insert", 77, 77, 7.0)]), f"{path}-new", IMAGES, 5)
    assert live(applying.live_rows(spark, f"{path}-new", COLS)) == fold(start, rows) | {77: 7.0}


def test_empty_batch_changes_nothing(spark):
    path = scratch_path(spark, "empty")
    applying.merge_batch(log(spark, []), path, IMAGES, 0)  # also as the first
    assert live(applying.live_rows(spark, path, COLS)) == {}
    applying.write_snapshot(target(spark, [(1, 1.0)]), path)
    applying.merge_batch(log(spark, []), path, IMAGES, 1)
    assert live(applying.live_rows(spark, path, COLS)) == {1: 1.0}
    assert live(cdc.apply_changes(target(spark, [(1, 1.0)]), log(spark, []), KEYS, IMAGES)) == {1: 1.0}


def test_places_are_numbers_not_text(spark):
    rows = [(9, 1000, "insert", 1, 1, 1.0), (10, 4, "update", 1, 1, 2.0), (9, 200, "delete", 1, 1, 0.0)]
    assert live(cdc.apply_changes(target(spark, []), log(spark, rows), KEYS, IMAGES)) == {1: 2.0}
    later = log(spark, rows).filter(cdc.after_position(9, 300))
    assert sorted((r["file_no"], r["pos"]) for r in later.collect()) == [(9, 1000), (10, 4)]


def test_null_key_parts_match_each_other(spark):
    start = spark.createDataFrame([("app.t", None, 1.0, "k", None), ("app.t", 2, 2.0, "k", None)], TARGET)
    got = cdc.apply_changes(start, log(spark, [(9, 1, "delete", None, None, 0.0)]), KEYS, IMAGES)
    assert live(got) == {2: 2.0}


def test_snapshot_ignores_events_up_to_its_place(spark):
    rows = [(9, 1, "update", 1, 1, 5.0), (9, 2, "update", 2, 2, 6.0), (9, 3, "delete", 3, 3, 0.0)]
    got = cdc.snapshot_then_changes(target(spark, [(1, 1.0), (2, 2.0), (3, 3.0)]), {"app.t": (9, 1)}, log(spark, rows), KEYS, IMAGES)
    assert live(got) == {1: 1.0, 2: 6.0}
    path = scratch_path(spark, "snap")
    applying.write_snapshot(target(spark, [(1, 1.0), (2, 2.0), (3, 3.0)]), path, at=(9, 1))
    applying.merge_batch(log(spark, rows), path, IMAGES, 0)
    assert live(applying.live_rows(spark, path, COLS)) == {1: 1.0, 2: 6.0}


def test_resume_reports_a_gap(spark):
    saved = spark.createDataFrame([("a", 9, 5), ("b", 4, 7)], "tag string, file_no bigint, pos bigint")
    files = spark.createDataFrame([(8,), (9,)], "file_no bigint")
    end = spark.createDataFrame([(9, 90)], "end_file bigint, end_pos bigint")
    got = {r["tag"]: (r["file_no"], r["pos"], r["gap"]) for r in cdc.resume_position(saved, files, end).collect()}
    assert got == {"a": (9, 5, False), "b": (9, 90, True)}


def test_duplicate_places_count_once(spark):
    twice = log(spark, [(9, 1, "insert", 1, 1, 1.0)])
    assert cdc.dedupe_events(twice.unionByName(twice)).count() == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_cross_chunks(spark, seed):
    rows = random_log(seed)
    want, last = [], None
    for _, _, op, *_ in rows:
        want = want[:-1] + [(op, want[-1][1] + 1)] if op == last else want + [(op, 1)]
        last = op
    labelled = ordered.label_runs(log(spark, rows)).groupBy("run_no", "op").count().orderBy("run_no").collect()
    assert [(r["op"], r["count"]) for r in labelled] == want
    assert [r["run_no"] for r in labelled] == list(range(1, len(want) + 1))


def test_update_run_becomes_delete_then_insert(spark):
    rows = [(9, 1, "update", 1, 1, 1.0), (9, 2, "update", 2, 2, 1.0), (10, 1, "update", 3, 3, 1.0), (10, 2, "delete", 3, 3, 1.0)]
    got = ordered.runs(log(spark, rows)).orderBy("run_no", "part").collect()
    assert [(r["statement"], r["n"], r["first_id"], r["last_id"]) for r in got] == [("delete", 3, 0, 2), ("insert", 3, 0, 2), ("delete", 1, 3, 3)]


def test_statements_escape_and_type_their_values(spark):
    df = spark.createDataFrame(
        [("app.t", "update", 1, "it's \\ here", None), ("app.t", "delete", 2, "x", 1.5)], "tbl string, op string, pk bigint, name string, val double"
    )
    got = [r["statement"] for r in cdc.to_statement(df, {"pk": "bigint", "name": "varchar", "val": "double"}, ["pk"]).collect()]
    assert got[0] == "alter table app.t delete  where pk = 1^^^insert into app.t (`pk`,`name`,`val`) values (1,'it\\'s \\\\ here',null)"
    assert got[1] == "alter table app.t delete  where pk = 2"
    both = cdc.to_statement(df.filter("pk = 2"), {"pk": "bigint", "name": "varchar", "val": "double"}, ["pk", "name"]).first()["statement"]
    assert both == "alter table app.t delete  where (pk,name) = (select toInt64(2),'x')"


def test_stream_restarted_on_its_checkpoint_equals_one_run(spark):
    rows = random_log(11)
    files, path = scratch_path(spark, "log"), scratch_path(spark, "target")
    for part in (rows[:150], rows[150:]):
        streams.write_change_files(log(spark, part), files, files=3)
        stream = streams.read_changes(spark, files, 1)
        applying.start_apply(stream, path, f"{path}-ck", IMAGES).awaitTermination()
    assert live(applying.live_rows(spark, path, COLS)) == fold({}, rows)


def test_lag_of_a_finished_stream(spark):
    files, path = scratch_path(spark, "log"), scratch_path(spark, "out")
    streams.write_change_files(log(spark, random_log(3)), files, files=2)
    query = streams.buffer_changes(streams.read_changes(spark, files), path, f"{path}-ck")
    query.awaitTermination()
    assert streams.stream_lag(query)["files_behind"] == 0
    assert spark.read.parquet(path).count() == 300


def test_tombstones_can_be_dropped_up_to_a_place(spark):
    path = scratch_path(spark, "tomb")
    applying.merge_batch(log(spark, [(9, 1, "delete", 1, 1, 0.0), (9, 5, "delete", 2, 2, 0.0), (9, 2, "insert", 3, 3, 3.0)]), path, IMAGES, 0)
    applying.fold(spark, path, f"{path}-new", forget=(9, 1))
    assert sorted(r["pk"] for r in applying.read_target(spark, f"{path}-new").collect()) == [2, 3]


def image_log(spark, rows):
    """rows of (place, table, op, before, after, statement); the place is a number, ten to a log file"""
    return spark.createDataFrame([(9 + n // 10, n % 10, n, t, op, before, after, text) for n, t, op, before, after, text in rows], images.IMAGE_SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_schema_changes_are_barriers(spark):
    rows = [
        (1, "app.t", "insert", None, {"pk": "1", "val": "1.5", "kind": "a"}, None),
        (2, "app.t", "query", None, None, "alter table app.t add column size int, drop column kind"),
        (3, "app.t", "insert", None, {"pk": "2", "val": "2.5", "size": "7"}, None),
        (4, "app.t", "query", None, None, "truncate table app.t"),
        (5, "app.t", "update", {"pk": "3"}, {"pk": "3", "val": "x", "size": "9"}, None),
        (11, "app.t", "query", None, None, "create table app.t (id int)"),
    ]
    start = {"app.t": spark.createDataFrame([(9, 9.0, "k")], "pk bigint, val double, kind string")}
    upto = lambda n, load=None: rows_of(images.route_tables(start, image_log(spark, rows[:n][::-1]), {"app.t": ["pk"]}, load)["app.t"])
    assert upto(3) == [(1, 1.5, None), (2, 2.5, 7), (9, 9.0, None)]
    assert upto(5) == upto(6) == [(3, None, 9)]
    assert upto(6, lambda t: spark.createDataFrame([(4, 4.0)], "pk bigint, val double")) == [(4, 4.0)]


def test_columns_keep_their_values_through_renames_and_lose_them_when_dropped(spark):
    rows = [
        (1, "a.t", "insert", None, {"id": "1", "x": "7.9", "y": "p"}, None),
        (2, "a.t", "query", None, None, "alter table t change id code varchar(9), modify code varchar(9), modify x int, add z int first"),
        (3, "a.t", "update", {"code": "5", "x": "1"}, {"code": "six", "x": "2", "y": "q", "z": "4"}, None),
        (4, "a.t", "query", None, None, "alter table a.t drop column y, change x w varchar(5), modify w varchar(5)"),
        (5, "a.t", "query", None, None, "alter table a.t add column y int"),
        (6, "a.t", "delete", {"code": "1"}, None, None),
        (7, "a.t", "insert", None, {"code": "8", "w": "v", "y": "3"}, None),
    ]
    start = {"a.t": spark.createDataFrame([(5, 5.5, "b"), (6, 6.6, "c")], "id int, x double, y string")}
    got = images.route_tables(start, image_log(spark, rows[::-1]), {"a.t": ["code"]})["a.t"]
    assert got.columns == ["z", "code", "w", "y"]
    assert rows_of(got) == sorted([(None, "6", "6", None), (4, "six", "2", None), (None, "8", "v", 3)], key=repr)


def test_keys_of_several_parts_move(spark):
    start = {"a.t": spark.createDataFrame([("x", 1, "old"), (None, 2, "old"), ("y", 3, "old")], "c string, n int, v string")}
    rows = [
        (1, "a.t", "update", {"c": "x", "n": "1"}, {"c": "x", "n": "9", "v": "moved"}, None),
        (2, "a.t", "update", {"c": None, "n": "2"}, {"c": None, "n": "2", "v": "new"}, None),
        (3, "a.t", "delete", {"c": "y", "n": "3"}, None, None),
        (4, "b.u", "insert", None, {"c": "other"}, None),
    ]
    keys = {"a.t": ["c", "n"]}
    assert rows_of(images.route_tables(start, image_log(spark, rows), keys)["a.t"]) == sorted([("x", 9, "moved"), (None, 2, "new")], key=repr)
    assert rows_of(images.route_tables(start, image_log(spark, rows), keys, compat=True)["a.t"]) == sorted([("x", 1, "old"), ("x", 9, "moved"), (None, 2, "new")], key=repr)
    assert rows_of(images.route_tables(start, image_log(spark, []), keys)["a.t"]) == rows_of(start["a.t"])


def test_batches_of_a_log_with_schema_changes_equal_the_whole(spark):
    rng, rows, tables = random.Random(6), [], {"a.t": "k", "b.u": "k"}
    for n in range(1, 120):
        t = rng.choice(list(tables))
        if n in (20, 60):
            rows.append((n, t, "query", None, None, f"alter table {t} add column c{n} int"))
            continue
        image = {"k": str(rng.randrange(9)), "v": str(n), "c20": str(n), "c60": str(n)}
        rows.append((n, t, rng.choice(["insert", "update", "delete"]), {**image, "k": str(rng.randrange(9))}, image, None))
    start = {t: spark.createDataFrame([(k, -1) for k in range(5)], "k int, v int") for t in tables}
    keys = {t: [k] for t, k in tables.items()}
    files, path = scratch_path(spark, "log"), scratch_path(spark, "routed")
    for part in (rows[:50], rows[50:90], rows[90:]):
        streams.write_change_files(image_log(spark, part), files, files=2)
        applying.start_routing(streams.read_changes(spark, files, 1, images.IMAGE_SCHEMA), path, f"{path}-ck", start, keys).awaitTermination()
    whole = images.route_tables(start, image_log(spark, rows), keys)
    got = applying.routed_tables(spark, path, start, keys)
    assert {t: rows_of(df) for t, df in got.items()} == {t: rows_of(df) for t, df in whole.items()}


def test_plans_do_not_grow_with_the_number_of_statements(spark):
    def plan(n):
        rows = [(1, "a.t", "insert", None, {"k": "1", "v": "1"}, None)] + [(2 + i, "a.t", "query", None, None, f"alter table a.t add column c{i} int") for i in range(n)]
        start = {"a.t": spark.createDataFrame([(1, 1)], "k int, v int")}
        changes = image_log(spark, rows)
        _, info = images.tables_of(start, images.statements_of(changes), {"a.t": ["k"]})
        return images.net_images(changes, info)._jdf.queryExecution().executedPlan().toString()

    small, large = plan(2), plan(20)
    for word in ("Exchange", "Scan", "Join", "Window"):
        assert small.count(word) == large.count(word)


def test_idempotent_insert_keeps_what_is_there(spark):
    got = cdc.idempotent_insert(target(spark, [(1, 1.0)]), target(spark, [(1, 9.0), (2, 2.0), (2, 2.0)]), KEYS)
    assert live(got) == {1: 1.0, 2: 2.0} and got.count() == 2


def test_merged_ids_are_counted_per_operation(spark):
    rows = [(9, 1, "update", 1, 1, 1.0), (9, 2, "update", 1, 1, 2.0), (10, 1, "delete", 1, 1, 0.0)]
    got = {r["op"]: (r["seq"], r["merged"], r["first_id"]) for r in ordered.last_change_per_key(log(spark, rows), ["tbl", "op", "pk"]).collect()}
    assert got == {"update": (1, 2, 0), "delete": (2, 1, 2)}


def _image_log(spark, rows):
    """rows of (file, pos, op, before, after, statement) of table a.t"""
    full = [(f, p, i, "a.t", op, before, after, said) for i, (f, p, op, before, after, said) in enumerate(rows)]
    return spark.createDataFrame(full, images.IMAGE_SCHEMA)


def test_events_are_dealt_out_before_they_are_sorted_and_carry_no_schemas(spark):
    start = {"a.t": spark.createDataFrame([], "k bigint, v string")}
    log = _image_log(spark, [(1, i, "insert", None, {"k": str(i % 3), "v": str(i)}, None) for i in range(9)])
    _, info = images.tables_of(start, images.statements_of(log), {"a.t": ["k"]})
    plan = images.net_images(log, info)._jdf.queryExecution().executedPlan().toString()
    first_sort = plan[plan.rindex("Sort [tbl"):]
    assert "REBALANCE_PARTITIONS_BY_COL" in first_sort
    assert not any(name in first_sort.split("\n")[0] for name in ("names", "chains", "keys"))
    got = images.net_images(log, info).collect()
    assert sorted((r["key"][0], r["values"][1], list(r["chains"])) for r in got) == [("0", "6", [0, 0]), ("1", "7", [0, 0]), ("2", "8", [0, 0])]


def test_a_key_is_renamed_in_a_later_batch(spark):
    """Events that come before the statement that gives their table its last key are all kept until it is there."""
    files, path = scratch_path(spark, "log"), scratch_path(spark, "routed")
    before = {"a.t": spark.createDataFrame([(1, "old"), (2, "old")], "k bigint, v string")}
    log = _image_log(spark, [
        (1, 1, "insert", None, {"k": "3", "v": "a"}, None), (1, 2, "update", {"k": "3", "v": "a"}, {"k": "4", "v": "b"}, None), (1, 3, "delete", {"k": "1", "v": "old"}, None, None),
        (2, 1, "query", None, None, "alter table t change k id bigint"), (2, 2, "update", {"id": "4", "v": "b"}, {"id": "4", "v": "c"}, None),
    ])
    for number in (1, 2):
        streams.write_change_files(log.filter(f"file_no = {number}"), files)
        applying.start_routing(streams.read_changes(spark, files, schema=images.IMAGE_SCHEMA), path, f"{path}-ck", before, {"a.t": ["id"]}).awaitTermination()
    got = applying.routed_tables(spark, path, before, {"a.t": ["id"]})["a.t"]
    assert sorted((r["id"], r["v"]) for r in got.collect()) == [(2, "old"), (4, "c")]


def test_a_large_log_gets_more_change_files(spark, monkeypatch):
    monkeypatch.setattr(streams, "FILE_ROWS", 50)
    path = scratch_path(spark, "log")
    streams.write_change_files(log(spark, random_log(1)), path, files=2)
    written = spark.read.schema(CHANGE_SCHEMA).json(path)
    assert written.select("_metadata.file_path").distinct().count() == 6 and written.count() == 300
