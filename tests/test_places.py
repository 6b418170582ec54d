"""The change log as a stream with places: starts, flushes, restarts, gaps."""

import json
import random

import pytest
from pyspark.errors import StreamingQueryException

from rowtide.operators.changes import CHANGE_SCHEMA
from rowtide.session import scratch_path
from rowtide.streaming import places


def events(spark, rows):
    """rows of (file, pos, number of events of that place)"""
    full, seq = [], 0
    for file_no, pos, n in rows:
        for _ in range(n):
            full.append((seq, file_no, pos, "app.t", "insert", 1, seq, float(seq), "k", None))
            seq += 1
    return spark.createDataFrame(full, CHANGE_SCHEMA)


def reader(path, **options):
    from pyspark.sql import types as T

    return places.PlaceReader({"path": path, "start": "[-1, -1]", **options}, T.StructType.fromDDL(CHANGE_SCHEMA))


def run(spark, log, out, **options):
    query = places.flush_places(places.read_places(spark, log, checkpoint=f"{out}-ck", **options), out, f"{out}-ck")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return places.last_place(spark, f"{out}-ck", flushed=True)


def batches(spark, out):
    got = {}
    for r in spark.read.parquet(out).collect():
        got.setdefault(r["batch"], []).append(r["seq"])
    return [sorted(got[k]) for k in sorted(got)]


def test_flushes_hold_as_many_rows_as_asked_and_keep_a_place_together(spark):
    log, out = scratch_path(spark, "log"), scratch_path(spark, "out")
    places.write_log(events(spark, [(f, p, 3 if p == 8 else 1) for f in (9, 10) for p in range(4, 14)]), log)
    assert run(spark, log, out, max_rows=6) == (10, 13)
    got = batches(spark, out)
    assert [len(b) for b in got] == [7, 6, 6, 5] and sum(got, []) == list(range(24))


def test_a_restart_goes_on_behind_the_last_place(spark):
    log, out = scratch_path(spark, "log"), scratch_path(spark, "out")
    rows = events(spark, [(f, p, 1) for f in (9, 10, 11) for p in range(4, 24)])
    places.write_log(rows.filter("file_no = 9 or (file_no = 10 and pos < 10)"), log)
    assert places.last_place(spark, f"{out}-ck") is None
    assert run(spark, log, out, max_rows=15) == (10, 9)
    assert places.last_place(spark, f"{out}-ck") == (10, 9)
    places.write_log(rows.filter("file_no > 10 or (file_no = 10 and pos >= 10)"), log)
    assert run(spark, log, out, max_rows=15) == (11, 23)
    got = batches(spark, out)
    assert sum(got, []) == list(range(60)) and max(map(len, got)) == 15
    run(spark, log, out, max_rows=15)
    assert batches(spark, out) == got


def test_a_missing_log_file_is_reported(spark):
    log, out = scratch_path(spark, "log"), scratch_path(spark, "out")
    places.write_log(events(spark, [(9, 4, 1), (10, 4, 1)]), log)
    with pytest.raises(StreamingQueryException, match="gap: log file 8"):
        run(spark, log, out, start=(8, 100))
    assert [r[0] for r in places.log_files(spark, log).collect()] == [9, 10]


def test_a_flush_waits_for_rows_or_seconds(spark, monkeypatch):
    log = scratch_path(spark, "log")
    places.write_log(events(spark, [(9, p, 1) for p in range(10)]), log)
    now = [100.0]
    monkeypatch.setattr(places.time, "monotonic", lambda: now[0])
    source = reader(log, max_rows="4", gap_seconds="30")
    ends = [source.latestOffset()["pos"] for _ in range(4)]
    assert ends == [3, 7, 7, 7]  # two rows are left: not enough, and not long enough
    now[0] += 31
    assert source.latestOffset() == {"file_no": 9, "pos": 9}
    now[0] += 31
    assert source.latestOffset() == {"file_no": 9, "pos": 9}


def test_places_inside_row_groups_and_overlapping_files(spark):
    log = scratch_path(spark, "log")
    places.write_log(events(spark, [(9, p, 1) for p in range(0, 100, 2)]).coalesce(1), log)
    places.write_log(events(spark, [(9, p, 1) for p in range(1, 100, 2)]).coalesce(1), log)
    source, seen = reader(log, max_rows="7"), []
    start = source.initialOffset()
    while (end := source.latestOffset()) != start:
        parts = source.partitions(start, end)
        rows = [r for p in parts for b in source.read(p) for r in b.to_pylist()]
        assert len(rows) == min(7, 100 - len(seen)) and all(r["file_no"] == 9 for r in rows)
        seen += sorted(r["pos"] for r in rows)
        start = end
    assert seen == list(range(100))
    assert json.loads(json.dumps(end)) == {"file_no": 9, "pos": 99}


def test_an_empty_log_gives_nothing(spark):
    source = reader(scratch_path(spark, "none"))
    assert source.latestOffset() == source.initialOffset() and source.partitions(source.initialOffset(), source.latestOffset()) == []


def test_small_log_files_share_parquet_files_and_tasks(spark):
    log = scratch_path(spark, "log")
    places.write_log(events(spark, [(f, 4, 1) for f in range(9, 209)]), log)
    source = reader(log)
    end = source.latestOffset()
    parts = source.partitions(source.initialOffset(), end)
    assert end == {"file_no": 208, "pos": 4} and len(parts) <= 8
    assert sorted(r["file_no"] for p in parts for b in source.read(p) for r in b.to_pylist()) == list(range(9, 209))
    assert [r[0] for r in places.log_files(spark, log).collect()] == list(range(9, 209))
    source = reader(log, start="[100, 4]")
    parts = source.partitions(source.initialOffset(), source.latestOffset())
    assert sorted(r["file_no"] for p in parts for b in source.read(p) for r in b.to_pylist()) == list(range(101, 209))


@pytest.mark.parametrize("max_rows", [1, 7, 64])
def test_flushes_cut_row_groups_of_many_log_files(spark, max_rows):
    """Several Parquet files whose places interleave, events of one place, without pos and without log file."""
    rng, log, rows = random.Random(max_rows), scratch_path(spark, "log"), []
    for n in range(3):
        own = [(len(rows) + i, rng.randrange(5, 12), rng.choice([None, *range(0, 40)])) for i in range(60)]
        rows += own
        full = [(i, f, p, "app.t", "insert", 1, i, 0.0, "k", None) for i, f, p in [*own, (1000 + n, None, 99), (2000 + n, None, None)]]
        places.write_log(spark.createDataFrame(full, CHANGE_SCHEMA).coalesce(1), log)
    source, got = reader(log, max_rows=str(max_rows)), []
    start = source.initialOffset()
    while (end := source.latestOffset()) != start:
        read = [r["seq"] for p in source.partitions(start, end) for b in source.read(p) for r in b.to_pylist()]
        got.append(sorted(read))
        start = end
    want, left = [], sorted((f, -1 if p is None else p, i) for i, f, p in rows)
    while left:
        last = left[min(max_rows, len(left)) - 1][:2]
        want.append(sorted(r[2] for r in left if r[:2] <= last))
        left = [r for r in left if r[:2] > last]
    assert got == want


def test_a_log_in_folders_of_single_files_is_read(spark):
    log = scratch_path(spark, "log")
    events(spark, [(f, p, 1) for f in (9, 10) for p in (4, 8)]).write.partitionBy("file_no").parquet(log)
    source = reader(log, start="[9, 4]")
    parts = source.partitions(source.initialOffset(), source.latestOffset())
    assert sorted((r["file_no"], r["pos"]) for p in parts for b in source.read(p) for r in b.to_pylist()) == [(9, 8), (10, 4), (10, 8)]
    assert [r[0] for r in places.log_files(spark, log).collect()] == [9, 10]


def test_a_missing_log_file_inside_a_row_group_is_reported(spark):
    log = scratch_path(spark, "log")
    places.write_log(events(spark, [(8, 4, 1), (10, 4, 1)]).coalesce(1), log)
    with pytest.raises(RuntimeError, match="gap: log file 9 .* begins at file 10"):
        reader(log, start="[9, 4]").latestOffset()
