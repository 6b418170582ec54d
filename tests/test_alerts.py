"""The alert state: golden sequences, and batch = stream = fold."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from rowtide.operators import alert_runs, alerts, ordered
from rowtide.operators.alert_runs import AlertState
from rowtide.session import scratch_path
from rowtide.sources.sinks import remove_path
from rowtide.specs import SERVER_RULE, AlertRule, api_rule
from rowtide.streaming import alerts as streaming
from rowtide.streaming.changes import buffer_changes

START = dt.datetime(2024, 1, 1)
SCHEMA = "server_id bigint, sample_id bigint, ts timestamp_ntz, ok boolean"
STATE = ["fail_times", "succ_times", "first_failure_time", "is_send_alt_mail", "is_send_alt_mail_times", "is_send_rcv_mail", "emit"]


def rows_of(results, server=1, minutes=1):
    return [(server, i, START + dt.timedelta(minutes=i * minutes), ok) for i, ok in enumerate(results)]


def advance(state, ok, ts, rule):
    """One step of the state machine, as plain as it gets."""
    fails, succs, first, sent, times, known, recovered = state
    if ok:
        if not known:
            return state, None
        succs += 1
        recover = sent and succs == rule.recover_at
        return (0, succs, None, sent and not recover, 0, True, recover), ("recovery" if recover else None)
    fails += 1
    alert = (not sent and fails > rule.first) or (sent and fails % rule.every == 0 and times <= rule.cap)
    return (fails, 0, first or ts, sent or alert, times + int(alert), True, recovered), ("alert" if alert else None)


def fold(rows, rule):
    out, states = {}, {}
    for server, ident, ts, ok in sorted(rows, key=lambda r: (r[2], r[1])):
        state, emit = advance(states.get(server, (0, 0, None, False, 0, False, False)), ok, ts, rule)
        states[server] = state
        if state[5]:
            out[server, ident] = (state[0], state[1], state[2], "Y" if state[3] else "N", state[4], "Y" if state[6] else "N", emit)
    return out


def batch(spark, rows, rule, chunk=None):
    df = alerts.alert_state(spark.createDataFrame(rows, SCHEMA), ["server_id"], F.col("ok"), ["ts", "sample_id"], "ts", rule, chunk)
    return {(r["server_id"], r["sample_id"]): tuple(r[c] for c in STATE) for r in df.collect()}


def emits(spark, results, rule=SERVER_RULE):
    got = batch(spark, rows_of(results), rule)
    return [(i, e[-1]) for (_, i), e in sorted(got.items()) if e[-1]]


def test_fourth_failure_alerts_and_success_recovers(spark):
    assert emits(spark, [False] * 3 + [True]) == []
    assert emits(spark, [False] * 4 + [True, True]) == [(3, "alert"), (4, "recovery")]


def test_repeats_every_sixtieth_failure_up_to_the_cap(spark):
    got = emits(spark, [False] * 450 + [True] + [False] * 4)
    assert [i for i, e in got if e == "alert"] == [3, 59, 119, 179, 239, 299, 454]
    assert (450, "recovery") in got


def test_success_without_a_state_row_is_not_recorded(spark):
    got = batch(spark, rows_of([True, True, False, True]), SERVER_RULE)
    assert sorted(i for _, i in got) == [2, 3]


@pytest.mark.parametrize("rule", [SERVER_RULE, AlertRule(first=1, every=2, cap=2), AlertRule(first=2, every=3, cap=1)])
def test_batch_equals_the_fold_over_chunks(spark, rule):
    rng = random.Random(5)
    rows = []
    for server in range(4):
        p = 0.5 + server * 0.15
        rows += [(server, i, START + dt.timedelta(minutes=i * 13), rng.random() > p) for i in range(300)]
    # server 4 fails through many chunks, server 5 has long silent stretches
    rows += rows_of([False] * 400 + [True] * 3 + [False] * 200, 4, 7)
    rows += rows_of([True, False, False, False, False, False, True], 5, 500)
    assert batch(spark, rows, rule) == fold(rows, rule)


@pytest.mark.parametrize("rule", [SERVER_RULE, api_rule(200)])
def test_stream_equals_the_fold(spark, rule):
    rng = random.Random(9)
    rows = [(s, i, START + dt.timedelta(minutes=i), rng.random() > 0.6) for s in range(3) for i in range(150)]
    src, out = scratch_path(spark, "samples"), scratch_path(spark, "state")
    streaming.use_rocksdb(spark)
    for part in (0, 1, 2):
        spark.createDataFrame([r for r in rows if r[1] // 50 == part], SCHEMA).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(SCHEMA).parquet(src)
        buffer_changes(streaming.alert_stream(stream, ["server_id"], "ts", "sample_id", rule), out, f"{out}-ck").awaitTermination()
    got = {(r["server_id"], r["sample_id"]): tuple(r[c] for c in STATE) for r in spark.read.parquet(out).collect()}
    assert got == fold(rows, rule)


def test_api_rule_needs_two_successes(spark):
    rows = rows_of([False, False, True, False, True, True])
    got = fold(rows, api_rule(200))
    assert [(i, e[-1]) for (_, i), e in sorted(got.items()) if e[-1]] == [(1, "alert"), (5, "recovery")]


def test_counter_reset_gives_null(spark):
    rows = [(1, START + dt.timedelta(minutes=40 * i), i, v) for i, v in enumerate([100, 2500, 50, 2450])]
    df = spark.createDataFrame(rows, "server_id int, ts timestamp_ntz, sample_id int, bytes bigint")
    got = ordered.counter_delta(df, ["server_id"], "bytes", ["sample_id"], "ts").orderBy("sample_id").collect()
    assert [(r["delta"], r["per_second"]) for r in got] == [(None, None), (2400, 1.0), (None, None), (2400, 1.0)]


def test_service_faults(spark):
    texts = [(1, "0@7@2024-01-01 00:00:00,1@8@2024-01-01 00:00:00,1@9@2024-01-01 00:09:00,0@8@2024-01-01 00:00:00")]
    envs = spark.createDataFrame([("7", "1"), ("8", "2"), ("9", "1")], "db_id string, db_env string")
    got = alerts.service_status(spark.createDataFrame(texts, "server_id int, service_service string"), envs, START + dt.timedelta(minutes=10))
    assert sorted((r["db_id"], r["fault"]) for r in got.collect()) == [("7", "service"), ("8", "network")]


def test_probe_attempts_end_with_the_first_settled_answer(spark):
    rows = [("a", 1, "200", 9.0), ("a", 2, "200", 1.0), ("a", 3, "500", 1.0), ("b", 1, None, 0.0), ("c", 1, "x", 3.0), ("d", 1, "200", 9.0), ("d", 2, "200", 9.0), ("d", 3, "200", 9.0), ("d", 4, "200", 1.0)]
    probes = spark.createDataFrame(rows, "probe string, attempt int, code string, ms double")
    first = [("a", 1, 408), ("a", 2, 200), ("b", 1, 202), ("c", 1, 201), ("d", 1, 408), ("d", 2, 408), ("d", 3, 408)]
    for most, more in ((3, []), (None, [("d", 4, 200)])):
        got = alerts.probe_status(probes, 5, ["probe"], most=most)
        assert sorted((r["probe"], r["attempt"], r["api_status"]) for r in got.collect()) == first + more


def test_missing_threshold_counts_as_zero_and_null_is_no_breach(spark):
    values = spark.createDataFrame([("mem", 1.0), ("cpu", 50.0), ("cpu", None), ("disk", 0.0)], "index_code string, index_value double")
    limits = spark.createDataFrame([("cpu", 0.8)], "index_code string, index_threshold double")
    got = alerts.with_breach(values, limits).collect()
    assert sorted((r["index_code"], r["index_value"] or 0, r["breach"]) for r in got) == [("cpu", 0, False), ("cpu", 50.0, False), ("disk", 0.0, False), ("mem", 1.0, True)]


@pytest.mark.parametrize("seed", range(6))
def test_array_steps_equal_single_steps(seed):
    rng = random.Random(seed)
    rule = AlertRule(first=rng.randrange(4), every=rng.randrange(1, 7), cap=rng.randrange(4), recover_at=rng.randrange(1, 4))
    p = rng.choice([0.1, 0.4, 0.7, 0.9])
    results = [False] + [rng.random() > p for _ in range(400)]
    times = [START + dt.timedelta(minutes=i) for i in range(len(results))]
    single, want = (0, 0, None, False, 0, False, False), []
    for ok, ts in zip(results, times):
        single, emit = advance(single, ok, ts, rule)
        want.append((*single, emit))
    state, at, got = streaming.AlertState(), 0, []
    while at < len(results):
        n = rng.randrange(1, 60)
        state, out = streaming.advance(state, np.array(results[at:at + n]), np.array(times[at:at + n], dtype="datetime64[us]"), rule)
        for r in out.itertuples():
            first = None if r.first_failure_time is pd.NaT else r.first_failure_time.to_pydatetime()
            got.append((r.fail_times, r.succ_times, first, r.is_send_alt_mail == "Y", r.is_send_alt_mail_times, True, r.is_send_rcv_mail == "Y", r.emit))
        assert tuple(state) == got[-1][:-1]
        at += n
    assert got == want


@pytest.mark.parametrize("rule", [AlertRule(first=1, every=2, cap=2), api_rule(200)])
def test_batches_with_late_samples_equal_the_fold(spark, rule):
    rng = random.Random(4)
    rows = [(s, i, START + dt.timedelta(minutes=i * 7), rng.random() > (0.3 + 0.2 * s)) for s in range(4) for i in range(200)]
    rows += rows_of([False] * 120 + [True] + [False] * 79, 4, 7) + rows_of([True] * 60 + [False] * 6 + [True, True] + [False] * 132, 5, 7)
    # server 6 is silent in the middle
    rows += [r for r in rows_of([False] * 200, 6, 7) if not 50 <= r[1] < 150]
    src, out = scratch_path(spark, "samples"), scratch_path(spark, "alerting")
    late = rng.sample(range(200), 30)
    for part in range(4):  # the last file holds samples of all days
        own = [r for r in rows if (r[1] in late) == (part == 3) and (part == 3 or r[1] // 67 == part)]
        spark.createDataFrame(own, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(SCHEMA).parquet(src)
        streaming.start_alerts(stream, ["server_id"], "ts", "sample_id", rule, out, f"{out}-ck").awaitTermination()
        seen = [r for r in rows if (r[1] in late and part == 3) or (r[1] not in late and r[1] // 67 <= part)]
        got = {(r["server_id"], r["sample_id"]): tuple(r[c] for c in STATE) for r in streaming.read_alerts(spark, out, ["server_id"], "sample_id").collect()}
        assert got == fold(seen, rule)


def test_a_late_success_ends_the_streak_it_falls_into(spark):
    src, out = scratch_path(spark, "samples"), scratch_path(spark, "alerting")
    rule = AlertRule(first=1, every=10, cap=1)
    hour = lambda h: START + dt.timedelta(hours=h)
    files = [[(1, 10, hour(10), False), (1, 12, hour(12), False), (2, 1, hour(1), False)], [(1, 30, hour(30), True)], [(1, 11, hour(11), True), (None, 5, hour(1), False), (1, 6, None, True), (1, 7, hour(1), None)]]
    emitted = []
    for part in files:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        streaming.start_alerts(spark.readStream.schema(SCHEMA).parquet(src), ["server_id"], "ts", "sample_id", rule, out, f"{out}-ck").awaitTermination()
        rows = streaming.read_alerts(spark, out, ["server_id"], "sample_id").collect()
        emitted.append(sorted((r["sample_id"], r["emit"]) for r in rows if r["emit"]))
    assert emitted == [[(12, "alert")], [(12, "alert"), (30, "recovery")], []]
    assert sorted(r["sample_id"] for r in spark.read.parquet(f"{out}/rejected").collect()) == [5, 6, 7]


def test_a_lost_state_stops_the_stream(spark):
    src, out = scratch_path(spark, "samples"), scratch_path(spark, "alerting")
    for part in range(2):
        spark.createDataFrame(rows_of([False] * 3)[part : part + 1], SCHEMA).write.mode("append").parquet(src)
        query = streaming.start_alerts(spark.readStream.schema(SCHEMA).parquet(src), ["server_id"], "ts", "sample_id", SERVER_RULE, out, f"{out}-ck")
        if part:
            with pytest.raises(StreamingQueryException, match="are missing"):
                query.awaitTermination()
        else:
            query.awaitTermination()
            remove_path(spark, f"{out}/carry")


@pytest.mark.parametrize("seed", range(5))
def test_summaries_of_pieces_tell_the_state(seed):
    rng = random.Random(seed)
    rule = AlertRule(first=rng.randrange(4), every=rng.randrange(1, 7), cap=rng.randrange(4), recover_at=rng.randrange(1, 4))
    results = [rng.random() > rng.choice([0.2, 0.5, 0.8]) for _ in range(500)]
    times = [START + dt.timedelta(minutes=i) for i in range(len(results))]
    micros = np.array(times, dtype="datetime64[us]").astype(np.int64)
    single, states = (0, 0, None, False, 0, False, False), []
    for ok, ts in zip(results, times):
        single, _ = advance(single, ok, ts, rule)
        states.append(single)
    cuts = sorted({0, len(results), *rng.sample(range(len(results)), 60)})
    parts = [alert_runs.runs_of(np.array(results[a:b]), micros[a:b], rule) for a, b in zip(cuts, cuts[1:])]
    assert max(map(len, parts)) <= 4
    state, joined = AlertState(), ()
    for b, part in zip(cuts[1:], parts):
        state, joined = alert_runs.after_runs(state, part, rule), alert_runs.merge(joined, part, rule)
        assert tuple(state) == states[b - 1]
        assert len(joined) <= 4 and tuple(alert_runs.after_runs(AlertState(), joined, rule)) == states[b - 1]
    i = rng.randrange(1, len(parts))  # merging may be done in any grouping
    left = alert_runs.merge((), (), rule)
    for part in parts[:i]:
        left = alert_runs.merge(left, part, rule)
    right = ()
    for part in reversed(parts[i:]):
        right = alert_runs.merge(part, right, rule)
    assert tuple(alert_runs.after_runs(AlertState(), alert_runs.merge(left, right, rule), rule)) == states[-1]


def test_one_time_for_a_third_of_the_samples_is_many_tasks(spark):
    rng = random.Random(3)
    rows = [(1, i, START, rng.random() > 0.6) for i in range(3000)] + [(s, i, START + dt.timedelta(minutes=i), rng.random() > 0.6) for s in range(2, 8) for i in range(1000)]
    samples = spark.createDataFrame(rows, SCHEMA).repartition(5)
    pieces = ordered.even_chunks(samples, ["server_id"], ["ts", "sample_id"], partitions=24)
    sizes = {r["_chunk"]: r["count"] for r in pieces.groupBy("_chunk").count().collect()}
    assert len(sizes) > 15 and max(sizes.values()) < 3 * 9000 / 24
    got = ordered.streaks(pieces, ["server_id"], F.col("ok"), ["ts", "sample_id"], "ts", chunk=F.col("_chunk")).drop("_chunk")
    want = ordered.streaks(samples, ["server_id"], F.col("ok"), ["ts", "sample_id"], "ts")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    rule = api_rule(200)
    followed = {(r["server_id"], r["sample_id"]): tuple(r[c] for c in STATE) for r in alert_runs.follow(samples, ["server_id"], "ts", "sample_id", rule).collect()}
    assert followed == fold(rows, rule)
