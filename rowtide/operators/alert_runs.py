"""The alert state on mergeable summaries of runs (M3-M5, M9).

What a stretch of samples does to the state of a check follows from a few of its runs of equal results, so a key's samples
are cut anywhere, each piece is summed up by itself, the few summaries are folded in order, and every piece is then
followed from the state it starts with. No key is one worker's, and rules that recover after several successes work alike.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from rowtide import specs
from rowtide.operators.ordered import even_chunks
from rowtide.specs import AlertRule

# what runs in the workers travels as code, so they need not have this package installed
for _module in (sys.modules[__name__], specs):
    cloudpickle.register_pickle_by_value(_module)

STATE = "fail_times bigint, succ_times bigint, first_failure_time timestamp_ntz, sent boolean, sent_times bigint, known boolean, recovered boolean"
FOLLOWED = "ok boolean, fail_times bigint, succ_times bigint, first_failure_time timestamp_ntz, is_send_alt_mail string, is_send_alt_mail_times bigint, is_send_rcv_mail string, emit string"


class AlertState(NamedTuple):
    """What is kept of a check between two samples."""

    fail_times: int = 0
    succ_times: int = 0
    first_failure_time: object = None
    sent: bool = False
    sent_times: int = 0
    known: bool = False
    recovered: bool = False


class Run(NamedTuple):
    """``n`` equal results in a row, the first of them at ``began`` (microseconds)."""

    ok: bool
    n: int
    began: int


def _before(flags: np.ndarray) -> np.ndarray:
    """Index of the latest true flag at or before each place, -1 if there is none."""
    return np.maximum.accumulate(np.where(flags, np.arange(len(flags)), -1))


def _sent_at_run_start(state: AlertState, ok: np.ndarray, starts: np.ndarray, lengths: np.ndarray, fails: np.ndarray, rule: AlertRule) -> np.ndarray:
    """Whether an alert was open when each run of equal results began.

    A failing run longer than ``rule.first`` opens one, a good run that reaches ``rule.recover_at`` ends it; what
    counts is which of the two came last.
    """
    last = starts + lengths - 1
    good = ok[starts]
    reach = lengths + np.where(np.arange(len(starts)) == 0, state.succ_times, 0)
    opens = np.concatenate([[state.sent], ~good & (fails[last] > rule.first)])
    ends = np.concatenate([[not state.sent], good & (reach >= rule.recover_at)])
    return (_before(opens) > _before(ends))[:-1]


def advance(state: AlertState, ok: np.ndarray, ts: np.ndarray, rule: AlertRule) -> tuple[AlertState, pd.DataFrame]:
    """The state after a series of samples in time order, and one row per sample. The series is not empty and starts
    with a failure unless the state is known."""
    n = len(ok)
    at = np.arange(n)
    starts = np.concatenate([[0], np.flatnonzero(ok[1:] != ok[:-1]) + 1])
    lengths = np.diff(np.append(starts, n))
    run = np.repeat(np.arange(len(starts)), lengths)
    within = at - starts[run] + 1
    goes_on = run == 0  # the first run may continue the one the state ended in
    fails = np.where(ok, 0, within + np.where(goes_on, state.fail_times, 0))
    succs = np.where(ok, within + np.where(goes_on, state.succ_times, 0), 0)
    sent_before = _sent_at_run_start(state, ok, starts, lengths, fails, rule)[run]

    # failures: the first alert once past the limit, then one at every multiple, up to the cap
    opening = np.maximum(rule.first + 1, np.where(goes_on, state.fail_times, 0) + 1)
    multiple = fails % rule.every == 0
    due = ~ok & np.where(sent_before, multiple, (fails == opening) | ((fails > opening) & multiple))
    count = np.cumsum(due)
    nth = count - (count - due)[starts][run]
    times_before = np.where(goes_on & ~ok, state.sent_times, 0)
    left = np.maximum(rule.cap + 1 - times_before, 0)
    alerts = due & (nth <= left)
    times = np.where(ok, 0, times_before + np.minimum(nth, left))

    # successes: the alert ends at the one the rule names
    recovers = ok & sent_before & (succs == rule.recover_at)
    sent = np.where(ok, sent_before & (succs < rule.recover_at), sent_before | (times > times_before))
    last_ok = _before(ok)
    recovered = np.where(last_ok >= 0, recovers[last_ok], state.recovered)

    began = ts[starts][run]
    if state.first_failure_time is not None:
        began = np.where(goes_on, np.datetime64(state.first_failure_time), began)
    out = pd.DataFrame(
        {
            "ok": ok, "fail_times": fails, "succ_times": succs, "first_failure_time": np.where(ok, np.datetime64("NaT"), began),
            "is_send_alt_mail": np.where(sent, "Y", "N"), "is_send_alt_mail_times": times, "is_send_rcv_mail": np.where(recovered, "Y", "N"),
            "emit": np.where(alerts, "alert", np.where(recovers, "recovery", None)),
        }
    )
    first = None if ok[-1] else pd.Timestamp(began[-1]).to_pydatetime()
    return AlertState(int(fails[-1]), int(succs[-1]), first, bool(sent[-1]), int(times[-1]), True, bool(recovered[-1])), out


def runs_of(ok: np.ndarray, began: np.ndarray, rule: AlertRule) -> tuple[Run, ...]:
    """The summary of a series of samples in order."""
    starts = np.concatenate([[0], np.flatnonzero(ok[1:] != ok[:-1]) + 1]).astype(np.int64)
    lengths = np.diff(np.append(starts, len(ok)))
    if len(starts) > 4:  # of the runs in the middle only the last decisive one counts
        good, middle = ok[starts], slice(1, len(starts) - 2)
        decides = np.flatnonzero(np.where(good[middle], lengths[middle] >= rule.recover_at, lengths[middle] > rule.first))
        keep = [0, *(decides[-1:] + 1), len(starts) - 2, len(starts) - 1]
        starts, lengths = starts[keep], lengths[keep]
    return tuple(Run(bool(ok[s]), int(n), int(began[s])) for s, n in zip(starts, lengths, strict=True))


def merge(a: tuple[Run, ...], b: tuple[Run, ...], rule: AlertRule) -> tuple[Run, ...]:
    """The summary of two series, one after the other, from theirs.

    All runs but the first are whole or at the end. Kept are the first, which may go on one from before; of those in the
    middle the last that opens or ends an alert; and the last two, which hold all counters and times.
    """
    if not a or not b:
        return a or b
    joined = a[-1].ok == b[0].ok
    runs = [*a[:-1], Run(a[-1].ok, a[-1].n + b[0].n, a[-1].began), *b[1:]] if joined else [*a, *b]
    if len(runs) <= 4:
        return tuple(runs)
    decides = [r for r in runs[1:-2] if (r.n >= rule.recover_at if r.ok else r.n > rule.first)]
    return (runs[0], *decides[-1:], *runs[-2:])


def after_runs(state: AlertState, runs: tuple[Run, ...], rule: AlertRule) -> AlertState:
    """The state after a series, from its summary."""
    for i, run in enumerate(runs):
        goes_on = i == 0
        if run.ok:
            if not state.known:
                continue
            before = state.succ_times if goes_on else 0
            succs = before + run.n
            recovered = state.sent and succs == rule.recover_at
            state = AlertState(0, succs, None, state.sent and succs < rule.recover_at, 0, True, recovered)
            continue
        before = state.fail_times if goes_on else 0
        fails, times = before + run.n, state.sent_times if goes_on else 0
        if state.sent:
            due = fails // rule.every - before // rule.every
        else:
            opening = max(rule.first + 1, before + 1)
            due = 1 + fails // rule.every - opening // rule.every if fails >= opening else 0
        now = times + min(due, max(rule.cap + 1 - times, 0))
        first = state.first_failure_time if goes_on and before else pd.Timestamp(run.began, unit="us").to_pydatetime()
        state = AlertState(fails, 0, first, state.sent or now > times, now, True, state.recovered)
    return state


def _micros(times: pd.Series) -> np.ndarray:
    return times.to_numpy().astype("datetime64[us]").astype(np.int64)


def _summaries(pieces: DataFrame, keys: list[str], ts: str, rule: AlertRule) -> DataFrame:
    """(keys, _chunk, ok, n, began): one summary per key and piece. Rows of a key lie together, in order, in each partition."""
    kinds = dict(pieces.dtypes)
    names = [*keys, "_chunk"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, ()

        def row():
            return [*now, [r.ok for r in held], [r.n for r in held], [r.began for r in held]]

        for rows in batches:
            if rows.empty:
                continue
            change = (rows[names] != rows[names].shift()).any(axis=1).to_numpy()
            change[0] = True
            starts = np.flatnonzero(change)
            ok, began, done = rows["ok"].to_numpy(dtype=bool), _micros(rows[ts]), []
            for s, e in zip(starts, np.append(starts[1:], len(rows)), strict=True):
                key = tuple(rows[c].iloc[s] for c in names)
                part = runs_of(ok[s:e], began[s:e], rule)
                if key == now:
                    held = merge(held, part, rule)
                    continue
                if now is not None:
                    done.append(row())
                now, held = key, part
            if done:
                yield pd.DataFrame(done, columns=[*names, "ok", "n", "began"])
        if now is not None:
            yield pd.DataFrame([row()], columns=[*names, "ok", "n", "began"])

    typed = ", ".join(f"`{c}` {kinds[c]}" for c in names)
    return pieces.mapInPandas(run, f"{typed}, ok array<boolean>, n array<bigint>, began array<bigint>")


def _state(row) -> AlertState:
    first = None if pd.isna(row.first_failure_time) else pd.Timestamp(row.first_failure_time).to_pydatetime()
    return AlertState(int(row.fail_times), int(row.succ_times), first, bool(row.sent), int(row.sent_times), bool(row.known), bool(row.recovered))


def _starting_states(summaries: DataFrame, since: DataFrame, keys: list[str], rule: AlertRule) -> DataFrame:
    """(keys, _chunk, state): the state each piece starts with; a key brings one small row per piece."""
    kinds = dict(summaries.dtypes)

    def fold(key: tuple, pieces: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        state = _state(next(before.itertuples())) if len(before) else AlertState()
        rows = []
        pieces = pieces.sort_values("_chunk")
        for chunk, *runs in zip(*(pieces[c] for c in ("_chunk", "ok", "n", "began")), strict=True):
            rows.append([*key, chunk, *state])
            state = after_runs(state, tuple(Run(bool(a), int(b), int(c)) for a, b, c in zip(*runs, strict=True)), rule)
        return pd.DataFrame(rows, columns=[*keys, "_chunk", *AlertState._fields])

    typed = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, "_chunk"])
    return summaries.groupBy(*keys).cogroup(since.groupBy(*keys)).applyInPandas(fold, f"{typed}, {STATE}")


def follow(samples: DataFrame, keys: list[str], ts: str, ident: str, rule: AlertRule, since: DataFrame | None = None) -> DataFrame:
    """M3-M5, M9: (keys, ident, ts, state after the sample, emit) for samples (keys, ident, ts, ok).

    ``since`` holds the state per key (``state_after`` of an earlier call) before these samples. Successes before a
    key's first failure give no row, as no state exists for them. Keys, time and result must not be null. Samples
    are sorted by ranges of (keys, ts, ident), so a hot key, also one with a single time, is cut into many even pieces.
    """
    spark = samples.sparkSession
    pieces = even_chunks(samples.select(*keys, ident, ts, "ok"), keys, [ts, ident])
    kinds = dict(pieces.dtypes)
    if since is None:
        since = spark.createDataFrame([], ", ".join([*[f"`{c}` {kinds[c]}" for c in keys], STATE]))
    starting = _starting_states(_summaries(pieces, keys, ts, rule), since, keys, rule)

    def run(key: tuple, rows: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        columns = [*keys, ident, ts, *[f.split(" ")[0] for f in FOLLOWED.split(", ")]]
        state = _state(next(start.itertuples())) if len(start) else AlertState()
        rows = rows.sort_values([ts, ident], ignore_index=True)
        if not state.known:  # successes before the first failure leave no state
            failed = np.flatnonzero(~rows["ok"].to_numpy(dtype=bool))
            rows = rows.iloc[failed[0] if len(failed) else len(rows) :]
        if rows.empty:
            return pd.DataFrame(columns=columns)
        _, out = advance(state, rows["ok"].to_numpy(dtype=bool), rows[ts].to_numpy(), rule)
        for i, name in enumerate([*keys, ident, ts]):
            out.insert(i, name, rows[name].to_numpy())
        return out

    typed = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, ident, ts])
    by = [*keys, "_chunk"]
    return pieces.groupBy(*by).cogroup(starting.groupBy(*by)).applyInPandas(run, f"{typed}, {FOLLOWED}")


def state_after(followed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, state) of rows of ``follow``: the state each of them leaves."""
    return followed.select(
        *keys, "fail_times", "succ_times", "first_failure_time", (F.col("is_send_alt_mail") == "Y").alias("sent"),
        F.col("is_send_alt_mail_times").alias("sent_times"), F.lit(True).alias("known"), (F.col("is_send_rcv_mail") == "Y").alias("recovered"),
    )
