"""The alert state as a stream (M3-M5, M9)."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce
from operator import and_, or_

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from rowtide import specs
from rowtide.operators import alert_runs
from rowtide.operators.alert_runs import FOLLOWED, STATE, AlertState, advance, follow, state_after
from rowtide.operators.ordered import keep_last
from rowtide.sources.sinks import children, has_parquet, mark_folder, path_exists
from rowtide.specs import AlertRule
from rowtide.streaming.changes import STATE_STORE_CONF, buffered, use_rocksdb

# the processor travels to the workers as code, so they need not have this package installed
for _module in (sys.modules[__name__], alert_runs, specs):
    cloudpickle.register_pickle_by_value(_module)


class AlertProcessor(StatefulProcessor):
    """Keeps one small state row per key and takes a batch of its samples as arrays."""

    def __init__(self, rule: AlertRule, keys: list[str], ts: str, ident: str):
        self.rule, self.keys, self.ts, self.ident = rule, keys, ts, ident

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("alert", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        samples = pd.concat(list(rows)).sort_values([self.ts, self.ident], ignore_index=True)
        state = AlertState(*self.state.get()) if self.state.exists() else AlertState()
        if not state.known:  # successes before the first failure leave no state
            failed = np.flatnonzero(~samples["ok"].to_numpy(dtype=bool))
            samples = samples.iloc[failed[0] if len(failed) else len(samples):]
        if samples.empty:
            return
        state, out = advance(state, samples["ok"].to_numpy(dtype=bool), samples[self.ts].to_numpy(), self.rule)
        out.insert(0, self.ts, samples[self.ts].to_numpy())
        out.insert(0, self.ident, samples[self.ident].to_numpy())
        for i, name in enumerate(self.keys):
            out.insert(i, name, key[i])
        self.state.update(tuple(state))
        yield out

    def close(self) -> None:
        pass


def alert_stream(samples: DataFrame, keys: list[str], ts: str, ident: str, rule: AlertRule) -> DataFrame:
    """M3, M9: follow the state of every key over a stream of (keys, ts, ident, ok); needs the RocksDB state store.

    A trigger takes the samples of a key together, so the source should limit what one trigger reads.
    """
    kinds = dict(samples.dtypes)
    names = ", ".join(f"{c} {kinds[c]}" for c in [*keys, ident, ts])
    return samples.select(*keys, ident, ts, "ok").groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=AlertProcessor(rule, keys, ts, ident), outputStructType=f"{names}, {FOLLOWED}", outputMode="Append", timeMode="None"
    )


def _days(spark: SparkSession, path: str, number: int) -> list[str]:
    """Days that batches before ``number`` have kept a starting state for, in order."""
    folders = [(day, batch) for day in children(spark, path) for batch in children(spark, f"{path}/{day}")]
    return sorted({day.removeprefix("day=") for day, batch in folders if batch.startswith("batch=") and int(batch.removeprefix("batch=")) < number})


def _put(rows: DataFrame, path: str, number: int, *by: str) -> None:
    """Rows of a batch; it replaces only what itself has written before."""
    rows.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by, "batch").parquet(path)


def start_alerts(samples: DataFrame, keys: list[str], ts: str, ident: str, rule: AlertRule, path: str, checkpoint: str, gap: str | None = None) -> StreamingQuery:
    """M3-M5, M9 as a stream in which samples may come late: each batch goes through :func:`follow`, a hot key in many pieces.

    A key's states are kept per day: ``carry`` has the state a day starts with, ``ends`` the one it leaves. A batch takes
    its keys from the first day it has samples of, reads that day's starting states and the samples kept since, and writes
    again what follows from there. So a late sample costs the days behind it for its own key, and a sample in time costs its
    day. ``read_alerts`` gives the rows, of which those of the latest batch count. Samples without key, time or
    result have no place in any order: they are kept under ``rejected``. A batch that runs again replaces its own rows.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark, day = batch.sparkSession, F.date_format(F.col(ts), "yyyy-MM-dd")
        batch = batch.select(*keys, ident, ts, "ok")
        lacking = reduce(or_, [F.col(c).isNull() for c in [*keys, ts, "ok"]])
        batch.filter(lacking).write.mode("overwrite").parquet(f"{path}/rejected/batch={number}")
        _put(batch.filter(~lacking).withColumn("day", day), f"{path}/samples", number, "day")
        if not has_parquet(spark, f"{path}/samples"):
            return
        kept = spark.read.parquet(f"{path}/samples").withColumn("day", F.col("day").cast("string"))
        first = kept.filter(F.col("batch") == number).groupBy(*keys).agg(F.min("day").alias("_first"))
        came = sorted(r["_first"] for r in first.select("_first").distinct().collect())  # days, not samples
        if not came:
            return
        had = _days(spark, f"{path}/carry", number)
        if not had and not kept.filter(F.col("batch") < number).isEmpty():
            raise RuntimeError(f"the states of earlier batches are missing at {path}/carry; going on would forget open alerts")
        states = ", ".join([*[f"`{c}` {kind}" for c, kind in batch.dtypes if c in keys], STATE, "day string", "batch int"])

        def held(name: str, days: list[str]) -> DataFrame:
            folders = [f"{path}/{name}/day={d}" for d in days if path_exists(spark, f"{path}/{name}/day={d}")]
            if not folders:
                return spark.createDataFrame([], states)
            rows = spark.read.schema(states).option("basePath", f"{path}/{name}").parquet(*folders)
            return keep_last(rows.filter(F.col("batch") < number), [*keys, "day"], ["batch"])

        def later_wins(one: DataFrame, two: DataFrame, by: list[str]) -> DataFrame:
            return keep_last(one.withColumn("_late", F.lit(0)).unionByName(two.withColumn("_late", F.lit(1))), by, ["_late"]).drop("_late")

        # a day that is new starts with what the day before it started with, and with what that one left
        new = sorted(r["day"] for r in kept.filter(F.col("batch") == number).select("day").distinct().collect() if r["day"] not in had)
        none, opened, after = spark.createDataFrame([], states), [], {}
        for d in new:
            for earlier in [x for x in had if x < d][-1:]:
                after.setdefault(earlier, []).append(d)
        for earlier, days in after.items():
            opened.append(later_wins(held("carry", [earlier]), held("ends", [earlier]), keys).withColumn("day", F.explode(F.array(*map(F.lit, days)))))
        start = reduce(DataFrame.unionByName, [held("carry", [x for x in came if x in had]), *opened])
        same = reduce(and_, [start[c] == first[c] for c in keys], F.col("day") == F.col("_first"))
        since = start.join(first, same).select(*[start[c] for c in keys], *AlertState._fields)
        again = kept.filter((F.col("batch") <= number) & (F.col("day") >= came[0])).join(first, keys).filter("day >= _first")
        out = f"{path}/out/batch={number}"
        follow(again, keys, ts, ident, rule, since).write.mode("overwrite").parquet(out)
        rows = spark.read.parquet(out).withColumn("day", day)
        ends = state_after(keep_last(rows, [*keys, "day"], [ts, ident]), [*keys, "day"])
        _put(ends, f"{path}/ends", number, "day")
        # the days behind start, for these keys, with the last state left before them
        behind = [d for d in sorted({*had, *new}) if d > came[0]]
        until = F.lead("day").over(Window.partitionBy(*keys).orderBy("day"))
        reached = F.filter(F.array(*map(F.lit, behind)).cast("array<string>"), lambda d: (d > F.col("day")) & (F.col("_until").isNull() | (d <= F.col("_until"))))
        patched = ends.withColumn("_until", until).withColumn("day", F.explode(reached)).drop("_until")
        fresh = reduce(DataFrame.unionByName, [o.drop("batch") for o in opened], none.drop("batch"))
        _put(later_wins(fresh, patched, [*keys, "day"]), f"{path}/carry", number, "day")
        for d in new:  # also a day that starts without any state is known from now on
            mark_folder(spark, f"{path}/carry/day={d}/batch={number}")

    return buffered(samples, checkpoint, gap).foreachBatch(step).start()


def read_alerts(spark: SparkSession, path: str, keys: list[str], ident: str) -> DataFrame:
    """The state after every sample as far as is known, with its notification: of several rows the latest batch's counts."""
    return keep_last(spark.read.parquet(f"{path}/out"), [*keys, ident], ["batch"]).drop("batch")
