"""Order-sensitive operators (W2-W5) that stay parallel inside one hot key.

A plain window over a key sends all its rows to one task. Here every key is cut into chunks of its own order
(a log file, an hour); rows are scanned inside (key, chunk), a summary with one row per chunk is scanned per
key, and what the summary carries over is joined back on (key, chunk).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rowtide.session import stable

POSITION = ["file_no", "pos", "seq"]


def hour_chunk(ts: str) -> Column:
    """Default chunk of time-ordered samples: the hour they belong to."""
    return F.date_trunc("hour", F.col(ts))


def even_chunks(df: DataFrame, keys: list[str], order: list[str], name: str = "_chunk", partitions: int | None = None) -> DataFrame:
    """Rows with a chunk number that rises with (keys, order); chunks hold about equal numbers of rows.

    Borders come from Spark's sample of whole (keys, order) values, so a key with a third of all rows is cut into a third of
    the chunks, and rows of one time are cut by the rest of the order. Rows of a chunk lie together, sorted, in one
    partition. The result is checkpointed: borders must not change when an executor is lost.
    """
    ranged = df.repartitionByRange(*([partitions] if partitions else []), *keys, *order).sortWithinPartitions(*keys, *order)
    return stable(ranged.withColumn(name, F.spark_partition_id()))


def _running(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def _placed(df: DataFrame, keys: list[str], chunk: Column) -> DataFrame:
    """Rows with their chunk. Rows without a key or a place in the order are kept apart (``_unplaced``), on both sides of the later
    join alike, so that the rows and their summary can share one shuffle."""
    cut = df.withColumn("_chunk", chunk)
    for name in [*keys, "_chunk"]:
        cut = cut.filter(F.col(name).isNotNull())
    return cut


def _unplaced(df: DataFrame, keys: list[str], chunk: Column) -> DataFrame:
    """Rows that ``_placed`` keeps apart: they have no place in any order."""
    missing = chunk.isNull()
    for name in keys:
        missing = missing | F.col(name).isNull()
    return df.filter(missing)


def rejected_samples(samples: DataFrame, keys: list[str], ts: str, chunk: Column | None = None) -> DataFrame:
    """Samples without a key or a time, which no streak can hold; ``streaks`` gives all others."""
    return _unplaced(samples, keys, hour_chunk(ts) if chunk is None else chunk)


def last_change_per_key(log: DataFrame, keys: list[str], order: list[str] = POSITION) -> DataFrame:
    """The last log row of every key with the number of rows merged into it.

    Aggregation merges on the map side, so a hot key reaches the shuffle as one row per input partition.
    """
    rest = [c for c in log.columns if c not in keys]
    place = F.struct(*order)
    return (
        log.groupBy(*keys)
        .agg(
            F.max_by(F.struct(*rest), place).alias("_last"),
            F.count(F.lit(1)).alias("merged"),
            F.min(order[-1]).alias("first_id"),
        )
        .select(*keys, "_last.*", "merged", "first_id")
    )


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of every key; the rank filter is applied before the shuffle as well as after it."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def label_runs(log: DataFrame, table: str = "tbl", op: str = "op", order: list[str] = POSITION, chunk: str = "file_no") -> DataFrame:
    """Number the runs of equal operations of each table in log order (column ``run_no``).

    Rows without a table or a log file have no place among the others: they stay, with a null run_no.
    """
    unplaced = log.filter(F.col(table).isNull() | F.col(chunk).isNull()).select("*", F.lit(None).cast("bigint").alias("run_no"))
    placed = log.filter(F.col(table).isNotNull() & F.col(chunk).isNotNull())
    w = _running([table, chunk], [c for c in order if c != chunk])
    local = placed.select("*", F.lag(op).over(w).alias("_was"), F.lead(op).over(w).alias("_next"))
    steps = F.sum(F.when(F.col("_was") != F.col(op), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    local = local.withColumn("_steps", steps)
    # operations are never null, so a missing neighbour marks the ends of a chunk
    summary = local.groupBy(table, chunk).agg(
        F.max(F.when(F.col("_was").isNull(), F.col(op))).alias("_first_op"),
        F.max(F.when(F.col("_next").isNull(), F.col(op))).alias("_last_op"),
        F.max("_steps").alias("_inner"),
    )
    by_chunk = Window.partitionBy(table).orderBy(chunk)
    carried = summary.withColumn("_prev", F.lag("_last_op").over(by_chunk)).withColumn(
        "_opens", F.when(F.col("_prev").isNull() | (F.col("_prev") != F.col("_first_op")), 1).otherwise(0)
    )
    carried = carried.withColumn(
        "_base", F.sum(F.col("_opens") + F.col("_inner")).over(by_chunk) - F.col("_inner")
    ).select(table, chunk, "_base")
    return (
        local.join(carried, [table, chunk])
        .withColumn("run_no", (F.col("_base") + F.col("_steps")).cast("bigint"))
        .select(*log.columns, "run_no")
        .unionByName(unplaced)
    )


def runs(log: DataFrame, table: str = "tbl", op: str = "op", order: list[str] = POSITION, chunk: str = "file_no") -> DataFrame:
    """One row per merged statement; an update run becomes a delete run followed by an insert run.

    The rows of a run are found again through ``label_runs``; their ids are not gathered into one cell.
    """
    labelled = label_runs(log, table, op, order, chunk)
    merged = labelled.groupBy(table, "run_no", op).agg(
        F.count(F.lit(1)).alias("n"), F.min(order[-1]).alias("first_id"), F.max(order[-1]).alias("last_id")
    )
    parts = F.when(F.col(op) == "update", F.array(F.lit("delete"), F.lit("insert"))).otherwise(F.array(op))
    return merged.select(
        table, "run_no", F.posexplode(parts).alias("part", "statement"), "n", "first_id", "last_id"
    )


def counter_delta(
    samples: DataFrame, keys: list[str], value: str, order: list[str], ts: str, chunk: Column | None = None
) -> DataFrame:
    """Growth per second of a cumulative counter; a fall means a reset and gives null, and so does a row without key or time."""
    lost = _unplaced(samples, keys, hour_chunk(ts) if chunk is None else chunk)
    cut = _placed(samples, keys, hour_chunk(ts) if chunk is None else chunk)
    w = _running([*keys, "_chunk"], order)
    here = F.struct(F.col(value).alias("v"), F.col(ts).alias("t"))
    local = cut.withColumn("_prev", F.lag(here).over(w))
    ends = cut.groupBy(*keys, "_chunk").agg(F.max_by(here, F.struct(*order)).alias("_end"))
    carried = ends.select(
        *keys, "_chunk", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_chunk")).alias("_carry")
    )
    joined = local.join(carried, [*keys, "_chunk"]).withColumn("_p", F.coalesce("_prev", "_carry"))
    grown = F.col(value) - F.col("_p.v")
    secs = F.timestamp_diff("SECOND", F.col("_p.t"), F.col(ts))
    out = joined.select(
        *samples.columns,
        F.when(grown >= 0, grown).alias("delta"),
        F.when(grown >= 0, F.try_divide(grown, secs)).alias("per_second"),
    )
    return out.unionByName(lost, allowMissingColumns=True)


def _as_chunk(since: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """Earlier results as the summary of a chunk before all others: an ended streak, its success, then what goes on."""
    failing = F.col("fail_times") > 0
    many = F.col("succ_times") > 1
    ended = F.when(many, F.lit(1)).otherwise(F.col("ended_streak"))
    good = F.when(failing, F.lit(1)).otherwise(F.col("succ_times"))
    return since.select(
        *keys,
        F.lit(None).cast(kind).alias("_chunk"),
        (ended + good + F.col("fail_times")).alias("_n"),
        (ended + good).cast("int").alias("_end_ok"),
        F.when(many, ended + good - 1).cast("int").alias("_end_ok2"),
        F.when(failing, ended + good + F.col("fail_times")).otherwise(ended).cast("int").alias("_end_fail"),
        F.col("first_failure_time").alias("_end_began"),
    )


def streaks(
    samples: DataFrame, keys: list[str], ok: Column, order: list[str], ts: str, chunk: Column | None = None, since: DataFrame | None = None
) -> DataFrame:
    """Failures in a row so far, when they began, successes since, and ``ended_streak``: the failures right before
    the latest success. ``since`` holds the last row per key of an earlier call whose run goes on here.

    ``recorded`` is false for successes before the first failure: no state exists for them yet.
    """
    cut = _placed(samples.withColumn("_ok", ok), keys, hour_chunk(ts) if chunk is None else chunk)
    w = _running([*keys, "_chunk"], order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    numbered = cut.select("*", F.row_number().over(w).alias("_rn"), F.lag("_ok").over(w).alias("_was_ok"))
    ok_at = F.when(F.col("_ok"), F.col("_rn"))
    fail_at = F.when(~F.col("_ok"), F.col("_rn"))
    start = F.when(~F.col("_ok") & F.coalesce("_was_ok", F.lit(True)), F.col(ts))
    local = numbered.select(
        "*",
        F.max(ok_at).over(upto).alias("_last_ok"),
        F.max(ok_at).over(before).alias("_ok_before"),
        F.max(fail_at).over(upto).alias("_last_fail"),
        F.max(start).over(upto).alias("_began"),
    ).withColumn("_ok2", F.max(F.when(F.col("_ok"), F.col("_ok_before"))).over(upto))
    summary = local.groupBy(*keys, "_chunk").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max("_last_ok").alias("_end_ok"),
        F.max("_ok2").alias("_end_ok2"),
        F.max("_last_fail").alias("_end_fail"),
        F.max("_began").alias("_end_began"),
    )
    if since is not None:
        summary = summary.unionByName(_as_chunk(since, keys, dict(cut.dtypes)["_chunk"]))
    by_chunk = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("_chunk"))
    past = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    summary = (
        summary.withColumn("_off", F.coalesce(F.sum("_n").over(past), F.lit(0)))
        .withColumn("_ends_ok", F.col("_end_ok").eqNullSafe(F.col("_n").cast("int")))
        .withColumn("_prev_ends_ok", F.coalesce(F.lag("_ends_ok").over(by_chunk), F.lit(True)))
        .withColumn("_carry_ok", F.max(F.col("_off") + F.col("_end_ok")).over(past))
    )
    opens = F.when(~F.col("_ends_ok") & (F.col("_end_ok").isNotNull() | F.col("_prev_ends_ok")), F.col("_end_began"))
    second = F.coalesce(F.col("_off") + F.col("_end_ok2"), F.when(F.col("_end_ok").isNotNull(), F.coalesce("_carry_ok", F.lit(0))))
    summary = summary.select(
        *keys,
        "_chunk",
        "_off",
        "_prev_ends_ok",
        "_carry_ok",
        F.max(second).over(past).alias("_carry_ok2"),
        F.max(F.col("_off") + F.col("_end_fail")).over(past).alias("_carry_fail"),
        F.max(opens).over(past).alias("_carry_began"),
    )
    rn = F.col("_off") + F.col("_rn")
    last_ok = F.coalesce(F.col("_off") + F.col("_last_ok"), "_carry_ok", F.lit(0))
    ok_before = F.coalesce(F.col("_off") + F.col("_ok2"), F.when(F.col("_last_ok").isNotNull(), F.col("_carry_ok")).otherwise(F.col("_carry_ok2")), F.lit(0))
    last_fail = F.coalesce(F.col("_off") + F.col("_last_fail"), "_carry_fail")
    continues = F.col("_last_ok").isNull() & ~F.col("_prev_ends_ok")
    good = F.col("_ok")
    return (
        local.join(summary, [*keys, "_chunk"])
        .withColumn("recorded", last_fail.isNotNull())
        .withColumn("fail_times", F.when(good, F.lit(0)).otherwise(rn - last_ok).cast("bigint"))
        .withColumn("succ_times", F.when(good, F.coalesce(rn - last_fail, F.lit(0))).otherwise(0).cast("bigint"))
        .withColumn("first_failure_time", F.when(~good, F.when(continues, F.col("_carry_began")).otherwise(F.col("_began"))))
        .withColumn("ended_streak", F.when(last_ok > 0, last_ok - 1 - ok_before).otherwise(0).cast("bigint"))
        .withColumn("ok", good)
        .select(*samples.columns, "ok", "recorded", "fail_times", "succ_times", "first_failure_time", "ended_streak")
    )
