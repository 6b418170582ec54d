"""Cutting a table into parts that can be read on their own."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F

# fixed value: a span of ids beyond this many times the rows is called sparse
SPARSE_FACTOR = 3
# fixed value: more marks than this would make one expression too large to be compiled
_HALVED = 128


def bucket_of(key: str, marks: list) -> Column:
    """Number of the bucket between sorted ``marks`` that a key lies in: keys up to the first mark are in bucket 0; null for a null key.

    Up to ``_HALVED`` marks are halved again and again, so that a key is compared with a few of them.
    """
    if len(marks) > _HALVED:
        held = F.array(*[F.lit(m) for m in marks])
        return F.when(F.col(key).isNotNull(), F.size(F.filter(held, lambda m: m < F.col(key))))

    def among(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.lit(marks[mid]) < F.col(key), among(mid + 1, hi)).otherwise(among(lo, mid))

    return F.when(F.col(key).isNotNull(), among(0, len(marks)))


def sketch_marks(df: DataFrame, key: str, n: int, accuracy: int) -> list:
    """At most ``n - 1`` different values that cut the keys into about equal parts, from a quantile sketch."""
    return sorted(set(df.agg(F.percentile_approx(key, [i / n for i in range(1, n)], accuracy)).first()[0] or []))


def exact_cuts(df: DataFrame, key: str, n: int, accuracy: int = 10_000) -> list:
    """The keys at ranks ceil(i * rows / n), i from 1 to n - 1, exactly; keys may be numbers or times, nulls don't count.

    A sketch cuts the keys into buckets, whose rows are counted. Only the buckets that hold a cut are looked at again: their
    keys are counted one by one. The driver gets one number per bucket and the cuts; no sort of the table is needed.
    """
    marks = sketch_marks(df, key, 4 * n, accuracy)
    bucket = bucket_of(key, marks).alias("bucket")
    sizes = {r["bucket"]: r["n"] for r in df.groupBy(bucket).agg(F.count(key).alias("n")).collect() if r["n"]}
    total, below, first = sum(sizes.values()), 0, {}
    for b in sorted(sizes):
        first[b], below = below, below + sizes[b]
    ranks = [(i * total + n - 1) // n for i in range(1, n)] if total else []
    wanted = [(max(b for b in first if first[b] < r), r) for r in ranks]
    inside = df.select(key, bucket).filter(F.col("bucket").isin(*{b for b, _ in wanted}))
    counted = inside.groupBy("bucket", key).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("bucket").orderBy(key)).alias("upto")
    at = F.explode(F.array(*[F.struct(F.lit(b).alias("b"), F.lit(r - first[b]).alias("rank"), F.lit(r).alias("r")) for b, r in wanted])).alias("w") if wanted else None
    if at is None:
        return []
    ranked = counted.select("bucket", F.col(key).alias("k"), "n", upto).select("*", at)
    hit = ranked.filter((F.col("w.b") == F.col("bucket")) & (F.col("upto") >= F.col("w.rank")) & (F.col("upto") - F.col("n") < F.col("w.rank")))
    found = {r["r"]: r["k"] for r in hit.select(F.col("w.r").alias("r"), "k").collect()}
    return [found[r] for _, r in wanted]


def key_ranges(df: DataFrame, key: str, n: int, accuracy: int = 10_000) -> DataFrame:
    """``n`` ranges (lo, hi, rows) of equal row counts but for repeated keys; null keys are a range of their own."""
    ranged = df.select(F.col(key), bucket_of(key, exact_cuts(df, key, n, accuracy)).alias("range_no"))
    return ranged.groupBy("range_no").agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(F.lit(1)).alias("rows"))


def key_blocks(df: DataFrame, key: str, lo: int, width: int) -> DataFrame:
    """Fixed-width id blocks with their row counts; empty blocks do not appear."""
    block = F.floor((F.col(key) - lo) / width)
    return (
        df.filter(F.col(key) >= lo)
        .groupBy(block.alias("block_no"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .select("block_no", (F.col("block_no") * width + lo).alias("start_id"), (F.col("block_no") * width + lo + width - 1).alias("stop_id"), "rows")
    )


def day_slices(df: DataFrame, ts: str) -> DataFrame:
    """The days that hold rows, as half-open slices, with their row counts."""
    return (
        df.groupBy(F.date_trunc("day", ts).cast("timestamp_ntz").alias("slice_start"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("slice_end", F.col("slice_start") + F.expr("INTERVAL 1 DAY"))
    )


def choose_split(df: DataFrame, key: str, floor: int = 0) -> DataFrame:
    """A10: read by id, or by date where ids are far sparser than rows; tables below ``floor`` rows are never sparse."""
    stats = df.agg(F.count(F.lit(1)).alias("rows"), (F.max(key) - F.min(key)).alias("span"))
    by_date = (F.col("rows") >= floor) & (F.col("span") > F.col("rows") * SPARSE_FACTOR)
    return stats.withColumn("split", F.when(by_date, "date").otherwise("id"))


def _literal(value) -> str:
    """A value as SQL text: numbers plain, all else quoted."""
    if isinstance(value, (int, float, Decimal)) and not isinstance(value, bool):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def _cover(col: str, starts: list) -> list[str]:
    """Half-open conditions between sorted ``starts`` that together take every row exactly once: the first is open below, the last
    above, and one more takes the nulls. Rows that came in after the starts were taken are covered too."""
    marks = [_literal(x) for x in starts[1:]]
    if not marks:
        return [f"{col} is not null", f"{col} is null"]
    inner = [f"{col} >= {lo} and {col} < {hi}" for lo, hi in zip(marks, marks[1:], strict=False)]
    return [f"{col} < {marks[0]}", *inner, f"{col} >= {marks[-1]}", f"{col} is null"]


def range_predicates(ranges: DataFrame, key: str) -> list[str]:
    """JDBC predicates of A7 ranges, or A8 blocks, that cover all rows; as many as parallel reads asked for, and one for null keys."""
    low = "lo" if "lo" in ranges.columns else "start_id"
    return _cover(key, ranges.agg(F.sort_array(F.collect_list(low))).first()[0])  # one value per range, nulls left out


def day_predicates(slices: DataFrame, ts: str, parts: int | None = None) -> list[str]:
    """JDBC predicates of A9 slices, one per day and one for rows without a time; together they cover all rows.

    With ``parts``, neighbouring days are put together to about so many ranges of equal row counts.
    """
    days = slices.filter(F.col("slice_start").isNotNull()).select("slice_start", "rows").orderBy("slice_start").collect()
    if parts:
        size, held, kept = max(1, sum(r["rows"] for r in days) // parts), 0, []
        for r in days:
            if not kept or held >= size:
                kept, held = [*kept, r], 0
            held += r["rows"]
        days = kept
    return _cover(ts, [f"{r['slice_start']:%Y-%m-%d}" for r in days])
