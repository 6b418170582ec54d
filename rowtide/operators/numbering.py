"""Dense numbering of a whole table without putting it through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rowtide.session import stable

_COPIES_PER_BLOCK = 65536
_PART_BITS = 33  # layout of monotonically_increasing_id: partition above, position below


def _spread_copies(df: DataFrame) -> DataFrame:
    """Number identical rows apart, so that a range split can cut through a hot group of copies."""
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    blocks = counted.withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / _COPIES_PER_BLOCK)))
    ).repartition(*df.columns, "_block")
    left = F.least(F.col("_n") - F.col("_block") * _COPIES_PER_BLOCK, F.lit(_COPIES_PER_BLOCK))
    copies = blocks.withColumn("_in_block", F.explode(F.sequence(F.lit(1).cast("bigint"), left)))
    return copies.withColumn("_copy", F.col("_in_block") + F.col("_block") * _COPIES_PER_BLOCK).select(*df.columns, "_copy")


def number_rows(
    df: DataFrame, order: list[Column | str], name: str = "row_num", unique: bool = False, partitions: int | None = None
) -> DataFrame:
    """Number rows 1..n in the given total order.

    Range partitions are sorted locally and shifted by the sizes of the partitions before them; the only
    global step works on one row per partition. ``unique`` says the rows differ and skips the copy split.
    """
    parts = [partitions] if partitions else []  # else as many as the session shuffles into
    exprs = [F.col(c) if isinstance(c, str) else c for c in order]
    rows = df if unique else _spread_copies(df)
    keys = exprs if unique else [*exprs, F.col("_copy")]
    ranged = stable(
        rows.repartitionByRange(*parts, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    )
    placed = ranged.withColumn("_part", F.shiftright("_at", _PART_BITS))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    index = F.col("_at").bitwiseAND((1 << _PART_BITS) - 1)
    return (
        placed.join(F.broadcast(offsets), "_part")  # one row per partition
        .withColumn(name, (F.col("_offset") + index + 1).cast("bigint"))
        .select(name, *df.columns)
    )


def add_surrogate_key(df: DataFrame, name: str = "pkid") -> DataFrame:
    """A keyless table gets 1..n in the order of all its columns."""
    return number_rows(df, list(df.columns), name)
