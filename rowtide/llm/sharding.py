"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix (operator 5)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from rowtide.llm.columns import whole_row

#: Rows up to which numpy draws; its generator ends at 10^9.
_DRAW = 900_000_000


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Sizes at most one apart, the larger ones first."""
    return np.array([rows // shards + (j < rows % shards) for j in range(shards)], np.int64)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` rows, taken without replacement, are among the ``good`` ones; also beyond ``_DRAW`` rows.

    There the law is inverted from ratios of neighbouring probabilities, over twelve deviations on both sides of the
    mean; what lies outside is below 1e-30, far under the steps of a random number.
    """
    total = good + bad
    if total <= _DRAW:
        return int(rng.hypergeometric(good, bad, drawn))
    low, high = max(0, drawn - bad), min(good, drawn)
    mean = drawn * (good / total)
    reach = 12 * (mean * (bad / total) * ((total - drawn) / total)) ** 0.5 + 40
    low, high = max(low, int(mean - reach)), min(high, int(mean + reach) + 1)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - k) + np.log(drawn - k) - np.log(k + 1) - np.log(bad - drawn + k + 1)
    weights = np.concatenate([[0.0], np.cumsum(steps)])
    sums = np.cumsum(np.exp(weights - weights.max()))
    return low + min(int(np.searchsorted(sums, rng.random() * sums[-1], side="right")), high - low)


def communication_matrix(cells: list[int], shards: int, seed: int) -> np.ndarray:
    """How many rows of each cell go to each shard: rows add up to the cells, columns to the shard sizes.

    Given both, the counts have the law they would have if all rows were shuffled at once: each cell draws from what
    is left of the shards without replacement. Beyond ``_DRAW`` rows, the cells are halved and the first half draws its
    total from every shard by the same law, until a run of cells is small enough or one cell.
    """
    rng, out = np.random.default_rng(seed), np.zeros((len(cells), shards), np.int64)

    def deal(begin: int, end: int, left: np.ndarray) -> None:
        rows = sum(cells[begin:end])
        if rows <= _DRAW:
            for i in range(begin, end):
                out[i] = rng.multivariate_hypergeometric(left, cells[i], method="marginals")
                left = left - out[i]
        elif end - begin == 1:
            out[begin] = left
        else:
            middle = (begin + end) // 2
            wanted, others, first = sum(cells[begin:middle]), rows, np.zeros(shards, np.int64)
            for j, size in enumerate(left.tolist()):
                others -= size
                first[j] = hypergeometric(rng, size, others, wanted)
                wanted -= int(first[j])
            deal(begin, middle, first)
            deal(middle, end, left - first)

    deal(0, len(cells), shard_sizes(sum(cells), shards))
    return out


def shuffle_into_shards(df: DataFrame, shards: int, seed: int = 17, cells: int | None = None, blocks: int = 8) -> DataFrame:
    """``df`` with columns shard and slot: a uniform shuffle, shard sizes at most one apart, slots gapless from 0.

    Rows fall into cells by a hash of all columns. The driver gets one count per cell and draws the communication matrix
    (cells x shards numbers, which is also all that is broadcast). In its cell a row takes a seeded random place, and the
    matrix row cuts the places among the shards. Inside a shard, rows are ordered by a second seeded hash, taken in blocks, so
    that a shard is no single task: a block's first slot is the number of rows in the blocks before it.

    The same rows, shards and seed give the same result, whatever the order or partitions of the input. Rows that
    are equal in all columns are interchangeable. Nulls are values like others; given columns named shard or slot are
    replaced; an empty table gives no rows.
    """
    cells = cells or max(64, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    given = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    keyed = df.select(row.alias("_row"), whole_row(df, seed).alias("_h1"), whole_row(df, seed + 1).alias("_h2"), whole_row(df, seed + 2).alias("_h3"))
    keyed = keyed.withColumn("_cell", F.pmod("_h1", F.lit(cells)).cast("int"))
    counts = {r["_cell"]: r["count"] for r in keyed.groupBy("_cell").count().collect()}
    matrix = communication_matrix([counts.get(i, 0) for i in range(cells)], shards, seed)
    ends = df.sparkSession.createDataFrame([(i, row) for i, row in enumerate(matrix.cumsum(axis=1).tolist())], "_cell int, _ends array<long>")
    place = F.row_number().over(Window.partitionBy("_cell").orderBy("_h2", "_h3"))
    dealt = (
        keyed.withColumn("_place", place)
        .join(F.broadcast(ends), "_cell")
        .withColumn("shard", F.size(F.filter("_ends", lambda e: e < F.col("_place"))))
        .withColumn("_block", F.pmod(F.shiftright("_h3", 20), F.lit(blocks)).cast("int"))
        .select("_row", "_h2", "_h3", "shard", "_block")
    )
    sizes = dealt.groupBy("shard", "_block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("_block")) - F.col("n")
    firsts = sizes.select("shard", "_block", before.alias("_first"))
    nth = F.row_number().over(Window.partitionBy("shard", "_block").orderBy("_h3", "_h2")) - 1
    return (
        dealt.withColumn("_nth", nth)
        .join(F.broadcast(firsts), ["shard", "_block"])
        .select(*[F.col("_row").getField(c).alias(c) for c in given], "shard", (F.col("_first") + F.col("_nth")).cast("long").alias("slot"))
    )
