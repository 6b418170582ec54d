"""Batches of documents by ranges of doc_id."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Stands for a missing doc_id, which comes after all others.
NO_ID = (1 << 63) - 1


def _place(bounds: np.ndarray):
    @F.pandas_udf("int")
    def place(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in ids:
            yield pd.Series(np.searchsorted(bounds, x.to_numpy(), "left").astype(np.int32))

    return place


def placed(values: np.ndarray, names: np.ndarray):
    """The name of each id among the sorted ``values``, -1 for the others."""

    @F.pandas_udf("int")
    def place(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in ids:
            at = np.minimum(np.searchsorted(values, x.to_numpy()), len(values) - 1)
            yield pd.Series(np.where(values[at] == x.to_numpy(), names[at], -1).astype(np.int32))

    return place


def id_bounds(docs: DataFrame, batch_bytes: int) -> np.ndarray:
    """Upper bounds of doc_id of all batches but the last.

    Quantiles of doc_id are taken, several to a batch, then the bytes between them are summed, and neighbours are joined
    up to ``batch_bytes``; there are at least as many batches as shuffle partitions, if ids allow. The driver holds two
    numbers for each quantile.
    """
    least = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.octet_length("text").alias("n"))
    total = ids.agg(F.sum("n")).first()[0] or 0
    limit = min(batch_bytes, max(total // least, 1))
    fine = 4 * (total // limit + 1)
    marks = ids.agg(F.percentile_approx("doc_id", [i / fine for i in range(1, fine)], 4 * fine)).first()[0]
    bounds = np.unique(np.array(marks or [], np.int64))
    sums = np.zeros(len(bounds) + 1, np.int64)
    for r in ids.groupBy(_place(bounds)("doc_id").alias("bin")).agg(F.sum(F.coalesce("n", F.lit(0))).alias("n")).collect():
        sums[r["bin"]] = r["n"]
    kept, held = [], 0
    for bound, n, after in zip(bounds.tolist(), sums.tolist(), sums[1:].tolist(), strict=False):
        held += n
        if held + after / 2 > limit:
            kept.append(bound)
            held = 0
    return np.array(kept, np.int64)


def doc_batches(docs: DataFrame, batch_bytes: int, bounds: np.ndarray | None = None) -> tuple[DataFrame, int]:
    """Rows (doc_id, text, rest, batch) and the number of batches. rest is a struct of all columns as given but text.

    doc_id has NO_ID for null. Batches rise with doc_id; rows that share a doc_id share a batch.
    """
    bounds = id_bounds(docs, batch_bytes) if bounds is None else bounds
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"), rest.alias("rest"))
    return rows.withColumn("batch", _place(bounds)("doc_id")), len(bounds) + 1


def split_batches(docs: DataFrame, batch_bytes: int) -> tuple[DataFrame, np.ndarray, int]:
    """Rows as of ``doc_batches``, the first batch of each group, and a number of slices for work that isn't cut by doc_id.

    Groups rise with doc_id. A doc_id with more than ``batch_bytes`` of text is a group of its own, and so are the rows
    without one; such a group is cut into several batches by a hash of the row. Any other group is one batch. A slice
    has about two batches' share, which bounds what one task holds. The driver holds two
    numbers for each group and one for each such doc_id.
    """
    bounds = id_bounds(docs, batch_bytes)
    least = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"))
    bins = ids.withColumn("bin", _place(bounds)("doc_id"))
    sizes = {r["bin"]: r for r in bins.groupBy("bin").agg(F.sum("n").alias("n"), F.max("doc_id").alias("top")).collect()}
    full = [k for k, r in sizes.items() if r["n"] > 2 * batch_bytes or r["top"] == NO_ID]
    large: dict[int, int] = {}
    if full:
        heavy = bins.where(F.col("bin").isin(full)).groupBy("doc_id").agg(F.sum("n").alias("n"))
        large = {r["doc_id"]: r["n"] for r in heavy.where((F.col("n") > batch_bytes) | (F.col("doc_id") == NO_ID)).collect()}
    own = np.array(sorted(large), np.int64)
    bounds = np.unique(np.concatenate([bounds, own - 1, own[own < NO_ID]])).astype(np.int64)
    parts = np.ones(len(bounds) + 1, np.int64)
    parts[np.searchsorted(bounds, own)] = [max(1, -(-large[i] // batch_bytes)) for i in own.tolist()]
    firsts = np.cumsum(parts) - parts

    @F.pandas_udf("int")
    def number(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        group = np.searchsorted(bounds, ids.to_numpy(), "left")
        return pd.Series((firsts[group] + hashes.to_numpy() % parts[group]).astype(np.int32))

    rows, _ = doc_batches(docs, batch_bytes, bounds)
    hashed = F.xxhash64("text", F.to_json("rest")) if parts.max() > 1 else F.lit(0).cast("long")
    batches = int(parts.sum())
    return rows.withColumn("batch", number("doc_id", hashed)), firsts, max(-(-batches // 2), min(batches, least))
