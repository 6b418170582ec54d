"""A first load in ranges that goes on where it stopped (Y1 with the reading plans A7-A10)."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowtide.sources.sinks import children, has_parquet
from rowtide.sources.splits import choose_split, day_predicates, day_slices, key_ranges, range_predicates

LEDGER = "range_no int, predicate string, rows bigint, seconds double"


def reading_plan(source: DataFrame, keys: list[str], ts: str | None, parts: int, floor: int = 100_000) -> list[str]:
    """Conditions that together take every row of a table once, also rows that come in later and rows with nulls.

    A10 chooses: ranges of the first key with equal row counts (A7), which also serve a composite key, or ranges of days (A9)
    where ids are far sparser than rows. A key that is neither a number nor a time is read by days, or at one go.
    """
    key = keys[0] if keys and dict(source.dtypes)[keys[0]].split("(")[0] in ("tinyint", "smallint", "int", "bigint", "decimal", "float", "double", "date", "timestamp", "timestamp_ntz") else None
    by_date = key is None or (dict(source.dtypes)[key] in ("smallint", "int", "bigint") and choose_split(source, key, floor).first()["split"] == "date")
    if ts and by_date:
        return day_predicates(day_slices(source, ts), ts, parts)
    return range_predicates(key_ranges(source, key, parts), key) if key else ["true"]


def _plan(spark: SparkSession, path: str, make: Callable[[], list[str]]) -> list[tuple[int, str]]:
    """The load's conditions: made once and kept, so that a load that goes on has the same ranges."""
    place = f"{path}-ledger/plan"
    if not has_parquet(spark, place):
        spark.createDataFrame(list(enumerate(make())), "range_no int, predicate string").coalesce(1).write.mode("overwrite").parquet(place)
    return sorted((r["range_no"], r["predicate"]) for r in spark.read.parquet(place).collect())


def ranged_load(
    spark: SparkSession, read: Callable[[str], DataFrame], plan: Callable[[], list[str]], path: str, at_once: int = 4, most: int | None = None
) -> DataFrame:
    """Load a table range by range into ``path``; gives the ledger: one row for each range that is done.

    ``read`` gives the rows under a condition (a filter, or a read over JDBC with that predicate). A range is written to its
    own folder and then entered in the ledger beside the target; a load that died goes on with the ranges that are not
    entered, and one that is whole does nothing. ``most`` ends the run after so many ranges.
    """
    ledger = f"{path}-ledger/done"
    done = {int(n.partition("=")[2]) for n in children(spark, ledger) if has_parquet(spark, f"{ledger}/{n}")}
    left = [(i, p) for i, p in _plan(spark, path, plan) if i not in done][:most]

    def one(item: tuple[int, str]) -> None:
        number, predicate = item
        began, place = time.monotonic(), f"{path}/range={number}"
        read(predicate).write.mode("overwrite").parquet(place)
        rows = spark.read.parquet(place).count()
        spark.createDataFrame([(predicate, rows, time.monotonic() - began)], "predicate string, rows bigint, seconds double").coalesce(1).write.mode("overwrite").parquet(f"{ledger}/range_no={number}")

    with ThreadPoolExecutor(at_once) as pool:
        list(pool.map(one, left))
    return spark.read.schema(LEDGER).parquet(ledger) if has_parquet(spark, ledger) else spark.createDataFrame([], LEDGER)


def loaded(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the ranges that are done; a range that died while it was written isn't among them."""
    done = [n.partition("=")[2] for n in children(spark, f"{path}-ledger/done") if has_parquet(spark, f"{path}-ledger/done/{n}")]
    return spark.read.option("basePath", path).parquet(*[f"{path}/range={n}" for n in done]).drop("range")


def load_left(spark: SparkSession, path: str) -> int:
    """How many ranges of a load are still to be done."""
    planned = spark.read.parquet(f"{path}-ledger/plan").agg(F.count(F.lit(1))).first()[0]
    return planned - sum(has_parquet(spark, f"{path}-ledger/done/{n}") for n in children(spark, f"{path}-ledger/done"))
