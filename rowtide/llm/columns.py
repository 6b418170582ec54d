"""Expressions shared by the operators that use Spark's own functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: One or more separators, and one character that isn't one.
SPACES, WORD_CHAR = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"


def words(text: Column) -> Column:
    """Words of a text as an array; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))


def whole_row(df: DataFrame, seed: int) -> Column:
    """A 64-bit hash of all columns; the same row has the same hash wherever it is read. Maps count by their entries."""
    parts = [F.map_entries(F.col(f"`{f.name}`")) if f.dataType.typeName() == "map" else F.col(f"`{f.name}`") for f in df.schema.fields]
    return F.xxhash64(F.lit(seed), *parts)
