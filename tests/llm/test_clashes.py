"""Operators and stages on tables with columns of any names and types beside their own."""

from pyspark.sql import functions as F

from rowtide.llm import mixing, packing, pivot_dedup, quality, suffix_index
from rowtide.llm.columns import words

NAMES = ["_of", "_fp", "_component", "_least", "fp", "least", "no_id", "component", "nth", "row", "bin", "rank", "low", "base", "first", "size", "h", "pattern", "copies", "doc", "batch", "rest"]


def odd(spark, rows):
    """Documents with a column for each inner name, and a map."""
    made = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return made.select("*", *[F.lit(f"given {c}").alias(c) for c in NAMES], F.create_map(F.lit("k"), F.col("doc_id")).alias("meta")).repartition(3)


ROWS = [(1, "one two three four five six"), (2, "ONE two three four five six"), (3, "another text of some other words"), (3, "another text of some other words"), (None, None), (4, "one two three four five six")]


def check(df, columns):
    rows = df.collect()
    assert rows and df.columns == columns
    assert all(r[c] == f"given {c}" for r in rows for c in NAMES) and all(r["meta"] == {"k": r["doc_id"]} for r in rows)
    return rows


def test_near_duplicates(spark):
    docs = odd(spark, ROWS)
    assert sorted(r["doc_id"] for r in check(pivot_dedup.keep_first(docs, spare_no_id=False).filter("doc_id is not null"), docs.columns)) == [1, 3]
    assert pivot_dedup.near_duplicates(docs).count() == len(ROWS)


def test_mixing(spark):
    docs = odd(spark, ROWS)
    check(mixing.repeat_rows(docs.filter("text is not null"), F.array("source"), F.size(words(F.col("text")))), docs.columns)


def test_repeated_passages(spark):
    docs = odd(spark, [(1, "x" * 80), (2, "y" + "x" * 60)])
    assert sorted((r["doc_id"], len(r["text"])) for r in check(suffix_index.drop_repeats(docs), docs.columns)) == [(1, 80), (2, 1)]


def test_quality(spark):
    docs = odd(spark, [(1, "the cat and the dog of the house " * 2 + " ".join(f"w{i}" for i in range(60))), (2, "no")])
    assert [r["doc_id"] for r in check(quality.keep_good(docs), docs.columns)] == [1]


def test_packing(spark):
    given = ["offset", "low", "base", "first", "r_length", "sequence_id", "row", "bin", "nth", "rank"]
    pieces = spark.range(20).selectExpr("id as doc_id", "0 as piece", "id % 7 + 1 as length", "map('k', id) as meta", *[f"'given {c}' as {c}" for c in given])
    packed = packing.pack(pieces, 8)
    assert packed.columns == ["doc_id", "piece", "length", "meta", *[c for c in given if c not in ("offset", "sequence_id")], "sequence_id", "offset"]
    rows = packed.collect()
    assert len(rows) == 20 and all(r[c] == f"given {c}" for r in rows for c in given if c not in ("offset", "sequence_id"))
    used = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used.get(r["sequence_id"], 0)
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(used.values()) <= 8 and set(used) == set(range(len(used)))
