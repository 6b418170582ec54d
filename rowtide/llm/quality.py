"""Quality rules as one Spark projection (operator 3): no user functions, no shuffle."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from rowtide.llm.columns import WORD_CHAR, words


class Rule(NamedTuple):
    """A ratio and the range it must stay in; None leaves a side open."""

    ratio: str
    least: float | None
    most: float | None


#: Frequent words of English, German, French and Spanish.
STOP_WORDS = (
    "the and of to in is that for on with was as at by be are this from or it an a "
    "der die das und ist in zu den von mit für auf ein eine nicht im dem des auch "
    "le la les de du des et un une en dans que qui pour par sur est au avec pas "
    "el los las del que y en un una por con para es se al lo no su"
).split()

SYMBOLS = "#*$%&|<>"

#: Length, symbol, stop-word and line ratios. A document fails if any ratio leaves its range.
RULES = (
    Rule("mean_word_chars", 2.0, 15.0),
    Rule("symbols_per_word", None, 0.25),
    Rule("stop_word_share", 0.02, None),
    Rule("dup_line_share", None, 0.5),
)

BASE_LEAST_WORDS, BASE_MOST_REPEATED = 50, 50

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _ratios(m: Column) -> dict[str, Column]:
    per_word = F.greatest(m["n_words"], F.lit(1))
    return {
        "mean_word_chars": m["word_chars"] / per_word,
        "symbols_per_word": m["n_symbols"] / per_word,
        "stop_word_share": m["n_stop_words"] / per_word,
        "dup_line_share": m["n_dup_lines"] / F.greatest(m["n_lines"], F.lit(1)),
    }


def compile_rules(rules: tuple[Rule, ...], m: Column) -> Column:
    """The table of thresholds as one boolean expression; true for a document that passes all."""
    ratios, passed = _ratios(m), F.lit(True)
    for rule in rules:
        if rule.least is not None:
            passed = passed & (ratios[rule.ratio] >= rule.least)
        if rule.most is not None:
            passed = passed & (ratios[rule.ratio] <= rule.most)
    return passed


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """Two columns: doc, a struct of all columns as given, and quality, a struct of measures, base_failed and kept.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word that equal an earlier line),
    n_repeat_words (words inside a run of three words that occurs twice or more), n_stop_words, n_lines (with a word).
    A null text counts as empty: no words, base_failed. Names of the given columns can't clash with the measures, as
    each has its own struct. Repeated rows are judged alike; an empty table gives no rows.
    """
    source = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), source.alias("text"), words(F.col(f"`{text}`")).alias("words"))
    n = F.size("words")
    triple = lambda i: F.struct(F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("i"))
    triples = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), triple))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD_CHAR))
    rows = rows.select(
        "doc",
        n.cast("long").alias("n_words"),
        F.length(F.concat_ws("", "words")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(*stop_words))).cast("long").alias("n_stop_words"),
        F.sort_array(triples).alias("sorted"),
        lines.alias("lines"),
    )
    # Equal triples are neighbours once sorted; each covers three words, and a word counts once.
    again = F.filter("sorted", lambda x, k: F.coalesce(x["h"] == F.get("sorted", k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("sorted", k + 1)["h"], F.lit(False)))
    covered = F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    measured = rows.select(
        "doc",
        F.struct(
            "n_words", "word_chars", "n_symbols", "n_stop_words",
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            F.size("lines").cast("long").alias("n_lines"),
            F.coalesce(F.size(covered), F.lit(0)).cast("long").alias("n_repeat_words"),
        ).alias("m"),
    )
    m = F.col("m")
    measured = measured.withColumn("m", F.when(m["n_words"] < 3, m.withField("n_repeat_words", F.lit(0).cast("long"))).otherwise(m))
    failed = (m["n_words"] < BASE_LEAST_WORDS) | (100 * m["n_repeat_words"] > BASE_MOST_REPEATED * m["n_words"])
    verdict = F.struct("m.*", failed.alias("base_failed"), (~failed & compile_rules(rules, m)).alias("kept"))
    # A filter on the verdict would be pushed below the projections, with all of them written out inside it: once for each use,
    # and per element inside the array functions. It stops at a generator, here one of exactly one row.
    return measured.select("doc", F.explode(F.array(verdict)).alias("quality"))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows that pass; columns as given."""
    rows = judge(docs, text).where("quality.kept")
    return rows.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
