"""Slow statement logs (Q1-Q8)."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rowtide.functions.timing import moment
from rowtide.operators.aggregates import command_summary, group_as_distinct
from rowtide.operators.filters import between_days
from rowtide.operators.joins import not_whitelisted

BLOCK_MARK = "# Time:"
DUMP_MARK = "$VAR1 ="


def read_records(spark: SparkSession, path: str, mark: str) -> DataFrame:
    """Records of text files cut at a mark; the reader splits files between tasks at the mark itself."""
    return spark.read.option("lineSep", mark).text(path).filter(F.col("value").rlike(r"\S"))


def once(df: DataFrame, *cols: Column) -> DataFrame:
    """Work out costly columns once per row. As output of a generator they are not copied into later filters and
    selections, as the optimiser would do with a plain select."""
    return df.select(F.explode(F.array(F.struct(*cols))).alias("_row")).select("_row.*")


def squeeze(text: Column) -> Column:
    """Runs of blanks as one, line ends dropped."""
    return F.regexp_replace(F.regexp_replace(text, r"\r?\n", ""), " +", " ")


def _found(pattern: str, group: int = 1, col: str = "value") -> Column:
    return F.nullif(F.regexp_extract(col, pattern, group), F.lit(""))


def parse_slow_blocks(records: DataFrame, inst_id: int | None = None, db_id: int | None = None) -> DataFrame:
    """Q1: fields of '# Time:' records. Records without a time, the numbers or a statement get ``ok`` false."""
    stmt = squeeze(F.regexp_extract("value", r"(?s)\n\s*use\s+[^;\n]+;[ \t]*\r?\n(.*)$", 1))
    parsed = once(
        records,
        F.try_to_timestamp(_found(r"^\s*(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d)"), F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz").alias("finish_time"),
        _found(r"# User@Host:\s*([^\[\s@]*)\s*\[").alias("user"),
        _found(r"# User@Host:[^@\n]*@\s*([^\s\[:]*)").alias("host"),
        _found(r"Query_time:\s*([\d.]+)").try_cast("double").alias("query_time"),
        _found(r"Lock_time:\s*([\d.]+)").try_cast("double").alias("lock_time"),
        _found(r"Rows_sent:\s*(\d+)").try_cast("bigint").alias("rows_sent"),
        _found(r"Rows_examined:\s*(\d+)").try_cast("bigint").alias("rows_examined"),
        _found(r"\n\s*use\s+([^;\n]+);").alias("db"),
        stmt.alias("sql_text"),
        F.col("value").alias("raw"),
    )
    whole = F.col("finish_time").isNotNull() & F.col("query_time").isNotNull() & (F.trim("sql_text") != "")
    return (
        parsed.withColumn("bytes", F.octet_length("sql_text").cast("bigint"))
        .withColumn("sql_id", F.md5("sql_text"))
        .withColumn("inst_id", F.lit(inst_id).cast("int"))
        .withColumn("db_id", F.lit(db_id).cast("int"))
        .withColumn("ok", whole)
    )


def accepted(parsed: DataFrame, after: datetime | None = None) -> DataFrame:
    """Whole records, later than the last one stored if given."""
    good = parsed.filter("ok").drop("ok", "raw")
    return good.filter(F.col("finish_time") > moment(after)) if after else good


def rejected(parsed: DataFrame) -> DataFrame:
    """Records that could not be read, as they came."""
    return parsed.filter("not ok").select("raw")


# one key => value pair, the value without its quotes; quoted values are taken whole, so that text inside them is
# never read as a pair. The repetitions do not give back what they took, which keeps long values off the matcher's stack
_PAIR = r"(?s)\b(\w++)\s*+=>\s*+'?+((?<=')[^'\\]*+(?:\\.[^'\\]*+)*+|[^,\s}']++)"


def _dump_value(name: str) -> Column:
    """The value of a key. ``_values`` opens with a null, where the place of a missing key points."""
    return F.element_at("_values", (F.array_position("_names", name) + 1).cast("int"))


def _dump_text(name: str) -> Column:
    return F.regexp_replace(squeeze(_dump_value(name)), r"\\", "")


def parse_digest_dump(records: DataFrame, inst_id: int | None = None, db_id: int | None = None) -> DataFrame:
    """Q2: key => value records with statement and fingerprint; equal fingerprints share ``templete_id``."""
    pairs = once(
        records, F.col("value"), F.regexp_extract_all("value", F.lit(_PAIR), 1).alias("_names"),
        F.concat(F.array(F.lit(None).cast("string")), F.regexp_extract_all("value", F.lit(_PAIR), 2)).alias("_values"),
    )
    parsed = once(
        pairs,
        F.try_to_timestamp(F.concat(F.lit("20"), _dump_value("ts")), F.lit("yyyyMMdd HH:mm:ss")).cast("timestamp_ntz").alias("finish_time"),
        *[F.nullif(_dump_value(n), F.lit("")).alias(n) for n in ("user", "host", "ip", "db", "cmd")],
        _dump_value("Query_time").try_cast("double").alias("query_time"),
        _dump_value("Lock_time").try_cast("double").alias("lock_time"),
        _dump_value("Rows_sent").try_cast("bigint").alias("rows_sent"),
        _dump_value("Rows_examined").try_cast("bigint").alias("rows_examined"),
        _dump_value("Thread_id").try_cast("bigint").alias("thread_id"),
        _dump_value("bytes").try_cast("bigint").alias("bytes"),
        _dump_value("pos_in_log").try_cast("bigint").alias("pos_in_log"),
        _dump_text("arg").alias("sql_text"),
        _dump_text("fingerprint").alias("finger"),
        F.col("value").alias("raw"),
    )
    whole = F.col("finish_time").isNotNull() & F.col("query_time").isNotNull() & F.col("sql_text").isNotNull()
    return (
        parsed.withColumn("sql_id", F.md5("sql_text"))
        .withColumn("templete_id", F.md5("finger"))
        .withColumn("inst_id", F.lit(inst_id).cast("int"))
        .withColumn("db_id", F.lit(db_id).cast("int"))
        .withColumn("ok", F.coalesce(whole, F.lit(False)))
    )


def fingerprint(sql: Column) -> Column:
    """Q3: the shape of a statement: literals as '?', value lists as one, blanks and case evened out."""
    text = F.lower(F.trim(F.regexp_replace(sql, r"\s+", " ")))
    # fixed values: patterns of what is folded, in the order they apply
    for pattern, put in (
        (r"(?s)'[^'\\]*+(?:(?:\\.|'')[^'\\]*+)*+'", "?"),
        (r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"', "?"),
        (r"\b[0-9]+(?:\.[0-9]+)?\b", "?"),
        (r"\bin ?\( ?\?(?: ?, ?\?)*+ ?\)", "in(?+)"),
        (r"\bvalues ?\([^)]*+\)(?: ?, ?\([^)]*+\))*+", "values(?+)"),
    ):
        text = F.regexp_replace(text, pattern, put)
    return text


def slow_summary(slow: DataFrame, by: list[str]) -> DataFrame:
    """Q4: how often and how long, per template, database or user."""
    return slow.groupBy(*by).agg(
        F.count(F.lit(1)).alias("times"),
        F.round(F.sum("query_time"), 2).alias("sum_time"),
        F.round(F.avg("query_time"), 2).alias("avg_time"),
        F.max("query_time").alias("max_time"),
        F.sum("rows_examined").alias("rows_examined"),
        F.sum("rows_sent").alias("rows_sent"),
    )


def upsert_statement(stored: DataFrame, new: DataFrame, key: str = "sql_id") -> DataFrame:
    """Q5: new statements replace stored ones of the same id."""
    return stored.join(new.select(key).distinct(), key, "left_anti").select(*stored.columns).unionByName(new.select(*stored.columns))


def _recent_commands(log: DataFrame, whitelist: DataFrame, as_of: datetime, minutes: int) -> DataFrame:
    first = as_of - timedelta(minutes=minutes)
    return not_whitelisted(log.filter((F.col("start_time") >= moment(first)) & (F.col("start_time") <= moment(as_of))), whitelist)


def command_slowlog(log: DataFrame, whitelist: DataFrame, as_of: datetime, minutes: int = 10) -> DataFrame:
    """Q6: slow commands of the last minutes that are not whitelisted, once each with the time last recorded.

    Numbering the lines of a listing is ``number_rows`` over this result.
    """
    recent = _recent_commands(log, whitelist, as_of, minutes)
    return group_as_distinct(recent, ["dbid", "start_time", "duration", "command"], "create_time")


def command_slowlog_summary(log: DataFrame, whitelist: DataFrame, as_of: datetime, minutes: int = 10) -> DataFrame:
    """Q6: the same commands per database, batch and command: average duration, first and last start."""
    return command_summary(_recent_commands(log, whitelist, as_of, minutes), ["dbid", "batch_id", "command"], "duration", "start_time")


def active_sessions(sessions: DataFrame, as_of: datetime, secs: int, started: str = "last_batch") -> DataFrame:
    """Q7: sessions running longer than ``secs`` with start, end and seconds."""
    took = F.timestamp_diff("SECOND", F.col(started), moment(as_of))
    return (
        sessions.withColumn("query_time", took)
        .filter(F.col("query_time") > secs)
        .withColumn("end_time", F.timestamp_add("SECOND", F.col("query_time").cast("int"), F.col(started)))
    )


def day_slice(stats: DataFrame, ts: str, day: date) -> DataFrame:
    """Q8: statistics whose interval began on a day."""
    return between_days(stats, ts, day, day)
