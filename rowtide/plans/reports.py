"""Parameterised reports."""

from __future__ import annotations

from datetime import date, datetime, time

from pyspark.sql import DataFrame, SparkSession

from rowtide.operators.reconcile import run_log
from rowtide.session import sql_over
from rowtide.sources.sinks import report_rows
from rowtide.specs import ReportSpec


def run_report(spark: SparkSession, spec: ReportSpec, begin: date, end: date, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """Prepare views in order, then the query; ``:begin`` and ``:end`` (last second of the end day) are bound.

    ``tables`` are read under their names. The session's own views are as they were afterwards.
    """
    args = {"begin": datetime.combine(begin, time(0, 0, 0)).isoformat(sep=" "), "end": datetime.combine(end, time(23, 59, 59)).isoformat(sep=" ")}

    views = dict(tables or {})

    def bound(sql: str) -> DataFrame:
        return sql_over(spark, sql, views, {k: v for k, v in args.items() if f":{k}" in sql})

    for name, sql in spec.preprocess:
        views[name] = bound(sql)
    result = bound(spec.query)
    return report_rows(result, list(spec.headers)) if spec.headers else result


def report_log(previous: DataFrame, new: DataFrame) -> DataFrame:
    """Run records of reports, the latest per tag."""
    return run_log(previous, new, ["tag"], ["started_at"])
