"""Reading tables and describing what a source holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rowtide.operators.ordered import even_chunks
from rowtide.session import sql_over
from rowtide.sources.splits import bucket_of, sketch_marks
from rowtide.specs import CdcSpec, TableCatalog

# fixed values: preferred time columns, best first
TIME_COLUMN_ORDER = ("create_time", "create_dt", "update_time", "update_dt")


def catalog_of(directory: str, tables: list[str], keys: dict[str, tuple[str, ...]] | None = None, schema: str = "app") -> TableCatalog:
    """A source of one Parquet file or folder per table."""
    return TableCatalog({t: f"{directory}/{t}.parquet" for t in tables}, keys or {}, schema)


def scan_table(spark: SparkSession, source: TableCatalog, table: str, cols: list[str] | None = None) -> DataFrame:
    """A1: one table, only the wanted columns."""
    df = spark.read.parquet(source.paths[table])
    return df.select(*cols) if cols else df


def jdbc_options(url: str, table: str | None = None, query: str | None = None, fetch_size: int = 10000, **extra: str) -> dict[str, str]:
    """Options of a JDBC read; exactly one of ``table`` and ``query``."""
    if (table is None) == (query is None):
        raise ValueError("give either a table or a query")
    options = {"url": url, "fetchsize": str(fetch_size), **extra}
    options["dbtable" if table else "query"] = table or query
    return options


def scan_jdbc(
    spark: SparkSession, url: str, table: str, predicates: list[str] | None = None, fetch_size: int = 10000, **extra: str
) -> DataFrame:
    """A1 over JDBC: one task per predicate, as cut by A7, A8 or A9."""
    if predicates:
        return spark.read.jdbc(url, table, predicates=predicates, properties={"fetchsize": str(fetch_size), **extra})
    return spark.read.format("jdbc").options(**jdbc_options(url, table, fetch_size=fetch_size, **extra)).load()


def query_jdbc(spark: SparkSession, url: str, query: str, **extra: str) -> DataFrame:
    """A2 over JDBC: the source runs the query."""
    return spark.read.format("jdbc").options(**jdbc_options(url, query=query, **extra)).load()


def scan_query(spark: SparkSession, source: TableCatalog, sql: str, blank_nulls: bool = False) -> DataFrame:
    """A2: any SELECT over the tables of a source; ``blank_nulls`` shows everything as text with '' for null."""
    df = sql_over(spark, sql, {table: spark.read.parquet(path) for table, path in source.paths.items()})
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns]) if blank_nulls else df


def list_tables(spark: SparkSession, source: TableCatalog) -> DataFrame:
    """A3: table names, lower-cased."""
    return spark.createDataFrame([(t.lower(),) for t in sorted(source.paths)], "table_name string")


def list_columns(spark: SparkSession, source: TableCatalog, table: str) -> DataFrame:
    """A3: columns of a table with type and position, names lower-cased."""
    fields = spark.read.parquet(source.paths[table]).schema.fields
    rows = [(table.lower(), f.name.lower(), f.dataType.simpleString(), i + 1) for i, f in enumerate(fields)]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, ordinal int")


def incremental_candidates(schema: T.StructType) -> list[str]:
    """A4: columns that can serve as increment column."""
    kinds = (T.TimestampType, T.TimestampNTZType, T.DateType)
    return [f.name for f in schema.fields if isinstance(f.dataType, kinds)]


def candidate_bounds(df: DataFrame) -> DataFrame:
    """A4: the increment columns of a table with the range each covers, from one pass."""
    names = incremental_candidates(df.schema)
    wide = df.agg(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi"), F.count(c).alias("n")).alias(c) for c in names])
    entries = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("b")) for c in names]
    return wide.select(F.explode(F.array(*entries)).alias("e")).select(
        "e.column_name", F.col("e.b.lo").alias("min_value"), F.col("e.b.hi").alias("max_value"), F.col("e.b.n").alias("non_null")
    )


def resolve_tables(patterns: str, source: TableCatalog) -> list[CdcSpec]:
    """A5: expand ``schema.tab*.col$dest`` entries; '*' means the rest occurs in the name; keyless tables drop out."""
    found = []
    for text in filter(None, (p.strip() for p in patterns.split(","))):
        spec = CdcSpec.parse(text)
        if spec.schema != source.schema:
            continue
        part = spec.table.replace("*", "")
        for table in sorted(source.paths):
            hit = part in table if "*" in spec.table else part == table
            if hit and source.keys.get(table):
                found.append(CdcSpec(spec.schema, table, spec.part_col, spec.dest_schema))
    return found


def project_synced(df: DataFrame, allow: str | None) -> DataFrame:
    """The columns of an allow-list ``a#b#c`` in the table's own order, whatever the case; no list means all."""
    if not allow:
        return df
    wanted = {c.strip().lower() for c in allow.split("#")}
    return df.select(*[c for c in df.columns if c.lower() in wanted])


def choose_time_column(schema: T.StructType, indexed: set[str] = frozenset()) -> str | None:
    """The time column to partition by: a preferred name first, else any that cannot be null; failing
    those, the ``indexed`` date or time columns in the same order of preference, null or not."""
    fixed = [f.name for f in schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)) and not f.nullable]
    keyed = [c for c in incremental_candidates(schema) if c in indexed]

    def rank(name: str) -> int:
        return TIME_COLUMN_ORDER.index(name.lower()) if name.lower() in TIME_COLUMN_ORDER else len(TIME_COLUMN_ORDER)

    return min(fixed or keyed, key=rank, default=None)


def page(df: DataFrame, order: list[str], offset: int, n: int) -> DataFrame:
    """One page in a total order, nulls first.

    Where the page lies is found by counting: a sketch cuts the first column into buckets, whose rows are counted, and only
    those the page touches are sorted. If that is one value alone, the next column is cut. A first column that is neither
    number nor time is cut by a sort by ranges. So no task keeps the rows before the page.
    """
    rows = df
    for i, column in enumerate(order):
        if not isinstance(df.schema[column].dataType, (T.NumericType, T.TimestampType, T.TimestampNTZType, T.DateType)):
            rows = even_chunks(rows, order[i:], [], "_bucket")
            bucket = F.col("_bucket")
        else:
            bucket = F.coalesce(bucket_of(column, sketch_marks(rows, column, 64, 1000)), F.lit(-1))
        stats = rows.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(column).alias("filled"))
        before, chosen = 0, []
        for s in sorted(stats.collect(), key=lambda r: r["b"]):  # one row per bucket
            if not chosen and before + s["n"] <= offset:
                before += s["n"]
            elif not chosen or sum(c["n"] for c in chosen) < offset - before + n:
                chosen.append(s)
        offset -= before
        if not chosen:
            return df.limit(0)
        rows = rows.filter(bucket.isin(*[c["b"] for c in chosen]))
        one = len(chosen) == 1 and chosen[0]["lo"] == chosen[0]["hi"] and chosen[0]["filled"] in (0, chosen[0]["n"])
        if not one or "_bucket" in rows.columns:
            break
    return rows.select(*df.columns).orderBy(*order).offset(offset).limit(n)
