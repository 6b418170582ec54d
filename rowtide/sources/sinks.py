"""Writing: appends, partitioned targets, partition-limited rewrites, exports."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# fixed values: schemas that are never exported
SYSTEM_SCHEMAS = ("information_schema", "performance_schema", "test", "sys", "mysql")
# fixed value: folder name of a partition without a value
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def with_month(df: DataFrame, ts: str, name: str = "yyyymm") -> DataFrame:
    return df.withColumn(name, F.date_format(F.col(ts), "yyyyMM"))


def with_bucket(df: DataFrame, keys: list[str], n: int, name: str = "bucket") -> DataFrame:
    return df.withColumn(name, F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int"))


def even_files(df: DataFrame, *by: str) -> DataFrame:
    """Rows brought together by partition for a write. Adaptive execution cuts a large partition into several tasks
    of the advisory size and puts small ones together, so one full month does not wait for one task."""
    return df.hint("rebalance", *[F.col(c) for c in by])


def write_month_partitioned(df: DataFrame, path: str, ts: str, keys: list[str], mode: str = "overwrite") -> None:
    """One folder per month, rows sorted by key inside each file."""
    monthly = even_files(with_month(df, ts), "yyyymm").sortWithinPartitions("yyyymm", *keys)
    monthly.write.mode(mode).partitionBy("yyyymm").parquet(path)


def write_hash_buckets(df: DataFrame, path: str, keys: list[str], n: int, mode: str = "overwrite") -> None:
    """Rows spread by a hash of the key; a change then touches only the bucket of its key."""
    bucketed = even_files(with_bucket(df, keys, n), "bucket").sortWithinPartitions("bucket", *keys)
    bucketed.write.mode(mode).partitionBy("bucket").parquet(path)


def append(df: DataFrame, path: str) -> None:
    """Add rows to a target."""
    df.write.mode("append").parquet(path)


def append_jdbc(df: DataFrame, url: str, table: str, batch_size: int = 1000, **extra: str) -> None:
    """A13 over JDBC: multi-row inserts of ``batch_size`` rows per task."""
    df.write.format("jdbc").options(url=url, dbtable=table, batchsize=str(batch_size), **extra).mode("append").save()


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def has_parquet(spark: SparkSession, path: str) -> bool:
    """True if there is at least one Parquet file in the folder or one partition below it."""
    if not path_exists(spark, path):
        return False
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(folder, True)
    while files.hasNext():
        if files.next().getPath().getName().endswith(".parquet"):
            return True
    return False


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; nothing if it isn't there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def mark_folder(spark: SparkSession, path: str) -> None:
    """Make a folder if it isn't there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)


def remove_path(spark: SparkSession, path: str) -> None:
    gone = spark._jvm.org.apache.hadoop.fs.Path(path)
    gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)


def _statuses(spark: SparkSession, folder: str) -> list:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return list(fs.listStatus(path)) if fs.exists(path) else []


def _files(spark: SparkSession, folder: str) -> frozenset[str]:
    return frozenset(f.getPath().getName() for f in _statuses(spark, folder))


def partition_files(spark: SparkSession, path: str, part_col: str) -> dict[str, list[str]]:
    """Parquet files of each partition that has a value, as they are now."""
    found = {}
    for folder in children(spark, path):
        name, _, value = folder.partition("=")
        if name == part_col and value != NO_VALUE:
            found[value] = [f"{path}/{folder}/{n}" for n in sorted(_files(spark, f"{path}/{folder}")) if n.endswith(".parquet")]
    return found


def replace_files(rows: DataFrame, path: str, part_col: str, files: list[str]) -> None:
    """Put ``rows`` in the place of certain files of a partitioned target; files that came in meanwhile stay.

    The rows and the list of files are first written aside, under names that readers pass over. What follows is a
    step that can be done again: the old files go, the new ones are moved in.
    """
    spark = rows.sparkSession
    rows.write.mode("overwrite").partitionBy(part_col).parquet(f"{path}/_replacing/rows")
    spark.createDataFrame([(f,) for f in files], "value string").write.mode("overwrite").text(f"{path}/_replacing/files")
    finish_replacing(spark, path)


def finish_replacing(spark: SparkSession, path: str) -> None:
    """Go on with a ``replace_files`` that died: one whose list is whole is brought to its end, another is forgotten."""
    aside = f"{path}/_replacing"
    if not path_exists(spark, aside):
        return
    if path_exists(spark, f"{aside}/files/_SUCCESS"):
        for row in spark.read.text(f"{aside}/files").collect():  # names of files
            remove_path(spark, row["value"])
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
        for folder in children(spark, f"{aside}/rows"):
            if "=" in folder:
                mark_folder(spark, f"{path}/{folder}")
                for name in sorted(_files(spark, f"{aside}/rows/{folder}")):
                    if name.endswith(".parquet") and not fs.rename(hadoop(f"{aside}/rows/{folder}/{name}"), hadoop(f"{path}/{folder}/{name}")):
                        raise RuntimeError(f"can't move {name} into {path}/{folder}")
        for folder in children(spark, path):
            if folder.partition("=")[1] and not any(n.endswith(".parquet") for n in _files(spark, f"{path}/{folder}")):
                remove_path(spark, f"{path}/{folder}")
    remove_path(spark, aside)


def rewrite_partitions(new_rows: DataFrame, path: str, part_col: str, touched: list) -> None:
    """Replace only the ``touched`` partitions of ``path`` by ``new_rows``.

    The dynamic overwrite stages its files and swaps them on commit. A partition that lost its last row gets no
    new files, so its old folder is removed afterwards. ``touched`` holds partition values, never row keys.
    """
    spark = new_rows.sparkSession
    folders = [f"{path}/{part_col}={NO_VALUE if value is None else value}" for value in touched]
    earlier = {folder: _files(spark, folder) for folder in folders}
    new_rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part_col).parquet(path)
    for folder in folders:
        if earlier[folder] and earlier[folder] == _files(spark, folder):
            remove_path(spark, folder)


def full_or_incremental(target: DataFrame, full: DataFrame, incr: DataFrame, incr_col: str | None) -> tuple[str, DataFrame]:
    """An empty target takes everything; else the increment if there is an increment column, else all again."""
    if target.isEmpty():
        return "full", full
    if incr_col:
        return "incremental", incr
    return "truncate", full


def rows_to_move(source: DataFrame, where: str | None, target: DataFrame) -> DataFrame:
    """Rows the chosen mode moves: all for an empty target or no condition, else those under the condition."""
    empty = ~target.select(F.lit(1)).limit(1).exists()
    chosen = F.when(empty | F.lit(not where), F.lit(True)).otherwise(F.expr(where) if where else F.lit(True))
    return source.withColumn("_chosen", chosen).agg(F.count_if("_chosen").alias("rows_to_move"))


def file_set_increment(listing: DataFrame, done: DataFrame, n: int | None, unit: str, as_of: Column, name: str = "object_name") -> DataFrame:
    """Objects whose name carries a time within ``n`` hours or minutes, minus those already present.

    The time is the 14 digits that open the last '_' part of the file name; names without one are left out.
    """
    last = F.element_at(F.split(F.element_at(F.split(F.col(name), "/"), -1), "_"), -1)
    stamp = F.regexp_extract(last, r"^(\d{14})", 1)
    taken = F.try_to_timestamp(stamp, F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")
    picked = listing
    if n is not None and unit in ("hour", "min"):
        age = F.timestamp_diff("SECOND", taken, as_of)
        limit = n * (3600 if unit == "hour" else 60)
        picked = listing.filter(age <= limit)
    return picked.join(done.select(name), name, "left_anti")


def list_objects(spark: SparkSession, path: str) -> DataFrame:
    """Objects under a folder with their size; contents are not read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("object_name"), F.col("length").alias("size"))
    )


def report_rows(df: DataFrame, headers: list[str]) -> DataFrame:
    """Everything as text under the given headers, nulls blank."""
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(h) for c, h in zip(df.columns, headers, strict=True)])


def export_report(df: DataFrame, headers: list[str], path: str) -> DataFrame:
    """Write the report as CSV with a header line, and give back what was written."""
    shown = report_rows(df, headers)
    shown.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)
    return df.sparkSession.read.schema(shown.schema).option("header", True).csv(path).fillna("")


_MANIFEST = "job string, item string, rows bigint, files bigint, bytes bigint, seconds double, status string, message string"


def _export(spark: SparkSession, df: DataFrame, place: str) -> tuple:
    """Write one table: rows, files, bytes, seconds, status and message. What goes wrong is a result like any other."""
    began = time.monotonic()
    try:
        df.write.mode("overwrite").parquet(place)
        sizes = [f.getLen() for f in _statuses(spark, place) if f.getPath().getName().endswith(".parquet")]
        rows = spark.read.schema(df.schema).parquet(place).count()
        return rows, len(sizes), sum(sizes), time.monotonic() - began, "ok" if rows else "empty", None
    except Exception as error:  # noqa: BLE001 - one broken table must not end the others
        return None, 0, 0, time.monotonic() - began, "failed", str(error).strip().split("\n")[0][:500]


def export_with_manifest(spark: SparkSession, tables: dict[str, DataFrame], path: str, job: str, at_once: int = 4) -> DataFrame:
    """Write every table, ``at_once`` of them side by side; rows, files, bytes, seconds and status per table and in total.

    A table that fails has status ``failed`` and its message, and leaves the others as they are; the total has failed then too.
    """
    with ThreadPoolExecutor(at_once) as pool:
        done = list(pool.map(lambda name: _export(spark, tables[name], f"{path}/{name}"), tables))
    items = [(job, name, *row) for name, row in zip(tables, done, strict=True)]
    failed = [name for name, row in zip(tables, done, strict=True) if row[4] == "failed"]
    total = [sum(row[i] or 0 for row in done) for i in range(4)]
    items.append((job, "TOTAL", *total[:3], float(total[3]), "failed" if failed else "ok", ", ".join(failed) or None))
    return spark.createDataFrame(items, _MANIFEST)


def select_databases(listing: DataFrame, wanted: str | None, col: str = "db") -> DataFrame:
    """User schemas only; a comma list means membership, a single word means it occurs in the name."""
    user = listing.filter(~F.col(col).isin(*SYSTEM_SCHEMAS))
    if not wanted:
        return user
    if "," in wanted:
        return user.filter(F.col(col).isin(*[w.strip() for w in wanted.split(",")]))
    return user.filter(F.instr(col, wanted) > 0)
