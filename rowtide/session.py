"""Session settings, the shared scratch folder and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "rowtide", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; sizes come from the cluster's own defaults."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, or a temp folder in local mode only."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not _is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="rowtide-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path under the shared folder."""
    return f"{shared_dir(spark)}/rowtide/{name}-{uuid.uuid4().hex}"


def sql_over(spark: SparkSession, sql: str, views: dict[str, DataFrame], args: dict | None = None) -> DataFrame:
    """The rows of ``sql`` over named tables. The names hold while the text is read; views of the session stay as they were."""
    before = {name: spark.table(name) for name in views if spark.catalog.tableExists(name)}
    try:
        for name, df in views.items():
            df.createOrReplaceTempView(name)
        return spark.sql(sql, args=args) if args else spark.sql(sql)
    finally:
        for name in views:
            if name in before:
                before[name].createOrReplaceTempView(name)
            else:
                spark.catalog.dropTempView(name)


def stable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` so that values depending on physical partitions survive lost executors."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)
