"""Change files as a stream: reading, buffering and lag."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from rowtide.operators.changes import CHANGE_SCHEMA
from rowtide.operators.ordered import POSITION

_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"


#: A change file has at most about so many events, which one task sorts.
FILE_ROWS = 1_000_000


def write_change_files(changes: DataFrame, path: str, files: int | None = None) -> None:
    """Lay a change log out as change-capture tools do: JSON lines in files of about equal size, in log order.

    A log too large for ``files`` files of ``FILE_ROWS`` events gets more of them.
    """
    if files:
        files = max(files, -(-changes.count() // FILE_ROWS))
    ranged = changes.repartitionByRange(*([files] if files else []), *POSITION).sortWithinPartitions(*POSITION)
    ranged.write.mode("append").option("timestampNTZFormat", _TIME_FORMAT).json(path)


def read_changes(spark: SparkSession, path: str, files_per_trigger: int | None = None, schema=CHANGE_SCHEMA) -> DataFrame:
    """The change files as a stream; the read files are kept in the query's checkpoint.

    Files may arrive out of log order: appliers compare log places and do not rely on the order of files.
    """
    reader = spark.readStream.schema(schema).option("timestampNTZFormat", _TIME_FORMAT)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def buffered(stream: DataFrame, checkpoint: str, gap: str | None = None) -> DataStreamWriter:
    """A writer that flushes every ``gap`` (or everything there is, once); the position is saved after the write."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=gap) if gap else writer.trigger(availableNow=True)


def buffer_changes(stream: DataFrame, path: str, checkpoint: str, gap: str | None = None) -> StreamingQuery:
    """Append the stream to the change log."""
    return buffered(stream, checkpoint, gap).format("parquet").outputMode("append").start(path)


STATE_STORE_CONF = "spark.sql.streaming.stateStore.providerClass"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> str:
    """Set the state store that keyed state needs, before its query starts. Gives the one set before."""
    before = spark.conf.get(STATE_STORE_CONF)
    spark.conf.set(STATE_STORE_CONF, STATE_STORE)
    return before


def stream_lag(query: StreamingQuery) -> dict[str, int]:
    """X11: what the last trigger read, and what the source still holds if it can tell."""
    progress = query.lastProgress
    if not progress:
        return {"input_rows": 0, "files_behind": 0}
    metrics = [s.get("metrics") or {} for s in progress["sources"]]
    return {
        "input_rows": int(progress["numInputRows"]),
        "files_behind": sum(int(m.get("numFilesOutstanding", 0)) for m in metrics),
    }
