"""A change log as a stream with places (X1, X2, X8): any start, flushes by rows or seconds, gaps reported.

The log is a folder of Parquet files sorted by place, each with the events of many small log files or of a part of a large one;
folders ``file_no=N`` for single log files are read too. A place (file_no, pos) is a stream offset: all events up to it have been
read; an event without pos comes first in its log file, one without log file has no place and is never read. Row counts
and place bounds come from the files' footers, so the driver reads no events but the places of the few row groups that a
flush starts or ends in; tasks read row groups, one each, so their number follows from the rows and not from the log files.
"""

from __future__ import annotations

import json
import sys
import time
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StreamingQuery

from rowtide.operators.changes import CHANGE_SCHEMA
from rowtide.operators.ordered import POSITION
from rowtide.sources.sinks import has_parquet, path_exists

# the reader travels to the workers as code, so they need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Place = tuple[int, int]
#: Before the first event of any log.
BEGINNING: Place = (-1, -1)
#: Where an event without pos stands in its log file.
NO_POS = -1


class RowGroup(NamedTuple):
    """Events that lie together in one Parquet row group: how many have a place, places that none of them is below or above, and
    whether the last of them is at ``high``."""

    path: str
    group: int
    rows: int
    low: Place
    high: Place
    exact: bool


class RowGroupRange(InputPartition):
    """A row group, and the events of it that are wanted: places above ``after`` up to ``until``."""

    def __init__(self, group: RowGroup, after: Place, until: Place):
        self.group, self.after, self.until = group, after, until


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


class PlaceReader(DataSourceStreamReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.schema = options["path"], schema
        self.start: Place = tuple(json.loads(options["start"]))
        self.at: Place = tuple(json.loads(options["resume"])) if "resume" in options else self.start
        self.max_rows = int(options["max_rows"]) if "max_rows" in options else None
        self.gap = float(options.get("gap_seconds", "0"))
        self.flushed, self.footers, self.checked = time.monotonic(), {}, False

    def initialOffset(self) -> dict:
        return {"file_no": self.start[0], "pos": self.start[1]}

    def _row_groups(self, at: Place, until: Place | None = None) -> list[RowGroup]:
        """Row groups that may hold places above ``at`` up to ``until``. Footers are read once; files never change."""
        store, root = open_store(self.path)
        out: list[RowGroup] = []
        for entry in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            own, number = [entry], None
            if entry.type == fs.FileType.Directory:
                number = _log_file(entry.path)
                if number is None or number < at[0] or (until is not None and number > until[0]):
                    continue
                own = store.get_file_info(fs.FileSelector(entry.path))
            for file in own:
                if file.base_name.startswith(("_", ".")) or not file.base_name.endswith(".parquet"):
                    continue
                if file.path not in self.footers:
                    self.footers[file.path] = self._footer(store, file.path, number)
                out += [g for g in self.footers[file.path] if g.high > at and (until is None or g.low <= until)]
        return sorted(out, key=lambda g: (g.low, g.path, g.group))

    @staticmethod
    def _footer(store: fs.FileSystem, path: str, number: int | None) -> list[RowGroup]:
        with store.open_input_file(path) as file:
            meta, out = pq.ParquetFile(file).metadata, []
        names = meta.schema.names
        for i in range(meta.num_row_groups):
            group = meta.row_group(i)
            if number is None:
                files = group.column(names.index("file_no")).statistics
                rows = group.num_rows - (files.null_count if files is not None else 0)
                least, most = _bounds(files) if rows else (0, 0)
            else:
                rows, least, most = group.num_rows, number, number
            if rows:
                pos = group.column(names.index("pos")).statistics
                low, high = (NO_POS, NO_POS) if pos is not None and pos.null_count == group.num_rows else _bounds(pos)
                out.append(RowGroup(path, i, rows, (least, min(low, NO_POS) if pos.null_count else low), (most, high), least == most and rows == group.num_rows))
        return out

    def _places(self, group: RowGroup) -> np.ndarray:
        """The places of a row group: a row (file_no, pos) each."""
        store, _ = open_store(self.path)
        with store.open_input_file(group.path) as file:
            held = pq.ParquetFile(file)
            columns = [n for n in ("file_no", "pos") if n in held.schema_arrow.names]
            return np.stack([c.to_numpy() for c in _placed(held.read_row_group(group.group, columns=columns), _log_file(group.path))[1:]], axis=1)

    def _above(self, group: RowGroup, at: Place, until: Place | None = None) -> np.ndarray:
        found = self._places(group)
        keep = _behind(found, at)
        return found[keep if until is None else keep & ~_behind(found, until)]

    def _check_gap(self, groups: list[RowGroup]) -> None:
        """The log file a start lies in must still be there: events behind the place could be lost otherwise."""
        file_no = self.at[0]
        if not self.checked and groups:
            if file_no >= 0 and not any(file_no in (g.low[0], g.high[0]) for g in groups):
                begins = []  # the first log file that is there, by the row groups that reach over this one
                for g in groups:
                    files = self._places(g)[:, 0] if g.low[0] < file_no else np.array([g.low[0]])
                    begins.append(int(files[files >= file_no].min()))
                if min(begins) > file_no:
                    raise RuntimeError(f"gap: log file {file_no} of the start {self.at} is gone, the log begins at file {min(begins)}")
            self.checked = True

    def advance(self, at: Place) -> tuple[Place, int]:
        """The place after the next ``max_rows`` events, or after all there are, and how many events that is.

        Events of one place stay together, so a flush may be larger by the events of its last place.
        """
        begun = (at[0], -sys.maxsize)
        groups = self._row_groups(begun)
        self._check_gap(groups)
        groups = [g for g in groups if g.high > at]
        counts = [g.rows if g.low > at else len(self._above(g, at)) for g in groups]
        if self.max_rows is not None and sum(counts) > self.max_rows:
            return self._nth(groups, counts, at, self.max_rows), self.max_rows
        end = at
        for g in sorted(groups, key=lambda g: g.high, reverse=True):
            if g.high > end:
                end = max(end, g.high if g.exact else self._last(g))
        return end, sum(counts)

    def _last(self, group: RowGroup) -> Place:
        found = self._places(group)
        file_no = int(found[:, 0].max())
        return file_no, int(found[found[:, 0] == file_no, 1].max())

    def _nth(self, groups: list[RowGroup], counts: list[int], at: Place, n: int) -> Place:
        """The n-th place above ``at``. It lies between the first low bound up to which row groups with n events begin and the first
        high bound up to which row groups with n events end; only row groups that reach in between are read."""

        def reached(bounds: list[Place]) -> Place:
            total = 0
            for bound, count in sorted(zip(bounds, counts, strict=True)):
                total += count
                if total >= n:
                    return bound
            raise AssertionError("fewer events than the footers say")

        least, most = reached([g.low for g in groups]), reached([g.high for g in groups])
        before = sum(c for g, c in zip(groups, counts, strict=True) if g.high < least)
        held = np.concatenate([self._above(g, at, most) for g in groups if g.high >= least and g.low <= most])
        row = held[np.lexsort((held[:, 1], held[:, 0]))[n - before - 1]]
        return int(row[0]), int(row[1])

    def latestOffset(self) -> dict:
        """The end of the next flush: full, or due because ``gap_seconds`` have passed since the last one; else no flush yet."""
        place, rows = self.advance(self.at)
        full = self.max_rows is not None and rows >= self.max_rows
        if place != self.at and (full or time.monotonic() - self.flushed >= self.gap):
            self.at, self.flushed = place, time.monotonic()
        return {"file_no": self.at[0], "pos": self.at[1]}

    def partitions(self, start: dict, end: dict) -> list[RowGroupRange]:
        after, until = (start["file_no"], start["pos"]), (end["file_no"], end["pos"])
        return [RowGroupRange(g, after, until) for g in self._row_groups(after, until)] if until > after else []

    def read(self, partition: RowGroupRange) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(self.path)
        want, g = to_arrow_schema(self.schema), partition.group
        with store.open_input_file(g.path) as file:
            held = pq.ParquetFile(file)
            there = set(held.schema_arrow.names)
            for batch in held.iter_batches(row_groups=[g.group], columns=[n for n in dict.fromkeys([*want.names, "file_no", "pos"]) if n in there]):
                rows, files, pos = _placed(pa.Table.from_batches([batch]), _log_file(g.path))
                places = np.stack([files.to_numpy(), pos.to_numpy()], axis=1)
                kept = pa.array(_behind(places, partition.after) & ~_behind(places, partition.until))
                rows, files = rows.filter(kept), files.filter(kept)
                columns = [
                    files.cast(f.type) if f.name == "file_no" else rows[f.name].cast(f.type) if f.name in rows.column_names
                    else pa.nulls(rows.num_rows, f.type) for f in want
                ]
                yield from pa.table(columns, schema=want).to_batches()

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


def _bounds(statistics) -> tuple[int, int]:
    if statistics is None or not statistics.has_min_max:
        raise ValueError("a log file has no bounds of its places in its footer")
    return statistics.min, statistics.max


def _log_file(path: str) -> int | None:
    """The log file whose folder a path is or lies in, if it is of one."""
    for name in path.split("/")[-1:-3:-1]:
        kind, _, number = name.partition("=")
        if kind == "file_no" and number.isdigit():
            return int(number)
    return None


def _placed(rows: pa.Table, number: int | None) -> tuple[pa.Table, pa.ChunkedArray, pa.ChunkedArray]:
    """The rows that have a log file, which ``number`` gives if they lie in a folder of one, with their log files and positions."""
    if number is None:
        rows = rows.filter(pc.is_valid(rows["file_no"]))
    files = pa.chunked_array([pa.array(np.full(rows.num_rows, number, np.int64))]) if number is not None else rows["file_no"].cast(pa.int64())
    return rows, files, pc.fill_null(rows["pos"].cast(pa.int64()), NO_POS)


def _behind(places: np.ndarray, at: Place) -> np.ndarray:
    return (places[:, 0] > at[0]) | ((places[:, 0] == at[0]) & (places[:, 1] > at[1]))


class ChangePlaces(DataSource):
    """Format ``change_places``: see :func:`read_places`."""

    @classmethod
    def name(cls) -> str:
        return "change_places"

    def schema(self) -> str:
        return self.options.get("schema", CHANGE_SCHEMA)

    def streamReader(self, schema: T.StructType) -> PlaceReader:
        return PlaceReader(dict(self.options), schema)


def write_log(changes: DataFrame, path: str) -> None:
    """Lay a change log out for :func:`read_places`: rows in log order, in files of about equal size whatever log files they are of."""
    ranged = changes.repartitionByRange(*POSITION).sortWithinPartitions(*POSITION)
    ranged.write.mode("append").parquet(path)


def log_files(spark: SparkSession, path: str) -> DataFrame:
    """(file_no): the log files that are there, from that column alone or the folders' names."""
    if not has_parquet(spark, path):
        return spark.createDataFrame([], "file_no bigint")
    rows = spark.read.schema("file_no bigint").option("recursiveFileLookup", "true").parquet(path)
    folder = F.regexp_extract("_metadata.file_path", r"/file_no=(\d+)/", 1).try_cast("bigint")
    return rows.select(F.coalesce("file_no", folder).alias("file_no")).filter("file_no is not null").distinct().orderBy("file_no")


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    if not path_exists(spark, folder):
        return []
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = [f.getPath().getName() for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)]
    return [int(n) for n in names if n.isdigit()]


def last_place(spark: SparkSession, checkpoint: str, flushed: bool = False) -> Place | None:
    """The place a query with this checkpoint has planned up to, or with ``flushed`` the one it has written up to; none before its first batch."""
    numbers = _numbers(spark, f"{checkpoint}/{'commits' if flushed else 'offsets'}")
    if not numbers:
        return None
    lines = spark.read.text(f"{checkpoint}/offsets/{max(numbers)}", wholetext=True).first()["value"].strip().split("\n")
    place = json.loads(lines[-1])
    return place["file_no"], place["pos"]


def read_places(
    spark: SparkSession, path: str, start: Place = BEGINNING, checkpoint: str | None = None, max_rows: int | None = None, gap_seconds: float = 0,
    schema: str = CHANGE_SCHEMA,
) -> DataFrame:
    """The events behind ``start`` as a stream, in flushes of ``max_rows`` events or what ``gap_seconds`` bring.

    ``checkpoint`` is that of the query to be started: if it has run before, it goes on behind its last place. A start in
    a log file that is gone raises an error that says so; ``resume_position`` (X8) finds a start that is there. The log must grow
    at its end: events that appear behind a place that was read are not seen.
    """
    spark.dataSource.register(ChangePlaces)
    options = {"path": path, "schema": schema, "start": json.dumps(start), "gap_seconds": str(gap_seconds)}
    if max_rows is not None:
        options["max_rows"] = str(max_rows)
    went = last_place(spark, checkpoint) if checkpoint else None
    if went is not None:
        options["resume"] = json.dumps(went)
    return spark.readStream.format("change_places").options(**options).load()


def flush_places(stream: DataFrame, out: str, checkpoint: str, every: str = "0 seconds") -> StreamingQuery:
    """Each flush in a folder of its own, ``batch=N``, which a flush that runs again replaces; the place is saved after the write.

    ``every`` is how often the log is looked at; what makes a flush is up to :func:`read_places`.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=every).foreachBatch(put).start()
