"""De-duplication of a change stream on places kept as state."""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from rowtide.operators.ordered import POSITION
from rowtide.streaming.changes import STATE_STORE_CONF, buffered, use_rocksdb

# the processor travels to the workers as code, so they need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Places are kept together in blocks of this many bytes of this many log files that follow each other, so that small log files
#: don't make a block each; a block is what one batch reads of them.
BLOCK_BITS, FILE_BITS = 16, 5


def pack(places: np.ndarray) -> bytes:
    """Sorted places, a row each, as differences, which are small and compress well."""
    return zlib.compress(np.diff(places, axis=0, prepend=np.zeros((1, places.shape[1]), np.int64)).astype("<i8").T.tobytes(), 1)


def unpack(data: bytes, width: int = 2) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), "<i8").reshape(width, -1).T, axis=0)


def unseen(known: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``places`` come for the first time, and all places seen now, sorted."""
    every, first, back = np.unique(np.concatenate([known, places]), axis=0, return_index=True, return_inverse=True)
    new = np.flatnonzero(first >= len(known))
    fresh = np.zeros(len(places), bool)
    fresh[first[new] - len(known)] = True
    return fresh, every


class SeenPlaces(StatefulProcessor):
    """Keeps the places seen in one block of the log; gives the events whose place is new."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("seen", "places binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = unpack(self.state.get()[0], len(POSITION)) if self.state.exists() else np.zeros((0, len(POSITION)), np.int64)
        before = len(known)
        for events in rows:
            events = events[self.columns]
            if key[2]:  # else they have no place and can't be told from others: all stay
                fresh, known = unseen(known, events[POSITION].to_numpy(dtype=np.int64))
                events = events[fresh]
            if len(events):
                yield events
        if len(known) > before:
            self.state.update((pack(known),))

    def close(self) -> None:
        pass


def without_repeats(stream: DataFrame) -> DataFrame:
    """The events of a stream whose place comes for the first time. Needs the RocksDB state store."""
    lacking = reduce(or_, [F.col(c).isNull() for c in POSITION])
    # whole numbers that may be null travel as text, since pandas would make them inexact
    longs = [f.name for f in stream.schema.fields if f.dataType.typeName() == "long" and f.name not in POSITION]
    placed = stream.withColumns({c: F.col(c).cast("string") for c in longs})
    # events without a place need no state in common: they are spread by what they hold
    cut = {"_files": F.shiftright("file_no", FILE_BITS), "_block": F.shiftright("pos", BLOCK_BITS)}
    cut = {name: F.when(lacking, F.pmod(F.xxhash64(*stream.columns), F.lit(64))).otherwise(part).cast("bigint") for name, part in cut.items()}
    keyed = placed.withColumns({**cut, "_placed": ~lacking})
    seen = keyed.groupBy("_files", "_block", "_placed").transformWithStateInPandas(
        statefulProcessor=SeenPlaces(stream.columns), outputStructType=placed.schema, outputMode="Append", timeMode="None"
    )
    return seen.withColumns({c: F.col(c).cast("bigint") for c in longs})


def dedupe_stream(stream: DataFrame, path: str, checkpoint: str, gap: str | None = None) -> StreamingQuery:
    """The change log at ``path`` with each log place once, however late or often an event is delivered.

    The places seen are state, a compressed set for each block of the log. A batch reads the sets of the blocks its
    events lie in and never the log; no event is forgotten after a time, so none is dropped for being late. Each
    micro-batch writes a folder of its own, ``batch=N``, so one that runs again replaces what it wrote before.
    """

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    spark = stream.sparkSession
    before = use_rocksdb(spark)
    try:
        return buffered(without_repeats(stream), checkpoint, gap).outputMode("append").foreachBatch(add).start()
    finally:
        spark.conf.set(STATE_STORE_CONF, before)
