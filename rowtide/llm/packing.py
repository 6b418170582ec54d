"""Best-fit packing by length patterns, fitted with non-negative least squares (operator 10)."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from rowtide.llm.texts import give_back
from rowtide.llm.tokens import default_paths, encoder
from rowtide.session import scratch_path

Pattern = tuple[int, ...]


def pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, paths: tuple[str, str] | None = None, with_ids: bool = True) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32, ids) of all documents; ids are little-endian unsigned 32-bit.

    A document is its token ids and ``end_id``. One of more than ``capacity`` ids is cut into pieces of that length, where
    the first one takes what is over. Null text counts as empty: one piece of one id. Without ``with_ids``, ids is null.
    """
    paths = paths or default_paths()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches):
        encode = encoder(*paths)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for first, ids, counts in encode.column(batch.column(1)):
                ids, rows, at = ids.astype("<u4"), [], 0
                end = np.array([end_id], "<u4")
                for k, n in enumerate(counts.tolist(), first):
                    own = np.concatenate([ids[at : at + n], end])
                    at += n
                    head = len(own) % capacity or capacity
                    cuts = [0, *range(head, len(own) + 1, capacity)]
                    for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        data = own[a:b].tobytes()
                        rows.append((doc_ids[k], p, a, b - a, zlib.crc32(data), data if with_ids else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], schema=pa.schema(list(zip(("doc_id", "piece", "start", "length", "ids_crc32", "ids"), kinds, strict=True))))
        batch = ids = rows = own = data = None  # the worker is used again: it keeps neither the last batch nor the pieces
        encode.forget()
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def few_document_patterns(lengths: Counter, capacity: int, slack: int = 7, common: int = 64) -> list[Pattern]:
    """Pairs that leave at most ``slack`` free, and full triples with two of the ``common`` most frequent lengths."""
    have = sorted(lengths)
    found = {(a, b) for a in have for b in range(max(a, capacity - slack - a), capacity - a + 1) if b in lengths}
    often = [x for x, _ in sorted(lengths.items(), key=lambda x: (-x[1], x[0]))[:common]]
    found |= {tuple(sorted((a, b, capacity - a - b))) for a in often for b in often if lengths.get(capacity - a - b)}
    return sorted(found, key=lambda p: (capacity - sum(p), len(p), p))


def fit(patterns: list[Pattern], lengths: Counter, rounds: int = 30) -> list[float]:
    """Repeat counts x >= 0 that bring the patterns' lengths nearest to the histogram, in least squares.

    Coordinates are solved one after the other, each exactly given the others; the best-filling patterns come first.
    """
    rest = dict.fromkeys(lengths, 0.0) | {k: float(v) for k, v in lengths.items()}
    x = [0.0] * len(patterns)
    terms = [(list(Counter(p).items()), sum(c * c for c in Counter(p).values())) for p in patterns]
    for _ in range(rounds):
        moved = 0.0
        for k, (items, norm) in enumerate(terms):
            step = max(sum(c * rest[n] for n, c in items) / norm, -x[k])
            if step:
                x[k] += step
                moved = max(moved, abs(step))
                for n, c in items:
                    rest[n] -= c * step
        if moved < 0.25:
            break
    return x


def best_fit(lengths: Counter, capacity: int) -> Counter:
    """Patterns for all lengths, longest first, each into the fullest sequence it fits. Works on groups of equal ones."""
    made: Counter = Counter()
    by_room: dict[int, dict[Pattern, int]] = {}
    rooms: list[int] = []

    def put(pattern: Pattern, n: int) -> None:
        room = capacity - sum(pattern)
        if room not in by_room:
            by_room[room] = {}
            insort(rooms, room)
        by_room[room][pattern] = by_room[room].get(pattern, 0) + n

    for length in sorted(lengths, reverse=True):
        left = lengths[length]
        while left:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                each = capacity // length
                if left >= each:
                    put((length,) * each, left // each)
                if left % each:
                    put((length,) * (left % each), 1)
                break
            room = rooms[k]
            pattern, n = next(iter(by_room[room].items()))
            fits = min(room // length, left)
            take = min(n, left // fits)
            if take == n:
                del by_room[room][pattern]
                if not by_room[room]:
                    del by_room[room]
                    rooms.pop(k)
            else:
                by_room[room][pattern] = n - take
            put((*pattern, *(length,) * fits), take)
            left -= take * fits
    for group in by_room.values():
        made.update(group)
    return made


def plan(lengths: Counter, capacity: int) -> Counter:
    """How often each pattern is used, so that every length of the histogram is placed exactly once.

    Full pieces stand alone. Patterns are used as often as the fit says, rounded, within what is left of each length;
    then the rest of the histogram is fitted again, as long as a pattern comes into use. Residuals are packed by best fit.
    """
    full, rest = lengths[capacity], Counter({k: v for k, v in lengths.items() if v and k < capacity})
    used, more = Counter(), True
    while more:
        patterns, more = few_document_patterns(rest, capacity), False
        for x, pattern in sorted(zip(fit(patterns, rest), patterns, strict=True), key=lambda e: (capacity - sum(e[1]), -e[0], e[1])):
            need = Counter(pattern)
            n = min(int(x + 0.5), *(rest[k] // c for k, c in need.items()))
            if n > 0:
                used[pattern], more = used[pattern] + n, True
                for k, c in need.items():
                    rest[k] -= c * n
        rest = +rest
    used.update(best_fit(rest, capacity))
    if full:
        used[(capacity,)] += full
    return used


def pack(pieces: DataFrame, capacity: int = 1024, bins: int | None = None) -> DataFrame:
    """``pieces`` with sequence_id and offset: where each piece lies, gapless from 0, at most ``capacity`` in a sequence.

    The driver gets the histogram of lengths (``capacity`` numbers at most) and plans on it. Each length's pieces are
    ranked, in bins by hash so that a frequent length is many tasks, and the plan says where each range of ranks goes;
    that table is bounded by the histogram, and is broadcast. Bins hold a million pieces or less, as far as these differ in
    doc_id or piece. Every length must be from 1 to ``capacity``. Other columns pass through whatever their names, but
    sequence_id and offset, which are replaced; rows that are equal in all columns are interchangeable; no rows give no rows.
    """
    bins = bins or max(64, pieces.count() >> 20)
    passed = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    keyed = pieces.select(F.struct(*[F.col(f"`{c}`") for c in passed]).alias("row"), "length", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(bins)).cast("int").alias("bin"))
    sums = keyed.groupBy("length", "bin").agg(F.count("*").alias("n"))
    lengths = Counter({r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect()})
    if any(not 1 <= x <= capacity for x in lengths):
        raise ValueError("a piece is empty or longer than a sequence")
    ranges, taken, base = [], Counter(), 0
    for pattern, n in sorted(plan(lengths, capacity).items()):
        offset = 0
        for length in pattern:
            ranges.append((length, taken[length], taken[length] + n, base, offset))
            taken[length] += n
            offset += length
        base += n
    spark = pieces.sparkSession
    table = spark.createDataFrame(ranges, "r_length long, low long, high long, base long, offset long")
    firsts = sums.withColumn("first", F.sum("n").over(Window.partitionBy("length").orderBy("bin")) - F.col("n")).select(F.col("length").alias("f_length"), F.col("bin").alias("f_bin"), "first")
    nth = F.row_number().over(Window.partitionBy("length", "bin").orderBy(F.xxhash64("row.piece", "row.doc_id"), "row.doc_id", "row.piece")) - 1
    ranked = keyed.withColumn("nth", nth).join(F.broadcast(firsts), (F.col("length") == F.col("f_length")) & (F.col("bin") == F.col("f_bin"))).withColumn("rank", F.col("first") + F.col("nth"))
    placed = ranked.join(F.broadcast(table), (F.col("length") == F.col("r_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return placed.select(*[F.col("row").getField(c).alias(c) for c in passed], (F.col("base") + F.col("rank") - F.col("low")).alias("sequence_id"), F.col("offset"))


def packed_documents(docs: DataFrame, capacity: int = 1024, end_id: int = 2, paths: tuple[str, str] | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their place; they are written to the shared folder once, so texts are encoded once."""
    place = scratch_path(docs.sparkSession, "pieces")
    rows = pieces(docs, capacity, end_id, paths, with_ids)
    (rows if with_ids else rows.drop("ids")).write.option("compression", "zstd").parquet(place)
    return pack(docs.sparkSession.read.parquet(place), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, doc_ids in order, and ids of all pieces joined. Needs ``ids``."""
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return rows.select("sequence_id", F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"), joined.alias("ids"))
