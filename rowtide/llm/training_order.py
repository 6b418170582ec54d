"""Token sequences in training order (operator 9): a keyed Feistel permutation gives every sequence its global slot."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from rowtide.llm.texts import column_bytes, give_back, mix64
from rowtide.llm.tokens import default_paths, encoder
from rowtide.session import scratch_path


def feistel(values: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """A keyed permutation of 0 ... n - 1, applied to ``values``.

    It permutes the smallest domain of an even number of bits that holds n, which is less than 4 n; a value that lands
    outside walks on along its cycle until it is inside again.
    """
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = mix64(np.arange(1, rounds + 1, dtype=np.uint64) + np.uint64(key & ((1 << 64) - 1)))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            left, right = right, left ^ (mix64(right + k) & mask)
        return (left << np.uint64(half)) | right

    out = values.astype(np.uint64)
    open_ = np.arange(len(out))
    while len(open_):
        out[open_] = once(out[open_])
        open_ = open_[out[open_] >= np.uint64(n)]
    return out.astype(np.int64)


def _sequences(length: int, end_id: int, paths: tuple[str, str]):
    """For ``mapInArrow``: documents (doc_id, text) as (part, nth, doc_id, piece, n_tokens, ids), where ids end with the document."""

    def run(batches):
        encode, part, nth = encoder(*paths), TaskContext.get().partitionId(), 0
        for batch in batches:
            doc_ids = batch.column(0)
            for first, ids, counts in encode.column(batch.column(1)):
                if len(ids) and ids.max() >= 1 << 16:
                    raise ValueError("the vocabulary doesn't fit 16 bits")
                sizes = counts + 1
                ends = np.cumsum(sizes)
                own, of_text = np.full(int(sizes.sum()), end_id, "<u2"), np.ones(int(sizes.sum()), bool)
                of_text[ends - 1] = False
                own[of_text] = ids
                rows = -(-sizes // length)
                doc = np.repeat(np.arange(len(sizes)), rows)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(rows) - rows, rows)
                n_tokens = np.minimum(sizes[doc] - piece * length, length)
                columns = [
                    pa.array(np.full(len(doc), part, np.int32)), pa.array(np.arange(nth, nth + len(doc))), doc_ids.take(pa.array(first + doc)),
                    pa.array(piece.astype(np.int32)), pa.array(n_tokens.astype(np.int32)), _binary(2 * n_tokens, own.view(np.uint8)),
                ]
                nth += len(doc)
                yield pa.RecordBatch.from_arrays(columns, names=["part", "nth", "doc_id", "piece", "n_tokens", "ids"])
        batch = doc_ids = ids = own = of_text = columns = None  # the worker is used again: it keeps neither the last batch nor the pieces
        encode.forget()
        give_back()

    return run


def _binary(sizes: np.ndarray, data: np.ndarray) -> pa.Array:
    """Values of ``sizes`` bytes that lie in ``data`` one after the other."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def token_sequences(docs: DataFrame, length: int = 512, end_id: int = 2, paths: tuple[str, str] | None = None) -> DataFrame:
    """(part, nth, doc_id, piece, n_tokens, ids): documents as runs of ``length`` ids, the last one filled up with ``end_id``.

    A document is its ids and one ``end_id``. ids are little-endian unsigned 16-bit, so every row has the same stride.
    part and nth number the rows within a task; they hold once the rows are written. Null text counts as empty.
    """
    made = _slim(docs).mapInArrow(_sequences(length, end_id, paths or default_paths()), "part int, nth long, doc_id long, piece int, n_tokens int, ids binary")
    return made.withColumn("ids", _filled_up(F.col("ids"), F.lit(2 * length)))


def _code(data: np.ndarray) -> np.ndarray:
    """Bytes of 16-bit ids, coded so that they compress well: ids are numbered by how often they come, the first numbers take
    one byte and the others two, and all first bytes stand before the second ones. ``_decode`` gives the bytes back."""
    ids = data.view("<u2")
    counts = np.bincount(ids, minlength=1 << 16)
    order = np.flatnonzero(counts)
    order = order[np.argsort(-counts[order], kind="stable")]
    numbers = np.zeros(1 << 16, np.uint16)
    numbers[order] = np.arange(len(order))
    one = _one_byte(len(order))
    number = np.arange(1 << 16)
    first = np.where(number < one, number, one + (np.maximum(number - one, 0) >> 8)).astype(np.uint8)
    own = numbers[ids]
    firsts = first[own]
    seconds = ((own[firsts >= one] - np.uint16(one)) & np.uint16(255)).astype(np.uint8)
    return np.concatenate([np.array([len(order)], "<u4").view(np.uint8), order.astype("<u2").view(np.uint8), firsts, seconds])


def _one_byte(distinct: int) -> int:
    """How many numbers can take one byte, if the other first bytes, with a second one, are to do for the rest."""
    return min(255, ((1 << 16) - distinct) // 255)


def _decode(code: np.ndarray, n: int) -> np.ndarray:
    """The bytes of the ``n`` ids that ``_code`` has coded."""
    distinct = int(code[:4].view("<u4")[0])
    order, one, at = code[4 : 4 + 2 * distinct].view("<u2"), _one_byte(distinct), 4 + 2 * distinct
    firsts, seconds = code[at : at + n], code[at + n :]
    own, long = firsts.astype(np.uint16), firsts >= one
    own[long] = np.uint16(one) + ((own[long] - np.uint16(one)) << np.uint16(8)) + seconds
    return order[own].view(np.uint8)


def _pack(rows: pa.RecordBatch) -> bytes:
    """Rows as one compressed block: an Arrow stream of the other columns with the sizes of ids, and one of all ids, coded."""
    rows, options = rows.combine_chunks() if isinstance(rows, pa.Table) else rows, pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
    ids, sink = rows.column("ids"), pa.BufferOutputStream()
    data, offsets = column_bytes(ids, pa.large_binary())
    sizes, even = np.diff(offsets), not np.any(np.diff(offsets) & 1)
    slim = rows.drop_columns("ids").append_column("size", pa.array(sizes.astype(np.int32)))
    code = pa.record_batch([pa.array(_code(np.ascontiguousarray(data)) if even else data, pa.uint8())], names=["ids" if even else "plain"])
    for part in (slim, code):
        with pa.ipc.new_stream(sink, part.schema, options=options) as out:
            out.write(part)
    return sink.getvalue().to_pybytes()


def _unpack(block: pa.Buffer) -> pa.RecordBatch:
    """The rows of a block, ids last."""
    source = pa.BufferReader(block)
    rows, code = (pa.ipc.open_stream(source).read_all().combine_chunks().to_batches()[0] for _ in range(2))
    sizes, data = rows.column("size").to_numpy(), code.column(0).to_numpy()
    if code.schema.names == ["ids"]:
        data = _decode(data, int(sizes.sum()) // 2)
    return rows.drop_columns("size").append_column("ids", _binary(sizes, data))


def _blocks(n: int, key: int, per_part: int, most: int = 96 << 20):
    """For ``mapInArrow``: rows (number, stride, doc_id, piece, n_tokens, ids) as (part, block), a block being rows of one part as ``_pack`` makes them.

    About ``most`` bytes are held at a time; rows of random places compress far better together than one by one.
    """

    def run(batches):
        def flush(held):
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            slots = feistel(rows.column("number").to_numpy(), n, key)
            order = np.argsort(slots)
            whole = rows.drop_columns("number").append_column("slot", pa.array(slots)).take(order).combine_chunks().to_batches()[0]
            of = slots[order] // per_part
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            made = [_pack(whole.slice(a, b - a)) for a, b in zip(cuts, cuts[1:], strict=False)]
            return pa.RecordBatch.from_arrays([pa.array(of[cuts[:-1]], pa.int32()), pa.array(made, pa.binary())], names=["to", "block"])

        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            batch = None
            if size > most:
                yield flush(held)
                size = 0
        if held:
            yield flush(held)
        give_back()

    return run


def _rows_of_blocks(shard_rows: int):
    """For ``mapInArrow``: the rows of a part's blocks in order of slot, with shard and byte offset."""
    names = ["slot", "shard", "byte_offset", "doc_id", "piece", "n_tokens", "stride", "ids"]

    def run(batches):
        held = [_unpack(x.as_buffer()) for batch in batches for x in batch.column("block")]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        slots = rows.column("slot").to_numpy()
        order = np.argsort(slots)
        for at in range(0, len(order), 4096):
            some = rows.take(order[at : at + 4096])
            slot = slots[order[at : at + 4096]]
            some = some.append_column("shard", pa.array(slot // shard_rows, pa.int32())).append_column("byte_offset", pa.array(slot % shard_rows * some.column("stride").to_numpy(), pa.int64()))
            yield from some.select(names).combine_chunks().to_batches()
        held = rows = some = None
        give_back()

    return run


def training_order(sequences: DataFrame, key: int = 99, shard_rows: int = 8192, parts: int | None = None) -> DataFrame:
    """Written sequences with slot, shard and byte offset, in parts of whole shards and sorted by slot.

    A row's number is the rows of the parts before its own (one number per task is counted and broadcast) plus nth;
    ``feistel`` turns it into its slot. A shard holds ``shard_rows`` slots of equal stride, so a reader finds slot s at
    byte (s mod shard_rows) * stride of shard s div shard_rows, reads on from there, and resumes at any slot.

    Rows go to their part in compressed blocks, without the ids that only fill up a sequence. A task holds the rows of its part:
    by default the shards of a part are 15 at most.
    """
    n, table = _firsts(sequences.groupBy("part").agg(F.count("*").alias("n")))
    stride = F.octet_length("ids")
    filled = F.substring(F.col("ids"), F.lit(1), 2 * F.col("n_tokens"))
    short = F.when(_filled_up(filled, stride) == F.col("ids"), filled).otherwise(F.col("ids"))
    rows = sequences.join(F.broadcast(table), "part").select((F.col("first") + F.col("nth")).alias("number"), stride.alias("stride"), "doc_id", "piece", "n_tokens", short.alias("ids"))
    passed = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("number", "stride", "ids").schema)
    return _in_slots(rows, lambda batches: batches, n, key, shard_rows, parts, passed)


def _firsts(counts: DataFrame) -> tuple[int, DataFrame]:
    """All rows of the tasks that counts (part, n) names, and (part, first): the rows of the parts before each one."""
    sums = sorted((r["part"], r["n"]) for r in counts.collect())
    firsts = np.concatenate([[0], np.cumsum([n for _, n in sums], dtype=np.int64)])
    return int(firsts[-1]), counts.sparkSession.createDataFrame([(p, int(f)) for (p, _), f in zip(sums, firsts, strict=False)], "part int, first long")


def _in_slots(given: DataFrame, rows_of, n: int, key: int, shard_rows: int, parts: int | None, passed: str) -> DataFrame:
    """The rows that ``rows_of`` makes of ``given``, as ``_blocks`` takes them, in order of slot and filled up."""
    shards = max(1, -(-n // shard_rows))
    parts = parts or min(shards, max(int(given.sparkSession.conf.get("spark.sql.shuffle.partitions")), shards // 8))
    cut = _blocks(n, key, shard_rows * -(-shards // parts))
    blocks = given.mapInArrow(lambda batches: cut(rows_of(batches)), "to int, block binary").repartitionById(parts, "to")
    ordered = blocks.mapInArrow(_rows_of_blocks(shard_rows), f"slot long, shard int, byte_offset long, {passed}, stride int, ids binary")
    return ordered.withColumn("ids", _filled_up(F.col("ids"), F.col("stride"))).drop("stride")


def _filled_up(ids: Column, stride: Column) -> Column:
    """ids with the last one repeated up to ``stride`` bytes."""
    return F.rpad(ids, stride, F.substring(ids, -2, 2))


def materialise(docs: DataFrame, length: int = 512, key: int = 99, shard_rows: int = 8192, paths: tuple[str, str] | None = None) -> DataFrame:
    """All documents in training order. The sequences are written to the shared folder first, in compressed blocks, so texts are encoded once and numbers stay.

    Each document is in it whole however long, repeated rows as often as they come; rows of one doc_id are told apart by nothing but
    their place. An empty table gives no rows; other columns are ignored. Slots follow from the order of the rows in the
    input's partitions: the same files in the same splits give the same slots.
    """
    spark, sequences = docs.sparkSession, _sequences(length, 2, paths or default_paths())

    def packed(batches):
        for rows in sequences(batches):
            yield pa.RecordBatch.from_arrays([rows.column("part")[:1], pa.array([rows.num_rows], pa.int64()), pa.array([_pack(rows.drop_columns("part"))], pa.binary())], names=["part", "n", "block"])

    def numbered(batches):
        for batch in batches:
            for first, block in zip(batch.column("first").to_pylist(), batch.column("block"), strict=True):
                rows = _unpack(block.as_buffer())
                number, stride = first + rows.column("nth").to_numpy(), np.full(rows.num_rows, 2 * length, np.int32)
                columns = [pa.array(number), pa.array(stride), *[rows.column(c) for c in ("doc_id", "piece", "n_tokens", "ids")]]
                yield pa.RecordBatch.from_arrays(columns, names=["number", "stride", "doc_id", "piece", "n_tokens", "ids"])

    place = scratch_path(spark, "sequences")
    _slim(docs).mapInArrow(packed, "part int, n long, block binary").write.option("compression", "none").parquet(place)
    blocks = spark.read.parquet(place)
    n, table = _firsts(blocks.groupBy("part").agg(F.sum("n").alias("n")))
    given = blocks.join(F.broadcast(table), "part").select("first", "block")
    return _in_slots(given, numbered, n, key, shard_rows, None, "doc_id bigint, piece int, n_tokens int")


def write_shards(ordered: DataFrame, path: str) -> DataFrame:
    """Binary files ``shard-<number>.bin`` under ``path``, one per shard; gives a row (slot, shard, byte_offset, doc_id, piece, n_tokens, ids_crc32, file) for each sequence written.

    Every file holds its sequences in order of slot, at equal strides and with nothing between, so that it can be read on from any
    slot. ``path`` is any folder that pyarrow's file systems reach from every executor. A file is written under
    another name and moved into place, so a task that runs again, or twice at once, leaves the same whole file.
    """
    kinds = [("slot", pa.int64()), ("shard", pa.int32()), ("byte_offset", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("n_tokens", pa.int32()), ("ids_crc32", pa.int64()), ("file", pa.string())]
    given = [name for name, _ in kinds[:6]]

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        store.create_dir(root)
        attempt, out, now = TaskContext.get().taskAttemptId(), None, None

        def name(shard: int) -> str:
            return f"shard-{shard:06d}.bin"

        def close():
            out.close()
            store.move(f"{root}/{name(now)}.{attempt}", f"{root}/{name(now)}")

        for batch in batches:
            shards, ids = batch.column("shard").to_pylist(), batch.column("ids").to_pylist()
            for shard, data in zip(shards, ids, strict=True):
                if shard != now:
                    if now is not None:
                        close()
                    now, out = shard, store.open_output_stream(f"{root}/{name(shard)}.{attempt}")
                out.write(data)
            columns = [batch.column(c) for c in given] + [pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array([name(x) for x in shards], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(kinds))
        if now is not None:
            close()

    return ordered.mapInArrow(run, "slot long, shard int, byte_offset long, doc_id long, piece int, n_tokens int, ids_crc32 long, file string")


def read_slots(path: str, first: int, count: int, stride: int, shard_rows: int = 8192) -> list[bytes]:
    """``count`` sequences from slot ``first`` on, read from the shards one after the other."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    out: list[bytes] = []
    while len(out) < count:
        shard, at = divmod(first + len(out), shard_rows)
        with store.open_input_file(f"{root}/shard-{shard:06d}.bin") as file:
            file.seek(at * stride)
            data = file.read(min(count - len(out), shard_rows - at) * stride)
        if not data:
            break
        out += [data[i : i + stride] for i in range(0, len(data), stride)]
    return out
