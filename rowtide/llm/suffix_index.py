"""Suffix-array dedup with a logarithmic index family (operator 4).

A document's bytes are removed where a string of ``length`` bytes also starts in a document with a smaller doc_id.
Documents are taken in batches of rising doc_id. Each new batch gets suffix arrays, which are merge-scanned against the
levels of all batches before it; then they become a level, and levels of equal size merge (``Levels``). A suffix is held
as its first ``length`` bytes, in byte order, since only their equality matters: every match is one of bytes.

Sorting every suffix of the corpus would cost several times its size, so two passes do it, the second over less:

1. Samples. Every string of ``length`` bytes has one sample, chosen by its bytes alone (the smallest fingerprint of
   ``gram`` bytes inside it), so equal strings have equal samples. A sample that no other document shares rules out all
   strings around it. Fingerprints do no more than that: two that are equal by chance cost a comparison, not a byte.
2. Blocks. The neighbouring strings of one sample make a block of bytes. Blocks whose sample another batch has are sent
   to a slice by sample, as bytes. A block that an earlier batch has too is matched as a whole. The suffixes in the first
   blocks of samples that have several (edges of passages, edits in near copies) go through the levels of the slice.

A sample with more than ``hot`` strings in all sends these strings one by one, by their own fingerprint, so that a line
that stands in a third of all documents, in other surroundings each time, isn't one task. Matches inside a batch are
found in the batch. A slice answers with one bit per string. Texts are shuffled once, and batches are told apart by
doc_id alone: no document id travels with a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from rowtide.llm.batches import split_batches
from rowtide.llm.texts import column_bytes, freeing, mix64, rolling, span_hashes

#: Positions hashed at a time, which bounds memory whatever the length of a document.
_STEP = 1 << 20


class Levels:
    """Sorted arrays of distinct values with their owners; arrays of about equal size merge, as in a binary counter."""

    def __init__(self):
        self.arrays: list[tuple[np.ndarray, np.ndarray]] = []

    def scan(self, values: np.ndarray) -> np.ndarray:
        """Owner of each of the sorted ``values`` in any level, or -1."""
        owner = np.full(len(values), -1, np.int64)
        for held, owners in self.arrays:
            at = np.minimum(np.searchsorted(held, values), len(held) - 1)
            hit = held[at] == values
            owner[hit] = owners[at[hit]]
        return owner

    def add(self, values: np.ndarray, owners: np.ndarray) -> None:
        """A new array of sorted values that no level holds yet."""
        if not len(values):
            return
        self.arrays.append((values, owners))
        while len(self.arrays) > 1 and len(self.arrays[-2][0]) < 2 * len(self.arrays[-1][0]):
            (v1, o1), (v2, o2) = self.arrays.pop(), self.arrays.pop()
            values, owners = np.concatenate([v2, v1]), np.concatenate([o2, o1])
            order = np.argsort(values, kind="stable")
            self.arrays.append((values[order], owners[order]))


def _chunks(buf: np.ndarray, tail: int) -> Iterator[tuple[int, np.ndarray]]:
    """Pieces of the buffer with ``tail`` more bytes each."""
    for a in range(0, max(len(buf) - tail, 0), _STEP):
        yield a, buf[a : a + _STEP + tail]


def _strings_at(buf: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The ``length`` bytes from each start on, as values that sort in byte order."""
    if not len(starts):
        return np.zeros(0, f"S{length}")
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(buf, length)[starts]).view(f"S{length}").ravel()


def _expand(firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All numbers of runs that begin at ``firsts``."""
    return np.repeat(firsts - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))


def _same_spans(buf: np.ndarray, starts: np.ndarray, others: np.ndarray, sizes: np.ndarray) -> bool:
    """Whether spans of equal sizes hold equal bytes."""
    ends, i = np.cumsum(sizes), 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + _STEP)))
        if np.any(buf[_expand(starts[i:j], sizes[i:j])] != buf[_expand(others[i:j], sizes[i:j])]):
            return False
        i = j
    return True


def distinct_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for the bytes of each span, and one span for each number. Hashes are compared first, then bytes."""
    _, one, place = np.unique(span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
    other = np.flatnonzero(one[place] != np.arange(len(place)))
    sizes, like = ends - starts, one[place[other]]
    if np.array_equal(sizes[other], sizes[like]) and _same_spans(buf, starts[other], starts[like], sizes[other]):
        return place, one
    numbers: dict[bytes, int] = {}
    place = np.array([numbers.setdefault(buf[a:b].tobytes(), len(numbers)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    return place, np.unique(place, return_index=True)[1]


class Batch:
    """The texts of a batch in order of doc_id, and their suffixes of interest."""

    def __init__(self, table: pa.Table, length: int, gram: int):
        ids = table.column("doc_id").to_numpy(zero_copy_only=False)
        self.order = np.argsort(ids, kind="stable")
        table = table.take(pa.array(self.order))
        self.table, self.ids, self.length, self.gram = table, ids[self.order], length, gram
        self.buf, self.offsets = column_bytes(table.column("text"))
        self.rank = np.unique(self.ids, return_inverse=True)[1]  # equal ids are no smaller than each other

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, positions, "right") - 1

    def _inside(self, starts: np.ndarray, width: int) -> np.ndarray:
        return self.offsets[self.doc_of(starts) + 1] >= starts + width

    def samples(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of all strings of ``length`` bytes as runs [first, last] that have one sample, and its fingerprint."""
        window = self.length - self.gram + 1
        firsts, lasts, prints = [], [], []
        for a, piece in _chunks(self.buf, self.length - 1):
            grams = rolling(piece, self.gram)
            n = len(grams) - window + 1
            if n <= 0:
                continue
            least, have = grams, 1
            while have < window:  # smallest of each window, by doubling
                step = min(have, window - have)
                least = np.minimum(least[:-step], least[step:])
                have += step
            # Equal neighbours have one sample; a string of equal bytes gives one long run, which is as right.
            new = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
            cuts = np.union1d(new, self.offsets[(self.offsets > a) & (self.offsets < a + n)] - a)
            ends = np.append(cuts[1:], n)
            prints.append(mix64(least[cuts]))  # smallest ones crowd near zero: spread them over the slices again
            firsts.append(a + cuts)
            lasts.append(a + ends - 1)
        if not prints:
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
        first, last, prints = np.concatenate(firsts), np.concatenate(lasts), np.concatenate(prints)
        last = np.minimum(last, self.offsets[self.doc_of(first) + 1] - self.length)  # strings don't cross documents
        real = last >= first
        return first[real], last[real], prints[real]

    def least_rank(self, place: np.ndarray, n: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The smallest rank of a document with each of n values, and whether documents of other ranks have it too."""
        rank, least, most = self.rank[self.doc_of(starts)], np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
        np.minimum.at(least, place, rank)
        np.maximum.at(most, place, rank)
        return least, least < most

    def strings(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts of all strings in the runs, a number for the bytes of each, and of each number a start and a fingerprint."""
        starts = np.sort(_expand(first, last - first + 1))
        prints = np.zeros(len(starts), np.uint64)
        for a, piece in _chunks(self.buf, self.length - 1):
            low, high = np.searchsorted(starts, [a, a + _STEP])
            if high > low:
                prints[low:high] = rolling(piece, self.length)[starts[low:high] - a]
        distinct, one, place = np.unique(prints, return_index=True, return_inverse=True)
        for i in range(0, len(starts), _STEP):
            own, like = starts[i : i + _STEP], starts[one[place[i : i + _STEP]]]
            if np.any(_strings_at(self.buf, own, self.length) != _strings_at(self.buf, like, self.length)):  # equal fingerprints of other bytes
                _, one, place = np.unique(_strings_at(self.buf, starts, self.length), return_index=True, return_inverse=True)
                return starts, place, starts[one], prints[one]
        return starts, place, starts[one], distinct


def _slice_cuts(distinct: np.ndarray, slices: int) -> np.ndarray:
    """Where each slice of the fingerprint space begins among sorted fingerprints."""
    bounds = np.array([(s << 64) // slices for s in range(slices)], np.uint64)
    return np.append(np.searchsorted(distinct, bounds), len(distinct))


def _narrow(prints: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each fingerprint; the high ones mostly follow from the slice."""
    return prints.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _widen(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel().astype(np.uint64)


_ASK = "batch int, slice int, prints binary, sizes binary, bytes binary, passed array<binary>"
_REPLY = "batch int, slice int, bits binary, more_bits binary, passed array<binary>"
_ASK_NAMES, _REPLY_NAMES = ["batch", "slice", "prints", "sizes", "bytes", "passed"], ["batch", "slice", "bits", "more_bits", "passed"]


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * (len(names) - 3), pa.list_(pa.binary())]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(names), kinds, strict=True)], names=names)


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)


def _joined(column: pa.ChunkedArray) -> np.ndarray:
    """The bytes of all rows one after the other, as they lie in the column: no copy if it is one chunk."""
    chunks = [c.cast(pa.large_binary()) for c in column.chunks if len(c)]
    parts = []
    for c in chunks:
        _, offsets, data = c.buffers()
        ends = np.frombuffer(offsets, np.int64, len(c) + 1, c.offset * 8)
        parts.append(np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _scan_samples(width: int, hot: int):
    """For one slice: which samples several batches have, and which have more than ``hot`` strings (counted in steps of 64)."""

    def run(table: pa.Table) -> pa.Table:
        batches, slices, asked, heat, _, _ = (table.column(c).to_pylist() for c in _ASK_NAMES)
        values = [_widen(x, width) for x in asked]
        ends = np.cumsum([len(v) for v in values]).tolist()
        _, place, counts = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
        strings = np.bincount(place, np.exp2(np.frombuffer(b"".join(heat), np.uint8) + 6.0))
        several, many = (counts > 1)[place], (strings > hot)[place]
        return _table([(n, s, _bits(several[b - len(v) : b]), _bits(many[b - len(v) : b]), None) for n, s, v, b in zip(batches, slices, values, ends, strict=True)], _REPLY_NAMES)

    return run


def _scan_blocks(length: int, firsts: np.ndarray):
    """For one slice: groups of batches in order, each merge-scanned against the levels, then added; a bit per string
    tells whether an earlier group has it. ``firsts`` are the first batches of the groups."""

    def run(table: pa.Table) -> pa.Table:
        batches, slices, passed = (table.column(c).to_pylist() for c in ("batch", "slice", "passed"))
        if slices[0] < 0:
            return _table([(b, s, None, None, p) for b, s, p in zip(batches, slices, passed, strict=True)], _REPLY_NAMES)
        held = [len(x) // 4 for x in table.column("sizes").to_pylist()]
        size = np.ascontiguousarray(_joined(table.column("sizes"))).view("<u4").astype(np.int64)
        tag, buf = np.ascontiguousarray(_joined(table.column("prints"))).view("<u4"), _joined(table.column("bytes"))
        group = np.repeat(np.searchsorted(firsts, batches, "right"), held)
        starts, counts = np.cumsum(size) - size, size - length + 1
        place, one = distinct_spans(buf, starts, starts + size)
        least = np.full(len(one), np.iinfo(np.int64).max)
        np.minimum.at(least, place, group)
        whole = group > least[place]
        _, sample, blocks = np.unique(tag[one], return_inverse=True, return_counts=True)
        open_ = np.flatnonzero(~whole & (blocks[sample] > 1)[place])
        open_ = open_[np.argsort(group[open_], kind="stable")]
        flags, bit, levels = np.repeat(whole, counts), np.cumsum(counts) - counts, Levels()
        for own in np.split(open_, np.flatnonzero(np.diff(group[open_])) + 1):
            strings = _strings_at(buf, _expand(starts[own], counts[own]), length)
            suffixes, at = np.unique(strings, return_inverse=True)
            seen = levels.scan(suffixes) >= 0
            flags[_expand(bit[own], counts[own])] = seen[at]
            levels.add(suffixes[~seen], np.zeros(int((~seen).sum()), np.int8))
        ends = np.append(bit, counts.sum())[np.cumsum([0, *held])].tolist()
        return _table([(n, s, _bits(flags[a:b]), None, None) for n, s, a, b in zip(batches, slices, ends[:-1], ends[1:], strict=True)], _REPLY_NAMES)

    return run


class Candidates:
    """What one batch knows after each pass; every step is worked out again from the texts and the bits received."""

    def __init__(self, batch: Batch, slices: int):
        self.batch, self.slices = batch, slices
        self.first, self.last, samples = batch.samples()
        self.samples, self.place = np.unique(samples, return_inverse=True)
        self.cuts = _slice_cuts(self.samples, slices)

    def ask_samples(self, number: int, width: int) -> pa.Table:
        """Samples of each slice, with the power of two of the strings that each has beyond 64."""
        strings = np.bincount(self.place, self.last - self.first + 1, len(self.samples))
        heat, rows = np.maximum(np.ceil(np.log2(np.maximum(strings, 1))) - 6, 0).astype(np.uint8), []
        for s in np.flatnonzero(np.diff(self.cuts)).tolist():
            own = slice(self.cuts[s], self.cuts[s + 1])
            rows.append((number, s, _narrow(self.samples[own], width), heat[own].tobytes(), None, None))
        return _table(rows, _ASK_NAMES)

    def read_samples(self, replies: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        shared, hot = np.zeros(len(self.samples), bool), np.zeros(len(self.samples), bool)
        for s, bits, more in zip(*(replies.column(c).to_pylist() for c in ("slice", "bits", "more_bits")), strict=True):
            own = slice(self.cuts[s], self.cuts[s + 1])
            shared[own], hot[own] = _flags(bits, len(shared[own])), _flags(more, len(shared[own]))
        return shared, hot

    def keep(self, shared: np.ndarray, hot: np.ndarray) -> None:
        """Keep the runs whose sample another document has, number their blocks, and list what the slices are asked: blocks
        by sample, and strings of hot samples by themselves."""
        batch, length = self.batch, self.batch.length
        self.several = batch.least_rank(self.place, len(self.samples), self.first)[1]
        kept = (self.several | shared)[self.place]
        self.first, self.last, sample = self.first[kept], self.last[kept], self.place[kept]
        self.block, one = distinct_spans(batch.buf, self.first, self.last + length)
        self.sample_of, self.rank = sample[one], batch.rank[batch.doc_of(self.first)]
        by_sample, by_string = shared & ~hot, shared & hot
        asked = np.flatnonzero(by_sample[self.sample_of])
        self.asked_of = np.full(len(one), -1)
        self.asked_of[asked] = np.arange(len(asked))
        self.loose = by_string[sample]
        self.loose_starts, self.loose_place, starts, prints = batch.strings(self.first[self.loose], self.last[self.loose])
        self.n_blocks = len(asked)
        self.starts = np.concatenate([self.first[one[asked]], starts])
        self.ends = np.concatenate([self.last[one[asked]], starts]) + length
        self.prints = np.concatenate([self.samples[self.sample_of[asked]], prints])
        bounds = np.array([(s << 64) // self.slices for s in range(self.slices)], np.uint64)
        at = np.searchsorted(bounds, self.prints, "right") - 1
        self.order = np.argsort(at, kind="stable")
        self.order_cuts = np.searchsorted(at[self.order], np.arange(self.slices + 1))

    def ask_blocks(self, number: int, passed: list[bytes]) -> pa.Table:
        rows, buf = [(number, -1 - number, None, None, None, passed)], self.batch.buf
        for s in np.flatnonzero(np.diff(self.order_cuts)).tolist():
            own = self.order[self.order_cuts[s] : self.order_cuts[s + 1]]
            sizes = self.ends[own] - self.starts[own]
            rows.append((number, s, self.prints[own].astype("<u4").tobytes(), sizes.astype("<u4").tobytes(), buf[_expand(self.starts[own], sizes)].tobytes(), None))
        return _table(rows, _ASK_NAMES)

    def removed(self, replies: pa.Table) -> np.ndarray:
        """Which bytes of the batch go."""
        length, counts = self.batch.length, self.ends - self.starts - self.batch.length + 1
        bit, flags = np.zeros(len(counts), np.int64), np.zeros(int(counts.sum()), bool)
        bit[self.order] = np.cumsum(counts[self.order]) - counts[self.order]
        ends = np.concatenate([[0], np.cumsum(counts[self.order])])[self.order_cuts]
        for s, bits in zip(*(replies.column(c).to_pylist() for c in ("slice", "bits")), strict=True):
            if s >= 0:
                flags[ends[s] : ends[s + 1]] = _flags(bits, ends[s + 1] - ends[s])
        sums = np.concatenate([[0], np.cumsum(flags)])
        hits = sums[bit + counts] - sums[bit]
        asked = self.asked_of[self.block]
        known = np.append(hits, 0)[asked]
        sure = (asked >= 0) & (known == self.last - self.first + 1)
        sure |= self.rank > self.batch.least_rank(self.block, len(self.asked_of), self.first)[0][self.block]
        part = np.flatnonzero(~sure & (asked >= 0) & (known > 0))
        n = self.last[part] - self.first[part] + 1
        found = [_expand(self.first[part], n)[flags[_expand(bit[asked[part]], n)]]]
        found.append(self.loose_starts[flags[bit[self.n_blocks :]][self.loose_place]])
        blocks = np.bincount(self.sample_of, minlength=len(self.samples))
        unsure = ~sure & (self.several & (blocks > 1))[self.sample_of[self.block]]
        starts, place, distinct, _ = self.batch.strings(self.first[unsure], self.last[unsure])
        least, _ = self.batch.least_rank(place, len(distinct), starts)
        found.append(starts[self.batch.rank[self.batch.doc_of(starts)] > least[place]])
        depth = np.zeros(len(self.batch.buf) + 1, np.int32)
        np.add.at(depth, self.first[sure], 1)
        np.add.at(depth, self.last[sure] + length, -1)
        for hit in found:
            depth[hit] += 1  # starts are distinct within each list
            depth[hit + length] -= 1
        return np.cumsum(depth[:-1]) > 0


def _judged(docs: DataFrame, length: int, gram: int, batch_bytes: int, sample_bytes: int, hot: int, keep_text: bool) -> DataFrame:
    """(rest, n_bytes, n_removed, n_spans, kept_sha256, kept_text); rest has all columns but text."""
    batched, firsts, slices = split_batches(docs, batch_bytes)
    texts = batched.repartition(F.col("batch"))

    def ask_samples(key: tuple, table: pa.Table) -> pa.Table:
        return freeing(lambda: Candidates(Batch(table, length, gram), slices).ask_samples(key[0].as_py(), sample_bytes))

    def ask_blocks(key: tuple, left: pa.Table, replies: pa.Table) -> pa.Table:
        return freeing(blocks_of, key, left, replies)

    def judge(key: tuple, left: pa.Table, replies: pa.Table) -> pa.Table:
        return freeing(judged_batch, left, replies)

    def blocks_of(key: tuple, left: pa.Table, replies: pa.Table) -> pa.Table:
        known = Candidates(Batch(left, length, gram), slices)
        shared, many = known.read_samples(replies)
        known.keep(shared, many)
        return known.ask_blocks(key[0].as_py(), [_bits(shared), _bits(many)])

    def judged_batch(left: pa.Table, replies: pa.Table) -> pa.Table:
        batch = Batch(left, length, gram)
        known, gone = Candidates(batch, slices), np.zeros(len(batch.buf), bool)
        passed = [p for p in replies.column("passed").to_pylist() if p is not None]
        if passed:
            known.keep(*(_flags(bits, len(known.samples)) for bits in passed[0]))
            gone = known.removed(replies)
        out = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")}
        for a, b in zip(batch.offsets[:-1].tolist(), batch.offsets[1:].tolist(), strict=True):
            mask = gone[a:b]
            kept = batch.buf[a:b][~mask].tobytes()
            out["n_bytes"].append(b - a)
            out["n_removed"].append(b - a - len(kept))
            out["n_spans"].append(int(np.count_nonzero(mask[1:] & ~mask[:-1]) + (b > a and bool(mask[0]))))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept_text"].append(kept.decode("utf-8", "ignore") if keep_text else None)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = [pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)]
        return pa.table([batch.table.column("rest"), *columns], names=["rest", *out])

    samples_of, strings_of = _scan_samples(sample_bytes, hot), _scan_blocks(length, firsts)
    grouped = texts.groupBy("batch")
    first = grouped.applyInArrow(ask_samples, _ASK).groupBy("slice").applyInArrow(lambda table: freeing(samples_of, table), _REPLY)
    second = grouped.cogroup(first.groupBy("batch")).applyInArrow(ask_blocks, _ASK)
    judged = second.groupBy("slice").applyInArrow(lambda table: freeing(strings_of, table), _REPLY)
    result = StructType([batched.schema["rest"], *StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")])
    return grouped.cogroup(judged.groupBy("batch")).applyInArrow(judge, result)


def removed_spans(docs: DataFrame, length: int = 50, gram: int = 24, batch_bytes: int = 8 << 20, sample_bytes: int = 6, hot: int = 1 << 20) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256.

    A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller doc_id; strings
    are judged on the input. Rows that share a doc_id are no smaller than each other. Rows without doc_id come last:
    strings found in any other document go, but no such row acts on another one. Both may be any share of the table: they
    are cut into batches by a hash of the row. Null text counts as empty. A very long text is judged whole, in a batch
    of its own if it is longer than ``batch_bytes``. An empty table gives no rows. Other columns are ignored.

    ``sample_bytes``, kept of each sample within a slice, and ``hot`` decide what is compared where, not the result.
    """
    rows = _judged(docs.select("doc_id", "text"), length, gram, batch_bytes, sample_bytes, hot, False)
    return rows.select(F.col("rest.doc_id").cast("long").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def drop_repeats(docs: DataFrame, length: int = 50, gram: int = 24, batch_bytes: int = 8 << 20, sample_bytes: int = 6, hot: int = 1 << 20) -> DataFrame:
    """``docs`` with the repeated bytes taken out of text, as ``removed_spans`` judges them; columns as given.

    A character that loses some of its bytes goes as a whole, n_chars follows the text if there is such a column, a
    document that is left with white space only goes, and one that loses nothing stays as it is.
    """
    rows = _judged(docs, length, gram, batch_bytes, sample_bytes, hot, True)
    changed = F.col("n_removed") > 0
    rows = rows.where(~changed | F.col("kept_text").rlike("[^\\x20\\x09-\\x0D]"))

    def column(name: str):
        if name == "text":
            return F.when(changed | (F.col("n_bytes") > 0), F.col("kept_text")).alias("text")
        given = F.col("rest").getField(name)
        if name == "n_chars":
            given = F.when(changed, F.length("kept_text")).otherwise(given)
        return given.cast(docs.schema[name].dataType).alias(name)

    return rows.select(*[column(c) for c in docs.columns])
