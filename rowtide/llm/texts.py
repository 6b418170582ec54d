"""Byte-level helpers on Arrow text columns: buffers, word bounds, rolling hashes and bit votes, all vectorised."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Separators of words everywhere in this package: 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def give_back() -> None:
    """Give the system what numpy and Arrow have freed. A Python worker lives on after its task, with all it once needed."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def freeing(work, *args):
    """What ``work`` gives; what it held on the way goes back to the system."""
    try:
        return work(*args)
    finally:
        give_back()


def column_bytes(column, kind: pa.DataType = pa.large_string()) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the offsets of its rows (one more than rows); null counts as empty. ``kind`` is large_binary for bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):  # no chunk at all
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column.cast(kind), "" if kind == pa.large_string() else b"")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def spans(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of at most ``limit`` bytes each, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_bounds(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of words in each row. Words never cross rows."""
    word = ~SPACE[buf]
    if not word.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    fresh = np.empty(len(buf) + 1, bool)  # at i: byte i doesn't go on from byte i - 1
    fresh[0] = fresh[-1] = True
    fresh[1:-1] = ~word[:-1]
    fresh[offsets] = True
    starts = np.flatnonzero(word & fresh[:-1])
    stop = np.empty(len(buf), bool)
    stop[:-1] = ~word[1:]
    stop[-1] = True
    inner = offsets[(offsets > 0)]
    stop[inner - 1] = True
    ends = np.flatnonzero(word & stop) + 1
    at = np.searchsorted(starts, offsets)
    return starts, ends, np.diff(at)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values (multiply and shift)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A random-looking 64-bit value for each byte, and the odd base of the rolling hash.
BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = 0x9E3779B97F4A7C15


def rolling(buf: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` bytes, by doubling: the hash of two joined strings follows from their hashes."""
    if len(buf) < width:
        return np.zeros(0, np.uint64)
    power, have, done, out, rest = BYTE_CODES[buf], 1, 0, None, width
    while True:
        if rest & 1:
            if out is None:
                out, done = power, have
            else:
                m = len(buf) - done - have + 1
                out = out[:m] * np.uint64(pow(BASE, have, 1 << 64)) + power[done : done + m]
                done += have
        rest >>= 1
        if not rest:
            return mix64(out)
        power = power[:-have] * np.uint64(pow(BASE, have, 1 << 64)) + power[have:]
        have *= 2


_RUN = 1 << 19
_RISING = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(_RUN, BASE, np.uint64)]), dtype=np.uint64)
_FALLING = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(_RUN, pow(BASE, -1, 1 << 64), np.uint64)]), dtype=np.uint64)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span [start, end); starts and ends rise, spans may overlap.

    Running sums of byte codes times falling powers give every span's sum as a difference, which is moved to one place.
    """
    out, i = np.zeros(len(starts), np.uint64), 0
    while i < len(starts):  # spans that lie within _RUN bytes
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _RUN, "right")))
        a, b = int(starts[i]), int(ends[j - 1])
        if b - a > _RUN:  # one longer span
            out[i] = int.from_bytes(hashlib.blake2b(buf[a:b].tobytes(), digest_size=8).digest(), "little")
        else:
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_CODES[buf[a:b]] * _FALLING[: b - a], dtype=np.uint64)])
            at = starts[i:j] - a
            out[i:j] = (sums[ends[i:j] - a] - sums[at]) * _RISING[at]
        i = j
    return mix64(out + (ends - starts).astype(np.uint64))


def bit_votes(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For rows with ``counts`` hashes each, one after the other: how many of a row's hashes have bit 0, ..., 63 set.

    The bits of eight byte lanes are summed at once in 64-bit words, in blocks of at most 255 hashes.
    """
    votes = np.zeros((len(counts), 64), np.int64)
    full = np.flatnonzero(counts)
    if not len(full):
        return votes
    counts = counts[full]
    blocks = -(-counts // 255)
    firsts = np.cumsum(counts) - counts
    block_of = np.repeat(np.arange(len(full)), blocks)
    nth = np.arange(len(block_of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    starts, group = firsts[block_of] + 255 * nth, np.cumsum(blocks) - blocks
    lanes = np.uint64(0x0101010101010101)
    got = np.zeros((len(full), 64), np.int64)
    for k in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(k)) & lanes, starts)
        got[:, k::8] = np.add.reduceat(sums.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), group, axis=0)
    votes[full] = got
    return votes


def pack_bits(bits: np.ndarray) -> np.ndarray:
    """Rows of 64 booleans, bit 0 first, as unsigned 64-bit values."""
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)
