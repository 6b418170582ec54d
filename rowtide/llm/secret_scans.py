"""Secrets in texts: known forms, and windows of high Shannon entropy per character class (operator 11)."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from rowtide.llm.texts import column_bytes, spans as row_spans

#: Known forms. Patterns work on UTF-8 bytes, so letters of either case are A-Z and a-z alone.
_ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_ASSIGN_LEAST, _ACCESS_LEAST, _HEX_LEAST = 8, 16, 32
#: A quick test for rows that may hold an assignment; it also lets letters through that fold to ASCII ones.
_MAY_ASSIGN = r"(?i)password|passwd|secret|token|api_?key"


class CharClass(NamedTuple):
    """A window slides over every run of ``members``; from ``least`` bits a character on, it is taken for a secret."""

    kind: str
    members: bytes
    window: int
    least: float


_DIGITS, _LOWER, _UPPER = b"0123456789", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Random strings of these classes have about 3.5, 4.1 and 4.6 bits in a window; words and names run together stay well below.
CLASSES = (
    CharClass("entropy_hex", _DIGITS + b"abcdefABCDEF", 24, 3.0),
    CharClass("entropy_alnum", _DIGITS + _LOWER, 24, 3.9),
    CharClass("entropy_base64", _DIGITS + _LOWER + _UPPER + b"+/-_", 32, 4.25),
)

#: Forms that look random and are no secrets. Each must match the whole token around a span: its longest run of ``[A-Za-z0-9+/_.=-]``.
ALLOW = (
    r"[0-9._+/=-]+",  # numbers, dates, separators
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",  # UUIDs
    r"sha(1|224|256|384|512)[-=].*",  # published digests
    r"[0-9]*(abcdefghijklmnopqrstuvwxyz|ABCDEFGHIJKLMNOPQRSTUVWXYZ|0123456789abcdef|0123456789ABCDEF)+[A-Za-z0-9+/=_-]*",  # alphabets
)

#: Kinds of the known forms; spans that start together come in this order, then those of the character classes.
BASE = ("assign", "access", "hex")

_TOKEN = np.zeros(256, bool)
_TOKEN[list(_DIGITS + _LOWER + _UPPER + b"+/_.=-")] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_SCALE = 1 << 20


def _runs(member: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of at least ``least`` member bytes; no run crosses a row."""
    fresh = np.ones(len(member) + 1, bool)
    fresh[1:-1] = ~member[:-1]
    fresh[offsets] = True
    starts = np.flatnonzero(member & fresh[:-1])
    last = np.ones(len(member), bool)
    last[:-1] = ~member[1:]
    last[offsets[offsets > 0] - 1] = True
    ends = np.flatnonzero(member & last) + 1
    keep = ends - starts >= least
    return starts[keep], ends[keep]


def window_bits(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Last position of every window of ``window`` bytes within the runs [start, end), and its entropy in bits a byte.

    With c the counts of the bytes in a window, its entropy is log2(window) - sum(c * log2(c)) / window. A step takes one
    byte out and one in, so the sum changes by the terms of two counts. Both counts are read off the sorted positions
    of that byte in the run, and the changes are added up in whole numbers, so that long runs gather no error.
    """
    lengths = ends - starts
    firsts = np.cumsum(lengths) - lengths
    run = np.repeat(np.arange(len(starts)), lengths)
    t = np.arange(len(run))
    at = starts[run] + t - firsts[run]
    key = (run * 256 + buf[at]) * (len(t) + 1)
    order = np.argsort(key, kind="stable")
    sorted_keys = key[order] + order
    place = np.empty(len(t), np.int64)
    place[order] = np.arange(len(t))
    inside = t - firsts[run]
    own = place - np.searchsorted(sorted_keys, key + np.maximum(t - window + 1, firsts[run]))  # this byte's count in the window before it comes in
    later = np.searchsorted(sorted_keys, key + np.minimum(t + window, len(t))) - place  # its count in the window that it leaves
    counts = np.arange(window + 1)
    term = np.rint(np.where(counts > 0, counts * np.log2(np.maximum(counts, 1)), 0) * _SCALE).astype(np.int64)
    change = term[own + 1] - term[own]
    leaves = np.flatnonzero(inside >= window)
    gone = later[leaves - window]
    change[leaves] += term[gone - 1] - term[gone]
    total = np.cumsum(change)
    total -= np.append(0, total)[firsts[run]]  # each run starts from nothing
    full = inside >= window - 1
    return at[full], np.log2(window) - total[full] / (_SCALE * window)


def _entropy_spans(buf: np.ndarray, offsets: np.ndarray, cls: CharClass) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and largest entropy of the unions of overlapping windows that reach the class's threshold."""
    member = np.zeros(256, bool)
    member[list(cls.members)] = True
    starts, ends = _runs(member[buf], offsets, cls.window)
    none = np.zeros(0, np.int64)
    if not len(starts):
        return none, none, np.zeros(0)
    last, bits = window_bits(buf, starts, ends, cls.window)
    last, bits = last[bits >= cls.least], bits[bits >= cls.least]
    if not len(last):
        return none, none, np.zeros(0)
    run = np.searchsorted(starts, last, "right")
    fresh = np.flatnonzero(np.concatenate([[True], (np.diff(last) > cls.window) | (np.diff(run) > 0)]))
    return last[fresh] - cls.window + 1, np.append(last[fresh[1:] - 1], last[-1]) + 1, np.maximum.reduceat(bits, fresh)


def find_spans(buf: np.ndarray, offsets: np.ndarray, may_assign: np.ndarray, classes: Sequence[CharClass], allow: re.Pattern) -> list[tuple[int, int, int, int, float | None]]:
    """(row, kind, start, end, bits) of all spans, by row, start and kind; positions are bytes of ``buf``."""
    found: list[tuple[int, int, int, int, float | None]] = []
    for row in np.flatnonzero(may_assign).tolist():
        a = int(offsets[row])
        text = buf[a : offsets[row + 1]].tobytes()
        found += [(row, 0, a + m.start(), a + m.end(), None) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= _ASSIGN_LEAST]
    whole = buf.tobytes()
    for m in _ACCESS.finditer(whole):
        row = int(np.searchsorted(offsets, m.start(), "right")) - 1
        a, b = m.span()
        if b > offsets[row + 1]:  # it ran into the next text: find those of the rows it touches again, one by one
            for k in range(row, int(np.searchsorted(offsets, b, "left"))):
                low = max(a, int(offsets[k]))
                found += [(k, 1, low + x.start(), low + x.end(), None) for x in _ACCESS.finditer(whole[low : min(b, int(offsets[k + 1]))]) if x.end() - x.start() >= _ACCESS_LEAST]
        elif b - a >= _ACCESS_LEAST:
            found.append((row, 1, a, b, None))
    starts, ends = _runs(_HEX[buf], offsets, _HEX_LEAST)
    found += [(row, 2, a, b, None) for row, a, b in zip((np.searchsorted(offsets, starts, "right") - 1).tolist(), starts.tolist(), ends.tolist(), strict=True)]
    token_starts, token_ends = _runs(_TOKEN[buf], offsets, 1)
    for number, cls in enumerate(classes, len(BASE)):
        starts, ends, bits = _entropy_spans(buf, offsets, cls)
        if not len(starts):
            continue
        # spans that lie inside one that is there already were told as a known form or by a class that comes first
        held = np.array(sorted((a, b) for _, _, a, b, _ in found), np.int64).reshape(-1, 2)
        reach = np.append(0, np.maximum.accumulate(held[:, 1]))[np.searchsorted(held[:, 0], starts, "right")]
        token = np.searchsorted(token_starts, starts, "right") - 1
        row = np.searchsorted(offsets, starts, "right") - 1
        for r, a, b, x, low, high in zip(*(y[reach < ends].tolist() for y in (row, starts, ends, bits, token_starts[token], token_ends[token])), strict=True):
            if not allow.fullmatch(whole, low, high):
                found.append((r, number, a, b, x))
    return sorted(found, key=lambda s: (s[0], s[2], s[1]))


def _column_spans(column, classes: Sequence[CharClass], allow: re.Pattern):
    """(first row, rows, their spans, buffer, offsets) of runs of rows of an Arrow text column."""
    text = pc.fill_null(column.cast(pa.large_string()), "")
    may = pc.match_substring_regex(text, _MAY_ASSIGN).to_numpy(zero_copy_only=False)
    buf, offsets = column_bytes(text)
    for i, j in row_spans(offsets, 1 << 20):
        part, own = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        yield i, j, find_spans(part, own, may[i:j], classes, allow) if len(part) else [], part, own


def _allowed(allow: Sequence[str]) -> re.Pattern:
    return re.compile(b"|".join(b"(?:" + a.encode() + b")" for a in allow) or b"(?!)")


def secret_spans(text: Column, classes: Sequence[CharClass] = CLASSES, allow: Sequence[str] = ALLOW) -> Column:
    """Array of (kind, start, end, bits) for a text, by start and kind; places are code points, end exclusive."""
    kinds, pattern = [*BASE, *(c.kind for c in classes)], _allowed(allow)
    fields = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("bits", pa.float64())])

    @F.arrow_udf("array<struct<kind:string,start:bigint,end:bigint,bits:double>>")
    def find(texts: pa.Array) -> pa.Array:
        out: list[list[dict]] = [[] for _ in range(len(texts))]
        for i, _, found, part, own in _column_spans(texts, classes, pattern):
            if not found:
                continue
            points = np.append(0, np.cumsum((part & 0xC0) != 0x80, dtype=np.int64))
            for row, kind, a, b, bits in found:
                base = points[own[row]]
                out[i + row].append({"kind": kinds[kind], "start": int(points[a] - base), "end": int(points[b] - base), "bits": bits})
        return pa.array(out, pa.list_(fields))

    return find.asNondeterministic()(text.cast("string"))


def scan(docs: DataFrame, text: str = "text", classes: Sequence[CharClass] = CLASSES, allow: Sequence[str] = ALLOW) -> DataFrame:
    """Rows (doc, spans), one per row of ``docs``: doc is the row as given, spans its secrets as (kind, start, end, bits).

    Known forms are kinds ``assign``, ``access`` and ``hex``: leftmost matches that don't overlap within a kind; those too
    short are dropped after matching. To these come unions of overlapping windows whose entropy reaches their class's
    threshold, unless they lie inside a span that is there already, or the token around them is on the allow-list;
    the allow-list takes no known form away. bits is the largest entropy of a window, null for known forms.

    A null or empty text has no spans. Whole texts are read, however long; a very long one takes memory in proportion
    to it. Spans that start together keep the order of kinds; equal rows have equal spans; no rows give no rows. Other
    columns, whatever their names and types, stay inside doc.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(row.alias("doc"), secret_spans(F.col(f"`{text}`"), classes, allow).alias("spans"))


def redact(text: Column, mark: str = "[secret]", classes: Sequence[CharClass] = CLASSES, allow: Sequence[str] = ALLOW) -> Column:
    """The text with ``mark`` in place of all that its spans cover; spans that touch or overlap become one. Null stays null."""
    pattern, put = _allowed(allow), mark.encode()

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        out: list[str | None] = []
        missing = pc.is_null(texts).to_pylist()
        for i, j, found, part, own in _column_spans(texts, classes, pattern):
            by_row: dict[int, list[tuple[int, int]]] = {}
            for row, _, a, b, _ in found:
                by_row.setdefault(row, []).append((a, b))
            for row in range(j - i):
                made, at = [], int(own[row])
                for a, b in by_row.get(row, ()):
                    if a > at or not made:
                        made += [part[at : max(a, at)].tobytes(), put]
                    at = max(at, b)
                made.append(part[at : own[row + 1]].tobytes())
                out.append(None if missing[i + row] else b"".join(made).decode())
        return pa.array(out, pa.string())

    return clean.asNondeterministic()(text.cast("string"))


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, number of each known form, hash of their list, and the list of all spans."""
    known = F.filter("spans", lambda s: s["kind"].isin(*BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scanned.select("doc.doc_id", *map(count, BASE), F.sha2(listed(known), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
