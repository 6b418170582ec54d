"""Runs of repeated word sequences, found on a grammar made by recompression (operator 13)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from rowtide.llm.columns import words
from rowtide.llm.texts import SPACE, column_bytes, mix64, spans as row_spans, word_bounds


def _numbered(keys: np.ndarray, first: int) -> tuple[np.ndarray, int]:
    """A new symbol for each distinct key, from ``first`` on, and the next free symbol."""
    values, which = np.unique(keys, return_inverse=True)
    return first + which, first + len(values)


class Grammar:
    """A run-length grammar over a line of symbols, by recompression: block and pair compression take turns.

    A round first replaces every maximal block of k > 1 equal symbols by a symbol for (symbol, k). Then a hash of
    (symbol, round) puts each symbol on the left or the right side, and every left one with a right one after it becomes
    a symbol for that pair. Equal stretches are compressed alike but for a few symbols at their borders. Separators are
    negative, each different, and never compressed. Rounds end when no two symbols stand side by side.

    All levels lie one after the other; a symbol of a level is a number into these arrays. ``up`` is the symbol that holds
    it on the next level, ``left`` and ``right`` are its first and last child, ``length`` is that of the text it stands
    for, ``ahead`` and ``behind`` count the equal symbols from it on to either side, itself included.
    """

    def __init__(self, line: np.ndarray):
        symbols, lengths = [line.astype(np.int64)], [np.ones(len(line), np.int64)]
        cuts: list[np.ndarray] = []  # for each level but the last: first children of the next one
        free, turn = int(line.max(initial=0)) + 1, 0
        while True:
            now = symbols[-1]
            if not ((now[1:] >= 0) & (now[:-1] >= 0)).any():
                break
            if turn % 2 == 0:
                first = np.flatnonzero(np.concatenate([[True], now[1:] != now[:-1]]))
                size = np.diff(np.append(first, len(now)))
                made = now[first].copy()
                block = np.flatnonzero(size > 1)
                made[block], free = _numbered(made[block] * (len(now) + 1) + size[block], free)
            else:
                side = mix64(now.astype(np.uint64) + np.uint64(turn * 0x9E3779B97F4A7C15 % (1 << 64))) & np.uint64(1)
                pair = np.flatnonzero((now[:-1] >= 0) & (now[1:] >= 0) & (side[:-1] == 0) & (side[1:] == 1))
                stays = np.ones(len(now), bool)
                stays[pair + 1] = False
                first = np.flatnonzero(stays)
                made = now[first].copy()
                at = np.searchsorted(first, pair)
                made[at], free = _numbered(now[pair] * free + now[pair + 1], free)
            turn += 1
            if len(first) == len(now):  # nothing to compress this time; the next round of pairs has other sides
                continue
            cuts.append(first)
            symbols.append(made)
            lengths.append(np.add.reduceat(lengths[-1], first))
        sizes = [len(s) for s in symbols]
        base = np.cumsum([0, *sizes])
        self.symbol, self.length = np.concatenate(symbols), np.concatenate(lengths)
        total = len(self.symbol)
        self.up, self.left, self.right = np.full(total, -1, np.int64), np.full(total, -1, np.int64), np.full(total, -1, np.int64)
        self.ahead, self.behind = np.ones(total, np.int64), np.ones(total, np.int64)
        for k, now in enumerate(symbols):
            first = np.flatnonzero(np.concatenate([[True], now[1:] != now[:-1]])) if len(now) else np.zeros(0, np.int64)
            size = np.diff(np.append(first, len(now)))
            nth = np.arange(len(now)) - np.repeat(first, size)
            self.behind[base[k] : base[k + 1]] = nth + 1
            self.ahead[base[k] : base[k + 1]] = np.repeat(size, size) - nth
            if k < len(cuts):
                cut = cuts[k]
                last = np.append(cut[1:], sizes[k]) - 1
                self.left[base[k + 1] : base[k + 2]] = base[k] + cut
                self.right[base[k + 1] : base[k + 2]] = base[k] + last
                self.up[base[k] : base[k + 1]] = base[k + 1] + np.repeat(np.arange(len(cut)), last - cut + 1)

    def lce(self, i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
        """How many symbols of the line agree from places i and j on, for all pairs at once; ``back``: to the left, both included.

        Both sides climb while they begin (``back``: end) their parents and these are equal. Equal symbols are passed, as
        many of a block as both have. Where symbols differ, both sides go down to their children; on the line itself a
        difference ends the search. A separator differs from everything, so no answer leaves its text.
        """
        edge, child, repeat, step = (self.right, self.right, self.behind, -1) if back else (self.left, self.left, self.ahead, 1)
        out = np.zeros(len(i), np.int64)
        left, a, b = np.arange(len(i)), i.copy(), j.copy()
        while len(left):
            p, q = self.up[a], self.up[b]
            climb = (p >= 0) & (q >= 0)
            climb &= (edge[p] == a) & (edge[q] == b) & (self.symbol[p] == self.symbol[q])
            same = ~climb & (self.symbol[a] == self.symbol[b])
            down = ~climb & ~same
            many = np.where(same, np.minimum(repeat[a], repeat[b]), 0)
            out[left[same]] += (many * self.length[a])[same]
            low_a, low_b = child[a], child[b]
            a = np.where(climb, p, np.where(down, low_a, a + step * many))
            b = np.where(climb, q, np.where(down, low_b, b + step * many))
            go = (a >= 0) & (b >= 0)
            left, a, b = left[go], a[go], b[go]
        return out


#: Points of the harmonic grids looked at in one go.
_POINTS = 1 << 21


def grid_candidates(line: np.ndarray, first: np.ndarray, count: np.ndarray, least: int = 4):
    """Arrays (text, period, place) where ``least`` words, ``period`` apart from ``place`` on, are equal.

    Places are multiples of the period, counted from the text's first word. A run of length >= least * period holds at
    least that many of them, so no run is missed, and a text of n words has n / 1 + n / 2 + ... places at most.
    """
    longest = count // least
    ends = np.cumsum(longest)
    begin = 0
    while begin < len(count):
        stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + _POINTS, "right")))
        n = longest[begin:stop]
        text = np.repeat(np.arange(begin, stop), n)
        period = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n) + 1
        size = (count[text] - 1) // period - least + 2  # multiples k with (k + least - 1) * period inside the text
        sums = np.cumsum(size)
        at = 0
        while at < len(text):
            to = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + _POINTS, "right")))
            n = size[at:to]
            which = np.repeat(np.arange(at, to), n)
            place = (np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)) * period[which]
            where, q = first[text[which]] + place, period[which]
            keep = np.flatnonzero(line[where] == line[where + q])
            for k in range(2, least):
                keep = keep[line[where[keep]] == line[where[keep] + k * q[keep]]]
            yield text[which[keep]], q[keep], where[keep]
            at = to
        begin = stop


def find_runs(line: np.ndarray, first: np.ndarray, count: np.ndarray, least: int = 4, shortest: int = 6) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of all runs, by text, start and period.

    ``line`` holds the texts' words as numbers >= 0; text k has ``count[k]`` of them from ``first[k]`` on. A run is a
    stretch with smallest period q, of length >= max(shortest, least * q), which no neighbour goes on.
    """
    parts = list(grid_candidates(line, first, count, least))
    text, period, place = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3
    nothing = (np.zeros(0, np.int64),) * 4
    if not len(text):
        return nothing
    # the grammar is made of the texts that have a candidate, with a separator before, between and after them
    chosen = np.unique(text)
    sizes = count[chosen]
    begins = np.cumsum(sizes + 1) - sizes
    own = np.full(int(begins[-1] + sizes[-1] + 1), -1, np.int64)
    inner = np.repeat(begins - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
    own[inner] = line[np.repeat(first[chosen] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))]
    bars = np.flatnonzero(own < 0)
    own[bars] = -1 - np.arange(len(bars))
    grammar = Grammar(own)
    row = np.searchsorted(chosen, text)
    place = place - first[text] + begins[row]
    # candidates of one text and period in a row of neighbours mostly lie in one run: the first is asked, those it covers are done
    order = np.lexsort((place, period, row))
    row, period, place = row[order], period[order], place[order]
    found: list[tuple[np.ndarray, ...]] = []
    while len(row):
        heads = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(period) != 0) | (np.diff(place) != period[1:])]))
        i, q = place[heads], period[heads]
        ahead = grammar.lce(i, i + q)
        behind = grammar.lce(i - 1, i - 1 + q, back=True)
        start, end = i - behind, i + q + ahead
        found.append((row[heads], start, end, q))
        group = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(row))))
        open_ = place + period >= end[group]  # its first two points aren't both in that stretch
        row, period, place = row[open_], period[open_], place[open_]
    row, start, end, q = (np.concatenate(x) for x in zip(*found, strict=True))
    long = (end - start >= shortest) & (end - start >= least * q)
    row, start, end, q = row[long], start[long], end[long], q[long]
    if not len(row):
        return nothing
    order = np.lexsort((q, end, start, row))
    row, start, end, q = row[order], start[order], end[order], q[order]
    fresh = np.concatenate([[True], (np.diff(row) != 0) | (np.diff(start) != 0) | (np.diff(end) != 0)])  # a multiple of a stretch's period gives the stretch again
    row, start, end, q = row[fresh], start[fresh], end[fresh], q[fresh]
    order = np.lexsort((q, start, row))
    return chosen[row][order], (start - begins[row])[order], (end - start)[order], q[order]


def _word_line(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All words of the rows as numbers, equal exactly if the words are, and words per row."""
    starts, ends, counts = word_bounds(buf, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), counts
    to = np.append(0, np.cumsum(ends - starts))
    array = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(to), pa.py_buffer(buf[~SPACE[buf]])])
    return array.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), counts


def _collapsed(words_of: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    drop = np.zeros(len(words_of) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    keep = np.cumsum(drop[:-1]) == 0
    return b" ".join(w for w, k in zip(words_of, keep.tolist(), strict=True) if k)


def runs_of_text(text: Column, least: int = 4, shortest: int = 6) -> Column:
    """(n_words, runs, collapsed) of a text; runs are (start, length, period) in words, by start and period."""
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    kind = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(run_type)), ("collapsed", pa.string())])

    @F.arrow_udf("struct<n_words:bigint,runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>")
    def find(texts: pa.Array) -> pa.Array:
        buf, offsets = column_bytes(pc.fill_null(texts, ""))
        n_words, runs, collapsed = [], [], []
        for i, j in row_spans(offsets, 1 << 20):
            part, own = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            line, counts = _word_line(part, own)
            firsts = np.cumsum(counts) - counts
            by_row: dict[int, list[tuple[int, int, int]]] = {}
            for k, *run in zip(*(x.tolist() for x in find_runs(line, firsts, counts, least, shortest)), strict=True):
                by_row.setdefault(k, []).append(tuple(run))
            for k in range(j - i):
                own_runs = by_row.get(k, [])
                said = part[own[k] : own[k + 1]].tobytes().split()
                n_words.append(len(said))
                runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in own_runs])
                collapsed.append((_collapsed(said, own_runs) if own_runs else b" ".join(said)).decode())
        columns = [pa.array(n_words, pa.int64()), pa.array(runs, pa.list_(run_type)), pa.array(collapsed, pa.string())]
        return pa.StructArray.from_arrays(columns, fields=list(kind))

    return find.asNondeterministic()(text.cast("string"))


def periodic_runs(docs: DataFrame, text: str | Column = "text", least: int = 4, shortest: int = 6) -> DataFrame:
    """Rows (doc, n_words, runs, collapsed), one per row of ``docs``: doc is the row as given.

    A run is a stretch of consecutive words with smallest period q (words q apart are equal) and of length >=
    max(shortest, least * q) that no neighbouring word goes on; runs come by start, then period, and may overlap. collapsed
    is the text without each run's words after its first q, words joined by one space. Places count words from 0.

    A null or empty text has no words and no runs, and collapsed is empty. Whole texts are read; memory is that of the
    largest text times some 150 bytes a word. Equal rows have equal results, no rows give no rows, other columns stay
    inside doc whatever their names and types.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    said = F.col(f"`{text}`") if isinstance(text, str) else text
    found = docs.select(row.alias("doc"), runs_of_text(said, least, shortest).alias("_found"))
    return found.select("doc", "_found.n_words", "_found.runs", "_found.collapsed")


def with_planted_run(doc_id: Column, text: Column) -> Column:
    """The text as it is but for one document in ten, by its id: there word i >= a becomes word a + (i - a) % p.

    With h the CRC-32 of the id in decimal and g = h / 10, those have h % 10 = 0 and a word; a is g modulo the number of
    words n, and p = 1 + (n - a) / (3 + g % 8), all in whole numbers. A null id or text stays as it is.
    """
    said = words(text)
    h = F.crc32(doc_id.cast("string").cast("binary")).cast("long")
    n, g = F.size(said).cast("long"), F.floor(h / 10).cast("long")
    a = g % n
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("long")
    again = F.flatten(F.array_repeat(F.slice(said, (a + 1).cast("int"), p.cast("int")), F.ceil((n - a) / p).cast("int")))
    made = F.concat(F.slice(said, F.lit(1), a.cast("int")), F.slice(again, F.lit(1), (n - a).cast("int")))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(made, " ")).otherwise(text)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, number of runs, the run with the greatest length by period, hashes of all runs and of the collapsed text."""
    runs = F.col("runs")

    def stronger(best: Column, run: Column) -> Column:
        more = run["length"] * best["period"] > best["length"] * run["period"]  # runs come by start and period, so ties keep the first
        return F.when(best.isNull() | more, run).otherwise(best)

    kind = "struct<start:bigint,length:bigint,period:bigint>"
    best = F.aggregate(runs, F.lit(None).cast(kind), stronger)
    lines = F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    rows = found.select("doc.doc_id", F.size(runs).cast("long").alias("n_runs"), best.alias("_best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select(
        "doc_id", "n_runs", "_best.start", "_best.length", "_best.period",
        F.floor(1000 * F.col("_best.length") / F.col("_best.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
