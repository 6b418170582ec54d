"""Byte-pair token ids of whole Arrow columns."""

from __future__ import annotations

import base64
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa

from rowtide.llm.texts import SPACE, column_bytes, spans

#: A byte that surely begins a character other than white space: printable ASCII, or a lead byte of characters none of which is.
_BEGINS = np.zeros(256, bool)
_BEGINS[0x21:0x7F] = _BEGINS[0xC3:0xE1] = _BEGINS[0xE4:0xF5] = True


class Encoder:
    """Ids of a byte-level BPE whose pattern never joins a white space with what stands before it.

    Ids are those of ``tokenizers`` with the JSON file, without added special tokens. Texts are first cut at the vocabulary's added
    tokens (such as the end of a text), which have ids of their own wherever a text holds them; what lies between is a text by
    itself. That is cut before a white space that a word follows; such a cut is always a border of the pattern, so the
    ids of a text are those of its pieces. Pieces repeat a lot: each distinct one of a chunk is looked up once, and
    ids are gathered by number. Known pieces are kept up to ``most``; then the store starts anew.
    """

    def __init__(self, ranks_path: str, json_path: str, most: int = 400_000):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoder = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        with open(json_path, encoding="utf-8") as file:
            added = json.load(file)["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that take blanks or words around them can't be cut out")
        self.added = {t["content"]: t["id"] for t in added}
        self.added_pattern = re.compile(b"|".join(re.escape(x.encode()) for x in sorted(self.added, key=len, reverse=True)) or b"(?!)")
        self.most = most
        self.forget()

    def forget(self) -> None:
        """Start the store of known pieces anew."""
        self.known: dict[str, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.begins, self.n = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _learn(self, pieces: list[str]) -> None:
        """Keep the ids of pieces that aren't known yet."""
        added, encode = self.added, self.encoder.encode_ordinary
        got = [[added[p]] if p in added else encode(p) for p in pieces]
        n = np.fromiter(map(len, got), np.int64, len(got))
        first, used = len(self.known), self.used + int(n.sum())
        while used > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while first + len(got) > len(self.n):
            self.begins, self.n = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begins, self.n))
        self.ids[self.used : used] = np.fromiter(chain.from_iterable(got), np.uint32, used - self.used)
        self.begins[first : first + len(got)], self.n[first : first + len(got)] = self.used + np.cumsum(n) - n, n
        self.used = used
        self.known.update(zip(pieces, range(first, first + len(got)), strict=True))

    def _cut_added(self, buf: np.ndarray, offsets: np.ndarray, cut: np.ndarray) -> None:
        """Put a cut before and after each added token, and none before the white space in front of one."""
        whole, at, end = buf.tobytes(), 0, -1
        while match := self.added_pattern.search(whole, at):
            a, b = match.span()
            row = int(np.searchsorted(offsets, a, "right")) - 1
            if b > offsets[row + 1]:  # half of it stands in the next text
                at = a + 1
                continue
            if a > offsets[row] + 1 and a - 1 != end:
                cut[a - 1] = False
            cut[a] = True
            if b < len(cut):
                cut[b] = True
            at = end = b

    def _chunk(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows one after the other, and how many each row has."""
        cut = np.zeros(len(buf), bool)
        cut[:-1] = SPACE[buf[:-1]] & _BEGINS[buf[1:]]
        cut[offsets[offsets > 0] - 1] = False  # what follows the last byte of a row is another text
        cut[offsets[:-1][offsets[:-1] < len(buf)]] = True
        self._cut_added(buf, offsets, cut)
        at = np.append(np.flatnonzero(cut), len(buf))
        pieces = pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(buf))]).dictionary_encode()
        if len(self.known) + len(pieces.dictionary) > self.most:
            self.forget()
        distinct, known = pieces.dictionary.to_pylist(), self.known
        self._learn([p for p in distinct if p not in known])
        place = np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))
        of = place[pieces.indices.to_numpy()]
        n = self.n[of]
        ends = np.cumsum(n)
        ids = self.ids[np.repeat(self.begins[of] - ends + n, n) + np.arange(int(n.sum()))]
        return ids, np.diff(np.append(0, ends)[np.searchsorted(at, offsets)])

    def column(self, column):
        """(first row, ids, ids per row) of runs of rows; null counts as empty."""
        buf, offsets = column_bytes(column)
        for i, j in spans(offsets, 1 << 22):
            if offsets[j] == offsets[i]:
                yield i, np.zeros(0, np.uint32), np.zeros(j - i, np.int64)
            else:
                yield i, *self._chunk(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def default_paths() -> tuple[str, str]:
    """Ranks and JSON file of the public 50k byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


_HELD: dict[tuple[str, str], Encoder] = {}


def encoder(ranks_path: str, json_path: str) -> Encoder:
    """One encoder per worker process."""
    key = (ranks_path, json_path)
    if key not in _HELD:
        _HELD[key] = Encoder(*key)
    return _HELD[key]
