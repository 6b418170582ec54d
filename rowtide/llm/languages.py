"""Language identification by mixtures (operator 2): each document is a mixture of languages over its words."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from rowtide.llm.texts import column_bytes, spans

#: Hash buckets of letter trigrams, and how many of them travel in one row while counts are added up.
BUCKETS, BLOCK = 1 << 16, 1 << 12
UNKNOWN = "und"

#: Bytes of words: ASCII letters and everything beyond ASCII. Texts are lower-cased first.
_LETTER = np.zeros(256, bool)
_LETTER[0x61:0x7B] = _LETTER[0x80:] = True


def trigrams(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all letters, and the bucket of each one with its two neighbours. Rows don't touch each other."""
    letter = _LETTER[buf]
    wide = np.full(len(buf) + 2, 0x20, np.uint32)
    wide[1:-1] = np.where(letter, buf, 0x20)
    before, after = wide[:-2].copy(), wide[2:].copy()
    inner = offsets[(offsets > 0) & (offsets < len(buf))]
    before[inner], after[inner - 1] = 0x20, 0x20
    at = np.flatnonzero(letter)
    mixed = before[at] * np.uint32(0x9E3779B1) + wide[1:-1][at] * np.uint32(0x85EBCA77) + after[at] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    return at, (mixed * np.uint32(0x27D4EB2F)) >> np.uint32(16)


class Model(NamedTuple):
    """Log-probabilities of trigram buckets, one column per language."""

    langs: list[str]
    logp: np.ndarray


def learn(labelled: DataFrame) -> Model:
    """Counts of trigrams by language over all rows (lang, text) whose lang isn't null.

    Each task adds up its own rows; then counts are added in blocks of buckets. The driver gets ``BUCKETS`` numbers
    per language, whatever the size of the corpus.
    """

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            lang = np.array(batch.column(0).to_pylist(), object)
            buf, offsets = column_bytes(pc.utf8_lower(batch.column(1)))
            for i, j in spans(offsets, 1 << 20):
                own = offsets[i : j + 1] - offsets[i]
                at, bucket = trigrams(buf[offsets[i] : offsets[j]], own)
                edges = np.searchsorted(at, own)
                names, which = np.unique(lang[i:j], return_inverse=True)
                which = np.repeat(which, np.diff(edges))
                for k, name in enumerate(names):
                    sums[name] = sums.get(name, 0) + np.bincount(bucket[which == k], minlength=BUCKETS)
        rows = [(name, b, total[b * BLOCK : (b + 1) * BLOCK].astype("<i8").tobytes()) for name, total in sums.items() for b in range(BUCKETS // BLOCK)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.binary()), strict=True)], ["lang", "block", "counts"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.int64)
        for counts in table.column("counts"):
            total += np.frombuffer(counts.as_py(), "<i8")
        return pa.table([pa.array([key[0].as_py()], pa.string()), pa.array([key[1].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["lang", "block", "counts"])

    schema = "lang string, block int, counts binary"
    rows = labelled.select("lang", "text").where("lang is not null and text is not null").mapInArrow(count, schema).groupBy("lang", "block").applyInArrow(add, schema).collect()
    langs = sorted({r["lang"] for r in rows})
    counts = np.zeros((BUCKETS, len(langs)))
    for r in rows:
        counts[r["block"] * BLOCK : (r["block"] + 1) * BLOCK, langs.index(r["lang"])] = np.frombuffer(r["counts"], "<i8")
    smooth = counts + 0.5
    return Model(langs, np.log(smooth / smooth.sum(axis=0)).astype(np.float32))


def _mixtures(like: np.ndarray, first: np.ndarray, count: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of languages in each document by expectation-maximisation, and its log-likelihood above the base.

    ``like`` has a row per word (likelihoods, the largest is 1); a document has ``count`` words from ``first`` on.
    """
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        part = like * np.repeat(share, count, axis=0)
        part /= np.maximum(part.sum(axis=1, keepdims=True), 1e-300)
        share = np.add.reduceat(part, first, axis=0) / count[:, None]
    total = np.log(np.maximum((like * np.repeat(share, count, axis=0)).sum(axis=1), 1e-300))
    return share, np.add.reduceat(total, first)


def infer(model: Model, buf: np.ndarray, offsets: np.ndarray, strength: float, rounds: int) -> list[list[tuple[str, float]]]:
    """For each text the selected languages with their proportions, largest first; nothing if it has no word.

    The set grows along the ranking of a mixture over all languages, and is the one with the largest log-likelihood
    less ``strength`` * log(words) / 2 for each language beyond the first.
    """
    at, bucket = trigrams(buf, offsets)
    out: list[list[tuple[str, float]]] = [[] for _ in range(len(offsets) - 1)]
    if not len(at):
        return out
    starts = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1]) | np.isin(at, offsets))
    words = np.add.reduceat(model.logp[bucket], starts, axis=0).astype(np.float64)
    counts = np.diff(np.searchsorted(at[starts], offsets))
    docs = np.flatnonzero(counts)
    count = counts[docs]
    first = np.cumsum(count) - count
    top = words.max(axis=1, keepdims=True)
    like, alone = np.exp(words - top), np.add.reduceat(words - top, first, axis=0)
    n, k = len(docs), len(model.langs)
    share, full = _mixtures(like, first, count, np.ones((n, k)), rounds)
    best, chosen = alone.max(axis=1), np.zeros((n, k), bool)
    chosen[np.arange(n), alone.argmax(axis=1)] = True
    price = strength * np.log(count + 1) / 2
    shares = np.where(chosen, share, 0.0)
    open_docs = np.flatnonzero(full - best > price)  # no set can gain more than all languages do
    ranking = np.argsort(-share, axis=1, kind="stable")
    for size in range(2, k + 1):
        open_docs = open_docs[full[open_docs] - (size - 1) * price[open_docs] > best[open_docs]]
        if not len(open_docs):
            break
        allowed = np.zeros((len(open_docs), k))
        np.put_along_axis(allowed, ranking[open_docs, :size], 1.0, axis=1)
        rows = np.repeat(first[open_docs] - np.cumsum(count[open_docs]) + count[open_docs], count[open_docs]) + np.arange(int(count[open_docs].sum()))
        own = np.cumsum(count[open_docs]) - count[open_docs]
        got, value = _mixtures(like[rows], own, count[open_docs], allowed, rounds)
        value = value - (size - 1) * price[open_docs]
        better = value > best[open_docs]
        best[open_docs[better]], shares[open_docs[better]] = value[better], got[better]
    for d, row in zip(docs.tolist(), shares, strict=True):
        out[d] = sorted(((model.langs[i], float(row[i])) for i in np.flatnonzero(row > 0)), key=lambda x: (-x[1], x[0]))
    return out


def held_out(doc_id) -> F.Column:
    """True for a third of the documents, by their id alone; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def identify(docs: DataFrame, model: Model, strength: float = 6.0, rounds: int = 8) -> DataFrame:
    """(doc_id, lang_pred, score, mixture), one row per row of ``docs``, from whole texts alone.

    lang_pred is the language with the largest proportion in the selected set, score its proportion in the mixture of
    all languages, mixture the selected set with its proportions. A text that is null or has no letter, and any text if the model knows no
    language, gives ``und``, score 0 and an empty mixture. Ties go to the first name. Repeated rows are judged alike, an empty table gives no
    rows, other columns are ignored.
    """
    schema = "doc_id long, lang_pred string, score double, mixture array<struct<lang:string,share:double>>"
    kinds = [pa.int64(), pa.string(), pa.float64(), pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))]

    def run(batches):
        for batch in batches:
            text = pc.fill_null(batch.column(1), "")
            spoken = pc.match_substring_regex(text, r"\p{L}").to_numpy(zero_copy_only=False)
            buf, offsets = column_bytes(pc.utf8_lower(text))
            found: list[list[tuple[str, float]]] = []
            for i, j in spans(offsets, 1 << 18):
                found += infer(model, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], strength, rounds) if model.langs else [[]] * (j - i)
            found = [x if ok else [] for x, ok in zip(found, spoken, strict=True)]
            names = [x[0][0] if x else UNKNOWN for x in found]
            scores = [min(max(x[0][1], 0.0), 1.0) if x else 0.0 for x in found]
            mixtures = [[{"lang": a, "share": b} for a, b in x] for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([batch.column(0), names, scores, mixtures], kinds, strict=True)], ["doc_id", "lang_pred", "score", "mixture"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def predict(docs: DataFrame) -> DataFrame:
    """Learn from the documents that aren't held out and have a lang, and identify all: doc_id, held_out, lang_pred, score, mixture."""
    model = learn(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "mixture")
