"""Document fingerprints (operator 8): SimHash of weighted terms, and permuted block tables that find near ones."""

from __future__ import annotations

import hashlib
from functools import reduce
from itertools import combinations
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rowtide.llm.batches import NO_ID, doc_batches, id_bounds, placed
from rowtide.llm.texts import bit_votes, column_bytes, mix64, span_hashes, spans, word_bounds
from rowtide.session import scratch_path

BITS = 128
#: Weights: a short word (up to 4 bytes), a longer one, and two words in a row, which tell texts apart best.
SHORT, LONG, PAIR = 1, 2, 6

_STEP = 1 << 19


def simhash128(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Two unsigned 64-bit halves per row. Each term votes with its weight for the set bits of its hash and against the others."""
    starts, ends, counts = word_bounds(buf, offsets)
    hashes = span_hashes(buf, starts, ends)
    row = np.repeat(np.arange(len(counts)), counts)
    long = (ends - starts) > 4
    twin = np.flatnonzero(row[1:] == row[:-1]) if len(row) else np.zeros(0, np.int64)
    pairs = mix64(hashes[twin] * np.uint64(3) + hashes[twin + 1] * np.uint64(0xD6E8FEB86659FD93)) if len(twin) else np.zeros(0, np.uint64)
    out = np.zeros((len(counts), 2), np.uint64)
    for half in range(2):
        votes = np.zeros((len(counts), 64), np.int64)
        for weight, terms, own in ((SHORT, hashes[~long], row[~long]), (LONG, hashes[long], row[long]), (PAIR, pairs, row[twin] if len(twin) else twin)):
            n = np.bincount(own, minlength=len(counts))
            salted = mix64(terms + np.uint64(half + 1))
            votes += weight * (2 * bit_votes(salted, n) - n[:, None])
        out[:, half] = np.packbits(votes > 0, axis=1, bitorder="little").view("<u8").ravel()
    return out


def prints_of(texts: list[str]) -> np.ndarray:
    """Fingerprints of texts, in runs of bounded size."""
    buf, offsets = column_bytes(pa.array(texts, pa.large_string()))
    out = np.zeros((len(texts), 2), np.uint64)
    for i, j in spans(offsets, _STEP):
        out[i:j] = simhash128(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of two texts' weighted terms as the share of equal bits estimates it; 0 for unrelated texts, 1 for equal fingerprints."""
    apart = np.bitwise_count(a ^ b).sum(axis=1)
    return np.clip(np.cos(np.pi * apart / BITS), 0.0, 1.0)


def _hex(prints: np.ndarray) -> list[str]:
    return [f"{a:016x}{b:016x}" for a, b in prints.tolist()]


_ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint(docs: DataFrame, batch_bytes: int = 8 << 20) -> DataFrame:
    """One row per row of ``docs``: fingerprints of its text and of its edited text, and how alike they are.

    The next document follows in descending doc_id, after the last comes the first; rows that share a doc_id follow each
    other by text, descending; a null doc_id counts as the largest. In the edited text the last third of the code points gives way to the
    first as many of the next document, or all it has. Null text counts as empty: fingerprint of zeros. One row is its
    own next document. An empty table gives no rows; other columns are ignored.

    Documents come in batches by ranges of doc_id; the one document that a batch needs from its neighbour is sent along.
    """
    chosen = docs.select("doc_id", "text")
    bounds = id_bounds(chosen, batch_bytes)
    batched, _ = doc_batches(chosen, batch_bytes, bounds)
    tops = sorted((r["batch"], r["top"]) for r in batched.groupBy("batch").agg(F.max("doc_id").alias("top")).collect())
    batches = [b for b, _ in tops]
    heirs = np.array(batches[1:] + batches[:1], np.int32)
    highest = np.array([t for _, t in tops], np.int64)
    sent = batched.withColumn("_heir", placed(highest, heirs)("doc_id"))
    copies = F.filter(F.array(F.struct(F.col("batch").alias("to"), F.lit(False).alias("sent")), F.struct(F.col("_heir").alias("to"), F.lit(True).alias("sent"))), lambda c: c["to"] >= 0)
    rows = sent.select("doc_id", "text", F.explode(copies).alias("c")).select("doc_id", "text", F.col("c.to").alias("to"), F.col("c.sent").alias("sent"))

    def judge(key: tuple, table: pa.Table) -> pa.Table:
        ids, texts, sent = table.column("doc_id").to_pylist(), [x or "" for x in table.column("text").to_pylist()], table.column("sent").to_pylist()
        order = sorted(range(len(ids)), key=lambda k: (not sent[k], ids[k], texts[k]))
        while len(order) > 1 and sent[order[1]]:  # of several with the neighbour's largest id, the last is next
            order.pop(0)
        texts = [texts[k] for k in order]
        edited = [a[: len(a) - len(a) // 3] + b[: len(a) // 3] for b, a in zip(texts, texts[1:], strict=False)]
        prints, others = prints_of(texts), prints_of(edited)
        own, after = prints[1:], prints[:-1]
        real = [None if ids[k] == NO_ID else ids[k] for k in order[1:]]
        columns = [
            pa.array(real, pa.int64()), pa.array([len(x) for x in texts[1:]], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
            pa.array(_hex(own), pa.string()), pa.array(_hex(others), pa.string()), pa.array(likeness(own, others)), pa.array(likeness(own, after)),
        ]
        return pa.table(columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return rows.groupBy("to").applyInArrow(judge, _ROW)


def _halves(fp: Column) -> list[Column]:
    """A hex fingerprint as signed 64-bit numbers, high half first."""
    return [F.conv(F.substring(fp, 1 + 16 * i, 16), 16, -10).cast("long") for i in range(BITS // 64)]


def near(queries: DataFrame, index: DataFrame, radius: int = 3, blocks: int = 4) -> DataFrame:
    """All pairs (query, fingerprint, apart) of distinct fingerprints within ``radius`` bits; both sides have a column fp.

    The bits are cut into ``blocks``; of two fingerprints within the radius, ``blocks - radius`` agree. Each choice of them
    is a table whose rows have these blocks moved to the front; a query meets the rows with the same front. Fingerprints are
    two numbers and a front is one, with the table's number in it: rows are 24 bytes, whatever plan joins them. A pair
    comes from the first table that holds it, so there is nothing to make distinct.
    """
    if not 0 <= radius < blocks <= BITS // 4:
        raise ValueError("0 <= radius < blocks <= 32 must hold")
    cuts = [BITS // 4 * i // blocks * 4 for i in range(blocks + 1)]
    choices = list(combinations(range(blocks), blocks - radius))

    def block(high: Column, low: Column, i: int) -> Column:
        """Bits from cuts[i] to cuts[i + 1], counted from the highest."""
        a, b, out = cuts[i], cuts[i + 1], F.lit(0).cast("long")
        for half, (start, end) in ((high, (a, min(b, 64))), (low, (max(a, 64), b))):
            if end > start:
                part = F.shiftrightunsigned(half, 64 - (end - 1) % 64 - 1).bitwiseAND((1 << (end - start)) - 1 if end - start < 64 else -1)
                out = F.shiftleft(out, end - start).bitwiseOR(part)
        return out

    def front(high: Column, low: Column, number: int) -> Column:
        return F.xxhash64(F.lit(number), *[block(high, low, i) for i in choices[number]])

    def tables(df: DataFrame, side: str) -> DataFrame:
        high, low = _halves(F.col("fp"))
        rows = df.select(high.alias(f"{side}_high"), low.alias(f"{side}_low")).distinct()
        fronts = F.array(*[front(F.col(f"{side}_high"), F.col(f"{side}_low"), k) for k in range(len(choices))])
        return rows.select("*", F.explode(fronts).alias("front"))

    q, x = [F.col("q_high"), F.col("q_low")], [F.col("x_high"), F.col("x_low")]
    apart = sum((F.bit_count(a.bitwiseXOR(b)) for a, b in zip(q, x, strict=True)), F.lit(0))
    met = tables(queries, "q").join(tables(index, "x"), "front").where(apart <= radius)
    # blocks that agree, highest table first: the pair counts where its front is that of the first choice that agrees
    same = [F.when(reduce(and_, [block(*q, i) == block(*x, i) for i in c]), front(*q, k)) for k, c in enumerate(choices)]
    met = met.where(F.col("front") == F.coalesce(*same))
    text = lambda parts: F.concat(*[F.lpad(F.lower(F.hex(p)), 16, "0") for p in parts])
    return met.select(text(q).alias("query"), text(x).alias("fingerprint"), apart.alias("apart"))


def fingerprint_and_search(docs: DataFrame, every: int = 100, radius: int = 6, blocks: int = 8, batch_bytes: int = 8 << 20) -> DataFrame:
    """The rows of ``fingerprint``, and n_near: for documents whose id is divisible by ``every``, how many other rows lie within ``radius`` bits.

    One replaced word moves 3.5 bits on average: the README gives the share of planted near copies that a radius finds.
    """
    spark = docs.sparkSession
    place = scratch_path(spark, "fingerprints")
    fingerprint(docs, batch_bytes).write.parquet(place)
    rows = spark.read.parquet(place)
    counts = rows.groupBy(F.col("fingerprint").alias("fp")).agg(F.count("*").alias("n"))
    asked = rows.where(F.col("doc_id") % every == 0).select(F.col("fingerprint").alias("fp"))
    found = near(asked, counts, radius, blocks).join(counts, F.col("fingerprint") == F.col("fp")).groupBy("query").agg(F.sum("n").alias("n"))
    chosen = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))  # the others need no partner and aren't moved
    joined = rows.where(chosen).join(found, F.col("fingerprint") == F.col("query"), "left").select(*rows.columns, (F.col("n") - 1).alias("n_near"))
    return joined.unionByName(rows.where(~chosen).withColumn("n_near", F.lit(None).cast("long")))
