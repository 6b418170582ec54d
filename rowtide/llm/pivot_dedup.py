"""SimHash near-dedup by pivot distance tables (operator 1)."""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from rowtide.llm.components import UnionFind, components
from rowtide.llm.texts import bit_votes, column_bytes, mix64, pack_bits, spans
from rowtide.session import scratch_path, stable

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BITS = 64


def shingle_hashes(text: bytes, width: int = 3, seed: int = 42) -> list[int]:
    """XXH64 of every run of ``width`` words, A-Z lower-cased, joined by one space; fewer words: of all words; none: nothing."""
    words = text.translate(_LOWER).split()
    if not words:
        return []
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return [digest(line, seed)]
    ends = list(accumulate((len(w) + 1 for w in words), initial=0))
    return [digest(line[a : b - 1], seed) for a, b in zip(ends, ends[width:], strict=False)]


def simhash64(column, width: int = 3) -> np.ndarray:
    """Fingerprint of every row of an Arrow text column: a bit is set if more than half of the shingle hashes set it."""
    buf, offsets = column_bytes(column)
    out = np.zeros(len(offsets) - 1, np.uint64)
    for i, j in spans(offsets, 1 << 20):
        lists = [shingle_hashes(buf[offsets[k] : offsets[k + 1]].tobytes(), width) for k in range(i, j)]
        counts = np.fromiter(map(len, lists), np.int64, j - i)
        hashes = np.fromiter((h for x in lists for h in x), np.uint64, int(counts.sum()))
        out[i:j] = pack_bits(2 * bit_votes(hashes, counts) > counts[:, None])
    return out


def fingerprints(docs: DataFrame, width: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint as a signed 64-bit number), one row per row of ``docs``. Null text counts as empty: zero."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(simhash64(batch.column(1), width).view(np.int64))], ["doc_id", "fp"])

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, fp long")


class PivotTable:
    """Hamming distances to reference fingerprints, laid out so that a few of them point to near fingerprints.

    The bits are cut into bands. References come in pairs that agree inside one band, where they are a thermometer code
    (the first 0, 1, 2, ... bits set), and are opposite outside of it. The distances to the two add up to twice the
    distance inside the band plus a constant, so a pair gives a coordinate that only flips inside its band can move,
    and each flip moves it by at most one. Two fingerprints within ``radius`` differ in at most ``radius`` bands: in at
    least ``bands - radius`` bands all coordinates differ by zero. Fingerprints are brought together by these, one table
    for each choice of bands. Then pairs with any of ``n_refs`` further distances more than ``radius`` apart are
    discarded (the triangle inequality), and what is left is verified bit by bit.
    """

    def __init__(self, radius: int = 3, bands: int = 5, n_refs: int = 16):
        if not 0 <= radius < bands <= BITS:
            raise ValueError("0 <= radius < bands <= 64 must hold")
        cuts = [BITS * i // bands for i in range(bands + 1)]
        self.radius, self.bands = radius, list(zip(cuts, cuts[1:], strict=False))
        self.choices = list(combinations(range(bands), bands - radius))
        if any(sum(self.bands[i][1] - self.bands[i][0] for i in c) + len(self.choices).bit_length() > 63 for c in self.choices):
            raise ValueError("keys wouldn't fit 63 bits: take more bands")
        self.refs = mix64(np.arange(1, n_refs + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def band_coordinates(self, fps: np.ndarray, band: int) -> np.ndarray:
        """Distances inside a band to its thermometer codes, from the distances to the pairs of whole references."""
        low, high = self.bands[band]
        mask = ((1 << high) - 1) ^ ((1 << low) - 1)
        every = (1 << BITS) - 1
        codes = np.array([((1 << (low + i)) - 1) & mask for i in range(high - low + 1)], np.uint64)
        one = np.bitwise_count(fps[:, None] ^ codes).astype(np.int16)
        two = np.bitwise_count(fps[:, None] ^ (codes | np.uint64(every ^ mask))).astype(np.int16)
        return (one + two - (BITS - (high - low))) // 2

    def keys(self, fps: np.ndarray) -> list[np.ndarray]:
        """For each choice of bands, a number that is equal exactly if all coordinates of these bands are equal.

        Neighbouring codes differ by one bit, so coordinates rise or fall by one: the falls tell the whole row.
        """
        falls = []
        for band in range(len(self.bands)):
            steps = np.diff(self.band_coordinates(fps, band), axis=1) < 0
            falls.append((steps.astype(np.int64) << np.arange(steps.shape[1])).sum(axis=1))
        out = []
        for number, choice in enumerate(self.choices):
            key = np.full(len(fps), number, np.int64)
            for band in choice:
                low, high = self.bands[band]
                key = (key << (high - low)) | falls[band]
            out.append(key)
        return out

    def distances(self, fps: np.ndarray) -> np.ndarray:
        """One row per reference: distances of all fingerprints to it."""
        return np.bitwise_count(fps[None, :] ^ self.refs[:, None]).astype(np.int16)

    def forest(self, groups: np.ndarray, fps: np.ndarray) -> list[tuple[int, int]]:
        """Pairs of positions that link each group as all its links within the radius would, without cycles.

        Rows are sorted by group and first distance. Step s compares each row with the one s places on, as long as
        that is in the group and within the radius by the first distance; pairs that hang together already are
        skipped, then every further distance discards, then the bits decide. Memory is that of the rows.
        """
        first = np.bitwise_count(fps ^ self.refs[0]).astype(np.int16)
        order = np.lexsort((first, groups))
        group, fp, table = groups[order], fps[order], self.distances(fps[order])
        found, sets, edges = np.arange(len(order)), UnionFind(len(order)), []
        left, step = np.arange(len(order) - 1), 1
        while len(left):
            left = left[left + step < len(order)]
            right = left + step
            near = (group[left] == group[right]) & (table[0][right] - table[0][left] <= self.radius)
            left, right = left[near], right[near]
            apart = found[left] != found[right]
            x, y = left[apart], right[apart]
            for row in table[1:]:
                if not len(x):
                    break
                keep = np.abs(row[x] - row[y]) <= self.radius
                x, y = x[keep], y[keep]
            linked = np.bitwise_count(fp[x] ^ fp[y]) <= self.radius
            joined = False
            for a, b in zip(x[linked].tolist(), y[linked].tolist(), strict=True):
                if sets.join(a, b):
                    edges.append((int(order[a]), int(order[b])))
                    joined = True
            if joined:
                up = np.array(sets.up)
                while not np.array_equal(up, up[up]):
                    up = up[up]
                found = up
            step += 1
        return edges


def links(prints: DataFrame, table: PivotTable, most: int = 1 << 16) -> DataFrame:
    """Links (a, b) between distinct fingerprints, column fp, that give the same components as all pairs within the radius.

    A group of more than ``most`` rows that share a key is cut into blocks and compared block against block, in tasks
    of their own: no pair is lost, and no task holds more than two blocks of a group.
    """

    def keyed(batches):
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for key in table.keys(fps):
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column("fp")], ["key", "fp"])

    rows = prints.select("fp").mapInArrow(keyed, "key long, fp long")
    large = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most)
    blocks = F.ceil(F.col("n") / most).cast("int")
    mine = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    cut = (
        rows.join(large, "key", "left")
        .withColumn("other", F.explode(F.when(F.col("n").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), blocks - 1))))
        .select("key", "fp", F.least(F.coalesce(mine, F.lit(0)), "other").alias("i"), F.greatest(F.coalesce(mine, F.lit(0)), "other").alias("j"))
    )

    def compare(batches):
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        part = pa.Table.from_batches(tables)
        key, i, j = (part.column(c).to_numpy() for c in ("key", "i", "j"))
        groups = np.unique(np.stack([key, i.astype(np.int64), j.astype(np.int64)], axis=1), axis=0, return_inverse=True)[1].ravel() if i.any() or j.any() else np.unique(key, return_inverse=True)[1]
        fp = part.column("fp").to_numpy()
        pairs = np.array(table.forest(groups, fp.view(np.uint64)), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(fp[pairs[:, 0]]), pa.array(fp[pairs[:, 1]])], ["a", "b"])

    return cut.repartition("key", "i", "j").mapInArrow(compare, "a long, b long")


def _components(docs: DataFrame, width: int, radius: int, bands: int, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Written rows (doc_id, fp), and a row (fp, least, component, component_id) for each distinct fingerprint.

    least is the smallest doc_id of the fingerprint, component_id that of its component; both are null without any.
    component is the smallest fingerprint in reach, so it also tells components apart that share a doc_id or have none.
    """
    spark = docs.sparkSession
    place = scratch_path(spark, "simhash")
    fingerprints(docs, width, doc_id, text).write.parquet(place)
    prints = spark.read.parquet(place)
    nodes = stable(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    named = nodes.join(components(links(nodes.select("fp"), PivotTable(radius, bands))).withColumnRenamed("node", "fp"), "fp", "left")
    named = named.select("fp", "least", F.coalesce("component", "fp").alias("component"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints, named.join(smallest, "component").select("fp", "least", "component", "component_id")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3, bands: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one per row of ``docs``.

    Fingerprints of equal value are linked, and those at ``radius`` or fewer differing bits. component_id is the
    smallest doc_id in reach. Equal fingerprints are one node, so copies cost one row each and no pair. A null text
    counts as empty and has fingerprint zero; a null doc_id keeps its row and never names a component (the component of
    rows that all lack a doc_id is null); repeated rows stay. An empty table gives no rows. Other columns are ignored.
    """
    prints, named = _components(docs, width, radius, bands, doc_id, text)
    of = named.select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, width: int = 3, radius: int = 3, bands: int = 5, spare_no_id: bool = True) -> DataFrame:
    """One row of each component stays, the one with the least (doc_id, text); columns as given.

    Components are told apart by their fingerprints: unrelated texts under one doc_id each stay. A null doc_id comes
    last. With ``spare_no_id``, rows without doc_id stay as they are and only the others are counted; else they are
    copies like any others, and one of them stays where no row of the component has a doc_id.

    Other columns, whatever their names and types, pass through; a very long text takes memory in proportion to it.

    Small tables say which (doc_id, fingerprint) a component is left to; only rows of these are moved, and the rank
    filter leaves one row of a component in each input partition.
    """

    @F.arrow_udf("long")
    def simhash(texts: pa.Array) -> pa.Array:
        return pa.array(simhash64(texts, width).view(np.int64))

    _, named = _components(docs, width, radius, bands)
    first = named.where("least = component_id" if spare_no_id else "least <=> component_id")
    first = first.select("fp", F.coalesce("least", F.lit(0)).alias("least"), F.col("least").isNull().alias("no_id"), "component")
    given = docs.where("doc_id is not null") if spare_no_id else docs
    doc_id = F.col("doc_id").cast("long")
    rows = given.select(  # the print is not computed again in a pushed filter
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), simhash.asNondeterministic()(F.col("text").cast("string")).alias("fp"),
        F.coalesce(doc_id, F.lit(0)).alias("least"), doc_id.isNull().alias("no_id"),
    )
    nth = F.row_number().over(Window.partitionBy("component").orderBy(F.col("row.text").asc_nulls_first()))
    kept = rows.join(first, ["fp", "least", "no_id"]).withColumn("nth", nth).where("nth = 1").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
    return kept.unionByName(docs.where("doc_id is null")) if spare_no_id else kept
