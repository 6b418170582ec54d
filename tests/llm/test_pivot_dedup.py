import random
import re

import numpy as np
import xxhash

from rowtide.llm.pivot_dedup import PivotTable, keep_first, links, near_duplicates
from rowtide.llm.components import components


def plain_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, radius):
    up = {i: i for i in range(len(ids))}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                up[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [least.get(root(i)) for i in range(len(ids))]


def check(spark, documents, rows):
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in near_duplicates(documents(rows)).collect()), key=repr)
    prints = [plain_print(t) for _, t in rows]
    want = plain_components([d for d, _ in rows], prints, 3)
    assert got == sorted(((d, f"{p:016x}", c) for (d, _), p, c in zip(rows, prints, want, strict=True)), key=repr)


def test_whole_table_equals_brute_force(spark, documents, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(spark, documents, rows)


def test_edges(spark, documents):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(5, None), (3, ""), (9, " \n\t"), (4, "One"), (8, "one"), (8, "one"), (7, "ONE two"), (1, long), (2, long + " x"), (None, "one"), (None, "lonely words here now"), (6, "é É x\x0by")]
    check(spark, documents, rows)
    assert near_duplicates(documents([])).count() == 0


def test_links_in_blocks_lose_nothing(spark):
    rnd = random.Random(5)
    prints = set()
    for _ in range(40):
        seed = rnd.getrandbits(64)
        for _ in range(30):
            prints.add(seed)
            seed ^= sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(1, 6)))
            seed &= (1 << 64) - 1
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    table = spark.createDataFrame([(p,) for p in signed], "fp long").repartition(5)
    want = plain_components(signed, prints, 3)
    for most in (4, 1 << 16):
        found = {r["node"]: r["component"] for r in components(links(table, PivotTable(), most)).collect()}
        assert [found.get(p, p) for p in signed] == want


def test_pivot_coordinates_are_distances_inside_the_band():
    table, rnd = PivotTable(), random.Random(1)
    fps = np.array([rnd.getrandbits(64) for _ in range(50)], np.uint64)
    for band, (low, high) in enumerate(table.bands):
        inner = ((1 << (high - low)) - 1) << low
        want = [[((int(f) & inner) ^ (((1 << i) - 1) << low)).bit_count() for i in range(high - low + 1)] for f in fps]
        assert table.band_coordinates(fps, band).tolist() == want


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 220)] + [(500, 500 + i) for i in range(1, 80)] + [(7, 7)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 100 for i in range(100, 221)} | {500 + i: 500 for i in range(80)}


def test_keep_first_keeps_one_of_each_component(spark, documents):
    text = "a b c d e f g h i j"
    rows = [(4, text), (2, text.upper()), (2, text), (9, "quite another text here"), (None, text)]
    got = keep_first(documents(rows))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted([(2, text.upper()), (9, rows[3][1]), (None, text)], key=repr)


def test_keep_first_goes_by_component_not_by_id(spark, documents):
    one, two = "a b c d e f g h i j", "quite another text here"
    rows = [(2, one), (2, two), (3, one.upper()), (5, two.upper()), (7, "third"), (None, "third"), (None, "lonely words"), (None, "lonely words"), (None, "LONELY words"), (8, None), (None, "")]
    # all that has an id: one row for each component, also where two share an id
    got = sorted(((r["doc_id"], r["text"]) for r in keep_first(documents(rows)).where("doc_id is not null").collect()), key=repr)
    assert got == sorted([(2, one), (2, two), (7, "third"), (8, None)], key=repr)
    got = sorted(((r["doc_id"], r["text"]) for r in keep_first(documents(rows), spare_no_id=False).collect()), key=repr)
    assert got == sorted([(2, one), (2, two), (7, "third"), (8, None), (None, "LONELY words")], key=repr)


def test_keep_first_of_repeated_ids_equals_brute_force(spark, documents):
    rnd, base = random.Random(3), [" ".join(f"w{i}x{k}" for k in range(60)) for i in range(12)]
    rows = []
    for _ in range(160):
        words = rnd.choice(base).split()
        if rnd.random() < 0.5:
            words[rnd.randrange(60)] = "other"
        rows.append((rnd.choice([None, 1, 2, 3, 4, 5]), " ".join(words)))
    prints, want = [plain_print(t) for _, t in rows], {}
    group = plain_components(list(range(len(rows))), prints, 3)
    for (d, t), g in zip(rows, group, strict=True):
        want[g] = min(want.get(g, (2, 0, "")), (d is None, d or 0, t))
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in keep_first(documents(rows), spare_no_id=False).collect())
    assert got == sorted(want.values())


def test_pipeline_drops_copies_without_id(spark, documents):
    import corpus_pipeline

    rows = [(1, "one two three four"), (None, "one two three four"), (None, "five six seven"), (None, "five six seven")]
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    got = sorted(((r["doc_id"], r["text"]) for r in stage(spark, documents(rows), "").collect()), key=repr)
    assert got == sorted([(1, "one two three four"), (None, "five six seven")], key=repr)
