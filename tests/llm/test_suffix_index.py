import hashlib
import random

import numpy as np
from rowtide.llm import suffix_index
from rowtide.llm.batches import split_batches
from rowtide.llm.suffix_index import Levels, drop_repeats, removed_spans


def plain(rows, length=50):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            if d is not None:
                first[s] = min(first.get(s, d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            f = first.get(b[i : i + length])
            if f is not None and (d is None or f < d):
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = len([x for x in bytes(gone).split(b"\0") if x])
        out.append((d, len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def run(docs, **options):
    return sorted((tuple(r) for r in removed_spans(docs, **options).collect()), key=repr)


def test_whole_table_equals_brute_force(spark, documents, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert run(documents(rows)) == plain(rows)


def test_edges(spark, documents):
    same = "x" * 300
    para = "Ünïcödé passage that many documents share, with more than fifty bytes in it. "
    long = "".join(random.Random(3).choices("abcdefgh ", k=1_300_000))
    rows = [(5, None), (3, ""), (9, same), (4, same + "y"), (8, "q" + para + same), (8, "q" + para + same), (7, "z" + para), (None, para + "none"), (None, para + "none"), (2, "a" * 49), (1, "a" * 49), (20, "b" * 50), (21, "b" * 50), (22, "c" + "b" * 51), (30, long), (31, "head " + long[600_000:] + para)]
    for options in ({}, {"batch_bytes": 2000, "gram": 50}):
        assert run(documents(rows), **options) == plain(rows)
    assert run(documents([])) == []


def test_random_texts_with_shared_parts(spark, documents):
    rnd = random.Random(11)
    pool = ["".join(rnd.choices("abc ", k=rnd.randrange(30, 160))) for _ in range(12)]
    rows = [(rnd.randrange(200), "".join(rnd.choice(pool)[rnd.randrange(20) :] for _ in range(rnd.randrange(6)))) for _ in range(120)]
    assert run(documents(rows), batch_bytes=2000) == plain(rows)


def test_levels_grow_geometrically():
    levels, rnd, seen = Levels(), np.random.default_rng(2), set()
    for n in range(40):
        values = np.unique(rnd.integers(0, 5000, 100).astype(np.uint64))
        owner = levels.scan(values)
        assert [o >= 0 for o in owner] == [int(v) in seen for v in values]
        fresh = owner < 0
        levels.add(values[fresh], np.full(int(fresh.sum()), n))
        seen |= set(values.tolist())
        sizes = [len(v) for v, _ in levels.arrays]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))


def test_drop_repeats(spark, documents):
    para = "A passage that two documents share, which has well over fifty bytes in all. "
    docs = documents([(1, "one " + para), (2, "two " + para + "end é"), (3, para), (4, None), (5, "short"), (6, "  ")])
    got = drop_repeats(docs)
    assert got.columns == docs.columns
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in got.collect()} == {
        1: ("one " + para, 4 + len(para)), 2: ("twoend é", 8), 4: (None, 0), 5: ("short", 5), 6: ("  ", 2),
    }


def test_texts_are_shuffled_once(spark, sf):
    got = removed_spans(spark.read.parquet(f"{sf}/documents.parquet"))
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("ReusedExchange") >= 2


def shared_parts(ids, n, seed):
    rnd = random.Random(seed)
    pool = ["".join(rnd.choices("abcdefg ", k=rnd.randrange(30, 400))) for _ in range(15)]
    return [(rnd.choice(ids), "".join(rnd.choice(pool)[rnd.randrange(20) :] for _ in range(rnd.randrange(5)))) for _ in range(n)]


def test_strings_of_hot_samples_go_one_by_one(spark, documents):
    line = "a line in all documents, "  # longer than a gram, shorter than a string
    rnd = random.Random(4)
    rows = shared_parts(range(100), 80, 5) + [(200 + i, "".join(rnd.choices("xyz", k=8)) + line + "".join(rnd.choices("xyz", k=22))) for i in range(60)]
    rows += [(900, "w" * 9000), (901, "w" * 700 + "v" * 90)]
    for hot in (0, 500):
        assert run(documents(rows), batch_bytes=1500, hot=hot) == plain(rows)


def test_rows_of_one_id_and_of_none_are_several_batches(spark, documents):
    rows = shared_parts([7, 7, 7, None, None, 1, 2, 8, 9], 150, 6) + [(7, "same " * 30)] * 3 + [(50, "short")]
    docs = documents(rows)
    batched, firsts, _ = split_batches(docs, 2000)
    held = {r["doc_id"]: r["n"] for r in batched.groupBy("doc_id").agg({"batch": "approx_count_distinct"}).toDF("doc_id", "n").collect()}
    assert held[7] > 3 and max(held) > 1 << 62 and held[max(held)] > 3 and held[50] == 1
    assert run(docs, batch_bytes=2000) == plain(rows)


def test_equal_hashes_of_other_bytes_are_told_apart(spark, documents, monkeypatch):
    buf = np.frombuffer(b"abcabcabd", np.uint8)
    spans = np.array([0, 3, 6]), np.array([3, 6, 9])
    assert suffix_index.distinct_spans(buf, *spans)[0].tolist().count(0) in (1, 2)
    monkeypatch.setattr(suffix_index, "span_hashes", lambda buf, starts, ends: np.zeros(len(starts), np.uint64))
    place, one = suffix_index.distinct_spans(buf, *spans)
    assert place.tolist() == [0, 0, 1] and one.tolist() == [0, 2]
    monkeypatch.setattr(suffix_index, "rolling", lambda piece, width: np.zeros(len(piece) - width + 1, np.uint64))
    batch = suffix_index.Batch.__new__(suffix_index.Batch)
    batch.buf, batch.length = buf, 3
    starts, place, distinct, _ = batch.strings(np.array([0, 6]), np.array([3, 6]))
    assert [bytes(buf[a : a + 3]) for a in distinct[place]] == [bytes(buf[a : a + 3]) for a in starts]
