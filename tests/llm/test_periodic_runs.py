import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowtide.llm import queries
from rowtide.llm.periodic_runs import Grammar, digest, find_runs, periodic_runs, with_planted_run


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_runs(said, least=4, shortest=6):
    """Every period by itself: stretches where words q apart are equal, of which the smallest period counts."""
    n, stretches = len(said), {}
    for q in range(1, n // least + 1):
        i = 0
        while i + q < n:
            if said[i] != said[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and said[j] == said[j + q]:
                j += 1
            if j + q - i >= max(shortest, least * q):
                stretches.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in stretches.items())


def plain_digest(doc_id, text):
    said = plain_words(text)
    n = len(said)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            said = [said[i] if i < a else said[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(said)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    lines = "".join(f"{a},{b},{q}\n" for a, b, q in runs)
    kept = " ".join(w for i, w in enumerate(said) if i not in gone)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines), sha(kept))


def check(spark, documents, rows):
    docs = documents(rows)
    got = digest(periodic_runs(docs, with_planted_run(F.col("doc_id"), F.col("text"))))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((plain_digest(d, t) for d, t in rows), key=repr)


def test_whole_table_equals_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(map(tuple, queries.QUERIES["op13_periodic_runs"](spark, sf).collect()))
    want = sorted(plain_digest(d, t) for d, t in rows)
    assert got == want and any(r[1] for r in want)


def test_edges(spark, documents):
    rnd = random.Random(2)
    long = " ".join(rnd.choice("abcde") for _ in range(4000)) + " x y z" * 3000
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a a a a a"), (5, "a a a a a a"), (6, "a b a b a b a b"), (7, "a b a b a b a"), (None, "q q q q q q q"), (8, "é é é é é é è"), (8, "z"), (9, long)]
    rows += [(i, "one two three four five six seven eight nine ten") for i in range(20, 80)]
    check(spark, documents, rows)
    assert digest(periodic_runs(documents([]))).count() == 0


def test_other_columns_may_have_any_name(spark):
    docs = spark.createDataFrame([(1, "a a a a a a b", 5, {"k": 1})], "doc_id long, text string, runs long, _found map<string,int>")
    row = periodic_runs(docs).first()
    assert row["doc"]["runs"] == 5 and row["doc"]["_found"] == {"k": 1}
    assert [tuple(r) for r in row["runs"]] == [(0, 6, 1)] and row["collapsed"] == "a b" and row["n_words"] == 7


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_random_lines(seed):
    rnd = random.Random(seed)
    texts = []
    for _ in range(60):
        line = []
        while len(line) < rnd.randrange(1, 120):
            root = [rnd.randrange(1 + seed) for _ in range(rnd.randrange(1, 9))]
            line += root * rnd.randrange(1, 9) + root[: rnd.randrange(len(root))]
        texts.append(line)
    texts.append([])
    counts = np.array([len(t) for t in texts])
    got = [[] for _ in texts]
    for k, *run in zip(*(x.tolist() for x in find_runs(np.array(sum(texts, []), np.int64), np.cumsum(counts) - counts, counts)), strict=True):
        got[k].append(tuple(run))
    assert got == [plain_runs(t) for t in texts]


def test_grammar_spells_its_line_and_answers_exactly():
    rnd = random.Random(9)
    line = [-1]
    for k in range(12):
        line += [rnd.randrange(3) for _ in range(rnd.randrange(90))] + [1, 2] * rnd.randrange(30) + [0] * rnd.randrange(40) + [-2 - k]
    line = np.array(line, np.int64)
    grammar = Grammar(line)

    def spelled(node):
        return [int(line[node])] if grammar.left[node] < 0 else [w for c in range(grammar.left[node], grammar.right[node] + 1) for w in spelled(c)]

    tops = np.flatnonzero(grammar.up < 0)
    assert [w for t in tops.tolist() for w in spelled(t)] == line.tolist()
    assert all(len(spelled(g)) == grammar.length[g] for g in range(len(grammar.symbol)))
    i = np.array([rnd.randrange(len(line)) for _ in range(3000)])
    j = np.array([rnd.randrange(len(line)) for _ in range(3000)])
    i, j = i[i != j], j[i != j]
    ahead, behind = [], []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        k = 0
        while line[a + k] == line[b + k]:
            k += 1
        ahead.append(k)
        k = 0
        while line[a - k] == line[b - k]:
            k += 1
        behind.append(k)
    assert grammar.lce(i, j).tolist() == ahead and grammar.lce(i, j, back=True).tolist() == behind


def test_a_long_run_takes_few_steps_of_the_grammar():
    line = np.concatenate([[-1], np.tile(np.arange(7), 20_000), [-2]])
    grammar = Grammar(line)
    assert grammar.lce(np.array([1]), np.array([8])).tolist() == [140_000 - 7]
    assert len(grammar.symbol) < 4 * len(line)
