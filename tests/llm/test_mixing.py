import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rowtide.llm.columns import words
from rowtide.llm.mixing import Network, mix, repeat_rows, route, share_out
from rowtide.llm.queries import op7


def test_shares_stop_at_three_times_the_source():
    got = share_out({"b": 10, "a": 1000, None: 500, "c": 5}, lambda i: 1 + i % 3)
    assert got["b"] == 30 and got["c"] == 15
    assert sum(got.values()) == pytest.approx(1515) and got["a"] == pytest.approx(735) and got[None] == pytest.approx(735)
    assert share_out({}, lambda i: 1) == {} and share_out({"a": 0}, lambda i: 1) == {"a": 0.0}


def test_flow_is_a_cheapest_one():
    rnd = random.Random(4)
    for _ in range(30):
        patterns = {("a",): rnd.randrange(1, 5), ("b",): rnd.randrange(1, 5), ("a", "b"): rnd.randrange(1, 5)}
        targets = {"a": rnd.randrange(10), "b": rnd.randrange(10)}
        got = route(patterns, targets)
        words_of = {p: q.passes * patterns[p] + q.rest for p, q in got.items()}

        def cost(p, n):
            return sum((1, 3, 9)[(k // patterns[p])] for k in range(n))

        best = None
        for x in range(3 * patterns[("a",)] + 1):
            for y in range(3 * patterns[("b",)] + 1):
                for z in range(3 * patterns[("a", "b")] + 1):
                    for za in range(z + 1):
                        if x + za <= targets["a"] and y + z - za <= targets["b"]:
                            key = (-(x + y + z), cost(("a",), x) + cost(("b",), y) + cost(("a", "b"), z))
                            best = min(best or key, key)
        assert (-sum(words_of.values()), sum(cost(p, n) for p, n in words_of.items())) == best
    net = Network(2)
    net.run(0, 1)


def test_whole_table(spark, sf):
    rows = op7(spark, sf).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    size = {d: len(r["text"].encode().split()) for d, r in docs.items()}
    assert {r["doc_id"]: r["size"] for r in rows} == size
    sources, taken = Counter(), Counter()
    for r in rows:
        s = docs[r["doc_id"]]["source"]
        sources[s] += r["size"]
        taken[s] += r["taken"]
        assert r["taken"] <= 3 * r["size"] and r["taken"] % max(r["size"], 1) == 0
    targets = share_out(sources, lambda i: 1 + i % 3)
    largest = defaultdict(int)
    for d, n in size.items():
        largest[docs[d]["source"]] = max(largest[docs[d]["source"]], n)
    for r in rows:
        s = docs[r["doc_id"]]["source"]
        assert r["source_size"] == sources[s] and r["target"] == pytest.approx(targets[s])
    for s, t in targets.items():
        assert abs(taken[s] - t) <= largest[s] / 2 + 1
    assert {(r["doc_id"], r["taken"]) for r in rows} == {(r["doc_id"], r["taken"]) for r in op7(spark, sf).collect()}


def test_edges_and_overlapping_sources(spark):
    rows = [(1, "a b c", ["x", "y"]), (2, "", ["x"]), (3, None, []), (4, "d e", None), (5, "f", [None, "y"]), (5, "f", [None, "y"]), (None, "g " * 1000, ["x"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, size array<string>").repartition(3)
    got = mix(df, F.col("size"), F.size(words(F.col("text")))).collect()
    assert len(got) == 7 and all(0 <= r["copies"] <= 3 for r in got) and all(r["copies"] == 0 for r in got if r["size"] == 0)
    assert mix(df.limit(0), F.col("size"), F.lit(1)).count() == 0
    out = repeat_rows(df, F.col("size"), F.size(words(F.col("text"))))
    assert out.columns == df.columns and out.count() == sum(r["copies"] for r in got)
