from collections import Counter

import numpy as np

from rowtide.llm import sharding
from rowtide.llm.queries import op5
from rowtide.llm.sharding import communication_matrix, shard_sizes, shuffle_into_shards


def test_whole_table(spark, sf):
    rows = op5(spark, sf).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r["doc_id"]: r["size"] for r in rows} == {d: len(t.encode()) + 16 for d, t in docs.items()}
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) == set(range(40)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}


def test_no_python_on_the_main_path(spark, sf):
    plan = op5(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_matrix_has_exact_margins_and_the_law_of_a_shuffle():
    cells = [7, 0, 40, 3, 50]
    for seed in range(20):
        m = communication_matrix(cells, 8, seed)
        assert m.sum(axis=1).tolist() == cells and m.sum(axis=0).tolist() == shard_sizes(100, 8).tolist() and (m >= 0).all()
    drawn = np.mean([communication_matrix([30, 30], 2, s)[0, 0] for s in range(3000)])
    spread = np.var([communication_matrix([30, 30], 2, s)[0, 0] for s in range(3000)])
    assert abs(drawn - 15) < 0.2 and abs(spread - 30 * 30 * 30 * 30 / (60 * 60 * 59)) < 0.4


def test_places_are_uniform_and_reruns_agree(spark):
    df = spark.range(4000).withColumnRenamed("id", "doc_id")
    one = {r["doc_id"]: (r["shard"], r["slot"]) for r in shuffle_into_shards(df, 4).collect()}
    two = {r["doc_id"]: (r["shard"], r["slot"]) for r in shuffle_into_shards(df.repartition(7), 4).collect()}
    assert one == two
    place = np.array([one[i][0] * 1000 + one[i][1] for i in range(4000)])
    assert sorted(place) == list(range(4000))
    assert abs(np.corrcoef(place, np.arange(4000))[0, 1]) < 0.06
    table = np.histogram2d(place, np.arange(4000), bins=8)[0]
    assert ((table - 62.5) ** 2 / 62.5).sum() < 95  # chi square, 49 degrees of freedom


def test_edges(spark, documents):
    docs = documents([(1, None), (1, None), (1, None), (None, "x"), (2, ""), (2, "long " * 50_000)])
    rows = shuffle_into_shards(docs.withColumnRenamed("lang", "shard"), 4).collect()
    assert len(rows) == 6 and sorted(Counter(r["shard"] for r in rows).values()) == [1, 1, 2, 2]
    assert shuffle_into_shards(documents([]), 4).count() == 0


def test_large_counts_keep_the_law_of_a_shuffle(monkeypatch):
    monkeypatch.setattr(sharding, "_DRAW", 50)
    cells, first = [30, 0, 70, 25, 40, 35], []
    for seed in range(3000):
        matrix = communication_matrix(cells, 4, seed)
        assert matrix.sum(axis=1).tolist() == cells and matrix.sum(axis=0).tolist() == [50] * 4 and matrix.min() >= 0
        first.append(matrix[:3, 0].sum())
    n, own, taken = 200, 50, 100  # rows of the first three cells in the first shard
    assert abs(np.mean(first) - taken * own / n) < 0.25
    want = taken * (own / n) * (1 - own / n) * (n - taken) / (n - 1)
    assert 0.88 * want < np.var(first) < 1.12 * want


def test_large_draws_follow_numpy(monkeypatch):
    cases = [(500, 700, 300), (3, 900, 400), (900, 3, 400), (50, 40, 90), (0, 100, 60), (100, 0, 60), (60, 50, 0), (60, 50, 75)]
    draw = lambda case, seed: [sharding.hypergeometric(rng, *case) for rng in [np.random.default_rng(seed)] for _ in range(4000)]
    plain = [draw(c, 1) for c in cases]
    monkeypatch.setattr(sharding, "_DRAW", 1)
    for case, one in zip(cases, plain, strict=True):
        two, (good, bad, drawn) = draw(case, 2), case
        assert min(two) >= max(0, drawn - bad) and max(two) <= min(good, drawn)
        spread = max(np.std(one), 1e-9)
        assert abs(np.mean(one) - np.mean(two)) <= 0.12 * spread and abs(np.std(two) - np.std(one)) <= 0.1 * spread


def test_cells_beyond_the_generator():
    cells = [2_000_000_000, 5, 1_500_000_000, 700_000_000]
    matrix = communication_matrix(cells, 3, 1)
    assert matrix.sum(axis=1).tolist() == cells and matrix.sum(axis=0).tolist() == shard_sizes(sum(cells), 3).tolist()
    assert matrix.min() >= 0 and len(set(matrix[0].tolist())) == 3
