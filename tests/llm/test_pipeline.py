from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from rowtide.llm import quality
from rowtide.session import scratch_path
from tests.llm.test_pivot_dedup import plain_components, plain_print

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def results(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        place = scratch_path(spark, name)
        stage(spark, docs, sf).write.parquet(place)
        docs = spark.read.parquet(place)
        out.append(docs)
    return out


def test_stages(results):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "suffix_array_dedup", "mixing_sources", "best_fit_packing"]
    assert all(df.columns == COLUMNS for df in results[:5])


def test_quality_keeps_what_passes(results):
    judged = {r["doc"]["doc_id"]: r["quality"]["kept"] for r in quality.judge(results[0]).collect()}
    assert {r["doc_id"] for r in results[1].collect()} == {d for d, kept in judged.items() if kept}


def test_one_of_each_component_stays(results):
    rows = [(r["doc_id"], r["text"]) for r in results[1].collect()]
    named = plain_components([d for d, _ in rows], [plain_print(t) for _, t in rows], 3)
    assert sorted(r["doc_id"] for r in results[2].collect()) == sorted(d for (d, _), c in zip(rows, named, strict=True) if d == c)


def test_no_passage_repeats(results):
    before = {r["doc_id"]: r["text"] for r in results[2].collect()}
    after = {r["doc_id"]: r["text"] for r in results[3].collect()}
    seen = {}
    for d in sorted(before):
        raw, gone = before[d].encode(), set()
        for i in range(len(raw) - 49):
            if seen.setdefault(raw[i : i + 50], d) < d:
                gone.update(range(i, i + 50))
        kept = bytes(b for i, b in enumerate(raw) if i not in gone).decode("utf-8", "ignore")
        if kept.strip() or not gone:
            assert after.pop(d) == kept
    assert not after


def test_mix_repeats_documents(results):
    size = lambda t: len(t.encode().split())
    before, after = results[3].collect(), results[4].collect()
    times = Counter(r["doc_id"] for r in after)
    assert max(times.values()) <= 3 and set(times) <= {r["doc_id"] for r in before}
    assert abs(sum(size(r["text"]) for r in after) - sum(size(r["text"]) for r in before)) < 0.05 * sum(size(r["text"]) for r in before)


def test_packing_holds_every_copy(results):
    times, pieces = Counter(r["doc_id"] for r in results[4].collect()), results[5].collect()
    assert Counter(r["doc_id"] for r in pieces if r["piece"] == 0) == times
    for r in pieces:
        assert len(r["ids"]) == 4 * r["length"] and r["length"] <= 1024
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in pieces)
    for (s, a, n), (t, b, _) in zip(places, places[1:]):
        assert (s != t and b == 0) or a + n == b
    last = [np.frombuffer(r["ids"], "<u4")[-1] for r in pieces if r["piece"] == 0 and r["length"] < 1024]
    assert last


def test_edges(spark, documents):
    good = "the of and to in " + " ".join(f"word{i} the" for i in range(60))
    for rows in ([], [(1, None), (1, None), (None, good), (3, ""), (4, good), (4, good), (5, good + " more")]):
        docs = documents(rows).withColumnRenamed("lang", "size")
        columns = docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            place = scratch_path(spark, "edge")
            stage(spark, docs, "").write.parquet(place)
            docs = spark.read.parquet(place)
            assert docs.columns == columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == (0 if not rows else docs.count())
