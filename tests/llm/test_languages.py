import math
import zlib

from pyspark.sql import functions as F

from rowtide.llm.languages import identify, learn, predict

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = predict(docs).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    test = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in test) >= 0.98 * len(test)


def plain_trigrams(text):
    """(word number, bucket) of every letter with its neighbours inside the word's text; letters are a-z and all bytes beyond ASCII."""
    data, out, word, inside = text.lower().encode(), [], -1, False
    letter = lambda b: 0x61 <= b <= 0x7A or b >= 0x80
    for i, b in enumerate(data):
        if not letter(b):
            inside = False
            continue
        word, inside = word + (not inside), True
        x, y, z = (data[j] if 0 <= j < len(data) and letter(data[j]) else 0x20 for j in (i - 1, i, i + 1))
        h = (x * 0x9E3779B1 + y * 0x85EBCA77 + z * 0xC2B2AE3D) % (1 << 32)
        h ^= h >> 15
        out.append((word, h * 0x27D4EB2F % (1 << 32) >> 16))
    return out


def plain_mixture(like, allowed, rounds):
    """Shares of the allowed languages by expectation-maximisation, word by word, and the log-likelihood."""
    k = len(like[0])
    share = [float(i in allowed) / len(allowed) for i in range(k)]
    for _ in range(rounds):
        sums = [0.0] * k
        for row in like:
            total = max(sum(p * s for p, s in zip(row, share)), 1e-300)
            for i in range(k):
                sums[i] += row[i] * share[i] / total
        share = [x / len(like) for x in sums]
    return share, sum(math.log(max(sum(p * s for p, s in zip(row, share)), 1e-300)) for row in like)


def test_whole_table_equals_a_plain_version(spark, sf):
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs = [d for d in docs if len(d[1]) < 1500]
    counts = {}
    for d, text, lang in docs:
        if zlib.crc32(str(d).encode()) % 3 != 1 and lang is not None:
            own = counts.setdefault(lang, [0] * 65536)
            for _, bucket in plain_trigrams(text):
                own[bucket] += 1
    langs = sorted(counts)
    logs = [[math.log((c + 0.5) / (sum(counts[x]) + 0.5 * 65536)) for c in counts[x]] for x in langs]
    schema = "doc_id long, text string, lang string"
    got = {r["doc_id"]: r for r in predict(spark.createDataFrame(docs, schema).repartition(3)).collect()}
    for d, text, _ in docs:
        grams = plain_trigrams(text)
        words = [[0.0] * len(langs) for _ in range(grams[-1][0] + 1 if grams else 0)]
        for w, bucket in grams:
            for i in range(len(langs)):
                words[w][i] += logs[i][bucket]
        if not words:
            assert got[d]["lang_pred"] == "und"
            continue
        like = [[math.exp(x - max(row)) for x in row] for row in words]
        alone = [sum(row[i] - max(row) for row in words) for i in range(len(langs))]
        share, _ = plain_mixture(like, set(range(len(langs))), 8)
        first = max(range(len(langs)), key=alone.__getitem__)
        price, best = 6.0 * math.log(len(words) + 1) / 2, (max(alone), {first: share[first]})  # alone, a language keeps its share of all
        ranking = sorted(range(len(langs)), key=lambda i: -share[i])
        for size in range(2, len(langs) + 1):
            own, value = plain_mixture(like, set(ranking[:size]), 8)
            if value - (size - 1) * price > best[0] + 1e-6:
                best = (value - (size - 1) * price, {i: own[i] for i in range(len(langs)) if own[i] > 0})
        mixture = {m["lang"]: m["share"] for m in got[d]["mixture"]}
        want = {langs[i]: s for i, s in best[1].items()}
        assert set(mixture) == set(want) and all(abs(mixture[x] - want[x]) < 1e-3 for x in want)
        assert abs(want[got[d]["lang_pred"]] - max(want.values())) < 1e-3


def test_mixtures_are_found(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = learn(docs)
    long = {x: docs.where(f"lang = '{x}' and n_chars between 3000 and 5000").orderBy("doc_id").first()["text"] for x in ("en", "de", "fr")}
    rows = [(1, long["en"][:2400] + "\n" + long["de"][:1200]), (2, long["fr"]), (3, long["en"][:1000] + " " + long["de"][:1000] + " " + long["fr"][:1000])]
    got = {r["doc_id"]: {m["lang"]: m["share"] for m in r["mixture"]} for r in identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert set(got[1]) == {"en", "de"} and abs(got[1]["en"] - 2 / 3) < 0.12
    assert set(got[2]) == {"fr"}
    assert set(got[3]) == {"en", "de", "fr"} and all(0.15 < s < 0.5 for s in got[3].values())


def test_edges(spark, documents):
    docs = documents([(1, None), (2, ""), (3, "123 \n --"), (4, "the"), (4, "the"), (None, "und die"), (6, "x " * 200_000), (7, "日本語")])
    train = spark.createDataFrame([("en", "the of and"), ("de", "und die der"), (None, "zzz"), ("fr", None)], "lang string, text string")
    got = identify(docs.withColumnRenamed("source", "score"), learn(train)).collect()
    assert len(got) == 8
    assert {r["doc_id"]: r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3)} == {1: "und", 2: "und", 3: "und"}
    assert all(r["lang_pred"] in ("en", "de") for r in got if r["doc_id"] not in (1, 2, 3))
    assert {r["lang_pred"] for r in got if r["doc_id"] == 4} == {"en"}
    none = identify(docs, learn(train.where(F.lit(False)))).collect()
    assert {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)}
    assert predict(documents([])).count() == 0
