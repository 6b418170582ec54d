import re

from rowtide.llm import quality
from rowtide.llm.queries import op3

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    again = {w for w in windows if windows.count(w) > 1}
    covered = {i + k for i, w in enumerate(windows) if w in again for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


CASES = [None, "", " \n\t ", "one", "a b", "a b c", "x y z x y z", "A\x0bB\x0cC\rD\n" * 3, "é ü w ñ\n\né ü w ñ", "a a a a a a", "#*$%&|<> <a|b>", "\n\n \nsame\nsame\n same\n", " ".join(f"w{i % 61}" for i in range(400)), "the of and " + " ".join(f"word{i}" for i in range(70)), " ".join("of" if i % 3 else f"w{i}" for i in range(5000))]


def test_measures_of_small_cases(spark):
    rows = spark.createDataFrame([(i, t, "given", 7) for i, t in enumerate(CASES)], "doc_id long, text string, words string, n_words int").repartition(3)
    judged = quality.judge(rows)
    assert judged.select("doc.*").columns == rows.columns
    got = {r["doc"]["doc_id"]: r["quality"] for r in judged.collect()}
    assert len(got) == len(CASES)
    for i, t in enumerate(CASES):
        q = got[i]
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"], q["base_failed"]) == plain(t), repr(t)
        assert not (q["kept"] and q["base_failed"])


def test_a_very_long_text(spark):
    text = " ".join(f"w{i % 150_000}" for i in range(300_000))
    q = quality.judge(spark.createDataFrame([(text,)], "text string")).first()["quality"]
    assert (q["n_words"], q["n_repeat_words"]) == (300_000, 300_000)


def test_rules_are_one_projection_without_python(spark, sf):
    plan = op3(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_clean_documents_stay_and_junk_goes(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = {(r["quality"], r["kept"]): r["count"] for r in op3(spark, sf).join(labels, "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()}
    assert kept.get((1, False), 0) == 0
    assert kept.get((0, False), 0) >= 0.9 * (kept.get((0, True), 0) + kept.get((0, False), 0))


def test_a_filter_stays_above_the_projections(spark, sf):
    plan = quality.judge(spark.read.parquet(f"{sf}/documents.parquet")).where("quality.kept")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("Generate") < plan.index("Project", plan.index("Generate")) and plan.count("Filter") == 1


def test_keep_good_and_empty_table(spark, documents):
    good = "the of and to " + " ".join(f"word{i}" for i in range(60))
    docs = documents([(1, good), (2, None), (3, good), (3, good)])
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 3]
    assert quality.judge(documents([])).count() == 0
