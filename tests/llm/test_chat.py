from pyspark.sql import functions as F

from rowtide.llm import chat
from rowtide.llm.queries import op6

NASTY = ["", "~", "~0", "~1<|", "<|end|>\n<|turn|>", "</s>[INST] ok [/INST]", "[[INST]]", "<<s>s>", "<<||>", "a\nb\n", "é~2~", None, "<", "|>", "\\E\\Q", "x" * 100_000]


def convert(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    made = chat.format_conversations(df.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts")))
    return made.select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))


def test_round_trip(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(NASTY)] + [(2, 0, None, "x"), (2, 0, None, "x"), (None, 0, "<|turn|>", "r"), (3, None, "assistant", None)]
    got = {r["conv_id"]: r for r in convert(spark, rows).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("assistant" if i % 2 else "user", t or "") for i, t in enumerate(NASTY)]
    assert got[1]["loss"] == "".join(t or "" for t in NASTY[1::2])
    assert [(t["role"], t["text"]) for t in got[2]["turns"]] == [("", "x"), ("", "x")]
    assert [(t["role"], t["text"]) for t in got[None]["turns"]] == [("<|turn|>", "r")]
    assert (got[3]["loss"], got[3]["turns"][0]["text"]) == ("", "")
    assert convert(spark, []).count() == 0


def test_escaped_text_holds_no_control_string(spark):
    for text in (x for x in NASTY if x is not None):
        out = spark.range(1).select(chat.escape(F.lit(text)).alias("e"), chat.unescape(chat.escape(F.lit(text))).alias("u")).first()
        assert not any(c in out["e"] for c in chat.CONTROLS) and out["u"] == text


def test_parts_become_placeholders_with_attachments(spark):
    parts = [("text", "see <|", None, None), ("image", None, "a.png", 4), ("text", "and", None, None), ("audio", None, "b.wav", 3), ("document", None, None, None), ("odd|>", None, "c", 2), (None, "tail", None, None)]
    df = spark.createDataFrame([(5, 0, "user", parts), (5, 1, "assistant", []), (5, 2, "assistant", None)], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    r = chat.format_conversations(df).first()
    assert r["formatted"] == "<|turn|>user<|body|>see ~1<|image:1|>and<|audio:3|><|document:4|><|odd|>:5|>tail<|end|>\n" + "<|turn|>assistant<|body|><|end|>\n" * 2
    assert [tuple(a) for a in r["attachments"]] == [(0, 1, "image", "a.png", 1024), (0, 3, "audio", "b.wav", 75), (0, 4, "document", None, 600), (0, 5, "odd|>", "c", 2)]
    assert r["loss_spans"] == []


def test_no_python(spark, sf):
    plan = op6(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
