"""Chat formatting with typed content parts (operator 6), in Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Marks of the template, and control strings of common chat formats. All are escaped inside texts.
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>\n"
CONTROLS = ("<|", "</s>", "<s>", "[INST]", "[/INST]")
_MARK = "~"

PARTS = "array<struct<kind:string,text:string,ref:string,units:long>>"

#: Tokens that a placeholder stands for, for each unit of its part: image tiles, seconds of audio, pages.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 600}


def escape(text: Column) -> Column:
    """Every mark and control string becomes a mark and a digit, so the result holds no control string."""
    out = F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit(_MARK), F.lit(_MARK + "0"))
    for digit, control in enumerate(CONTROLS, 1):
        out = F.replace(out, F.lit(control), F.lit(f"{_MARK}{digit}"))
    return out


def unescape(text: Column) -> Column:
    """The text that was escaped: a mark always begins a pair, so pairs can be put back one kind after the other."""
    out = text
    for digit, control in enumerate(CONTROLS, 1):
        out = F.replace(out, F.lit(f"{_MARK}{digit}"), F.lit(control))
    return F.replace(out, F.lit(_MARK + "0"), F.lit(_MARK))


def text_part(text: Column) -> Column:
    """A content of one text part."""
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("kind"), text.cast("string").alias("text"), none.cast("string").alias("ref"), none.cast("long").alias("units")))


def _visit(part: Column, nth: Column) -> Column:
    """A text part gives its escaped text, any other kind a placeholder with its place in the content."""
    kind = F.coalesce(part["kind"], F.lit("text"))
    return F.when(kind == "text", escape(part["text"])).otherwise(F.concat(F.lit("<|"), escape(kind), F.lit(":"), nth.cast("string"), F.lit("|>")))


def _attachment(part: Column, nth: Column, tokens: dict[str, int]) -> Column:
    per_unit = F.coalesce(*[F.when(part["kind"] == k, F.lit(v)) for k, v in tokens.items()], F.lit(1))
    return F.struct(nth.alias("part"), part["kind"].alias("kind"), part["ref"].alias("ref"), (per_unit * F.greatest(F.coalesce(part["units"], F.lit(1)), F.lit(1))).cast("long").alias("tokens"))


def format_conversations(turns: DataFrame, loss_role: str = "assistant", tokens: dict[str, int] = TOKENS_PER_UNIT) -> DataFrame:
    """One row per conversation from rows (conv_id, turn, role, parts): conv_id, formatted, loss_spans, attachments.

    A visitor walks the parts of a turn in order (type ``PARTS``): texts are escaped, all other kinds become
    placeholders; attachments holds one (turn, part, kind, ref, tokens) per placeholder, with the tokens it expands to.
    loss_spans are (first, length) in bytes of the UTF-8 string, one for each non-empty content of ``loss_role``.
    Turns are ordered by turn, then role, then content; repeated turns stay, a null turn comes first. A null role or
    text counts as empty, null parts as none. Null conv_ids make one conversation. No rows give no rows.
    """
    numbered = F.coalesce(F.col("parts"), F.array().cast(PARTS))
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), numbered.alias("parts"))
    body = F.concat_ws("", F.transform("parts", _visit))
    held = F.filter(F.transform("parts", lambda p, i: _attachment(p, i, tokens)), lambda a: a["kind"] != "text")
    rows = rows.select("conv_id", "turn", "role", body.alias("body"), held.alias("held"))
    rows = rows.select("*", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY)).alias("head"))
    rows = rows.select("*", F.concat("head", "body", F.lit(END)).alias("piece"))
    order = ["turn", "role", "body"]
    before = F.coalesce(F.sum(F.octet_length("piece")).over(Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy(*order))
    rows = rows.select("conv_id", "turn", "role", "piece", "held", nth.alias("nth"), (before + F.octet_length("head")).cast("long").alias("first"), F.octet_length("body").cast("long").alias("length"))
    joined = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("nth", "turn", "role", "piece", "first", "length", "held"))).alias("turns"))
    spoken = F.filter("turns", lambda t: (t["role"] == loss_role) & (t["length"] > 0))
    return joined.select(
        "conv_id",
        F.concat_ws("", F.transform("turns", lambda t: t["piece"])).alias("formatted"),
        F.transform(spoken, lambda t: F.struct(t["first"].alias("first"), t["length"].alias("length"))).alias("loss_spans"),
        F.flatten(F.transform("turns", lambda t: F.transform(t["held"], lambda a: F.struct(t["turn"].alias("turn"), a["part"].alias("part"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))))).alias("attachments"),
    )


def read_turns(formatted: Column) -> Column:
    """(role, text) of every turn, read back from a formatted conversation; placeholders stay as they are."""
    pieces = F.slice(F.split(formatted, r"\Q" + TURN + r"\E"), 2, 1 << 30)

    def turn(piece: Column) -> Column:
        body = F.substring_index(piece, BODY, -1)
        return F.struct(
            unescape(F.substring_index(piece, BODY, 1)).alias("role"),
            unescape(F.substring(body, F.lit(1), F.length(body) - len(END))).alias("text"),
        )

    return F.transform(pieces, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, in order."""
    raw = F.encode(formatted, "UTF-8")
    return F.concat_ws("", F.transform(spans, lambda s: unescape(F.decode(F.substring(raw, (s["first"] + 1).cast("int"), s["length"].cast("int")), "UTF-8"))))
