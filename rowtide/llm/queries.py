"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowtide.llm import chat, fingerprints, languages, mixing, packing, periodic_runs, pivot_dedup, prefix_trie, quality, secret_scans, sharding, suffix_index, training_order
from rowtide.llm.columns import words
from rowtide.llm.registry import ORACLES, QUERIES, query
from rowtide.session import scratch_path

__all__ = ["ORACLES", "QUERIES"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op1_simhash_near_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_dedup.near_duplicates(documents(spark, sf_dir))


@query("op2_language_id")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.predict(documents(spark, sf_dir))


_STOPS = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)

OP3_SQL = rf"""
with w as (
    select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), d as (select *, row_number() over () as r from w),
triples as (
    select r, i, list_slice(w, i, i + 2) as g from (select r, w, unnest(range(1, len(w) - 1)) as i from d where len(w) >= 3)
), again as (
    select r, i from triples qualify count(*) over (partition by r, g) > 1
), covered as (
    select r, count(distinct i + k) as n from again, (values (0), (1), (2)) as s(k) group by r
), lines as (
    select r, count(*) as n_lines, count(*) - count(distinct l) as n_dup
    from (select r, unnest(string_split(t, chr(10))) as l from d) where regexp_matches(l, '[^\x20\x09-\x0D]') group by r
), m as (
    select d.doc_id, len(w)::bigint as n_words, coalesce(length(array_to_string(w, '')), 0)::bigint as word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
        coalesce(n_dup, 0)::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words, coalesce(n_lines, 0) as n_lines,
        len(list_filter(w, lambda x: lower(x) in ({_STOPS}))) as n_stop
    from d left join covered c using (r) left join lines using (r)
), f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, greatest(n_words, 1)::double as per from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    not base_failed and word_chars / per >= 2 and word_chars / per <= 15 and n_symbols / per <= 0.25 and n_stop / per >= 0.02
        and n_dup_lines / greatest(n_lines, 1)::double <= 0.5 as kept
from f
"""


@query("op3_quality_rules", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judge(documents(spark, sf_dir))
    return rows.select("doc.doc_id", *[f"quality.{c}" for c in quality.MEASURES], "quality.base_failed", "quality.kept")


@query("op4_suffix_array_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_index.removed_spans(documents(spark, sf_dir))


@query("op5_sharding")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    return sharding.shuffle_into_shards(rows, 40).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _escaped(column: str) -> str:
    out = f"replace({column}, '~', '~0')"
    for digit, control in enumerate(chat.CONTROLS, 1):
        out = f"replace({out}, '{control}', '~{digit}')"
    return out


OP6_SQL = f"""
with t as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e as (select *, {_escaped("text")} as body, {_escaped("role")} as head from t)
select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, body)) as turns_sha256,
    coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, role, body) filter (role = 'assistant'), '')) as loss_sha256,
    sum({len(chat.TURN + chat.BODY + chat.END)} + length(head) + length(body))::bigint as formatted_chars
from e group by conv_id
"""


@query("op6_chat_formatting", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string"))
    made = chat.format_conversations(rows.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts")))
    read = made.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    spoken = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op7_mixing_sources")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.size(words(F.col("text"))).cast("long")
    place = scratch_path(spark, "sizes")  # the mix reads its rows more than once; texts are split into words once
    documents(spark, sf_dir).select("doc_id", "source", size.alias("size")).write.parquet(place)
    mixed = mixing.mix(spark.read.parquet(place), F.array("source"), F.col("size"))
    return mixed.select("doc.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query("op8_document_fingerprints")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_and_search(documents(spark, sf_dir))


@query("op9_training_order")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards are written; what comes back tells where each sequence lies and the checksum of its ids."""
    return training_order.write_shards(training_order.materialise(documents(spark, sf_dir)), scratch_path(spark, "shards"))


@query("op10_best_fit_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(documents(spark, sf_dir))


@query("op11_secret_scans")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scans.digest(secret_scans.scan(documents(spark, sf_dir)))


OP12_SQL = r"""
with t as (
    select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
        row_number() over (partition by conv_id order by turn nulls first, role, text) as k
    from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations)
), c as (
    select conv_id, count(*) as n, conv_id - ((conv_id % 20) + 20) % 20 as base,
        xor(list_reduce(
            list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
            lambda crc, byte: list_reduce(
                list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
                lambda v, z: case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end)
        ), 4294967295) % 4 as h
    from t group by conv_id
), m as (
    select c.*, least(c.h, coalesce(b.n, 0)) as got, least(c.h, coalesce(b.n, 0)) + greatest(c.n - c.h, 0) as total
    from c left join c as b on b.conv_id = c.base
), r as (
    select m.conv_id, t.k as pos, role, text from m join t on t.conv_id = m.base and t.k <= m.h
    union all
    select m.conv_id, t.k - m.h + m.got, role, text from m join t on t.conv_id = m.conv_id and t.k > m.h
), p as (
    select conv_id, pos, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as w,
        md5(string_agg(sha256(length(role) || ':' || role || text), '') over (partition by conv_id order by pos)) as key
    from r
    union all select conv_id, 0, 0, '' from m
), q as (
    select p.*, lag(key) over (partition by p.conv_id order by pos) as up, pos = m.total as ends from p join m using (conv_id)
), nodes as (
    select pos, key, min(conv_id) as conv_id, count(*) as n_convs, any_value(up) as up, any_value(w) as w,
        sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '')) as ends_sha256
    from q group by pos, key
), kids as (
    select pos - 1 as pos, up as key, count(*) as n from nodes where pos > 0 group by all
), valued as (
    select nodes.*, coalesce(kids.n, 0) as n_children, (n_convs - 1) * w as saved from nodes left join kids using (pos, key)
), totals as (
    select a.pos, a.key, count(*) filter (n_children = 0) as n_leaves, sum(saved)::bigint as saved_tokens
    from valued v join p a on a.conv_id = v.conv_id and a.pos <= v.pos group by all
)
select v.conv_id, v.pos as depth, above.conv_id as parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, v.ends_sha256
from valued v join totals using (pos, key) left join nodes above on above.pos = v.pos - 1 and above.key = v.up
"""


@query("op12_conversation_prefix_trie", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.number_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    c = F.col("c")
    return prefix_trie.trie(prefix_trie.share_openings(turns, c - F.pmod(c, F.lit(20)), F.crc32(c.cast("string").cast("binary")) % 4, 3))


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return periodic_runs.digest(periodic_runs.periodic_runs(docs, periodic_runs.with_planted_run(F.col("doc_id"), F.col("text"))))
