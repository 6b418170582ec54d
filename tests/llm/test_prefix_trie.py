import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from rowtide.llm import queries
from rowtide.llm.prefix_trie import number_turns, share_openings, trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_conversations(rows):
    """Turns (role, text) of each conversation, by turn, null first; ties among equal rows only."""
    out = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (repr(r[0]), r[1] is not None, r[1] or 0)):
        out.setdefault(c, []).append((role or "", text or ""))
    return out


def plain_rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4 if c is not None else 0
        out[c] = convs.get(c - c % 20, [])[:h] + own[h:] if c is not None else own
    return out


def plain_trie(convs):
    members = {}
    for c, own in convs.items():
        for d in range(len(own) + 1):
            members.setdefault(tuple(own[:d]), []).append(c)
    least = lambda key: min((c for c in members[key] if c is not None), default=None)
    kids, rows = {}, []
    for key in members:
        if key:
            kids.setdefault(key[:-1], []).append(key)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for key in members:
        words = len(re.findall(r"[^\x20\x09-\x0D]+", key[-1][1])) if key else 0
        for d in range(len(key) + 1):
            leaves[key[:d]] += key not in kids
            saved[key[:d]] += (len(members[key]) - 1) * words
    for key in members:
        ends = ",".join(map(str, sorted(c for c in members[key] if c is not None and len(convs[c]) == len(key))))
        rows.append((least(key), len(key), least(key[:-1]) if key else None, len(members[key]), len(kids.get(key, ())), leaves[key], saved[key], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=repr)


def table(spark, rows, parts=3):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(parts)


def got(nodes):
    assert nodes.columns == COLUMNS
    return sorted(map(tuple, nodes.collect()), key=repr)


def random_rows(seed, convs=40, deepest=25, words=2):
    rnd = random.Random(seed)
    rows = []
    for c in range(convs):
        for k in range(rnd.randrange(1, deepest)):
            rows.append((c + 3, None if k == 0 and c % 3 == 0 else k, rnd.choice(["user", None]), " ".join(rnd.choice("ab") for _ in range(rnd.randrange(words)))))
    return rows


def test_query_equals_its_sql(spark, sf):
    db = duckdb.connect()
    db.sql(f"create view conversations as select * from '{sf}/conversations.parquet'")
    nodes = queries.QUERIES["op12_conversation_prefix_trie"](spark, sf)
    want = db.sql(queries.ORACLES["op12_conversation_prefix_trie"])
    assert nodes.columns == want.columns == COLUMNS
    assert got(nodes) == sorted(want.fetchall(), key=repr)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(nodes) == plain_trie(plain_rebuilt(plain_conversations(rows)))


@pytest.mark.parametrize("height", [3, 16])
def test_random_tries_at_any_band_height(spark, height):
    rows = random_rows(height)
    turns = number_turns(table(spark, rows))
    assert got(trie(turns, height)) == plain_trie(plain_conversations(rows))
    c = F.col("c")
    rebuilt = share_openings(turns, c - F.pmod(c, F.lit(20)), F.crc32(c.cast("string").cast("binary")) % 4, 3)
    assert got(trie(rebuilt, height)) == plain_trie(plain_rebuilt(plain_conversations(rows)))


def test_edges(spark):
    long = "w " * 100_000
    rows = [(None, 0, "user", "a b"), (None, 1, "user", "c"), (20, None, None, None), (20, 0, "", "x"), (21, 0, "user", "a b"), (22, 0, "user", "a b"), (22, 1, "user", "c"), (23, 5, "user", long), (23, 5, "user", long), (24, 0, "user", "u"), (-3, 0, "user", "a b")]
    rows += [(7, 1, "user", "same words here")] * 50
    turns = number_turns(table(spark, rows))
    assert got(trie(turns)) == plain_trie(plain_conversations(rows))
    c = F.col("c")
    rebuilt = share_openings(turns, c - F.pmod(c, F.lit(20)), F.crc32(c.cast("string").cast("binary")) % 4, 3)
    assert got(trie(rebuilt)) == plain_trie(plain_rebuilt(plain_conversations(rows)))
    assert trie(number_turns(table(spark, []))).count() == 0


def test_other_columns_may_have_any_name(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a", 5, 6)], "conv_id long, turn long, role string, text string, pos long, c long")
    assert got(trie(number_turns(rows))) == plain_trie({1: [("user", "a")]})


def test_one_deep_conversation_takes_few_rounds(spark):
    rows = [(1, k, "user", f"t{k}") for k in range(280)] + [(2, k, "user", f"t{k}") for k in range(260)] + [(2, 260, "user", "else")]
    assert got(trie(number_turns(table(spark, rows)), 4)) == plain_trie(plain_conversations(rows))


def test_turns_are_numbered_once(spark):
    """What rebuilds conversations reads the numbered turns from a file: the plan doesn't hold the numbering, let alone several times."""
    rows = [(c, k, "user", f"{c % 3} {k}") for c in range(40) for k in range(4)]
    turns = number_turns(table(spark, rows))
    assert "Window" in turns._jdf.queryExecution().optimizedPlan().toString()
    rebuilt = share_openings(turns, F.col("c") - F.pmod("c", F.lit(20)), F.lit(2), 3)
    assert "Window" not in rebuilt._jdf.queryExecution().optimizedPlan().toString()
