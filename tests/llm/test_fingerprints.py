import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowtide.llm.fingerprints import BITS, LONG, PAIR, SHORT, fingerprint, fingerprint_and_search, near, prints_of
from rowtide.llm.texts import bit_votes, mix64, rolling, span_hashes, word_bounds


def plain(rows):
    order = sorted(((2**63 - 1 if d is None else d), t or "", k) for k, (d, t) in enumerate(rows))
    out = []
    for k, (_, text, place) in enumerate(order):
        after = order[k - 1][1]
        n = len(text) // 3
        edited = text[: len(text) - n] + after[:n]
        out.append((rows[place][0], len(text), hashlib.sha256(edited.encode()).hexdigest(), edited, text, after))
    return out


def test_whole_table_equals_brute_force(spark, documents, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in fingerprint(documents(rows), batch_bytes=20_000).collect()}
    want = plain(rows)
    assert len(got) == len(rows)
    texts = prints_of([x[4] for x in want])
    edited = prints_of([x[3] for x in want])
    for (d, n, sha, *_), p, e in zip(want, texts.tolist(), edited.tolist(), strict=True):
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (n, sha)
        assert (r["fingerprint"], r["edited_fingerprint"]) == ("%016x%016x" % tuple(p), "%016x%016x" % tuple(e))
    assert sum(r["near_edited"] > r["near_next"] for r in got.values()) >= 0.97 * len(got)


def test_edges(spark, documents):
    rows = [(1, None), (2, ""), (3, "one"), (3, "two words"), (None, "é ü ñ 日本"), (9, "w " * 300_000), (7, "a" * 700_000)]
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_chars"], r["edited_sha256"]) for r in fingerprint(documents(rows)).collect())
    assert got == sorted((x[0] is None, x[0] or 0, x[1], x[2]) for x in plain(rows))
    assert fingerprint(documents([])).count() == 0
    one = fingerprint(documents([(5, "alone here")])).first()
    assert one["near_next"] == 1.0


def test_search_finds_all_within_the_radius(spark):
    rnd = random.Random(8)
    prints = [rnd.getrandbits(BITS) for _ in range(30)]
    prints += [p ^ sum(1 << b for b in rnd.sample(range(BITS), rnd.randrange(6))) for p in prints for _ in range(8)]
    table = spark.createDataFrame([(f"{p:032x}",) for p in prints], "fp string")
    asked = table.limit(60)
    got = sorted((r["query"], r["fingerprint"], r["apart"]) for r in near(asked, table).collect())
    ask = {r["fp"] for r in asked.collect()}
    want = sorted((q, f"{p:032x}", (int(q, 16) ^ p).bit_count()) for q in ask for p in set(prints) if (int(q, 16) ^ p).bit_count() <= 3)
    assert got == want


@pytest.mark.parametrize("radius, blocks", [(0, 1), (2, 5), (6, 8)])
def test_any_cut_into_blocks_finds_all(spark, radius, blocks):
    rnd = random.Random(radius)
    prints = [rnd.getrandbits(BITS) for _ in range(12)]
    prints += [p ^ sum(1 << b for b in rnd.sample(range(BITS), rnd.randrange(radius + 3))) for p in prints for _ in range(6)]
    table = spark.createDataFrame([(f"{p:032x}",) for p in prints], "fp string")
    want = sorted((f"{q:032x}", f"{p:032x}", (q ^ p).bit_count()) for q in set(prints) for p in set(prints) if (q ^ p).bit_count() <= radius)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert sorted(tuple(r) for r in near(table, table, radius, blocks).collect()) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_prints_equal_a_plain_vote(spark):
    """Words and word pairs hashed one by one, each voting with its weight for or against every bit."""
    rnd = random.Random(7)
    texts = [" ".join(rnd.choice(["a", "the", "longer", "words", "été"]) for _ in range(rnd.randrange(40))) for _ in range(30)]
    for text, (one, two) in zip(texts, prints_of(texts).tolist(), strict=True):
        said = text.encode().split()
        hashes = [int(span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) for w in said]
        terms = [(SHORT if len(w) <= 4 else LONG, h) for w, h in zip(said, hashes, strict=True)]
        terms += [(PAIR, int(mix64(np.array([(3 * a + b * 0xD6E8FEB86659FD93) % (1 << 64)], np.uint64))[0])) for a, b in zip(hashes, hashes[1:])]
        for half, value in enumerate((one, two)):
            salted = [(w, int(mix64(np.array([(h + half + 1) % (1 << 64)], np.uint64))[0])) for w, h in terms]
            assert value == sum(1 << b for b in range(64) if sum(w if h >> b & 1 else -w for w, h in salted) > 0)


def test_search_counts_rows(spark, documents):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(100, text), (101, text), (102, text), (200, "quite another text " * 9), (None, text)]
    got = {r["doc_id"]: r["n_near"] for r in fingerprint_and_search(documents(rows)).collect()}
    assert got == {100: 3, 101: None, 102: None, 200: 0, None: None}


def test_byte_helpers():
    rnd = random.Random(2)
    buf = np.array([rnd.randrange(97, 99) for _ in range(400)], np.uint8)
    for width in (1, 2, 7, 24, 50):
        hashes = rolling(buf, width)
        strings = [buf[i : i + width].tobytes() for i in range(len(buf) - width + 1)]
        assert len(hashes) == len(strings) and len(set(hashes.tolist())) == len(set(strings)) == len(set(zip(hashes.tolist(), strings)))
    texts = [b"ab c", b"", b" ", b"d", b"e  f\n"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    starts, ends, counts = word_bounds(data, offsets)
    assert [data[a:b].tobytes() for a, b in zip(starts, ends)] == [b"ab", b"c", b"d", b"e", b"f"] and counts.tolist() == [2, 0, 0, 1, 2]
    hashes = np.array([rnd.getrandbits(64) for _ in range(700)], np.uint64)
    votes = bit_votes(hashes, np.array([0, 300, 0, 1, 399]))
    assert votes[1].tolist() == [sum(int(h) >> b & 1 for h in hashes[:300]) for b in range(64)] and votes[2].sum() == 0
    assert votes[4].tolist() == [sum(int(h) >> b & 1 for h in hashes[301:]) for b in range(64)]


def test_a_null_id_stays_null(spark, documents):
    assert fingerprint(documents([(None, "a"), (1, "b")])).where(F.col("doc_id").isNull()).count() == 1


def test_search_finds_copies_with_one_replaced_word(spark, documents):
    rnd, rows = random.Random(4), []
    for k in range(30):
        words = [f"w{rnd.randrange(400)}" for _ in range(300)]
        copy = list(words)
        copy[rnd.randrange(300)] = "other"
        rows += [(100 * k, " ".join(words)), (100 * k + 1, " ".join(copy))]
    prints = prints_of([t for _, t in rows])
    apart = [int(np.bitwise_count(prints[i] ^ prints[i + 1]).sum()) for i in range(0, len(rows), 2)]
    got = {r["doc_id"]: r["n_near"] for r in fingerprint_and_search(documents(rows)).collect()}
    assert [got[100 * k] for k in range(30)] == [int(a <= 6) for a in apart]
    assert any(3 < a <= 6 for a in apart)
