import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rowtide.llm import packing, training_order
from rowtide.llm.queries import op9, op10
from rowtide.llm.texts import give_back
from rowtide.llm.tokens import Encoder, default_paths


@pytest.fixture(scope="module")
def reference():
    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda texts: [x.ids for x in made.encode_batch(texts, add_special_tokens=False)]


def encode(texts, most=400_000):
    made, out = Encoder(*default_paths(), most=most), []
    for _, ids, counts in made.column(pa.array(texts, pa.string())):
        ends = np.cumsum(counts)
        out += [ids[b - n : b].tolist() for b, n in zip(ends, counts, strict=True)]
    return out


def test_ids_are_those_of_the_tokenizer(spark, sf, reference):
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert encode(texts) == reference(texts) == encode(texts, most=3000)


def test_ids_of_odd_texts(reference):
    rnd = random.Random(6)
    parts = [" ", "  ", "\n", "\t", "\r\n", " ", " ", "　", "\u0085", "\x0b", "\x1c", "a", "Zé", "日本", "😀", "'s", "'ll", "12", "!?", "<|endoftext|>", "​", "ß.", " ", "_"]
    texts = ["".join(rnd.choices(parts, k=rnd.randrange(12))) for _ in range(4000)] + ["", "<|endoftext|>", "a  <|endoftext|>  b", " <|endoftext|><|endoftext|> x", "<|endof", "text|><|endoftext|", "<<|endoftext|>>", "x" * 30_000, " " * 5000, "ab " * 3000]
    assert encode(texts) == reference(texts)


def test_pieces_of_texts_with_added_tokens(spark, documents, reference):
    rows = [(1, "one <|endoftext|> two"), (2, "<|endoftext|>"), (3, "a \n <|endoftext|>\n")]
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in packing.pieces(documents(rows)).collect()}
    assert got == {d: x + [2] for (d, _), x in zip(rows, reference([t for _, t in rows]), strict=True)} and got[2] == [50256, 2]


def check_packing(rows, docs, ids_of, capacity=1024):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(docs)
    for d, own in by_doc.items():
        ids = ids_of[d]
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and own[0]["start"] == 0
        assert sum(r["length"] for r in own) == len(ids) and all(r["length"] == capacity for r in own[1:])
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    for own in by_sequence.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(n for _, n in own) <= capacity
    return len(by_sequence)


def test_packing_of_the_whole_table(spark, sf, reference):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = {d: x + [2] for d, x in zip(docs, reference(list(docs.values())), strict=True)}
    n = check_packing(op10(spark, sf).collect(), docs, ids)
    assert n <= -(-sum(map(len, ids.values())) // 1024) * 1.02 + 1


def test_packing_edges(spark, documents, reference):
    rows = [(1, None), (2, ""), (3, "one"), (4, "word " * 5000), (None, "x y z"), (6, "a " * 1023)]
    packed = packing.packed_documents(documents(rows), with_ids=True)
    made = packed.collect()
    ids = {d: x + [2] for (d, _), x in zip(rows, reference([t or "" for _, t in rows]), strict=True)}
    check_packing(made, dict(rows), ids)
    whole = {r["sequence_id"]: r for r in packing.sequences(packed).collect()}
    for r in made:
        assert np.frombuffer(whole[r["sequence_id"]]["ids"], "<u4")[r["offset"] : r["offset"] + r["length"]].tolist() == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
    assert packing.packed_documents(documents([])).count() == 0
    twice = packing.packed_documents(documents([(8, "same")] * 5)).collect()
    assert len(twice) == 5 and len({(r["sequence_id"], r["offset"]) for r in twice}) == 5


def test_fit_equals_a_plain_solver():
    """Multiplicative updates on the dense matrix come to the same least squares distance."""
    rnd = random.Random(11)
    lengths = Counter(rnd.choice([3, 4, 5, 7, 8, 9, 12, 13]) for _ in range(400))
    patterns = packing.few_document_patterns(lengths, 20, slack=2)
    names = sorted(lengths)
    a = np.array([[Counter(p)[x] for p in patterns] for x in names], float)
    b = np.array([lengths[x] for x in names], float)
    x = np.ones(len(patterns))
    for _ in range(200_000):
        x *= (a.T @ b + 1e-12) / (a.T @ (a @ x) + 1e-12)
    best = np.linalg.norm(a @ x - b)
    ours = np.array(packing.fit(patterns, lengths, rounds=400))
    assert (ours >= 0).all() and np.linalg.norm(a @ ours - b) <= best + 1.0


def test_most_short_pieces_come_through_fitted_patterns():
    rnd = random.Random(5)
    lengths = Counter(min(1024, int(rnd.lognormvariate(5.5, 1)) + 1) for _ in range(10_000))
    fitted = [p for p in packing.plan(lengths, 1024) if len(p) <= 3 and 1024 - sum(p) <= 7]
    made = packing.plan(lengths, 1024)
    assert sum(made[p] * len(p) for p in fitted) >= 0.4 * sum(lengths.values())


def test_plans_place_every_length_once():
    rnd = random.Random(3)
    for capacity, lengths in ((20, [rnd.randrange(1, 21) for _ in range(500)]), (1024, [min(1024, int(rnd.lognormvariate(5, 1)) + 1) for _ in range(20_000)]), (16, [16] * 5 + [9] * 7), (8, [])):
        made, have = packing.plan(Counter(lengths), capacity), Counter()
        for pattern, n in made.items():
            assert sum(pattern) <= capacity and n > 0
            for x in pattern:
                have[x] += n
        assert have == Counter(lengths)
        least = max(-(-sum(lengths) // capacity), sum(2 * x > capacity for x in lengths))
        assert sum(made.values()) <= least * 1.03 + 1
    ours = packing.plan(Counter({5: 10, 3: 20, 4: 9}), 8)
    assert sum(ours.values()) == 20


def test_feistel_is_a_keyed_permutation():
    for n in (1, 2, 3, 17, 1000, 65_537):
        one = training_order.feistel(np.arange(n), n, 5)
        assert sorted(one) == list(range(n))
    assert (training_order.feistel(np.arange(1000), 1000, 5) != training_order.feistel(np.arange(1000), 1000, 6)).mean() > 0.9
    assert abs(np.corrcoef(training_order.feistel(np.arange(5000), 5000, 1), np.arange(5000))[0, 1]) < 0.06


def test_training_order_holds_every_document(spark, sf, reference, tmp_path):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = dict(zip(docs, reference(list(docs.values())), strict=True))
    ordered = training_order.materialise(spark.read.parquet(f"{sf}/documents.parquet"), shard_rows=100)
    folder = f"file://{tmp_path}/shards"
    rows = sorted(training_order.write_shards(ordered, folder).collect())
    assert [r["slot"] for r in rows] == list(range(len(rows)))
    got = defaultdict(dict)
    for r in rows:
        assert r["byte_offset"] == r["slot"] % 100 * 1024 and r["shard"] == r["slot"] // 100 and r["file"] == f"shard-{r['shard']:06d}.bin"
        data = (tmp_path / "shards" / r["file"]).read_bytes()[r["byte_offset"] : r["byte_offset"] + 1024]
        assert len(data) == 1024 and zlib.crc32(data) == r["ids_crc32"]
        got[r["doc_id"]][r["piece"]] = np.frombuffer(data, "<u2")[: r["n_tokens"]].tolist()
    assert {d: [x for _, p in sorted(own.items()) for x in p] for d, own in got.items()} == {d: ids + [2] for d, ids in want.items()}
    assert sorted(p.name for p in (tmp_path / "shards").iterdir()) == sorted({r["file"] for r in rows})
    whole = b"".join((tmp_path / "shards" / f).read_bytes() for f in sorted({r["file"] for r in rows}))
    assert len(whole) == 1024 * len(rows)
    assert b"".join(training_order.read_slots(folder, 95, 210, 1024, 100)) == whole[95 * 1024 : 305 * 1024]
    assert training_order.read_slots(folder, len(rows), 5, 1024, 100) == [] or len(rows) % 100


def test_training_order_query(spark, sf):
    rows = op9(spark, sf).collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows))) and all(r["byte_offset"] == r["slot"] % 8192 * 1024 for r in rows)


def test_slots_are_the_plain_permutation(spark, documents):
    """Each slot is recomputed from the row's number with a Feistel network in whole numbers."""
    ordered = training_order.token_sequences(documents([(i, "w " * (40 * i)) for i in range(60)]), length=64).orderBy("part", "nth").collect()
    place = spark.createDataFrame(ordered).repartition(5)
    n, got = len(ordered), {(r["doc_id"], r["piece"]): r["slot"] for r in training_order.training_order(place, key=7, shard_rows=16).collect()}
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1

    def mix(x):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> shift) * factor % (1 << 64)
        return x ^ x >> 31

    for number, r in enumerate(ordered):
        x = number
        while True:
            left, right = x >> half, x & mask
            for k in range(6):
                left, right = right, left ^ mix((right + mix(k + 1 + 7)) % (1 << 64)) & mask
            x = left << half | right
            if x < n:
                break
        assert got[r["doc_id"], r["piece"]] == x


def test_training_order_edges(spark, documents, reference):
    given = [(1, None), (1, None), (None, "x"), (3, "w " * 2000)]
    rows = training_order.materialise(documents(given)).collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    assert sum(r["n_tokens"] for r in rows) == sum(len(x) + 1 for x in reference([t or "" for _, t in given]))
    assert training_order.materialise(documents([])).count() == 0


def test_sequences_travel_in_compressed_blocks(spark, sf):
    """The same rows as one by one, whatever fills a sequence up, in less than two thirds of their bytes."""
    made = training_order.token_sequences(spark.read.parquet(f"{sf}/documents.parquet"), length=64).persist()
    odd = made.withColumn("ids", F.when(F.col("doc_id") % 3 == 0, F.concat(F.substring("ids", 1, 126), F.lit(b"\x07\x01"))).otherwise(F.col("ids")))
    for rows in (made, odd):
        want = {(r["doc_id"], r["piece"]): (r["n_tokens"], bytes(r["ids"])) for r in rows.collect()}
        got = training_order.training_order(rows, shard_rows=1000, parts=3).collect()
        assert len(got) == len(want) and {(r["doc_id"], r["piece"]): (r["n_tokens"], bytes(r["ids"])) for r in got} == want
        assert sorted((r["shard"], r["byte_offset"]) for r in got) == [(s // 1000, s % 1000 * 128) for s in range(len(got))]
    numbered = made.selectExpr("cast(row_number() over (order by part, nth) - 1 as bigint) as number", "octet_length(ids) as stride", "doc_id", "piece", "n_tokens", "ids")
    blocks = numbered.mapInArrow(training_order._blocks(made.count(), 99, 5000), "to int, block binary").agg(F.sum(F.octet_length("block"))).first()[0]
    assert blocks < made.count() * 128 * 2 / 3


def test_blocks_of_ids_are_small_and_exact():
    rng = np.random.default_rng(4)
    for distinct in (0, 1, 255, 256, 257, 512, 4811, 50257, 65536):
        ids = np.concatenate([np.arange(distinct), rng.integers(0, max(distinct, 1), distinct)]).astype("<u2")
        rng.shuffle(ids)
        data = ids.view(np.uint8)
        assert np.array_equal(training_order._decode(training_order._code(data), len(ids)), data)
    for values in ([b"ab", b"", b"abcd"], [b"a", b"bcd"], [b""]):
        rows = pa.record_batch([pa.array(range(len(values)), pa.int64()), pa.array(values, pa.binary())], names=["x", "ids"])
        assert training_order._unpack(pa.py_buffer(training_order._pack(rows))).equals(rows)
    ids = np.minimum(rng.zipf(1.3, 1 << 18), 50000).astype("<u2")
    rows = pa.record_batch([pa.array([ids.tobytes()], pa.binary())], names=["ids"])
    assert len(training_order._pack(rows)) < 0.9 * len(pa.Codec("zstd", compression_level=6).compress(ids.tobytes()))


def test_workers_give_memory_back():
    psutil = pytest.importorskip("psutil")
    encode = Encoder(*default_paths())
    texts = pa.array([" ".join(f"{i}{k:x}z" for k in range(6000)) for i in range(300)])
    for _ in encode.column(texts):
        pass
    before = psutil.Process().memory_info().rss
    del texts
    encode.forget()
    give_back()
    assert not encode.known and psutil.Process().memory_info().rss < before - (20 << 20)


def test_workers_forget_pieces_after_packing(spark, documents):
    """A worker that has encoded texts and lives on holds no pieces of them."""
    packing.pieces(documents([(i, f"some words of {i} and {i * i}") for i in range(300)], parts=8)).write.format("noop").mode("overwrite").save()

    def held(batches):
        from rowtide.llm import tokens

        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([sum(len(x.known) for x in tokens._HELD.values())], pa.int64())], names=["n"])

    assert {r["n"] for r in spark.range(0, 64, 1, 8).mapInArrow(held, "n long").collect()} == {0}
