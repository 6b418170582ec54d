"""The prefix trie of conversations, with subtree totals by a depth-band rollup (operator 12)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from rowtide.llm.columns import words
from rowtide.operators.numbering import number_rows
from rowtide.session import scratch_path

#: A node: its depth, and two 64-bit sums (exclusive or) of hashes of (place, role, text) over the turns that lead to it.
NODE = ["pos", "p", "q"]
#: A conversation: its id, and whether it has none. Rows without conv_id are one conversation.
CONV = ["no_id", "c"]

HEIGHT = 16


def number_turns(conversations: DataFrame) -> DataFrame:
    """Turns (no_id, c, pos, a, b, n_words, last) of conversations (conv_id, turn, role, text); a and b are hashes of (role, text).

    Turns go by turn, null first, then role, then hash; pos counts them from 1, last marks the final one. A row at pos 0
    stands for each conversation itself. Rows are sorted by ranges and numbered without bringing a conversation together,
    so one of any length, or one of many equal rows, is cut over tasks. Null role and text count as empty.
    """
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("role", "text"))
    slim = conversations.select(
        F.col("conv_id").isNull().alias("no_id"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("c"), "turn", role.alias("role"),
        F.xxhash64(F.lit(1), role, text).alias("a"), F.xxhash64(F.lit(2), role, text).alias("b"), F.size(words(text)).cast("long").alias("n_words"),
    )
    numbered = number_rows(slim, [*CONV, "turn", "role", "a", "b"], "n")
    firsts = numbered.groupBy(*CONV).agg(F.min("n").alias("first"), F.count("*").alias("size"))
    pos = F.col("n") - F.col("first") + 1
    turns = numbered.join(firsts, CONV).select(*CONV, pos.alias("pos"), "a", "b", "n_words", (pos == F.col("size")).alias("last"))
    return turns.unionByName(_tops(firsts, F.lit(False)))


def _tops(convs: DataFrame, last: Column) -> DataFrame:
    zero = F.lit(0).cast("long")
    return convs.select(*CONV, zero.alias("pos"), zero.alias("a"), zero.alias("b"), zero.alias("n_words"), last.alias("last"))


def share_openings(turns: DataFrame, base: Column, shared: Column, most: int) -> DataFrame:
    """Turns of rebuilt conversations: the first ``shared`` turns of conversation ``base``, then the own ones after as many.

    ``base`` and ``shared`` are expressions over ``c``, and ``shared`` is at most ``most``. Fewer turns there give all of
    them, a conversation that isn't there gives none, and so does a null id. A conversation may be left without turns.
    """
    own = _kept(turns.where("pos > 0"), "trie-turns")
    sizes = own.groupBy(*CONV).agg(F.max("pos").alias("size"))
    asked = F.when(~F.col("no_id"), shared).otherwise(0).cast("long")
    convs = sizes.select(*CONV, "size", F.when(~F.col("no_id"), base).alias("base"), asked.alias("asked"))
    there = sizes.where("not no_id").select(F.col("c").alias("base"), F.col("size").alias("base_size"))
    convs = convs.join(there, "base", "left").withColumn("got", F.least("asked", F.coalesce("base_size", F.lit(0))))
    convs = convs.select(*CONV, "base", "asked", "got", (F.col("got") + F.greatest(F.col("size") - F.col("asked"), F.lit(0))).alias("total"))
    opening = own.where(~F.col("no_id") & (F.col("pos") <= most)).select(F.col("c").alias("base"), "pos", "a", "b", "n_words")
    begun = convs.join(opening, "base").where("pos <= asked")
    moved = own.drop("last").join(convs, CONV).where("pos > asked").withColumn("pos", F.col("pos") - F.col("asked") + F.col("got"))
    columns = [*CONV, "pos", "a", "b", "n_words", (F.col("pos") == F.col("total")).alias("last")]
    return begun.select(*columns).unionByName(moved.select(*columns)).unionByName(_tops(convs, F.col("total") == 0))


def _paths(turns: DataFrame, height: int) -> DataFrame:
    """Each turn with its node (pos, p, q), the parent's (p0, q0), and ``up``: the nodes of its band on the way to it.

    Prefix sums are taken in chunks of a conversation, whole bands each, and the sums of the chunks before are added.
    """
    chunk = F.floor(F.col("pos") / height**3)
    own = [F.when(F.col("pos") > 0, F.xxhash64(F.lit(k), "pos", "a", "b")).otherwise(F.lit(0)).cast("long").alias(f"h{k}") for k in (1, 2)]
    rows = turns.select(*CONV, "pos", chunk.alias("chunk"), F.floor(F.col("pos") / height).alias("band"), *own, "n_words", "last")
    sums = rows.groupBy(*CONV, "chunk").agg(F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"))
    earlier = Window.partitionBy(*CONV).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(*CONV, "chunk", F.bit_xor("h1").over(earlier).alias("e1"), F.bit_xor("h2").over(earlier).alias("e2")).where("chunk > 0")
    so_far = Window.partitionBy(*CONV, "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    for k, name in ((1, "p"), (2, "q")):
        rows = rows.withColumn(name, F.bit_xor(f"h{k}").over(so_far))
    rows = rows.join(carry, [*CONV, "chunk"], "left")
    rows = rows.withColumns({name: F.col(name).bitwiseXOR(F.coalesce(f"e{k}", F.lit(0).cast("long"))) for k, name in ((1, "p"), (2, "q"))})
    in_band = Window.partitionBy(*CONV, "chunk", "band").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(
        *CONV, *NODE, F.col("p").bitwiseXOR(F.col("h1")).alias("p0"), F.col("q").bitwiseXOR(F.col("h2")).alias("q0"), "n_words", "last",
        F.collect_list(F.struct("p", "q")).over(in_band).alias("up"),
    )


def _kept(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: what follows uses it more than once, and lost executors cost no more than a read."""
    place = scratch_path(df.sparkSession, name)
    df.write.parquet(place)
    return df.sparkSession.read.parquet(place)


def rollup(tree: DataFrame, paths: DataFrame, deepest: int, totals: list[str], height: int = HEIGHT, step: int = 1) -> DataFrame:
    """(pos, p, q, *totals): every node's totals over its subtree.

    ``tree`` has a node in each row: pos, p, q, its parent's p0 and q0 at depth pos - step, its own values in ``totals``,
    and ``up``, the nodes from the first depth of its band of ``height`` steps to itself. ``paths`` are the turns.

    A node explodes only to the nodes of ``up``. Nodes below the band count through the roots of the next one: the band
    roots form a tree of their own, ``height`` times less deep, whose nodes hold the sums of their bands. That tree is
    rolled up the same way; then the completed total of every band root is given to its parent, and the bands are exploded.
    So there are as many rounds as ``deepest`` has digits to the base ``height``, and a node makes at most ``height`` rows a round.
    """
    wide, add = step * height, [F.sum(t).alias(t) for t in totals]
    if deepest >= wide:
        top = [(F.floor(F.col("pos") / wide) * wide).alias("pos"), F.col("up")[0]["p"].alias("p"), F.col("up")[0]["q"].alias("q")]
        sums = tree.select(*top, *totals).groupBy(*NODE).agg(*add)
        roots = tree.where(F.col("pos") % wide == 0).select(*NODE, "p0", "q0")
        above = tree.select(F.col("pos").alias("u_pos"), F.col("p").alias("p0"), F.col("q").alias("q0"), F.col("up")[0].alias("top"))
        linked = roots.withColumn("u_pos", F.col("pos") - step).join(above, ["u_pos", "p0", "q0"], "left")
        linked = linked.select(*NODE, F.coalesce("top.p", F.lit(0)).alias("p0"), F.coalesce("top.q", F.lit(0)).alias("q0"))
        in_band = Window.partitionBy(*CONV, F.floor(F.col("pos") / (wide * height))).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        lists = paths.where(F.col("pos") % wide == 0).select(*NODE, F.collect_list(F.struct("p", "q")).over(in_band).alias("up")).groupBy(*NODE).agg(F.first("up").alias("up"))
        upper = _kept(sums.join(linked, NODE).join(lists, NODE), "trie-bands")
        done = rollup(upper, paths, deepest, totals, height, wide)
        given = done.join(roots, NODE).where("pos > 0").select((F.col("pos") - step).alias("pos"), F.col("p0").alias("p"), F.col("q0").alias("q"), *totals).groupBy(*NODE).agg(*[F.sum(t).alias(f"g_{t}") for t in totals])
        tree = tree.join(given, NODE, "left").select(*NODE, "up", *[(F.col(t) + F.coalesce(f"g_{t}", F.lit(0))).alias(t) for t in totals])
    exploded = tree.select((F.floor(F.col("pos") / wide) * wide).alias("from"), *totals, F.posexplode("up").alias("nth", "node"))
    return exploded.select((F.col("from") + F.col("nth") * step).alias("pos"), "node.p", "node.q", *totals).groupBy(*NODE).agg(*add)


def _hash_rows(rows: list[tuple]):
    if rows:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], [*NODE, "ends_sha256"])


def _end_hashes(ends: DataFrame, ids_a_piece: int = 1 << 14) -> DataFrame:
    """(pos, p, q, ends_sha256): SHA-256 of the ids ``c`` that end in a node, in rising order, joined by commas.

    Ids are sorted by ranges of (node, id), so those of one node may lie in many tasks; each task joins them to pieces
    of text. SHA-256 has to read its input in order: the pieces of a node, a row for many ids each, are read one by one.
    """

    def pieces(batches):
        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(4)]
            changes = np.zeros(batch.num_rows, bool)
            changes[:1] = True
            for x in columns[:3]:
                changes[1:] |= x[1:] != x[:-1]
            starts = np.flatnonzero(changes)
            cuts = [a for s, e in zip(starts, np.append(starts[1:], batch.num_rows), strict=True) for a in range(int(s), int(e), ids_a_piece)]
            texts = [",".join(map(str, columns[3][a:b].tolist())) for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True)]
            yield pa.RecordBatch.from_arrays([*[pa.array(x[cuts]) for x in columns], pa.array(texts, pa.string())], ["pos", "p", "q", "c", "ids"])

    def hashes(batches):
        node, state = None, None
        for batch in batches:
            ready: list[tuple] = []
            for *now, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                if now == node:
                    state.update(b",")
                else:
                    if state:
                        ready.append((*node, state.hexdigest()))
                    node, state = now, hashlib.sha256()
                state.update(ids.encode())
            yield from _hash_rows(ready)
        if state:
            yield from _hash_rows([(*node, state.hexdigest())])

    ranged = ends.select(*NODE, "c").repartitionByRange(*NODE, "c").sortWithinPartitions(*NODE, "c")
    cut = ranged.mapInArrow(pieces, "pos long, p long, q long, c long, ids string")
    return cut.repartition(*NODE).sortWithinPartitions(*NODE, "c").mapInArrow(hashes, "pos long, p long, q long, ends_sha256 string")


def trie(turns: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Nodes of the prefix trie of conversations, given as ``turns`` of :func:`number_turns` or :func:`share_openings`.

    A node is a distinct sequence of (role, text) that some conversation begins with; all of them begin with the root
    (depth 0). Columns: conv_id, the smallest id of its members; depth; parent_conv_id, the parent's conv_id (root: null);
    n_convs, members; n_children; n_leaves, nodes without children in its subtree, itself included; saved_tokens, the sum
    over its subtree of (n_convs - 1) * words of the node's last text; ends_sha256, of the ids of members that end there.

    Equal sequences are told by 128 bits of hash. A conversation without an id is a member like any other, but names no
    node and is in no list of ids: a node of it alone has a null conv_id. No conversations give no rows.
    Members are counted before they are moved; texts aren't moved at all, only their hashes.
    """
    paths = _kept(_paths(turns, height), "trie-paths")
    nodes = paths.groupBy(*NODE).agg(
        F.min(F.when(~F.col("no_id"), F.col("c"))).alias("conv_id"), F.count("*").alias("n_convs"),
        F.min("n_words").alias("n_words"), F.min("p0").alias("p0"), F.min("q0").alias("q0"), F.first("up").alias("up"),
    )
    parent = [(F.col("pos") - 1).alias("pos"), F.col("p0").alias("p"), F.col("q0").alias("q")]
    nodes = _kept(nodes, "trie-nodes")
    children = nodes.where("pos > 0").select(*parent).groupBy(*NODE).agg(F.count("*").alias("n_children"))
    tree = nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    tree = tree.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("n_words"))
    tree = _kept(tree, "trie-tree")
    deepest = tree.agg(F.max("pos")).first()[0] or 0
    totals = rollup(tree.select(*NODE, "p0", "q0", "n_leaves", "saved_tokens", "up"), paths, deepest, ["n_leaves", "saved_tokens"], height)
    above = nodes.select(F.col("pos").alias("u_pos"), F.col("p").alias("p0"), F.col("q").alias("q0"), F.col("conv_id").alias("parent_conv_id"))
    named = tree.select(*NODE, "p0", "q0", "conv_id", "n_convs", "n_children").withColumn("u_pos", F.col("pos") - 1).join(above, ["u_pos", "p0", "q0"], "left")
    ends = _end_hashes(paths.where("last and not no_id"))
    rows = named.join(totals, NODE).join(ends, NODE, "left")
    return rows.select(
        "conv_id", F.col("pos").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
