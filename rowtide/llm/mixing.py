"""Mixing sources to target weights by min-cost flow (operator 7)."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from rowtide.llm.columns import whole_row

#: Cost of a word of the first, second and third pass over a document: it rises, so flow repeats as little as it can.
PASS_COSTS = (1, 3, 9)


class Network:
    """Min-cost flow by shortest augmenting paths; meant for patterns and sources, not for documents."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def flow(self, arc: int) -> int:
        return self.room[arc + 1]

    def run(self, source: int, sink: int) -> None:
        """As much flow as fits, at the least cost."""
        while True:
            far: list[float] = [float("inf")] * len(self.out)
            by, queue, queued = [-1] * len(self.out), deque([source]), [False] * len(self.out)
            far[source] = 0
            while queue:
                x = queue.popleft()
                queued[x] = False
                for arc in self.out[x]:
                    y = self.to[arc]
                    if self.room[arc] > 0 and far[x] + self.cost[arc] < far[y]:
                        far[y], by[y] = far[x] + self.cost[arc], arc
                        if not queued[y]:
                            queued[y] = True
                            queue.append(y)
            if by[sink] < 0:
                return
            path, x = [], sink
            while x != source:
                path.append(by[x])
                x = self.to[by[x] ^ 1]
            push = min(self.room[arc] for arc in path)
            for arc in path:
                self.room[arc] -= push
                self.room[arc ^ 1] += push


def share_out(sizes: dict[str | None, int], weight: Callable[[int], int], most: int = 3) -> dict[str | None, float]:
    """Targets by weight that share all sizes; a target stops at ``most`` times its source, and the rest share the excess.

    Sources weigh by their place in code point order, null last.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: weight(i) for i, s in enumerate(order)}
    left, free, target = float(sum(sizes.values())), list(order), {}
    while free:
        total = sum(weights[s] for s in free)
        over = [s for s in free if left * weights[s] / total > most * sizes[s]]
        if not over:
            return target | {s: left * weights[s] / total for s in free}
        for s in over:
            target[s] = float(most * sizes[s])
        left -= sum(target[s] for s in over)
        free = [s for s in free if s not in target]
    return target


class Quota(NamedTuple):
    """What the documents of one membership pattern give: whole passes over all, and words of one more pass."""

    passes: int
    rest: int


def route(patterns: dict[tuple[str | None, ...], int], targets: dict[str | None, float]) -> dict[tuple[str | None, ...], Quota]:
    """Words that each pattern gives, so that sources get their targets with as little repetition as can be."""
    places = {s: i for i, s in enumerate(targets)}
    net = Network(2 + len(patterns) + len(targets))
    sink, arcs = 1, {}
    for k, (pattern, size) in enumerate(sorted(patterns.items(), key=repr)):
        node = 2 + k
        arcs[pattern] = [net.arc(0, node, size, cost) for cost in PASS_COSTS]
        for s in pattern:
            net.arc(node, 2 + len(patterns) + places[s], len(PASS_COSTS) * size, 0)
    for s, t in targets.items():
        net.arc(2 + len(patterns) + places[s], sink, round(t), 0)
    net.run(0, sink)
    given = {p: sum(net.flow(a) for a in own) for p, own in arcs.items()}
    return {p: Quota(*divmod(given[p], patterns[p])) if patterns[p] else Quota(0, 0) for p in patterns}


def _code(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source.cast("string")))


def mix(docs: DataFrame, sources: Column, size: Column, weight: Callable[[int], int] = lambda i: 1 + i % 3, seed: int = 23, bins: int = 1024) -> DataFrame:
    """Columns doc (a struct of all columns as given), size, source_size, target and copies, one row per row of ``docs``.

    ``sources`` is an array of the sources that a document belongs to; source_size and target are those of the first in
    code point order. Documents are summed by membership pattern; the driver gets one number per pattern, shares
    targets out, and routes capacity to them. A pattern's quota is some whole passes and a rest: the rest is filled
    with documents in a seeded order, up to the one that brings it nearest. That order is cut into ``bins`` by hash, so a
    pattern with a third of all documents is many tasks. copies is how often the mix takes the document, 3 at most.

    The same rows and seed give the same mix. A document without words has size 0 and isn't taken; a document without
    any source counts as source null; repeated rows are taken one by one; an empty table gives no rows.
    """
    listed = F.coalesce(sources, F.array().cast("array<string>"))
    listed = F.when(F.size(listed) == 0, F.array(F.lit(None).cast("string"))).otherwise(listed)
    pattern = F.array_sort(F.array_distinct(F.transform(listed, _code)))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(row.alias("doc"), size.cast("long").alias("size"), F.concat_ws("\x00", pattern).alias("pattern"), whole_row(docs, seed).alias("h"))
    keyed = keyed.withColumn("bin", F.pmod("h", F.lit(bins)).cast("int"))
    sums = keyed.groupBy("pattern", "bin").agg(F.sum("size").alias("n"))
    totals = {r["pattern"]: r["n"] for r in sums.groupBy("pattern").agg(F.sum("n").alias("n")).collect()}
    members = {p: tuple(None if s == "-" else s[1:] for s in p.split("\x00")) for p in totals}
    sizes: dict[str | None, int] = {}
    for p, n in totals.items():
        for s in members[p]:
            sizes[s] = sizes.get(s, 0) + n
    targets = share_out(sizes, weight, len(PASS_COSTS))
    quotas = route({members[p]: n for p, n in totals.items()}, targets)
    first = {p: min(members[p], key=lambda s: (s is None, s or "")) for p in totals}
    plan = docs.sparkSession.createDataFrame(
        [(p, sizes[first[p]], float(targets[first[p]]), *quotas[members[p]]) for p in totals],
        "pattern string, source_size long, target double, passes long, rest long",
    )
    before = F.sum("n").over(Window.partitionBy("pattern").orderBy("bin")) - F.col("n")
    firsts = sums.select("pattern", "bin", before.alias("before"))
    inside = F.sum("size").over(Window.partitionBy("pattern", "bin").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = keyed.withColumn("inside", inside).join(firsts, ["pattern", "bin"]).join(F.broadcast(plan), "pattern")
    more = (2 * (F.col("before") + F.col("inside")) + F.col("size") <= 2 * F.col("rest")) & (F.col("rest") > 0)
    copies = F.when(F.col("size") > 0, F.col("passes") + more.cast("long")).otherwise(F.lit(0).cast("long"))
    return placed.select("doc", "size", "source_size", "target", copies.alias("copies"))


def repeat_rows(docs: DataFrame, sources: Column, size: Column) -> DataFrame:
    """The mix itself: every row as often as it is taken; columns as given."""
    mixed = mix(docs, sources, size).where("copies > 0")
    rows = mixed.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy"))
    return rows.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
