"""Groups of a weighted graph by modularity, and its layout.

Nodes move to the neighbouring group that raises modularity most, half of them at a time (by a hash of their name), so
that two neighbours seldom swap. When a round no longer raises it, groups become the nodes of a smaller graph, and so on, until
nothing moves. Gains are compared as whole numbers and ties go to the smaller name, so results don't depend on the order
of rows. Links are dealt once, in buckets of their first node, and repeated ones are summed there. Of up to FEW nodes each bucket is packed,
some LINKS_A_BUCKET links or those of its nodes, and groups go to the packed links; the groups, a number a node, pass the driver. More nodes
are joined with the links, where every step is a join or a sum by node or by node and group.

Nulls: links without an end or weight are left out, and so are weights of 0 or less. Repeated links add up. A link of a node to itself counts for
its group. An empty graph has no groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmill.operators.frequency import numbered
from litmill.operators.semantic import FEW, few
from litmill.operators.settled import bucketed, settled

#: Rounds of a level, and levels, at most; each stops when modularity does not rise.
ROUNDS, LEVELS = 50, 20
#: Links to a bucket, about; one task reads it.
LINKS_A_BUCKET = 500_000


def _exact(x: Column) -> Column:
    return x.cast("decimal(19,0)")


def half_of(node: Column) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(2))


def _buckets(links: DataFrame) -> int:
    return -(-links.count() // LINKS_A_BUCKET) or 1


def _both(edges: DataFrame) -> DataFrame:
    """u, v, w: each link from both ends; those to the node itself once, with twice the weight. A node's links lie in one bucket and stay there."""
    loops, links = edges.where("src = dst"), edges.where("src <> dst")
    ways = links.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col("weight").alias("w"))
    ways = ways.unionByName(links.select(F.col("dst").alias("u"), F.col("src").alias("v"), F.col("weight").alias("w")))
    ways = ways.unionByName(loops.select(F.col("src").alias("u"), F.col("dst").alias("v"), (2 * F.col("weight")).alias("w")))
    buckets = _buckets(ways)
    return bucketed(ways.repartition(buckets, "u").groupBy("u", "v").agg(F.sum("w").cast("bigint").alias("w")), buckets, "u")


def _quality(both: DataFrame, member: DataFrame, total: int) -> float:
    """Modularity of the groups: the links inside them are one sum over all, so no link moves."""
    held = few(member)
    u, v = (held.select(F.col("node").alias(x), F.col("c").alias(f"c{x}")) for x in ("u", "v"))
    inside = both.join(u, "u").join(v, "v").where("cu = cv").agg(F.sum("w")).first()[0] or 0
    share = F.col("tot") / F.lit(float(total))
    return inside / total - (member.groupBy("c").agg(F.sum("k").alias("tot")).agg(F.sum(share * share)).first()[0] or 0.0)


def _moved(both: DataFrame, member: DataFrame, total: int, half: int) -> DataFrame:
    """node, k, c after the nodes of one half have moved. Only their links are read, and up to FEW nodes and groups are sent to them."""
    member = few(member)
    sizes = few(settled(member.groupBy("c").agg(F.sum("k").alias("tot"))))
    own = member.where(half_of(F.col("node")) == half).join(sizes, "c").select(F.col("node").alias("u"), "k", F.col("c").alias("own"), F.col("tot").alias("own_tot"))
    links = both.where((half_of(F.col("u")) == half) & (F.col("u") != F.col("v"))).join(member.select(F.col("node").alias("v"), "c"), "v")
    choices = links.groupBy("u", "c").agg(F.sum("w").alias("w")).join(sizes, "c").join(own, "u")
    # Products are at most the square of the total.
    whole = _exact if total * total >= 2**63 else lambda x: x.cast("bigint")
    rest = F.col("tot") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0)
    loss = whole(F.col("k")) * whole(rest) - whole(F.lit(total)) * whole(F.col("w"))
    stays = F.when(F.col("c") == F.col("own"), 0).otherwise(1)
    best = choices.groupBy("u").agg(F.min(F.struct(loss.alias("loss"), stays.alias("stays"), "c")).alias("best")).select(F.col("u").alias("node"), "best")
    # A node's own group is a choice though it may have no link to it.
    alone = whole(F.col("k")) * whole(F.col("own_tot") - F.col("k"))
    to = own.join(best, F.col("u") == F.col("node"), "left").select("u", F.when((F.col("best.loss") < alone), F.col("best.c")).otherwise(F.col("own")).alias("to"))
    return member.join(to, F.col("node") == F.col("u"), "left").select("node", "k", F.coalesce("to", "c").alias("c"))


def _level(edges: DataFrame) -> tuple[DataFrame, float, bool]:
    """node, c of one level, the modularity, and whether anything moved."""
    both = _both(edges)
    degrees = settled(both.groupBy("u").agg(F.sum("w").alias("k")))
    total = degrees.agg(F.sum("k")).first()[0]
    if total * total < 2**63 and degrees.count() <= FEW:
        return _packed_level(both, degrees, total)
    now = degrees.select(F.col("u").alias("node"), "k", F.col("u").alias("c"))
    quality, moved = _quality(both, now, total), False
    for _ in range(ROUNDS):
        then = now
        for half in (0, 1):
            then = settled(_moved(both, then, total, half))
        better = _quality(both, then, total)
        if better <= quality + 1e-12:
            break
        now, quality, moved = then, better, True
    return now.select("node", "c"), quality, moved


def _pack(links: pa.Table) -> pa.Table:
    """A bucket's links as one row of arrays, those of a node together."""
    i, j, w = (links[x].to_numpy() for x in "ijw")
    order = np.argsort(i, kind="stable")
    return pa.table({x: pa.array([a[order].astype(t).tobytes()], pa.binary()) for x, a, t in (("i", i, "i4"), ("j", j, "i4"), ("w", w, "i8"))})


def _better_groups(i, j, w, c, k, tot, total):
    """Nodes and the groups they move to, of those whose links (i in order, j, w) are given: as _moved()."""
    if not len(i):
        return i, i
    code = i * np.int64(len(c)) + c[j]
    order = np.argsort(code)
    code = code[order]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    to, w, u = code[first] % len(c), np.add.reduceat(w[order], first), code[first] // len(c)
    loss = k[u] * (tot[to] - np.where(to == c[u], k[u], 0)) - total * w
    first = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
    each, size = u[first], np.diff(np.r_[first, len(u)])
    least = np.minimum.reduceat(loss, first)
    rank = np.where(loss == np.repeat(least, size), np.where(to == c[u], -1, to), len(c))
    to = np.minimum.reduceat(rank, first)
    moves = (to >= 0) & (least < k[each] * (tot[c[each]] - k[each]))
    return each[moves], to[moves]


def _packed_level(both: DataFrame, degrees: DataFrame, total: int) -> tuple[DataFrame, float, bool]:
    """The same for up to FEW nodes: their groups are arrays that go to the packed links, and only moves come back."""
    spark = both.sparkSession
    names = settled(numbered(degrees, "place", F.col("u")).select(F.col("u").alias("node"), (F.col("place") - 1).cast("bigint").alias("idx"), "k", half_of(F.col("u")).alias("half")))
    i, j = (F.broadcast(names.select(F.col("node").alias(x), F.col("idx").alias(y))) for x, y in (("u", "i"), ("v", "j")))
    indexed = both.join(i, "u").join(j, "v").select(F.hash("u").alias("part"), "i", "j", "w")
    parts = _buckets(both)
    packed = settled(indexed.withColumn("part", F.pmod("part", F.lit(parts))).groupBy("part").applyInArrow(_pack, "i binary, j binary, w binary"))
    held = names.select("idx", "k", "half").toArrow().sort_by("idx")
    k, halves = held["k"].to_numpy(), held["half"].to_numpy()

    def passed(c: np.ndarray, half: int) -> tuple[int, np.ndarray]:
        """The weight inside the groups, and the groups after the nodes of one half have moved."""
        sent = spark.sparkContext.broadcast((c, k, halves == half, np.bincount(c, k, len(c)).astype("i8")))

        def moves(batches):
            c, k, mine, tot = sent.value
            for batch in batches:
                for i, j, w in zip(*(batch.column(x).to_pylist() for x in "ijw"), strict=True):
                    i, j, w = np.frombuffer(i, "i4"), np.frombuffer(j, "i4"), np.frombuffer(w, "i8")
                    some = mine[i] & (i != j)
                    u, to = _better_groups(i[some], j[some], w[some], c, k, tot, total)
                    yield pa.RecordBatch.from_pydict({"inside": pa.array([int(w[c[i] == c[j]].sum())], pa.int64()), "u": pa.array([u.astype("i8").tobytes()], pa.binary()), "c": pa.array([to.astype("i8").tobytes()], pa.binary())})

        got, c = packed.mapInArrow(moves, "inside bigint, u binary, c binary").toArrow(), c.copy()
        sent.destroy()
        for u, to in zip(got["u"].to_pylist(), got["c"].to_pylist(), strict=True):
            c[np.frombuffer(u, "i8")] = np.frombuffer(to, "i8")
        return sum(got["inside"].to_pylist()), c

    def quality_of(inside: int, c: np.ndarray) -> float:
        return inside / total - float(((np.bincount(c, k, len(c)) / total) ** 2).sum())

    # A pass gives the quality of the groups it starts from, so a round's is known from the next one's first half.
    now, quality, moved = np.arange(len(k)), None, False
    then, inside = now, None
    for at in range(ROUNDS + 1):
        inside, half_way = passed(then, 0)
        better = quality_of(inside, then)
        if at and better <= quality + 1e-12:
            break
        now, quality, moved = then, better, at > 0
        if at < ROUNDS:
            then = passed(half_way, 1)[1]
    made = spark.createDataFrame(pa.table({"idx": np.arange(len(now)), "at": now}), "idx bigint, at bigint")
    member = made.join(names.select("idx", "node"), "idx").join(names.select(F.col("idx").alias("at"), F.col("node").alias("c")), "at").select("node", "c")
    return settled(member), quality, moved


def communities(edges: DataFrame, *, src: str = "src", dst: str = "dst", weight: str = "weight") -> tuple[DataFrame, float]:
    """node, community (the smallest node in it), and the modularity."""
    now = settled(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.col(weight).cast("bigint").alias("weight")).where("src is not null and dst is not null and weight > 0"))
    every = now.select(F.col("src").alias("node")).union(now.select("dst")).distinct()
    found, quality = settled(every.select("node", F.col("node").alias("community"))), 0.0
    if now.isEmpty():
        return found, quality
    for _ in range(LEVELS):
        member, quality, moved = _level(now)
        if not moved:
            break
        member = few(member)
        found = settled(found.join(member.select(F.col("node").alias("community"), "c"), "community").select("node", F.col("c").alias("community")))
        a, b = (member.select(F.col("node").alias(x), F.col("c").alias(y)) for x, y in (("src", "a"), ("dst", "b")))
        now = settled(now.join(a, "src").join(b, "dst").groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.sum("weight").cast("bigint").alias("weight")))
    least = found.groupBy("community").agg(F.min("node").alias("least"))
    return settled(found.join(least, "community").select("node", F.col("least").alias("community"))), quality


def layout(edges: DataFrame, *, src: str = "src", dst: str = "dst", weight: str = "weight", steps: int = 200, seed: int = 7) -> DataFrame:
    """node, x, y: linked nodes near each other, others apart, by the forces of a t-SNE map with the links as its graph."""
    from litmill.operators import tsne

    both = _both(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.col(weight).cast("bigint").alias("weight")).where("src is not null and dst is not null and weight > 0")).where("u <> v")
    nodes = settled(numbered(both.select(F.col("u").alias("node")).distinct(), "rank", F.col("node")).select("node", (F.col("rank") - 1).alias("idx")))
    n, total = nodes.count(), both.agg(F.sum("w")).first()[0]
    if n < 3:
        return nodes.select("node", F.col("idx").cast("double").alias("x"), F.lit(0.0).alias("y"))
    a, b = (nodes.select(F.col("node").alias(x), F.col("idx").alias(y)) for x, y in (("u", "i"), ("v", "j")))
    links = settled(both.join(a, "u").join(b, "v").select("i", "j", (F.col("w") / F.lit(float(total))).alias("p")))
    # Places to start from: even round a circle, in the order of a hash.
    angle = F.col("idx") * F.lit(2 * np.pi * 0.6180339887498949) + F.lit(float(seed))
    start = nodes.select("idx", F.array(F.cos(angle) * 1e-2, F.sin(angle) * 1e-2).alias("y"))
    heaviest = links.groupBy("i").agg(F.sum("p").alias("p")).agg(F.max("p")).first()[0]
    placed = tsne.embed(start, links, n, steps_=steps, rate=min(tsne.rate_of(n), 1 / (12 * heaviest)))  # or hubs would overshoot
    return nodes.join(placed, "idx").select("node", F.col("tsne_x").alias("x"), F.col("tsne_y").alias("y"))
