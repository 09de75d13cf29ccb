"""Nearest neighbours by few stable projections, a kd-tree over them, and a chi-square stopping test.

Inner products become distances by one more coordinate: with M the largest norm, x gets sqrt(M^2 - |x|^2) and a query 0,
so the largest product is the least distance. Points are projected by DIMS Gaussian directions; then a projected
distance over the true one, squared, follows a chi-square law. A kd-tree over the projections gives its cells in the
order of their distance from a query's projection, and points of these cells are verified with true products. The search
ends once a point at no more than the distance of the k-th best so far would, with probability SURE, have been projected
nearer than the next cell.

On the cluster, the tree's upper part is cut from a bounded sample of projections; every row goes to its cell. There are as
many cells as leave BLOCK rows in each, up to CELLS. Cells are
held in blocks of about BLOCK rows, by a hash, so one value that very many rows share fills many blocks. A query
first searches the cell it falls in, which bounds its k-th distance, and then the cells that the test doesn't rule out.
Within a block the lower part of the tree leads the search. Rows of a cell that no query goes to stay where they are; the others
move once. A task holds a block's rows while the queries that go to it pass by, QUERIES at a time.

Vectors that are null, zero, or hold nulls or non-finite components take no part, nor do null ids. A vector that is shorter
than the longest counts as if zeros followed. Of rows with one id, one is the query; none is its own neighbour. Ties go to the smaller id; equal vectors get
equal products. Empty tables give empty results. Other columns are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from litmill.llm._base import DOCS_A_FILE, materialise, table

DIMS, SURE, SEED = 8, 0.97, 11
BLOCK, LEAF, QUERIES, CELLS = 8192, 128, 16_384, 1 << 16
#: Projections of the sample that the upper tree is cut from: so many for each cell, and at least.
PER_CELL, SAMPLE = 8, 20_000
#: Part of the largest product possible by which products may be off.
ROUNDING = 1e-12
#: Queries whose products with a block are held at once.
AT_ONCE = 256


def chi_square(x: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """The distribution function for an even number of degrees of freedom."""
    h = np.minimum(x, 1e4) / 2
    term, total = np.ones_like(h), np.ones_like(h)
    for i in range(1, dims // 2):
        term = term * h / i
        total = total + term
    return 1 - np.exp(-h) * total


class Projection:
    def __init__(self, length: int, norm: float, seed: int = SEED):
        self.norm2 = norm * norm
        self.axes = np.random.default_rng(seed).standard_normal((length + 1, DIMS))

    def points(self, x: np.ndarray) -> np.ndarray:
        more = np.sqrt(np.maximum(self.norm2 - (x * x).sum(axis=1), 0))
        return x @ self.axes[:-1] + more[:, None] * self.axes[-1]

    def queries(self, q: np.ndarray) -> np.ndarray:
        return q @ self.axes[:-1]

    def squared(self, q2: np.ndarray, product: np.ndarray) -> np.ndarray:
        return np.maximum(q2 + self.norm2 - 2 * product, 0)


def split(points: np.ndarray, size: int) -> list[np.ndarray]:
    """Places of the points, in leaves of a kd-tree: the widest side is halved until a leaf has ``size`` or fewer."""
    todo, out = [np.arange(len(points))], []
    while todo:
        at = todo.pop()
        if len(at) <= size:
            out.append(at)
            continue
        own = points[at]
        axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
        order = np.argsort(own[:, axis], kind="stable")
        todo += [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]
    return [x for x in out if len(x)]


class Cells:
    """The upper tree, cut from a sample: a full binary tree of sides and thresholds."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.axis, self.cut = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
        parts = {0: sample}
        for node in range((1 << depth) - 1):
            own = parts.pop(node, sample[:0])
            if len(own):
                self.axis[node] = np.argmax(own.max(axis=0) - own.min(axis=0))
                self.cut[node] = np.median(own[:, self.axis[node]])
            right = own[:, self.axis[node]] > self.cut[node]
            parts[2 * node + 1], parts[2 * node + 2] = own[~right], own[right]

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axis[node]] > self.cut[node])
        return node - (1 << self.depth) + 1


def box_distance(low: np.ndarray, high: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of each query from each box."""
    out = np.zeros((len(q), len(low)))
    for d in range(q.shape[1]):
        x = q[:, d, None]
        gap = np.maximum(np.maximum(low[None, :, d] - x, x - high[None, :, d]), 0)
        out += gap * gap
    return out


def search_block(projection: Projection, ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, reach: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's best of a block, with ``reach`` the squared distance of its k-th best so far: places of queries and rows, products."""
    points = projection.points(x)
    leaves = split(points, LEAF)
    low, high = (np.array([f(points[at], axis=0) for at in leaves]) for f in (np.min, np.max))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for first in range(0, len(q), AT_ONCE):
        own, own_ids, d_k = q[first : first + AT_ONCE], qids[first : first + AT_ONCE], reach[first : first + AT_ONCE].copy()
        q2 = (own * own).sum(axis=1)
        far = box_distance(low, high, projection.queries(own))
        order = np.argsort(far, axis=1, kind="stable")
        product = np.full((len(own), len(x)), -np.inf)
        best = np.full((len(own), k), -np.inf)
        active = np.arange(len(own))
        for turn in range(len(leaves)):
            leaf = order[active, turn]
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio = np.where(d_k[active] > 0, far[active, leaf] / d_k[active], np.inf)
            go = (far[active, leaf] == 0) | ~(chi_square(ratio) >= SURE)
            active, leaf = active[go], leaf[go]
            if not len(active):
                break
            for i in np.unique(leaf):
                rows, at = active[leaf == i], leaves[i]
                got = own[rows] @ x[at].T
                got[own_ids[rows][:, None] == ids[at][None, :]] = -np.inf
                product[np.ix_(rows, at)] = got
                best[rows] = -np.partition(-np.concatenate([best[rows], got], axis=1), k - 1, axis=1)[:, :k]
                least = best[rows].min(axis=1)
                d_k[rows] = np.minimum(d_k[rows], np.where(np.isfinite(least), projection.squared(q2[rows], np.where(np.isfinite(least), least, 0)), np.inf))
        # What is farther than the k-th best that is known already is not passed on.
        least = np.maximum(best.min(axis=1), np.where(np.isfinite(reach[first : first + AT_ONCE]), (q2 + projection.norm2 - reach[first : first + AT_ONCE]) / 2, -np.inf))
        slack = ROUNDING * np.sqrt(q2 * projection.norm2)
        a, b = np.nonzero((product >= np.where(np.isfinite(least), least - slack, -np.inf)[:, None]) & np.isfinite(product))
        exact = np.empty(len(a))
        for s in range(0, len(a), 1 << 14):  # summed in one order for every row, so that equal vectors tie
            exact[s : s + (1 << 14)] = (own[a[s : s + (1 << 14)]] * x[b[s : s + (1 << 14)]]).sum(axis=1)
        by = np.lexsort((ids[b], -exact, a))
        a, b, exact = a[by], b[by], exact[by]
        start = np.searchsorted(a, a)
        keep = np.arange(len(a)) - start < k
        found.append((a[keep] + first, b[keep], exact[keep]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _matrix(column: pa.ChunkedArray | pa.Array, length: int) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)


def _usable(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    v = F.transform(F.col(vector), lambda e: e.cast("double"))
    rows = vectors.select(F.col(key).alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    odd = F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = rows.where(~odd & F.exists("v", lambda e: e != 0))
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    return rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(longest) - F.size("v")))), longest


def _dealt(placed: DataFrame, queries: DataFrame, asked: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (kind 0) and queries (kind 1) as they meet, with cell and block: a row once, a query once for each block that it searches."""
    blocks = F.broadcast(blocks)  # a row a cell
    wanted = F.broadcast(materialise(asked.select("cell").distinct().join(blocks, "cell"), CELLS))
    held = placed.join(wanted, "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), F.lit(0).alias("kind"), "id", "v", F.lit(None).cast("double").alias("reach"))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    dealt = asked.join(blocks, "cell").join(queries.select("id", "v"), "id").select("cell", every.alias("block"), F.lit(1).alias("kind"), "id", "v", "reach")
    return held, dealt


def nearest(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 20, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query, the rows whose id ``every`` divides."""
    spark = vectors.sparkSession
    schema = f"query_id {dict(vectors.dtypes)[key]}, vec_id {dict(vectors.dtypes)[key]}, score double"
    rows, length = _usable(vectors, key, vector)
    if not length:
        return spark.createDataFrame([], schema).select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e))
    n, top = rows.agg(F.count("*"), F.max(norm)).first()
    projection = Projection(length, top)
    depth = max(0, min(int(math.log2(CELLS)), math.ceil(math.log2(max(1, n / block)))))
    size = max(SAMPLE, PER_CELL << depth)
    share = min(1.0, size / n)

    def project(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(projection.points(_matrix(batch.column(0), length))), pa.list_(pa.float64()))], names=["p"])

    chosen = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("v").limit(2 * size)
    sample = _matrix(chosen.mapInArrow(project, "p array<double>").toArrow()["p"], DIMS)
    sent = spark.sparkContext.broadcast((projection, Cells(sample, depth)))

    def place(batches):
        projection, cells = sent.value
        for batch in batches:
            x = _matrix(batch.column(1), length)
            points = projection.points(x)
            at = cells.of(points)
            home = cells.of(projection.queries(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at), pa.array(home), pa.array(list(points), pa.list_(pa.float64()))], names=["id", "v", "cell", "home", "p"])

    kind = dict(vectors.dtypes)[key]
    placed = materialise(rows.mapInArrow(place, f"id {kind}, v array<double>, cell bigint, home bigint, p array<double>"), n, DOCS_A_FILE)
    sides = [f(F.col("p")[d]).alias(f"{name}{d}") for name, f in (("l", F.min), ("h", F.max)) for d in range(DIMS)]
    boxes = placed.groupBy("cell").agg(F.count("*").alias("n"), *sides).collect()  # CELLS rows at most
    blocks = materialise(placed.groupBy("cell").agg(F.ceil(F.count("*") / block).alias("blocks")), len(boxes))
    is_query = F.pmod("id", F.lit(every)) == 0
    n_queries = placed.where(is_query).count()
    queries = placed.where(is_query).groupBy("id").agg(F.min(F.struct("v", "home")).alias("x")).select("id", "x.v", "x.home")

    id_type = to_arrow_type(vectors.schema[key].dataType)

    def run(asked: DataFrame) -> DataFrame:
        """asked: id, cell, reach, written. Every block of the cell is searched."""
        held, dealt = _dealt(placed, queries, asked, blocks)

        def search(rows: list[pa.RecordBatch], asked: list[pa.RecordBatch]):
            if not rows or not asked:
                return
            left, right = pa.Table.from_batches(rows), pa.Table.from_batches(asked)
            ids, qids = left["id"].to_numpy(), right["id"].to_numpy()
            a, b, s = search_block(sent.value[0], ids, _matrix(left["v"], length), qids, _matrix(right["v"], length), right["reach"].to_numpy(), k)
            for at in range(0, len(a), 1 << 16):
                one = slice(at, at + (1 << 16))
                kinds = [id_type, id_type, pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((qids[a[one]], ids[b[one]], s[one]), kinds, strict=True)], names=["query_id", "vec_id", "score"])

        def walk(batches):
            of, rows, asked, n = None, [], [], 0
            for batch in batches:
                keys = np.stack([batch.column(c).to_numpy() for c in range(3)], axis=1)
                cuts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1), [True]])) if len(keys) else []
                for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
                    cell, block_, which = keys[start].tolist()
                    part = batch.slice(start, stop - start)
                    if (cell, block_) != of:
                        yield from search(rows, asked)
                        of, rows, asked, n = (cell, block_), [], [], 0
                    if which == 0:
                        rows.append(part)
                        continue
                    asked.append(part)
                    n += part.num_rows
                    if n >= QUERIES:
                        yield from search(rows, asked)
                        asked, n = [], 0
            yield from search(rows, asked)

        both = held.unionByName(dealt).repartition("cell", "block").sortWithinPartitions("cell", "block", "kind")
        return both.mapInArrow(walk, schema)

    near = materialise(run(materialise(queries.select("id", F.col("home").alias("cell"), F.lit(float("inf")).alias("reach")), n_queries)), k * n_queries)
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = near.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
    cells = np.array([r["cell"] for r in boxes], np.int64)
    low, high = (np.array([[r[f"{name}{d}"] for d in range(DIMS)] for r in boxes]) for name in "lh")
    edges = spark.sparkContext.broadcast((cells, low, high))

    def route(batches):
        projection = sent.value[0]
        cells, low, high = edges.value
        for batch in batches:
            q = _matrix(batch.column(1), length)
            least = batch.column(3).to_numpy(zero_copy_only=False).astype(np.float64)
            reach = np.where(np.isnan(least), np.inf, projection.squared((q * q).sum(axis=1), np.where(np.isnan(least), 0, least)))
            far = box_distance(low, high, projection.queries(q))
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio = np.where(reach[:, None] > 0, far / reach[:, None], np.inf)
            go = ((far == 0) | ~(chi_square(ratio) >= SURE)) & (cells[None, :] != batch.column(2).to_numpy()[:, None])
            a, b = np.nonzero(go)
            for s in range(0, len(a), 4096):
                i = pa.array(a[s : s + 4096])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(i), pa.array(cells[b[s : s + 4096]]), pa.array(reach[a[s : s + 4096]])], names=["id", "cell", "reach"])

    routed = queries.join(kth, "id", "left").select("id", "v", "home", "least").mapInArrow(route, f"id {kind}, cell bigint, reach double")
    both = near.unionByName(run(materialise(routed)))
    return both.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
