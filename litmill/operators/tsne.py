"""t-SNE maps: a neighbour graph from sorted orders, attraction over its edges, repulsion from sums over a grid.

Neighbours. Rows are sorted in several orders, each by the signs of random projections and then by a projection. A row's
neighbours in space are near it in one order or another, so in each the rows of every window are compared with each other. Windows are
cut by exact ranks, overlap by half and have a fixed number of rows, whatever repeats or crowds there are; a table of one window
is compared whole. Each row keeps its nearest, and a bisection finds the width at which they have the perplexity.

Map. Rows lie in blocks of a fixed number, by their rank in the first order. Each block has its rows' places, the edges of its rows,
the places of the rows that edges lead to, and the sums of all places over a grid. It makes some steps with the rest held
still; then places and sums are exchanged and written. Repulsion is the grid's sums folded with the kernel by Fourier
transforms, so a step costs rows, edges and grid cells. A table of one block needs no exchange. A hub's edges are in its block,
as numbers.

Exchange. Some blocks that follow each other are a part, which one task steps. Edges are dealt by part once, in buckets, and stay there; only
places move, each once to each part that has edges to it. There are few parts, as long as their edges fit a task, so a row's
place goes to no more of them in a larger table.

Coordinates are the same for the same table on the same machine. Nulls: rows without a vector are left out. Equal vectors are neighbours at distance 0.
A table of fewer than three rows gets its components as the map.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litmill.operators import landscape
from litmill.operators.frequency import numbered
from litmill.operators.settled import bucketed, settled

#: Rows that overlap between windows; orders of a table of more than one window; rows of a block.
HALF, ORDERS, BLOCK = 512, 4, 4096
#: Signs by which an order sorts before its projection.
SIGNS = 12
#: Steps, those of them with exaggerated attraction, its factor, and steps between exchanges.
STEPS, EARLY, EXAGGERATION, ROUND = 500, 125, 12.0, 10
#: Cells along a side of the grid, at least and at most, and their width where the most allow it.
LEAST_CELLS, MOST_CELLS, CELL = 48, 256, 0.5
#: Edges that are packed together; parts of a table of more blocks than that, at least; edges of a part of several blocks, about, at most.
PART, PARTS, PART_EDGES = 1 << 16, 24, 1 << 22


def perplexity_of(n: int) -> int:
    return max(8, min(30, (n - 1) // 5))


def _orders(points: DataFrame, d: int, orders: int, seed: int) -> DataFrame:
    """o, code, at, idx, x: every row in each order."""
    rng = np.random.default_rng(seed)
    planes = rng.normal(size=(orders, d, SIGNS + 1))

    def run(batches):
        for b in batches:
            x = np.array(b.column(1).to_pylist(), np.float64).reshape(b.num_rows, d)
            for o in range(orders):
                p = x @ planes[o]
                code = ((p[:, :SIGNS] > 0) << np.arange(SIGNS)[::-1]).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), o)), pa.array(code), pa.array(p[:, SIGNS]), b.column(0), b.column(1)], names=["o", "code", "at", "idx", "x"])

    return points.select("idx", "x").mapInArrow(run, "o bigint, code bigint, at double, idx bigint, x array<double>")


def neighbours(points: DataFrame, n: int, d: int, k: int, *, half: int = HALF, orders: int = ORDERS, seed: int = 42) -> DataFrame:
    """points: idx (0 to n - 1), x. Result: idx, found: array of near (array<bigint>), d2 (array<double>), a list from each window of the row."""
    last = max(0, -(-n // half) - 2)  # the last window
    orders = orders if last else 1
    placed = numbered(_orders(points, d, orders, seed), "rank", F.col("o"), F.col("code"), F.col("at"), F.col("idx"))
    slot = F.floor((F.col("rank") - 1 - F.col("o") * n) / half)
    windows = F.array_distinct(F.transform(F.array(slot - 1, slot), lambda w: F.least(F.greatest(w, F.lit(0)), F.lit(last))))
    dealt = placed.select("o", "rank", "idx", "x", F.explode(windows).alias("w"))

    def near(t: pa.Table) -> pa.Table:
        t = t.sort_by("rank")
        idx = t.column("idx").to_numpy()
        x = np.array(t.column("x").to_pylist(), np.float64).reshape(len(idx), d)
        kk = min(k, len(idx) - 1)
        if kk < 1:
            return pa.table({"idx": pa.array([], pa.int64()), "near": pa.array([], pa.list_(pa.int64())), "d2": pa.array([], pa.list_(pa.float64()))})
        norm = (x * x).sum(axis=1)
        d2 = np.maximum(norm[:, None] + norm[None] - 2 * (x @ x.T), 0.0)
        np.fill_diagonal(d2, np.inf)
        best = np.argpartition(d2, kk - 1, axis=1)[:, :kk]
        return pa.table({"idx": idx, "near": pa.array(list(idx[best]), pa.list_(pa.int64())), "d2": pa.array(list(np.take_along_axis(d2, best, 1)), pa.list_(pa.float64()))})

    lists = dealt.groupBy("o", "w").applyInArrow(near, "idx bigint, near array<bigint>, d2 array<double>")
    return lists.groupBy("idx").agg(F.collect_list(F.struct("near", "d2")).alias("found"))  # twice the orders at most


def affinities(found: DataFrame, k: int, perplexity: float) -> DataFrame:
    """i, j, p: of each row its k nearest with shares whose entropy is that of the perplexity."""

    def run(batches):
        for b in batches:
            i, j, p = [], [], []
            for idx, lists in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                best = {}
                for x in lists:
                    best.update(zip(x["near"], x["d2"], strict=True))
                near = sorted(best.items(), key=lambda x: (x[1], x[0]))[:k]
                i.append(np.full(len(near), idx))
                j.append(np.array([x for x, _ in near], np.int64))
                p.append(shares(np.array([x for _, x in near]), perplexity))
            if i:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (i, j, p)], names=["i", "j", "p"])

    return found.mapInArrow(run, "i bigint, j bigint, p double")


def shares(d2: np.ndarray, perplexity: float) -> np.ndarray:
    """Shares exp(-beta * d2) over their sum, with the beta at which their entropy is log(perplexity), or all that it can be."""
    want, low, high, beta = math.log(min(perplexity, len(d2))), 0.0, math.inf, 1.0
    d2 = d2 - d2.min()
    for _ in range(64):
        p = np.exp(-beta * d2)
        p /= p.sum()
        entropy = -(p * np.log(np.maximum(p, 1e-300))).sum()
        if abs(entropy - want) < 1e-6:
            break
        low, high = (beta, high) if entropy > want else (low, beta)
        beta = beta * 2 if math.isinf(high) else (low + high) / 2
    return p


def graph(points: DataFrame, n: int, d: int, perplexity: float, **how) -> DataFrame:
    """i, j, p: the symmetric graph, both ways of each edge; p sums to 1. Written."""
    k = min(n - 1, int(3 * perplexity))
    one = settled(affinities(neighbours(points, n, d, k, **how), k, perplexity))
    both = one.unionByName(one.select(F.col("j").alias("i"), F.col("i").alias("j"), "p"))
    return settled(both.groupBy("i", "j").agg((F.sum("p") / (2.0 * n)).alias("p")))


class Grid:
    """Sums of places over square cells, and the forces that they make."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        side = max(float((high - low).max()), 1e-9) * 1.5
        self.cells = int(min(MOST_CELLS, max(LEAST_CELLS, math.ceil(side / CELL))))
        self.width = side / (self.cells - 1)
        self.low = (low + high) / 2 - side / 2
        self.centre = (low + high) / 2
        at = np.arange(2 * self.cells)
        at = np.minimum(at, 2 * self.cells - at) * self.width
        near = 1 / (1 + at[:, None] ** 2 + at[None] ** 2)
        self.kernels = np.fft.rfft2(near), np.fft.rfft2(near * near)

    def weights(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each place its four cells, and its share in each."""
        at = np.clip((y - self.low) / self.width, 0, self.cells - 1 - 1e-9)
        cell = at.astype(np.int64)
        part = at - cell
        first = cell[:, 0] * self.cells + cell[:, 1]
        a, b = part[:, 0], part[:, 1]
        return first[:, None] + np.array([0, 1, self.cells, self.cells + 1]), np.stack([(1 - a) * (1 - b), (1 - a) * b, a * (1 - b), a * b], axis=1)

    def sums(self, y: np.ndarray, cells: np.ndarray, part: np.ndarray) -> np.ndarray:
        """Number and coordinates, from the grid's centre, of the places in each cell."""
        z = y - self.centre
        flat = cells.ravel()
        return np.stack([np.bincount(flat, (part * v[:, None]).ravel(), self.cells**2) for v in (np.ones(len(y)), z[:, 0], z[:, 1])])

    def repulsion(self, y: np.ndarray, others: np.ndarray | float, n: int) -> np.ndarray:
        cells, part = self.weights(y)
        charge = (self.sums(y, cells, part) + others).reshape(3, self.cells, self.cells)
        size = (2 * self.cells, 2 * self.cells)
        waves = np.fft.rfft2(charge, size)
        near, far = self.kernels
        field = np.fft.irfft2(np.concatenate([waves[:1] * near, waves * far]), size)[:, : self.cells, : self.cells].reshape(4, -1)
        total = (charge[0].ravel() * field[0]).sum() - n  # a place and itself count 1
        at = (field[1:, cells] * part).sum(axis=2)
        return ((y - self.centre) * at[0][:, None] - at[1:].T) / max(total, 1e-12)


def rate_of(n: int) -> float:
    """Longest steps that leave small tables together."""
    return min(max(n / EXAGGERATION / 4, 50.0), n / 6)


def steps(y, u, gain, i, p, j, places, base, others, grid, n, rate, first, count):
    """``count`` steps from step ``first`` of the rows at ``y``. i, j, p: edges; j counts in ``places``, where the rows begin at ``base`` and no others move."""
    there = places[j]
    own = np.flatnonzero((j >= base) & (j < base + len(y)))
    back = j[own] - base
    for step in range(first, first + count):
        factor, momentum = (EXAGGERATION, 0.5) if step < EARLY else (1.0, 0.8)
        there[own] = y[back]
        diff = y[i] - there
        pull = factor * p / (1 + (diff * diff).sum(axis=1))
        force = np.stack([np.bincount(i, pull * diff[:, c], len(y)) for c in range(2)], axis=1)
        slope = 4 * (force - grid.repulsion(y, others, n))
        same = (slope > 0) == (u > 0)
        gain = np.maximum(np.where(same, gain * 0.8, gain + 0.2), 0.01)
        u = momentum * u - rate * gain * slope
        y = y + u
    return y, u, gain


#: A part's places, and its steps and gains, as bytes; the corners of its places.
STATE = "part bigint, y binary, rest binary, low array<double>, high array<double>"
#: Of a part, some of its edges, or the rows whose places part ``at`` asks for.
LINKS = "part bigint, at bigint, edges binary, sends binary"
EDGE = np.dtype([("i", "<i4"), ("j", "<i4"), ("p", "<f8")])


def _state(part: int, y: np.ndarray, rest: np.ndarray) -> pa.Table:
    names = ["part", "y", "rest", "low", "high"]
    pair = pa.list_(pa.float64())
    return pa.table([[part], [y.tobytes()], [rest.tobytes()], pa.array([y.min(axis=0).tolist()], pair), pa.array([y.max(axis=0).tolist()], pair)], names=names)


def _begin(points: DataFrame, size: int) -> DataFrame:
    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("idx")
        y = np.array(t.column("y").to_pylist(), np.float64).reshape(t.num_rows, 2)
        return _state(int(t.column("idx")[0].as_py()) // size, y, np.concatenate([np.zeros_like(y), np.ones_like(y)], axis=1))

    return settled(points.select(F.floor(F.col("idx") / size).alias("part"), "idx", "y").groupBy("part").applyInArrow(pack, STATE))


def _packed(edges: DataFrame, n: int, size: int) -> DataFrame:
    """Edges of each part, as the bytes of many at a time, which the rounds read where they lie. j counts the part's rows, then the rows of others in order."""

    def pack(t: pa.Table) -> pa.Table:
        part = int(t.column("part")[0].as_py())
        base, m = part * size, min(size, n - part * size)
        i, j = t.column("i").to_numpy() - base, t.column("j").to_numpy()
        order = np.lexsort((j, i))
        i, j = i[order], j[order]
        away = (j < base) | (j >= base + m)
        own = np.empty(len(i), EDGE)
        own["i"], own["p"] = i, t.column("p").to_numpy()[order]
        own["j"] = np.where(away, m + np.searchsorted(np.unique(j[away]), j), j - base)
        parts = [own[a : a + PART].tobytes() for a in range(0, len(own), PART)]
        # Edges go both ways: a row is asked for by the parts to which its own edges lead.
        to, row = np.divmod(np.unique(j[away] // size * size + i[away]), size)
        parted = np.unique(to)
        cut = np.searchsorted(to, parted)
        sends = [rows.astype("<i4").tobytes() for rows in np.split(row, cut[1:])] if len(cut) else []
        none = lambda of: [None] * len(of)
        at = [*range(len(parts)), *parted.tolist()]
        return pa.table({"part": pa.array([part] * len(at), pa.int64()), "at": pa.array(at, pa.int64()), "edges": pa.array(parts + none(sends), pa.binary()), "sends": pa.array(none(parts) + sends, pa.binary())})

    parted = edges.withColumn("part", F.floor(F.col("i") / size))
    return bucketed(parted.groupBy("part").applyInArrow(pack, LINKS), 2 * -(-n // size), "part")


def _sent(state: DataFrame, links: DataFrame) -> DataFrame:
    """part, source, y: the places that a part is sent by others, each once."""

    def send(own: pa.Table, sends: pa.Table) -> pa.Table:
        m = sends.num_rows if own.num_rows else 0
        y = np.frombuffer(own.column("y")[0].as_py()).reshape(-1, 2) if m else None
        rows = (np.frombuffer(sends.column("sends")[k].as_py(), "<i4") for k in range(m))
        source = [own.column("part")[0].as_py()] * m if m else []
        return pa.table({"part": sends.column("at") if m else pa.array([], pa.int64()), "source": pa.array(source, pa.int64()), "y": pa.array([y[r].tobytes() for r in rows], pa.binary())})

    sends = links.where("sends is not null").select("part", "at", "sends")
    return state.select("part", "y").groupBy("part").cogroup(sends.groupBy("part")).applyInArrow(send, "part bigint, source bigint, y binary")


def _round(state: DataFrame, sent: DataFrame | None, links: DataFrame, n: int, rate: float, block: int, first: int, count: int, grid: Grid | None, cells: np.ndarray | None) -> DataFrame:
    """A round of every block. Without a grid the block is the only one, and all rounds are made at once."""

    def go(inputs: pa.Table, packed: pa.Table) -> pa.Table:
        inputs, packed = inputs.sort_by("source"), packed.sort_by("at")
        rest, came = inputs.column("rest").to_pylist(), [np.frombuffer(b).reshape(-1, 2) for b in inputs.column("y").to_pylist()]
        own = next(k for k, b in enumerate(rest) if b is not None)
        y, v = came[own].copy(), np.frombuffer(rest[own]).reshape(-1, 4)
        u, gain = v[:, :2].copy(), v[:, 2:].copy()
        places = np.concatenate([came.pop(own), *came])
        edges = np.concatenate([np.zeros(0, EDGE), *(np.frombuffer(b, EDGE) for b in packed.column("edges").to_pylist())])
        for base in range(0, len(y), block):
            rows = slice(base, base + block)
            e = edges[slice(*np.searchsorted(edges["i"], [base, base + block]))]
            i, p, j = e["i"].astype(np.int64) - base, e["p"], e["j"].astype(np.int64)
            now = y[rows], u[rows], gain[rows]
            if grid is None:
                for step in range(first, first + count, ROUND):
                    now = steps(*now, i, p, j, places, base, 0.0, Grid(now[0].min(axis=0), now[0].max(axis=0)), n, rate, step, min(ROUND, first + count - step))
            else:
                others = cells - grid.sums(now[0], *grid.weights(now[0]))
                now = steps(*now, i, p, j, places, base, others, grid, n, rate, first, count)
            y[rows], u[rows], gain[rows] = now
        return _state(inputs.column("part")[0].as_py(), y, np.concatenate([u, gain], axis=1))

    inputs = state.select("part", F.col("part").alias("source"), "y", "rest")
    if sent is not None:
        inputs = inputs.unionByName(sent.withColumn("rest", F.lit(None).cast("binary")))
    packed = links.where("edges is not null").select("part", "at", "edges")
    return inputs.groupBy("part").cogroup(packed.groupBy("part")).applyInArrow(go, STATE)


def _cells(state: DataFrame, grid: Grid) -> np.ndarray:
    """The sums of all places over the grid: three numbers a cell, whatever the rows."""

    def run(batches):
        total = np.zeros((3, grid.cells**2))
        for b in batches:
            for one in b.column(0):
                y = np.frombuffer(one.as_py()).reshape(-1, 2)
                total += grid.sums(y, *grid.weights(y))
        used = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(total[c][used]) for c in range(3))], names=["cell", "n", "x", "y"])

    found = state.select("y").mapInArrow(run, "cell bigint, n double, x double, y double").groupBy("cell").agg(*(F.sum(c).alias(c) for c in ("n", "x", "y")))
    out = np.zeros((3, grid.cells**2))
    for r in found.orderBy("cell").collect():
        out[:, r["cell"]] = r["n"], r["x"], r["y"]
    return out


def _placed(state: DataFrame, size: int) -> DataFrame:
    def run(batches):
        for b in batches:
            for part, one in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                y = np.frombuffer(one).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(part * size + np.arange(len(y))), pa.array(y[:, 0]), pa.array(y[:, 1])], names=["idx", "tsne_x", "tsne_y"])

    return state.select("part", "y").mapInArrow(run, "idx bigint, tsne_x double, tsne_y double")


def embed(points: DataFrame, edges: DataFrame, n: int, *, steps_: int = STEPS, block: int = BLOCK, parts: int = PARTS, rate: float | None = None) -> DataFrame:
    """points: idx, y (two coordinates to start from). edges: of graph(), both ways of each. Result: idx, tsne_x, tsne_y."""
    rate = rate_of(n) if rate is None else rate
    room = PART_EDGES * n // (max(1, edges.count()) * block)
    size = block * max(1, min(-(-n // block) // parts, room))
    links = _packed(edges, n, size)
    state = _begin(points, size)
    if n <= block:
        state = settled(_round(state, None, links, n, rate, block, 0, steps_, None, None))
    else:
        for first in range(0, steps_, ROUND):
            corners = state.agg(*(f(F.col(c)[k]) for f, c in ((F.min, "low"), (F.max, "high")) for k in range(2))).first()
            grid = Grid(np.array(corners[:2]), np.array(corners[2:]))
            state = settled(_round(state, _sent(state, links), links, n, rate, block, first, min(ROUND, steps_ - first), grid, _cells(state, grid)))
    return _placed(state, size)


def project(df: DataFrame, key: str, vector: str, *, steps: int = STEPS, block: int = BLOCK, seed: int = 42, **how) -> DataFrame:
    """key, tsne_x, tsne_y. Vectors are scaled and reduced to principal components first; the first two, shrunk, are the start."""
    rows = settled(df.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("vector")))
    n, width = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
    if n < 3:
        one = F.element_at("vector", 1).cast("double")
        return rows.select(F.col("key").alias(key), one.alias("tsne_x"), F.coalesce(F.try_element_at("vector", F.lit(2)).cast("double"), F.lit(0.0)).alias("tsne_y"))
    d = min(width, landscape.dimensions(n, width))
    made, _ = landscape.components(landscape.scaled(rows, "vector"), "scaled", d)
    reduced = settled(made.select("key", F.col("pca").alias("x")))
    first = np.random.default_rng(seed).normal(size=(d, SIGNS + 1))
    sign = lambda plane: F.aggregate(F.zip_with("x", F.array(*map(F.lit, plane.tolist())), lambda a, b: a * b), F.lit(0.0), lambda s, a: s + a)
    ordered = numbered(reduced, "rank", F.array(*(sign(first[:, c]) > 0 for c in range(SIGNS))), sign(first[:, SIGNS]), F.col("key"))
    spread = reduced.agg(F.stddev_pop(F.col("x")[0])).first()[0] or 1.0
    second = F.col("x")[1] if d > 1 else F.lit(0.0)
    points = settled(ordered.select("key", (F.col("rank") - 1).alias("idx"), "x", F.array(F.col("x")[0] * (1e-4 / spread), second * (1e-4 / spread)).alias("y")))
    edges = graph(points, n, d, perplexity_of(n), seed=seed, **how)
    placed = embed(points.select("idx", "y"), edges, n, steps_=steps, block=block)
    return points.select("idx", F.col("key").alias(key)).join(placed, "idx").drop("idx")
