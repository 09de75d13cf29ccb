"""t-SNE maps, binned densities, sparse components, the nearest by bounds, and groups of graphs, against plain versions."""

import math
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from litmill.operators import groups, landscape, packed_terms, semantic, tsne


def trust(x, y, k=10):
    """How far near places come from near vectors: 1 if all do."""
    n = len(x)
    a, b = (((v[:, None] - v[None]) ** 2).sum(-1) for v in (x, y))
    np.fill_diagonal(a, np.inf)
    np.fill_diagonal(b, np.inf)
    rank = np.empty((n, n), int)
    np.put_along_axis(rank, a.argsort(1), np.arange(1, n + 1)[None].repeat(n, 0), 1)
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * np.maximum(np.take_along_axis(rank, b.argsort(1)[:, :k], 1) - k, 0).sum()


def exact_graph(x, perplexity):
    n = len(x)
    d2 = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d2, np.inf)
    p = np.zeros((n, n))
    k = min(n - 1, int(3 * perplexity))
    for i in range(n):
        near = d2[i].argsort(kind="stable")[:k]
        low, high = 1e-9, 1e9
        for _ in range(200):  # the width whose entropy is that of the perplexity
            beta = math.sqrt(low * high)
            q = np.exp(-beta * (d2[i, near] - d2[i, near].min()))
            q /= q.sum()
            low, high = (beta, high) if -(q * np.log(np.maximum(q, 1e-300))).sum() > math.log(min(perplexity, k)) else (low, beta)
        p[i, near] = q
    return (p + p.T) / (2 * n)


def exact_map(x, start, perplexity, steps):
    """All pairs in every step."""
    p, n, y = exact_graph(x, perplexity), len(x), start.copy()
    u, gain, rate = np.zeros_like(y), np.ones_like(y), max(n / 48, 50.0)
    for step in range(steps):
        diff = y[:, None] - y[None]
        q = 1 / (1 + (diff**2).sum(-1))
        np.fill_diagonal(q, 0)
        slope = 4 * ((((12 if step < 125 else 1) * p - q / q.sum()) * q)[:, :, None] * diff).sum(1)
        gain = np.maximum(np.where((slope > 0) == (u > 0), gain * 0.8, gain + 0.2), 0.01)
        u = (0.5 if step < 125 else 0.8) * u - rate * gain * slope
        y = y + u
    return y, p


def loss(p, y):
    q = 1 / (1 + ((y[:, None] - y[None]) ** 2).sum(-1))
    np.fill_diagonal(q, 0)
    q /= q.sum()
    at = p > 0
    return (p[at] * np.log(p[at] / np.maximum(q[at], 1e-300))).sum()


def test_map_of_the_embeddings_is_as_good_as_the_exact_one(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    x = np.array([r["embedding"] for r in e.orderBy("vec_id").collect()], np.float64)
    x = (x - x.mean(0)) / x.std(0)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    d = landscape.dimensions(*x.shape)
    z = u[:, :d] * s[:d]
    best, p = exact_map(z, z[:, :2] / z[:, 0].std() * 1e-4, tsne.perplexity_of(len(x)), tsne.STEPS)
    got = [np.array([[r["tsne_x"], r["tsne_y"]] for r in tsne.project(e, "vec_id", "embedding").orderBy("vec_id").collect()]) for _ in range(2)]
    assert np.array_equal(*got)
    assert trust(x, got[0]) >= trust(x, best) - 0.02
    assert loss(p, got[0]) <= 1.05 * loss(p, best)


@pytest.mark.parametrize(("block", "half"), [(4096, 512), (150, 60)])
def test_clusters_stay_together_in_one_block_and_in_many(spark, block, half):
    rng = np.random.default_rng(3)
    label = rng.integers(0, 6, 420)
    x = rng.normal(size=(6, 12))[label] * 4 + rng.normal(size=(420, 12))
    x[400:] = x[400]  # equal rows
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "k bigint, v array<double>")
    got = tsne.project(df, "k", "v", block=block, half=half, steps=250).orderBy("k").collect()
    assert [r["k"] for r in got] == list(range(420))
    y = np.array([[r["tsne_x"], r["tsne_y"]] for r in got])
    assert trust((x - x.mean(0)) / x.std(0), y) >= 0.95


def test_neighbours_by_sorted_orders_are_nearly_all_found(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(8, 10))[rng.integers(0, 8, 3000)] * 3 + rng.normal(size=(3000, 10))
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "idx bigint, x array<double>")
    found = {r["idx"]: {j: d for f in r["found"] for j, d in zip(f["near"], f["d2"], strict=True)} for r in tsne.neighbours(points, 3000, 10, 10, half=128).collect()}
    d2 = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d2, np.inf)
    hit = sum(len(set(np.argsort(d2[i])[:10].tolist()) & set(sorted(found[i], key=found[i].get)[:10])) for i in range(3000))
    assert hit >= 0.75 * 30_000


def test_grid_repulsion_is_near_the_sum_over_all_pairs():
    rng = np.random.default_rng(5)
    y = rng.normal(size=(700, 2)) * 12
    diff = y[:, None] - y[None]
    q = 1 / (1 + (diff**2).sum(-1))
    np.fill_diagonal(q, 0)
    want = ((q * q)[:, :, None] * diff).sum(1) / q.sum()
    got = tsne.Grid(y.min(0), y.max(0)).repulsion(y, 0.0, 700)
    assert np.linalg.norm(got - want) <= 0.15 * np.linalg.norm(want)


def ring(spark, n, each):
    """Rows with edges, both ways, to the next ``each`` rows and to one half a round away."""
    steps = [*range(1, each + 1), n // 2]
    edges = {(i, (i + d) % n) for i in range(n) for d in steps} | {((i + d) % n, i) for i in range(n) for d in steps}
    rng = np.random.default_rng(9)
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(n, 2)) * 1e-2)], "idx bigint, y array<double>")
    return points, spark.createDataFrame([(i, j, 1 / len(edges)) for i, j in sorted(edges)], "i bigint, j bigint, p double")


def test_exchanges_send_places_and_no_edges(spark):
    n, each = 600, 60
    points, edges = ring(spark, n, each)
    store, last = spark.sparkContext._jsc.sc().statusStore(), [-1]

    def written(steps):
        tsne.embed(points, edges, n, steps_=steps, block=150).count()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        done = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        stages = [s for s in (done.apply(k) for k in range(done.size())) if s.stageId() > last[0]]
        last[0] = max(s.stageId() for s in stages)
        return sum(s.shuffleWriteBytes() + s.diskBytesSpilled() for s in stages if "COMPLETE" in str(s.status()))

    written(10)
    each_round = (written(50) - written(10)) / 4
    assert each_round < n * 250  # bytes; a row's edges alone have 122 * 16


@pytest.mark.parametrize("parts", [1, 2, 24])
def test_blocks_of_a_part_make_the_same_steps(spark, parts):
    points, edges = ring(spark, 700, 8)
    want, got = (tsne.embed(points, edges, 700, steps_=20, block=100, parts=p).orderBy("idx").collect() for p in (7, parts))
    assert [r["idx"] for r in got] == list(range(700))
    assert np.allclose([tuple(r) for r in got], [tuple(r) for r in want], rtol=0, atol=1e-9)


def test_few_rows_have_a_map(spark):
    for n in range(5):
        df = spark.createDataFrame([(i, [float(i), 1.0, float(i * i)]) for i in range(n)], "k bigint, v array<double>")
        assert tsne.project(df, "k", "v", steps=20).count() == n


@pytest.mark.parametrize("factor", [0.24, 0.5])
def test_binned_densities_are_those_of_all_points(spark, factor):
    rng = np.random.default_rng(6)
    rows = [(g, *v) for g, n, t in (("a", 400, [[1, 0.8], [0, 0.5]]), ("b", 30, [[0.3, 0], [-0.5, 2]]), (None, 12, [[1, 0], [0, 1]])) for v in (rng.normal(size=(n, 2)) @ np.array(t)).tolist()]
    rows += [("few", 1.0, 2.0)] * 3 + [("line", float(i), 2.0 * i) for i in range(9)] + [("a", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = defaultdict(dict)
    for r in landscape.kde(df, F.col("x"), F.col("y"), factor=factor, xs=(-3, 3, 13), ys=(-4, 4, 17), by=("g",)).collect():
        got[r["g"]][round(r["gx"], 6), round(r["gy"], 6)] = r["density"]
    assert got.keys() == {"a", "b", None}
    for g, cells in got.items():
        p = np.array([r[1:] for r in rows if r[0] == g and r[1] is not None])
        inverse = np.linalg.inv(cov := np.cov(p.T) * factor**2)
        gx, gy = np.meshgrid(np.linspace(-3, 3, 13), np.linspace(-4, 4, 17), indexing="ij")
        at = np.stack([gx.ravel(), gy.ravel()], 1)
        d = at[:, None] - p[None]
        want = np.exp(-np.einsum("abi,ij,abj->ab", d, inverse, d) / 2).mean(1) / (2 * math.pi * math.sqrt(np.linalg.det(cov)))
        err = [abs(cells.get((round(a, 6), round(b, 6)), 0.0) - w) for (a, b), w in zip(at.tolist(), want.tolist(), strict=True)]
        assert max(err) <= 2e-3 * want.max() and np.mean(err) <= 1e-4


def test_binned_densities_are_those_of_density_grid(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    # Made uncorrelated and of one deviation, so that the covariance's kernel is the round one of density().
    p = np.array([tuple(r) for r in e.collect()])
    z = (p - p.mean(0)) @ np.linalg.inv(np.linalg.cholesky(np.cov(p.T))).T
    df = spark.createDataFrame(z.tolist(), "x double, y double")
    a = {(round(r["gx"], 6), round(r["gy"], 6)): r["density"] for r in landscape.density(df, F.col("x"), F.col("y"), low=-2, high=2, steps=20, bandwidth=0.3).collect()}
    b = {(round(r["gx"], 6), round(r["gy"], 6)): r["density"] for r in landscape.kde(df, F.col("x"), F.col("y"), factor=0.3, xs=(-2, 2, 20), ys=(-2, 2, 20)).collect()}
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) <= 1e-4


@pytest.mark.parametrize("center", [False, True])
def test_sparse_components_agree_with_dense_ones(spark, sf, center):
    w = semantic.tfidf(spark.read.parquet(f"{sf}/benchmark.parquet"), key="item_id", text="text", pattern="[a-z]{2,}").collect()
    rows, terms = sorted({r["item_id"] for r in w}), {t: i for i, t in enumerate(sorted({r["term"] for r in w}))}
    a = np.zeros((len(rows), len(terms)))
    for r in w:
        a[rows.index(r["item_id"]), terms[r["term"]]] = r["weight"]
    a -= a.mean(0) * center
    u, s, _ = np.linalg.svd(a, full_matrices=False)
    frame = spark.createDataFrame([(r["item_id"], r["term"], r["weight"]) for r in w], "r bigint, t string, weight double")
    found, sizes = landscape.sparse_components(frame, 8, row="r", term="t", center=center)
    assert sizes == pytest.approx(s[:8].tolist(), rel=0.01)
    got = {r["r"]: r["coordinates"] for r in found.collect()}
    y = np.array([got[r] for r in rows])
    assert np.abs((y**2).sum(0) - s[:8] ** 2).max() <= 0.02 * s[0] ** 2
    first = y[:, 0] / np.linalg.norm(y[:, 0])
    assert abs(first @ u[:, 0]) >= 0.999


def test_sparse_components_of_few_and_none(spark):
    one = spark.createDataFrame([(1, "a", 2.0), (1, "b", 1.0), (2, "a", 4.0), (2, "b", 2.0), (3, "c", None)], "r bigint, t string, weight double")
    found, sizes = landscape.sparse_components(one, 1, row="r", term="t")
    assert sizes == pytest.approx([5.0]) and {r["r"] for r in found.collect()} == {1, 2}
    found, sizes = landscape.sparse_components(one.where("false"), 2, row="r", term="t")
    assert sizes == [] and found.count() == 0


def test_nearest_by_bounds_are_those_of_all_pairs(spark):
    rnd = random.Random(14)
    terms = [f"t{i}" for i in range(300)]
    share = [1 / (i + 1) for i in range(300)]

    def vectors(names, least, most):
        for n in names:
            got = set(rnd.choices(terms, share, k=rnd.randrange(least, most)))
            raw = {t: rnd.random() / share[int(t[1:])] ** 0.5 for t in got}
            norm = math.sqrt(sum(x * x for x in raw.values()))
            yield from ((n, t, x / norm) for t, x in raw.items())

    docs = list(vectors(range(600), 3, 40)) + [(n, "t7", 1.0) for n in range(600, 620)]
    asked = list(vectors([f"q{i}" for i in range(25)], 2, 25)) + [("common", "t0", 0.8), ("common", "t1", 0.6), ("tied", "t7", 1.0), ("none", "absent", 1.0)]
    want = {}
    by = defaultdict(dict)
    for n, t, x in docs:
        by[n][t] = x
    for q in {a[0] for a in asked}:
        own = {t: x for a, t, x in asked if a == q}
        scored = sorted((-round(sum(x * v.get(t, 0) for t, x in own.items()), 9), n) for n, v in by.items())
        want[q] = [(n, -s) for s, n in scored if s < 0][:10]
    w = spark.createDataFrame(docs, "k bigint, term string, weight double")
    a = spark.createDataFrame(asked, "q string, term string, weight double")
    for hot in (0.0, 0.02, 0.2, 1.0):
        got = defaultdict(list)
        for r in semantic.top_cosines(w, a, 10, key="k", anchor_key="q", hot=hot).orderBy("q", "rank").collect():
            got[r["q"]].append((r["k"], r["cosine"]))
        for q, best in want.items():
            assert [n for n, _ in got[q]] == [n for n, _ in best]
            assert [c for _, c in got[q]] == pytest.approx([c for _, c in best])


    got = defaultdict(list)
    for r in semantic.top_cosines(w, a, 10, key="k", anchor_key="q", hot=0.02, most=0).orderBy("q", "rank").collect():  # by bounds, as of many anchors
        got[r["q"]].append((r["k"], r["cosine"]))
    assert all([n for n, _ in got[q]] == [n for n, _ in best] for q, best in want.items())


def test_weights_of_asked_terms_are_those_of_all_terms_and_stay_by_key(spark):
    rnd = random.Random(16)
    docs = [(f"d{i % 90}", " ".join(rnd.choices(["aa", "bb", "cc", "dd", f"own{i}", "é"], k=rnd.randrange(9)))) for i in range(100)]  # ten keys twice
    docs = spark.createDataFrame([*docs, ("d95", None), ("d96", "")], "k string, t string")
    items = spark.createDataFrame([("b1", "aa bb zz"), ("b2", "cc"), ("b3", None)], "k string, t string")
    every = docs.unionByName(items)
    whole = {(r["k"], r["term"]): r["weight"] for r in semantic.tfidf(every, key="k", text="t").collect()}
    w = semantic.tfidf(every, key="k", text="t", asked=items)
    got = {(r["k"], r["term"]): r["weight"] for r in w.collect()}
    assert len(got) == w.count() and got == pytest.approx({k: x for k, x in whole.items() if k[1] in ("aa", "bb", "zz", "cc", "aa bb", "bb zz")})
    a = w.where(F.col("k").startswith("b")).withColumnRenamed("k", "q")
    for found in (semantic.tfidf_cosines(w, a, key="k", anchor_key="q"), semantic.top_cosines(w, a, 10, key="k", anchor_key="q")):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(key") == 1 and "hashpartitioning(term" not in plan  # only texts move


@pytest.mark.parametrize("bigrams", [True, False])
def test_packed_weights_are_those_of_all_terms(spark, monkeypatch, bigrams):
    rnd = random.Random(17)
    rows = [(f"d{i % 70}" if i % 9 else None, " ".join(rnd.choices(["Aa", "bb", "a", "cc", "dd", f"own{i}"], k=rnd.randrange(12)))) for i in range(90)]  # repeated keys, and none
    docs = spark.createDataFrame([*rows, ("null", None), ("empty", ""), ("long", "aa bb " * 5000)], "k string, t string").repartition(5)
    items = spark.createDataFrame([("b1", "aa bb cc zz"), ("b2", "dd aa"), ("b3", None)], "k string, t string")
    options = {"key": "k", "text": "t", "pattern": "[a-z]{2,}", "bigrams": bigrams}
    whole = {(r["k"], r["term"]): r["weight"] for r in semantic.tfidf(docs, **options).collect()}
    terms = {"aa", "bb", "cc", "zz", "dd"} | ({"aa bb", "bb cc", "cc zz", "dd aa"} if bigrams else set())
    want = {k: x for k, x in whole.items() if k[1] in terms}
    assert any(k is None for k, _ in want)
    monkeypatch.setattr(packed_terms, "BATCH_BYTES", 2000)  # some thirty batches and parts
    for few in (semantic.FEW, 0):
        monkeypatch.setattr(semantic, "FEW", few)
        rows = semantic.tfidf(docs, asked=items, **options).collect()
        got = {(r["k"], r["term"]): r["weight"] for r in rows}
        assert len(rows) == len(got) and got == pytest.approx(want)


@pytest.mark.parametrize("sums", [1, 300, 1_000_000])
def test_packed_cosines_are_those_of_a_join(spark, monkeypatch, sums):
    rnd = random.Random(18)
    docs = [(n, f"t{t}", rnd.random()) for n in range(80) for t in rnd.sample(range(30), rnd.randrange(1, 9))] + [(n, "t3", 0.5) for n in range(80, 120)] + [(120, None, 1.0), (121, "other", 1.0)]
    asked = [(f"q{i}", f"t{t}", rnd.random()) for i in range(12) for t in rnd.sample(range(40), 6)] + [("tied", "t3", 1.0), ("nil", "t4", 0.0), ("none", "absent", 1.0)]
    w = spark.createDataFrame(docs, "k bigint, term string, weight double").repartition(3)
    a = spark.createDataFrame(asked, "q string, term string, weight double")
    monkeypatch.setattr(packed_terms, "SUMS", sums)
    want = defaultdict(float)
    for n, t, x in docs:
        for q, s, y in asked:
            if t == s:
                want[n, q] += x * y
    got = {(r["k"], r["anchor"]): r["cosine"] for r in semantic.tfidf_cosines(w, a, key="k", anchor_key="q").collect()}
    assert got == pytest.approx(dict(want))
    best = {q: [n for _, n in sorted((-round(x, 9), n) for (n, p), x in want.items() if p == q and x > 0)[:10]] for q in {q for q, *_ in asked}}
    top = defaultdict(list)
    for r in semantic.top_cosines(w, a, 10, key="k", anchor_key="q").orderBy("q", "rank").collect():
        top[r["q"]].append(r["k"])
    assert top == {q: x for q, x in best.items() if x}


def test_codes_of_terms_stay_under_the_largest_number(monkeypatch):
    rows = pa.table({"key": ["x", "y", "x", None], "t": [["aa", "bb", "aa", "bb"], ["bb"], ["aa"], []]})
    found = [packed_terms._counted(rows, True)]
    monkeypatch.setattr(packed_terms, "MOST", 0)
    found.append(packed_terms._counted(rows, True))
    for _, words, doc, code, tf in found:
        assert words.to_pylist() == ["aa", "bb"] and [*zip(doc.tolist(), code.tolist(), tf.tolist(), strict=True)] == [(0, 0, 3), (0, 1, 2), (0, 3, 2), (0, 4, 1), (1, 1, 1)]


def modularity(edges, of):
    total = sum(2 * w for *_, w in edges)
    inside, size = defaultdict(int), defaultdict(int)
    for a, b, w in edges:
        size[of[a]] += w
        size[of[b]] += w
        inside[of[a]] += 2 * w * (of[a] == of[b])
    return sum(inside[c] / total - (size[c] / total) ** 2 for c in size)


def plain_level(edges, half):
    """One level of moves, half of the nodes at a time."""
    both = defaultdict(lambda: defaultdict(int))
    for a, b, w in edges:
        both[a][b] += w
        both[b][a] += w
    k = {u: sum(x.values()) for u, x in both.items()}
    total, now = sum(k.values()), {u: u for u in both}
    quality, moved = modularity(edges, now), False
    for _ in range(50):
        then = now
        for h in (0, 1):
            size = defaultdict(int)
            for u, c in then.items():
                size[c] += k[u]
            new = dict(then)
            for u in both:
                if half[u] == h:
                    links = defaultdict(int)
                    links[then[u]] += 0
                    for v, w in both[u].items():
                        links[then[v]] += w * (u != v)
                    new[u] = min((-(total * w - k[u] * (size[c] - k[u] * (c == then[u]))), c != then[u], c) for c, w in links.items())[2]
            then = new
        better = modularity(edges, then)
        if better <= quality + 1e-12:
            break
        now, quality, moved = then, better, True
    return now, quality, moved


def plain_groups(edges, half):
    of, now, quality = {x: x for e in edges for x in e[:2]}, edges, 0
    while True:
        level, quality, moved = plain_level(now, half)
        if not moved:
            break
        of = {x: level[c] for x, c in of.items()}
        merged = defaultdict(int)
        for a, b, w in now:
            merged[min(level[a], level[b]), max(level[a], level[b])] += w
        now = [(a, b, w) for (a, b), w in merged.items()]
    least = {}
    for x, c in of.items():
        least[c] = min(least.get(c, x), x)
    return {x: least[c] for x, c in of.items()}, quality


def test_groups_agree_with_a_plain_version(spark):
    rnd = random.Random(15)
    edges = [(10 * g + a, 10 * g + b, rnd.randrange(1, 5)) for g in range(5) for a in range(8) for b in range(a + 1, 8) if rnd.random() < 0.7]
    edges += [(10 * g, 10 * ((g + 1) % 5) + 3, 1) for g in range(5)] + [(2, 47, 2), (90, 90, 3), (91, 92, 1), (92, 91, 2)]
    half = {r["n"]: r["h"] for r in spark.createDataFrame([(x,) for x in sorted({x for e in edges for x in e[:2]})], "n bigint").select("n", groups.half_of(F.col("n")).alias("h")).collect()}
    df = spark.createDataFrame([*edges, (None, 1, 5), (1, 2, None), (3, 4, 0)], "src bigint, dst bigint, weight bigint")
    found, quality = groups.communities(df)
    got = {r["node"]: r["community"] for r in found.collect()}
    want, best = plain_groups(edges, half)
    assert got == want and quality == pytest.approx(best) == pytest.approx(modularity(edges, got))
    assert all(len({got[10 * g + a] for a in range(8)}) == 1 for g in range(5)) and quality > 0.6
    none, quality = groups.communities(df.where("false"))
    assert none.count() == 0 and quality == 0


def test_modularity_moves_no_link(spark):
    both = groups._both(spark.createDataFrame([(1, 2, 3), (2, 3, 1), (4, 4, 2)], "src bigint, dst bigint, weight bigint"))
    member = spark.createDataFrame([(1, 3, 1), (2, 4, 1), (3, 1, 3), (4, 4, 4)], "node bigint, k bigint, c bigint")
    assert groups._quality(both, member, 12) == pytest.approx(modularity([(1, 2, 3), (2, 3, 1), (4, 4, 2)], {1: 1, 2: 1, 3: 3, 4: 4}))
    plan = groups._moved(both, member, 12, 0)._jdf.queryExecution().optimizedPlan().toString()
    scanned = [line for line in plan.splitlines() if "pmod(xxhash64(u" in line]
    assert scanned  # only the links of the half that moves are read


def test_links_lie_in_buckets_and_groups_are_those_of_packed_links(spark, monkeypatch):
    rnd = random.Random(21)
    edges = [(a, b, rnd.randrange(1, 4)) for a in range(60) for b in range(a, 60) if rnd.random() < (0.5 if a // 12 == b // 12 else 0.05)]
    df = spark.createDataFrame(edges, "src bigint, dst bigint, weight bigint")
    monkeypatch.setattr(groups, "LINKS_A_BUCKET", 200)
    packed, quality = groups.communities(df)
    both = groups._both(df)
    member = both.groupBy("u").agg(F.sum("w").alias("k")).select(F.col("u").alias("node"), "k", F.col("u").alias("c"))
    links = groups._moved(both, groups.settled(member), 1000, 0)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\((v|u#\w+, c)", links)  # neither links nor their sums move
    monkeypatch.setattr(groups, "FEW", 0)  # by joins, as of many nodes
    joined, same = groups.communities(df)
    half = {r["n"]: r["h"] for r in spark.range(60).select(F.col("id").alias("n"), groups.half_of(F.col("id")).alias("h")).collect()}
    want, _ = plain_groups(edges, half)
    assert {r["node"]: r["community"] for r in packed.collect()} == {r["node"]: r["community"] for r in joined.collect()} == want
    assert quality == pytest.approx(same) and len(set(want.values())) > 1


def test_layout_puts_linked_nodes_near_each_other(spark):
    edges = [(f"{g}{a}", f"{g}{b}", 4) for g in "abc" for a in range(6) for b in range(a + 1, 6)] + [("a0", "b0", 1), ("b1", "c1", 1)]
    got = {r["node"]: (r["x"], r["y"]) for r in groups.layout(spark.createDataFrame(edges, "src string, dst string, weight bigint")).collect()}
    assert len(got) == 18
    near = [math.dist(got[f"{g}{a}"], got[f"{g}{b}"]) for g in "abc" for a in range(6) for b in range(a)]
    far = [math.dist(got[f"{g}{a}"], got[f"{h}{b}"]) for g, h in ("ab", "ac", "bc") for a in range(6) for b in range(6)]
    assert max(near) < min(far)
