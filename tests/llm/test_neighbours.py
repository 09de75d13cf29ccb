import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from litmill.llm import neighbours as nn

SCHEMA = "vec_id bigint, embedding array<float>, label int, score string"


def brute(rows, every, k):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v, *_ in rows if i is not None and v and all(e is not None and math.isfinite(e) for e in v) and any(v)]
    out = {}
    for i, q in ok:
        if i % every == 0:
            out[i] = sorted((-(q * x).sum(), j) for j, x in ok if j != i)[:k]
    return out


def got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(found, want):
    hit = sum(len({j for _, j in found[q]} & {j for _, j in w}) for q, w in want.items())
    return hit / sum(map(len, want.values()))


def test_chi_square():
    assert nn.chi_square(np.array([15.507, 7.344, 0.0]), 8) == pytest.approx([0.95, 0.5, 0], abs=1e-3)


@pytest.mark.parametrize("block", [64, 2048])
def test_recall_and_scores_over_the_table(spark, sf, block):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want, found = brute(rows, 20, 20), got(nn.nearest(df, block=block))
    assert found.keys() == want.keys() and all(len(v) == 20 for v in found.values())
    assert recall(found, want) >= 0.9
    by = dict(rows)
    for q, v in found.items():
        assert v == sorted(v)
        for s, j in v:
            assert -s == pytest.approx(float(np.dot(np.array(by[q], float), np.array(by[j], float))), abs=1e-12)


def test_lengths_differ_and_copies_tie(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((600, 10)) * rng.uniform(0.2, 4, (600, 1))
    rows = [(i, [float(x) for x in base[7 if i % 3 == 0 else i]], 0, "x") for i in range(600)]
    want, found = brute(rows, 20, 20), got(nn.nearest(spark.createDataFrame(rows, SCHEMA), block=100))
    assert recall(found, want) >= 0.9
    for q in want:
        if q % 3 == 0:  # a copy of row 7: ties go to the smaller ids
            tied = [j for s, j in found[q] if s == found[q][0][0]]
            assert tied == sorted(tied)


def test_what_takes_no_part_and_few_candidates(spark):
    rows = [(0, [1.0, 2.0], 1, ""), (20, [2.0, -1.0], 1, ""), (3, None, 1, ""), (4, [0.0, 0.0], 1, ""), (40, [1.0, None], 1, ""), (60, [float("nan"), 1.0], 1, ""), (80, [float("inf"), 1.0], 1, ""), (None, [1.0, 1.0], 1, ""), (7, [1.0, 2.0], 1, ""), (8, [1.0, 2.0], 1, ""), (8, [1.0, 2.0], 1, ""), (9, [], 1, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(nn.nearest(df)) == {0: [(-5.0, 7), (-5.0, 8), (-5.0, 8), (0.0, 20)], 20: [(0.0, 0), (0.0, 7), (0.0, 8), (0.0, 8)]}
    assert nn.nearest(df.where(F.lit(False))).count() == 0
    assert nn.nearest(df.where("vec_id = 0")).count() == 0


def test_shorter_vectors_count_as_if_zeros_followed(spark):
    rows = [(0, [1.0, 2.0], 1, ""), (1, [3.0], 1, ""), (20, [2.0, -1.0, 4.0], 1, "")]
    assert got(nn.nearest(spark.createDataFrame(rows, SCHEMA))) == {0: [(-3.0, 1), (0.0, 20)], 20: [(-6.0, 1), (0.0, 0)]}


def test_long_vectors_tie_by_exact_products():
    rng = np.random.default_rng(9)
    x = np.repeat(rng.standard_normal((60, 16)) * 1e6, 50, axis=0)
    q = rng.standard_normal((200, 16)) * 1e6
    ids, qids = rng.permutation(len(x)), np.arange(10_000, 10_200)
    a, b, s = nn.search_block(nn.Projection(16, float(np.linalg.norm(np.concatenate([x, q]), axis=1).max())), ids, x, qids, q, np.full(200, np.inf), 20)
    for i in range(200):
        exact = (q[i] * x).sum(axis=1)
        want = np.lexsort((ids, -exact))[:20]
        assert ids[b[a == i]].tolist() == ids[want].tolist() and s[a == i].tolist() == exact[want].tolist()


def test_rows_move_as_often_at_any_size(spark, monkeypatch):
    moved, dealt = [], nn._dealt

    def counted(placed, *rest):
        held, asked = dealt(placed, *rest)
        moved.append((held.count(), placed.count()))
        return held, asked

    monkeypatch.setattr(nn, "_dealt", counted)
    monkeypatch.setattr(nn, "QUERIES", 50)
    for n in (1_000, 8_000):
        rng = np.random.default_rng(10)
        rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((40, 6))[rng.integers(0, 40, n)] * 5 + rng.standard_normal((n, 6)) * 0.1)]
        nn.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), block=250).count()
        assert len(moved) == 2 and all(held <= every == n for held, every in moved)
        moved.clear()


def test_extra_columns_may_have_any_name(spark):
    names = ("id", "v", "cell", "home", "p", "block", "part", "reach", "blocks", "parts", "query_id", "rank")
    rng = np.random.default_rng(12)
    rows = [(i, rng.standard_normal(4).tolist(), *names) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, " + ", ".join(f"{n} string" for n in names))
    assert nn.nearest(df, k=3).count() == 9
