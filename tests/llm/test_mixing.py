import hashlib
import re

import pytest
from pyspark.sql import functions as F

from litmill.llm import mixing
from tests import harness


def water(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight, again and again, until no source is over its limit."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    got, stopped = dict.fromkeys(names, 0.0), set()
    left = float(sum(sizes.values()))
    while left > 1e-9 and len(stopped) < len(names):
        total, over = sum(w[s] for s in names if s not in stopped), 0.0
        for s in names:
            if s not in stopped:
                got[s] += left * w[s] / total
        for s in names:
            if got[s] >= most * sizes[s] and s not in stopped:
                over += got[s] - most * sizes[s]
                got[s] = most * sizes[s]
                stopped.add(s)
        left = over
    return got


@pytest.mark.parametrize("sizes", [{"a": 1000, "b": 10, "c": 5, "d": 400, None: 90}, {"z": 5}, {"a": 0, "b": 0}, {"a": 1, "b": 10_000, "c": 1}, {"a": 10, "b": 1, "c": 1000, "Z": 3, "é": 77}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in mixing.targets(rows).collect()}
    want = water(sizes)
    assert got.keys() == want.keys()
    for s in want:
        assert got[s] == pytest.approx(want[s], abs=1e-6)
        assert got[s] <= 3 * sizes[s] + 1e-9
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_sizes_rates_and_copies(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = mixing.plan(docs).collect()
    again = {r["doc_id"]: r["taken"] for r in mixing.op7_mixing(spark, sf).collect()}
    texts = {r["doc_id"]: r for r in docs.collect()}
    assert len(got) == len(texts)
    for r in got:
        assert r["size"] == len(re.findall("[^\x20\x09-\x0d]+", texts[r["doc_id"]]["text"]))
        rate = r["target"] / r["source_size"]
        assert int(rate) <= r["copies"] <= int(rate) + 1 <= 4
        assert r["taken"] == r["copies"] * r["size"] == again[r["doc_id"]] <= 3 * r["size"]
    mixed = {r["doc_id"]: r["n"] for r in mixing.mix(docs).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert mixed == {r["doc_id"]: r["copies"] for r in got if r["copies"]}


def test_many_equal_documents_come_near_the_target(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.concat(F.lit("s"), F.least(F.col("id") % 13, F.lit(3))).alias("source"))
    for r in mixing.plan(docs).groupBy("source_size", "target").agg(F.sum("taken").alias("t")).collect():
        assert r["t"] == pytest.approx(r["target"], rel=0.05)


def test_nulls_repeats_clashing_names_and_empty_tables(spark):
    names = ("key", "size", "chance", "rate", "low", "high", "wrap", "copies", "of", "row", "col", "source_size", "target")
    rows = [(1, None, "a"), (2, "x y", None), (2, "x y", None), (None, "\x0bq\t", "b"), (4, "w " * 50_000, "b")]
    docs = spark.createDataFrame([(*r, *names) for r in rows], "doc_id bigint, text string, source string, " + ", ".join(f"{n} string" for n in names))
    assert sorted(r["size"] for r in mixing.plan(docs).collect()) == [0, 1, 2, 2, 50_000]
    assert mixing.mix(docs).columns == docs.columns
    none = docs.where(F.lit(False))
    assert mixing.plan(none).count() == 0 == mixing.mix(none).count()


def test_long_documents_do_not_carry_a_source_off(spark):
    docs = spark.range(800).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), F.when(F.col("id") % 40 < 4, 4000).otherwise(50).cast("int")).alias("text"), F.concat(F.lit("s"), F.col("id") % 4).alias("source"))
    for r in mixing.plan(docs).groupBy(F.col("doc_id") % 4, "source_size", "target").agg(F.sum("taken").alias("t"), F.max("size").alias("longest"), F.min("copies").alias("least"), F.max("copies").alias("most")).collect():
        assert abs(r["t"] - r["target"]) <= r["longest"]
        assert int(r["target"] / r["source_size"]) <= r["least"] <= r["most"] <= int(r["target"] / r["source_size"]) + 1


def test_copies_come_as_often_as_the_fraction_asks(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.concat(F.lit("s"), F.col("id") % 2).alias("source"))
    for r in mixing.plan(docs).groupBy("target", "source_size").agg(F.avg("copies").alias("c")).collect():
        assert r["c"] == pytest.approx(r["target"] / r["source_size"], rel=0.002)


def test_every_document_gets_its_copy_with_the_probability_of_the_fraction(spark):
    # As each source is turned by its own name, 1,800 sources are as many draws, for sources of one, two and three documents.
    kinds = [(40,), (30, 10), (20, 15, 5)]
    rows = [(10 * i + k, "w " * n, f"s{i:04}") for i in range(1800) for k, n in enumerate(kinds[i // 3 % 3])]
    seen = {}
    for r in mixing.plan(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect():
        rate, i = r["target"] / r["source_size"], r["doc_id"] // 10
        seen.setdefault((i // 3 % 3, r["doc_id"] % 10, round(rate, 6)), []).append(r["copies"] - int(rate))
    assert len(seen) == 18
    for (_, _, rate), got in seen.items():
        fraction = rate - int(rate)
        assert abs(sum(got) / len(got) - fraction) <= 4.5 * (fraction * (1 - fraction) / len(got)) ** 0.5 + 1e-9


def test_small_sources_draw_as_the_fraction_asks_over_many_seeds():
    """The draw itself, in plain numbers, for one to three documents and 4,000 seeds."""
    for sizes in ([400], [400, 30], [5, 50, 500]):
        words = sum(sizes)
        for fraction in (0.05, 0.3, 0.5, 0.9):
            got = [0] * len(sizes)
            for seed in range(4000):
                order = sorted(range(len(sizes)), key=lambda k: draw(str(k), seed))  # noqa: B023
                at, ahead, taken = 0, draw("source s", seed) * words, 0
                for k in order:
                    hit = (at + ahead) % words < fraction * words
                    got[k] += hit
                    taken += hit * sizes[k]
                    at += sizes[k]
                assert abs(taken - fraction * words) <= max(sizes)
            for n in got:
                assert abs(n / 4000 - fraction) <= 4.5 * (fraction * (1 - fraction) / 4000) ** 0.5


def draw(name, seed):
    return int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:12], 16) / 2**48


def test_rows_without_a_key_draw_by_their_text(spark):
    docs = spark.range(4000).select(F.lit(None).cast("bigint").alias("doc_id"), F.concat(F.lit("a b c"), "id").alias("text"), F.concat(F.lit("s"), F.col("id") % 2).alias("source"))
    got = mixing.plan(docs).groupBy("target").agg(F.sum("taken").alias("t")).collect()
    assert len(got) == 2 and all(r["t"] == pytest.approx(r["target"], rel=0.01) for r in got)


def test_query_agrees_with_its_sql(spark):
    for sf_dir in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        assert harness.differences(spark, harness.connect(sf_dir), sf_dir, mixing.op7_mixing, mixing.OP7_SQL) == ""
