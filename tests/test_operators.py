import bisect
import math
import random

import pytest
from pyspark.sql import functions as F

from litmill.operators import agreement, coding, dedupe, frequency, landscape, sampling, semantic
from litmill.operators import relations as R


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_counts_and_shares(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), (None,), ("",), ("a",), ("c",), ("c",)], "x string")
    assert rows(frequency.frequencies(df, "x")) == [("a", 2, 28.6), ("b", 2, 28.6), ("c", 2, 28.6), ("", 1, 14.3)]
    assert rows(frequency.group_sizes(df.withColumn("y", F.lit(1)), "x", "y"))[0] == (None, 1, 1)
    assert rows(frequency.frequencies(df.where("false"), "x")) == []
    # Halves go to the even digit.
    assert spark.range(1).select(frequency.share(F.lit(1225), F.lit(10000)), frequency.share(F.lit(1), F.lit(0))).first()[:] == (12.2, None)


def test_conditional_counts_and_labels(spark):
    df = spark.createDataFrame([(["a", "b"], True), (["none"], False), (["b"], True)], "l array<string>, y boolean")
    assert rows(frequency.label_counts(df, F.col("l"), name="f", without=("none",))) == [("b", 2, 66.7), ("a", 1, 33.3)]
    assert rows(frequency.conditional_counts(df, {"yes": F.col("y"), "no": ~F.col("y")})) == [("yes", 2, 66.7), ("no", 1, 33.3)]
    assert rows(frequency.conditional_counts(df.where("false"), {"yes": F.col("y")})) == [("yes", 0, None)]


def test_crosstabs(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", None)], "r string, c string")
    t = frequency.crosstab(df, "r", "c")
    assert t.columns == ["r", "x", "y"] and rows(t) == [("a", 1, 1), ("b", 1, 0)]
    wide = spark.createDataFrame([(f"r{i % 11:02d}", f"c{i % 9}") for i in range(500)], "r string, c string")
    top = frequency.top_crosstab(wide, "r", "c")
    assert len(top.columns) == 9 and top.count() == 8


def test_windows_over_all_rows(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") * 7919 % 501).alias("k"))
    got = frequency.numbered(df, "n", F.desc("k"), F.asc("id")).orderBy("n").collect()
    want = sorted(((-(i * 7919 % 501), i) for i in range(500)))
    assert [r["id"] for r in got] == [i for _, i in want] and [r["n"] for r in got] == list(range(1, 501))
    y = spark.createDataFrame([(2000, 3), (2001, 6), (2003, 9)], "year int, n int")
    assert [r["rolling"] for r in frequency.rolling_mean(y, "year", "n").orderBy("year").collect()] == [4.5, 6.0, 7.5]
    m = frequency.mass_by(spark.createDataFrame([("b", 3.0), ("b", 1.0)], "k string, m double"), "k", "m", spark.createDataFrame([(0, "a"), (1, "b")], "ord int, k string"))
    assert rows(frequency.sweep(m, "ord", "share").select("k", "mass", "start_angle", "end_angle")) == [("a", 0.0, 90.0, 90.0), ("b", 4.0, 90.0, 450.0)]
    s = spark.createDataFrame([("x", 2.0), ("x", 4.0), ("y", 0.0)], "k string, v double").withColumn("r", frequency.relative_to_largest("v", "k"))
    assert sorted(r["r"] or 0 for r in s.collect()) == [0, 0.5, 1.0]
    c = spark.createDataFrame([(5,), (1,), (3,), (1,)], "n int")
    assert frequency.top_share(c, 2).first()["share"] == pytest.approx(0.8)


@pytest.mark.parametrize(
    ("pairs", "want"),
    [
        ([], ("empty", 0, None, None)),
        ([("", "x"), (None, "y")], ("not_ready", 0, None, None)),
        ([("x", "x"), (" x ", "x")], ("ok", 2, 1.0, None)),
        ([("x", "x"), ("y", "y"), ("x", "y"), ("y", "x")], ("ok", 4, 0.5, 0.0)),
        ([("a", "a"), ("b", "b"), ("a", "b"), ("", "b")], ("ok", 3, 0.6667, 0.4)),
    ],
)
def test_agreement(spark, pairs, want):
    df = spark.createDataFrame(pairs, "a string, b string")
    assert tuple(agreement.agreement(df, "a", "b").first()) == want


def test_agreement_report(spark):
    df = spark.createDataFrame([("x", "x")], "a string, b string")
    got = rows(agreement.report({"one": (df, "a", "b"), "two": (df, "a", "missing"), "three": (df.where("false"), "a", "missing")}).select("stage", "status"))
    assert got == [("one", "ok"), ("two", "not_ready"), ("three", "empty")]


def test_kappa_stays_in_its_range(spark):
    random.seed(1)
    for _ in range(3):
        df = spark.createDataFrame([(random.choice("abc"), random.choice("abc")) for _ in range(60)], "a string, b string")
        r = agreement.agreement(df, "a", "b").first()
        assert -1 <= r["cohen_kappa"] <= 1 and 0 <= r["percent_agreement"] <= 1


def test_samples(spark):
    assert [sampling.size(n) for n in (0, 1, 7, 1000)] == [0, 1, 2, 50] and sampling.size(7, up=False) == 1 and sampling.size(92, most=20, up=False) == 18
    df = spark.range(300).select(F.col("id").cast("string").alias("record_id"))
    a, b, c = (sampling.sample(d, 40, s) for d, s in ((df, 7), (df.repartition(7), 7), (df, 8)))
    assert rows(a) == rows(b) != rows(c) and a.count() == 40 == a.distinct().count()
    assert sampling.share_sample(df, 7).count() == 50 and sampling.blank_form(a, ["x"]).first()["x"] == ""


RECORDS = "record_id string, doi string, title string, year int, database string, query_key string"


def test_dedupe_edge_cases_and_idempotence(spark):
    data = [("1", "10.1/A", "T", 2020, "W", "q"), ("2", "https://doi.org/10.1/a", "U", 2019, "P", "q"), ("3", None, "The title!", 2020, "P", "q"), ("4", " ", "the TITLE", 2020, "A", "q"), ("5", "", "the title", 2021, "A", "q"), ("6", None, None, 2020, "A", "q"), ("7", "", "", 2020, "B", "q")]
    df = spark.createDataFrame(data, RECORDS)
    got = dedupe.deduplicate(df)
    assert {r["record_id"] for r in got.collect()} == {"2", "4", "5", "6"}
    again = dedupe.deduplicate(got.select(*df.columns))
    assert again.count() == got.count()
    assert tuple(dedupe.audit(dedupe.rank_duplicates(df)).first()) == (7, 4, 3)
    assert dedupe.deduplicate(df.where("false")).count() == 0


def test_joins_and_set_operations(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "p", 1), (1, "q", 2), (4, "r", 1)], "k int, w string, t int")
    assert sorted(rows(R.enrich(a, b, "k", defaults={"w": ""}, last_by=[F.col("t")]).select("k", "w"))) == [(1, "q"), (2, ""), (3, "")]
    assert sorted(rows(R.unmatched(a, b, "k"))) == [("left", 2), ("left", 3), ("right", 4)]
    with pytest.raises(ValueError):
        R.require_same_keys(a, b, "k")
    R.require_same_keys(a, a, "k")
    assert R.present(a, b, "k").count() == 1 and R.absent(a, b, "k").count() == 2
    assert rows(R.stack([a, b]).where("k = 4")) == [(4, None, "r", 1)]
    assert sorted(rows(R.upsert(a, spark.createDataFrame([(2, "new"), (9, "n")], "k int, v string"), ["k"]))) == [(1, "x"), (2, "new"), (3, "z"), (9, "n")]
    assert sorted(rows(R.prefer(a, spark.createDataFrame([(1, None), (2, "w")], "k int, v string"), "k", ["v"]))) == [(1, "x"), (2, "w"), (3, "z")]
    p = R.pairs(spark.createDataFrame([(["b", "a", "b"],), (["a", "b", "c"],), (["c"],), (None,)], "l array<string>"), "k", "l")
    assert sorted(rows(p)) == [("a", "b", 2), ("a", "c", 1), ("b", "c", 1)]
    assert [r["status"] for r in R.alignment([("x", a, a), ("y", a, b.limit(1))]).collect()] == ["aligned", "check"]
    assert R.project(a, (("v", "string"), ("n", "int"))).columns == ["v", "n"] and R.reorder(a, ["v"]).columns == ["v", "k"]
    with pytest.raises(ValueError, match="n"):
        R.require(a, ["k", "n"])


LOADINGS = "record_id string, cosine_biological double, cosine_psychological double, cosine_social double"


def test_loadings(spark):
    df = spark.createDataFrame([("1", 0.5, 0.5, 0.4), ("2", -1.0, 0.0, 1.0)], LOADINGS)
    got = semantic.pairwise(semantic.domain_loadings(df)).orderBy("record_id").collect()
    assert got[0]["dominant_domain"] == "biological" and got[1]["dominant_domain"] == "social"
    for r in got:
        b, p, s = (r[f"loading_{d}"] for d in semantic.DOMAINS)
        assert b + p + s == pytest.approx(1, abs=2e-4) and r["triadic_product"] == pytest.approx(b * p * s, abs=1e-4)
    e = [math.exp(x) for x in (0.5, 0.5, 0.4)]
    assert got[0]["loading_social"] == round(e[2] / sum(e), 4)
    assert [r["dominance_n"] for r in semantic.domain_summary(semantic.domain_loadings(df)).collect()] == [1, 0, 1]
    assert semantic.co_loading(semantic.pairwise(semantic.domain_loadings(df))).count() == 9


def test_products_and_summaries_of_rounded_loadings(spark):
    """Loadings of two records and their products."""
    df = spark.createDataFrame([(0.3412, 0.3399, 0.3189), (0.3361, 0.3427, 0.3212)], ", ".join(f"loading_{d} double" for d in semantic.DOMAINS))
    r = semantic.pairwise(df).collect()
    assert [r[0][c] for c in ("bio_psych", "bio_social", "psych_social", "triadic_product")] == [0.116, 0.1088, 0.1084, 0.037]
    assert tuple(semantic.pairwise_summary(semantic.pairwise(df)).first()) == (0.1156, 0.1084, 0.1092, 0.037)


def test_parts_and_geometry(spark):
    c = spark.createDataFrame([("1", "b", "x", 0.2), ("1", "b", "y", 0.2), ("1", "s", "z", 0.9)], "record_id string, domain string, part string, cosine double")
    parents = spark.createDataFrame([("1", "b", 0.6), ("1", "s", 0.4)], "record_id string, domain string, parent double")
    assert sorted(rows(semantic.part_loadings(c, parents))) == [("1", "b", "x", 0.3), ("1", "b", "y", 0.3), ("1", "s", "z", 0.4)]
    one = spark.range(1)
    x, y = semantic.ternary(F.lit(0.2), F.lit(0.3), F.lit(0.5))
    assert tuple(one.select(F.round(x, 6), F.round(y, 6), semantic.in_triangle(x, y), semantic.in_triangle(F.lit(0.1), F.lit(0.9))).first()) == (0.55, 0.433013, True, False)
    assert tuple(one.select(semantic.strength([F.lit(1.0), F.lit(0.0), F.lit(0.0)]), semantic.strength([F.lit(1 / 3)] * 3), semantic.blend(F.lit(1.0), F.lit(0.0), 0.6)).first()) == (1.0, 0.0, 0.6)


def test_tfidf(spark):
    docs = spark.createDataFrame([("1", "Pain and pain relief"), ("2", "the relief"), ("3", "")], "k string, t string")
    got = {(r["k"], r["term"]): r["weight"] for r in semantic.tfidf(docs, key="k", text="t", stop_words=["and", "the"]).collect()}
    idf = {1: math.log(4 / 2) + 1, 2: math.log(4 / 3) + 1}
    raw = {"pain": 2 * idf[1], "relief": idf[2], "pain pain": idf[1], "pain relief": idf[1]}
    norm = math.sqrt(sum(v * v for v in raw.values()))
    assert {t: w for (k, t), w in got.items() if k == "1"} == pytest.approx({t: v / norm for t, v in raw.items()})
    assert got["2", "relief"] == pytest.approx(1) and not any(k == "3" for k, _ in got)


def test_semantic_run_without_vectors_and_with(spark):
    df = spark.createDataFrame([("1", "Central sensitization and neuroplasticity", "brain", "", 2020, "a"), ("2", "Work disability and family", "social support network", "", 2021, "b")], "record_id string, title string, abstract string, objective_text string, year int, review_type string")
    made = semantic.run(df)
    assert {r["record_id"]: r["dominant_domain"] for r in made.records.collect()} == {"1": "biological", "2": "social"}
    assert made.parts.count() == 84 and made.part_summary.count() == 42 and made.domain_summary.count() == 3

    def embed(rows_):
        return rows_.select("record_id", F.transform(F.array(*map(F.lit, ("bio", "psycho", "social"))), lambda w: F.when(F.lower("text").contains(w), 1.0).otherwise(0.1)).alias("vector"))

    assert semantic.run(df, embed).method == "embedding"


def test_landscape(spark):
    random.seed(4)
    data = [(i, [random.gauss(0, 1) * 3, random.gauss(0, 1), 5.0]) for i in range(40)]
    df = spark.createDataFrame(data, "k int, v array<double>")
    s = [r["scaled"] for r in landscape.scaled(df, "v").collect()]
    for c in range(2):
        x = [v[c] for v in s]
        assert sum(x) == pytest.approx(0, abs=1e-9) and sum(v * v for v in x) / len(x) == pytest.approx(1)
    assert {v[2] for v in s} == {0.0}
    _, explained = landscape.components(df, "v", 2)
    assert explained[0] > explained[1] > 0 and sum(explained) == pytest.approx(1)
    assert landscape.dimensions(5, 100) == 4 and landscape.dimensions(1000, 100) == 36
    d = landscape.density(landscape.coordinates(df, "v"), F.col("pca_x"), F.col("pca_y"), low=-5, high=5, steps=20, bandwidth=0.5)
    assert d.agg(F.sum("density")).first()[0] * (10 / 19) ** 2 == pytest.approx(1, abs=0.05)


def test_every_record_gets_one_decision(spark, sf):
    from litmill.plans import catalogue

    got = coding.screen(catalogue.studies(spark, sf))
    assert got.count() == catalogue.studies(spark, sf).count() and got.where("stage1_decision not in ('include', 'exclude', 'unclear')").count() == 0


def test_quantiles_are_exact_and_split_over_ranges(spark):
    import numpy as np

    values = {"a": [float(i * 7919 % 503) for i in range(503)], "b": [5.0] * 400 + [1.0], None: [2.5], "c": [-1.0, 4.0]}
    data = [(k, v) for k, vs in values.items() for v in vs] + [("a", None), ("none", None)]
    df = spark.createDataFrame(data, "k string, v double").repartition(5)
    at = (0.0, 0.05, 0.5, 0.95, 1.0)
    got = {r["k"]: r for r in frequency.summary(df, "v", "k", at=at).collect()}
    assert set(got) == {"a", "b", "c", None, "none"} and got["none"]["n"] == 0 and got["none"]["p50"] is None
    for k, vs in values.items():
        assert got[k]["n"] == len(vs)
        assert np.allclose([got[k][f"p{int(round(p * 100)):02d}"] for p in at], np.quantile(vs, at))
    whole = frequency.summary(df, "v").first()
    assert np.isclose(whole["p25"], np.quantile([v for _, v in data if v is not None], 0.25))
    assert frequency.summary(df.where("false"), "v").first()["p50"] is None


def test_ranks_of_a_hot_key_in_ranges(spark):
    df = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), (F.col("id") * 7919 % 3001).alias("o"))
    order = [F.desc("o"), F.asc("id")]
    one, many = (rows(dedupe.ranked(df, "k", "n", order, limit).select("id", "n").orderBy("id")) for limit in (10_000, 100))
    assert one == many and max(n for _, n in one) == 2000


def test_last_of_several_links(spark):
    from litmill.operators import fulltext

    c = spark.createDataFrame([("r1", "1", ""), ("r2", "2", None)], "record_id string, pmid string, pmcid string")
    links = spark.createDataFrame([("1", "PMC9", 1), ("1", "PMC2", 2), ("2", "PMC5", 1)], "pmid string, linked string, ord int")
    assert [r["pmcid"] for r in fulltext.resolve(c, links).orderBy("record_id").collect()] == ["PMC2", "PMC5"]
    assert [r["pmcid"] for r in fulltext.resolve(c, links.drop("ord")).orderBy("record_id").collect()] == ["PMC9", "PMC5"]


def test_sketches_of_parts_give_quantiles_of_the_whole(spark):
    rows = spark.range(60_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 11).alias("part"), F.when(F.col("id") % 100 > 0, F.pow(F.pmod(F.xxhash64("id"), F.lit(10_000)) / 100.0, F.lit(2.0))).alias("x"))
    parts = frequency.quantile_sketches(rows, "x", "g", "part")
    merged = frequency.merged_sketches(parts, "g")
    shares = (0.001, 0.1, 0.5, 0.9, 0.999)
    values = {g: sorted(r["x"] for r in rows.where(F.col("g") == g).where("x is not null").collect()) for g in range(3)}
    for r in merged.select("g", "n", *(frequency.sketch_quantile(F.col("sketch"), q).alias(f"q{i}") for i, q in enumerate(shares))).collect():
        own = values[r["g"]]
        assert r["n"] == len(own)
        for i, q in enumerate(shares):
            assert bisect.bisect_left(own, r[f"q{i}"]) / len(own) - 0.01 <= q <= bisect.bisect_right(own, r[f"q{i}"]) / len(own) + 0.01
    loadings = rows.where("x is not null").select(F.lit("d").alias("domain"), F.col("g").cast("string").alias("part"), F.col("x").alias("loading"))
    exact, near = ({r["part"]: r["median_loading"] for r in semantic.part_summary(loadings, sketch=k).collect()} for k in (None, 2000))
    assert all(abs(bisect.bisect_left(values[int(p)], near[p]) - bisect.bisect_left(values[int(p)], exact[p])) <= 0.01 * 20_000 for p in exact)
    assert frequency.quantile_sketches(rows.where("x is null"), "x", "g").count() == 0
