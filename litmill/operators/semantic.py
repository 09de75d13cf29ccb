"""Loadings of records on anchors: cosines, softmax within groups, products of domains, TF-IDF."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litmill.functions import text as T
from litmill.operators import packed_terms
from litmill.operators.settled import settled
from litmill.operators.vocabulary import ONTOLOGY

DOMAINS = ("biological", "psychological", "social")


def prompts() -> list[tuple[str, str, int, str]]:
    """domain, part ('' for the domain itself), place, text: of all domains and of all their parts."""
    out = [(d, "", i, f"{d} chronic pain ontology. {'; '.join(parts)}.") for i, (d, parts) in enumerate(ONTOLOGY.items())]
    return out + [(d, p, i, f"{d} chronic pain subdomain. {p}.") for d, parts in ONTOLOGY.items() for i, p in enumerate(parts)]


def ontology(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(prompts(), "domain string, part string, ord int, prompt string")


def semantic_text(title: Column, abstract: Column, objective: Column) -> Column:
    t, a, o = (T.strip(T.blank(c)) for c in (title, abstract, objective))
    return T.strip(F.concat(F.lit("Title. "), t, F.lit("\n\nAbstract. "), a, F.lit("\n\nObjective. "), o))


def corpus(coded: DataFrame) -> DataFrame:
    """Records with a text that is long enough to be compared."""
    return coded.withColumn("semantic_text", semantic_text(F.col("title"), F.col("abstract"), F.col("objective_text"))).where(F.length("semantic_text") > 20)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null if either vector has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def anchor_cosines(records: DataFrame, anchors: DataFrame, *, key: str, vector: str, anchor_key: str = "anchor", anchor_vector: str = "anchor_vector", most: int = 1000) -> DataFrame:
    """key, anchor, cosine: every record with every anchor. The anchors are an ontology, whose size is checked."""
    held = anchors.select(F.col(anchor_key).alias("anchor"), F.col(anchor_vector).alias("v")).limit(most + 1).collect()
    if len(held) > most:
        raise ValueError(f"over {most} anchors")
    spark = records.sparkSession
    few = spark.createDataFrame(held, anchors.select(F.col(anchor_key).alias("anchor"), F.col(anchor_vector).alias("v")).schema)
    one = few.agg(F.collect_list(F.struct("anchor", "v")).alias("_anchors"))  # a single row
    each = records.select(key, vector).join(F.broadcast(one)).select(key, vector, F.explode("_anchors").alias("a"))
    return each.select(key, F.col("a.anchor").alias("anchor"), cosine(F.col(vector), F.col("a.v")).alias("cosine"))


def softmax(tall: DataFrame, value: str, *keys: str, name: str = "loading") -> DataFrame:
    """exp over the sum within the keys, from the largest so that nothing overflows."""
    w = Window.partitionBy(*keys)
    e = F.exp(F.col(value) - F.max(value).over(w))
    return tall.withColumn("_e", e).withColumn(name, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def softmax_of(values: Sequence[Column]) -> list[Column]:
    top = F.greatest(*values)
    e = [F.exp(v - top) for v in values]
    total = reduce(lambda a, b: a + b, e)
    return [x / total for x in e]


def dominant(values: Sequence[Column], labels: Sequence[str]) -> Column:
    """The label of the largest value, the first of equals."""
    a = F.array(*values)
    return F.element_at(F.array(*map(F.lit, labels)), F.array_position(a, F.array_max(a)).cast("int"))


def domain_loadings(cosines: DataFrame, domains: Sequence[str] = DOMAINS, digits: int = 4) -> DataFrame:
    """cosines: columns cosine_<domain>. Adds loading_<domain> and dominant_domain; both are rounded after the choice."""
    raw = softmax_of([F.col(f"cosine_{d}") for d in domains])
    out = cosines.withColumn("dominant_domain", dominant(raw, domains))
    out = out.withColumns({f"loading_{d}": F.bround(x, digits) for d, x in zip(domains, raw, strict=True)})
    return out.withColumns({f"cosine_{d}": F.bround(F.col(f"cosine_{d}"), digits) for d in domains})


def wide(tall: DataFrame, key: str, label: str, value: str, labels: Sequence[str], prefix: str) -> DataFrame:
    return tall.groupBy(key).agg(*(F.max(F.when(F.col(label) == x, F.col(value))).alias(prefix + x) for x in labels))


def domain_summary(loadings: DataFrame, domains: Sequence[str] = DOMAINS, digits: int = 4) -> DataFrame:
    """A row a domain in order: means of the rounded values and how often it leads."""
    once = loadings.agg(*(x for i, d in enumerate(domains) for x in (F.avg(f"cosine_{d}").alias(f"c{i}"), F.avg(f"loading_{d}").alias(f"l{i}"), F.count_if(F.col("dominant_domain") == d).alias(f"n{i}"))))
    rows = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(d).alias("domain"), F.bround(F.col(f"c{i}"), digits).alias("mean_cosine"), F.bround(F.col(f"l{i}"), digits).alias("mean_loading"), F.col(f"n{i}").alias("dominance_n")) for i, d in enumerate(domains)))
    return once.select(F.explode(rows).alias("x")).select("x.*").orderBy("ord").drop("ord")


def part_loadings(cosines: DataFrame, parents: DataFrame, *, key: str = "record_id") -> DataFrame:
    """cosines: key, domain, part, cosine; parents: key, domain, parent. The softmax within a domain, times the parent's loading."""
    soft = softmax(cosines, "cosine", key, "domain", name="_share")
    return soft.join(parents, [key, "domain"]).select(key, "domain", "part", (F.col("_share") * F.col("parent")).alias("loading"))


def part_summary(loadings: DataFrame, digits: int = 4, sketch: int | None = None) -> DataFrame:
    """Means and medians of each part, by the largest mean. sketch: medians by KLL sketches of that size, where groups are too large for exact ones."""
    median = F.median("loading") if sketch is None else F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double("loading", F.lit(sketch)), F.lit(0.5))
    made = loadings.groupBy("domain", "part").agg(F.bround(F.avg("loading"), digits).alias("mean_loading"), F.bround(median, digits).alias("median_loading"))
    return made.orderBy("domain", F.desc("mean_loading"), "part")


PAIRS = (("bio_psych", 0, 1), ("bio_social", 0, 2), ("psych_social", 1, 2))


def pairwise(loadings: DataFrame, domains: Sequence[str] = DOMAINS, digits: int = 4) -> DataFrame:
    """Products of two domains' rounded loadings, and of all three."""
    c = [F.col(f"loading_{d}") for d in domains]
    return loadings.withColumns({**{n: F.bround(c[i] * c[j], digits) for n, i, j in PAIRS}, "triadic_product": F.bround(c[0] * c[1] * c[2], digits)})


def pairwise_summary(products: DataFrame, digits: int = 4) -> DataFrame:
    return products.agg(*(F.bround(F.avg(n), digits).alias(f"{n}_mean") for n in (*(p[0] for p in PAIRS), "triadic_product")))


def co_loading(products: DataFrame, domains: Sequence[str] = DOMAINS) -> DataFrame:
    """row, column, value: mean loadings on the diagonal, mean products beside it."""
    name = {(i, j): n for n, i, j in PAIRS}
    cells = [(a, b, F.avg(f"loading_{domains[a]}") if a == b else F.avg(name[min(a, b), max(a, b)])) for a in range(3) for b in range(3)]
    once = products.agg(*(v.alias(f"v{a}{b}") for a, b, v in cells))
    rows = F.array(*(F.struct(F.lit(domains[a]).alias("row"), F.lit(domains[b]).alias("column"), F.col(f"v{a}{b}").alias("value")) for a, b, _ in cells))
    return once.select(F.explode(rows).alias("x")).select("x.*")


def deviation(loadings: DataFrame, domains: Sequence[str] = DOMAINS) -> DataFrame:
    """dev_x, dev_y: psychological less biological, and social from a third, of loadings that sum to one; with gaps to even products."""
    c = [F.col(f"loading_{d}") for d in domains]
    total = c[0] + c[1] + c[2]
    b, p, s = (x / total for x in c)
    return loadings.withColumns({"dev_x": p - b, "dev_y": s - F.lit(1 / 3), "gap_bp": b * p - F.lit(1 / 9), "gap_bs": b * s - F.lit(1 / 9), "gap_ps": p * s - F.lit(1 / 9), "gap_all": b * p * s - F.lit(1 / 27)})


def strength(loadings: Sequence[Column]) -> Column:
    """How far the leading loading is from an even third, from 0 to 1."""
    return F.least(F.greatest((F.greatest(*loadings) - F.lit(1 / 3)) / F.lit(2 / 3), F.lit(0.0)), F.lit(1.0))


def ternary(bio: Column, psych: Column, social: Column) -> tuple[Column, Column]:
    """Where shares lie in a triangle with corners (0, 0), (1, 0) and (1/2, sqrt 3 / 2)."""
    total = bio + psych + social
    return (psych + social / 2) / total, social / total * F.lit(3**0.5 / 2)


def in_triangle(x: Column, y: Column) -> Column:
    h = F.lit(3**0.5)
    return (y >= 0) & (y <= h * x) & (y <= h * (1 - x))


def blend(own: Column, centre: Column, weight: float) -> Column:
    """A place drawn towards a centre; the weight is the place's own."""
    return own * weight + centre * (1 - weight)


TOKEN = r"(?U)\b\w\w+\b"


def tokens(text: Column, stop_words: Sequence[str] = (), pattern: str = TOKEN) -> Column:
    got = F.regexp_extract_all(F.lower(T.blank(text)), F.lit(pattern), F.lit(0))
    return F.filter(got, lambda t: ~t.isin(*stop_words)) if stop_words else got


def english_stop_words() -> list[str]:
    from pyspark.ml.feature import StopWordsRemover

    return StopWordsRemover.loadDefaultStopWords("english")


def _terms(texts: Column, stop_words: Sequence[str], bigrams: bool, pattern: str) -> Column:
    t = tokens(texts, stop_words, pattern)
    if not bigrams:
        return t
    two = F.zip_with(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, 2, F.size(t)), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(t, F.when(F.size(t) > 1, two).otherwise(F.array().cast("array<string>")))


def _idf(n: Column, df: Column) -> Column:
    return F.log((1 + n) / (1 + df)) + 1


def tfidf(docs: DataFrame, *, key: str, text: str, stop_words: Sequence[str] = (), bigrams: bool = True, pattern: str = TOKEN, asked: DataFrame | None = None) -> DataFrame:
    """key, term, weight: counts times ln((1 + N) / (1 + df)) + 1, scaled so that a document's weights have length one.

    Stop words go before pairs of words are made. Terms are counted in each document before anything is shuffled.

    asked: rows of the same form whose terms are the only ones wanted, as those of anchors. Weights are the same, of all terms of all
    documents, but only lengths are worked out from all of them, once; see packed_terms. Tokens must hold no blank then.
    """
    if asked is not None:
        return _asked(docs, asked, key, text, stop_words, bigrams, pattern)
    t = docs.select(key, _terms(F.col(text), stop_words, bigrams, pattern).alias("t"))
    counts = t.select(key, F.explode("t").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("_n"))  # one row
    raw = counts.join(df, "term").join(F.broadcast(n)).withColumn("_w", F.col("tf") * _idf(F.col("_n"), F.col("df")))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("_w") / norm).alias("weight"))


def _asked(docs: DataFrame, asked: DataFrame, key: str, text: str, stop_words: Sequence[str], bigrams: bool, pattern: str) -> DataFrame:
    """Weights of the terms of ``asked`` in all documents, on partitions by key. Up to FEW terms go to the documents."""
    wanted = settled(asked.select(F.explode(_terms(F.col(text), stop_words, bigrams, pattern)).alias("term")).distinct())
    few_ = wanted.count() <= FEW
    terms = [r["term"] for r in wanted.collect()] if few_ else None
    found = packed_terms.weights(docs, key, text, tokens(F.col(text), stop_words, pattern), bigrams=bigrams, wanted=terms)
    return found if few_ else found.join(wanted, "term", "left_semi").select(key, "term", "weight")


#: Rows of a term, a name and a number that are sent to every executor at most.
FEW = 1_000_000


def few(written: DataFrame) -> DataFrame:
    """The written frame, sent to every executor if it has FEW rows at most; joins shuffle it otherwise."""
    return F.broadcast(written) if written.count() <= FEW else written


def tfidf_cosines(weights: DataFrame, anchors: DataFrame, *, key: str, anchor_key: str) -> DataFrame:
    """Cosines of documents and anchors that share a term, by the terms' index.

    Few anchors go to the documents, so weights that lie by their key stay where they are."""
    a = settled(anchors.select(F.col(anchor_key).alias("anchor"), "term", F.col("weight").alias("_a")))
    if a.count() <= FEW:
        w = weights.select(F.col(key).alias("key"), "term", "weight")
        return packed_terms.cosines(w, a.withColumnRenamed("_a", "weight")).select(F.col("key").alias(key), "anchor", "cosine")
    return weights.join(a, "term").groupBy(key, "anchor").agg(F.sum(F.col("weight") * F.col("_a")).alias("cosine"))


#: A term in more than this part of the documents is left for last.
HOT = 0.02
#: Digits by which cosines are told apart.
DIGITS = 9


def top_cosines(weights: DataFrame, anchors: DataFrame, k: int, *, key: str, anchor_key: str, hot: float = HOT, most: int | None = None) -> DataFrame:
    """anchor, rank, key, cosine: of each anchor the k documents of the highest cosines above 0; equal ones, to DIGITS, by key.

    weights: key, term, weight; anchors: anchor_key, term, weight; none negative. Anchors of ``most`` terms in all (FEW) go to the
    documents, each task keeps the best of its own for each anchor, and nothing else moves. More are found by bounds: documents are counted through the index of
    rare terms first; each anchor's k-th best sum so far is a floor. Of its common terms, the commonest are left out while
    what they can add at most (the anchor's weight times the term's largest) stays under the floor: a document with none of the others can't be
    among the best. The rest are summed too, and the few documents that can still pass the floor get what was left out from
    their own weights. So common terms meet all documents only for anchors that are about nothing else.
    """
    w = weights.select(F.col(key).alias("key"), "term", "weight")
    a = settled(anchors.select(F.col(anchor_key).alias("anchor"), "term", F.col("weight").alias("aw")))

    def ranked(whole: DataFrame) -> DataFrame:
        best = whole.where("cosine > 0").withColumn("rank", F.row_number().over(Window.partitionBy("anchor").orderBy(F.col("cosine").desc(), "key"))).where(F.col("rank") <= k)
        return best.select(F.col("anchor").alias(anchor_key), "rank", F.col("key").alias(key), "cosine")

    if a.count() <= (FEW if most is None else most):
        near = packed_terms.cosines(w, a.withColumnRenamed("aw", "weight"), best=k, slack=10.0 ** (1 - DIGITS))
        return ranked(near.withColumn("cosine", F.round("cosine", DIGITS)))
    asked = a.select("term").distinct()
    w = settled(w.join(asked, "term", "left_semi"))
    n = w.select("key").distinct().count()
    stats = w.groupBy("term").agg(F.count("*").alias("df"), F.max("weight").alias("most"))
    a = settled(a.join(stats, "term").withColumns({"bound": F.col("aw") * F.col("most"), "is_hot": F.col("df") > hot * n}))
    floor_order = Window.partitionBy("anchor").orderBy(F.col("s").desc(), F.col("key"))

    def summed(some: DataFrame) -> DataFrame:
        return w.join(some.select("anchor", "term", "aw"), "term").groupBy("anchor", "key").agg(F.sum(F.col("weight") * F.col("aw")).alias("s"))

    def floors(partial: DataFrame) -> DataFrame:
        return partial.withColumn("place", F.row_number().over(floor_order)).where(F.col("place") == k).select("anchor", F.col("s").alias("floor"))

    slack = F.lit(10.0 ** (1 - DIGITS))
    rare = settled(summed(a.where(~F.col("is_hot"))))
    common = a.where("is_hot").join(floors(rare), "anchor", "left")
    upto = F.sum("bound").over(Window.partitionBy("anchor").orderBy(F.col("df").desc(), "term"))
    common = settled(common.withColumn("left_out", F.coalesce(upto < F.col("floor") - slack, F.lit(False))))
    partial = settled(rare.unionByName(summed(common.where(~F.col("left_out")))).groupBy("anchor", "key").agg(F.sum("s").alias("s")))
    out = common.where("left_out")
    more = out.groupBy("anchor").agg(F.sum("bound").alias("more"))
    able = partial.join(more, "anchor", "left").join(floors(partial), "anchor", "left").where(F.col("floor").isNull() | (F.col("s") + F.coalesce("more", F.lit(0.0)) >= F.col("floor") - slack))
    able = settled(able.select("anchor", "key", "s"))
    rest = able.join(out.select("anchor", "term", "aw"), "anchor").join(w, ["key", "term"]).groupBy("anchor", "key").agg(F.sum(F.col("weight") * F.col("aw")).alias("s"))
    return ranked(able.unionByName(rest).groupBy("anchor", "key").agg(F.round(F.sum("s"), DIGITS).alias("cosine")))


@dataclass
class Loadings:
    """What run() gives."""

    method: str
    records: DataFrame
    parts: DataFrame
    domain_summary: DataFrame
    part_summary: DataFrame
    pairwise: DataFrame
    pairwise_summary: DataFrame
    dominance_by_review_type: DataFrame


def run(coded: DataFrame, embed=None, stop_words: Sequence[str] | None = None) -> Loadings:
    """Loadings of coded records on the ontology, by vectors that ``embed`` gives for a frame of key and text, or else by TF-IDF."""
    from litmill.operators.frequency import crosstab

    spark = coded.sparkSession
    texts = corpus(coded)
    names = ontology(spark).select(F.concat_ws("::", "domain", "part").alias("anchor"), F.col("prompt"))
    if embed is not None:
        vectors = embed(texts.select("record_id", F.col("semantic_text").alias("text")))
        anchors = embed(names.select(F.col("anchor").alias("record_id"), F.col("prompt").alias("text"))).select(F.col("record_id").alias("anchor"), F.col("vector").alias("anchor_vector"))
        tall = anchor_cosines(vectors, anchors, key="record_id", vector="vector")
    else:
        every = texts.select("record_id", F.col("semantic_text").alias("text"), F.lit(False).alias("is_anchor")).unionByName(names.select(F.col("anchor").alias("record_id"), F.col("prompt").alias("text"), F.lit(True).alias("is_anchor")))
        w = tfidf(every, key="record_id", text="text", stop_words=english_stop_words() if stop_words is None else stop_words, asked=every.where("is_anchor"))
        is_anchor = F.col("record_id").isin(*(f"{d}::{p}" if p else f"{d}::" for d, p, *_ in prompts()))
        sparse = tfidf_cosines(w.where(~is_anchor), w.where(is_anchor).withColumnRenamed("record_id", "anchor_id"), key="record_id", anchor_key="anchor_id")
        all_pairs = texts.select("record_id", F.explode(F.array(*(F.lit(f"{d}::{p}") for d, p, *_ in prompts()))).alias("anchor"))
        tall = all_pairs.join(sparse, ["record_id", "anchor"], "left").withColumn("cosine", F.coalesce("cosine", F.lit(0.0)))
    tall = tall.withColumns({"domain": F.split("anchor", "::")[0], "part": F.split("anchor", "::")[1]})
    cosines = wide(tall.where("part = ''"), "record_id", "domain", "cosine", DOMAINS, "cosine_")
    extra = [c for c in ("year", "review_type") if c in texts.columns]
    records = domain_loadings(texts.select("record_id", *extra).join(cosines, "record_id"))
    parents = records.select("record_id", F.explode(F.array(*(F.struct(F.lit(d).alias("domain"), F.col(f"loading_{d}").alias("parent")) for d in DOMAINS))).alias("x")).select("record_id", "x.*")
    parts = part_loadings(tall.where("part <> ''").select("record_id", "domain", "part", "cosine"), parents)
    products = pairwise(records)
    by_type = crosstab(records, "review_type", "dominant_domain", DOMAINS) if "review_type" in extra else crosstab(records.withColumn("review_type", F.lit("unclear")), "review_type", "dominant_domain", DOMAINS)
    return Loadings("embedding" if embed else "tfidf", records, parts, domain_summary(records), part_summary(parts), products, pairwise_summary(products), by_type)
