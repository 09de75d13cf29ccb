"""Mixing sources to target weights by repetition.

Sources in the order of their code points (null last) weigh 5, 2, 1, repeating, and share all words by weight. No
source's target goes over ``most`` times its size; what is over is shared among the rest by weight, until none is over.
A source's rate is its target over its size: each of its documents is taken floor(rate) times, and once more with a
probability of the fraction, decided by a hash of the document's key and a seed, so that reruns agree.

The draw is systematic. A source's documents lie on a circle of its words, in the order of their hashes; a hash of the seed
and the source turns it, and a document is copied if its start then lies in the first part of the circle, as long as
the fraction. Over seeds the turn is even, so each copy has just the fraction's probability, in a source of one
document too; and the copies are an arc, so their words are those asked for to within a document. Independent
draws let a few long documents carry a small source far off (by up to 69 % of its target on the test tables). As hashes are
dealt to BINS, the documents of a bin have one start. An arc is at most two ranges of bins, which is all that a source needs.

Nulls: a null text has size 0, a null source is a source of its own, and rows without a key draw by their text. Sources
without words have target and rate 0. Repeated keys decide alike. A very long text is one row, its words are counted in
place. An empty table gives an empty mix. Other columns are left out of the plan and kept by mix(), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litmill.llm._base import DOCS_A_FILE, SPACES, materialise, table

WEIGHTS = (5, 2, 1)
MOST = 3.0
#: Ranges of the hash in which a source's words are summed: the places where a document can start, and the most rows a
#: source has from then on, so that the largest source is summed in many tasks.
BINS, SHELF = 1 << 16, 1 << 8
SEED = 7
#: Sources, and characters of their names, up to which their rates are sent to every executor.
BROADCAST_SOURCES, BROADCAST_CHARS = 10_000, 1_000_000


def size_of(text: Column) -> Column:
    """The number of words: stretches without a space or 0x09 to 0x0D."""
    plain = F.translate(F.coalesce(text, F.lit("")), SPACES[1:], " " * (len(SPACES) - 1))
    return F.size(F.filter(F.split(plain, " "), lambda w: w != "")).cast("long")


def targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """sizes: source, source_size, a row a source. Adds weight and target.

    The sources that stop at their limit are those with the least limit per weight. In that order, the level that the
    rest shares after the first k stopped is (all - their limits) / (weight of the rest); the first source that stays
    under the level then fixes it.
    """
    n = len(weights)
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % n + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("limit", F.col("source_size") * F.lit(float(most)))
    all_ = Window.partitionBy()
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    below = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn(
        "level",
        (F.sum("source_size").over(all_) - F.coalesce(F.sum("limit").over(below), F.lit(0.0)))
        / (F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(below), F.lit(0.0))),
    )
    free = F.when(F.col("limit") > F.col("level") * F.col("weight"), F.col("level"))
    # Levels rise while sources stop and fall after the first that doesn't, so that one's level is the highest of the free.
    ranked = ranked.withColumn("shared", F.max(free).over(all_))
    target = F.when(F.col("shared").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("shared") * F.col("weight")))
    return ranked.select("source", "source_size", "weight", target.alias("target"))


def _unit(name: Column, seed: int) -> Column:
    """48 bits of a hash: a number from 0 up to but not 1."""
    return F.conv(F.substr(F.sha2(F.concat(F.lit(f"{seed}:"), name), 256), F.lit(1), F.lit(12)), 16, 10).cast("bigint") / F.lit(float(1 << 48))


def chance(key: Column, text: Column, seed: int = SEED) -> Column:
    """A number from 0 up to but not 1 by the key, or by the text if there is no key."""
    return _unit(F.coalesce(key.cast("string"), F.concat(F.lit("text "), F.sha2(F.coalesce(text, F.lit("")), 256))), seed)


def turn(source: Column, seed: int = SEED) -> Column:
    """How far a source's circle is turned."""
    return _unit(F.coalesce(F.concat(F.lit("source "), source.cast("string")), F.lit("no source")), seed)


def rates_of(sized: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, most: float = MOST, seed: int = SEED) -> DataFrame:
    """sized: source, size, chance. Result: of, source_size, weight, target, rate, low, high, wrap, a row a source, written once.

    Bins from low to high and those up to wrap are copied once more.
    """
    rows = sized.count()
    bins = materialise(sized.groupBy("source", F.floor(F.col("chance") * BINS).alias("bin")).agg(F.sum("size").alias("s")), rows)
    found = targets(bins.groupBy("source").agg(F.sum("s").alias("source_size")), weights=weights, most=most)
    found = found.withColumnRenamed("source", "of").withColumn("rate", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)))
    found = found.withColumns({"asked": (F.col("rate") - F.floor("rate")) * F.col("source_size"), "ahead": turn(F.col("of"), seed) * F.col("source_size")})
    found = materialise(found, rows)
    # Words before each bin: sums run within shelves of bins, and over a source's shelves, so that no task has a whole source.
    shelf = F.floor(F.col("bin") / SHELF)
    shelves = bins.groupBy(F.col("source").alias("of"), shelf.alias("shelf")).agg(F.sum("s").alias("s"))
    shelves = shelves.select("of", "shelf", (F.sum("s").over(Window.partitionBy("of").orderBy("shelf")) - F.col("s")).alias("before"))
    shelves = shelves.join(found.select(F.col("of").alias("own"), "asked", "ahead", "source_size"), F.col("of").eqNullSafe(F.col("own"))).drop("own")
    within = bins.select("source", "bin", shelf.alias("at"), (F.sum("s").over(Window.partitionBy("source", shelf).orderBy("bin")) - F.col("s")).alias("within"))
    places = within.join(shelves, F.col("source").eqNullSafe(F.col("of")) & (F.col("at") == F.col("shelf")))
    turned = F.col("before") + F.col("within") + F.col("ahead")
    round_ = turned >= F.col("source_size")
    taken = F.when(round_, turned - F.col("source_size")).otherwise(turned) < F.col("asked")
    arcs = places.groupBy(F.col("of").alias("for")).agg(*(f(F.when(taken & side, F.col("bin"))).alias(name) for name, f, side in (("low", F.min, round_), ("high", F.max, round_), ("wrap", F.max, ~round_))))
    return materialise(found.drop("asked", "ahead").join(arcs, F.col("of").eqNullSafe(F.col("for"))).drop("for"), found.count())


def _copies(rows: DataFrame, rates: DataFrame, most: float) -> DataFrame:
    """rows: source, chance, ..; adds source_size, target and copies: floor(rate) and the copy that the draw decides.

    Rows stay where they are if the sources are few and short, and are joined by the source otherwise.
    """
    n, chars = rates.agg(F.count("*"), F.coalesce(F.sum(F.length("of")), F.lit(0))).first()
    rates = F.broadcast(rates) if n <= BROADCAST_SOURCES and chars <= BROADCAST_CHARS else rates
    bin_ = F.floor(F.col("chance") * BINS)
    more = F.coalesce(bin_.between(F.col("low"), F.col("high")), F.lit(False)) | F.coalesce(bin_ <= F.col("wrap"), F.lit(False))
    copies = F.least(F.floor("rate") + more.cast("long"), F.lit(int(most)).cast("long"))
    return rows.join(rates, rows["source"].eqNullSafe(rates["of"]), "left").withColumn("copies", copies)


def _sized(docs: DataFrame, key: str, text: str, source: str, seed: int) -> DataFrame:
    return docs.select(F.col(key).alias("key"), F.col(source).alias("source"), size_of(F.col(text)).alias("size"), chance(F.col(key), F.col(text), seed).alias("chance"))


def plan(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, most: float = MOST, seed: int = SEED, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """key, size, source_size, target, copies, taken: a row a document."""
    sized = materialise(_sized(docs, key, text, source, seed), docs.count(), DOCS_A_FILE)
    found = _copies(sized, rates_of(sized, weights=weights, most=most, seed=seed), most)
    return found.select(F.col("key").alias(key), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, most: float = MOST, seed: int = SEED, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents themselves, each as often as the plan takes it; columns as they were."""
    rates = rates_of(_sized(docs, key, text, source, seed), weights=weights, most=most, seed=seed)
    rows = docs.select(F.struct("*").alias("row"), F.col(source).alias("source"), chance(F.col(key), F.col(text), seed).alias("chance"))
    taken = _copies(rows, rates, most).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return taken.select("row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = plan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'text ' || sha256(coalesce(text, '')))), 1, 12) AS BIGINT) / {float(1 << 48)} AS chance
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS place FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE (place - 1) % 3 WHEN 0 THEN {WEIGHTS[0]}.0 WHEN 1 THEN {WEIGHTS[1]}.0 ELSE {WEIGHTS[2]}.0 END::DOUBLE AS weight, source_size * {MOST}::DOUBLE AS most FROM sources
), levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(most) OVER below, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER below, 0.0)) AS level
  FROM weighed WINDOW below AS (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), shared AS (
  SELECT *, max(CASE WHEN most > level * weight THEN level END) OVER () AS shared FROM levels
), targets AS (
  SELECT source, source_size, CASE WHEN shared IS NULL THEN most ELSE least(most, shared * weight) END AS target FROM shared
), rates AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0.0 ELSE target / source_size END AS rate FROM targets
), bins AS (
  SELECT source, CAST(floor(chance * {BINS}) AS BIGINT) AS bin, sum(size) AS s FROM sized GROUP BY ALL
), places AS (
  SELECT b.source, bin, r.rate, r.source_size, (r.rate - floor(r.rate)) * r.source_size AS asked, sum(s) OVER (PARTITION BY b.source ORDER BY bin)::BIGINT - s::BIGINT
    + CAST('0x' || substr(sha256('{SEED}:' || coalesce('source ' || b.source, 'no source')), 1, 12) AS BIGINT) / {float(1 << 48)} * r.source_size AS turned
  FROM bins b JOIN rates r ON b.source IS NOT DISTINCT FROM r.source
), taken AS (
  SELECT source, bin, CASE WHEN turned >= source_size THEN turned - source_size ELSE turned END < asked AS more FROM places
)
SELECT d.doc_id, d.size, r.source_size, r.target, CAST(least(floor(r.rate) + CASE WHEN more THEN 1 ELSE 0 END, {int(MOST)}) * d.size AS BIGINT) AS taken
FROM sized d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source JOIN taken t ON d.source IS NOT DISTINCT FROM t.source AND CAST(floor(d.chance * {BINS}) AS BIGINT) = t.bin
"""
