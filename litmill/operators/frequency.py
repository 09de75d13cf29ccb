"""Counts, shares, crosstabs and summaries. Ties are ordered by label, so every result is in a definite order."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litmill.operators.settled import settled


#: Distinct values to a block, as a power of two, of those among which quantiles are looked for.
BLOCK_BITS = 12
#: Columns that a crosstab may have.
MOST_COLUMNS = 10_000


def share(n: Column, total: Column, digits: int = 1) -> Column:
    """Percent, rounded half to even; null if there is no total."""
    return F.bround(F.try_divide(n * 100, total), digits)


def with_percent(counts: DataFrame, column: str = "n") -> DataFrame:
    """Adds the percent of the column's sum over all rows; few rows, as they are counts."""
    return counts.withColumn("percent", share(F.col(column), F.sum(column).over(Window.partitionBy())))


def value_counts(df: DataFrame, column: str, *, name: str | None = None) -> DataFrame:
    """A row a value, nulls left out, the most frequent first."""
    name = name or column
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias(name)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name)


def frequencies(df: DataFrame, column: str, *, name: str | None = None) -> DataFrame:
    return with_percent(value_counts(df, column, name=name)).orderBy(F.desc("n"), name or column)


def group_sizes(df: DataFrame, *keys: str) -> DataFrame:
    """Sizes of all groups, null keys too, by the first key and then the size."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(keys[0], F.desc("n"), *keys[1:])


def label_counts(df: DataFrame, labels: Column, *, name: str, without: Sequence[str] = ()) -> DataFrame:
    """Counts of an array column's elements, with the percent of those that are not left out."""
    each = df.select(F.explode(labels).alias(name)).where(~F.col(name).isin(*without) if without else F.lit(True))
    return frequencies(each, name)


def conditional_counts(df: DataFrame, conditions: dict[str, Column], *, name: str = "indicator", total: Column | None = None) -> DataFrame:
    """A row a condition, in their order, counted in one pass; percent of all rows or of those of ``total``."""
    base = F.count_if(total) if total is not None else F.count("*")
    once = df.agg(base.alias("_total"), *(F.count_if(c).alias(f"_{i}") for i, c in enumerate(conditions.values())))
    rows = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(k).alias(name), F.col(f"_{i}").alias("n")) for i, k in enumerate(conditions)))
    tall = once.select("_total", F.explode(rows).alias("x")).select("x.*", "_total")
    return tall.select("ord", name, "n", share(F.col("n"), F.col("_total")).alias("percent")).orderBy("ord").drop("ord")


def crosstab(df: DataFrame, rows: str, columns: str, values: Sequence[str] | None = None) -> DataFrame:
    """Counts by row and column label, 0 where there are none; columns are those given, or those that occur, in order."""
    if values is None:
        values = [r[0] for r in df.select(columns).where(F.col(columns).isNotNull()).distinct().orderBy(columns).limit(MOST_COLUMNS + 1).collect()]
        if len(values) > MOST_COLUMNS:
            raise ValueError(f"over {MOST_COLUMNS} columns")
    return df.groupBy(rows).pivot(columns, list(values)).agg(F.count(F.lit(1))).na.fill(0).orderBy(rows)


def top_crosstab(df: DataFrame, rows: str, columns: str, k: int = 8) -> DataFrame:
    """The crosstab of the k largest rows and the k largest columns, both by their totals over the whole table."""

    def largest(c: str) -> list:
        return [r[0] for r in value_counts(df, c).limit(k).collect()]

    keep_rows, keep_columns = largest(rows), largest(columns)
    order = F.array_position(F.array(*map(F.lit, keep_rows)), F.col(rows)) if keep_rows else F.lit(0)
    kept = df.where(F.col(rows).isin(*keep_rows))
    return kept.groupBy(rows).pivot(columns, keep_columns).agg(F.count(F.lit(1))).na.fill(0).orderBy(order)


def summary(df: DataFrame, column: str, *keys: str, at: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Number, sum, mean, extremes and quantiles (linear between values), a row a group."""
    c = F.col(column)
    plain = df.groupBy(*keys).agg(F.count(c).alias("n"), F.sum(c).alias("total"), F.avg(c).alias("mean"), F.min(c).alias("least"), F.max(c).alias("most"))
    marks = quantiles(df, column, *keys, at=at)
    names = [f"p{int(round(p * 100)):02d}" for p in at]
    if not keys:
        return plain.join(marks, F.lit(True), "left").select(*plain.columns, *names)  # one row each
    marks = marks.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys))
    return plain.join(marks, same, "left").select(*plain.columns, *names)


def quantiles(df: DataFrame, column: str, *keys: str, at: Sequence[float]) -> DataFrame:
    """Exact quantiles, linear between values, of the groups that have values: the keys, then p and the percent.

    No task holds a group: equal values are counted first, the distinct ones are range-partitioned and sorted, and the
    sums of blocks of them tell which hold the wanted places. Only those are summed value by value.
    """
    names = [f"p{int(round(p * 100)):02d}" for p in at]
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    placed = settled(counts.repartitionByRange(*keys, "_v").sortWithinPartitions(*keys, "_v").withColumn("_part", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy()
    upto = F.sum("_in").over(group.orderBy("_part"))
    ranges = placed.groupBy(*keys, "_part").agg(F.sum("_n").alias("_in"))
    ranges = ranges.withColumns({"_before": upto - F.col("_in"), "_all": F.sum("_in").over(group)})
    # A quantile lies between the values at two places, weighed by how near they are.
    x = [F.lit(float(p)) * (F.col("_all") - 1) for p in at]
    wanted = [F.struct(F.lit(i).alias("i"), edge(p).cast("bigint").alias("place"), weight.alias("w")) for i, p in enumerate(x) for edge, weight in ((F.floor, F.lit(1.0) - (p - F.floor(p))), (lambda p: F.floor(p) + 1, p - F.floor(p)))]
    held = F.filter(F.array(*wanted), lambda s: (s["w"] > 0) & (s["place"] >= F.col("_before")) & (s["place"] < F.col("_before") + F.col("_in")))
    ranges = ranges.select(*(F.col(k).alias(f"_of_{k}") for k in keys), F.col("_part").alias("_range"), "_before", held.alias("_held")).where(F.size("_held") > 0)
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys), F.col("_part") == F.col("_range"))
    run = F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys, "_part").orderBy("_v"))
    here = placed.join(ranges, same).withColumn("_upto", run)
    hits = here.select(*keys, "_v", F.explode(F.filter("_held", lambda s: (s["place"] < F.col("_upto")) & (s["place"] >= F.col("_upto") - F.col("_n")))).alias("_h"))
    return hits.groupBy(*keys).agg(*(F.sum(F.when(F.col("_h.i") == i, F.col("_v") * F.col("_h.w"))).alias(name) for i, name in enumerate(names)))


def mass_by(df: DataFrame, key: str, mass: str, order: DataFrame) -> DataFrame:
    """order: a frame of keys with their place ``ord``. Sums in that order, 0 for keys without rows, and shares of all."""
    sums = df.groupBy(key).agg(F.sum(mass).alias("mass"))
    out = order.join(sums, key, "left").withColumn("mass", F.coalesce("mass", F.lit(0)))
    return out.withColumn("share", F.try_divide(F.col("mass"), F.sum("mass").over(Window.partitionBy()))).orderBy("ord")


def within_band(columns: Sequence[Column], centre: float, width: float) -> Column:
    """Whether all columns are within the width of the centre."""
    return F.greatest(*(F.abs(c - centre) for c in columns)) <= width


def top_share(counts: DataFrame, k: int = 3) -> DataFrame:
    """Of a frame with n: share, that of the k largest; each task passes on its k largest only."""
    top = counts.orderBy(F.desc("n")).limit(k).agg(F.sum("n").alias("_top"))
    return counts.agg(F.sum("n").alias("_all")).join(F.broadcast(top)).select((F.col("_top") / F.col("_all").cast("double")).alias("share"))


def quantile_sketches(df: DataFrame, value: str, *keys: str, size: int = 2000) -> DataFrame:
    """keys, n, sketch (binary): of each group a KLL sketch of its values, merged from those of the tasks.

    Quantiles from it are off by a rank of about 1.7 / size of the group at most, in 99 of 100 cases: 0.1 % at 2,000. It takes a few
    thousand numbers whatever the group, and sketches of parts can be kept and merged. Nulls are left out.
    """
    x = F.col(value).cast("double")
    return df.where(x.isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(x, F.lit(size)).alias("sketch"))


def merged_sketches(sketches: DataFrame, *keys: str, size: int = 2000) -> DataFrame:
    """As quantile_sketches() of all rows, from sketches of parts of them."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(size)).alias("sketch"))


def sketch_quantile(sketch: Column, share: float) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(float(share)))


def relative_to_largest(value: str, key: str) -> Column:
    return F.try_divide(F.col(value), F.max(value).over(Window.partitionBy(key)))


def top_per_group(df: DataFrame, key: str, k: int, *order: Column) -> DataFrame:
    """The first k of each group; order must end in something unique."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """A running number over all rows in an order that ends in something unique.

    One task would have to count all rows otherwise: rows are range-partitioned by the order and written with their place
    in their range, and each range starts at the number of rows in the ranges before it. Rows move once.
    """
    placed = settled(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))
    # A row a range, so as few as there were tasks.
    return placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + within + 1).drop("_part", "_at", "_before")


def rolling_mean(counts: DataFrame, order: str, value: str, *, each_side: int = 1) -> DataFrame:
    """Centred mean over rows in order; for series of few points, such as counts a year."""
    return counts.withColumn("rolling", F.avg(value).over(Window.orderBy(order).rowsBetween(-each_side, each_side)))


def sweep(shares: DataFrame, order: str, value: str, *, full: float = 360.0, start: float = 90.0) -> DataFrame:
    """Start and end angles of shares that follow each other around a circle."""
    upto = F.sum(value).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return shares.withColumns({"start_angle": F.lit(start) + (upto - F.col(value)) * full, "end_angle": F.lit(start) + upto * full})


def pipeline_counts(combined: DataFrame, screened: DataFrame, coded: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row of what each stage holds."""
    once = [
        combined.agg(F.count("*").alias("combined_records"), F.count_if(~F.col("is_duplicate")).alias("deduplicated_records"), F.count_if("is_duplicate").alias("duplicates_removed")),
        screened.agg(*(F.count_if(F.col("stage1_decision") == d).alias(n) for d, n in (("include", "included_records"), ("exclude", "excluded_records"), ("unclear", "unclear_records")))),
        coded.agg(F.count("*").alias("stage2_records"), F.count_if(F.col("stage3_candidate") == "yes").alias("stage3_expected")),
        manifest.agg(
            F.count("*").alias("stage3_candidates"),
            F.count_if(F.col("fulltext_status").isin("pmc_fulltext_cached", "pmc_fulltext_fetched")).alias("stage3_pmc_open_fulltexts"),
            F.count_if(F.col("manual_retrieval_needed") == "yes").alias("stage3_manual_retrieval_required"),
        ),
    ]
    out = once[0]
    for o in once[1:]:
        out = out.join(o)  # each side is the one row of an aggregate
    return out


def flow_nodes(counts: DataFrame, by_database: DataFrame) -> DataFrame:
    """node, label, n, shown: the values of a flow diagram, with thousands separated."""
    names = counts.columns
    tall = counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("node"), F.lit(c.replace("_", " ")).alias("label"), F.col(c).alias("n")) for c in names))).alias("x")).select("x.*")
    bases = by_database.select(F.concat(F.lit("database:"), F.col("database")).alias("node"), F.col("database").alias("label"), "n")
    return tall.unionByName(bases).withColumn("shown", F.format_number("n", 0)).orderBy("node")
