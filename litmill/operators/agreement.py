"""Agreement of two raters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litmill.functions import text as T


def agreement(df: DataFrame, a: str, b: str, digits: int | None = 4) -> DataFrame:
    """status, n, percent_agreement, cohen_kappa: one row.

    Rows count if both raters gave something. Status is empty for a table without rows, not_ready if a column is missing
    or no row counts, else ok. Kappa is null where chance alone would agree always. Counts by pair of labels are made
    first; marginals are sums of those, so the rows are read once.
    """
    if a not in df.columns or b not in df.columns:
        total = df.agg(F.count("*").alias("total"))
        return total.select(F.when(F.col("total") == 0, "empty").otherwise("not_ready").alias("status"), F.lit(0).cast("bigint").alias("n"), *(F.lit(None).cast("double").alias(c) for c in ("percent_agreement", "cohen_kappa")))
    both = df.select(*(T.strip(T.blank(F.col(c).cast("string"))).alias(n) for c, n in ((a, "a"), (b, "b"))))
    cells = both.groupBy("a", "b").agg(F.count("*").alias("n"))
    used = cells.where((F.col("a") != "") & (F.col("b") != ""))
    rows, columns = used.groupBy(F.col("a").alias("l")).agg(F.sum("n").alias("x")), used.groupBy(F.col("b").alias("l")).agg(F.sum("n").alias("y"))
    chance = rows.join(columns, "l").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).cast("double").alias("chance"))
    sums = used.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0)).cast("double").alias("same"))
    one = sums.join(chance).join(cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")))
    po, pe = F.try_divide("same", "n"), F.try_divide(F.col("chance"), F.col("n").cast("double") * F.col("n"))
    kappa = F.when(pe == 1, None).otherwise(F.try_divide(po - pe, 1 - pe))

    def shown(c):
        return F.bround(c, digits) if digits is not None else c

    return one.select(
        F.when(F.col("total") == 0, "empty").when(F.col("n") == 0, "not_ready").otherwise("ok").alias("status"),
        F.col("n").cast("bigint").alias("n"),
        shown(po).alias("percent_agreement"),
        shown(kappa).alias("cohen_kappa"),
    )


def report(stages: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """A row a stage; stages map to a form and its two raters' columns."""
    out = None
    for name, (df, a, b) in stages.items():
        row = agreement(df, a, b).select(F.lit(name).alias("stage"), "*")
        out = row if out is None else out.unionByName(row)
    return out
