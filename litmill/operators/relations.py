"""Joins, set operations and checks between stage tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def enrich(base: DataFrame, more: DataFrame, key: str, *, defaults: dict[str, object] | None = None, last_by: Sequence[Column] | None = None) -> DataFrame:
    """Left join by a key. With ``last_by``, of several matches the last in that order counts; missing values get defaults."""
    if last_by is not None:
        w = Window.partitionBy(key).orderBy(*(c.desc() for c in last_by))
        more = more.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")
    out = base.join(more, key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in (defaults or {}).items()})


def prefer(base: DataFrame, answer: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Field by field the answer's value, or the base's where there is none."""
    renamed = answer.select(key, *(F.col(f).alias(f"_{f}") for f in fields))
    joined = base.join(renamed, key, "left")
    return joined.withColumns({f: F.coalesce(F.col(f"_{f}"), F.col(f)) for f in fields}).drop(*(f"_{f}" for f in fields))


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """side, key: the keys of one side that the other lacks."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").select(F.lit("left").alias("side"), key).unionByName(b.join(a, key, "left_anti").select(F.lit("right").alias("side"), key))


def require_same_keys(expected: DataFrame, received: DataFrame, key: str) -> None:
    """Raises unless both sides hold the same keys."""
    odd = unmatched(expected, received, key).limit(5).collect()
    if odd:
        raise ValueError(f"keys differ: {[tuple(r) for r in odd]}")


def present(rows: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    return rows.join(cache.select(key).distinct(), key, "left_semi")


def absent(rows: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    return rows.join(cache.select(key).distinct(), key, "left_anti")


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows by column name; columns that a frame lacks are null in its rows."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def latest(rows: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The last row of each key in an order that ends in something unique."""
    w = Window.partitionBy(*keys).orderBy(*(c.desc() for c in order))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """Old and new rows, one for each key: a new one before old ones, the last of several."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, F.col("_new"), *order).drop("_new")


def pairs(rows: DataFrame, key: str, labels: str) -> DataFrame:
    """src, dst, weight: how many rows have both labels, smaller label first. ``labels`` is an array column."""
    sorted_ = F.array_sort(F.array_distinct(F.col(labels)))
    each = rows.select(sorted_.alias("l")).where(F.size("l") > 1)
    two = F.flatten(F.transform("l", lambda a, i: F.transform(F.slice("l", i + 2, F.size("l")), lambda b: F.struct(a.alias("src"), b.alias("dst")))))
    return each.select(F.explode(two).alias("x")).select("x.*").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def alignment(checks: Sequence[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """checkpoint, value, expected, status: numbers of rows that should be equal, each counted once."""
    out = None
    for name, actual, expected in checks:
        row = actual.agg(F.count("*").alias("value")).join(expected.agg(F.count("*").alias("expected")))
        row = row.select(F.lit(name).alias("checkpoint"), "value", "expected", F.when(F.col("value") == F.col("expected"), "aligned").otherwise("check").alias("status"))
        out = row if out is None else out.unionByName(row)
    return out


def project(df: DataFrame, columns: Sequence[tuple[str, str]]) -> DataFrame:
    """The named columns in their order and types; missing ones are null, others are dropped."""
    return df.select(*(F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in columns))


def reorder(df: DataFrame, first: Sequence[str]) -> DataFrame:
    """The wanted columns that exist, then the rest."""
    return df.select(*(c for c in first if c in df.columns), *(c for c in df.columns if c not in first))


def require(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
