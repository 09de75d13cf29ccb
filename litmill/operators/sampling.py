"""Samples of an exact size that a seed fixes, on any cluster."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def size(total: int, share: float = 0.2, most: int = 50, *, up: bool = True) -> int:
    """A share of all rows, rounded up or down, one at least and ``most`` at most; 0 of none."""
    return 0 if total <= 0 else min(most, max(1, math.ceil(total * share) if up else int(total * share)))


def sample(df: DataFrame, n: int, seed: int, key: str = "record_id") -> DataFrame:
    """n rows, or all if there are fewer: those whose keys hash lowest with the seed. Each task keeps n rows at most."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key).cast("string")), F.col(key)).limit(n)


def share_sample(df: DataFrame, seed: int, *, share: float = 0.2, most: int = 50, up: bool = True, key: str = "record_id") -> DataFrame:
    return sample(df, size(df.count(), share, most, up=up), seed, key)


def blank_form(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds empty columns for people to fill in."""
    return df.withColumns({c: F.lit("") for c in columns})
