"""Deduplication of records by DOI, or else by title and year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litmill.functions import text as T
from litmill.operators.settled import settled

#: Records of one key that one task ranks; beyond it the key's records are ranked in ranges.
ONE_TASK = 1_000_000


def rank_duplicates(records: DataFrame, *tie_break: Column) -> DataFrame:
    """Adds norm_doi, norm_title, dedupe_key, duplicate_rank and is_duplicate. Ranks go by database, query and the tie-break."""

    def col(c: str) -> Column:
        return F.col(c) if c in records.columns else F.lit(None).cast("string")

    keyed = records.withColumns({"norm_doi": T.normal_doi(col("doi")), "norm_title": T.normal_title(col("title")), "dedupe_key": T.dedupe_key(col("doi"), col("title"), col("year"))})
    order = [*(F.col(c) for c in ("database", "query_key") if c in records.columns), *(tie_break or [F.col("record_id")])]
    return ranked(keyed, "dedupe_key", "duplicate_rank", order).withColumn("is_duplicate", F.col("duplicate_rank") > 1)


def ranked(rows: DataFrame, key: str, name: str, order: list[Column], one_task: int = ONE_TASK) -> DataFrame:
    """A running number within each key.

    Keys of over ``one_task`` rows, such as that of all records with neither DOI nor title, are range-partitioned by the
    order; each range of a key starts at the key's rows before it. Both ways give the same numbers.
    """
    # Hashes are counted, which are short; a key that shares a heavy one's is ranked as one, with the same result.
    heavy = settled(rows.groupBy(F.xxhash64(key).alias("_heavy")).agg(F.count("*").alias("_n")).where(F.col("_n") > one_task).select("_heavy"))
    is_heavy = F.xxhash64(key) == F.col("_heavy")
    w = Window.partitionBy(key)
    if heavy.isEmpty():
        return rows.withColumn(name, F.row_number().over(w.orderBy(*order)))
    # At most a heavy key for every ``one_task`` rows, so a few even of billions.
    light = rows.join(F.broadcast(heavy), is_heavy, "left_anti").withColumn(name, F.row_number().over(w.orderBy(*order)))
    placed = settled(rows.join(F.broadcast(heavy), is_heavy, "left_semi").repartitionByRange(F.col(key), *order).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy(key, "_part").agg(F.count("*").alias("_size"))
    before = sizes.select(key, "_part", (F.sum("_size").over(w.orderBy("_part")) - F.col("_size")).alias("_before"))
    within = F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order))
    spread = placed.withColumn(name, within).join(before, [key, "_part"]).withColumn(name, (F.col(name) + F.col("_before")).cast("int"))
    return light.unionByName(spread.select(*light.columns))


def deduplicate(records: DataFrame, *tie_break: Column) -> DataFrame:
    return rank_duplicates(records, *tie_break).where(~F.col("is_duplicate"))


def audit(ranked: DataFrame) -> DataFrame:
    return ranked.agg(F.count("*").alias("combined_records"), F.count_if(~F.col("is_duplicate")).alias("deduplicated_records"), F.count_if("is_duplicate").alias("duplicates_removed"))
