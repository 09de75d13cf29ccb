"""Frames that are written once, so that what is read from them twice is the same and needs no lost executor's work."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors share: the one the cluster names, or in local mode a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = _own_folder()
    return named


@functools.cache
def _own_folder() -> str:
    """One for the process, which goes with it."""
    import atexit
    import shutil
    import tempfile

    made = tempfile.mkdtemp(prefix="litmill-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return made


def settled(df: DataFrame) -> DataFrame:
    """The frame as a Parquet table of the shared folder. Each task runs once, unless it is lost before it has written."""
    path = f"{folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, buckets: int, *by: str) -> DataFrame:
    """The same in buckets of a key: grouped by the key, or joined by it with a frame that moves, its rows stay where they are."""
    spark, name = df.sparkSession, f"settled_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, *by).saveAsTable(name, format="parquet", path=f"{folder(spark)}/{name}")
    found = spark.table(name)
    spark.sql(f"drop table {name}")  # only its name goes, the files are in a folder of their own
    return found
