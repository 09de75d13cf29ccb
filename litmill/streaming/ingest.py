"""Records that keep arriving: files are taken as they come, deduplicated by key and put into a table."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from litmill.functions import text as T
from litmill.operators.relations import latest
from litmill.sources.files import exists

#: The column that says which batch a row came with.
BATCH = "_batch"


def arriving(spark: SparkSession, folder: str, schema: str, kind: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).format(kind).load(folder)


def first_seen(records: DataFrame, *, time: str, within: str = "7 days") -> DataFrame:
    """A record a key; a key that comes again within the time is left out, and its state is dropped after it."""
    keyed = records.withColumn("dedupe_key", T.dedupe_key(F.col("doi"), F.col("title"), F.col("year")))
    return keyed.withWatermark(time, within).dropDuplicatesWithinWatermark(["dedupe_key"])


def windowed_counts(events: DataFrame, *, time: str, key: str, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by window and key; what comes later than ``late`` is left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), key).agg(F.count("*").alias("n"))


def keep_last(target: str, keys: list[str], order: str, stream: str):
    """A sink that adds each batch to a table, in which the last row of a key counts; current() reads it.

    A batch writes its own folder, named by stream and number, and no other rows: one that is run again writes the same.
    """

    def put(batch: DataFrame, number: int) -> None:
        latest(batch.withColumn(BATCH, F.lit(number).cast("bigint")), keys, F.col(order)).write.mode("overwrite").parquet(f"{target}/{stream}-{number}")

    return put


def run_upserts(records: DataFrame, target: str, keys: list[str], order: str, checkpoint: str) -> StreamingQuery:
    """Takes everything that is there in batches, then stops. Streams with other checkpoints add to the same table."""
    sink = keep_last(target, keys, order, hashlib.sha256(checkpoint.encode()).hexdigest()[:12])
    return records.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str, keys: list[str], order: str) -> DataFrame:
    """The table: a row a key, the greatest by order, and of equal ones that of the later batch."""
    return latest(_added(spark, target), keys, F.col(order), F.col(BATCH)).drop(BATCH)


def compact(spark: SparkSession, target: str, keys: list[str], order: str) -> None:
    """Puts all batches so far into one folder. A row is only taken away after it has been written again."""
    before = [p for p in _folders(spark, target)]
    made = f"{target}/all-{uuid.uuid4().hex}"
    latest(_added(spark, target), keys, F.col(order), F.col(BATCH)).write.parquet(made)
    path = spark._jvm.org.apache.hadoop.fs.Path
    for old in before:
        path(old).getFileSystem(spark._jsc.hadoopConfiguration()).delete(path(old), True)


def _added(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(*_folders(spark, target))


def _folders(spark: SparkSession, target: str) -> list[str]:
    """Those that were written to the end."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(str(s.getPath()) for s in system.listStatus(path(target)) if exists(spark, f"{s.getPath()}/_SUCCESS"))
