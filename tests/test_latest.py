"""The last row of a key by state: late and repeated batches, and keys that expire."""

import datetime as dt
import random

from pyspark.sql import functions as F

from litmill.operators.relations import latest as latest_of
from litmill.streaming import ingest, latest

SCHEMA = "k string, n bigint, v string, at timestamp"
START = dt.datetime(2024, 1, 1)


def run(spark, folder, target, state, within="365 days"):
    stream = ingest.arriving(spark, folder, SCHEMA)
    changes = latest.last_by_key(stream, ["k"], order="n", time="at", within=within, late="0 seconds" if within != "365 days" else "400 days")

    def put(batch, number):
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    changes.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def added(spark, folder, rows, name):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def test_late_and_repeated_batches_agree_with_the_latest_of_all(spark, tmp_path):
    rnd = random.Random(16)
    folder, target, state = (f"{tmp_path}/{x}" for x in ("in", "out", "state"))
    n = list(range(240))
    rnd.shuffle(n)
    rows = [(f"k{rnd.randrange(12)}", i, f"v{i}", START + dt.timedelta(hours=i)) for i in n]
    for b in range(4):
        part = rows[60 * b : 60 * b + 60]
        added(spark, folder, part, f"p{b}")
        added(spark, folder, part[:20], f"again{b}")
        run(spark, f"{folder}/*", target, state)
    want = latest_of(spark.createDataFrame(rows, SCHEMA), ["k"], F.col("n"))
    got = latest.merged(spark, target, ["k"])
    assert sorted(map(tuple, got.select("k", "n", "v").collect())) == sorted(map(tuple, want.select("k", "n", "v").collect()))
    changes = spark.read.parquet(target)
    assert changes.groupBy("k", "change").count().where("count > 1").count() == 0 and changes.count() < len(rows)


def test_keys_expire_and_begin_anew(spark, tmp_path):
    folder, target, state = (f"{tmp_path}/{x}" for x in ("in", "out", "state"))
    day = lambda n: START + dt.timedelta(days=n)
    for name, rows in (("a", [("x", 1, "one", day(0)), ("y", 1, "two", day(0)), ("z", None, "none", None)]), ("b", [("y", 2, "kept", day(4))]), ("c", [("w", 1, "later", day(9))]), ("d", [("w", 2, "still", day(10)), ("x", 0, "again", day(10))])):
        added(spark, folder, rows, name)
        run(spark, f"{folder}/*", target, state, within="5 days")
    got = {r["k"]: (r["v"], r["gone"]) for r in latest.merged(spark, target, ["k"], with_gone=True).collect()}
    assert got["x"] == ("again", False) and got["w"] == ("still", False) and got["y"] == ("kept", True) and "z" not in got
    assert latest.merged(spark, target, ["k"]).count() == 2
