"""The last row of each key of a stream, kept as state, with keys that expire.

Batches may come late, twice or in any order: a row counts if its order is no less than that of the key's row so far, and only what
changes is passed on. A key that has had no row for ``within`` of event time, as the watermark sees it, is passed on as
gone and its state is dropped; a row that comes later still begins it anew. So the state holds one row for each key that is alive, in RocksDB on the
executors and in the checkpoint. merged() makes the table of what has been passed on.

Nulls: a null order is less than any other; rows without a time are left out, as they can't expire. Of rows with one order the later to
come counts.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from litmill.operators.relations import latest

#: The columns that say whether a key is gone, and the place of a change among those of its key.
GONE, CHANGE = "gone", "change"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Last(StatefulProcessor):
    def __init__(self, schema: StructType, order: str, time: str, within_ms: int):
        self.schema, self.order, self.time, self.within_ms = schema, order, time, within_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # The row, the place of its last change and when it expires.
        self.last = handle.getValueState("last", StructType([*self.schema.fields, StructField("_changes", LongType()), StructField("_until", LongType())]))

    def _better(self, row, now) -> bool:
        a, b = row[self.order], now[self.order]
        return b is None or (a is not None and a >= b)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        names = self.schema.names
        held = self.last.get()
        best = dict(zip([*names, "_changes", "_until"], held, strict=True)) if held is not None else None
        # A new key's changes are counted from the watermark, so that they come behind those before it was gone.
        changes, until = (best["_changes"], best["_until"]) if best else (max(0, timerValues.getCurrentWatermarkInMs()) + 1, 0)
        new, seen = best, until
        for row in rows:
            seen = max(seen, int(row[self.time].replace(tzinfo=datetime.UTC).timestamp() * 1000) + self.within_ms)
            if new is None or self._better(row, new):
                new = row.asDict()
        if seen != until:
            self.handle.registerTimer(seen)
        changed = best is None or any(new[n] != best[n] for n in names)
        if changed or seen != until:
            self.last.update((*(new[n] for n in names), changes + changed, seen))
        if changed:
            yield Row(**{n: new[n] for n in names}, **{GONE: False, CHANGE: changes + 1})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.last.get()
        if held is not None and held[-1] <= expiredTimerInfo.getExpiryTimeInMs():  # rows that came later have a timer of their own
            self.last.clear()
            yield Row(**dict(zip(self.schema.names, held, strict=False)), **{GONE: True, CHANGE: max(held[-2] + 1, timerValues.getCurrentWatermarkInMs())})

    def close(self) -> None:
        pass


def last_by_key(records: DataFrame, keys: list[str], *, order: str, time: str, within: str, late: str) -> DataFrame:
    """records: a stream. Result: its columns, gone, change: a row whenever the last row of a key changes, or the key is gone."""
    spark = records.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    ms = int(spark.range(1).select((F.unix_millis(F.timestamp_millis(F.lit(0)) + F.expr(f"INTERVAL {within}"))).alias("ms")).first()["ms"])
    schema = records.schema
    out = StructType([*schema.fields, StructField(GONE, BooleanType()), StructField(CHANGE, LongType())])
    rows = records.where(F.col(time).isNotNull()).withWatermark(time, late)
    return rows.groupBy(*keys).transformWithState(_Last(schema, order, time, ms), out, "Update", "EventTime")


def merged(spark: SparkSession, target: str, keys: list[str], *, with_gone: bool = False) -> DataFrame:
    """The table of the changes that were written to ``target``: a row a key, without those that are gone."""
    now = latest(spark.read.parquet(target), keys, F.col(CHANGE))
    return (now if with_gone else now.where(~F.col(GONE))).drop(CHANGE, *([] if with_gone else [GONE]))
