"""Small helpers that several operators share."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rules: the space and 0x09 to 0x0D.
SPACES = " \t\n\x0b\x0c\r"
#: Rows, and bytes of their texts and lists, that a Python stage takes at a time; a row that is longer goes alone.
ROWS_AT_ONCE, BYTES_AT_ONCE = 256, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(df: DataFrame, schema: str, start: Callable[[], Callable[..., Iterable[tuple]]]) -> DataFrame:
    """Run ``start()`` once a task and the function it returns on every row; that one yields result rows.

    Rows go through Arrow in slices, so what a task holds beside Spark's batch is bounded by a slice, or by one long row.
    """
    out = pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in _struct(schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = start()
        for batch in batches:
            for part in slices(batch):
                got = [y for x in zip(*(c.to_pylist() for c in part.columns), strict=True) for y in row(*x)]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got, strict=True), out, strict=True)], schema=out)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, rows: int = ROWS_AT_ONCE, size: int = BYTES_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The batch in parts of ``rows`` rows at most, whose strings have ``size`` bytes at most, or of one row."""
    lengths = [pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False) for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type)]
    ends = sum(lengths).cumsum() if lengths else np.zeros(batch.num_rows, np.int64)
    at = 0
    while at < batch.num_rows:
        gone = ends[at - 1] if at else 0
        stop = max(at + 1, min(at + rows, int(np.searchsorted(ends, gone + size, "right"))))
        yield batch.slice(at, stop - at)
        at = stop


def _struct(schema: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema)


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


#: Rows to a file, of a few numbers each, and documents to a task that reads or makes them.
ROWS_A_FILE, DOCS_A_FILE = 100_000, 20_000


def _few_files(df: DataFrame, most: int | None, a_file: int) -> DataFrame:
    return df if most is None else df.coalesce(max(1 + most // a_file, df.sparkSession.sparkContext.defaultParallelism))


def materialise(df: DataFrame, most: int | None = None, a_file: int = ROWS_A_FILE) -> DataFrame:
    """Write a frame once to the shared checkpoint folder and read on from there, so that later jobs neither repeat it nor need its executors.

    most: a bound of its rows, or of what they are made of, if there is one; then it goes to no more files, and comes from
    no more tasks, than they need at ``a_file`` each, or than there are cores. Small files cost a process each.
    """
    session = df.sparkSession
    if session.sparkContext.getCheckpointDir() is None:
        session.sparkContext.setCheckpointDir(shared_folder(session))
    return _few_files(df, most, a_file).checkpoint(eager=True)


def written(df: DataFrame, most: int | None = None, a_file: int = ROWS_A_FILE) -> DataFrame:
    """As materialise(), but as a Parquet table, which is smaller where columns repeat themselves or few of them are read again."""
    path = f"{shared_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    _few_files(df, most, a_file).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a few numbers or short names that are sent to every executor at most.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The written frame, marked to be sent to every executor if it has ``most`` rows or fewer; joins shuffle it otherwise."""
    return F.broadcast(df) if df.count() <= most else df


def fold(column: str, parts: int):
    """crc32 of the column as text, modulo ``parts``: the folds that the contracts name."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors share: the one the cluster names, or in local mode a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _own_folder()
    return folder


@functools.cache
def _own_folder() -> str:
    """One for the process, which goes with it."""
    import atexit
    import shutil
    import tempfile

    made = tempfile.mkdtemp(prefix="litmill-shared-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return made


class Remember(dict):
    """Key to a value that is worked out once while it is remembered.

    Holds up to twice ``limit`` keys: when ``limit`` new ones have come, those used since the last time are kept and the
    others go. ``keep`` says which keys are remembered.
    """

    def __init__(self, work: Callable, limit: int, keep: Callable = lambda key: True):
        super().__init__()
        self.work, self.limit, self.keep, self.old = work, limit, keep, {}

    def __missing__(self, key):
        value = self.old.get(key, self)
        if value is self:
            value = self.work(key)
            if not self.keep(key):
                return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
