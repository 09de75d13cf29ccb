"""Links among the rows of each class, for classes of any size.

A class that fits is searched in one task. A larger one is cut into blocks by hash; its head, the smallest id, is in every
block. When the blocks are searched, most rows of a class of near copies are joined to the head. Pairs of two such rows
need no look; every row that is left meets every block. So all pairs of a class are compared or joined already.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from litmill.llm._base import ROWS_A_FILE, materialise, small
from litmill.llm.components import components


def _upto(n: str) -> Column:
    return F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)


def class_links(rows: DataFrame, pairs: Callable[[list[np.ndarray]], Iterable[tuple[int, int]]], limit: int, a_file: int = ROWS_A_FILE) -> DataFrame:
    """rows: class, id, size, data (array<bigint>), written. Result: a, b, enough of the links to join what ``pairs`` links in a class.

    pairs: from the data of some rows to places of linked ones. limit: the sum of sizes that one search holds, about.
    """
    n, whole = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    # Only classes over the limit are cut, and there are no more of them than the limit goes into all sizes; so rows of a
    # common class are not brought together to learn of its size.
    sizes = rows.groupBy("class").agg(F.min("id").alias("head"), F.ceil(F.sum("size") / limit).alias("parts")).where("parts > 1")
    sizes = materialise(sizes, whole // limit)
    if sizes.isEmpty():
        return materialise(_search(rows.withColumn("cell", F.lit(0)), pairs), n, a_file)
    rows = rows.join(small(sizes), "class", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("bigint")))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), "parts"))
    is_head = F.col("id").eqNullSafe(F.col("head"))
    first = rows.select("class", "id", "data", F.explode(F.when(is_head, _upto("parts")).otherwise(F.array("block"))).alias("cell"))
    links = materialise(_search(first, pairs), n + whole // limit, a_file)
    large = rows.where("parts > 1")
    joined = components(links).withColumnRenamed("node", "id")
    large = materialise(large.join(joined, "id", "left").withColumn("label", F.coalesce("component", "id")), n, a_file)
    heads = large.where(is_head).select("class", F.col("label").alias("main")).distinct()
    large = large.join(small(heads), "class")
    rest = large.where("label <> main")
    left = materialise(rest.groupBy("class").agg(F.ceil(F.sum("size") / limit).alias("rests")), whole // limit)
    if left.isEmpty():
        return links
    left = small(left)
    here = large.join(left, "class").select("class", "id", "data", "block", F.explode(_upto("rests")).alias("rest"))
    there = rest.join(left, "class").select("class", "id", "data", F.explode(_upto("parts")).alias("block"), F.pmod(F.xxhash64("id", F.lit(1)), "rests").alias("rest"))
    return links.unionByName(materialise(_search(here.unionByName(there).withColumn("cell", F.struct("block", "rest")), pairs)))


def _search(dealt: DataFrame, pairs: Callable) -> DataFrame:
    dealt = dealt.select("class", "cell", "id", "data").repartition("class", "cell").sortWithinPartitions("class", "cell")
    kind = to_arrow_type(dealt.schema["id"].dataType)

    def run(batches):
        import pyarrow as pa

        key, ids, data = None, [], []

        def work():
            got = [(ids[x], ids[y]) for x, y in stars(pairs(data), ids)] if len(ids) > 1 else []
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c in zip(*got, strict=True)], names=["a", "b"])

        for batch in batches:
            column = batch.column(3)
            at, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            for i, (c, e, k) in enumerate(zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True)):
                if key is None or (c, e) != key:
                    yield from work()
                    key, ids, data = (c, e), [], []
                ids.append(k)
                data.append(flat[at[i] : at[i + 1]].copy())
        yield from work()

    kind_of = dict(dealt.dtypes)["id"]
    return dealt.mapInArrow(run, f"a {kind_of}, b {kind_of}")


def stars(links: Iterable[tuple[int, int]], ids: list) -> list[tuple[int, int]]:
    """Links from every place that ``links`` join to the place of the smallest id that it is joined to, which saves rounds later."""
    forest = Forest(len(ids))
    for x, y in links:
        forest.join(x, y)
    root, least = forest.roots().tolist(), {}
    for x, r in enumerate(root):
        if r not in least or ids[x] < ids[least[r]]:
            least[r] = x
    return [(x, least[r]) for x, r in enumerate(root) if least[r] != x]


class Forest:
    """Sets of places that are joined one by one."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def roots(self) -> np.ndarray:
        """The root of every place."""
        up = np.array(self.up)
        while not np.array_equal(above := up[up], up):
            up = above
        return up

    def join(self, x: int, y: int) -> bool:
        r, s = self.root(x), self.root(y)
        self.up[max(r, s)] = min(r, s)
        return r != s
