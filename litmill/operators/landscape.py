"""Maps of vectors: scaled, reduced to principal components (of dense or of sparse vectors), and densities over a grid."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmill.operators.settled import settled


def scaled(df: DataFrame, vector: str, out: str = "scaled") -> DataFrame:
    """Each component with mean 0 and population deviation 1; components that don't vary are 0."""
    v = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    n = df.count()
    model = StandardScaler(inputCol="_v", outputCol="_s", withMean=True, withStd=True).fit(v)
    # The scaler divides by the sample deviation.
    factor = math.sqrt(n / (n - 1)) if n > 1 else 1.0
    return model.transform(v).withColumn(out, F.transform(vector_to_array("_s"), lambda x: x * factor)).drop("_v", "_s")


def dimensions(n: int, d: int, most: int = 36) -> int:
    return max(2, min(most, n - 1, d))


def components(df: DataFrame, vector: str, k: int, out: str = "pca") -> tuple[DataFrame, list[float]]:
    """The first k principal components (signs are arbitrary) and the shares of variance they explain."""
    v = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(v)
    return model.transform(v).withColumn(out, vector_to_array("_p")).drop("_v", "_p"), [float(x) for x in model.explainedVariance]


def coordinates(df: DataFrame, vector: str, k: int = 2) -> DataFrame:
    """Adds pca_x and pca_y of the scaled vectors."""
    made, _ = components(scaled(df, vector), "scaled", k)
    return made.withColumns({"pca_x": F.col("pca")[0], "pca_y": F.col("pca")[1]}).drop("scaled", "pca")


def density(points: DataFrame, x: Column, y: Column, *, low: float, high: float, steps: int = 40, bandwidth: float = 0.3) -> DataFrame:
    """gx, gy, density: a Gaussian kernel over a grid of fixed size, of all points; those without a coordinate are left out.

    Each task multiplies its points' kernels along x by those along y, some points at a time, and passes on a grid's sums.
    """
    at = low + np.arange(steps) * ((high - low) / max(steps - 1, 1))

    def run(batches):
        total, n = np.zeros((steps, steps)), 0
        for b in batches:
            for first in range(0, b.num_rows, 8192):
                part = b.slice(first, 8192)
                kernels = [np.exp(-(((c.to_numpy(zero_copy_only=False)[:, None] - at) / bandwidth) ** 2) / 2) for c in part.columns]
                total += kernels[0].T @ kernels[1]
                n += part.num_rows
        gx, gy = np.repeat(at, steps), np.tile(at, steps)
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (gx, gy, total.ravel(), np.full(steps * steps, n))], names=["gx", "gy", "s", "n"])

    held = points.select(x.cast("double").alias("x"), y.cast("double").alias("y")).where("x is not null and y is not null")
    summed = held.mapInArrow(run, "gx double, gy double, s double, n bigint").groupBy("gx", "gy").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).where("n > 0")
    return summed.select("gx", "gy", (F.col("s") / F.col("n") / (2 * math.pi * bandwidth * bandwidth)).alias("density"))


#: Cells to a deviation of the kernel, and deviations beyond which a point adds nothing to a grid.
CELLS, BEYOND = 16, 9.0
#: Groups whose covariances are sent to every executor.
BROADCAST_GROUPS = 100_000


def kde(points: DataFrame, x: Column, y: Column, *, factor: float, xs: tuple[float, float, int], ys: tuple[float, float, int], by: tuple[str, ...] = (), least: int = 6) -> DataFrame:
    """by, gx, gy, density over a grid: Gaussian kernels with the covariance of the points, of each group, times ``factor`` squared.

    Points are dealt to the four cells around them, in proportion. Cells have a 16th of a deviation of the kernel, which is made
    as much narrower as that widens it. After y is sheared so that the two don't vary together, cells are
    summed along x to the grid's columns and then along y. So the work is that of the points and of a fixed number of cells.

    xs, ys: of the grid's lines the first, the last and their number. Groups of fewer than ``least`` points, or on one line,
    are left out. Nulls: points without a coordinate are left out; a null group is a group.
    """
    rows = points.select(*by, x.cast("double").alias("x"), y.cast("double").alias("y")).where("x is not null and y is not null")
    f2 = F.lit(factor * factor)
    of = rows.groupBy(*by).agg(F.count("*").alias("n"), (F.var_samp("x") * f2).alias("a"), (F.covar_samp("x", "y") * f2).alias("b"), (F.var_samp("y") * f2).alias("c"))
    of = of.where((F.col("n") >= least) & (F.col("a") > 0) & (F.col("a") * F.col("c") - F.col("b") * F.col("b") > F.col("a") * F.col("c") * 1e-12))
    of = of.withColumns({"shear": F.col("b") / F.col("a"), "c": F.col("c") - F.col("b") * F.col("b") / F.col("a")})
    of = of.withColumns({"dx": F.sqrt("a") / CELLS, "dy": F.sqrt("c") / CELLS})
    of = settled(of.select(*(F.col(g).alias(f"of_{g}") for g in by), "n", "shear", "dx", "dy", (F.col("a") - F.col("dx") * F.col("dx") / 6).alias("a"), (F.col("c") - F.col("dy") * F.col("dy") / 6).alias("c")))
    of = F.broadcast(of) if not by or of.count() <= BROADCAST_GROUPS else of

    def joined(df: DataFrame) -> DataFrame:
        same = F.lit(True)
        for g in by:
            same = same & F.col(g).eqNullSafe(F.col(f"of_{g}"))
        return df.join(of, same).drop(*(f"of_{g}" for g in by))

    tilt = [F.lit(v) - F.col("shear") * F.lit(u) for u in xs[:2] for v in ys[:2]]
    held = joined(rows).withColumn("y", F.col("y") - F.col("shear") * F.col("x")).where(
        F.col("x").between(F.lit(xs[0]) - BEYOND * CELLS * F.col("dx"), F.lit(xs[1]) + BEYOND * CELLS * F.col("dx"))
        & F.col("y").between(F.least(*tilt) - BEYOND * CELLS * F.col("dy"), F.greatest(*tilt) + BEYOND * CELLS * F.col("dy"))
    )
    held = held.withColumns({"u": F.col("x") / F.col("dx"), "v": F.col("y") / F.col("dy")})
    held = held.withColumns({"cx": F.floor("u"), "cy": F.floor("v"), "u": F.col("u") - F.floor("u"), "v": F.col("v") - F.floor("v")})
    corner = lambda i, j: F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy"), ((F.col("u") if i else 1 - F.col("u")) * (F.col("v") if j else 1 - F.col("v"))).alias("w"))
    cells = held.select(*by, F.explode(F.array(*(corner(i, j) for i in (0, 1) for j in (0, 1)))).alias("k")).groupBy(*by, "k.cx", "k.cy").agg(F.sum("k.w").alias("w"))

    def line(low: float, high: float, steps: int) -> Column:
        return F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.lit(low) + i * F.lit((high - low) / max(steps - 1, 1))))

    across = joined(cells).withColumn("gx", line(*xs))
    off = F.col("gx") - F.col("cx") * F.col("dx")
    columns = across.groupBy(*by, "gx", "cy").agg(F.sum(F.col("w") * F.exp(-off * off / (2 * F.col("a")))).alias("w"))
    up = joined(columns).withColumn("gy", line(*ys))
    off = F.col("gy") - F.col("shear") * F.col("gx") - F.col("cy") * F.col("dy")
    height = F.col("w") * F.exp(-off * off / (2 * F.col("c"))) / (F.col("n") * 2 * math.pi * F.sqrt(F.col("a") * F.col("c")))
    return up.groupBy(*by, "gx", "gy").agg(F.sum(height).alias("density"))


def _signs(term: Column, count: int, seed: int) -> list[Column]:
    """Of each term ``count`` random signs, by its hash."""
    words = [F.xxhash64(term, F.lit(seed + w)) for w in range(-(-count // 64))]
    return [1 - 2 * F.shiftrightunsigned(words[i // 64], i % 64).bitwiseAND(F.lit(1).cast("bigint")).cast("double") for i in range(count)]


def _moments(vectors: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums, sums of products and number of the rows' vectors ``v``: a table of a few hundred numbers, summed in each task first."""

    def run(batches):
        total = np.zeros((width + 1, width + 1))
        for b in batches:
            v = np.ones((b.num_rows, width + 1))
            v[:, :width] = np.array(b.column(0).to_pylist(), np.float64).reshape(b.num_rows, width)
            total += v.T @ v
        at = np.arange(total.size)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel())], names=["at", "s"])

    found = vectors.select("v").mapInArrow(run, "at bigint, s double").groupBy("at").agg(F.sum("s").alias("s")).collect()
    total = np.zeros((width + 1) ** 2)
    for r in found:
        total[r["at"]] = r["s"]
    total = total.reshape(width + 1, width + 1)
    return total[width, :width], total[:width, :width], round(total[width, width])


def _turned(vectors: DataFrame, key: str, mean: np.ndarray, turn: np.ndarray) -> DataFrame:
    """key, v: each vector less the mean, times a small matrix."""

    def run(batches):
        for b in batches:
            v = np.array(b.column(1).to_pylist(), np.float64).reshape(b.num_rows, len(mean))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list((v - mean) @ turn), pa.list_(pa.float64()))], names=[key, "v"])

    return vectors.select(key, "v").mapInArrow(run, f"{key} {dict(vectors.dtypes)[key]}, v array<double>")


def _orthonormal(products: np.ndarray) -> np.ndarray:
    """The matrix that makes columns with these products orthonormal; those that depend on others go."""
    values, vectors = np.linalg.eigh(products)
    kept = values > max(values.max(), 0.0) * 1e-13
    return vectors[:, kept] / np.sqrt(values[kept])


def sparse_components(weights: DataFrame, k: int, *, row: str, term: str, weight: str = "weight", center: bool = False, passes: int = 6, extra: int = 16, seed: int = 42) -> tuple[DataFrame, list[float]]:
    """row, coordinates (array of k, signs are arbitrary) of vectors given by their non-zero weights, and the k singular values.

    A randomised range finder: the vectors are multiplied by ``k + extra`` columns of random signs, and then by their own
    transpose and themselves ``passes`` times; each product is a join by term or row and a sum, and only matrices of that many rows and columns come
    to the driver. ``center`` takes the mean vector off without filling in zeros. Rows without weights are left out; repeated ones add up.
    """
    a = settled(weights.select(F.col(row).alias("row"), F.col(term).alias("term"), F.col(weight).cast("double").alias("w")).where("w is not null and w <> 0"))
    width = k + extra

    def sums(joined: DataFrame, key: str, n: int) -> DataFrame:
        parts = [F.sum(F.col("w") * F.col("v")[i]).alias(f"s{i}") for i in range(n)]
        return joined.groupBy(key).agg(*parts).select(key, F.array(*(f"s{i}" for i in range(n))).alias("v"))

    y = a.groupBy("row").agg(*(F.sum(F.col("w") * s).alias(f"s{i}") for i, s in enumerate(_signs(F.col("term"), width, seed))))
    y = settled(y.select("row", F.array(*(f"s{i}" for i in range(width))).alias("v")))
    for last in [*[False] * passes, True]:
        total, products, n = _moments(y, width)
        if not n:
            return a.select(F.col("row").alias(row), F.array().cast("array<double>").alias("coordinates")), []
        mean = total / n if center else np.zeros(width)
        turn = _orthonormal(products - n * np.outer(mean, mean))
        q = settled(_turned(y, "row", mean, turn))
        z = settled(sums(a.join(q, "row"), "term", turn.shape[1]))  # the columns of q sum to 0 if centred
        _, products, _ = _moments(z, turn.shape[1])
        if last:
            values, vectors = np.linalg.eigh(products)
            best = np.argsort(-values)[:k]
            sizes = np.sqrt(np.maximum(values[best], 0.0))
            made = _turned(q, "row", np.zeros(turn.shape[1]), vectors[:, best] * sizes)
            return made.select(F.col("row").alias(row), F.col("v").alias("coordinates")), sizes.tolist()
        turn = _orthonormal(products)
        width = turn.shape[1]
        y = settled(sums(a.join(_turned(z, "term", np.zeros(len(products)), turn), "term"), "row", width))
