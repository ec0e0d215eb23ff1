"""Batches, Gaussian style heads and their losses."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penprint.functions import vectors as vx
from penprint.plans.keys import join_on

BATCH = 12


def pad_sequences(df: DataFrame, batch: str = "batch", items: str = "prefix_ids", row_id: str = "row_id") -> DataFrame:
    """Right-pad each array with zeros to the longest of its batch."""
    longest = F.max(F.size(items)).over(Window.partitionBy(batch))  # a batch is a few rows
    sized = df.withColumn("__longest", longest)
    return sized.withColumn(items, vx.pad_right(F.col(items).cast("array<bigint>"), F.col("__longest"))).drop("__longest")


def shuffle_batches(df: DataFrame, key: Column, row_id: str, size: int = BATCH, bits: int = 31, bucket_bits: int = 10) -> DataFrame:
    """Number the rows in the order of a random key and cut them into full batches.

    ``key`` is an integer below ``2**bits``. Rows are ranked inside the buckets of its leading bits
    and only the bucket sizes are summed in one place, so there is no global sort.
    """
    keyed = df.withColumn("__key", key).withColumn("__bucket", F.shiftright("__key", bits - bucket_bits))
    inside = Window.partitionBy("__bucket").orderBy("__key", row_id)
    sizes = keyed.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__bucket", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    ranked = join_on(keyed.withColumn("__rank", F.row_number().over(inside)), starts, ["__bucket"])
    place = F.col("__start") + F.col("__rank") - 1
    return ranked.withColumn("place", place).withColumn("batch", F.expr(f"place div {size}")).drop(
        "__key", "__bucket", "__rank", "__start"
    )


def fit_author_gaussian(df: DataFrame, author: str = "author", vector: str = "vector") -> DataFrame:
    """``(author, n, mu, sigma)``: mean and population deviation per dimension."""
    dense = df.select(author, array_to_vector(vx.as_double(F.col(vector))).alias("__v"))
    stats = dense.groupBy(author).agg(
        Summarizer.metrics("count", "mean", "variance").summary(F.col("__v")).alias("s")
    )
    n = F.col("n")
    spread = F.transform(F.col("variance"), lambda v: F.sqrt(v * (n - 1) / n))
    return stats.select(
        author,
        F.col("s.count").alias("n"),
        vector_to_array("s.mean").alias("mu"),
        vector_to_array("s.variance").alias("variance"),
    ).select(author, "n", "mu", spread.alias("sigma"))


def _moments(features: str, target: str, means: tuple[np.ndarray, np.ndarray]):
    """Per batch of rows, the sums of products that least squares needs, one row per matrix line.

    Columns are centred first: sums of products of large numbers that differ little would cancel.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = np.stack(batch.column(features).to_numpy(zero_copy_only=False)).astype(float)
            y = np.stack(batch.column(target).to_numpy(zero_copy_only=False)).astype(float)
            x, y = x - means[0], y - means[1]
            x = np.hstack([x, np.ones((len(x), 1))])
            full = np.vstack([x.T @ np.hstack([x, y]), np.hstack([y.sum(0) * 0, np.zeros(x.shape[1])])[None, :]])
            full[-1, : y.shape[1]] = (y * y).sum(0)
            total = full if total is None else total + full
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))],
                ["line", "sums"],
            )

    return partial


def fit_linear_gaussian(df: DataFrame, features: str = "features", target: str = "target", ridge: float = 1e-6) -> DataFrame:
    """Least-squares mean head with a constant deviation per output dimension.

    One row per output dimension: ``(dim, weights, bias, sigma)``. Each task boils its rows down to
    a matrix whose size depends on the dimensions only; those are added per matrix line on the
    executors. What reaches the driver is one such matrix, and one small solve.
    """
    vectors = df.select(*[array_to_vector(vx.as_double(F.col(c))).alias(c) for c in (features, target)])
    mean = vectors.agg(Summarizer.mean(F.col(features)).alias("x"), Summarizer.mean(F.col(target)).alias("y")).first()
    means = (mean["x"].toArray(), mean["y"].toArray())
    partials = df.select(features, target).mapInArrow(_moments(features, target, means), "line int, sums array<double>")
    dense = partials.select("line", array_to_vector("sums").alias("v"))
    lines = dense.groupBy("line").agg(vector_to_array(Summarizer.sum(F.col("v"))).alias("sums"))
    matrix = np.array([r["sums"] for r in lines.orderBy("line").collect()])
    d = len(matrix) - 1
    k = matrix.shape[1] - d
    gram, cross, squares = matrix[:d, :d], matrix[:d, d:], matrix[d, :k]
    n = gram[-1, -1]
    weights = np.linalg.solve(gram + ridge * np.eye(d), cross)
    residual = squares - 2 * (weights * cross).sum(0) + (weights * (gram @ weights)).sum(0)
    sigma = np.sqrt(np.maximum(residual / n, 0.0))
    bias = weights[-1] + means[1] - means[0] @ weights[:-1]
    rows = [(j, weights[:-1, j].tolist(), float(bias[j]), float(sigma[j])) for j in range(k)]
    return df.sparkSession.createDataFrame(rows, "dim int, weights array<double>, bias double, sigma double")


def apply_linear_gaussian(df: DataFrame, head: DataFrame, features: str = "features") -> DataFrame:
    """Add ``mu`` and ``sigma``. The head has one row per dimension and travels with the task."""
    rows = head.orderBy("dim").collect()
    weights = np.array([r["weights"] for r in rows]).T
    bias = np.array([r["bias"] for r in rows])

    @F.pandas_udf("array<double>")
    def mean_head(x: pd.Series) -> pd.Series:
        if x.empty:
            return pd.Series([], dtype=object)
        return pd.Series(list(np.stack(x.to_numpy()).astype(float) @ weights + bias))

    sigma = F.array(*[F.lit(r["sigma"]) for r in rows])
    return df.withColumns({"mu": mean_head(F.col(features)), "sigma": sigma})


def gaussian_nll(df: DataFrame, target: str = "target", mu: str = "mu", sigma: str = "sigma", out: str = "nll") -> DataFrame:
    return df.withColumn(out, vx.gaussian_nll(F.col(target), F.col(mu), F.col(sigma)))


def gaussian_logprob(df: DataFrame, target: str = "target", mu: str = "mu", sigma: str = "sigma", out: str = "e1") -> DataFrame:
    return df.withColumn(out, vx.neg_log_density(F.col(target), F.col(mu), F.col(sigma)))


def mean_nll(df: DataFrame, group: str = "author", nll: str = "nll") -> DataFrame:
    return df.groupBy(group).agg(F.avg(nll).alias("mean_nll"), F.count(F.lit(1)).alias("n"))
