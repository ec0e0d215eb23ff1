"""Pooling, centroids and distances of style vectors."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penprint.functions import vectors as vx
from penprint.plans.keys import join_on


def mean_vector(df: DataFrame, group: list[str], vector: str, out: str) -> DataFrame:
    """Element-wise mean per group, with one running vector per group and task."""
    dense = df.select(*group, array_to_vector(vx.as_double(F.col(vector))).alias("__v"))
    return dense.groupBy(*group).agg(vector_to_array(Summarizer.mean(F.col("__v"))).alias(out))


def mean_pool(
    df: DataFrame, sentence: list[str], vector: str = "vector", keep: str | None = None, out: str = "pooled"
) -> DataFrame:
    """One vector per sentence: the mean of its token vectors.

    ``keep`` names a boolean column that marks real tokens; without it padding counts as well.
    """
    real = df.where(F.col(keep)) if keep else df
    return mean_vector(real, sentence, vector, out)


def l2_normalize(df: DataFrame, vector: str = "vector", out: str | None = None) -> DataFrame:
    return df.withColumn(out or vector, vx.unit(F.col(vector)))


def style_centroid(df: DataFrame, author: str = "author", vector: str = "vector") -> DataFrame:
    """``(author, style_vector)``: the mean of an author's unit vectors, itself not of unit length."""
    return mean_vector(l2_normalize(df, vector), [author], vector, "style_vector")


def user_style_vector(df: DataFrame, author: str = "author", vector: str = "vector") -> DataFrame:
    """The centroid scaled to unit length."""
    return l2_normalize(style_centroid(df, author, vector), "style_vector")


def style_distance(df: DataFrame, a: str, b: str, out: str = "e2") -> DataFrame:
    """One minus the cosine."""
    return df.withColumn(out, 1.0 - vx.cosine(F.col(a), F.col(b)))


def semantic_distance(df: DataFrame, a: str, b: str, out: str = "e3") -> DataFrame:
    """One minus the dot product of the unit vectors."""
    return df.withColumn(out, 1.0 - vx.dot(vx.unit(F.col(a)), vx.unit(F.col(b))))


def pick_author_vector(rows: DataFrame, vectors: DataFrame, key: str, row_id: str) -> DataFrame:
    """Give every row its author's vector. One author may own most of the rows: adaptive execution
    splits such a key's rows over tasks. ``row_id`` names the rows and is kept for callers."""
    return join_on(rows, vectors, [key], "left")
