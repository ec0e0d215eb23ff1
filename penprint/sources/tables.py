"""Readers and writers for posts, style vectors, prefixes and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from penprint.functions import text as tx
from penprint.functions import vectors as vx

POSTS_SCHEMA = T.StructType(
    [
        T.StructField("blogger_id", T.StringType()),
        T.StructField("gender", T.StringType()),
        T.StructField("age", T.IntegerType()),
        T.StructField("industry", T.StringType()),
        T.StructField("zodiac", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)


def scan_posts_csv(spark: SparkSession, path: str) -> DataFrame:
    """Posts without a header line; the columns are named by place and quoted text may hold newlines."""
    return (
        spark.read.schema(POSTS_SCHEMA)
        .option("header", False)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows out evenly if the input comes in fewer pieces than there are cores.

    Text work is bound by the processor, and one small file would run on one core. An input that
    is already in many pieces is left as it is, so large data is never moved by this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """Stripped non-empty lines of text files, as ``line``."""
    line = tx.strip(F.col("value"))
    return spark.read.text(path).select(line.alias("line")).where(F.col("line") != "")


def sink_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def sink_profile_json(profile: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per profile; arrays and structs stay nested."""
    profile.write.mode(mode).json(path)


def preview(df: DataFrame) -> DataFrame:
    """One row per column: name, type, number of rows, nulls, and mean size for arrays and strings."""
    rows = []
    measures: list[Column] = [F.count(F.lit(1)).alias("__rows")]
    for i, field in enumerate(df.schema.fields):
        col = F.col(f"`{field.name}`")
        kind = field.dataType.simpleString()
        measures.append(F.count(F.when(col.isNull(), 1)).alias(f"__nulls{i}"))
        if kind.startswith("array"):
            size = F.sum(F.size(col).cast("bigint"))
        elif kind == "string":
            size = F.sum(F.length(col).cast("bigint"))
        else:
            size = F.lit(None).cast("bigint")
        measures.append(size.alias(f"__size{i}"))
        rows.append(
            F.struct(
                F.lit(i).cast("bigint").alias("place"),
                F.lit(field.name).alias("column"),
                F.lit(kind).alias("type"),
                F.col("__rows").alias("rows"),
                F.col(f"__nulls{i}").alias("nulls"),
                F.col(f"__size{i}").alias("total_size"),
            )
        )
    return df.agg(*measures).select(F.inline(F.array(*rows)))


def decode_prefix_json(df: DataFrame, prefix: str = "prefix_ids") -> DataFrame:
    """Integer arrays from JSON text, JSON bytes or arrays."""
    kind = df.schema[prefix].dataType
    if isinstance(kind, T.ArrayType):
        decoded = F.col(prefix).cast("array<bigint>")
    else:
        decoded = F.from_json(F.col(prefix).cast("string"), "array<bigint>")
    return df.withColumn(prefix, decoded)


def coerce_float_vector(df: DataFrame, vector: str = "style_vector") -> DataFrame:
    return df.withColumn(vector, vx.as_double(F.col(vector)))


def coerce_id_string(df: DataFrame, key: str = "author_id") -> DataFrame:
    return df.withColumn(key, F.col(key).cast("string"))
