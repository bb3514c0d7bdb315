"""Vectors as arrays of floats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    size = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x / F.when(size == 0, 1.0).otherwise(size))


def cosine(a: Column, b: Column) -> Column:
    """The product of the normalised vectors."""
    return dot(normalised(a), normalised(b))


def mean_vector(rows: DataFrame, vector: str) -> DataFrame:
    """One row: mean, the mean of each component."""
    parts = rows.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("m")).select(F.col("m.x").alias("mean"))


def centred_scores(rows: DataFrame, vector: str, query: list[float]) -> DataFrame:
    """rows with score: the product of vector and query, each less the mean of all; neither is normalised again."""
    mean = mean_vector(rows, vector).first().mean
    less = F.lit([q - m for q, m in zip(query, mean)])
    return rows.withColumn("score", dot(F.zip_with(F.col(vector), F.lit(mean), lambda x, m: x.cast("double") - m), less))
