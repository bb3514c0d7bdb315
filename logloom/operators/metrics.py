"""Figures over rows: area under the ROC curve, upper median, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """One row: positives, negatives and the area, ties counting half. Scores are counted first, so the window that ranks
    them sees a row for each distinct score and label total, not one for each row."""
    by = rows.where(F.col(label).isNotNull()).groupBy(score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = by.withColumn("won", F.col("p") * (below + F.col("n") / 2)).agg(F.coalesce(F.sum("p"), F.lit(0)).alias("positives"), F.coalesce(F.sum("n"), F.lit(0)).alias("negatives"), F.coalesce(F.sum("won"), F.lit(0.0)).alias("won"))
    return out.select("positives", "negatives", (F.col("won") / F.greatest(F.lit(1), F.col("positives") * F.col("negatives"))).alias("auc"))


def upper_median(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """group, median: the value at place n div 2 in ascending order. Distinct values are counted first."""
    by = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("k"))
    own = Window.partitionBy(*group)
    upto = F.sum("k").over(own.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return by.withColumns({"upto": upto, "n": F.sum("k").over(own)}).where(F.col("upto") > F.floor(F.col("n") / 2)).groupBy(*group).agg(F.min(value).alias("median"))


def agreement(a: Column, b: Column) -> Column:
    """The share of rows in which two decisions agree."""
    return F.avg((a == b).cast("int"))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(F.sum(a), F.sum(b))
