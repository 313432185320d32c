"""Gini and Lorenz without a single-task sort: equal values are added up first, prefix sums run over parts of the distinct values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grantmill.operators.ranking import before_parts, join_parts, with_parts


def _prefixes(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """The positive distinct values with _n (how often), _n0 and _v0: number and sum of the smaller values of the group."""
    v = df.where(F.col(value) > 0).groupBy(*by, value).agg(F.count("*").alias("_n")).withColumn("_nv", F.col("_n") * F.col(value))
    v = with_parts(v, F.col(value))
    w = Window.partitionBy(*by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    v = join_parts(v, before_parts(v, {"_n0": F.sum("_n"), "_v0": F.sum("_nv")}, by), by)
    return v.withColumns({"_n0": F.col("_n0") + F.coalesce(F.sum("_n").over(w), F.lit(0)), "_v0": F.col("_v0") + F.coalesce(F.sum("_nv").over(w), F.lit(0.0))})


def gini(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Gini of the positive values; 0 if there is none. Per group, a group with a single positive value gets null."""
    by = by or []
    v = _prefixes(df, value, by)
    v = v.withColumn("_ranks", F.col("_n") * F.col("_n0") + F.col("_n") * (F.col("_n") + 1) / 2)
    n, total = F.sum("_n"), F.sum("_nv")
    out = F.coalesce((2 * F.sum(F.col("_ranks") * F.col(value)) - (n + 1) * total) / (n * total), F.lit(0.0))
    return v.groupBy(*by).agg((F.when(n > 1, out) if by else out).alias("gini"), n.cast("long").alias("n"))


def lorenz(df: DataFrame, value: str) -> DataFrame:
    """Points (share of items, share of the sum), one per distinct value, from (0, 0)."""
    v = _prefixes(df, value, [])
    totals = df.where(F.col(value) > 0).agg(F.count("*").alias("_all"), F.sum(value).alias("_sum"))
    pts = v.join(F.broadcast(totals)).select(((F.col("_n0") + F.col("_n")) / F.col("_all")).alias("x"), ((F.col("_v0") + F.col("_nv")) / F.col("_sum")).alias("y"))
    return pts.union(df.sparkSession.createDataFrame([(0.0, 0.0)], "x double, y double"))
