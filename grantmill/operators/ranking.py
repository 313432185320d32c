"""Global row numbers and running sums in parts of about equal size: no task holds the whole table.

A double that rises with the order cuts the rows at its approximate quantiles. The parts' totals, one row a part, are summed up
and added to what each part finds by itself, so the result is exact wherever the cuts lie.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INF = float("inf")
MAX_PARTS = 10_000


def with_parts(df: DataFrame, coarse: Column, name: str = "_part", parts: int | None = None) -> DataFrame:
    """df with the number of the row's part, rising with `coarse`; null and NaN come first, equal values share a part."""
    parts = min(parts or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), MAX_PARTS)
    value = coarse.cast("double")
    value = F.when(value.isNull() | F.isnan(value), F.lit(-INF)).otherwise(value)
    shares = [i / parts for i in range(1, parts)] or [0.5]
    cuts = df.agg(F.percentile_approx(value, shares, 10 * parts).alias("c")).first().c  # at most MAX_PARTS doubles
    inner = sorted({c for c in cuts or [] if -INF < c < INF}) or [0.0]
    marked = Bucketizer(splits=[-INF, *inner, INF], inputCol="_coarse", outputCol=name).transform(df.withColumn("_coarse", value))
    return marked.withColumn(name, F.col(name).cast("int")).drop("_coarse")


def before_parts(df: DataFrame, sums: dict[str, Column], by: list[str] | None = None, part: str = "_part") -> DataFrame:
    """by, part and, for each of the sums, its total over the earlier parts of the group."""
    by = by or []
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*by, part).agg(*[v.alias(k) for k, v in sums.items()])
    return totals.select(*by, part, *[F.coalesce(F.sum(k).over(w), F.lit(0)).alias(k) for k in sums])


def join_parts(df: DataFrame, offsets: DataFrame, by: list[str] | None = None, part: str = "_part") -> DataFrame:
    """df with the offsets of its part; null groups match. Without groups there are at most MAX_PARTS offsets, which are broadcast."""
    by = by or []
    other = offsets.withColumnsRenamed({c: f"_o_{c}" for c in [*by, part]})
    on = other[f"_o_{part}"] == df[part]
    for c in by:
        on = on & other[f"_o_{c}"].eqNullSafe(df[c])
    return df.join(other if by else F.broadcast(other), on).drop(*[f"_o_{c}" for c in [*by, part]])


def row_numbers(df: DataFrame, order: list[Column | str], coarse: Column, name: str, by: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """df with the row's number from 1, in the whole table or in its group. `order` must be unique and `coarse` rise with it."""
    by = by or []
    marked = with_parts(df, coarse, parts=parts)
    offsets = before_parts(marked, {"_before": F.count("*")}, by)
    place = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))
    return join_parts(marked, offsets, by).withColumn(name, (place + F.col("_before")).cast("long")).drop("_part", "_before")


def hash_share(h: Column) -> Column:
    """The first 12 hex digits of a hash as a number: it rises with the hash and spreads evenly."""
    return F.conv(F.substring(h, 1, 12), 16, 10).cast("double")
