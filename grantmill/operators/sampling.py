"""Deterministic sampling by the hash of a key: the same rows at every run and partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(key: str, seed: int = 42) -> Column:
    return F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed))))


def sample_n(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(hash_order(key, seed), key).limit(n)


def stratified_cap(df: DataFrame, by: str, cap: int, key: str, seed: int = 42) -> DataFrame:
    """At most cap rows per class; Spark limits each task's groups before the shuffle."""
    w = Window.partitionBy(by).orderBy(hash_order(key, seed), key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).drop("_r")


def dedup(df: DataFrame, by: list[str], order: list[str], keep: str = "first") -> DataFrame:
    """The first or last row of each key in an explicit order; a hot key is reduced on the map side."""
    names = [c for c in df.columns if c not in by]
    seq = F.struct(*order)
    pick = F.min_by if keep == "first" else F.max_by
    return df.groupBy(*by).agg(pick(F.struct(*names), seq).alias("_s")).select(*by, *[F.col(f"_s.{c}").alias(c) for c in names]).select(*df.columns)


def train_test_split(df: DataFrame, key: str, test: float = 0.1, seed: int = 42) -> DataFrame:
    """is_test by hash rank: exactly ceil(test * n) rows. The rank is cut at a hash, found from counts by prefix."""
    h = df.withColumn("_h", hash_order(key, seed))
    n = h.count()
    want = -(-n * int(test * 1000) // 1000)
    prefix = F.substring("_h", 1, 4)
    counts = h.groupBy(prefix.alias("p")).agg(F.count("*").alias("c")).orderBy("p").collect()  # at most 65,536 rows
    below, cut = 0, None
    for r in counts:
        if below + r.c >= want:
            cut = r.p
            break
        below += r.c
    if cut is None:
        return h.withColumn("is_test", F.lit(want >= n)).drop("_h")
    edge = [r._h for r in h.where(prefix == cut).orderBy("_h").limit(want - below).select("_h").collect()]
    limit = edge[-1] if edge else cut
    return h.withColumn("is_test", F.col("_h") <= limit).drop("_h")
