"""Profiles of any table: one aggregation over all columns, one row a column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _by_column(df: DataFrame, names: Sequence[str], measures: dict[str, dict[str, Column]]) -> DataFrame:
    """A row for each name with its measures; all of them are aggregated in one pass."""
    one = df.agg(F.struct(*[F.struct(*[m[c].alias(k) for k, m in measures.items()]).alias(f"c{i}") for i, c in enumerate(names)]).alias("all"))
    rows = F.array(*[F.struct(F.lit(c).alias("col"), *[F.col(f"all.c{i}.{k}").alias(k) for k in measures]) for i, c in enumerate(names)])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """col, dtype, non_null, nulls, null_pct and uniq of every column. `exact=False` estimates uniq without a shuffle of values."""
    names = df.columns
    types = dict(df.dtypes)
    uniq = F.count_distinct if exact else F.approx_count_distinct
    n = F.count(F.lit(1))
    return _by_column(df, names, {
        "dtype": {c: F.first(F.lit(types[c])) for c in names},
        "non_null": {c: F.count(_quoted(c)) for c in names},
        "nulls": {c: n - F.count(_quoted(c)) for c in names},
        "null_pct": {c: F.coalesce(F.try_divide(100.0 * (n - F.count(_quoted(c))), n), F.lit(0.0)) for c in names},
        "uniq": {c: uniq(_quoted(c)) for c in names},
    })


def length_audit(df: DataFrame, limit: int = 2045) -> DataFrame:
    """col, longest, over_limit and non_ascii (share of values) of every string column."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    odd = {c: _quoted(c).rlike(r"[^\x00-\x7F]") for c in names}
    return _by_column(df, names, {
        "longest": {c: F.coalesce(F.max(F.char_length(_quoted(c))), F.lit(0)).cast("long") for c in names},
        "over_limit": {c: F.count_if(F.char_length(_quoted(c)) > limit) for c in names},
        "non_ascii": {c: F.coalesce(F.avg(odd[c].cast("double")), F.lit(0.0)) for c in names},
    })


def label_checks(df: DataFrame, label: str, allowed: Sequence[str], cap: int) -> DataFrame:
    """check and broken: rows whose label is null or not allowed, allowed labels without rows, labels with more rows than the cap."""
    g = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    ok = F.coalesce(F.col("label").isin(*allowed), F.lit(False))
    one = g.agg(F.coalesce(F.sum(F.when(~ok, F.col("n"))), F.lit(0)).alias("a"), (F.lit(len(set(allowed))) - F.count_if(ok)).alias("b"), F.count_if(F.col("n") > cap).alias("c"))
    pairs = F.array(*[F.struct(F.lit(k).alias("check"), F.col(v).cast("long").alias("broken")) for k, v in (("label not allowed", "a"), ("label missing", "b"), ("over the cap", "c"))])
    return one.select(F.explode(pairs).alias("x")).select("x.*")
