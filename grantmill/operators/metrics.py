"""Classification metrics as one aggregation each."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def binary_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """tp, fp, fn, tn, accuracy, precision, recall and f1 of two boolean columns; null counts as false, 0 / 0 as 0."""
    t, p = (F.coalesce(F.col(c), F.lit(False)) for c in (truth, predicted))
    c = df.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("tp", "fp", "fn", "tn", _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def class_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """label, precision, recall, f1 and support of each class."""
    both = df.select(F.explode(F.array(F.struct(F.col(truth).alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col(truth) == F.col(predicted)).cast("int").alias("hit")), F.struct(F.col(predicted).alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("hit")))).alias("x")).select("x.*")
    g = both.where(F.col("label").isNotNull()).groupBy("label").agg(F.sum("t").alias("support"), F.sum("p").alias("n_pred"), F.sum("hit").alias("tp"))
    return g.select("label", _ratio(F.col("tp"), F.col("n_pred")).alias("precision"), _ratio(F.col("tp"), F.col("support")).alias("recall"), _ratio(2 * F.col("tp"), F.col("support") + F.col("n_pred")).alias("f1"), F.col("support").cast("long"))


def averages(report: DataFrame) -> DataFrame:
    """The macro and the weighted average of a class report, weighted by support, with the whole support."""
    total = F.sum("support")
    cols = ("precision", "recall", "f1")
    macro = report.agg(*[F.avg(c).alias(c) for c in cols], total.alias("support")).select(F.lit("macro avg").alias("label"), *cols, "support")
    weighted = report.agg(*[_ratio(F.sum(F.col(c) * F.col("support")), total).alias(c) for c in cols], total.alias("support")).select(F.lit("weighted avg").alias("label"), *cols, "support")
    return macro.union(weighted)


def confusion_matrix(df: DataFrame, truth: str, predicted: str, labels: Sequence[str]) -> DataFrame:
    """One row for each label, in order, with a column for each predicted label; other labels are left out, missing cells are 0."""
    t, p = F.col(truth).cast("string"), F.col(predicted).cast("string")
    cells = df.where(t.isin(*labels) & p.isin(*labels)).groupBy(t.alias("truth")).agg(*[F.count_if(p == x).alias(x) for x in labels])
    order = df.sparkSession.createDataFrame(list(enumerate(labels)), "place int, truth string")
    return order.join(cells, "truth", "left").select("place", "truth", *[F.coalesce(F.col(x), F.lit(0)).alias(x) for x in labels])


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """chi2, dof and p of the independence of two columns, rows with a null left out; p is 1 where dof is 0."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("o"))
    rows, cols = both.groupBy("a").agg(F.sum("o").alias("x")), both.groupBy("b").agg(F.sum("o").alias("y"))
    n = both.agg(F.sum("o").alias("n"))
    # the sum of (o - e)^2 / e is n * (sum of o^2 / (x * y) - 1), for which empty cells need not be made
    part = both.join(rows, "a").join(cols, "b").agg(F.sum(F.col("o").cast("double") * F.col("o") / (F.col("x").cast("double") * F.col("y"))).alias("s"))
    size = rows.agg(F.count("*").alias("r")).join(cols.agg(F.count("*").alias("c")))
    x = part.join(n).join(size).select((F.col("n") * (F.col("s") - 1)).alias("chi2"), (F.greatest(F.col("r") - 1, F.lit(0)) * F.greatest(F.col("c") - 1, F.lit(0))).alias("dof")).first()
    chi2, dof = max(x.chi2 or 0.0, 0.0), max(x.dof or 0, 0)
    return df.sparkSession.createDataFrame([(chi2, dof, chi_square_tail(chi2, dof))], "chi2 double, dof long, p double")


def chi_square_tail(x: float, dof: int) -> float:
    """The probability that a chi-square variable exceeds x: the finite series of whole or half orders."""
    if dof < 1 or x <= 0:
        return 1.0
    half = x / 2
    term, total = (math.exp(-half), math.exp(-half)) if dof % 2 == 0 else (math.exp(-half) / math.sqrt(math.pi * half), math.erfc(math.sqrt(half)))
    for k in range(1, dof // 2 if dof % 2 == 0 else (dof + 1) // 2):
        term *= half / (k if dof % 2 == 0 else k - 0.5)
        total += term
    return min(total, 1.0)
