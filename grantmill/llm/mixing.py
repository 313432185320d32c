"""Mixing sources to target weights by Pareto order sampling.

Every document of a source is due the same number of copies, target / size of the source, at most
MAX_COPIES. Whole copies are certain. The fraction is the inclusion probability p of one more copy:
documents are ranked by u / (1 - u) divided by p / (1 - p), u a hash of the document as a number in
(0, 1), and are taken in that order until the source's words come as near to its target as whole
documents can. The ranks are cut in two steps: sums by slices of the rank find the slice that crosses the
target, and only that slice's documents are put in order, so that no source has to fit in one task.

A null or empty text has no words and is never taken beyond its whole copies of nothing. Rows with equal
doc_id and text have equal ranks. A null source is a source of its own, last in order. Extra columns may have
any name; computed columns replace input columns so named.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grantmill.llm.common import WORD_SPLIT, guarded, saved, table, with_columns

WEIGHTS, SHARE, MAX_COPIES, SEED = (3.0, 1.0, 2.0), 1.5, 2, "mix-1"
SLICES = 1024


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MAX_COPIES) -> DataFrame:
    """source, source_size, weight and target for each source of (source, size) rows.

    Caps bind in the order of cap / weight: with the sources sorted so, a source is capped if the common
    level, what is left of the total over the weights that are left, isn't below its own ratio.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by = Window.orderBy("ratio", F.col("source").isNull(), "source")
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("weight", F.get(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights)).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * float(most)).withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy(F.lit(1))
    total = share * F.sum("source_size").over(everything)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    per = per.withColumn("level", level).withColumn("capped", F.col("level") >= F.col("ratio"))
    final = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)
    return per.select("source", "source_size", "weight", F.when(F.col("capped"), F.col("cap")).otherwise(final * F.col("weight")).alias("target"))


@guarded("doc_id", "source", "text")
def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MAX_COPIES, seed: str = SEED, slices: int = SLICES) -> DataFrame:
    """A row for each document: its other columns without text, size, source_size, target, copies and taken."""
    spark_docs = with_columns(docs, {
        "size": F.size(F.filter(F.split(F.coalesce("text", F.lit("")), WORD_SPLIT), lambda w: w != "")).cast("long"),
        "_tie": F.xxhash64("text"),
    }).drop("text")
    rows = saved(spark_docs)
    per = saved(targets(rows, weights, share, most)).select(F.col("source").alias("_s"), "source_size", "target")
    rows = rows.drop("source_size", "target").join(F.broadcast(per) if per.count() <= 100_000 else per, rows["source"].eqNullSafe(per["_s"])).drop("_s")
    due = F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0))
    whole = F.floor(due + 1e-9)
    p = F.greatest(due - whole, F.lit(0.0))
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("double") + 0.5) / 2.0**48
    odds = F.col("_u") / (1 - F.col("_u")) * (1 - F.col("_p")) / F.col("_p")
    rows = rows.withColumns({"_whole": whole, "_p": p, "_u": u})
    open_ = (F.col("_p") > 1e-9) & (F.col("size") > 0)
    rows = rows.withColumn("_rank", F.when(open_, odds / (1 + odds)))
    rows = rows.withColumn("_slice", F.least(F.floor(F.col("_rank") * slices), F.lit(slices - 1)))
    # words that the fractions must bring, and the slice in which they are reached
    per_slice = rows.where(open_).groupBy("source", "_slice", "source_size", "target", "_whole").agg(F.sum("size").alias("words"))
    up_to = Window.partitionBy("source").orderBy("_slice")
    need = F.col("target") - F.col("_whole") * F.col("source_size")
    per_slice = per_slice.withColumn("above", F.sum("words").over(up_to)).withColumn("below", F.col("above") - F.col("words"))
    crossing = saved(per_slice.where((F.col("below") < need) & (F.col("above") >= need)).select(F.col("source").alias("_s"), F.col("_slice").alias("_cut"), "below"))
    rows = rows.join(F.broadcast(crossing) if crossing.count() <= 100_000 else crossing, rows["source"].eqNullSafe(crossing["_s"]), "left").drop("_s")
    inside = open_ & (F.col("_slice") == F.col("_cut"))
    in_order = Window.partitionBy("source").orderBy("_rank", "doc_id", "_tie")
    edge = rows.where(inside).withColumn("_sum", F.col("below") + F.sum("size").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    # the document that crosses is taken if its middle lies before the target
    edge = edge.withColumn("_more", (F.col("_sum") - F.col("size") / 2.0 <= need).cast("long"))
    rest = rows.where(~F.coalesce(inside, F.lit(False)))
    rest = rest.withColumn("_more", F.when(open_ & (F.col("_cut").isNull() | (F.col("_slice") < F.col("_cut"))), 1).otherwise(0).cast("long"))
    out = rest.unionByName(edge.drop("_sum"))
    out = out.withColumn("copies", F.least(F.col("_whole") + F.col("_more"), F.lit(most)).cast("long"))
    return out.withColumn("taken", F.col("copies") * F.col("size")).drop(*[c for c in out.columns if c[0] == "_"], "below")


@guarded("doc_id", "source")
def repeated(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The documents as often as the mix takes them."""
    m = mixed.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), "copies").groupBy("_d", "_s").agg(F.max("copies").alias("copies")).where(F.col("copies") > 0)
    df = docs.join(m, docs["doc_id"].eqNullSafe(m["_d"]) & docs["source"].eqNullSafe(m["_s"]))
    return df.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("col")


def op2(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


#: The same, with one ordered pass over each source.
SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS r FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((r - 1) % 3 + 1)::BIGINT] AS weight, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM per),
o AS (SELECT *, {MAX_COPIES}.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY source_size / weight, source IS NULL, source) AS k FROM w),
lev AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) /
  (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM o),
t AS (SELECT source, source_size, CASE WHEN level >= cap / weight THEN cap ELSE weight * max(CASE WHEN level < cap / weight THEN level END) OVER () END AS target FROM lev),
r AS (SELECT doc_id, size, d.source, source_size, target, floor(target / source_size + 1e-9) AS whole,
  greatest(target / source_size - floor(target / source_size + 1e-9), 0) AS p,
  (('0x' || substr(md5('{SEED}' || doc_id), 1, 12))::BIGINT::DOUBLE + 0.5) / pow(2, 48) AS u FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, p > 1e-9 AND size > 0 AS open FROM r),
c AS (SELECT *, sum(CASE WHEN open THEN size END) OVER (PARTITION BY source, open ORDER BY u / (1 - u) * (1 - p) / CASE WHEN p > 0 THEN p END, doc_id ROWS UNBOUNDED PRECEDING) AS s FROM q)
SELECT doc_id, size, source_size, target, (size * least(whole + CASE WHEN open AND s - size / 2.0 <= target - whole * source_size THEN 1 ELSE 0 END, 2))::BIGINT AS taken FROM c
"""
