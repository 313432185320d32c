"""URL filters: rules, and a tree of path templates judged by their labelled urls.

DataFrame functions only. Per host, path segments become shapes (numbers, hex, dates as wildcards), and a
node with more than MAX_CHILDREN literal children gets one wildcard for them. The urls that a rule decides
are the labels. At every level, sibling branches whose share of blocked labels doesn't differ significantly
from the share of all siblings are merged; a chain without siblings is one branch with the node above it.
A template is rejected when the smoothed share of blocked labels of its (merged) branch, or of the nearest
branch above that has labels, reaches PURITY; on a host without labels the prior decides, so its urls are
allowed. Everything is counted per (host, shape path) before any join, so that a large host is a few rows there.

Null urls and urls without :// have empty host and path and are judged like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grantmill.llm.common import guarded, saved, table, with_columns

#: (verdict, host, start of the path)
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
MAX_CHILDREN, Z, PRIOR_BLOCK, PRIOR_ALLOW, PURITY = 20, 1.96, 1.0, 2.0, 0.9
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with host and path."""
    rest = F.expr(f"CASE WHEN locate('://', `{url}`) > 0 THEN substring(`{url}`, locate('://', `{url}`) + 3) ELSE '' END")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return with_columns(pages, {"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})


def by_rule(df: DataFrame, rules=RULES) -> DataFrame:
    """df with rule and rule_verdict: the longest rule that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return with_columns(df, {"rule": rule, "rule_verdict": verdict})


def _shape(s):
    """A segment with its variable parts as wildcards."""
    for pattern, name in ((r"^[0-9a-fA-F]{8}-[0-9a-fA-F-]{27}", "{u}"), (r"^\d{4}-\d{2}-\d{2}", "{d}"), (r"^(?=[^.]*\d)[0-9a-fA-F]{8,}(?=$|\.)", "{h}"), (r"\d+", "{n}")):
        s = F.regexp_replace(s, pattern, name)
    return s


def shaped(df: DataFrame) -> DataFrame:
    return with_columns(df, {"shape": F.array_join(F.transform(F.split("path", "/"), _shape), "/")})


def _branches(t: DataFrame) -> DataFrame:
    """_h, _t, _k, _b, _l of the branches (host, template, key) of rows with blocked and labels, alike siblings pooled."""
    siblings = Window.partitionBy("host", "template")
    pool = F.try_divide(F.sum("b").over(siblings).cast("double"), F.sum("l").over(siblings))
    share = F.try_divide(F.col("b").cast("double"), F.col("l"))
    alike = (F.col("l") > 0) & (F.abs(share - F.col("pool")) <= Z * F.sqrt(F.greatest(F.col("pool") * (1 - F.col("pool")), F.lit(0.0)) / F.col("l")) + 1e-12)
    out = t.groupBy("host", "template", "key").agg(F.sum("blocked").alias("b"), F.sum("labels").alias("l")).withColumn("pool", pool)
    out = out.withColumn("alike", F.coalesce(alike, F.lit(False)))
    merged = Window.partitionBy("host", "template", "alike")
    pooled = lambda c: F.when(F.col("alike"), F.sum(c).over(merged)).otherwise(F.col(c))
    out = out.select("host", "template", "key", pooled("b").alias("_b"), pooled("l").alias("_l"), F.count("*").over(siblings).alias("_n"))
    return out.where((F.col("_l") > 0) & (F.col("_n") > 1)).select(F.col("host").alias("_h"), F.col("template").alias("_t"), F.col("key").alias("_k"), "_b", "_l")


def templates(labelled: DataFrame, max_children: int = MAX_CHILDREN) -> DataFrame:
    """host, shape, template, purity for each (host, shape) of rows with host, shape and rule_verdict.

    Goes down from the hosts, a level at a time, until each shape has ended or is alone in its branch; b and l
    are the blocked and all labels of the lowest branch so far that has any."""
    t = labelled.groupBy("host", "shape").agg(F.count_if(F.col("rule_verdict") == "block").alias("blocked"), F.count("rule_verdict").alias("labels"))
    hosts = t.groupBy(F.col("host").alias("_h")).agg(F.sum("blocked").alias("b"), F.sum("labels").alias("l"))
    t = t.join(hosts, t["host"] == hosts["_h"]).drop("_h")
    t = t.withColumns({"segs": F.slice(F.split("shape", "/"), 2, 1 << 20), "template": F.lit(""), "open": F.lit(True)})
    t = saved(t)  # a level reads it several times: without a cut the plan would multiply with each
    level = 0
    while t.where("open").limit(1).count():
        seg = F.get("segs", F.lit(level))
        children = t.where("open").groupBy("host", "template", seg.alias("seg")).agg(F.count("*").alias("rows"))
        nodes = children.groupBy(F.col("host").alias("_h"), F.col("template").alias("_t")).agg(F.count("seg").alias("_c"), F.sum("rows").alias("_rows"))
        t = t.join(nodes, F.col("open") & (t["host"] == nodes["_h"]) & (t["template"] == nodes["_t"]), "left").drop("_h", "_t")
        alone = F.col("open") & (F.col("_rows") == 1) & seg.isNotNull()
        rest = F.concat("template", F.lit("/"), F.array_join(F.slice("segs", level + 1, 1 << 20), "/"))
        step = F.when((F.col("_c") > max_children) & ~seg.contains("{"), F.lit("*")).otherwise(seg)
        t = t.withColumns({"key": F.when(F.col("open") & ~alone, F.coalesce(F.concat(F.lit("/"), step), F.lit("$"))), "template": F.when(alone, rest).otherwise(F.col("template"))}).drop("_c", "_rows")
        t = saved(t)
        found = _branches(t.where("key is not null"))
        t = t.join(found, (t["host"] == found["_h"]) & (t["template"] == found["_t"]) & (t["key"] == found["_k"]), "left")
        goes_on = F.col("key").startswith("/")
        t = t.withColumns({"b": F.coalesce("_b", "b"), "l": F.coalesce("_l", "l"), "template": F.when(goes_on, F.concat("template", "key")).otherwise(F.col("template")), "open": F.coalesce(goes_on, F.lit(False))})
        t = saved(t.drop("_h", "_t", "_k", "_b", "_l", "key"))
        level += 1
    return t.select("host", "shape", "template", ((F.col("b") + PRIOR_BLOCK) / (F.col("l") + PRIOR_BLOCK + PRIOR_ALLOW)).alias("purity"))


@guarded(named=("url",))
def judge(pages: DataFrame, url: str = "url", rules=RULES, purity: float = PURITY, max_children: int = MAX_CHILDREN) -> DataFrame:
    """pages with host, path, rule, template, purity and verdict."""
    df = shaped(by_rule(parts(pages, url), rules))
    t = templates(df.select("host", "shape", "rule_verdict"), max_children)
    t = t.select(F.col("host").alias("_h"), F.col("shape").alias("_p"), "template", "purity")
    df = df.drop("template", "purity").join(t, (df["host"] == t["_h"]) & (df["shape"] == t["_p"])).drop("_h", "_p", "shape")
    own = F.when(F.col("purity") >= purity, F.lit("block")).otherwise(F.lit("allow"))
    return with_columns(df, {"verdict": F.coalesce("rule_verdict", own)}).drop("rule_verdict")


def op8(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "template")
