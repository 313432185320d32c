"""Queries that call the library's functions, each with DuckDB's statement of the whole rule: name -> (function, SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from grantmill import dims
from grantmill.functions import text
from grantmill.operators import metrics, profile, ranking, sampling


def _t(name, *cols):
    """A reader of columns of a table."""

    def read(spark, sf):
        df = spark.read.parquet(f"{sf}/{name}.parquet")
        return df.select(*cols) if cols else df

    return read


def _on(table, *make):
    """A query that selects columns of a table."""
    return lambda spark, sf: _t(table)(spark, sf).select(*[m() if callable(m) else m for m in make])


def _case(column: str, table: dict, default: str = "NULL") -> str:
    quote = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return f"CASE {column} " + " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in table.items()) + f" ELSE {default} END"


def _ranked(table, cols, order, coarse, name, by=None):
    return lambda spark, sf: ranking.row_numbers(_t(table, *cols)(spark, sf), order, coarse(), name, by)


def _hash_rank(df, name):
    h = df.withColumn("_h", sampling.hash_order("doc_id"))
    return ranking.row_numbers(h, ["_h", "doc_id"], ranking.hash_share(F.col("_h")), name).drop("_h")


def _positional(spark, sf):
    a = ranking.row_numbers(_t("customer", "c_custkey")(spark, sf), ["c_custkey"], F.col("c_custkey"), "rn")
    b = ranking.row_numbers(_t("supplier", "s_suppkey")(spark, sf), ["s_suppkey"], F.col("s_suppkey"), "rn")
    return a.join(b, "rn").select("rn", "c_custkey", "s_suppkey")


def _topup(spark, sf):
    labels = _t("labels")(spark, sf)
    judged = labels.join(_t("documents", "doc_id")(spark, sf), "doc_id")
    want = judged.agg(F.abs(F.count_if(F.col("quality") == 1) - F.count_if(F.col("quality") == 0)).alias("want"))
    pool = _t("documents", "doc_id")(spark, sf).join(labels, "doc_id", "left_anti")
    return _hash_rank(pool, "rn").join(F.broadcast(want)).where("rn <= want").select("doc_id")


#: The Spark side of statements of the catalogue whose window would put all rows in one task; their SQL stays there.
SPREAD = {
    "row_seq": lambda s, d: ranking.row_numbers(_t("orders", "o_orderkey", "o_orderdate")(s, d), ["o_orderdate", "o_orderkey"], F.unix_date(F.to_date("o_orderdate")) + F.col("o_orderkey") / 1e12, "seq").select("o_orderkey", "seq"),
    "positional_join": _positional,
    "shuffle_hash": lambda s, d: _hash_rank(_t("documents", "doc_id")(s, d), "place"),
    "balance_topup": _topup,
    "chunk_assign": lambda s, d: ranking.row_numbers(_t("orders", "o_orderkey")(s, d), ["o_orderkey"], F.col("o_orderkey"), "n").select("o_orderkey", F.floor((F.col("n") - 1) / 1000).cast("long").alias("chunk")),
    "per_class_filename": lambda s, d: ranking.row_numbers(_t("documents", "doc_id", "lang")(s, d), ["doc_id"], F.col("doc_id"), "n", ["lang"]).select("doc_id", F.concat("lang", F.lit("_desc_"), F.lpad(F.col("n").cast("string"), 5, "0"), F.lit(".txt")).alias("file")),
    "dedup_last": lambda s, d: sampling.dedup(_t("documents", "doc_id", "text")(s, d), ["text"], ["doc_id"], "last").select("doc_id"),
}

STOP = ("the", "and", "der", "die", "des", "las", "los")
LABELS = ("User", "Assist", "Assistant")
MACROS = {"Heat": ("hot", "Cold"), "Size": ("large", "small"), "Colour": ("red", "blue")}
LICENCES = {"mit": (r"\bmit\s+license\b",), "apache": (r"\bapache\b",), "gpl": (r"\bgeneral\s+public\b", r"\bgpl\b")}


def _say(sql: str):
    return lambda: F.expr(sql)


def _words(spark, sf, by=(), stop=()):
    d = _t("documents", *by, "text")(spark, sf)
    return d.select(*by, F.explode(text.words("text", 2, stop)).alias("w")).groupBy(*by, "w").agg(F.count("*").alias("n"))


def _predictions(spark, sf):
    labels = _t("labels")(spark, sf)
    return labels.join(_t("documents", "doc_id", "lang", "n_chars")(spark, sf), "doc_id").select("lang", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("t"), F.when(F.col("n_chars") > 1500, "good").otherwise("bad").alias("p"))


def _averages(spark, sf):
    r = metrics.averages(metrics.class_report(_predictions(spark, sf), "t", "p"))
    return r.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


def _confusion(spark, sf):
    return metrics.confusion_matrix(_predictions(spark, sf), "t", "p", ("good", "bad", "unsure"))


def _chi(spark, sf):
    o = _t("orders", "o_orderpriority", "o_orderstatus")(spark, sf)
    return metrics.chi_square(o, "o_orderpriority", "o_orderstatus").select(F.round("chi2", 6).alias("chi2"), "dof", F.round("p", 6).alias("p"))


def _double_explode(spark, sf):
    p = _t("part")(spark, sf).select(F.when(F.col("p_partkey") % 10 > 0, F.split("p_type", " ")).alias("a"), F.split("p_name", " ").alias("b"))
    return p.select(F.explode_outer("a").alias("a"), "b").select("a", F.explode_outer("b").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))


def _templates(spark, sf):
    d = _t("documents", "doc_id", "text", "lang")(spark, sf)
    return d.select("doc_id", F.posexplode(text.template_variants("text", dims.USE_CASE_TEMPLATES, F.lower("lang"))).alias("k", "x")).withColumn("k", F.col("k").cast("long"))


def _round(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


_RX = "coalesce(regexp_matches({}, '(?i){}'), false)"
_MIT, _APACHE, _GPL = r"\bmit\s+license\b", r"\bapache\b", r"(\bgeneral\s+public\b|\bgpl\b)"
_FOUND = "SELECT {by}unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS w FROM documents"
_INDUSTRY = "concat(p_name, CASE p_partkey % 4 WHEN 0 THEN ' Industria 4.0' WHEN 1 THEN ' transizione-4 0' WHEN 2 THEN ' industria 14.0' ELSE ' versione 4.0' END)"
_SIZE = "CASE c_custkey % 7 WHEN 0 THEN 'Piccola impresa' WHEN 1 THEN ' media ' WHEN 2 THEN 'micro' WHEN 3 THEN 'GRANDE impresa' WHEN 4 THEN 'pmi' WHEN 5 THEN c_mktsegment END"
_REASON = "CASE WHEN turn % 2 = 0 THEN concat('<think>', text, '</think> ', text) ELSE concat(text, ' <think>', text) END"
_ROLE = "CASE turn % 3 WHEN 0 THEN concat(' ', upper(role)) WHEN 1 THEN concat('the ', role, ' or user') ELSE concat('none ', turn) END"
_FENCE = "concat('```json', chr(10), text, chr(10), '```')"
_MANY = "concat(replace(p_name, ' ', ', '), '|', p_type, '  ', p_name, '|', p_type)"
_PRED = "WITH p AS (SELECT CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS t, CASE WHEN n_chars > 1500 THEN 'good' ELSE 'bad' END AS p FROM labels JOIN documents USING (doc_id))"

#: Functions of the library with DuckDB's statement of the same rule.
LIBRARY = {
    "word_freq": (lambda s, d: _words(s, d, (), STOP), "SELECT w, count(*) AS n FROM (" + _FOUND.format(by="") + f") WHERE length(w) > 2 AND w NOT IN {STOP} GROUP BY w"),
    "word_freq_by_class": (lambda s, d: _words(s, d, ("lang",)), "SELECT lang, w, count(*) AS n FROM (" + _FOUND.format(by="lang, ") + ") WHERE length(w) > 2 GROUP BY lang, w"),
    "regex_any_col": (lambda s, d: _t("documents")(s, d).where(text.matches_any(["text", "source"], r"\blicensed\s+under\b|\bsrc1[0-9]$", ("licens", "src1"))).select("doc_id"), "SELECT doc_id FROM documents WHERE " + _RX.format("text", r"\blicensed\s+under\b|\bsrc1[0-9]$") + " OR " + _RX.format("source", r"\blicensed\s+under\b|\bsrc1[0-9]$")),
    "regex_concat": (lambda s, d: _t("documents")(s, d).where(text.matches_concat(["text", "source", "lang"], r"public\s+license|mit\s+license")).select("doc_id"), "SELECT doc_id FROM documents WHERE " + _RX.format("concat_ws(' ', text, source, lang)", r"(public\s+license|mit\s+license)")),
    "regex_exclude": (lambda s, d: _t("documents")(s, d).where(~text.matches("text", "license")).select("doc_id"), "SELECT doc_id FROM documents WHERE NOT " + _RX.format("text", "license")),
    "regex_classify": (_on("documents", "doc_id", lambda: text.first_match("text", LICENCES, "Research").alias("label")), f"SELECT doc_id, CASE WHEN {_RX.format('text', _MIT)} THEN 'mit' WHEN {_RX.format('text', _APACHE)} THEN 'apache' WHEN {_RX.format('text', _GPL)} THEN 'gpl' ELSE 'Research' END AS label FROM documents"),
    "regex_binary": (_on("documents", "doc_id", lambda: text.regex_binary("text", r"\blicen[sc]e\b").alias("label")), "SELECT doc_id, CASE WHEN " + _RX.format("text", r"\blicen[sc]e\b") + " THEN 'ai' ELSE 'non_ai' END AS label FROM documents"),
    "regex_case_split": (_on("documents", "doc_id", lambda: F.col("text").rlike(r"(?i:apache)|\bMIT\b").alias("hit")), r"SELECT doc_id, regexp_matches(text, '(?i:apache)|\bMIT\b') AS hit FROM documents"),
    "industry_40": (_on("part", "p_partkey", lambda: F.expr(_INDUSTRY).alias("x"), lambda: text.matches_any([F.expr(_INDUSTRY)], dims.INDUSTRY_40, dims.INDUSTRY_WORDS).alias("hit")), f"SELECT p_partkey, {_INDUSTRY} AS x, regexp_matches({_INDUSTRY}, '(?i){dims.INDUSTRY_40}') AS hit FROM part"),
    "bucket_keyword": (_on("customer", "c_custkey", lambda: text.bucket_beneficiary(F.expr(_SIZE)).alias("size_class")), f"SELECT c_custkey, CASE WHEN regexp_matches(upper(trim(x)), 'PMI|PICCOL|MEDI|MICRO') THEN 'PMI' WHEN contains(upper(trim(x)), 'GRANDE') THEN 'Grande impresa' ELSE 'Altro' END AS size_class FROM (SELECT c_custkey, {_SIZE} AS x FROM customer)"),
    "section_name": (_on("part", "p_partkey", lambda: text.lookup(F.substring("p_type", 1, 1), dims.SECTIONS, "Altro").alias("section"), lambda: text.lookup(F.col("p_size") % 8, dims.INSTRUMENTS).alias("instrument")), f"SELECT p_partkey, {_case('substr(p_type, 1, 1)', dims.SECTIONS, chr(39) + 'Altro' + chr(39))} AS section, {_case('p_size % 8', dims.INSTRUMENTS)} AS instrument FROM part"),
    "label_macros": (_on("part", "p_partkey", lambda: F.array_join(text.map_labels(F.split("p_name", " "), MACROS, "Other"), "|").alias("macros")), "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(string_split(p_name, ' '), lambda w: CASE WHEN lower(w) IN ('hot', 'cold') THEN 'Heat' WHEN lower(w) IN ('large', 'small') THEN 'Size' WHEN lower(w) IN ('red', 'blue') THEN 'Colour' ELSE 'Other' END))), '|') AS macros FROM part"),
    "clean_ascii": (_on("documents", "doc_id", lambda: text.clean_ascii("text").alias("t")), r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\r\n\t]|[^\x00-\x7F]', ' ', 'g'), '["'']', '', 'g'), '[,;]', ' ', 'g'), ' +', ' ', 'g')) AS t FROM documents"""),
    "multival_normalise": (_on("part", "p_partkey", lambda: text.multi_normalise(F.expr(_MANY)).alias("labels")), f"SELECT p_partkey, array_to_string(list_filter(l, lambda v, i: list_position(l, v) = i), '|') AS labels FROM (SELECT p_partkey, list_filter(list_transform(string_split_regex({_MANY}, '\\s{{2,}}|[|]|, '), lambda v: trim(v)), lambda v: v <> '') AS l FROM part)"),
    "strip_fence": (_on("conversations", "conv_id", "turn", lambda: text.strip_fence(F.expr(_FENCE)).alias("t")), rf"SELECT conv_id, turn, trim(regexp_replace(regexp_replace(trim({_FENCE}), '\A```[a-zA-Z]*\s*', ''), '\s*```\z', '')) AS t FROM conversations"),
    "strip_reasoning": (_on("conversations", "conv_id", "turn", lambda: text.strip_reasoning(F.expr(_REASON)).alias("t")), rf"SELECT conv_id, turn, trim(regexp_replace({_REASON}, '(?s)<think>.*?(?:</think>|\z)', '', 'g')) AS t FROM conversations"),
    "resolve_label": (_on("conversations", "conv_id", "turn", lambda: text.resolve_label(F.expr(_ROLE), LABELS).alias("label")), f"SELECT conv_id, turn, CASE lower(trim(x)) WHEN 'user' THEN 'User' WHEN 'assist' THEN 'Assist' WHEN 'assistant' THEN 'Assistant' ELSE coalesce(list_filter(['Assistant', 'Assist', 'User'], lambda l: contains(lower(x), lower(l)))[1], 'UNKNOWN_' || trim(x)) END AS label FROM (SELECT conv_id, turn, {_ROLE} AS x FROM conversations)"),
    "template_explode": (_templates, r"WITH b AS (SELECT doc_id, text, coalesce(lower(lang), '') AS g, regexp_replace(trim(text), '\.+\z', '') AS bare FROM documents WHERE text IS NOT NULL), v AS (SELECT doc_id, text, g, bare, lower(substr(bare, 1, 1)) || substr(bare, 2) AS low FROM b), l AS (SELECT doc_id, [text, 'AI system that performs ' || low, 'An artificial intelligence solution designed for ' || low, 'Technology leveraging AI and machine learning for ' || low, 'Automated ' || g || ' application: ' || low, bare || '. This AI-powered system automates key processes in the ' || g || ' domain', 'A ' || g || ' AI tool capable of ' || low] AS x FROM v) SELECT doc_id, unnest(range(7)) AS k, unnest(x) AS x FROM l"),
    "double_explode": (_double_explode, "WITH t AS (SELECT CASE WHEN p_partkey % 10 > 0 THEN string_split(p_type, ' ') ELSE [NULL] END AS a, string_split(p_name, ' ') AS b FROM part), u AS (SELECT unnest(a) AS a, b FROM t), v AS (SELECT a, unnest(b) AS b FROM u) SELECT a, b, count(*) AS n FROM v GROUP BY a, b"),
    "non_ascii_chars": (lambda s, d: _t("documents")(s, d).select("lang", F.explode(text.non_ascii_chars("text")).alias("ch")).groupBy("lang", "ch").agg(F.count("*").alias("n")), r"SELECT lang, ch, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(text, '[^\x00-\x7F]')) AS ch FROM documents) GROUP BY lang, ch"),
    "profile_columns": (lambda s, d: _round(profile.profile(_t("documents")(s, d)), "null_pct"), " UNION ALL ".join(f"SELECT '{c}' AS col, '{t}' AS dtype, count({c}) AS non_null, count(*) - count({c}) AS nulls, round(100.0 * (count(*) - count({c})) / count(*), 6) AS null_pct, count(DISTINCT {c}) AS uniq FROM documents" for c, t in (("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")))),
    "strlen_audit": (lambda s, d: _round(profile.length_audit(_t("documents")(s, d)), "non_ascii"), " UNION ALL ".join(f"SELECT '{c}' AS col, coalesce(max(length({c})), 0) AS longest, count(*) FILTER (length({c}) > 2045) AS over_limit, round(coalesce(avg(CASE WHEN {c} IS NULL THEN NULL WHEN regexp_matches({c}, '[^\\x00-\\x7F]') THEN 1.0 ELSE 0.0 END), 0), 6) AS non_ascii FROM documents" for c in ("text", "lang", "source"))),
    "label_checks": (lambda s, d: profile.label_checks(_t("documents", "lang")(s, d), "lang", ("en", "de", "it"), 60), "WITH g AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang) SELECT 'label not allowed' AS \"check\", CAST(coalesce(sum(n) FILTER (lang IS NULL OR lang NOT IN ('en', 'de', 'it')), 0) AS BIGINT) AS broken FROM g UNION ALL SELECT 'label missing', 3 - count(*) FILTER (lang IN ('en', 'de', 'it')) FROM g UNION ALL SELECT 'over the cap', count(*) FILTER (n > 60) FROM g"),
    "confusion_matrix": (_confusion, _PRED + ", l AS (SELECT unnest([0, 1, 2]) AS place, unnest(['good', 'bad', 'unsure']) AS truth) SELECT place, truth, count(*) FILTER (p = 'good') AS good, count(*) FILTER (p = 'bad') AS bad, count(*) FILTER (p = 'unsure') AS unsure FROM l LEFT JOIN p ON t = truth GROUP BY place, truth"),
    "class_report_averages": (_averages, _PRED + ", l AS (SELECT unnest(['good', 'bad']) AS label), c AS (SELECT label, count(*) FILTER (t = label) AS s, count(*) FILTER (p = label) AS q, count(*) FILTER (t = label AND p = label) AS k FROM p, l GROUP BY label), r AS (SELECT CASE WHEN q = 0 THEN 0 ELSE k / q END AS a, CASE WHEN s = 0 THEN 0 ELSE k / s END AS b, 2 * k / (s + q) AS f, s FROM c) SELECT 'macro avg' AS label, round(avg(a), 6) AS \"precision\", round(avg(b), 6) AS recall, round(avg(f), 6) AS f1, CAST(sum(s) AS BIGINT) AS support FROM r UNION ALL SELECT 'weighted avg', round(sum(a * s) / sum(s), 6), round(sum(b * s) / sum(s), 6), round(sum(f * s) / sum(s), 6), CAST(sum(s) AS BIGINT) FROM r"),
    "chi_square_p": (_chi, "WITH c AS (SELECT o_orderpriority AS a, o_orderstatus AS b, count(*) AS o FROM orders GROUP BY 1, 2), r AS (SELECT a, sum(o) AS x FROM c GROUP BY a), k AS (SELECT b, sum(o) AS y FROM c GROUP BY b), t AS (SELECT sum(o) AS n FROM c), e AS (SELECT r.a, k.b, CAST(x AS DOUBLE) * y / n AS e FROM r, k, t), s AS (SELECT sum((coalesce(o, 0) - e) * (coalesce(o, 0) - e) / e) AS chi2, (count(DISTINCT e.a) - 1) * (count(DISTINCT e.b) - 1) AS dof FROM e LEFT JOIN c ON c.a = e.a AND c.b = e.b) SELECT round(chi2, 6) AS chi2, dof, round(exp(-chi2 / 2) * list_sum(list_transform(range(0, dof // 2), lambda i: pow(chi2 / 2, i) / CAST(factorial(CAST(i AS INTEGER)) AS DOUBLE))), 6) AS p FROM s"),
}
