"""All named queries over the tables, each a declarative statement for both engines or a DataFrame operator with its SQL.

Grant records are orders with their customers: year and date of the order, amount, class (AI for finished
orders), category (priority), confidence and region. Texts are documents.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from grantmill.operators import inequality, metrics, sampling
from grantmill.plans.dialect import duck_sql, spark_sql
from grantmill.plans.library import LIBRARY, SPREAD

AID = """aid AS (SELECT o_orderkey AS id, o_custkey AS cup, CAST(year(o_orderdate) AS INT) AS anno, DAY(o_orderdate) AS day, o_totalprice AS amount,
 CASE WHEN o_orderstatus = 'F' THEN 'AI' ELSE 'NON_AI' END AS class, o_orderpriority AS category, (o_orderkey % 101) / CAST(100 AS DOUBLE) AS conf,
 c_name AS beneficiary, c_mktsegment AS kind, r_name AS region
 FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey)"""
DOCS = "d AS (SELECT doc_id, text, lang, source, n_chars FROM {documents})"
PRED = """p AS (SELECT l.doc_id, l.quality AS truth, l.toxic, CASE WHEN d.n_chars > 1500 THEN 1 ELSE 0 END AS pred, (l.doc_id % 97) / CAST(96 AS DOUBLE) AS conf, d.text, d.lang
 FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id)"""
CELL = "CASE WHEN truth = 1 AND pred = 1 THEN 'TP' WHEN truth = 1 THEN 'FN' WHEN pred = 1 THEN 'FP' ELSE 'TN' END"
PRIO = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def _pivot(expr: str, end: str = "") -> str:
    return ", ".join(f"{expr.format(p=p)} AS c{p[0]}{end}" for p in PRIO)


A, D, P = f"WITH {AID} ", f"WITH {DOCS} ", f"WITH {PRED} "
N = "CAST(count(*) AS BIGINT) AS n"
MULTI = "m AS (SELECT l_orderkey AS id, AJOIN(ASORT(COLLECT(l_returnflag)), '|') AS flags FROM {lineitem} GROUP BY l_orderkey)"
HASH = "md5(concat(CAST({k} AS VARCHAR(20)), '-42'))"


def _h(k: str) -> str:
    return HASH.replace("{k}", k)


QUERIES: dict[str, str] = {
    # scans, projections, filters
    "scan_project": "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice > 100000",
    "scan_year_partition": A + f"SELECT anno, {N} FROM aid GROUP BY anno",
    "scan_filter_class": A + "SELECT id, anno, amount FROM aid WHERE class = 'AI'",
    "scan_try_cast": "SELECT event_id, TRYDOUBLE(CASE WHEN event_id % 7 = 0 THEN 'x' ELSE CAST(event_id AS VARCHAR(20)) END) AS v FROM {events}",
    "scan_keep_ids": "SELECT lpad(CAST(c_custkey AS VARCHAR(20)), 11, '0') AS fiscal_code, c_name FROM {customer}",
    "scan_provenance": "SELECT concat(source, '.csv') AS file, lang, CAST(count(*) AS BIGINT) AS n FROM {documents} GROUP BY source, lang",
    "scan_semicolon": "SELECT c_custkey, SPLIT(concat(c_name, ';', c_mktsegment), ';') AS parts FROM {customer} WHERE length(c_name) > 0",
    "scan_wholetext": "SELECT lang AS label, doc_id, trim(text) AS text FROM {documents} WHERE length(trim(text)) > 0",
    "project_rename": "SELECT p_partkey AS codice, p_name AS descrizione, p_retailprice AS importo FROM {part}",
    "project_const": "SELECT s_suppkey, 'AI' AS label, '' AS note FROM {supplier}",
    "decimal_comma": "SELECT o_orderkey, TRYDOUBLE(replace(replace(CAST(o_totalprice AS VARCHAR(30)), '.', ','), ',', '.')) AS amount FROM {orders}",
    "lookup_default": A + "SELECT id, coalesce(CASE region WHEN 'ASIA' THEN 'Oriente' WHEN 'EUROPE' THEN 'Europa' END, 'Altro') AS area FROM aid",
    "lookup_drop": A + ", m AS (SELECT 'ASIA' AS k, 'Est' AS v UNION ALL SELECT 'EUROPE', 'Ovest' UNION ALL SELECT 'AFRICA', NULL) SELECT id, v FROM aid JOIN m ON region = k WHERE v IS NOT NULL",
    "value_replace": A + "SELECT id, CASE category WHEN '1-URGENT' THEN 'HIGH' WHEN '2-HIGH' THEN 'HIGH' ELSE category END AS label FROM aid",
    "bin_right_closed": A + ", b AS (SELECT CASE WHEN conf > 0 AND conf <= 0.5 THEN '(0, 0.5]' WHEN conf > 0.5 AND conf <= 0.9 THEN '(0.5, 0.9]' WHEN conf > 0.9 AND conf <= 1 THEN '(0.9, 1]' END AS bin FROM aid), k AS (SELECT '(0, 0.5]' AS bin UNION ALL SELECT '(0.5, 0.9]' UNION ALL SELECT '(0.9, 1]') SELECT k.bin, CAST(count(b.bin) AS BIGINT) AS n FROM k LEFT JOIN b ON k.bin = b.bin GROUP BY k.bin",
    "clip_hist": "SELECT least(x.k, 20) AS k, CAST(count(*) AS BIGINT) AS n FROM (SELECT o_custkey, CAST(count(*) AS BIGINT) AS k FROM {orders} GROUP BY o_custkey) x GROUP BY least(x.k, 20)",
    "coalesce_text": "SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END, lang) AS t FROM {documents}",
    "refine_label": D + "SELECT doc_id, CASE WHEN lang = 'en' THEN CASE WHEN RX(lower(text), 'tion') THEN 'Enterprise' ELSE 'Research' END ELSE lang END AS label FROM d",
    "log_amount": "SELECT o_orderkey, round(ln(1 + o_totalprice), 6) AS l1, round(log10(o_totalprice), 6) AS l10 FROM {orders} WHERE o_totalprice > 0",
    "truncate_text": "SELECT doc_id, CASE WHEN length(text) > 80 THEN concat(substr(text, 1, 80), '...') ELSE text END AS preview, substr(text, 1, 800) AS prompt FROM {documents}",
    "row_seq": "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS seq FROM {orders}",
    "norm_text": "SELECT doc_id, trim(lower(text)) AS t FROM {documents}",
    "filter_range": A + "SELECT id, conf FROM aid WHERE conf > 0.5 AND conf < 0.6",
    "filter_notnull": "SELECT doc_id FROM {documents} WHERE text IS NOT NULL AND source IS NOT NULL",
    "isin_anti": A + "SELECT id, region FROM aid WHERE NOT coalesce(region IN ('ASIA', 'EUROPE'), false)",
    "filter_nonempty": "SELECT doc_id FROM {documents} WHERE trim(text) <> ''",
    "filter_prefix": "SELECT event_id, event_type FROM {events} WHERE STARTS(event_type, 'c')",
    "having_count": "SELECT o_custkey, CAST(count(DISTINCT year(o_orderdate)) AS BIGINT) AS years FROM {orders} GROUP BY o_custkey HAVING count(DISTINCT year(o_orderdate)) > 1",
    "filter_mismatch": P + "SELECT doc_id, truth, pred FROM p WHERE truth IS DISTINCT FROM pred",
    "invariant_xor": A + "SELECT CAST(sum(CASE WHEN (class = 'AI') <> (amount > 150000) THEN 1 ELSE 0 END) AS BIGINT) AS broken FROM aid",
    # joins
    "join_left_fill0": A + ", t AS (SELECT anno, " + N + " FROM aid GROUP BY anno), u AS (SELECT anno, CAST(count(*) AS BIGINT) AS k FROM aid WHERE conf > 0.99 AND class = 'AI' GROUP BY anno) SELECT t.anno, t.n, coalesce(u.k, 0) AS k FROM t LEFT JOIN u ON t.anno = u.anno",
    "share_within_group": A + ", g AS (SELECT anno, category, " + N + " FROM aid GROUP BY anno, category) SELECT anno, category, n, round(100 * CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY anno), 6) AS pct FROM g",
    "outer_align": P + ", a AS (SELECT lang, " + N + " FROM p WHERE truth = 1 GROUP BY lang), b AS (SELECT lang, " + N + " FROM p WHERE toxic = 1 GROUP BY lang) SELECT coalesce(a.lang, b.lang) AS lang, coalesce(a.n, 0) AS good, coalesce(b.n, 0) AS toxic, coalesce(a.n, 0) + coalesce(b.n, 0) AS total FROM a FULL OUTER JOIN b ON a.lang = b.lang",
    "semi_topk": A + ", t AS (SELECT beneficiary FROM aid GROUP BY beneficiary ORDER BY sum(amount) DESC, beneficiary LIMIT 5) SELECT id, beneficiary, amount FROM aid WHERE beneficiary IN (SELECT beneficiary FROM t)",
    "anti_resume": "SELECT d.doc_id FROM {documents} d LEFT ANTI JOIN {labels} l ON d.doc_id = l.doc_id",
    "leakage_check": "SELECT CAST(count(*) AS BIGINT) AS leaks FROM {benchmark} b WHERE EXISTS (SELECT 1 FROM {documents} d WHERE d.text = b.text)",
    "positional_join": "SELECT a.rn, a.c_custkey, b.s_suppkey FROM (SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_custkey) AS BIGINT) AS rn FROM {customer}) a JOIN (SELECT s_suppkey, CAST(row_number() OVER (ORDER BY s_suppkey) AS BIGINT) AS rn FROM {supplier}) b ON a.rn = b.rn",
    "cooccurrence": "WITH t AS (SELECT DISTINCT l_orderkey AS id, l_returnflag AS f FROM {lineitem}) SELECT a.f AS f1, b.f AS f2, CAST(count(*) AS BIGINT) AS n FROM t a JOIN t b ON a.id = b.id AND a.f <= b.f GROUP BY a.f, b.f",
    "macro_map": "WITH t AS (SELECT p_partkey, EXPLODE(SPLIT(p_name, ' ')) AS w FROM {part}) SELECT CASE WHEN w < 'h' THEN 'first' WHEN w < 'q' THEN 'second' ELSE 'Other' END AS macro, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY 1",
    "multi_year_top": "SELECT o_custkey, CAST(min(year(o_orderdate)) AS INT) AS first_year, CAST(max(year(o_orderdate)) AS INT) AS last_year, CAST(count(DISTINCT year(o_orderdate)) AS BIGINT) AS years, CAST(count(*) AS BIGINT) AS n FROM {orders} GROUP BY o_custkey ORDER BY years DESC, n DESC, o_custkey LIMIT 10",
    "ext_range_join": A + ", b AS (SELECT 'low' AS band, 0 AS lo, 50000 AS hi UNION ALL SELECT 'mid', 50000, 200000 UNION ALL SELECT 'high', 200000, 100000000) SELECT band, CAST(count(*) AS BIGINT) AS n FROM aid JOIN b ON amount >= lo AND amount < hi GROUP BY band",
    # aggregations
    "count_by_year": A + f"SELECT anno, {N} FROM aid GROUP BY anno",
    "pivot_count": A + "SELECT anno, " + _pivot("CAST(sum(CASE WHEN category = '{p}' THEN 1 ELSE 0 END) AS BIGINT)") + " FROM aid GROUP BY anno",
    "pivot_pct": A + f"SELECT anno, {N}, " + _pivot("round(100 * CAST(sum(CASE WHEN category = '{p}' THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 6)", "_pct") + " FROM aid GROUP BY anno",
    "row_pct": A + ", g AS (SELECT region, class, " + N + " FROM aid GROUP BY region, class) SELECT region, class, round(100 * CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY region), 6) AS pct FROM g",
    "multi_agg": A + f"SELECT class, {N}, round(sum(amount), 2) AS total, round(avg(amount), 6) AS mean, median(amount) AS median FROM aid GROUP BY class",
    "pivot_multi_agg": A + "SELECT region, round(sum(CASE WHEN class = 'AI' THEN amount END), 2) AS sum_ai, round(avg(CASE WHEN class = 'AI' THEN amount END), 6) AS mean_ai, round(sum(CASE WHEN class <> 'AI' THEN amount END), 2) AS sum_non, round(avg(CASE WHEN class <> 'AI' THEN amount END), 6) AS mean_non FROM aid GROUP BY region",
    "pivot_sum": A + "SELECT anno, " + _pivot("round(coalesce(sum(CASE WHEN category = '{p}' THEN amount END), 0), 2)") + " FROM aid GROUP BY anno",
    "crosstab": "SELECT lang, source, CAST(count(*) AS BIGINT) AS n FROM {documents} WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY lang, source",
    "distinct_count": A + "SELECT anno, CAST(count(DISTINCT cup) AS BIGINT) AS cups, CAST(count(DISTINCT beneficiary) AS BIGINT) AS people FROM aid GROUP BY anno",
    "describe_by_group": A + f"SELECT class, {N}, round(avg(amount), 6) AS mean, round(stddev_samp(amount), 6) AS std, min(amount) AS lo, round(PCTL(amount, 0.25), 6) AS q1, round(PCTL(amount, 0.5), 6) AS q2, round(PCTL(amount, 0.75), 6) AS q3, max(amount) AS hi FROM aid GROUP BY class",
    "value_counts": A + f"SELECT category, {N} FROM aid WHERE category IS NOT NULL GROUP BY category",
    "value_counts_pct": A + ", g AS (SELECT category, " + N + " FROM aid GROUP BY category) SELECT category, round(CAST(n AS DOUBLE) / sum(n) OVER (), 6) AS share FROM g",
    "value_counts_pair": A + f"SELECT region, category, {N} FROM aid GROUP BY region, category",
    "mode_len": "WITH g AS (SELECT length(c_name) AS len, count(*) AS n FROM {customer} GROUP BY length(c_name)) SELECT CAST(len AS BIGINT) AS len, CAST(n AS BIGINT) AS n FROM g ORDER BY n DESC, len LIMIT 1",
    "quantiles": A + "SELECT class, round(PCTL(conf, 0.25), 6) AS q25, round(PCTL(conf, 0.75), 6) AS q75, round(PCTL(conf, 0.95), 6) AS q95, round(PCTL(conf, 0.99), 6) AS q99 FROM aid GROUP BY class",
    "count_if_bands": A + "SELECT CAST(count_if(conf > 0.7) AS BIGINT) AS c70, CAST(count_if(conf > 0.9) AS BIGINT) AS c90, CAST(count_if(conf > 0.99) AS BIGINT) AS c99 FROM aid",
    "count_of_counts": "SELECT CAST(count_if(k = 1) AS BIGINT) AS one, CAST(count_if(k BETWEEN 2 AND 5) AS BIGINT) AS few, CAST(count_if(k BETWEEN 6 AND 10) AS BIGINT) AS some, CAST(count_if(k BETWEEN 11 AND 50) AS BIGINT) AS many, CAST(count_if(k > 50) AS BIGINT) AS more, CAST(max(k) AS BIGINT) AS top FROM (SELECT o_custkey, count(*) AS k FROM {orders} GROUP BY o_custkey) x",
    "dup_count": "SELECT CAST(count(*) - count(DISTINCT text) AS BIGINT) AS duplicates FROM {documents}",
    "pct_ai_by_year": A + f"SELECT anno, {N}, CAST(count_if(class = 'AI') AS BIGINT) AS n_ai, round(100 * avg(CASE WHEN class = 'AI' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS pct_ai, round(sum(amount), 2) AS total, round(avg(amount), 6) AS mean, median(amount) AS median FROM aid GROUP BY anno",
    "entropy": A + ", g AS (SELECT category, count(*) AS n FROM aid GROUP BY category), q AS (SELECT CAST(n AS DOUBLE) / sum(n) OVER () AS p FROM g) SELECT round(-sum(p * log2(p)), 6) AS entropy, round(-sum(p * log2(p)) / log2(count(*)), 6) AS normalised FROM q",
    "imbalance": A + ", g AS (SELECT category, " + N + " FROM aid GROUP BY category) SELECT category, n, round(CAST(n AS DOUBLE) / max(n) OVER (), 6) AS to_major, round(max(n) OVER () / CAST(min(n) OVER () AS DOUBLE), 6) AS ratio FROM g",
    "cumulative_pct": A + ", g AS (SELECT category, " + N + " FROM aid GROUP BY category), q AS (SELECT category, n, 100 * CAST(n AS DOUBLE) / sum(n) OVER () AS pct FROM g) SELECT category, round(pct, 6) AS pct, round(sum(pct) OVER (ORDER BY n DESC, category ROWS UNBOUNDED PRECEDING), 6) AS running FROM q",
    "chi_square": A + ", c AS (SELECT region, category, count(*) AS o FROM aid GROUP BY region, category), a AS (SELECT region, count(*) AS x FROM aid GROUP BY region), b AS (SELECT category, count(*) AS y FROM aid GROUP BY category), t AS (SELECT count(*) AS n FROM aid), e AS (SELECT a.region, b.category, CAST(x AS DOUBLE) * y / n AS e FROM a CROSS JOIN b CROSS JOIN t) SELECT round(sum((coalesce(o, 0) - e) * (coalesce(o, 0) - e) / e), 6) AS chi2, CAST((count(DISTINCT e.region) - 1) * (count(DISTINCT e.category) - 1) AS BIGINT) AS dof FROM e LEFT JOIN c ON e.region = c.region AND e.category = c.category",
    "label_freq": "WITH t AS (SELECT EXPLODE(SPLIT(p_name, ' ')) AS label FROM {part}) SELECT label, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY label",
    "label_cardinality": "WITH t AS (SELECT CAST(SIZE(SPLIT(p_type, ' ')) AS BIGINT) AS k FROM {part}) SELECT k, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY k",
    "confusion_regex": P + f"SELECT {CELL} AS cell, {N} FROM p GROUP BY {CELL}",
    "confusion_unique": P + f", u AS (SELECT {CELL} AS cell, md5(text) AS h, max(conf) AS conf FROM p GROUP BY {CELL}, md5(text)) SELECT cell, {N}, round(avg(conf), 6) AS mean, round(PCTL(conf, 0.25), 6) AS q1, round(PCTL(conf, 0.75), 6) AS q3 FROM u GROUP BY cell",
    "pivot_total_row": A + f"SELECT coalesce(class, 'TOTAL') AS class, {N}, round(sum(amount), 2) AS total FROM aid GROUP BY GROUPING SETS ((class), ())",
    "histogram": A + "SELECT CAST(floor(conf * 50) AS BIGINT) AS bin, " + N + " FROM aid GROUP BY floor(conf * 50)",
    "ext_cube": A + f"SELECT coalesce(region, 'ALL') AS region, coalesce(class, 'ALL') AS class, {N} FROM aid GROUP BY CUBE (region, class)",
    "ext_rollup": A + f"SELECT coalesce(region, 'ALL') AS region, coalesce(class, 'ALL') AS class, {N} FROM aid GROUP BY ROLLUP (region, class)",
    # windows, sorts, sampling
    "topk_per_group": A + ", g AS (SELECT category, beneficiary, " + N + " FROM aid GROUP BY category, beneficiary), w AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, beneficiary) AS rn FROM g) SELECT category, beneficiary, n FROM w WHERE rn <= 3",
    "ext_rank_lag": A + ", g AS (SELECT anno, " + N + " FROM aid GROUP BY anno) SELECT anno, n, CAST(rank() OVER (ORDER BY n DESC) AS BIGINT) AS r, n - lag(n) OVER (ORDER BY anno) AS change FROM g",
    "topn_groups": A + f"SELECT beneficiary, {N}, round(sum(amount), 2) AS total FROM aid GROUP BY beneficiary ORDER BY total DESC, beneficiary LIMIT 20",
    "topk_long_text": "SELECT doc_id, CAST(length(text) AS BIGINT) AS len, substr(text, 1, 80) AS preview FROM {documents} ORDER BY len DESC, doc_id LIMIT 10",
    "lowconf_unique_top20": P + "SELECT md5(text) AS h, min(conf) AS conf FROM p GROUP BY md5(text) ORDER BY conf, h LIMIT 20",
    "head_per_outcome": P + f", w AS (SELECT {CELL} AS cell, doc_id, row_number() OVER (PARTITION BY {CELL} ORDER BY doc_id) AS rn FROM p) SELECT cell, doc_id FROM w WHERE rn <= 5",
    "sample_n": f"SELECT doc_id FROM {{documents}} ORDER BY {_h('doc_id')}, doc_id LIMIT 100",
    "stratified_oversample": "WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n FROM {documents}), g AS (SELECT lang, max(n) AS n FROM r GROUP BY lang), s AS (SELECT lang, n, EXPLODE(SEQ500) AS i FROM g), t AS (SELECT lang, i, PICK % n AS k FROM s) SELECT t.lang, CAST(t.i AS BIGINT) AS i, r.doc_id FROM t JOIN r ON t.lang = r.lang AND t.k = r.k",
    "shuffle_hash": f"SELECT doc_id, CAST(row_number() OVER (ORDER BY {_h('doc_id')}, doc_id) AS BIGINT) AS place FROM {{documents}}",
    "balance_topup": P + f", c AS (SELECT count_if(truth = 1) AS a, count_if(truth = 0) AS b FROM p), pool AS (SELECT d.doc_id, row_number() OVER (ORDER BY {_h('d.doc_id')}, d.doc_id) AS rn FROM {{documents}} d LEFT ANTI JOIN {{labels}} l ON d.doc_id = l.doc_id) SELECT pool.doc_id FROM pool CROSS JOIN c WHERE rn <= abs(a - b)",
    "chunk_assign": "SELECT o_orderkey, CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 1000) AS BIGINT) AS chunk FROM {orders}",
    "per_class_filename": "SELECT doc_id, concat(lang, '_desc_', lpad(CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS VARCHAR(20)), 5, '0'), '.txt') AS file FROM {documents}",
    "dedup_last": "WITH w AS (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) AS rn FROM {documents}) SELECT doc_id FROM w WHERE rn = 1",
    # sets
    "union_all": "SELECT doc_id AS id, 'doc' AS kind, lang AS note FROM {documents} UNION ALL SELECT item_id, 'bench', CAST(NULL AS VARCHAR(5)) FROM {benchmark}",
    "except_categories": A + "SELECT DISTINCT category FROM aid EXCEPT SELECT DISTINCT category FROM aid WHERE amount > 400000",
    # text and cleaning
    "text_len_stats": "SELECT lang, round(avg(length(text)), 6) AS mean, round(stddev_samp(length(text)), 6) AS std, CAST(max(length(text)) AS BIGINT) AS top FROM {documents} GROUP BY lang",
    "word_count": "SELECT doc_id, CASE WHEN trim(RXREPLACE(text, '[ \t\n\r]+', ' ')) = '' THEN 0 ELSE CAST(SIZE(SPLIT(trim(RXREPLACE(text, '[ \t\n\r]+', ' ')), ' ')) AS BIGINT) END AS words FROM {documents}",
    "truncated_by_label": "WITH t AS (SELECT lang, CASE WHEN n_chars > 1000 THEN concat(substr(text, 1, 80), '...') ELSE text END AS x FROM {documents}) SELECT lang, CAST(count_if(ENDS(x, '...')) AS BIGINT) AS cut, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY lang",
    "sector_letter": "SELECT p_partkey, upper(substr(p_type, 1, 1)) AS letter FROM {part}",
    "sector_extract": "SELECT p_partkey, nullif(regexp_extract(p_type, '([A-Z])', 1), '') AS letter FROM {part}",
    "code_valid": "WITH t AS (SELECT CASE WHEN c_custkey % 5 = 0 THEN '0000' ELSE concat('C', lpad(CAST(c_custkey AS VARCHAR(20)), 14, '0')) END AS cup FROM {customer}) SELECT CAST(count_if(RX(cup, '^[A-Z0-9]{15}$')) AS BIGINT) AS valid, CAST(count_if(NOT RX(cup, '^[A-Z0-9]{15}$')) AS BIGINT) AS invalid, CAST(min(length(cup)) AS BIGINT) AS lo, CAST(max(length(cup)) AS BIGINT) AS hi FROM t",
    "date_format_audit": A + ", t AS (SELECT concat(CAST(day AS VARCHAR(10)), CASE WHEN id % 2 = 0 THEN '+02:00' ELSE '' END) AS x FROM aid) SELECT CASE WHEN RX(x, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN 'pure' WHEN RX(x, '[+-][0-9]{2}:[0-9]{2}$') THEN 'tz' ELSE 'other' END AS shape, " + N + " FROM t GROUP BY 1",
    "strip_tz": A + "SELECT id, RXREPLACE(concat(CAST(day AS VARCHAR(10)), CASE WHEN id % 2 = 0 THEN '+02:00' ELSE '' END), '[+-][0-9]{2}:[0-9]{2}$', '') AS day FROM aid",
    "clean_text": "SELECT doc_id, replace(RXREPLACE(concat('\"', text, '\"'), '[\r\n]+', ' '), '\"', '''') AS t FROM {documents}",
    "non_ascii_audit": "SELECT lang, CAST(count_if(RX(text, '[^ -~\n\r\t]')) AS BIGINT) AS n, round(avg(CASE WHEN RX(text, '[^ -~\n\r\t]') THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS share FROM {documents} GROUP BY lang",
    "delimiter_audit": "SELECT CAST(count_if(contains(text, ',')) AS BIGINT) AS commas, CAST(count_if(contains(text, ';')) AS BIGINT) AS semis, CAST(count_if(contains(text, '\"')) AS BIGINT) AS quotes, CAST(count_if(contains(text, '\n')) AS BIGINT) AS newlines FROM {documents}",
    "multival_dup_count": f"WITH {MULTI} SELECT CAST(count_if(SIZE(SPLIT(flags, SEP)) <> SIZE(ADISTINCT(SPLIT(flags, SEP)))) AS BIGINT) AS dups FROM m",
    "md5_key": "SELECT doc_id, md5(text) AS h FROM {documents}",
    "concat_text": "SELECT doc_id, concat_ws(' ', source, lang) AS both_, CASE WHEN doc_id % 2 = 0 THEN source END || lang AS loose FROM {documents}",
    "numeric_audit": "WITH t AS (SELECT CASE WHEN o_orderkey % 50 = 0 THEN 'x' ELSE CAST(o_totalprice AS VARCHAR(30)) END AS v FROM {orders}) SELECT CAST(count_if(v IS NOT NULL AND TRYDOUBLE(v) IS NULL) AS BIGINT) AS bad, CAST(count_if(TRYDOUBLE(v) < 0) AS BIGINT) AS negative, min(TRYDOUBLE(v)) AS lo, max(TRYDOUBLE(v)) AS hi, CAST(count_if(TRYDOUBLE(v) > 1000000000000000) AS BIGINT) AS huge FROM t",
    "null_counts": "SELECT CAST(count(*) - count(doc_id) AS BIGINT) AS doc_id, CAST(count(*) - count(text) AS BIGINT) AS text, CAST(count(*) - count(lang) AS BIGINT) AS lang, CAST(count(*) - count(source) AS BIGINT) AS source, CAST(count(*) - count(n_chars) AS BIGINT) AS n_chars, CAST(count(*) - count(doc_id) + count(*) - count(text) + count(*) - count(lang) + count(*) - count(source) + count(*) - count(n_chars) AS BIGINT) AS total FROM {documents}",
    "mojibake_by_year": "SELECT lang, round(avg(CASE WHEN contains(text, 'Ã') THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS share FROM {documents} GROUP BY lang",
    # nested
    "array_join_pipe": "SELECT p_partkey, AJOIN(SPLIT(p_name, ' '), '|') AS labels FROM {part}",
    "label_vocab": "WITH t AS (SELECT DISTINCT EXPLODE(SPLIT(p_name, ' ')) AS w FROM {part}) SELECT AJOIN(ASORT(COLLECT(w)), '|') AS vocabulary FROM t",
    # metrics
    "outcome_flags": P + "SELECT doc_id, truth = 1 AND pred = 1 AS tp, truth = 0 AND pred = 0 AS tn, truth = 0 AND pred = 1 AS fp, truth = 1 AND pred = 0 AS fn FROM p",
    "confusion_multi": P + f"SELECT truth, pred, {N} FROM p GROUP BY truth, pred",
    "accuracy": P + "SELECT round(avg(CASE WHEN truth = pred THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS accuracy FROM p",
    "accuracy_by_class": P + f"SELECT truth, {N}, round(avg(CASE WHEN truth = pred THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS accuracy FROM p GROUP BY truth",
    "confusion_conf_stats": P + f"SELECT {CELL} AS cell, round(avg(conf), 6) AS mean, round(PCTL(conf, 0.25), 6) AS q1, round(PCTL(conf, 0.75), 6) AS q3 FROM p GROUP BY {CELL}",
    "error_slices": P + f"SELECT doc_id, {CELL} AS cell, conf FROM p WHERE truth <> pred AND conf > 0.9",
    "clean_merge": P + f"SELECT doc_id, {CELL} AS cell FROM p WHERE truth = pred UNION ALL SELECT item_id, 'BENCH' FROM {{benchmark}}",
    # sinks, json, events
    "export_year_counts": A + f"SELECT coalesce(CAST(anno AS VARCHAR(5)), 'all') AS part, {N} FROM aid GROUP BY GROUPING SETS ((anno), ())",
    "ext_sliding": "WITH t AS (SELECT event_type, value, EXPLODE(HALVES) AS start FROM {events}) SELECT start, event_type, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY start, event_type",
}

#: What neither engine can say in the other's words: name -> (Spark, DuckDB).
_WORDS = {
    "SEQ500": ("sequence(1, 500)", "range(1, 501)"),
    "PICK": ("CAST(conv(substr(md5(concat(lang, '-', CAST(i AS STRING))), 1, 8), 16, 10) AS BIGINT)", "CAST('0x' || substr(md5(concat(lang, '-', CAST(i AS VARCHAR))), 1, 8) AS BIGINT)"),
    "SEP": ("'[|]'", "'|'"),
    "HALVES": ("array(date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR)", "[date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]"),
    "LEFT ANTI JOIN": ("LEFT ANTI JOIN", "ANTI JOIN"),
}


def _words(text: str, duck: bool) -> str:
    for k, v in _WORDS.items():
        text = text.replace(k, v[duck])
    return text


def _orders(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet")


def _docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def _r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _predicted(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    return labels.join(_docs(spark, sf).select("doc_id", "n_chars"), "doc_id").select((F.col("quality") == 1).alias("t"), (F.col("n_chars") > 1500).alias("p"))


def _tumbling(spark, sf):
    from grantmill.streaming.windows import tumbling

    return _r6(tumbling(spark.read.parquet(f"{sf}/events.parquet")), "total")


def _sessions(spark, sf):
    from grantmill.streaming.windows import sessions

    return sessions(spark.read.parquet(f"{sf}/events.parquet"))


_GINI = "WITH v AS (SELECT o_orderpriority AS g, o_totalprice AS v, row_number() OVER ({p}ORDER BY o_totalprice) AS i FROM orders WHERE o_totalprice > 0) SELECT {s}round((2 * sum(i * v) - (count(*) + 1) * sum(v)) / (count(*) * sum(v)), 6) AS gini, count(*) AS n FROM v{e}"
#: DataFrame operators with their DuckDB statement.
FRAMES = {
    "gini_global": (lambda s, d: _r6(inequality.gini(_orders(s, d), "o_totalprice"), "gini"), _GINI.format(p="", s="", e="")),
    "gini_by_group": (lambda s, d: _r6(inequality.gini(_orders(s, d).withColumnRenamed("o_orderpriority", "g"), "o_totalprice", ["g"]), "gini"), _GINI.format(p="PARTITION BY o_orderpriority ", s="g, ", e=" GROUP BY g")),
    "lorenz": (lambda s, d: _r6(inequality.lorenz(_orders(s, d), "o_totalprice"), "x", "y"), "WITH v AS (SELECT o_totalprice AS v, count(*) AS n FROM orders WHERE o_totalprice > 0 GROUP BY 1) SELECT round(sum(n) OVER w / sum(n) OVER (), 6) AS x, round(sum(n * v) OVER w / sum(n * v) OVER (), 6) AS y FROM v WINDOW w AS (ORDER BY v ROWS UNBOUNDED PRECEDING) UNION ALL SELECT 0, 0"),
    "dedup_first": (lambda s, d: sampling.dedup(_docs(s, d).select("doc_id", "text"), ["text"], ["doc_id"]).select("doc_id"), "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text"),
    "stratified_cap": (lambda s, d: sampling.stratified_cap(_docs(s, d).select("doc_id", "lang"), "lang", 40, "doc_id"), "SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '-42'), doc_id) <= 40"),
    "train_test_split": (lambda s, d: sampling.train_test_split(_docs(s, d).select("doc_id"), "doc_id"), "SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || '-42'), doc_id) <= ceil(0.1 * count(*) OVER ()) AS is_test FROM documents"),
    "prf_binary": (lambda s, d: _r6(metrics.binary_report(_predicted(s, d), "t", "p"), "accuracy", "precision", "recall", "f1"), "WITH p AS (SELECT quality = 1 AS t, n_chars > 1500 AS p FROM labels JOIN documents USING (doc_id)), c AS (SELECT count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND NOT p) AS tn FROM p) SELECT *, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS \"precision\", round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c"),
    "class_report": (lambda s, d: _r6(metrics.class_report(_predicted(s, d), "t", "p"), "precision", "recall", "f1"), "WITH p AS (SELECT quality = 1 AS t, n_chars > 1500 AS p FROM labels JOIN documents USING (doc_id)), l AS (SELECT unnest([true, false]) AS label), c AS (SELECT label, count(*) FILTER (t = label) AS s, count(*) FILTER (p = label) AS q, count(*) FILTER (t = label AND p = label) AS k FROM p, l GROUP BY label) SELECT label, round(k / q, 6) AS \"precision\", round(k / s, 6) AS recall, round(2 * k / (s + q), 6) AS f1, s AS support FROM c"),
    "ext_tumbling": (_tumbling, "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2"),
    "ext_session": (_sessions, "WITH a AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM a) SELECT user_id, min(ts) AS start, count(*) AS n FROM b GROUP BY user_id, k"),
    "ext_json": (lambda s, d: s.read.parquet(f"{d}/events.parquet").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n")), "SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1"),
    "json_label_parse": (lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", F.coalesce(F.get_json_object("props", "$.k"), "props").alias("label")), "SELECT event_id, coalesce(json_extract_string(props, '$.k'), props) AS label FROM events"),
    "to_json_records": (lambda s, d: s.read.parquet(f"{d}/region.parquet").select("r_regionkey", F.to_json(F.struct("r_regionkey", "r_name")).alias("json")), "SELECT r_regionkey, to_json({'r_regionkey': r_regionkey, 'r_name': r_name})::VARCHAR AS json FROM region"),
    "json_roundtrip": (lambda s, d: s.read.parquet(f"{d}/nation.parquet").select(F.from_json(F.to_json(F.struct("n_nationkey", "n_name")), "n_nationkey int, n_name string").alias("x")).select("x.*"), "SELECT n_nationkey, n_name FROM nation"),
    "parse_list_literal": (lambda s, d: _parse_list(s, d), "SELECT p_partkey, array_to_string(list_sort(list_distinct(string_split(lower(p_name), ' '))), '|') AS labels FROM part"),
    "format_euro": (lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.concat(F.lit("€ "), F.format_number(F.col("p_size").cast("double"), 2)).alias("size")), "SELECT p_partkey, '€ ' || format('{:,.2f}', p_size::DOUBLE) AS size FROM part"),
    "colname_audit": (lambda s, d: _colnames(s, d), "SELECT column_name AS name, length(column_name) <= 32 AND NOT regexp_matches(column_name, '^[0-9]') AND regexp_full_match(column_name, '[A-Za-z0-9_]+') AS valid FROM (DESCRIBE documents)"),
}


def _parse_list(spark, sf):
    from grantmill.functions.text import parse_list_literal

    quoted = F.concat(F.lit("['"), F.regexp_replace(F.initcap("p_name"), " ", "', '"), F.lit("']"))
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", parse_list_literal(quoted).alias("labels"))


def _colnames(spark, sf):
    rows = [(c, len(c) <= 32 and not c[0].isdigit() and c.replace("_", "a").isalnum() and c.isascii()) for c in _docs(spark, sf).columns]
    return spark.createDataFrame(rows, "name string, valid boolean")


def _run(name, spark, sf_dir):
    return spark_sql(spark, sf_dir, _words(QUERIES[name], False))


def queries() -> dict:
    return {k: partial(_run, k) for k in QUERIES} | SPREAD | {k: v[0] for k, v in (FRAMES | LIBRARY).items()}


def oracle_sql() -> dict[str, str]:
    return {k: duck_sql(_words(v, True)) for k, v in QUERIES.items()} | {k: v[1] for k, v in (FRAMES | LIBRARY).items()}
