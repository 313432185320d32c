"""Quality rules: base features of a text and cross-document line frequency.

DataFrame functions only. Null and empty texts have no words: all counts are 0 and the
base rules reject them. Rows are judged one by one; repeated rows get equal results. Extra columns may have
any name; computed columns replace input columns so named.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantmill.llm.common import WORD_SPLIT, WS, guarded, saved, with_columns

SYMBOLS = "#*$%&|<>"
#: A line is removed when it stands in at least MIN_DOCS distinct documents of its host and in more
#: than MAX_SHARE of the host's documents; a document is depleted when removal leaves it less than
#: MIN_LEFT of its words.
MIN_DOCS, MAX_SHARE, MIN_LEFT = 5, 0.005, 0.3

BROADCAST_ROWS = 300_000

_WORDS = rf"filter(split(coalesce(text, ''), '{WORD_SPLIT}'), w -> w != '')".replace("\\", "\\\\")
_WINDOW = ", ".join(f"get(h, i + {k})" for k in range(8))
#: Words in 8-word windows that occur twice or more. Most texts end at the first test; the others sort
#: their windows by hash, take those with an equal neighbour and add up the stretches they cover.
_REPEATS = f"""
CASE WHEN size(ws) < 8 THEN 0L ELSE
element_at(transform(array(transform(ws, w -> xxhash64(w))), h ->
  element_at(transform(array(transform(sequence(0, size(h) - 8), i -> xxhash64({_WINDOW}))), g ->
    CASE WHEN size(array_distinct(g)) = size(g) THEN 0L ELSE
      element_at(transform(array(array_sort(transform(g, (x, i) -> struct(x AS h, i AS i)))), s ->
        element_at(transform(array(array_sort(transform(filter(s, (e, j) ->
            coalesce(get(s, j - 1).h = e.h, false) OR coalesce(get(s, j + 1).h = e.h, false)), e -> e.i))), p ->
          aggregate(transform(p, (x, j) -> least(8, coalesce(get(p, j + 1), x + 8) - x)), 0L, (a, b) -> a + b)), 1)), 1) END), 1)), 1) END"""
_FEATURES = f"element_at(transform(array({_WORDS}), ws -> struct(CAST(size(ws) AS BIGINT) AS n_words, {_REPEATS} AS n_repeat_words)), 1)"
_DUP_LINES = r"""element_at(transform(array(filter(split(coalesce(text, ''), '\n'), l -> l RLIKE '[^\\x20\\x09-\\x0D]')), ls -> CAST(size(ls) - size(array_distinct(ls)) AS BIGINT)), 1)"""


def features(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce("text", F.lit(""))
    df = with_columns(docs, {
        "_f": F.expr(_FEATURES),
        "word_chars": F.length(F.translate(text, WS, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": F.expr(_DUP_LINES),
    })
    df = with_columns(df, {"n_words": F.col("_f.n_words"), "n_repeat_words": F.col("_f.n_repeat_words")}).drop("_f")
    return with_columns(df, {"base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))})


def lines(docs: DataFrame) -> DataFrame:
    """Each line that has a word: its document, host, place, number of words, key and the document's class.

    The key is the hash of the lower-cased, trimmed line with digits as 0. The class is the hash of all the
    document's keys in order: documents whose whole normalised texts are equal are one distinct document, so a
    group of exact copies doesn't make its own lines frequent.
    """
    keyed = (
        docs.select(F.col("doc_id"), F.col("source").alias("host"), F.xxhash64("text").alias("text_hash"), F.split(F.coalesce("text", F.lit("")), "\n").alias("ls"))
        .select("doc_id", "host", "text_hash", F.transform("ls", lambda line: F.substring(F.md5(F.translate(F.lower(F.trim(line, F.lit(WS))), "0123456789", "0000000000")), 1, 16)).alias("keys"), "ls")
        .select("doc_id", "host", "text_hash", F.xxhash64("keys").alias("class"), F.posexplode(F.arrays_zip("keys", "ls")).alias("place", "e"))
        .select("doc_id", "host", "text_hash", "class", "place", F.col("e.keys").alias("key"), F.trim("e.ls", F.lit(WS)).alias("line"))
        .where(F.length("line") > 0)
    )
    return keyed.select("doc_id", "host", "text_hash", "place", "key", "class", F.size(F.split("line", WORD_SPLIT)).cast("long").alias("words"))


def frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """(host, key) of the lines above the limits. Distinct documents are counted in two steps, so that a
    very common line is spread over all tasks before its count is added up."""
    counts = lines(docs).select("host", "key", "class").distinct().groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    hosts = docs.groupBy(F.col("source").alias("h")).agg(F.count("*").alias("host_docs"))
    return counts.join(hosts, counts["host"].eqNullSafe(hosts["h"])).where(F.col("n") > max_share * F.col("host_docs")).select("host", "key")


def _found(docs: DataFrame, min_docs: int, max_share: float) -> DataFrame:
    """The places and words of the frequent lines of each document that has any."""
    frequent = frequent_lines(docs, min_docs, max_share).select(F.col("host").alias("fh"), F.col("key").alias("fk"))
    own = lines(docs)
    return (
        own.join(frequent, (own["key"] == frequent["fk"]) & own["host"].eqNullSafe(frequent["fh"]), "left_semi")
        .groupBy("doc_id", "text_hash", "host", "place").agg(F.first("words").alias("words"))
        .groupBy(F.col("doc_id").alias("rd"), F.col("text_hash").alias("rt"), F.col("host").alias("rh")).agg(F.sum("words").alias("_words"), F.collect_list("place").alias("_places"))
    )


def _judged(docs: DataFrame, min_docs: int, max_share: float, min_left: float, with_places: bool) -> DataFrame:
    found = _found(docs, min_docs, max_share)
    if not with_places:
        found = found.drop("_places")
    else:  # texts stay where they are while the documents with such lines are few enough to send to all
        found = saved(found)
        found = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    df = with_columns(features(docs), {"_t": F.xxhash64("text")})
    df = df if with_places else df.drop("text")
    df = df.join(found, df["doc_id"].eqNullSafe(found["rd"]) & (df["_t"] == found["rt"]) & df["source"].eqNullSafe(found["rh"]), "left").drop("rd", "rt", "rh", "_t")
    df = with_columns(df, {"n_removed_words": F.coalesce("_words", F.lit(0).cast("long"))}).drop("_words")
    return with_columns(df, {"kept": ~F.col("base_failed") & (F.col("n_words") - F.col("n_removed_words") >= min_left * F.col("n_words"))})


@guarded("doc_id", "text", "source")
def quality(docs: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """docs without text, with the features, base_failed, n_removed_words and kept."""
    return _judged(docs, min_docs, max_share, min_left, False)


@guarded("doc_id", "text", "source")
def judged(docs: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """docs with the same columns, their texts without the lines above the limits."""
    df = _judged(docs, min_docs, max_share, min_left, True)
    left = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("_places", i)), "\n")
    return with_columns(df, {"text": F.when(F.col("_places").isNull(), F.col("text")).otherwise(left)}).drop("_places")


def op7(spark, sf_dir):
    from grantmill.llm.common import table

    out = quality(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", "kept")


_TRIM = r"trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
dup AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM dup) GROUP BY doc_id),
l0 AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM d),
dl AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM l0 WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
l1 AS (SELECT doc_id, source, place, {_TRIM} AS t, substr(md5(translate(lower({_TRIM}), '0123456789', '0000000000')), 1, 16) AS key FROM l0),
ks AS (SELECT doc_id, md5(string_agg(key, ',' ORDER BY place)) AS class FROM l1 GROUP BY doc_id),
l2 AS (SELECT l1.*, class FROM l1 JOIN ks USING (doc_id) WHERE t <> ''),
hosts AS (SELECT source, count(*) AS n FROM d GROUP BY source),
freq AS (SELECT l2.source, key FROM l2 JOIN hosts ON l2.source IS NOT DISTINCT FROM hosts.source GROUP BY l2.source, key, hosts.n
  HAVING count(DISTINCT class) >= {MIN_DOCS} AND count(DISTINCT class) > {MAX_SHARE} * hosts.n),
gone AS (SELECT doc_id, sum(len(string_split_regex(t, '[\x20\x09-\x0D]+'))) AS n FROM l2 JOIN freq ON l2.key = freq.key AND l2.source IS NOT DISTINCT FROM freq.source GROUP BY doc_id),
f AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words,
  length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  coalesce(dl.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_removed_words
  FROM d JOIN w USING (doc_id) LEFT JOIN dl USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed, n_removed_words,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - n_removed_words >= {MIN_LEFT} * n_words AS kept
FROM f
"""
