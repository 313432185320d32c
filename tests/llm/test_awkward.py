"""Every operator with extra columns of its own internal names, with nulls, ties, repeated rows and an empty table."""

import collections

import pytest
from pyspark.sql import functions as F

from grantmill.llm import bpe, html_text, katz, licenses, line_dedup, media, mixing, ngram_join, quality, urls

LINE = "a line that is long enough to be looked at, and the same in all of these"
NAMES = "_f _t _words _places rd rt rh _slice _s _d _u _p _rank _cut below above _gone _h _c _n n rep node _dir _near _digest place col key keys class host hosts words items digest media caption text_hash Text TEXT blocked labels extra__0 extra__1 x x".split()
extra = lambda: [F.lit(f"own {i}").alias(n) for i, n in enumerate(NAMES)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"{LINE}\n" + " ".join(f"{'abcdefgh'[i % 8]}{k}q" for k in range(30)), "s1") for i in range(8)]
    rows += [(7, rows[7][1], "s1"), (7, "other text of the same document", "s1"), (0, None, None), (None, None, None), (None, "", "s2"), (9, " \n\t", "s2")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).cache()


OPERATORS = {
    "quality": lambda d: quality.quality(d),
    "judged": lambda d: quality.judged(d),
    "mix": lambda d: mixing.mix(d),
    "repeated": lambda d: mixing.repeated(d, mixing.mix(d)),
    "lines": lambda d: line_dedup.dedup_lines(d),
    "lines on shards": lambda d: line_dedup.dedup_lines(d, broadcast_bytes=0, shard_keys=1),
    "store": lambda d: media.store(d),
    "sequences": lambda d: media.sequences(d, html="text"),
    "resolve": lambda d: media.resolve(media.sequences(d.withColumn("html", F.lit("<p>a<img src='media:1' alt=b>")), html="html"), media.read_back(media.store(d))),
    "digests": lambda d: bpe.digests(d),
    "licenses": lambda d: licenses.inherit(licenses.own_licenses(d.withColumn("path", F.concat_ws("/", "source", "doc_id")))),
    "urls": lambda d: urls.judge(d.withColumn("url", F.concat(F.lit("http://h.com/en/"), "doc_id"))),
    "html": lambda d: html_text.extract(d, html="text"),
    "near copies": lambda d: ngram_join.without_near_copies(d),
}


def _rows(df, columns):
    at = [df.columns.index(c) for c in columns]
    return collections.Counter(repr([r[i] for i in at]) for r in df.collect())


@pytest.mark.parametrize("name", list(OPERATORS))
def test_extra_columns_and_empty_table(docs, name):
    plain = OPERATORS[name](docs)
    wide = OPERATORS[name](docs.select("*", *extra()))
    assert _rows(wide, plain.columns) == _rows(plain, plain.columns)
    computed = {c.lower() for c in plain.columns}
    for i, n in enumerate(NAMES):
        if n.lower() not in computed and n != "x" and n.lower() not in ("text", "html", "items"):
            at = wide.columns.index(n)
            assert {r[at] for r in wide.collect()} <= {f"own {i}"}, n
            break
    assert [c for c in wide.columns if c == "x"] == ["x", "x"]
    empty = OPERATORS[name](docs.where("false").select("*", *extra()))
    assert empty.count() == 0 and empty.columns == wide.columns


def test_a_document_is_counted_once_for_a_line(spark):
    rows = [(1, LINE)] * 3 + [(2, LINE)] * 2
    for bound in (line_dedup.BROADCAST_BYTES, 0):
        assert {r.n_dropped for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), broadcast_bytes=bound).collect()} == {0}
        more = spark.createDataFrame(rows + [(i, LINE) for i in (3, 4, 5, 5, None)], "doc_id long, text string")
        assert collections.Counter(r.n_dropped for r in line_dedup.dedup_lines(more, broadcast_bytes=bound).collect()) == {1: 8, 0: 2}


@pytest.mark.parametrize("texts", [["a b c"], ["", None, ""], [" ".join(f"w{i}_{k}" for k in range(60)) for i in range(61)], ["one two three", "", "four"], ["same text", "same text"]])
def test_katz_on_small_corpora(spark, texts):
    """Chunks without rare pairs, without frequent ones, of empty texts alone."""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = katz.score(df).collect()
    assert len(got) == len(texts)
    assert sum(r.n_tokens for r in got) == sum(len((t or "").split()) + 1 for t in texts)
    assert all(r.score < 0 and r.base_score <= 0 for r in got)


def test_katz_tells_null_from_zero(spark):
    got = katz.score(spark.createDataFrame([(0, "a b"), (None, "a b"), (0, "a b"), (1, "a")], "doc_id long, text string")).collect()
    assert collections.Counter(r.doc_id for r in got) == {0: 2, None: 1, 1: 1}


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from grantmill.llm import common

    conf = SimpleNamespace(get=lambda *_: "")
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://h:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(SimpleNamespace(conf=conf, sparkContext=context))
