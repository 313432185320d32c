"""The corpus pipeline: quality rules, line dedup, near copies, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written and read again before the
next one. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from grantmill.llm import bpe, common, line_dedup, mixing, ngram_join, quality

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df):
    """The columns of documents, n_chars after the text as it is now."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark, docs, sf_dir):
    """Rejected documents go; the others lose the lines above the limits."""
    flat = quality.judged(docs)
    return _documents(flat.where("kept"))


def line_dedup_stage(spark, docs, sf_dir):
    return _documents(line_dedup.dedup_lines(docs.select(*COLUMNS)))


def near_copies(spark, docs, sf_dir):
    """The document with the least doc_id of each group stays."""
    return ngram_join.without_near_copies(docs.select(*COLUMNS))


def mixing_stage(spark, docs, sf_dir):
    """Each document as often as the mix takes it."""
    docs = docs.select(*COLUMNS)
    return mixing.repeated(docs, mixing.mix(docs.select("doc_id", "source", "text")))


def encoding(spark, docs, sf_dir):
    return bpe.digests(docs.select("doc_id", "source", "text"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", near_copies),
    ("mixing", mixing_stage),
    ("byte-level BPE", encoding),
]

#: Groups of near copies and merges of byte pairs are beyond a practical SQL statement; tests/llm/test_pipeline.py
#: tests properties of each stage's rows, the operators have brute-force versions or SQL of their own.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages over documents, each read from what the one before has written in the shared folder."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
