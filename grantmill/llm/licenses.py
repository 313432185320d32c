"""License scans: TF-IDF cosine of headers and licence files to templates, then inheritance by directory.

Every file is compared whole, whatever its length, to the texts in license_texts and to the notices. Headers are
its lines, the sentences in them, and up to WINDOW lines in a row with the sentences in those, for notices that
wrap; they are compared to the notices. A file is its directory's licence file if it matches as a whole, or if it
has a licence and a name such as LICENSE or COPYING. A file without a licence of its own takes the licence of the
nearest ancestor directory that has one (the most frequent there, ties by the greatest name). Idf comes from the
number of documents of the whole corpus that hold each template term, a table no longer than the templates'
vocabulary. Null and empty texts have no licence of their own; a null path is the root.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from importlib import resources

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grantmill.llm.common import guarded, map_arrow, saved, table

#: Usual wordings of licence notices.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("proprietary", "All rights reserved."),
)
#: Whole licence files by name, in their published wording.
FILES = tuple((f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in sorted(resources.files(__package__).joinpath("license_texts").iterdir(), key=lambda f: f.name) if f.name.endswith(".txt"))
COSINE, WINDOW = 0.8, 3
#: Names of licence files, for a file whose licence is only named in it.
FILE_NAMES = r"(?i)^(un)?(licen[cs]e|copying|notice)s?([._-].*)?$"
BROADCAST_BYTES, SALTS = 16 << 20, 64
_SENTENCE = re.compile(r"(?<=[.!?;])[ \t\n\x0b\x0c\r]+")
_TERM = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")


def terms(text: str) -> Counter:
    return Counter(_TERM.findall(text.lower()))


VOCABULARY = frozenset(t for _, text in NOTICES + FILES for t in terms(text))


def document_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """term, df over all documents for the templates' terms; each batch sends one row a term at most."""

    def run(batches):
        for b in batches:
            df = Counter(t for x in b.column(0) for t in VOCABULARY.intersection(_TERM.findall((x.as_py() or "").lower())))
            if df:
                yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.string()), pa.array(list(df.values()), pa.int64())], ["term", "df"])

    return map_arrow(docs.select(F.col(f"`{text}`")), run, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


class Matcher:
    """Sparse TF-IDF cosine to the templates. Terms outside the vocabulary have the idf of an unseen term."""

    def __init__(self, df: dict[str, int], n_docs: int, cosine: float):
        self.cosine = cosine
        self.other = math.log(1 + n_docs) + 1
        self.idf = {t: math.log((1 + n_docs) / (1 + df.get(t, 0))) + 1 for t in VOCABULARY}
        self.notices, self.all = self._rows(NOTICES), self._rows(NOTICES + FILES)
        # a header can only reach the cosine if it has a term that isn't among the lightest ones: those together stay below it
        own = {t for _, w, _ in self.notices for t in w}
        common = set(own)
        for _, w, norm in self.notices:
            left = 0.0
            for t in sorted(w, key=lambda t: (w[t], t)):
                left += w[t] * w[t]
                if left >= (cosine * norm) ** 2 * (1 - 1e-9):
                    common.discard(t)
        self.needed = re.compile("|".join(sorted(map(re.escape, own - common), key=len, reverse=True)), re.I)

    def _rows(self, templates) -> list[tuple[str, dict[str, float], float]]:
        weights = [(name, {t: c * self.idf[t] for t, c in terms(text).items()}) for name, text in templates]
        return [(name, w, math.sqrt(sum(x * x for x in w.values()))) for name, w in weights]

    def best(self, text: str, rows: list) -> tuple[str | None, float]:
        """The template that reaches the cosine and is nearest, the first of equals."""
        found = terms(text)
        norm = math.sqrt(sum((c * self.idf.get(t, self.other)) ** 2 for t, c in found.items()))
        known = {t: c * self.idf[t] for t, c in found.items() if t in self.idf}
        top = (None, 0.0)
        if math.sqrt(sum(x * x for x in known.values())) < self.cosine * norm * (1 - 1e-9):
            return top  # too much of the text is in no template at all
        for name, w, size in rows:
            few, many = (known, w) if len(known) < len(w) else (w, known)
            score = sum(x * many[t] for t, x in few.items() if t in many) / (norm * size) if norm else 0.0
            if score >= self.cosine and score > top[1]:
                top = (name, score)
        return top

    def headers(self, text: str) -> Iterator[tuple[int, str]]:
        """(number of the first line, header) of all headers that can match a notice."""
        if not self.needed.search(text):
            return
        lines = text.split("\n")
        hits = [i for i, line in enumerate(lines) if self.needed.search(line)]
        for width in range(1, WINDOW + 1):
            for start in sorted({s for i in hits for s in range(max(0, i - width + 1), i + 1) if s + width <= len(lines)}):
                whole = "\n".join(lines[start : start + width])
                yield start, whole
                parts = _SENTENCE.split(whole)
                yield from ((start, x) for x in parts if len(parts) > 1 and self.needed.search(x))

    def scan(self, text: str) -> tuple[str | None, float, int | None, bool]:
        """Licence, cosine, number of the header's first line (null: the whole text), whether the whole text matches."""
        name, score = self.best(text, self.all)
        if name:  # its own headers, such as a reserved right, don't overrule the whole text
            return name, score, None, True
        top = (None, 0.0, None)
        for at, header in self.headers(text):
            found = self.best(header, self.notices)
            if found[1] > top[1] + 1e-12:
                top = (*found, at)
        return (*top, False)


@guarded(named=("text",))
def own_licenses(files: DataFrame, cosine: float = COSINE, text: str = "text") -> DataFrame:
    """files without the text, with own_license, cosine, line_no and is_license_file (the whole text matches)."""
    df = {r.term: r.df for r in document_frequencies(files, text).collect()}  # at most the templates' vocabulary
    matcher_args = (df, files.count(), cosine)
    rest = [c for c in files.columns if c.lower() not in (text.lower(), "own_license", "cosine", "line_no", "is_license_file")]
    schema = T.StructType([*(files.schema[c] for c in rest), T.StructField("own_license", T.StringType()), T.StructField("cosine", T.DoubleType()), T.StructField("line_no", T.IntegerType()), T.StructField("is_license_file", T.BooleanType())])

    def run(batches):
        matcher = Matcher(*matcher_args)
        for b in batches:
            rows = [matcher.scan(x.as_py() or "") for x in b.column(len(rest))]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(rest))), *(pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.float64(), pa.int32(), pa.bool_()), strict=True))], [f.name for f in schema])

    return map_arrow(files.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`")), run, schema)


@guarded("path", "own_license", "is_license_file")
def inherit(files: DataFrame) -> DataFrame:
    """files (with path, own_license, is_license_file) with license and license_from ('own', the directory, or null).

    The files are saved first: their rows have no text, and the joins read them three times."""
    df = saved(files).withColumn("_dir", F.regexp_replace(F.coalesce("path", F.lit("")), r"/?[^/]*$", ""))
    named = F.regexp_extract(F.coalesce("path", F.lit("")), r"([^/]*)$", 1).rlike(FILE_NAMES)
    gives = F.col("own_license").isNotNull() & (F.col("is_license_file") | named)
    counts = df.where(gives).groupBy("_dir", "own_license").agg(F.count("*").alias("n"))
    given = counts.groupBy(F.col("_dir").alias("up")).agg(F.max_by("own_license", F.struct("n", "own_license")).alias("dir_license"))
    dirs = df.select("_dir").distinct().withColumn("_p", F.split("_dir", "/"))
    ups = dirs.select("_dir", F.explode(F.transform(F.sequence(F.lit(0), F.size("_p")), lambda k: F.array_join(F.slice("_p", 1, k), "/"))).alias("a")).distinct()
    nearest = saved(ups.join(given, ups["a"] == given["up"]).groupBy(F.col("_dir").alias("_d")).agg(F.max_by(F.struct("up", "dir_license"), F.length("up")).alias("_near")))
    size = nearest.agg(F.sum(64 + F.octet_length("_d") + F.octet_length("_near.up") + F.octet_length("_near.dir_license"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        df = df.join(F.broadcast(nearest), df["_dir"] == nearest["_d"], "left")
    else:  # a directory may hold a third of all files
        nearest = nearest.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        df = df.withColumn("_s", F.pmod(F.xxhash64("path", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
        df = df.join(nearest, (df["_dir"] == nearest["_d"]) & (df["_s"] == nearest["_salt"]), "left").drop("_s", "_salt")
    return df.withColumns({
        "license": F.coalesce("own_license", "_near.dir_license"),
        "license_from": F.when(F.col("own_license").isNotNull(), F.lit("own")).otherwise(F.col("_near.up")),
    }).drop("_dir", "_d", "_near")


def op5(spark, sf_dir):
    """Each document is the file <source>/<lang>/<doc_id>."""
    docs = table(spark, sf_dir, "documents")
    files = docs.select("doc_id", F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias("path"), "text")
    return inherit(own_licenses(files))
