"""Media columns: documents as ordered sequences of text and media references.

``store`` turns texts into media, ``sequences`` parses HTML into an array of structs (place, kind, text,
ref, caption), ``resolve`` joins the references with the media by digest. A reference keeps its place and
caption whether or not its media is found. Null HTML is an empty sequence. A null text is stored as the
empty payload. Media with the same bytes have one digest and are read once for each digest.
"""

from __future__ import annotations

import hashlib
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grantmill.llm.common import guarded, map_arrow, table, with_columns

ROW = 64
ITEM = T.StructType([T.StructField("place", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("caption", T.StringType())])
_ITEMS = pa.list_(pa.struct([("place", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))
_BLOCKS = frozenset("address article aside blockquote body br dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
_MEDIA = frozenset("img video audio source embed".split())


def payload(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % ROW if raw else ROW)


def as_image(data: bytes) -> bytes:
    """A grey image of ROW columns, one 8-bit sample for each byte (portable grey map)."""
    return b"P5\n%d %d\n255\n" % (ROW, len(data) // ROW) + data


def samples(image: bytes) -> np.ndarray:
    magic, shape, top, data = image.split(b"\n", 3)
    width, height = map(int, shape.split())
    if magic != b"P5" or top != b"255" or len(data) != width * height:
        raise ValueError("not an 8-bit grey map")
    return np.frombuffer(data, dtype=np.uint8).reshape(height, width)


def feature(image: np.ndarray) -> str:
    """Height, mean, standard deviation and an 8-bin histogram of the samples; integers, so equal everywhere."""
    n, values = image.size, image.astype(np.int64)
    total, squares = int(values.sum()), int((values * values).sum())
    bins = np.bincount(image.reshape(-1) >> 5, minlength=8)
    return f"h={image.shape[0]};mean={1000 * total // n};var={(n * squares - total * total) // (n * n)};hist=" + ",".join(map(str, bins))


@guarded(named=("text",))
def store(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, with digest (of the media's bytes) and media."""
    rest = [c for c in docs.columns if c.lower() not in (text.lower(), "digest", "media")]
    schema = T.StructType([*(docs.schema[c] for c in rest), T.StructField("digest", T.StringType()), T.StructField("media", T.BinaryType())])

    def run(batches):
        for b in batches:
            media = [as_image(payload(x.as_py() or b"")) for x in b.column(len(rest)).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(rest))), pa.array([hashlib.sha256(m).hexdigest() for m in media]), pa.array(media, pa.binary())], [f.name for f in schema])

    return map_arrow(docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`")), run, schema)


def read_back(media: DataFrame) -> DataFrame:
    """digest, payload_bytes, payload_sha256, tail_crc32, media_bytes and feature, once for each digest."""

    def run(batches):
        for b in batches:
            rows = []
            for digest, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = raw.as_py()
                image = samples(raw)
                data = image.tobytes()
                rows.append((digest, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-ROW:]), len(raw), feature(image)))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "feature"])

    facts = map_arrow(media.select("digest", "media"), run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, feature string")
    return facts.groupBy("digest").agg(*[F.first(c).alias(c) for c in facts.columns[1:]])


class _Sequence(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.caption: list[str] | None = None
        self.waiting: list[int] = []
        self.quiet = 0

    def flush(self) -> None:
        text = " ".join(" ".join(self.words).split())
        self.words = []
        if text:
            self.items.append({"place": len(self.items), "kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "head"):
            self.quiet += 1
        elif tag in _MEDIA and (src := dict(attrs).get("src")):
            self.flush()
            self.waiting.append(len(self.items))
            self.items.append({"place": len(self.items), "kind": "media", "text": None, "ref": src, "caption": dict(attrs).get("alt")})
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in _BLOCKS:
            self.flush()
            if tag == "figure":
                self.waiting = []

    def handle_endtag(self, tag):
        if tag in ("script", "style", "head"):
            self.quiet = max(0, self.quiet - 1)
        elif tag == "figcaption" and self.caption is not None:
            text = " ".join(" ".join(self.caption).split())
            for at in self.waiting:
                self.items[at]["caption"] = text
            self.caption = None
        elif tag in _BLOCKS:
            self.flush()

    def handle_data(self, data):
        if not self.quiet:
            (self.words if self.caption is None else self.caption).append(data)


def parse_sequence(html: str | None) -> list[dict]:
    """The ordered text and media items of a page; a figure's caption goes to its media."""
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    if parser.caption is not None:
        parser.handle_endtag("figcaption")
    parser.flush()
    return parser.items


@guarded(named=("html",))
def sequences(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages without the HTML, with items."""
    rest = [c for c in pages.columns if c.lower() not in (html.lower(), "items")]
    schema = T.StructType([*(pages.schema[c] for c in rest), T.StructField("items", T.ArrayType(ITEM))])

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(rest))), pa.array([parse_sequence(x.as_py()) for x in b.column(len(rest))], _ITEMS)], [f.name for f in schema])

    return map_arrow(pages.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{html}`")), run, schema)


@guarded("items")
def resolve(items: DataFrame, media: DataFrame, prefix: str = "media:") -> DataFrame:
    """The media items of sequences, a row each, with what is known of their media; null where there is none.

    A reference that doesn't start with the prefix names no stored media. What is known of media and place and
    caption replace input columns so named."""
    rest = [c for c in items.columns if c != "items"]
    rows = items.select(*rest, F.explode("items").alias("i")).where(F.col("i.kind") == "media")
    own = F.when(F.col("i.ref").startswith(prefix), F.expr(f"substring(i.ref, {len(prefix) + 1})"))
    rows = rows.select(*rest, F.col("i.place").alias("place"), F.col("i.caption").alias("caption"), own.alias("_digest"))
    media = media.withColumnRenamed("digest", "media_sha256")
    return rows.join(media, rows["_digest"] == media["media_sha256"], "left").drop("_digest")


def page_of(text: Column, digest: Column, caption: Column) -> Column:
    """A document as HTML: a paragraph for each line, and after the first half of the lines a figure that refers to its media."""
    clean = F.replace(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = F.split(clean, "\n")
    half = F.floor(F.size(lines) / 2).cast("int")
    figure = F.concat(F.lit("<figure><img src='media:"), digest, F.lit("'><figcaption>"), F.coalesce(caption.cast("string"), F.lit("null")), F.lit("</figcaption></figure>"))
    some = lambda a: F.concat(F.lit("<p>"), F.array_join(a, "</p><p>"), F.lit("</p>"))
    return F.concat(some(F.slice(lines, F.lit(1), half)), figure, some(F.slice(lines, half + 1, F.size(lines))))


def op4(spark, sf_dir):
    """Each document becomes a page of its paragraphs with its media between them; the page is parsed, the reference resolved.

    `place` is the media's place in the sequence, that is the number of paragraphs before it, `n_text` the number of all
    paragraphs (lines that aren't blank), `caption` the doc_id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = store(with_columns(docs, {"n_bytes": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"), "body": F.col("text")}))
    items = sequences(stored.select("doc_id", "n_bytes", page_of(F.col("body"), F.col("digest"), F.col("doc_id")).alias("html")))
    n_text = F.size(F.filter("items", lambda i: i["kind"] == "text")).cast("long")
    out = resolve(with_columns(items, {"n_text": n_text}), read_back(store(docs)))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "place", "caption", "n_text")
