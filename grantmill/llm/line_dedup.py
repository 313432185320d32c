"""Line dedup: a sharded minimal perfect hash over the repeated lines, probed by the documents.

A line's key is the line without white space at both ends, A-Z lower-cased. A key of at least
``min_chars`` code points that stands in at least ``min_docs`` documents keeps its lines only in the
document with the largest doc_id. Rows with the same doc_id are one document, rows with a null doc_id are
one document below every other; all rows of the document with the largest doc_id keep their lines. Null and
empty texts are one empty line and come back as they were. Extra columns may have any name; n_lines and
n_dropped replace input columns so named.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grantmill.llm.common import guarded, map_arrow, packed, saved, splitmix, table, unpacked, with_columns

MIN_CHARS, MIN_DOCS = 40, 5
SHARD_KEYS = 1 << 16
#: Indexes up to this size go to all executors; larger ones stay on their shards and the probes travel.
BROADCAST_BYTES = 64 << 20
_NULL_ID = -(1 << 63)


class LineIndex:
    """Minimal perfect hash of distinct 128-bit keys with a fingerprint, a saturating count and the largest document of each.

    Levels of bits: a key that is alone on its bit of a level gets that bit's rank; the others go to the
    next level. A key outside the set meets a fingerprint (its other 64 bits) that differs.
    """

    def __init__(self, levels: list[np.ndarray], prints: np.ndarray, counts: np.ndarray, last: np.ndarray):
        self.levels, self.prints, self.counts, self.last = levels, prints, counts, last
        self.bits = [np.unpackbits(x).astype(bool) for x in levels]
        base = np.cumsum([0, *(int(b.sum()) for b in self.bits)])
        self.ranks = [np.cumsum(b) - 1 + n for b, n in zip(self.bits, base, strict=False)]

    @staticmethod
    def _spot(h: np.ndarray, level: int, size: int) -> np.ndarray:
        return splitmix(h + np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(size)

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, last: np.ndarray) -> LineIndex:
        todo, order, levels = np.arange(len(h1)), [], []
        while len(todo):
            size = -(-max(64, 2 * len(todo)) // 8) * 8
            spot = cls._spot(h1[todo] ^ splitmix(h2[todo]), len(levels), size).astype(np.int64)
            alone = np.bincount(spot, minlength=size) == 1
            levels.append(np.packbits(alone))
            placed = alone[spot]
            order.append(todo[placed][np.argsort(spot[placed])])
            todo = todo[~placed]
        at = np.concatenate(order) if order else np.empty(0, dtype=np.int64)
        return cls(levels, h2[at], np.minimum(counts[at], 255).astype(np.uint8), last[at])

    def find(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count (0 if absent) and largest document of each key."""
        count, last = np.zeros(len(h1), dtype=np.uint8), np.full(len(h1), _NULL_ID, dtype=np.int64)
        todo = np.arange(len(h1))
        key = h1 ^ splitmix(h2)
        for level, (bits, ranks) in enumerate(zip(self.bits, self.ranks, strict=True)):
            spot = self._spot(key[todo], level, len(bits)).astype(np.int64)
            hit = bits[spot]
            rank, own = ranks[spot[hit]], todo[hit]
            true = self.prints[rank] == h2[own]
            count[own[true]], last[own[true]] = self.counts[rank[true]], self.last[rank[true]]
            todo = todo[~hit]
        return count, last

    def dumps(self) -> bytes:
        return packed([self.prints, self.counts, self.last, *self.levels])

    @classmethod
    def loads(cls, blob: bytes) -> LineIndex:
        prints, counts, last, *levels = unpacked(blob)
        return cls(levels, prints, counts, last)


def line_keys(text: str, min_chars: int) -> tuple[list[str], list[int], np.ndarray, np.ndarray]:
    """The lines, the numbers of the long ones and the two halves of their 128-bit hashes."""
    lines = text.split("\n")
    at, digests = [], []
    for i, line in enumerate(lines):
        if len(line) >= min_chars:
            raw = line.encode().strip().lower()
            if len(raw) >= min_chars and (len(raw) >= 4 * min_chars or len(raw.decode()) >= min_chars):
                at.append(i)
                digests.append(xxhash.xxh3_128_digest(raw))
    h = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2)
    return lines, at, h[:, 0], h[:, 1]


def _shard(h1: np.ndarray, shards: int) -> np.ndarray:
    return ((h1 >> np.uint64(40)) * np.uint64(shards) >> np.uint64(24)).astype(np.int64)


def _emit_keys(min_chars: int):
    def run(batches):
        for batch in batches:
            ids, out = batch.column(0), []
            for doc, text in zip(ids, batch.column(1), strict=True):
                _, _, h1, h2 = line_keys(text.as_py() or "", min_chars)
                if len(h1):
                    pairs = np.unique(np.stack([h1, h2], 1), axis=0) if len(h1) > 1 else np.stack([h1, h2], 1)
                    out.append((np.full(len(pairs), _NULL_ID if doc.as_py() is None else doc.as_py(), dtype=np.int64), pairs))
            if out:
                pairs = np.concatenate([p for _, p in out]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1])), pa.array(np.concatenate([d for d, _ in out]))], ["h1", "h2", "doc_id"])

    return run


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """h1, h2, n and last of the keys in at least min_docs documents.

    Each document counts once: its keys are dealt by key and document first, so that a line that all documents
    share is spread over all tasks, then added up, on the map side first."""
    keys = map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), _emit_keys(min_chars), "h1 long, h2 long, doc_id long")
    return keys.distinct().groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= min_docs)


def build_index(repeated: DataFrame, shards: int) -> DataFrame:
    """One row for each shard that has keys: shard, blob."""

    def run(batches):
        own: dict[int, list] = {}
        for b in batches:
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            for s in np.unique(cols[0]):
                own.setdefault(int(s), []).append([c[cols[0] == s] for c in cols[1:]])
        for s, parts in own.items():
            h1, h2, n, last = (np.concatenate(x) for x in zip(*parts, strict=True))
            index = LineIndex.build(h1.view(np.uint64), h2.view(np.uint64), n, last)
            yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([index.dumps()], pa.binary())], ["shard", "blob"])

    top = F.shiftrightunsigned("h1", 40) * shards
    rows = repeated.select(F.shiftrightunsigned(top, 24).alias("shard"), "h1", "h2", "n", "last")
    return map_arrow(rows.repartition(shards, "shard"), run, "shard long, blob binary")


def _output(batch: pa.RecordBatch, schema: T.StructType, names: list[str], new: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([new[f.name] if f.name in new else batch.column(names.index(f.name)) for f in schema], [f.name for f in schema])


def _strike(text: str | None, drop: np.ndarray, lines: list[str]) -> str | None:
    if not len(drop):
        return text
    gone = set(drop.tolist())
    return "\n".join(x for i, x in enumerate(lines) if i not in gone)


def _probe_all(blobs, shards: int, min_chars: int, min_docs: int, schema: T.StructType, names: list[str], doc_at: int, text_at: int):
    def run(batches):
        index = {s: LineIndex.loads(b) for s, b in blobs.value}
        for batch in batches:
            ids = np.array([_NULL_ID if x is None else x for x in batch.column(doc_at).to_pylist()], dtype=np.int64)
            found = [line_keys(t.as_py() or "", min_chars) for t in batch.column(text_at)]
            sizes = np.array([len(f[1]) for f in found], dtype=np.int64)
            h1, h2 = (np.concatenate([f[k] for f in found]) if len(found) else np.empty(0, np.uint64) for k in (2, 3))
            count, last = np.zeros(len(h1), dtype=np.uint8), np.full(len(h1), _NULL_ID, dtype=np.int64)
            shard = _shard(h1, shards)
            for s in np.unique(shard):
                if int(s) in index:
                    own = np.flatnonzero(shard == s)
                    count[own], last[own] = index[int(s)].find(h1[own], h2[own])
            drop = (count >= min(min_docs, 255)) & (last != np.repeat(ids, sizes))
            ends = np.cumsum(sizes)
            gone = [np.asarray(f[1], dtype=np.int64)[drop[e - n : e]] for f, n, e in zip(found, sizes, ends, strict=True)]
            yield _output(batch, schema, names, {
                "text": pa.array([_strike(t.as_py(), g, f[0]) for t, g, f in zip(batch.column(text_at), gone, found, strict=True)], pa.string()),
                "n_lines": pa.array([len(f[0]) for f in found], pa.int64()),
                "n_dropped": pa.array([len(g) for g in gone], pa.int64()),
            })

    return run


def _emit_probes(shards: int, salts: int, min_chars: int):
    def run(batches):
        for batch in batches:
            for doc, text_hash, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                _, at, h1, h2 = line_keys(text.as_py() or "", min_chars)
                if at:
                    n = len(at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(_shard(h1, shards)), pa.array(np.full(n, text_hash % salts)), pa.array(np.ones(n, np.int32)), pa.nulls(n, pa.binary()), pa.array([doc] * n, pa.int64()), pa.array(np.full(n, text_hash, np.int64)), pa.array(at, pa.int32()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))],
                        ["shard", "salt", "kind", "blob", "doc_id", "text_hash", "line_no", "h1", "h2"])

    return run


def _probe_shards(min_docs: int):
    """A stream in the order of (shard, salt, kind): each index comes before its probes."""

    def run(batches):
        index, at = None, None
        for b in batches:
            shard, kind = b.column(0).to_pylist(), b.column(2).to_pylist()
            start = 0
            for i in range(len(shard) + 1):
                if i == len(shard) or kind[i] == 0 or shard[i] != shard[start]:
                    if i > start and kind[start] == 1 and at == shard[start]:
                        part = b.slice(start, i - start)
                        h1, h2 = (part.column(k).to_numpy().view(np.uint64) for k in (7, 8))
                        count, last = index.find(h1, h2)
                        ids = np.array([_NULL_ID if x is None else x for x in part.column(4).to_pylist()], dtype=np.int64)
                        keep = pa.array((count >= min(min_docs, 255)) & (last != ids))
                        yield pa.RecordBatch.from_arrays([part.column(k).filter(keep) for k in (4, 5, 6)], ["doc_id", "text_hash", "line_no"])
                    if i < len(shard) and kind[i] == 0:
                        index, at = LineIndex.loads(b.column(1 + 2)[i].as_py()), shard[i]
                    start = i
                    if i < len(shard) and kind[i] == 0:
                        start = i + 1

    return run


@guarded("doc_id", "text")
def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, broadcast_bytes: int = BROADCAST_BYTES, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """docs with the struck lines gone from text, and n_lines (before) and n_dropped."""
    spark = docs.sparkSession
    repeated = saved(repeated_lines(docs, min_chars, min_docs))
    n = repeated.count()
    shards = 1 << max(0, (n // shard_keys).bit_length())
    index = build_index(repeated, shards)
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([f for f in docs.schema] + [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    names = docs.columns
    if 20 * n <= broadcast_bytes:
        blobs = spark.sparkContext.broadcast([(r.shard, bytes(r.blob)) for r in index.toLocalIterator()])
        return map_arrow(docs, _probe_all(blobs, shards, min_chars, min_docs, schema, names, names.index("doc_id"), names.index("text")), schema)
    salts = 16
    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    layout = "shard long, salt long, kind int, blob binary, doc_id long, text_hash long, line_no int, h1 long, h2 long"
    probes = map_arrow(keyed, _emit_probes(shards, salts, min_chars), layout)
    empty = F.lit(None)
    indexes = index.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"), F.lit(0).alias("kind"), "blob",
                           *[empty.cast(t).alias(c) for c, t in (("doc_id", "long"), ("text_hash", "long"), ("line_no", "int"), ("h1", "long"), ("h2", "long"))])
    both = probes.unionByName(indexes).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    gone = (map_arrow(both, _probe_shards(min_docs), "doc_id long, text_hash long, line_no int").distinct()
            .groupBy(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t")).agg(F.collect_list("line_no").alias("_gone")))
    df = docs.withColumn("_h", F.xxhash64("text"))
    df = df.join(gone, df["doc_id"].eqNullSafe(gone["_d"]) & (df["_h"] == gone["_t"]), "left")
    parts = F.split(F.coalesce("text", F.lit("")), "\n")
    left = F.array_join(F.filter(parts, lambda _, i: ~F.array_contains("_gone", i)), "\n")
    return with_columns(df, {
        "text": F.when(F.col("_gone").isNull(), F.col("text")).otherwise(left),
        "n_lines": F.size(parts).cast("long"), "n_dropped": F.coalesce(F.size("_gone"), F.lit(0)).cast("long"),
    }).select(*[f.name for f in schema])


def op10(spark, sf_dir):
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT doc_id, line, place, last IS NOT NULL AND last <> doc_id AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
