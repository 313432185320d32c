"""Byte-level BPE: encoding with the tokenizers library over Arrow batches, and decoding.

``encode`` gives the ids packed as little-endian unsigned 32-bit integers and, if asked, the character
offsets of the tokens; ``decode`` gives the bytes back and the text, in which bytes that are no whole
character become U+FFFD. Null counts as the empty text, which has no ids. Texts are encoded whole. Each
piece that the split pattern matches is encoded by itself, so that a batch sends only its distinct,
not yet known pieces through the library.
"""

from __future__ import annotations

import base64
import functools
import os

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grantmill.llm.common import guarded, map_arrow, table

#: The pieces, and about the characters in them, kept for reuse in a worker; beyond, the memory of pieces starts anew.
KNOWN_PIECES, KNOWN_CHARS = 100_000, 2_000_000


@functools.lru_cache(1)
def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in own}
    for b in range(256):
        out.setdefault(b, chr(256 + len(out) - len(own)))
    return [out[b] for b in range(256)]


@functools.lru_cache(4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _last_pair(token: bytes, known: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that merges of lower rank leave of a token."""
    parts, top = [token[i : i + 1] for i in range(len(token))], known[token]
    while len(parts) > 2:
        at = min(range(len(parts) - 1), key=lambda i: r if (r := known.get(parts[i] + parts[i + 1], top)) < top else top)
        if known.get(parts[at] + parts[at + 1], top) >= top:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


@functools.lru_cache(4)
def tokenizer(path: str):
    """The library's BPE over the byte characters, with the ranks as vocabulary and merges."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer, models

    known, char = ranks(path), byte_characters()
    shown = {t: "".join(char[b] for b in t) for t in known}
    merges = []
    for t in sorted(known, key=known.get):
        if len(t) > 1 and (pair := _last_pair(t, known)):
            merges.append((shown[pair[0]], shown[pair[1]]))
    return Tokenizer(models.BPE(vocab={shown[t]: r for t, r in known.items()}, merges=merges))


class Encoder:
    def __init__(self, path: str, pattern: str, known_pieces: int = KNOWN_PIECES):
        self.lib, self.split, self.most = tokenizer(path), regex.compile(pattern).findall, known_pieces
        self.table = str.maketrans({b: c for b, c in enumerate(byte_characters())})
        self.known: dict[str, bytes] = {}
        self.size = 0

    def learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > self.most or self.size > KNOWN_CHARS:
            self.known, self.size = {}, 0
            new = list(pieces)
        shown = [p.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.table) for p in new]
        for p, e in zip(new, self.lib.encode_batch_fast(shown, add_special_tokens=False), strict=True):
            self.known[p] = np.array(e.ids, dtype="<u4").tobytes()
        self.size += sum(map(len, new))

    def __call__(self, text: str) -> list[bytes]:
        """The packed ids of each piece."""
        pieces = self.split(text)
        known = self.known
        try:
            return [known[p] for p in pieces]
        except KeyError:
            self.learn(set(pieces))
            known = self.known
            return [known[p] for p in pieces]


def token_bytes(path: str) -> list[bytes]:
    known = ranks(path)
    out = [b""] * (max(known.values()) + 1)
    for t, r in known.items():
        out[r] = t
    return out


def offsets(text: str, tokens: list[bytes]) -> list[tuple[int, int]]:
    """The characters that each token's bytes touch; a character split over tokens belongs to all of them."""
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    place = np.cumsum((raw & 0xC0) != 0x80) - 1
    ends = np.cumsum([len(t) for t in tokens])
    return [(int(place[e - len(t)]), int(place[e - 1]) + 1) for t, e in zip(tokens, ends, strict=True)]


@guarded(named=("text",))
def encode(df: DataFrame, path: str, pattern: str, text: str = "text", with_offsets: bool = False) -> DataFrame:
    """df without the text, with n_tokens, ids (packed) and, if asked, offsets as array<struct<start, end>>."""
    rest = [c for c in df.columns if c.lower() not in ("n_tokens", "ids", "offsets", text.lower())]
    fields = [df.schema[c] for c in rest] + [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    if with_offsets:
        fields.append(T.StructField("offsets", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))))
    schema = T.StructType(fields)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        encoder = Encoder(path, pattern)
        table_ = token_bytes(path) if with_offsets else []
        for batch in batches:
            kept = [batch.column(i) for i in range(len(rest))]
            found = [t.as_py() or "" for t in batch.column(len(rest))]
            ids = [b"".join(encoder(t)) for t in found]
            out = [*kept, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            if with_offsets:
                out.append(pa.array([[{"start": a, "end": b} for a, b in offsets(t, [table_[i] for i in np.frombuffer(x, "<u4")])] for t, x in zip(found, ids, strict=True)], span))
            yield pa.RecordBatch.from_arrays(out, [f.name for f in schema])

    return map_arrow(df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`")), run, schema)


@guarded(named=("ids",))
def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """df with decoded (bytes)."""
    rest = [c for c in df.columns if c.lower() != "decoded"]
    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField("decoded", T.BinaryType())])
    at = rest.index(ids)

    def run(batches):
        lookup = np.array(token_bytes(path), dtype=object)
        for batch in batches:
            out = [b"".join(lookup[np.frombuffer(x.as_py() or b"", "<u4")].tolist()) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(rest))), pa.array(out, pa.binary())], [f.name for f in schema])

    return map_arrow(df.select(*[F.col(f"`{c}`") for c in rest]), run, schema)


def decoded_text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


@guarded("text")
def digests(docs: DataFrame) -> DataFrame:
    import public_tokenizers as P

    path = P.path("byte_bpe_50k.tiktoken")
    out = decode(encode(docs, path, P.PATTERN), path)
    return out.withColumns({"ids_sha256": F.sha2("ids", 256), "decoded_sha256": F.sha2("decoded", 256)}).drop("ids", "decoded")


def op3(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
