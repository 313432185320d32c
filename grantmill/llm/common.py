"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import gc
import inspect
import os
import re
import sys
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: White space of the word and line rules: blank and \t \n \v \f \r.
WS = " \t\n\x0b\x0c\r"
WORD_SPLIT = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one only in local mode where none is set, an error on a cluster."""
    if folder := spark.conf.get("spark.checkpoint.dir", ""):
        return folder
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="grantmill-"))
    return sc.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, so that a lost executor loses nothing of it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read again, for tables that a loop joins over and over.

    A checkpoint keeps the estimated size of its plan. Where each round joins the last one's tables, the estimates
    multiply until the planner does nothing but arithmetic on them; files have their real size.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of a stored table that nothing reads any more."""
    delete_path(df.sparkSession, df.stored_path)


def delete_path(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Lets the cluster drop shuffle files, broadcasts and checkpoints of finished steps that nothing refers to.

    Spark does so when the driver's collector finds their handles gone, by default only every half hour."""
    gc.collect()
    time.sleep(1.5)  # the handles on the Python side are given up by a thread that looks once a second
    spark.sparkContext._jvm.System.gc()


def guarded(*needed: str, named: tuple[str, ...] = ()) -> Callable:
    """For operators over a table: its columns beyond the needed ones have names inside that nothing else uses.

    ``named`` are the operator's parameters that hold the name of a needed column. Extra columns may thus have any
    name, repeated ones too; they come back under it, but for those of which the operator computes a column itself
    (in any case), which replaces them."""

    def wrap(fn):
        signature = inspect.signature(fn)

        @functools.wraps(fn)
        def run(df, *args, **kwargs):
            bound = signature.bind(df, *args, **kwargs)
            bound.apply_defaults()
            own = [*needed, *(bound.arguments[x] for x in named)]
            low = [c.lower() for c in df.columns]
            place = {low.index(n.lower()): n for n in own if n.lower() in low}
            extra = {f"extra__{i}": c for i, c in enumerate(df.columns) if i not in place}
            out = fn(df.toDF(*[place.get(i, f"extra__{i}") for i in range(len(low))]), *args, **kwargs)
            computed = {c.lower() for c in out.columns if c not in extra}
            return out.select(*[F.col(f"`{c}`").alias(extra.get(c, c)) for c in out.columns if c not in extra or extra[c].lower() not in computed])

        return run

    return wrap


def with_columns(df: DataFrame, columns: dict) -> DataFrame:
    """Adds columns; a computed column replaces an input column of that name (any case)."""
    taken = {c.lower() for c in columns}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken], *[v.alias(k) for k, v in columns.items()])


def trim() -> None:
    """Gives the memory that a worker no longer uses back to the machine; workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


ARROW_BYTES = 16 << 20
_ARROW_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def _bytes(size: str) -> int:
    """A setting of bytes, with or without a unit, as a number."""
    m = re.fullmatch(r"(\d+)([kmgtp]?)b?", size.strip().lower())
    return int(m[1]) << 10 * " kmgtp".index(m[2] or " ") if m else sys.maxsize


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow, with this package on the workers' path wherever it is installed under the same path.

    Arrow batches, which both the executor and its worker hold, are bounded to ARROW_BYTES in this session."""
    if _bytes(df.sparkSession.conf.get(_ARROW_CONF)) > ARROW_BYTES:
        df.sparkSession.conf.set(_ARROW_CONF, str(ARROW_BYTES))
    env = df.sparkSession.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, env.get("PYTHONPATH", "")) if x)

    def run(batches):
        yield from fn(batches)
        trim()

    return df.mapInArrow(run, schema)


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: Powers of an odd multiplier and of its inverse modulo 2^64, for rolling sums.
_P = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << max(16, int(n).bit_length())
        with np.errstate(over="ignore"):
            for base, name in ((_P, "_powers"), (pow(_P, -1, 1 << 64), "_inverses")):
                out = np.full(size, np.uint64(base), dtype=np.uint64)
                out[0] = 1
                globals()[name] = np.multiply.accumulate(out)
    return _powers[:n], _inverses[:n]


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of the text, A-Z lower-cased, in order.

    Words are maximal runs without the six white-space characters. The hash is a
    polynomial over the word's bytes and its length, mixed; it depends on the word alone.
    """
    if not text:
        return np.empty(0, dtype=np.uint64)
    raw = np.frombuffer(text, dtype=np.uint8)
    word = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, dtype=np.uint64)
    powers, inverses = _power_table(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * powers[1:], out=sums[1:])
        value = (sums[end] - sums[start]) * inverses[start]
        return splitmix(value + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def packed(arrays: list[np.ndarray]) -> bytes:
    """Arrays one after the other, each with its length and type code."""
    head = np.array([len(arrays)] + [x for a in arrays for x in (ord(a.dtype.char), len(a))], dtype="<i8")
    return head.tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpacked(blob: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, "<i8", 1)[0])
    head, at, out = np.frombuffer(blob, "<i8", 2 * n, 8), 8 + 16 * n, []
    for code, size in zip(head[::2], head[1::2], strict=True):
        kind = np.dtype(chr(code))
        out.append(np.frombuffer(blob, kind, int(size), at))
        at += int(size) * kind.itemsize
    return out


def squeezed(arrays: list[np.ndarray]) -> bytes:
    """packed() and compressed, the bytes of one place after the other: counts and ids nearly vanish, hashes stay."""
    head = np.array([len(arrays)] + [x for a in arrays for x in (ord(a.dtype.char), len(a))], dtype="<i8").tobytes()
    raw = head + b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def unsqueezed(blob: bytes) -> list[np.ndarray]:
    raw = pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    head, at, out = np.frombuffer(raw, "<i8", 2 * n, 8), 8 + 16 * n, []
    for code, size in zip(head[::2].tolist(), head[1::2].tolist(), strict=True):
        kind = np.dtype(chr(code))
        own = np.frombuffer(raw, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size)
        out.append(np.ascontiguousarray(own.T).view(kind).reshape(size))
        at += size * kind.itemsize
    return out


def texts(batch: pa.RecordBatch, name: str) -> Iterator[bytes]:
    """The UTF-8 bytes of a string column; null as empty."""
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary())
    for x in column:
        yield x.as_py() or b""
