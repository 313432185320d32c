"""A slot for row-wise model inference with resume; the default client is an offline stub."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stub(texts: list[str]) -> list[str]:
    return ["ai" if "ai" in (t or "").lower().split() else "non_ai" for t in texts]


FAILED = "ERROR_MAX_RETRIES"


def classify(df: DataFrame, text: str, client: Callable[[list[str]], list[str]] = stub, out: str = "prediction", retries: int = 3, concurrency: int = 1, batch: int = 64) -> DataFrame:
    """df with the client's answer for each text; a batch that fails `retries` times gets ERROR_MAX_RETRIES.

    Each task has at most `concurrency` batches of `batch` texts with the client at a time.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def ask(texts: list[str]) -> list[str]:
        for _ in range(retries):
            try:
                answers = list(client(texts))
                if len(answers) == len(texts):
                    return answers
            except Exception:  # noqa: BLE001  any failure of a remote client is tried again
                pass
        return [FAILED] * len(texts)

    def run(frames):
        with ThreadPoolExecutor(concurrency) as pool:
            for pdf in frames:
                texts = pdf[text].tolist()
                parts = pool.map(ask, [texts[i : i + batch] for i in range(0, len(texts), batch)])
                yield pdf.assign(**{out: pd.Series([x for p in parts for x in p], index=pdf.index, dtype=object)})

    return df.mapInPandas(run, schema)


def throughput(df: DataFrame, out: str = "prediction", seconds: float | None = None) -> DataFrame:
    """n, errors and, with the seconds that the answers took, answers a second."""
    n = F.count("*")
    speed = F.lit(None).cast("double") if not seconds else n / F.lit(float(seconds))
    return df.agg(n.alias("n"), F.count_if(F.col(out).startswith("ERROR_")).alias("errors"), speed.alias("per_second"))


def few_shot_prompt(text: Column | str, labels: Sequence[str], task: str, shots: Sequence[tuple[str, str]] = (), limit: int | None = None) -> Column:
    """A prompt: the task, the labels allowed, solved examples, then the text, cut to `limit` characters if given."""
    head = f"{task}\nAnswer with one of: {', '.join(labels)}.\n" + "".join(f"\nText: {t}\nLabel: {x}\n" for t, x in shots)
    value = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.concat(F.lit(f"{head}\nText: "), F.substring(value, 1, limit) if limit else value, F.lit("\nLabel:"))


def augment_minority(df: DataFrame, label: str, text: str, rewrite: Callable[[list[str]], list[str]], threshold: int = 100, flag: str = "Is_Augmented") -> DataFrame:
    """df and, for each row of a class with fewer than `threshold` rows, its rewritten text where that differs and isn't empty.

    The flag is false in rows that were there, unless they bring the column. A null label is no class. A rewrite that keeps
    failing adds nothing.
    """
    base = df if flag in df.columns else df.withColumn(flag, F.lit(False))
    few = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("_n")).where(F.col("_n") < threshold).select(label)
    made = classify(base.join(few, label, "left_semi").select(*base.columns), text, rewrite, "_new")
    made = made.where((F.col("_new") != "") & (F.col("_new") != FAILED) & ~F.col("_new").eqNullSafe(F.col(text)))
    return base.unionByName(made.withColumns({text: F.col("_new"), flag: F.lit(True)}).select(*base.columns))


def pending(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The rows that aren't among the done ones."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def append_answers(df: DataFrame, path: str, key: str, step: Callable[[DataFrame], DataFrame], slices: int = 10) -> DataFrame:
    """Answers the rows whose key isn't in the table at `path` and appends them there, a slice of the keys at a time.

    Each slice is one commit: a run that was stopped goes on after the last one. Equal keys get one answer, for a row picked by
    its columns, so the table never holds a key twice. Null keys are left out. Returns the whole table.
    """
    spark = df.sparkSession
    rows = df.where(F.col(key).isNotNull())
    names = [c for c in rows.columns if c != key]
    if names:
        rows = rows.groupBy(key).agg(F.min(F.struct(*names)).alias("_s")).select(key, *[F.col(f"_s.`{c}`").alias(c) for c in names]).select(*df.columns)
    else:
        rows = rows.distinct()
    for i in range(slices):
        part = rows.where(F.pmod(F.xxhash64(key), F.lit(slices)) == i)
        try:
            part = pending(part, spark.read.parquet(path), key)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
        step(part).write.mode("append").parquet(path)
    return spark.read.parquet(path)
