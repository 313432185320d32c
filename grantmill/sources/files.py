"""Sources and sinks. Schemas are explicit; nothing is inferred."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NA_VALUES = ("", "NA", "N/A", "NaN", "nan", "null", "NULL", "None", "n/a")


def strings(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """Quoted newlines and doubled quotes are read; the spellings of a missing value become null; ANNO comes from the file name."""
    df = spark.read.schema(schema).csv(path, header=True, sep=sep, multiLine=True, escape='"', encoding=encoding)
    df = df.select(*[F.when(~F.col(f.name).isin(*NA_VALUES), F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in schema], F.try_to_number(F.nullif(F.regexp_extract(F.col("_metadata.file_name"), r"(\d{4})\.csv$", 1), F.lit("")), F.lit("9999")).cast("int").alias("ANNO"))
    return df


def read_text_dirs(spark: SparkSession, path: str) -> DataFrame:
    """filename, text and label (the folder) of a tree with a text in each file."""
    df = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    parts = F.split(F.col("_metadata.file_path"), "/")
    return df.select(F.element_at(parts, -1).alias("filename"), F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")).alias("text"), F.element_at(parts, -2).alias("label"))


def present(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Those of the paths that exist, in any file system that Spark reads."""
    conf = spark._jsc.hadoopConfiguration()
    found = []
    for x in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(x)
        if path.getFileSystem(conf).exists(path):
            found.append(x)
    return found


def read_years(spark: SparkSession, pattern: str, years: Sequence[int], schema: T.StructType, columns: Sequence[str] | None = None, **options) -> DataFrame:
    """The files of the years, `{year}` in the pattern; absent ones are skipped, and without any the frame is empty.

    ANNO is the year of the pattern, not of the file name. Only the named columns are parsed.
    """
    names = list(columns or schema.names)
    frames = [read_csv(spark, pattern.format(year=y), schema, **options).select(*names, F.lit(y).cast("int").alias("ANNO")) for y in years if present(spark, [pattern.format(year=y)])]
    if not frames:
        wanted = T.StructType([*[schema[n] for n in names], T.StructField("ANNO", T.IntegerType())])
        return spark.createDataFrame([], wanted)
    return reduce(DataFrame.unionByName, frames)


def read_named(spark: SparkSession, path: str, columns: Sequence[str], sep: str = ";", defaults: Mapping[str, str] | None = None, encoding: str = "UTF-8") -> DataFrame:
    """The columns as strings, found by the header's names; one that the file lacks has its default everywhere, else null.

    `file` is the file's name without its ending. Rows whose first column is null or blank are left out.
    """
    df = spark.read.csv(path, header=True, sep=sep, multiLine=True, escape='"', encoding=encoding, inferSchema=False)
    given = defaults or {}
    cols = [F.col(f"`{c}`").alias(c) if c in df.columns else F.lit(given.get(c)).cast("string").alias(c) for c in columns]
    out = df.select(*cols, F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("file"))
    return out.where(F.length(F.trim(F.col(f"`{columns[0]}`"))) > 0)


def read_csv_any(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",", fallback: str = "ISO-8859-1") -> DataFrame:
    """read_csv where each file that isn't valid UTF-8 is read in the fallback encoding.

    The lines are checked as they lie, in tasks; the driver gets the names of the files at fault.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("f"), F.is_valid_utf8("value").alias("ok"))
    files = lines.groupBy("f").agg(F.bool_and("ok").alias("ok")).collect()  # one row a file
    groups = [([r.f for r in files if r.ok], "UTF-8"), ([r.f for r in files if not r.ok], fallback)]
    frames = [read_csv(spark, fs, schema, sep, enc) for fs, enc in groups if fs]
    return reduce(DataFrame.unionByName, frames) if frames else read_csv(spark, path, schema, sep)


def write_csv(df: DataFrame, path: str, by: str | None = None, quote_all: bool = False) -> None:
    w = df.write.mode("overwrite").options(header=True, escape='"', quoteAll=quote_all)
    (w.partitionBy(by) if by else w).csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_chunks(df: DataFrame, path: str, rows: int = 10_000) -> None:
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(path)


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """path and bytes of the data files below a folder; their contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"))


def export_years(df: DataFrame, path: str, year: str = "ANNO") -> DataFrame:
    """One folder a year and one of all years, as CSV; returns the part (the year, or `all`), its rows and its bytes."""
    write_csv(df, f"{path}/by_year", by=year)
    write_csv(df, f"{path}/all")
    part = F.coalesce(F.nullif(F.regexp_extract("path", rf"/{year}=([^/]+)/", 1), F.lit("")), F.lit("all"))
    bytes_ = file_sizes(df.sparkSession, path).groupBy(part.alias("part")).agg(F.sum("bytes").alias("bytes"))
    name = F.when(F.grouping(year) == 1, "all").otherwise(F.coalesce(F.col(year).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")))
    rows = df.rollup(year).agg(name.alias("part"), F.count("*").alias("n")).select("part", "n")
    return rows.join(bytes_, "part", "left")


def write_unquoted(df: DataFrame, path: str, sep: str = ",", escape: str = "\\") -> None:
    """Lines without quotes: separators, line ends and the escape itself are escaped, null is empty. The names of the columns go
    to write_config, as text files have no header."""
    special = "[" + "".join("\\" + c for c in (sep, escape)) + r"\r\n]"

    def one(name: str) -> Column:
        return F.coalesce(F.regexp_replace(F.col(f"`{name}`").cast("string"), f"({special})", escape * 2 + "$1"), F.lit(""))

    df.select(F.concat_ws(sep, *[one(c) for c in df.columns]).alias("value")).write.mode("overwrite").text(path)


def write_config(spark: SparkSession, path: str, config: Mapping) -> None:
    """A small JSON object as one file."""
    spark.createDataFrame([(json.dumps(config, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_config(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first().value)


def write_texts(df: DataFrame, path: str, label: str, text: str, key: str) -> None:
    """Each row's text as a file `<label>/<label>_desc_<number>.txt`, numbered in its label from 001: by the key if
    that is a number, else by the key's hash.

    The path is one that pyarrow opens on every executor (a shared folder, hdfs:// or s3://). A task that runs again writes the
    same names with the same contents.
    """
    from grantmill.operators.ranking import row_numbers

    numeric = isinstance(df.schema[key].dataType, T.NumericType)
    h = F.md5(F.col(key).cast("string"))
    order, coarse = ([F.col(key)], F.col(key)) if numeric else ([h, F.col(key)], F.conv(F.substring(h, 1, 12), 16, 10).cast("double"))
    named = row_numbers(df.select(label, text, key), order, coarse, "_n", [label])
    number = F.when(F.col("_n") < 1000, F.lpad(F.col("_n").cast("string"), 3, "0")).otherwise(F.col("_n").cast("string"))
    safe = F.regexp_replace(F.coalesce(F.col(label).cast("string"), F.lit("none")), r"[^\w.-]+", "_")
    files = named.select(F.concat(safe, F.lit("/"), safe, F.lit("_desc_"), number, F.lit(".txt")).alias("file"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def write(rows):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        made = set()
        for r in rows:
            folder = f"{root}/{r.file.rsplit('/', 1)[0]}"
            if folder not in made:
                store.create_dir(folder, recursive=True)
                made.add(folder)
            with store.open_output_stream(f"{root}/{r.file}") as out:
                out.write(r.text.encode())

    files.foreachPartition(write)
