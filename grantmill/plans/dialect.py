"""One text for both engines: short names in capitals stand for functions that are spelt differently."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_SPARK = {"RX": "regexp_like", "SPLIT": "split", "EXPLODE": "explode", "AJOIN": "array_join", "ADISTINCT": "array_distinct", "ASORT": "array_sort", "COLLECT": "collect_list", "COLLECTSET": "collect_set", "SIZE": "size", "RXREPLACE": "regexp_replace", "PCTL": "percentile", "DAY": "to_date", "TRYDOUBLE": "try_double", "STARTS": "startswith", "ENDS": "endswith", "BROUND": "bround"}
_DUCK = {"RX": "regexp_matches", "SPLIT": "string_split", "EXPLODE": "unnest", "AJOIN": "array_to_string", "ADISTINCT": "list_distinct", "ASORT": "list_sort", "COLLECT": "list", "COLLECTSET": "list_distinct_of", "SIZE": "len", "RXREPLACE": "regexp_replace_all", "PCTL": "quantile_cont", "DAY": "date", "TRYDOUBLE": "try_double", "STARTS": "starts_with", "ENDS": "ends_with", "BROUND": "round_even"}


def _arguments(text: str, at: int) -> tuple[list[str], int]:
    """The arguments of the call whose bracket opens at `at`, and the place after it."""
    depth, quoted, start, out = 0, False, at + 1, []
    for i in range(at, len(text)):
        c = text[i]
        if c == "'":
            quoted = not quoted
        elif not quoted and c in "([":
            depth += 1
        elif not quoted and c in ")]":
            depth -= 1
            if depth == 0:
                return [*out, text[start:i]], i + 1
        elif not quoted and c == "," and depth == 1:
            out.append(text[start:i])
            start = i + 1
    raise ValueError("bracket not closed")


def _render(text: str, names: dict[str, str], duck: bool) -> str:
    out, at = [], 0
    for m in re.finditer(r"\b([A-Z]+)\(", text):
        if m.start() < at or m[1] not in names:
            continue
        args, end = _arguments(text, m.end() - 1)
        args = [_render(a, names, duck) for a in args]
        name = names[m[1]]
        if name == "try_double":
            call = f"TRY_CAST({args[0]} AS DOUBLE)"
        elif name == "regexp_replace_all":
            call = f"regexp_replace({', '.join(args)}, 'g')"
        elif name == "list_distinct_of":
            call = f"list_distinct(list({args[0]}))"
        elif name == "date":
            call = f"CAST({args[0]} AS DATE)"
        else:
            call = f"{name}({','.join(args)})"
        out += [text[at : m.start()], call]
        at = end
    return "".join(out) + text[at:]


def spark_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Runs the text over the Parquet tables of a folder; only the tables it names are read."""
    rendered = _render(text, _SPARK, False)
    for t in TABLES:
        rendered = rendered.replace("{" + t + "}", f"parquet.`{sf_dir}/{t}.parquet`")
    return spark.sql(rendered)


def duck_sql(text: str) -> str:
    return _render(re.sub("{(" + "|".join(TABLES) + ")}", r"\1", text), _DUCK, True)
