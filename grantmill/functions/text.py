"""Text expressions. Patterns are Unicode-aware: (?U) makes \\b, \\w and \\s follow Unicode as in Python."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def matches(col: Column | str, pattern: str) -> Column:
    """Whether the pattern occurs, any case; null is no match."""
    return F.coalesce(_c(col).rlike(f"(?U)(?i){pattern}"), F.lit(False))


def matches_any(cols: Sequence[str], pattern: str, words: Sequence[str] = ()) -> Column:
    """Whether the pattern occurs in any column; cheap word tests come first where given."""
    out = F.lit(False)
    for c in cols:
        low = F.lower(F.coalesce(_c(c), F.lit("")))
        cheap = F.lit(True) if not words else F.lit(False)
        for w in words:
            cheap = cheap | low.contains(w)
        out = out | (cheap & matches(c, pattern))
    return out


def matches_concat(cols: Sequence[str], pattern: str) -> Column:
    return matches(F.concat_ws(" ", *cols), pattern)


def first_match(col: Column | str, rules: Mapping[str, Sequence[str]], default: str) -> Column:
    """The first label, in order, one of whose patterns occurs."""
    out = F
    for label, patterns in rules.items():
        out = out.when(matches(col, "(?:" + "|".join(patterns) + ")"), F.lit(label))
    return out.otherwise(F.lit(default)) if out is not F else F.lit(default)


def regex_binary(col: Column | str, pattern: str) -> Column:
    return F.when(matches(col, pattern), "ai").otherwise("non_ai")


def lookup(col: Column | str, table: Mapping, default=None) -> Column:
    """The table's value; default (or the value itself, if default is ...) where there is none."""
    pairs = [F.lit(x) for k, v in table.items() if v is not None for x in (k, v)]
    found = F.create_map(*pairs)[_c(col)] if pairs else F.lit(None)
    return F.coalesce(found, _c(col) if default is ... else F.lit(default)) if default is not None else found


def parse_list_literal(col: Column | str) -> Column:
    """Quoted items of a list literal: hyphens as blanks, lower case, distinct, sorted, joined by pipes."""
    items = F.regexp_extract_all(_c(col), F.lit("['\"]([^'\"]*)['\"]"), F.lit(1))
    clean = F.filter(F.transform(items, lambda x: F.trim(F.lower(F.replace(x, F.lit("-"), F.lit(" "))))), lambda x: x != "")
    return F.coalesce(F.array_join(F.array_sort(F.array_distinct(clean)), "|"), F.lit(""))


def strip_reasoning(col: Column | str) -> Column:
    return F.trim(F.regexp_replace(_c(col), r"(?s)<think>.*?(?:</think>|\z)", ""))


def strip_fence(col: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(_c(col)), r"(?s)\A```[a-zA-Z]*\s*", ""), r"(?s)\s*```\z", ""))


def resolve_label(col: Column | str, labels: Sequence[str]) -> Column:
    """Exact label in any case, else the longest label that the text contains, else UNKNOWN_ and the text."""
    text = F.lower(F.trim(_c(col)))
    inside = F
    for label in sorted(labels, key=lambda x: (-len(x), x)):
        inside = inside.when(text.contains(label.lower()), label)
    exact = lookup(text, {x.lower(): x for x in labels})
    return F.coalesce(exact, inside.otherwise(F.concat(F.lit("UNKNOWN_"), F.trim(_c(col)))))


def bucket_beneficiary(col: Column | str) -> Column:
    t = F.upper(F.trim(F.coalesce(_c(col), F.lit(""))))
    return F.when(t.contains("PMI") | t.contains("PICCOL") | t.contains("MEDI") | t.contains("MICRO"), "PMI").when(t.contains("GRANDE"), "Grande impresa").otherwise("Altro")


def clean_ascii(col: Column | str) -> Column:
    """One line of ASCII: controls and non-ASCII as blanks, no quotes, comma and semicolon as blanks, blanks collapsed."""
    flat = F.regexp_replace(_c(col), r"[\r\n\t]|[^\x00-\x7F]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(flat, "[\"']", ""), "[,;]", " "), " +", " "))


def strip_tz(col: Column | str) -> Column:
    return F.regexp_replace(_c(col), r"[+-]\d{2}:\d{2}$", "")


def multi_normalise(col: Column | str, separator: str = r"\s{2,}|[|]|, ") -> Column:
    """A multi-value cell as distinct values in order, joined by pipes."""
    return F.array_join(F.array_distinct(F.filter(F.transform(F.split(_c(col), separator), F.trim), lambda x: x != "")), "|")


def template_variants(col: Column | str, templates: Sequence[str], *extra: Column) -> Column:
    """The text and its variants. In a template %1$s (or %s) is the text without final dots and with a small first letter,
    %2$s the text without final dots, %3$s and so on the extra columns, empty where null. A null text has no variants."""
    bare = F.regexp_replace(F.trim(_c(col)), r"\.+\z", "")
    low = F.concat(F.lower(F.substring(bare, 1, 1)), F.substring(bare, 2, 1 << 30))
    more = [F.coalesce(x.cast("string"), F.lit("")) for x in extra]
    return F.when(_c(col).isNotNull(), F.array(_c(col), *[F.format_string(t, low, bare, *more) for t in templates]))


def words(col: Column | str, longer_than: int = 2, stop: Sequence[str] = ()) -> Column:
    """The runs of letters of any script, in small letters, of more than so many letters and not among the stop words."""
    found = F.regexp_extract_all(F.lower(_c(col)), F.lit(r"\p{L}+"), F.lit(0))
    keep = lambda w: (F.char_length(w) > longer_than) & ~w.isin(*stop) if stop else F.char_length(w) > longer_than
    return F.filter(found, keep)


def non_ascii_chars(col: Column | str) -> Column:
    """Every character outside ASCII, in order, repeats kept."""
    return F.regexp_extract_all(_c(col), F.lit(r"[^\x00-\x7F]"), F.lit(0))


def map_labels(labels: Column | str, macros: Mapping[str, Sequence[str]], default: str) -> Column:
    """The distinct macro labels of a list of labels, any case, sorted; labels that no macro names count as the default."""
    reverse = {sub.lower(): macro for macro, subs in macros.items() for sub in subs}
    return F.array_sort(F.array_distinct(F.transform(F.filter(_c(labels), lambda x: x.isNotNull()), lambda x: lookup(F.lower(x), reverse, default))))
