"""License scans against a plain reading of the method: every header compared to every notice, directories walked up."""

import math
import re
from collections import Counter

from grantmill.llm import licenses

MIT = dict(licenses.FILES)["MIT"]
APACHE = dict(licenses.FILES)["Apache-2.0"]
FILLER = " ".join(f"word{i}" for i in range(80))
ROWS = [
    (1, "r/a/LICENSE", f"Copyright (c) 2020 Some Body\nAll rights reserved.\n\n{MIT}"),
    (2, "r/a/src/x.py", f"# {FILLER}"),
    (3, "r/a/src/deep/er/y.py", f"{FILLER}. Licensed under CC BY 4.0. {FILLER}"),
    (4, "r/a/vendor/COPYING", f"{FILLER}\nThis work is licensed under the GNU General\nPublic License, version 3.\n{FILLER}"),
    (5, "r/a/vendor/z.c", ""),
    (6, "r/a/vendor/lib/z.c", None),
    (7, "r/b/any name", APACHE + FILLER),
    (8, "r/b/q", "plain"),
    (9, "r/q", "plain"),
    (10, None, "plain"),
    (11, "r/b/notes.txt", f"{FILLER}\nReleased under the MIT License.\nAll rights reserved.\n{FILLER}"),
    (12, "r/b/notes.txt", f"{FILLER}\nReleased under the MIT License.\nAll rights reserved.\n{FILLER}"),
    (13, "r/c/one", MIT),
    (14, "r/c/two", APACHE),
    (15, "r/c/three", "日本語 and nothing else"),
    (16, "r/a/src/long", f"{FILLER} " * 3000 + "\nReleased under the MIT License."),
]
EXPECTED = {1: "MIT", 2: "MIT", 3: "CC-BY-4.0", 4: "GPL-3.0", 5: "GPL-3.0", 6: "GPL-3.0", 7: "Apache-2.0", 8: "Apache-2.0", 9: None, 10: None, 11: "MIT", 12: "MIT", 13: "MIT", 14: "Apache-2.0", 15: "MIT", 16: "MIT"}


def _brute(rows):
    term = lambda t: Counter(re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", (t or "").lower()))
    n, known = len(rows), {t for _, x in licenses.NOTICES + licenses.FILES for t in term(x)}
    df = Counter(t for _, _, x in rows for t in set(term(x)) & known)
    idf = lambda t: math.log((1 + n) / (1 + df[t])) + 1 if t in known else math.log(1 + n) + 1
    weigh = lambda t: {k: c * idf(k) for k, c in term(t).items()}
    norm = lambda w: math.sqrt(sum(x * x for x in w.values()))

    def best(text, templates):
        a, top = weigh(text), (None, 0.0)
        for name, t in templates:
            b = weigh(t)
            c = sum(x * b.get(k, 0.0) for k, x in a.items()) / (norm(a) * norm(b)) if a else 0.0
            if c >= licenses.COSINE and c > top[1] + 1e-12:
                top = (name, c)
        return top

    own, whole = {}, {}
    for doc, _, text in rows:
        text = text or ""
        name, _ = best(text, licenses.NOTICES + licenses.FILES)
        whole[doc] = name is not None
        lines, top = text.split("\n"), (name, 0.0)
        for width in range(1, licenses.WINDOW + 1) if not name else ():
            for i in range(len(lines) - width + 1):
                joined = "\n".join(lines[i : i + width])
                for x in [joined, *re.split(r"(?<=[.!?;])[ \t\n\x0b\x0c\r]+", joined)]:
                    found = best(x, licenses.NOTICES)
                    top = found if found[1] > top[1] + 1e-12 else top
        own[doc] = top[0]
    folder = {doc: "/".join((path or "").split("/")[:-1]) for doc, path, _ in rows}
    given = {}
    for doc, path, _ in rows:
        file = (path or "").split("/")[-1].upper()
        if own[doc] and (whole[doc] or file.startswith(("LICENSE", "LICENCE", "COPYING", "NOTICE"))):
            given.setdefault(folder[doc], Counter())[own[doc]] += 1
    out = {}
    for doc, _, _ in rows:
        at = folder[doc].split("/") if folder[doc] else []
        ups = ["/".join(at[:k]) for k in range(len(at), -1, -1)]
        near = next((u for u in ups if u in given), None)
        out[doc] = (own[doc], "own") if own[doc] else (max(given[near].items(), key=lambda e: (e[1], e[0]))[0], near) if near is not None else (None, None)
    return out


def _got(spark, rows):
    files = licenses.own_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string").repartition(3))
    return {r.doc_id: (r.license, r.license_from) for r in licenses.inherit(files).collect()}


def test_licenses_equal_a_plain_reading(spark):
    got = _got(spark, ROWS)
    assert got == _brute(ROWS)
    assert {k: v[0] for k, v in got.items()} == EXPECTED


def test_large_directories_go_by_salt(spark, monkeypatch):
    monkeypatch.setattr(licenses, "BROADCAST_BYTES", 0)
    rows = [*ROWS, *[(100 + i, "r/a/src/same", "plain") for i in range(300)]]
    got = _got(spark, rows)
    assert got == _brute(rows) and got[399] == ("MIT", "r/a")


def test_each_licence_file_is_its_own_and_a_query_keeps_all_rows(spark, monkeypatch):
    rows = [(i, f"d{i}/x", f"Some project\n{text}") for i, (_, text) in enumerate(licenses.FILES)] + [(99, "plain", FILLER)] * 2
    got = _got(spark, rows)
    assert {i: got[i] for i in range(len(licenses.FILES))} == {i: (name, "own") for i, (name, _) in enumerate(licenses.FILES)}
    docs = spark.createDataFrame([(i, "s", "en", t) for i, _, t in rows], "doc_id long, source string, lang string, text string")
    monkeypatch.setattr(licenses, "table", lambda *_: docs)
    assert licenses.op5(spark, "").count() == len(rows)
    monkeypatch.setattr(licenses, "table", lambda *_: docs.where("false"))
    assert licenses.op5(spark, "").count() == 0
