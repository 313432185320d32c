"""URL filters against a plain-Python tree: whole results over random urls, rules, repeats and nulls."""

import collections
import math
import random
import re

import pytest

from grantmill.llm import urls

RULES = (*urls.RULES, ("block", "bad.org", "/a/"), ("allow", "bad.org", "/a/ok"), ("block", "wide.com", "/p/"), ("allow", "mixed.net", "/x/"), ("block", "mixed.net", "/y/b"))


def _parts(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def _shape(path):
    out = []
    for s in path.split("/"):
        for pattern, name in ((r"^[0-9a-fA-F]{8}-[0-9a-fA-F-]{27}", "{u}"), (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}", "{d}"), (r"^(?=[^.]*[0-9])[0-9a-fA-F]{8,}(?=$|\.)", "{h}"), (r"[0-9]+", "{n}")):
            s = re.sub(pattern, name, s)
        out.append(s)
    return "/".join(out)


def _brute(rows, rules, max_children):
    judged, hosts = [], collections.defaultdict(lambda: collections.defaultdict(lambda: [0, 0]))
    for page, url in rows:
        host, path = _parts(url)
        fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        rule = max(fits, key=lambda r: (len(r[1] + r[2]), r[1] + r[2]), default=None)
        judged.append((page, host, path, rule))
        count = hosts[host][_shape(path)]
        count[0] += rule is not None and rule[0] == "block"
        count[1] += rule is not None
    found = {}

    def walk(host, shapes, level, template, b, l):
        if len(shapes) == 1 and len(shapes[0][1]) > level:
            found[host, shapes[0][0]] = ("/".join([template, *shapes[0][1][level:]]), b, l)
            return
        literal = {s[1][level] for s in shapes if len(s[1]) > level}
        groups = collections.defaultdict(list)
        for s in shapes:
            step = s[1][level] if len(s[1]) > level else None
            groups["$" if step is None else "/*" if len(literal) > max_children and "{" not in step else "/" + step].append(s)
        sums = {k: (sum(s[2] for s in g), sum(s[3] for s in g)) for k, g in groups.items()}
        all_b, all_l = sum(x[0] for x in sums.values()), sum(x[1] for x in sums.values())
        pool = all_b / all_l if all_l else 0.0
        alike = {k for k, (x, y) in sums.items() if y and abs(x / y - pool) <= urls.Z * math.sqrt(max(pool * (1 - pool), 0) / y) + 1e-12}
        for k, g in groups.items():
            x, y = [sum(sums[q][i] for q in (alike if k in alike else {k})) for i in (0, 1)]
            x, y = (x, y) if y and len(groups) > 1 else (b, l)
            if k == "$":
                for s in g:
                    found[host, s[0]] = (template, x, y)
            else:
                walk(host, g, level + 1, template + k, x, y)

    for host, shapes in hosts.items():
        walk(host, [(s, s.split("/")[1:], *c) for s, c in shapes.items()], 0, "", *[sum(c[i] for c in shapes.values()) for i in (0, 1)])
    out = {}
    for page, host, path, rule in judged:
        template, b, l = found[host, _shape(path)]
        purity = (b + urls.PRIOR_BLOCK) / (l + urls.PRIOR_BLOCK + urls.PRIOR_ALLOW)
        out[page] = (host, path, rule and rule[1] + rule[2], rule[0] if rule else "block" if purity >= urls.PURITY else "allow", template, round(purity, 12))
    return out


def _urls():
    rng = random.Random(11)
    rows = [None, "", "nothing", "http://", "http://bad.org", "http://BAD.org/?q", "http://bad.org/a/#f", "ftp://x.bad.org//a//b/"]
    for _ in range(500):
        host = rng.choice(["bad.org", "www.bad.org", "mixed.net", "wide.com", "free.io", "v.example.com"])
        depth = rng.randint(0, 6)
        segs = [rng.choice(["a", "a", "b", "x", "y", "p", "en", "ok", str(rng.randint(1, 99)), f"w{rng.choice('abcdefghijklmnopqrstuvwxyz')}{rng.choice('abcdefghijklmnopqrstuvwxyz')}", "2024-01-02", "deadbeef01.html"]) for _ in range(depth)]
        rows.append(f"https://{host}/{'/'.join(segs)}{rng.choice(['', '/', '?x=1'])}")
    rows += [f"http://bad.org/a/{c}{d}" for c in "abcdefgh" for d in "mnopqr"] + ["http://bad.org/q/new", "http://bad.org/q/new"]
    rows += [f"http://wide.com/p/{c}{d}/end" for c in "abcdefgh" for d in "mnopqr"] + ["http://wide.com/p", "http://wide.com/r/s"]
    return list(enumerate(rows))


@pytest.mark.parametrize("max_children", [urls.MAX_CHILDREN, 2])
def test_urls_equal_a_plain_tree(spark, max_children):
    rows = _urls()
    df = spark.createDataFrame(rows, "page_id long, url string").repartition(3)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.template, round(r.purity, 12)) for r in urls.judge(df, rules=RULES, max_children=max_children).collect()}
    want = _brute(rows, RULES, max_children)
    assert got == want
    assert {v[3] for v in want.values() if v[2] is None} == {"block", "allow"}


def test_no_urls(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_verdicts_of_the_contract(spark):
    """Every rule's word as the contract lists it: on its host, on a subdomain, beside a longer or shorter rule, and as a label of its host."""
    want = {
        "http://com/en/": ("com/en/", "block"), "http://a.b.COM/en/x?q": ("com/en/", "block"), "http://example.com/en/6": ("com/en/", "block"),
        "http://example.com/en/7": ("example.com/en/7", "allow"), "http://s.example.com/en/70#f": ("example.com/en/7", "allow"),
        "http://net/de/": ("net/de/", "allow"), "ftp://x.y.Net/de/1": ("net/de/", "allow"), "http://example.net/de/7": ("net/de/", "allow"), "http://anexample.net/de/8": ("net/de/", "allow"),
        "http://example.net/de/8": ("example.net/de/8", "block"), "http://s.example.net/de/81": ("example.net/de/8", "block"),
        "http://org/es/": ("org/es/", "block"), "http://o.org/es/1": ("org/es/", "block"),
    }
    labels = {f"http://many.net/de/{c}{d}": ("net/de/", "allow") for c in "abcdefghij" for d in "xy"}
    want |= labels | {"http://many.net/de": (None, "allow"), "http://many.net/fr/1": (None, "allow")}
    got = {r.url: (r.rule, r.verdict) for r in urls.judge(spark.createDataFrame([(u,) for u in want], "url string")).collect()}
    assert got == want
