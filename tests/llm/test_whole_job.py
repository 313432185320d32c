"""Cases in which an operator once did less than the whole job."""

import collections
import math

import numpy as np
import pytest

from grantmill.llm import katz, urls


@pytest.mark.parametrize("contexts", [katz.CONTEXTS, 20])
def test_katz_learns_every_history(spark, monkeypatch, contexts):
    """Words below a share of 1 / CONTEXTS are contexts too, whatever follows them."""
    monkeypatch.setattr(katz, "CONTEXTS", contexts)
    rng = np.random.default_rng(3)
    docs = [[f"w{x}" for x in np.minimum(rng.zipf(1.25, 1000), 1 << 40)] for _ in range(100)] + [["w1", f"rare{i % 7}", f"rare{i % 5}"] * 3 for i in range(40)] + [[]]
    got = {r.doc_id: r for r in katz.score(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")).collect()}
    rows = [(i, [*w, "</s>"]) for i, w in enumerate(docs)]
    train = [w for i, w in rows if not katz.held_out(i)]
    uni, pairs = collections.Counter(x for w in train for x in w), collections.defaultdict(collections.Counter)
    for w in train:
        for a, b in zip(["<s>", *w[:-1]], w):
            pairs[a][b] += 1
    n, v = sum(uni.values()), len(uni)
    assert n > katz.CONTEXTS and min(uni.values()) * katz.CONTEXTS < n
    p1 = lambda x: (uni[x] + 0.5) / (n + 0.5 * (v + 1))
    d = [*katz.Parameters.good_turing([sum(r == k for c in pairs.values() for r in c.values()) for k in range(1, 7)]), 1.0]
    total, alpha = {}, collections.defaultdict(lambda: 1.0)
    for a, c in pairs.items():
        t, kept = sum(c.values()), sum(d[min(r, 6) - 1] * r for r in c.values())
        total[a] = t + (kept >= t * (1 - 1e-9))
        alpha[a] = (1 - kept / total[a]) / (1 - sum(map(p1, c)))
    assert len(got) == len(rows)
    for i, w in rows:
        s = sum(math.log10(d[min(pairs[a][b], 6) - 1] * pairs[a][b] / total[a] if a in total and b in pairs[a] else alpha[a] * p1(b)) for a, b in zip(["<s>", *w[:-1]], w))
        assert abs(got[i].score - s) < 1e-6 * abs(s)
        assert abs(got[i].base_score - sum(math.log10(p1(x)) for x in w)) < 1e-6 * abs(got[i].base_score)
        assert got[i].n_tokens == len(w) and got[i].n_known == sum(uni[x] > 0 for x in w)


def test_urls_of_branches_without_labels(spark):
    """Undecided urls are judged by the nearest branch above them that has labels, at any depth."""
    rows = [f"http://bad.com/en/{'abcdefghij'[i % 10]}{'xy'[i // 10]}" for i in range(20)] + ["http://bad.com/fr/1", "http://bad.com/new"]
    rows += [f"http://s.example.com/en/7{i}" for i in range(20)] + [f"http://s.example.com/en/{c}" for c in "abcdefghijklmnopqrst"] + ["http://s.example.com/fr/1"]
    deep = "http://d.net/x/1/2/a/b/c/d/e"
    rules = (*urls.RULES, ("block", "d.net", "/x/1/2/a/b/c/d/e/f/"), ("allow", "d.net", "/x/1/2/a/b/c/d/e/g/"))
    rows += [f"{deep}/f/{'abcdefghijklmnopqrst'[i]}" for i in range(20)] + [f"{deep}/g/{'abcdefghijklmnopqrst'[i]}" for i in range(20)] + [f"{deep}/h", "http://free.org/fr/1"]
    got = {r.url: r for r in urls.judge(spark.createDataFrame([(u,) for u in rows], "url string"), rules=rules).collect()}
    assert len(got) == len(rows)
    assert got["http://bad.com/fr/1"].verdict == got["http://bad.com/new"].verdict == "block"
    assert abs(got["http://bad.com/fr/1"].purity - 21 / 23) < 1e-12
    assert got["http://s.example.com/fr/1"].verdict == got[f"{deep}/h"].verdict == got["http://free.org/fr/1"].verdict == "allow"
    assert abs(got[f"{deep}/h"].purity - 21 / 43) < 1e-12 and abs(got[f"{deep}/f/a"].purity - 21 / 23) < 1e-12
    assert got[f"{deep}/h"].template == "/x/{n}/{n}/a/b/c/d/e/h" and abs(got["http://free.org/fr/1"].purity - 1 / 3) < 1e-12
