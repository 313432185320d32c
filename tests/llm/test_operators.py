"""The operators on small and awkward rows: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from grantmill.llm import bpe, html_text, katz, licenses, line_dedup, media, mixing, ngram_join, quality, urls

SCHEMA = "doc_id long, text string, source string, lang string"
LINE = "a line that is long enough to be looked at, number one"


@pytest.fixture(scope="module")
def odd(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(i, base.replace("w7 ", f"x{i} "), "s1", "en") for i in range(40)]
    rows += [(100, None, None, None), (101, "", "s1", "en"), (102, "one two", "s2", "en"), (103, "ONE  two", "s2", "en"), (None, base, "s1", "en"), (104, base, "s1", "en"), (104, base, "s1", "en")]
    rows += [(200 + i, f"{LINE}\n own text of {i} " + " ".join(f"v{i}_{k}" for k in range(30)) + f"\n{LINE.upper()} ", "s3", "fr") for i in range(8)]
    rows += [(300, "y " * 30_000, "s4", "de"), (301, " \n\t", "s4", "de"), (302, "日本語 🎉 é", "s5", "ja")]
    return spark.createDataFrame(rows, SCHEMA)


def _sets(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def _same_as_brute_force(df, **how):
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join_components(df, **how).collect())
    rows = [(r.doc_id, _sets(r.text)) for r in df.collect()]
    ids = [d for d, _ in rows if d is not None]
    up = {d: d for d in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, s) in enumerate(rows):
        for b, t in rows[:i]:
            if None not in (a, b) and s and t and 100 * len(s & t) >= 75 * len(s | t):
                lo, hi = sorted((find(a), find(b)))
                up[hi] = lo
    assert got == collections.Counter((d, len(s), None if d is None else find(d)) for d, s in rows)


@pytest.mark.parametrize("bucket", [24, 2])
def test_ngram_join_equals_brute_force(spark, odd, bucket):
    """With buckets of two sets, nearly all pairs go the way of deletions, stars and blocks."""
    _same_as_brute_force(odd, bucket=bucket)


@pytest.mark.parametrize(("bucket", "stars"), [(3, 1), (2, 3), (24, 2)])
def test_ngram_join_of_drifting_copies(spark, bucket, stars):
    """Chains of copies whose neighbours are near 0.75, of short and long texts: sets enter only some of their large buckets."""
    rng, rows = np.random.default_rng(7), []
    for size in (9, 20, 45, 90, 200):
        words = [f"c{size}_{k}" for k in range(size)]
        for _ in range(60):
            for at in rng.integers(0, len(words), max(1, size // 45)):
                words[at] = f"e{rng.integers(1 << 30)}"
            cut = int(rng.integers(0, size // 8 + 1))
            rows.append((len(rows), " ".join(words[cut:]), "s1", "en"))
    _same_as_brute_force(spark.createDataFrame(rows, SCHEMA), bucket=bucket, stars=stars)


def test_ngram_join_of_nothing(spark, odd):
    assert ngram_join.join_components(odd.where("false")).count() == 0
    assert ngram_join.join_components(odd.where("text is null")).first().n_shingles == 0


def test_targets_equal_stepwise_resharing(spark):
    sizes = {"a": 100, "b": 1000, "c": 10, "d": 300, None: 50, "é": 0}
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    names = [*sorted(k for k in sizes if k is not None), None]
    weight = {k: (3, 1, 2)[i % 3] for i, k in enumerate(names)}
    target, free, left = dict.fromkeys(names, 0.0), set(names), 1.5 * sum(sizes.values())
    while left > 1e-9 and free:
        total = sum(weight[k] for k in free)
        target |= {k: target[k] + left * weight[k] / total for k in free}
        left = 0.0
        for k in list(free):
            if target[k] > 2 * sizes[k]:
                left += target[k] - 2 * sizes[k]
                target[k] = 2.0 * sizes[k]
                free.remove(k)
    assert all(abs(got[k] - target[k]) < 1e-6 for k in names)


def test_mix_comes_near_its_targets(spark, odd):
    m = mixing.mix(odd).toPandas()
    assert len(m) == odd.count() and (m["taken"] <= 2 * m["size"]).all()
    for _, g in m.groupby("source", dropna=False):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= g["size"].max()
    again = mixing.mix(odd.repartition(5)).toPandas()
    key = lambda d: sorted(map(str, d[["doc_id", "size", "taken"]].itertuples(index=False)))
    assert key(m) == key(again)
    assert mixing.mix(odd.where("false")).count() == 0


def test_bpe_equals_tiktoken_and_round_trips(spark, odd):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks(path), special_tokens={})
    df = spark.createDataFrame([(1, "don't <|endoftext|>  🎉\n\n日本語 x"), (2, None), (3, "")], "ids long, text string")
    for r in bpe.encode(df.withColumnRenamed("ids", "doc_id"), path, P.PATTERN, with_offsets=True).collect():
        text = {1: "don't <|endoftext|>  🎉\n\n日本語 x"}.get(r.doc_id, "")
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids == ref.encode_ordinary(text) and len(r.offsets) == r.n_tokens == len(ids)
        assert all(0 <= o.start < o.end <= len(text) for o in r.offsets)
    for r in bpe.digests(odd.select("doc_id", "text")).collect():
        assert len(r.ids_sha256) == 64
    back = {(r.doc_id, r.decoded_sha256) for r in bpe.digests(odd.select("doc_id", "text")).collect()}
    assert back == {(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in odd.collect()}
    assert bpe.decoded_text(b"a\xf0\x9f") == "a�"


def test_media(spark, odd, monkeypatch):
    monkeypatch.setattr(media, "table", lambda *_: odd)
    rows = media.op4(spark, "").collect()
    assert len(rows) == odd.count()
    texts = collections.defaultdict(list)
    for r in odd.collect():
        texts[r.doc_id].append((r.text or "").encode())
    for r in rows:
        raw = next(x for x in texts[r.doc_id] if len(x) == r.n_bytes)
        full = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        image = b"P5\n64 %d\n255\n" % (len(full) // 64) + full
        assert (r.media_bytes, r.media_sha256) == (len(image), hashlib.sha256(image).hexdigest())
        mean, square = sum(full) / len(full), sum(x * x for x in full) / len(full)
        shape, m, var, hist = (x.split("=")[1] for x in r.feature.split(";"))
        assert (int(shape), int(m)) == (len(full) // 64, int(1000 * sum(full) // len(full))) and abs(int(var) - (square - mean * mean)) <= 1
        assert [int(x) for x in hist.split(",")] == [sum(x >> 5 == k for x in full) for k in range(8)]
        lines = [bool(x.split()) for x in raw.decode().split("\n")]
        assert (r.place, r.n_text, r.caption) == (sum(lines[: len(lines) // 2]), sum(lines), "null" if r.doc_id is None else str(r.doc_id))
    items = media.parse_sequence("<p>a<figure><img src='m:1' alt=x><figcaption>cap <b>1</b></figcaption></figure>b<img src='m:2'>")
    assert [(i["kind"], i["text"] or i["ref"], i["caption"]) for i in items] == [("text", "a", None), ("media", "m:1", "cap 1"), ("text", "b", None), ("media", "m:2", None)]
    assert media.parse_sequence(None) == []


def test_media_references_stay_aligned(spark):
    """Several references in a page, one of them repeated, one without media, one of another kind; texts with markup in them."""
    docs = spark.createDataFrame([(1, "one <b> & two"), (2, "three")], "doc_id long, text string")
    stored = media.store(docs)
    d1, d2 = (r.digest for r in stored.orderBy("doc_id").collect())
    html = f"<p>a</p><img src='media:{d2}' alt=x>b<figure><img src='media:{d1}'><img src='media:{d2}'><figcaption>both</figcaption></figure><p>c</p><img src='media:none' alt=gone><img src='http://h/p'>"
    pages = spark.createDataFrame([(7, html), (8, None), (9, "<p>only text")], "page_id long, html string")
    items = media.sequences(pages)
    rows = media.resolve(items, media.read_back(stored)).orderBy("page_id", "place").collect()
    assert [(r.page_id, r.place, r.caption, r.media_sha256) for r in rows] == [(7, 1, "x", d2), (7, 3, "both", d1), (7, 4, "both", d2), (7, 6, "gone", None), (7, 7, None, None)]
    page = media.page_of(F.lit("x < y\n\n&amp; z\nw"), F.lit("D"), F.lit(5))
    got = media.parse_sequence(spark.range(1).select(page.alias("p")).first().p)
    assert [(i["text"], i["ref"], i["caption"]) for i in got] == [("x < y", None, None), (None, "media:D", "5"), ("&amp; z", None, None), ("w", None, None)]


def test_licenses(spark):
    rows = [(1, "r/a/x", "text\nReleased under the MIT License.\nmore"), (2, "r/a/LICENSE", "All rights reserved."), (3, "r/a/b/y", "plain"), (4, "q/z", "plain"), (5, None, None), (6, "r/a/b/w", "the of and")]
    got = {r.doc_id: (r.license, r.license_from) for r in licenses.inherit(licenses.own_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string"))).collect()}
    assert got[1][0] == "MIT" and got[2] == ("proprietary", "own") and got[3] == got[6] == ("proprietary", "r/a") and got[4] == got[5] == (None, None)


def test_katz_sums_to_one_and_equals_brute_force(spark, odd):
    got = {(r.doc_id, r.n_tokens): r for r in katz.score(odd.select("doc_id", "text")).collect()}
    rows = [(r.doc_id, (r.text or "").encode().lower().split() + ["</s>"]) for r in odd.collect()]
    train = [w for d, w in rows if not katz.held_out(d)]
    uni, pairs = collections.Counter(x for w in train for x in w), collections.defaultdict(collections.Counter)
    for w in train:
        for a, b in zip(["<s>", *w[:-1]], w):
            pairs[a][b] += 1
    n, v = sum(uni.values()), len(uni)
    p1 = lambda x: (uni[x] + 0.5) / (n + 0.5 * (v + 1))
    d = [*katz.Parameters.good_turing([sum(r == k for c in pairs.values() for r in c.values()) for k in range(1, 7)]), *[1.0] * 100_000]
    model = {}
    for a, c in pairs.items():
        total, kept = sum(c.values()), sum(d[min(r, 6) - 1] * r for r in c.values())
        total += kept >= total * (1 - 1e-9)
        alpha = (1 - kept / total) / (1 - sum(map(p1, c)))
        model[a] = (total, alpha)
        assert abs(sum(d[min(r, 6) - 1] * r / total for r in c.values()) + alpha * (1 - sum(map(p1, c))) - 1) < 1e-9
    for doc, w in rows:
        s = sum(math.log10(d[min(r, 6) - 1] * r / model[a][0]) if (r := pairs[a][b] if a in pairs else 0) else math.log10((model[a][1] if a in model else 1) * p1(b)) for a, b in zip(["<s>", *w[:-1]], w))
        r = got[doc, len(w)]
        assert abs(r.score - s) < 1e-6 * abs(s) and abs(r.base_score - sum(math.log10(p1(x)) for x in w)) < 1e-6 * abs(r.base_score)
        assert r.train_tokens == n and r.n_known == sum(uni[x] > 0 for x in w)
    assert katz.score(odd.where("false").select("doc_id", "text")).count() == 0


def test_quality(spark, odd):
    rows = {(r.doc_id, r.n_words): r for r in quality.quality(odd).collect()}
    assert len(rows) == odd.select("doc_id").distinct().count()
    assert rows[100, 0].base_failed and not rows[100, 0].kept
    assert rows[300, 30_000].n_repeat_words == 30_000 and rows[300, 30_000].base_failed
    assert rows[0, 60].kept and rows[0, 60].n_removed_words == 0
    assert rows[200, 58].n_removed_words == 0  # texts that differ in digits alone are one document to the line counts
    other = spark.createDataFrame([(i, f"{LINE}\n" + " ".join(f"{chr(97 + i)}{chr(97 + k)}" for k in range(24)), "s", "en") for i in range(8)], SCHEMA)
    assert {(r.n_removed_words, r.kept) for r in quality.quality(other).collect()} == {(12, True)}
    assert {r.text.count("\n") for r in quality.judged(other).collect()} == {0}
    assert quality.judged(odd).count() == odd.count() and quality.quality(odd.where("false")).count() == 0


def test_urls(spark):
    url = ["https://A.Example.com/en/1?x", "http://example.com/en/77", "ftp://x.net/de/1", "http://example.net/de/8", "https://o.org/es", None, "nothing", "http://h.com/fr/9#a", "http://xexample.com/en/7"]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(spark.createDataFrame(list(enumerate(url)), "page_id long, url string")).collect()}
    assert got[0] == ("a.example.com", "/en/1", "com/en/", "block") and got[1] == ("example.com", "/en/77", "example.com/en/7", "allow")
    assert got[2][2:] == ("net/de/", "block") and got[3][2:] == ("example.net/de/8", "block") and got[4] == ("o.org", "/es", None, "allow")
    assert got[5] == got[6] == ("", "", None, "allow") and got[7][2:] == (None, "allow") and got[8][2:] == ("com/en/", "block")


def test_html(spark):
    page = "<head><title>t</title></head><body><nav><a href=1>Home</a> <a href=2>News</a></nav><div class=ad>Buy now</div><article><h1>Head &amp; more</h1><p><b>First  line<br>goes on<p>Two.</p><script>var a='</p>'</script><section class=comments><p>I like it.</p></section></article><footer>&copy; x</footer>"
    assert html_text.main_text(page, html_text.model()) == "Head & more\nFirst line goes on\nTwo."
    df = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "<p>")], "page_id long, html string")
    assert {r.page_id: r.n_chars for r in html_text.extract(df).collect()} == {1: 35, 2: 0, 3: 0, 4: 0}


@pytest.mark.parametrize("bound", [line_dedup.BROADCAST_BYTES, 0])
def test_line_dedup(spark, odd, bound):
    """Both ways of the index: sent to all, and probed on its shards."""
    got = {(r.doc_id, r.n_lines): r for r in line_dedup.dedup_lines(odd, broadcast_bytes=bound, shard_keys=1).collect()}
    for i in range(8):
        r = got[200 + i, 3]
        assert r.n_dropped == (0 if i == 7 else 2)
        assert (r.text.startswith(LINE)) == (i == 7)
    assert got[100, 1].text is None and got[101, 1].text == "" and got[301, 2].n_dropped == 0
    assert line_dedup.dedup_lines(odd.where("false"), broadcast_bytes=bound).count() == 0


def test_line_index_finds_its_keys_and_no_others():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, (2, 5000), dtype=np.uint64)
    index = line_dedup.LineIndex.loads(line_dedup.LineIndex.build(h[0], h[1], np.full(5000, 7), np.arange(5000)).dumps())
    count, last = index.find(h[0], h[1])
    assert (count == 7).all() and (last == np.arange(5000)).all()
    assert (index.find(h[0] + np.uint64(1), h[1])[0] == 0).all() and (index.find(h[0], h[1] ^ np.uint64(1))[0] == 0).all()
