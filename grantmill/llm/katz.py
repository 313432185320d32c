"""LM scoring: a Katz backoff bigram model with Good-Turing discounts.

Tokens are the lower-cased words of a text and one end. The unigram level gives a token with count c
(c + 0.5) / (N + 0.5 (V + 1)), which sums to one over the V known tokens and one unknown. A context is any
word of the training documents, or the start of a text; after an unknown word the unigram level holds as it
is. After a context v, a token w seen r > 0 times has d_r * r / total(v), d_r the
Good-Turing discount up to r = K, and any other token has alpha(v) times its unigram probability. alpha(v)
is the mass left by the seen tokens divided by the unigram mass of the unseen ones, so that the
probabilities after each context sum to one.

The counts are tables dealt by token: a partition holds all counts of its tokens, its rows are packed
arrays. Texts send their tokens with their contexts to the partitions and get sums back. Frequent tokens
are dealt by token and context, and pairs of two very frequent tokens (share 1 / FREQUENT at least) are
scored where the text is, from a table that can't have more than FREQUENT^2 rows. Every table that is sent
to all executors is bounded by CONTEXTS or FREQUENT^2 at any size of the corpus.

Words with a share of at least 1 / CONTEXTS have ids and their totals and alphas are sent to all. Any other
context is rare: its pairs, total and alpha are in tables dealt by context, the parts after those by token.
Where the token is rare too, its unigram probability comes from the token's part and the rest of the score
from the context's, whose table has the unigram counts of the followers.

A null or empty text is its end alone. Rows that repeat are learnt from and scored each. Words are
compared by 64-bit hashes.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantmill.llm.common import map_arrow, release, saved, splitmix, squeezed, table, texts, unsqueezed, word_hashes

CONTEXTS, FREQUENT, K = 60_000, 1024, 5
CHUNK_TOKENS, PARTITION_TOKENS, LEAST_PARTITIONS = 750_000, 6_000_000, 24
END, BOS = np.uint64(0x656E64), np.uint64(0x626F73)
FOLDS, HELD_OUT = 5, 1


def held_out(doc_id: int | None) -> bool:
    """A null doc_id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def tokens(raw: bytes) -> np.ndarray:
    return np.append(word_hashes(raw), END)


def _chunks(batches, only_train: bool):
    """(keys, doc_ids, held, sizes, tokens, contexts) of some documents at a time, within bounds of tokens and documents."""
    docs: list = []
    size = 0
    for b in batches:
        ids, hashes = b.column(0).to_pylist(), b.column(1).to_pylist()
        for doc, h, raw in zip(ids, hashes, texts(b, "text"), strict=True):
            held = held_out(doc)
            if only_train and held:
                continue
            docs.append((doc, h, held, tokens(raw)))
            size += len(docs[-1][3])
            if size >= CHUNK_TOKENS or len(docs) >= 60_000:
                yield _chunk(docs)
                docs, size = [], 0
    if docs:
        yield _chunk(docs)


def _chunk(docs: list):
    ids = np.array([0 if d[0] is None else d[0] for d in docs], dtype=np.int64).view(np.uint64)
    none = np.array([d[0] is None for d in docs], dtype=np.uint64)
    with np.errstate(over="ignore"):
        keys = splitmix(splitmix(ids) + none + np.array([d[1] for d in docs], dtype=np.int64).view(np.uint64))
    sizes = np.array([len(d[3]) for d in docs])
    w = np.concatenate([d[3] for d in docs])
    v = np.concatenate(([BOS], w[:-1]))
    v[np.cumsum(sizes)[:-1]] = BOS
    return keys, [d[0] for d in docs], np.array([d[2] for d in docs]), sizes, w, v


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), "text")


def unigrams(docs: DataFrame) -> DataFrame:
    """word (hash), c: the tokens' counts in the training documents; start of text counts as a word of its own."""

    def run(batches):
        for _, _, _, sizes, w, _ in _chunks(batches, True):
            words, c = np.unique(w, return_counts=True)
            words, c = np.append(words, BOS), np.append(c, len(sizes))
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(c.astype(np.int64))], ["word", "c"])

    return map_arrow(_keyed(docs), run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Head:
    """The frequent contexts, sorted by hash, with their counts; id 0 is every other word. Pairs of frequent ones have codes."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, n: int):
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]
        often = self.counts * FREQUENT >= n
        self.often = np.concatenate(([0], np.where(often, np.cumsum(often), 0)))

    def ids(self, words: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.words, words), max(0, len(self.words) - 1))
        return np.where(self.words[at] == words, at + 1, 0)

    def near(self, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs (of ids) are of two frequent words, and their codes."""
        a, b = self.often[v], self.often[w]
        return (a > 0) & (b > 0), a * (FREQUENT + 2) + b

    def parts(self, w: np.ndarray, wid: np.ndarray, v: np.ndarray, parts: int) -> np.ndarray:
        """Frequent tokens are dealt by token and context, others by token."""
        with np.errstate(over="ignore"):
            h = splitmix(w + np.where(wid > 0, v, 0).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return ((h >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64)


def near_pairs(docs: DataFrame, head) -> DataFrame:
    """code, r of the pairs of two frequent words."""

    def run(batches):
        h = head.value
        for _, _, _, _, w, v in _chunks(batches, True):
            own, code = h.near(h.ids(v), h.ids(w))
            codes, r = np.unique(code[own], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(r)], ["code", "r"])

    return map_arrow(_keyed(docs), run, "code long, r long").groupBy("code").agg(F.sum("r").alias("r"))


def _split(part: np.ndarray, columns: list[np.ndarray]):
    """(part, columns) for each part, in order; columns sorted by part, then as they are. Nothing where there are no rows."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    part, columns = part[order], [c[order] for c in columns]
    cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    for i, (a, b) in enumerate(zip(cut, [*cut[1:], len(part)], strict=True)):
        yield int(part[cut[i]]), [c[a:b] for c in columns]


def _grouped(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of a sorted array and how often each stands there."""
    start = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1]))) if len(w) else np.empty(0, np.int64)
    return w[start], np.diff(np.append(start, len(w))).astype(np.uint32)


def _by_context(v: np.ndarray, head: Head, parts: int) -> np.ndarray:
    """The parts of rare contexts: they come after the parts of the tokens."""
    none = np.zeros(len(v), np.int64)
    return parts + head.parts(v, none, none, parts)


def counts(docs: DataFrame, head, parts: int) -> DataFrame:
    """part, blob: each chunk's distinct (token, context) with their counts, packed.

    A frequent context is its id, a rare one its hash; pairs of a rare context and a frequent token are dealt
    by context, as (context, token id).
    """

    def run(batches):
        h = head.value
        for _, _, _, _, w, v in _chunks(batches, True):
            vid, wid = h.ids(v), h.ids(w)
            away = (vid > 0) & ~h.near(vid, wid)[0]
            found = []
            for first, second, kind, part in (
                (w[away], vid[away], np.uint16, lambda a, b: h.parts(a, h.ids(a), b, parts)),
                (w[both := (vid == 0) & (wid == 0)], v[both], np.uint64, lambda a, b: h.parts(a, np.zeros(len(a), np.int64), b, parts)),
                (v[rare := (vid == 0) & (wid > 0)], wid[rare], np.uint16, lambda a, b: _by_context(a, h, parts)),
            ):
                first, second, r = _merged(first, second, np.ones(len(first), np.int64))
                if len(r):
                    found += [(p, squeezed([*_grouped(c[0]), c[1].astype(kind), c[2].astype(np.uint32)])) for p, c in _split(part(first, second), [first, second, r])]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], ["part", "blob"])

    return map_arrow(_keyed(docs), run, "part int, blob binary")


def _merged(w: np.ndarray, v: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((v, w))
    w, v, r = w[order], v[order], r[order]
    start = np.flatnonzero(np.concatenate(([True], (w[1:] != w[:-1]) | (v[1:] != v[:-1])))[: len(w)])
    return w[start], v[start], np.add.reduceat(r, start) if len(start) else r


_STATS = [f"n{r}" for r in range(1, K + 2)] + ["more", "mass", "seen", "total"]


def _stats(v: np.ndarray, r: np.ndarray, c: np.ndarray) -> dict[str, np.ndarray]:
    """Per context: pairs seen 1..K+1 times, counts above K, the seen tokens' unigram counts, pairs and tokens."""
    ids, at = np.unique(v, return_inverse=True)
    add = lambda x: np.bincount(at, weights=x, minlength=len(ids)).astype(np.int64)
    out = {"vid": ids.astype(np.int64)} | {f"n{k}": add(r == k) for k in range(1, K + 2)}
    return out | {"more": add(np.where(r > K, r, 0)), "mass": add(c), "seen": add(np.ones(len(r))), "total": add(r)}


def model(sent: DataFrame, head, parts: int) -> DataFrame:
    """The partitioned count tables (part, blob) and, in rows with vid, each partition's sums per frequent context.

    Parts of rare contexts get one table of their pairs with frequent tokens and, from the parts of the tokens,
    those with rare tokens and the tokens' counts. Their sums are one row, of vid 0.
    """
    schema = "part int, blob binary, vid long, " + ", ".join(f"{c} long" for c in _STATS)
    names = ["part", "blob", "vid", *_STATS]

    def tables(found):
        none = [pa.nulls(len(found), pa.int64()) for _ in names[2:]]
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary()), *none], names)

    def sums(p, s):
        n = len(s["vid"])
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, p, np.int32)), pa.nulls(n, pa.binary()), *[pa.array(s[x]) for x in names[2:]]], names)

    def run(batches):
        h = head.value
        own: dict[tuple[int, bool], list] = {}  # by part and whether both words are rare
        size: dict[tuple[int, bool], int] = {}

        def shrink(p):
            w, v, r = (np.concatenate(x) for x in zip(*own[p], strict=True))
            own[p] = [_merged(w, v, r)]
            size[p] = 2 * len(own[p][0][0])

        def add(p, w, v, r):
            own.setdefault(p, []).append((w, v, r))
            # merged when what came in since is as much as there was: bounded by the distinct pairs
            if sum(len(x[0]) for x in own[p]) > max(1_000_000, size.get(p, 0)):
                shrink(p)

        def finish(p):
            shrink((p, False))
            w, v, r = own.pop((p, False))[0]
            words, k = _grouped(w)
            if p >= parts:
                yield tables([(p, squeezed([words, k, v, r.astype(np.uint32)]))])
                yield sums(p, _stats(np.zeros(len(r), np.int64), r, r))
                return
            c = np.add.reduceat(r, np.cumsum(k.astype(np.int64)) - k) if len(words) else r
            wid = h.ids(words)
            c = np.where(wid > 0, h.counts[np.maximum(wid, 1) - 1], c)
            yield tables([(p, squeezed([words, k, c.astype(np.int64), v, r.astype(np.uint32)]))])
            in_context = v > 0
            yield sums(p, _stats(v[in_context], r[in_context], np.repeat(c, k)[in_context]))
            del w, v, r, k
            if (p, True) in own:
                shrink((p, True))
                w, v, r = own.pop((p, True))[0]
                yield sums(p, _stats(np.zeros(len(r), np.int64), r, r))
                c = c[np.searchsorted(words, w)]
                order = np.argsort(v, kind="stable")
                w, v, r, c = w[order], v[order], r[order], c[order]
                yield tables([(q, squeezed([*_grouped(x[0]), x[1], x[2].astype(np.uint32), x[3].astype(np.uint32)])) for q, x in _split(_by_context(v, h, parts), [v, w, r, c])])

        now = None
        for b in batches:
            for p, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if now is not None and p != now:  # parts come one after the other: one is held at a time
                    yield from finish(now)
                now = p
                words, k, v, r = unsqueezed(blob.as_py())
                r = r.astype(np.int64)
                both = v.dtype == np.uint64
                add((p, both), np.repeat(words, k), v, r)
                if both:  # the token's own count has them as well
                    add((p, False), words, np.zeros(len(words), np.uint16), np.add.reduceat(r, np.cumsum(k.astype(np.int64)) - k))
        if now is not None:
            yield from finish(now)

    return map_arrow(sent.repartition(2 * parts, "part").sortWithinPartitions("part"), run, schema)


class Parameters:
    """N, V, the discounts, and per context id the total by which counts are divided and log10 of alpha."""

    def __init__(self, n: int, v: int, stats: dict[str, np.ndarray], contexts: int):
        self.n, self.v = n, v
        self.norm = n + 0.5 * (v + 1)
        times = [int(stats[f"n{k}"].sum()) for k in range(1, K + 2)]
        self.discount = self.good_turing(times)
        self.log_total, self.log_alpha = np.zeros(contexts + 1), np.zeros(contexts + 1)
        own = stats["vid"] > 0  # the row of id 0 is of all rare contexts
        at = stats["vid"][own]
        self.log_total[at], self.log_alpha[at] = self.levels({c: x[own] for c, x in stats.items()})

    def levels(self, stats: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """log10 of the total and of alpha of contexts with these sums."""
        kept = sum(d * k * stats[f"n{k}"] for k, d in enumerate(self.discount, 1)) + stats["more"]
        total = stats["total"].astype(float)
        total += kept >= total * (1 - 1e-9)  # nothing was discounted: one more keeps mass for the rest
        return np.log10(total), np.log10(1 - kept / total) - np.log10(1 - (stats["mass"] + 0.5 * stats["seen"]) / self.norm)

    @staticmethod
    def good_turing(times: list[int]) -> np.ndarray:
        """d_1..d_K; where the counts of counts give no proper discount, a half is taken from each count."""
        r = np.arange(1, K + 1)
        if min(times) > 0:
            top = (K + 1) * times[K] / times[0]
            d = np.array([((k + 1) * times[k] / (k * times[k - 1]) - top) / (1 - top) if top != 1 else -1 for k in r])
            if ((d > 0) & (d < 1)).all():
                return d
        return 1 - 0.5 / r

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / self.norm)

    def score(self, v: np.ndarray, r: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Log10 probabilities of tokens seen r times after context ids v."""
        return np.where((v > 0) & (r > 0), self.seen(r) - self.log_total[v], self.log_alpha[v] + base)

    def seen(self, r: np.ndarray) -> np.ndarray:
        """Log10 of the discounted counts."""
        d = np.concatenate((self.discount, [1.0]))[np.minimum(np.maximum(r, 1), K + 1) - 1]
        return np.log10(d * np.maximum(r, 1))


def _found(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of x in a sorted table and which of them are there."""
    if not len(table):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return at, table[at] == x


class Rare:
    """The rare contexts of a part: their pairs, totals and alphas."""

    def __init__(self, blobs: list[list[np.ndarray]], head: Head, params: Parameters):
        self.head, self.params = head, params
        near = [b for b in blobs if len(b) == 4]
        far = [b for b in blobs if len(b) == 5]
        join = lambda x, kind: np.concatenate([np.empty(0, kind), *x])
        v1, v2 = (join([np.repeat(b[0], b[1]) for b in x], np.uint64) for x in (near, far))
        wid, r1 = (join([b[i].astype(np.int64) for b in near], np.int64) for i in (2, 3))
        w, r2, c = join([b[2] for b in far], np.uint64), *(join([b[i].astype(np.int64) for b in far], np.int64) for i in (3, 4))
        self.words, at = np.unique(np.concatenate((v1, v2)), return_inverse=True)
        self.log_total, self.log_alpha = params.levels(_stats(at, np.concatenate((r1, r2)), np.concatenate((head.counts[wid - 1], c))))
        code, pair = (at[: len(v1)] << 16) + wid, self.pair(v2, w)
        order, order2 = np.argsort(code), np.argsort(pair)
        self.code, self.r = code[order], r1[order]
        self.pairs, self.pair_r, self.pair_c = pair[order2], r2[order2], c[order2]

    @staticmethod
    def pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return splitmix(splitmix(v) + w)

    def score(self, words, k, wid, w) -> tuple[np.ndarray, np.ndarray]:
        """Unigram counts (0 where the token is rare) and log10 probabilities of tokens after these contexts.

        wid has the tokens' ids, w the rare tokens. Those get their unigram probability in their own part; here
        it is taken off again where the pair is seen."""
        at, known = _found(self.words, words)
        at, known, v = np.repeat(at, k), np.repeat(known, k), np.repeat(words, k)
        often = wid > 0
        r, taken, c = np.zeros(len(wid), np.int64), np.zeros(len(wid)), np.where(often, self.head.counts[np.maximum(wid, 1) - 1], 0)
        base = np.where(often, self.params.base(c), 0.0)
        place, hit = _found(self.code, (at << 16) + wid)
        hit &= often & known
        r[hit] = self.r[place[hit]]
        place, hit = _found(self.pairs, self.pair(v[~often], w))
        rare = np.flatnonzero(~often)[hit]
        r[rare], taken[rare] = self.pair_r[place[hit]], self.params.base(self.pair_c[place[hit]])
        total, alpha = (x[at] if len(x) else np.zeros(len(at)) for x in (self.log_total, self.log_alpha))
        return c, np.where(r > 0, self.params.seen(r) - total - taken, np.where(known, alpha, 0.0) + base)


_FACTS = "key long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
_SUMS = "key long, n_known long, base_score double, score double"


def _sums(keys, known, base, score, **facts) -> pa.RecordBatch:
    cols = {"key": pa.array(keys.view(np.int64)), **facts, "n_known": pa.array(known.astype(np.int64)), "base_score": pa.array(base.astype(np.float64)), "score": pa.array(score.astype(np.float64))}
    return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))


def near_scores(docs: DataFrame, head, near, params) -> DataFrame:
    """One row a document: its facts and the sums of its pairs of frequent words."""

    def run(batches):
        h, (codes, rs), p = head.value, near.value, params.value
        for keys, ids, held, sizes, w, v in _chunks(batches, False):
            vid, wid = h.ids(v), h.ids(w)
            own, code = h.near(vid, wid)
            doc = np.repeat(np.arange(len(keys)), sizes)[own]
            code, vid, wid = code[own], vid[own], wid[own]
            at = np.minimum(np.searchsorted(codes, code), max(0, len(codes) - 1))
            r = np.where(codes[at] == code, rs[at], 0) if len(codes) else np.zeros(len(code), np.int64)
            base = p.base(h.counts[wid - 1]) if len(wid) else np.empty(0)
            add = lambda x: np.bincount(doc, weights=x, minlength=len(keys))  # noqa: E731, B023
            facts = {"doc_id": pa.array(ids, pa.int64()), "held_out": pa.array(held), "n_tokens": pa.array(sizes.astype(np.int64))}
            yield _sums(keys, add(np.ones(len(doc))), add(base), add(p.score(vid, r, base)), **facts)

    return map_arrow(_keyed(docs), run, _FACTS)


def events(docs: DataFrame, head, parts: int) -> DataFrame:
    """part, kind, blob: the tokens of each chunk's documents with their contexts, dealt like the counts.

    Tokens after a rare context go to its part; if they are rare themselves, to their own as well."""

    def run(batches):
        h = head.value
        for keys, _, _, sizes, w, v in _chunks(batches, False):
            vid, wid = h.ids(v), h.ids(w)
            away = ~h.near(vid, wid)[0]
            doc = np.repeat(np.arange(len(keys)), sizes)
            away &= (vid > 0) | (wid == 0)
            rare = np.flatnonzero(vid == 0)
            rare = rare[np.argsort(v[rare], kind="stable")]
            late = [(p, squeezed([keys, *_grouped(c[0]), c[1].astype(np.uint16), c[2].astype(np.uint16), c[3][c[1] == 0]])) for p, c in _split(_by_context(v[rare], h, parts), [v[rare], wid[rare], doc[rare], w[rare]])] if len(rare) else []
            doc, w, vid, wid = doc[away], w[away], vid[away], wid[away]
            part = h.parts(w, wid, vid, parts)
            order = np.argsort(w, kind="stable")
            found = [(p, squeezed([keys, *_grouped(c[0]), c[1].astype(np.uint16), c[2].astype(np.uint16)])) for p, c in _split(part[order], [w[order], vid[order], doc[order]])] if len(w) else []
            found += late
            n = len(found)
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int32()), pa.array(np.ones(n, np.int32)), pa.array([x for _, x in found], pa.binary())], ["part", "kind", "blob"])

    return map_arrow(_keyed(docs), run, "part int, kind int, blob binary")


def far_scores(sent: DataFrame, tables: DataFrame, head, params, parts: int) -> DataFrame:
    """Sums of the tokens that travelled. Each partition's table comes before its events, which pass one by one."""

    def run(batches):
        h, p, now, rare = head.value, params.value, None, (-1, [])
        for b in batches:
            for part, kind, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                parts_ = unsqueezed(blob.as_py())
                if part >= parts:
                    if rare[0] != part:
                        now, rare = None, (part, [])
                    if kind == 0:
                        rare[1].append(parts_)
                        continue
                    if isinstance(rare[1], list):
                        rare = (part, Rare(rare[1], h, p))
                    keys, words, k, wid, doc, w = parts_
                    c, score = rare[1].score(words, k, wid.astype(np.int64), w)
                    base = np.where(wid > 0, p.base(c), 0.0)
                    add = lambda x: np.bincount(doc, weights=x, minlength=len(keys))  # noqa: E731, B023
                    there = np.bincount(doc, minlength=len(keys)) > 0
                    yield _sums(keys[there], add(c > 0)[there], add(base)[there], add(score)[there])
                    continue
                if kind == 0:
                    words, k, c, v, r = parts_
                    now = (part, words, c, np.repeat(np.arange(len(words)) << 16, k) + v, r)
                    continue
                keys, words, k, vid, doc = parts_
                wid = h.ids(words)
                c, at = np.where(wid > 0, h.counts[np.maximum(wid, 1) - 1], 0), np.full(len(words), -1)
                if now and now[0] == part and len(now[1]):
                    place = np.minimum(np.searchsorted(now[1], words), len(now[1]) - 1)
                    hit = now[1][place] == words
                    c, at = np.where(hit, now[2][place], c), np.where(hit, place, -1)
                vid, doc = vid.astype(np.int64), doc.astype(np.int64)
                code = np.repeat(at, k) * 65536 + vid
                r = np.zeros(len(code), np.int64)
                if now and now[0] == part and len(now[3]):
                    place = np.minimum(np.searchsorted(now[3], code), len(now[3]) - 1)
                    r = np.where(now[3][place] == code, now[4][place], 0)
                c = np.repeat(c, k)
                base = p.base(c)
                add = lambda x: np.bincount(doc, weights=x, minlength=len(keys))  # noqa: E731, B023
                there = np.bincount(doc, minlength=len(keys)) > 0
                yield _sums(keys[there], add(c > 0)[there], add(base)[there], add(p.score(vid, r, base))[there])

    both = sent.unionByName(tables.select("part", F.lit(0).alias("kind"), "blob")).repartition(2 * parts, "part").sortWithinPartitions("part", "kind")
    return map_arrow(both, run, _SUMS)


def fit(docs: DataFrame) -> tuple:
    """head, near pairs, parameters (each sent to all executors) and the partitioned tables."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    uni = saved(unigrams(docs))
    words = uni.where(F.col("word") != int(BOS))
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = uni.where((F.col("c") * CONTEXTS >= n) | (F.col("word") == int(BOS))).toPandas()  # at most CONTEXTS + 1 rows
    own = Head(top["word"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64), n) if len(top) else Head(np.array([BOS]), np.array([0]), 1)
    head = sc.broadcast(own)
    parts = max(LEAST_PARTITIONS, n // PARTITION_TOKENS + 1)
    pairs = near_pairs(docs, head).toPandas().sort_values("code")  # at most (FREQUENT + 1)^2 rows
    codes, rs = pairs["code"].to_numpy(np.int64), pairs["r"].to_numpy(np.int64)
    near = sc.broadcast((codes, rs))
    learnt = saved(model(counts(docs, head, parts), head, parts))
    sums = learnt.where("vid is not null").groupBy("vid").agg(*[F.sum(c).alias(c) for c in _STATS]).toPandas()  # at most CONTEXTS + 2 rows
    place = np.full(FREQUENT + 3, 0)
    place[own.often[1:]] = np.arange(1, len(own.words) + 1)
    a, b = place[codes // (FREQUENT + 2)], place[codes % (FREQUENT + 2)]
    local = _stats(a, rs, own.counts[b - 1] if len(b) else rs)
    both = {c: np.concatenate((sums[c].to_numpy(np.int64), local[c])) for c in ("vid", *_STATS)}
    ids, at = np.unique(both["vid"], return_inverse=True)
    stats = {"vid": ids} | {c: np.bincount(at, weights=both[c], minlength=len(ids)).astype(np.int64) for c in _STATS}
    params = sc.broadcast(Parameters(int(n), int(v), stats, len(own.words)))
    return head, near, params, learnt.where("blob is not null"), parts


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs."""
    head, near, params, tables, parts = fit(docs)
    release(docs.sparkSession)  # the counts that travelled are in the tables now
    sums = ("n_known", "base_score", "score")
    far = far_scores(events(docs, head, parts), tables, head, params, parts).groupBy("key").agg(*[F.sum(c).alias(f"far_{c}") for c in sums])
    per = near_scores(docs, head, near, params).groupBy("key").agg(F.max("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), F.first("n_tokens").alias("n_tokens"), F.count("*").alias("k"), *[F.sum(c).alias(c) for c in sums])
    per = per.join(far, "key", "left")
    share = lambda c: (F.col(c) + F.coalesce(f"far_{c}", F.lit(0))) / F.col("k")
    one = per.select("doc_id", "held_out", "n_tokens", share("n_known").cast("long").alias("n_known"), F.lit(params.value.n).cast("long").alias("train_tokens"), share("base_score").alias("base_score"), share("score").alias("score"), F.explode(F.sequence(F.lit(1).cast("long"), "k")).alias("_k"))
    return one.drop("_k")


def op6(spark, sf_dir):
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"))
