"""N-gram Jaccard join by universe-partition pigeonhole.

A document is the set of hashes of its distinct 5-word shingles. Sizes fall into bands of ratio 4/3, so a
partner with Jaccard 0.75 or more is in the same band or the next lower or upper one. Each band cuts the
hash range into segments. The sets of a pair whose smaller one is in the band differ in at most
H = (x + y) / 7 hashes, so any H + 1 segments in which one of them isn't empty have one in which the sets
agree. Signatures of the segments' subsets meet in buckets:

1. Every set sends the signatures of its non-empty segments, in its band and, as the larger partner, in
   the next lower band. Pairs in buckets of at most BUCKET sets are candidates. A set that keeps H + 1
   segments without those in larger buckets has met all its partners.
2. Sets that don't (the cost-based allocation gives large buckets no credit) also send their segments with
   one hash deleted: a segment of two or more hashes whose deletions stay in small buckets counts two
   credits. Only pairs of two such sets can be missing.
3. What still lacks credits, mostly members of large groups of near copies, is compared inside as many of
   its large buckets as it lacks credits: first with a few central members, then, between different
   components, block by block.

Candidates are verified exactly on the sets. Equal sets are one node from the start. Candidates inside a
component already found are skipped, since only components are returned; no link between components is
lost. Signatures travel packed, 11 bytes each, in a number of partitions that follows their number.

Null and empty texts and those without words have no shingle and no link. Rows with a null doc_id are not
linked and have a null component. Rows that repeat a doc_id are one document with all its texts' links.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grantmill.llm.common import guarded, map_arrow, packed, saved, splitmix, table, texts, trim, unpacked, word_hashes
from grantmill.llm.components import components

WORDS, BUCKET, STARS = 5, 24, 2
#: Sets and hashes in a block, and distinct hashes and rows compared at a time (memory only, not results), where members of large buckets meet.
BLOCK, BLOCK_HASHES, BLOCK_TOKENS, BLOCK_ROWS = 2048, 400_000, 512, 256
#: Signatures gathered in one partition, and held by one task before it sends them.
PARTITION_SIGNATURES, HELD_SIGNATURES = 1_000_000, 1_000_000
#: Pairs of small buckets counted at a time; a pair met in two such lots is two rows, which are added up later.
PAIRS = 500_000
_C = np.uint64(0xA0761D6478BD642F)


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's word n-grams; of the whole sequence if it is shorter."""
    w = word_hashes(text)
    if not len(w):
        return w
    with np.errstate(over="ignore"):
        if len(w) < words:
            h = np.uint64(len(w))
            for x in w:
                h = h * _C + x
            return splitmix(np.array([h], dtype=np.uint64))
        h = np.full(len(w) - words + 1, words, dtype=np.uint64)
        for k in range(words):
            h = h * _C + w[k : len(w) - words + 1 + k]
        return np.unique(splitmix(h))


def fingerprint(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        total = splitmix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(s))
        return int(splitmix(np.array([total], dtype=np.uint64))[0])


@functools.lru_cache(1)
def bands() -> tuple[np.ndarray, np.ndarray]:
    """The least size of each band and its number of segments."""
    low = [1]
    while low[-1] < 1 << 40:
        low.append(max(low[-1] + 1, -(-low[-1] * 4 // 3)))
    top = np.array(low[1:]) - 1
    most = (top + top * 4 // 3) // 7
    return np.array(low[:-1]), np.maximum(most + 1, -(-top * 42 // 100)) + (most > 0)


def band_of(n: int) -> int:
    return int(np.searchsorted(bands()[0], n, side="right")) - 1


def needs(n: int) -> tuple[int, int]:
    """Credits that rule out a missed partner: in the set's own band, and of a smaller one in the next lower band (0: none there)."""
    k = band_of(n)
    own = (n + n * 4 // 3) // 7 + 1
    top = int(bands()[0][k]) - 1
    return own, (top + n) // 7 + 1 if k and top >= -(-3 * n // 4) else 0


def segments(s: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """The start of each non-empty segment in the sorted set, and its signature; equal subsets, equal signatures."""
    m = np.uint64(bands()[1][band])
    seg = (s >> np.uint64(32)) * m >> np.uint64(32)
    start = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
    with np.errstate(over="ignore"):
        return start, np.add.reduceat(splitmix(s ^ np.uint64(band + 1)), start)


def _filled(s: np.ndarray, band: int) -> tuple[int, int]:
    """Non-empty segments, and those of one hash."""
    start = segments(s, band)[0]
    return len(start), int((np.diff(np.append(start, len(s))) == 1).sum())


def profile(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n (size of the set), node (its fingerprint), e_own and e_low (non-empty segments in the two bands), s_own and s_low (those of one hash), band, low_top (greatest size in the lower band)."""

    names = ("n", "node", "e_own", "e_low", "s_own", "s_low", "band", "low_top")

    def run(batches):
        for b in batches:
            rows = []
            for raw in texts(b, "text"):
                s = shingles(raw, words)
                n = len(s)
                if n:
                    k, low = band_of(n), needs(n)[1]
                    (e_own, s_own), (e_low, s_low) = (_filled(s, b_) if there else (0, 0) for b_, there in ((k, True), (k - 1, low)))
                    rows.append((n, fingerprint(s), e_own, e_low, s_own, s_low, k, int(bands()[0][k]) - 1))
                else:
                    rows.append((0,) * 8)
            cols = np.array(rows, dtype=np.uint64).reshape(-1, 8).T
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(x).view(np.int64)) for x in cols)], ["doc_id", *names])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, " + ", ".join(f"{x} long" for x in names))


def _sent(sig: np.ndarray, ids: np.ndarray, parts: int):
    """Signatures and ids, dealt by signature into packed blobs. In a blob a signature keeps 40 bits; an id has 48."""
    sig = splitmix(sig)
    part = ((sig >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    sig, ids, part = sig[order], ids[order], part[order]
    cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    blobs = [packed([s.astype(np.uint32), (s >> np.uint64(32)).astype(np.uint8), i.astype(np.uint32), (i >> np.uint64(32)).astype(np.uint16)]) for s, i in zip(np.split(sig, cut[1:]), np.split(ids, cut[1:]), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(part[cut].astype(np.int32)), pa.array(blobs, pa.binary())], ["part", "blob"])


def _signatures(s: np.ndarray, deletions: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of one set: signatures and ids. An id is 46 bits of the fingerprint, whether a hash is deleted, and whether the band is the lower one."""
    k, low = band_of(len(s)), needs(len(s))[1]
    node = np.uint64(fingerprint(s) >> 18 << 2)
    sigs, ids = [], []
    for role, band in ((0, k), (1, k - 1)) if low else ((0, k),):
        start, sig = segments(s, band)
        m, seed = np.uint64(bands()[1][band]), np.uint64(band << 40)
        with np.errstate(over="ignore"):
            place = splitmix(((s[start] >> np.uint64(32)) * m >> np.uint64(32)) + seed)
            sigs.append(sig + place)
            ids.append(np.full(len(sig), node + np.uint64(role)))
            if deletions:
                length = np.diff(np.append(start, len(s)))
                each = np.repeat(np.arange(len(start)), length)
                more = length[each] > 1  # what is left of a single hash would meet no one: empty segments aren't sent
                each = each[more]
                sigs.append(sig[each] + place[each] - splitmix(s[more] ^ np.uint64(band + 1)))
                ids.append(np.full(len(each), node + np.uint64(2 + role)))
    return np.concatenate(sigs), np.concatenate(ids)


def signatures(docs: DataFrame, parts: int, words: int = WORDS, deletions: bool = False) -> DataFrame:
    """part, blob. A task sends a set once, however many of its documents have it."""

    def run(batches):
        seen: set[int] = set()
        held: list = []
        size = 0
        for b in batches:
            for raw in texts(b, "text"):
                s = shingles(raw, words)
                if len(s) and (f := fingerprint(s)) not in seen:
                    seen.add(f)
                    held.append(_signatures(s, deletions))
                    size += len(held[-1][0])
                    if size >= HELD_SIGNATURES:
                        yield _sent(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]), parts)
                        held, size = [], 0
        if held:
            yield _sent(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]), parts)

    return map_arrow(docs.select("text"), run, "part int, blob binary")


def _runs(sig: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (signature, id) of the signatures that several ids have, in order; the runs' starts and lengths."""
    order = np.argsort(sig, kind="stable")
    sig, ids = sig[order], ids[order]
    same = sig[1:] == sig[:-1]
    keep = np.concatenate((same, [False])) | np.concatenate(([False], same))
    sig, ids = sig[keep], ids[keep]
    order = np.lexsort((ids, sig))
    sig, ids = sig[order], ids[order]
    first = np.concatenate(([True], (sig[1:] != sig[:-1]) | (ids[1:] != ids[:-1])))[: len(sig)]
    sig, ids = sig[first], ids[first]
    start = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1]))[: len(sig)])
    return sig, ids, start, np.diff(np.append(start, len(sig)))


def _counted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs a < b and how often each stands there."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    start = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[: len(a)])
    c = np.diff(np.append(start, len(a)))
    a, b = a[start], b[start]
    return a[a < b], b[a < b], c[a < b]


def _pairs(part: int, blobs: list[bytes], bucket: int, deletions: bool) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(0, least, greatest, common buckets) of the candidates and (1, key, id, ids in the bucket) of the rows in large buckets."""
    cols = [np.concatenate(x) for x in zip(*map(unpacked, blobs), strict=True)]
    sig = cols[0].astype(np.uint64) | cols[1].astype(np.uint64) << np.uint64(32)
    ids = cols[2].astype(np.uint64) | cols[3].astype(np.uint64) << np.uint64(32)
    sig, ids, start, length = _runs(sig, ids)
    out = []
    heavy = length > bucket
    rows = np.repeat(heavy, length)
    if rows.any():
        out.append((1, (sig[rows] | np.uint64(part) << np.uint64(40)).view(np.int64), ids[rows].view(np.int64), np.repeat(length, length)[rows]))
    for size in range(2, bucket + 1):
        at, step = start[length == size], max(1, PAIRS * 2 // (size * (size - 1)))
        for lo in range(0, len(at), step):
            group = ids[at[lo : lo + step, None] + np.arange(size)]
            i, j = np.triu_indices(size, 1)
            a, b = group[:, i].ravel(), group[:, j].ravel()
            keep = (a & b & np.uint64(1)) == 0
            if deletions:
                keep &= ((a ^ b) & np.uint64(2)) != 0
            a, b = a[keep] >> np.uint64(2), b[keep] >> np.uint64(2)
            a, b, c = _counted(np.minimum(a, b), np.maximum(a, b))
            out.append((0, a.view(np.int64), b.view(np.int64), c))
    return out


def buckets(sent: DataFrame, parts: int, bucket: int, deletions: bool = False) -> DataFrame:
    """kind, x, y, c as _pairs gives them."""

    def run(batches):
        own: dict[int, list[bytes]] = {}
        for b in batches:
            for part, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own.setdefault(part, []).append(blob.as_py())
        for part in list(own):
            for kind, x, y, c in _pairs(part, own.pop(part), bucket, deletions):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, dtype=np.int32)), pa.array(x), pa.array(y), pa.array(c.astype(np.int64))], ["kind", "x", "y", "c"])

    return map_arrow(sent.repartition(parts, "part"), run, "kind int, x long, y long, c long")


def _named(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Candidates (x, y: 46 bits of the fingerprints) as nodes a < b that can be linked.

    A linked pair differs in at most H segments, so it agrees in at least e - lost - H segments in small
    buckets (l1), e and lost being those of either set; with deletions, 2 l1 + l2 is at least
    2 (e - lost) - s - lost2 - H, s being the segments of one hash. Fewer common buckets rule a link out.
    """
    c = classes.select(F.shiftrightunsigned("node", 18).alias("short"), "node", "n", "band", "b1_own", "b1_low", "b2_own", "b2_low")
    p = pairs.groupBy("x", "y").agg(F.sum("l1").alias("l1"), F.sum("l2").alias("l2"))
    for k, key in (("a", "x"), ("b", "y")):
        side = c.select(*[F.col(x).alias(f"{k}_{x}") for x in c.columns])
        p = p.join(side, p[key] == side[f"{k}_short"])
    p = p.where((4 * F.least("a_n", "b_n") >= 3 * F.greatest("a_n", "b_n")) & (F.col("a_node") != F.col("b_node")))
    most = F.floor((F.col("a_n") + F.col("b_n")) / 7)
    bound = lambda k, o, i: F.when(F.col(f"{k}_band") > F.col(f"{o}_band"), F.col(f"{k}_b{i}_low")).otherwise(F.col(f"{k}_b{i}_own"))
    p = p.where(F.col("l1") >= F.greatest(bound("a", "b", 1), bound("b", "a", 1)) - most)
    # deletions count only where both have sent them
    second = bound("a", "b", 2).isNull() | bound("b", "a", 2).isNull() | (2 * F.col("l1") + F.col("l2") >= F.greatest(bound("a", "b", 2), bound("b", "a", 2)) - most)
    return p.where(second).select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct()


#: Up to this many ids are sent to all executors to pick documents; more ids are joined.
BROADCAST_IDS = 1_000_000


def _picked(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts of the wanted (saved) classes' representatives, with node."""
    wanted = wanted.select("rep", "node")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    return docs.select(F.col("doc_id").cast("long").alias("_d"), "text").join(wanted, F.col("_d") == wanted["rep"]).select("node", "text")


def sets_of(docs: DataFrame, wanted: DataFrame, words: int = WORDS) -> DataFrame:
    """node, hashes for the wanted classes (rep, node): each is made from the text of its representative."""

    def run(batches):
        for b in batches:
            nodes, blobs = [], []
            for node, raw in zip(b.column(0).to_pylist(), texts(b, "text"), strict=True):
                s = shingles(raw, words)
                if len(s) and np.uint64(fingerprint(s)).astype(np.int64) == node:
                    nodes.append(node)
                    blobs.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(blobs, pa.binary())], ["node", "hashes"])

    return map_arrow(_picked(docs, wanted), run, "node long, hashes binary")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= 75 * union."""

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = (np.frombuffer(z.as_py(), dtype=np.uint64) for z in (x, y))
                both = np.sort(np.concatenate((x, y)), kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= 75 * (len(both) - same))
            yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], ["a", "b"])

    one, two = (sets.select(F.col("node").alias(f"_{k}"), F.col("hashes").alias(f"h{k}")) for k in "ab")
    rows = pairs.join(two, pairs["b"] == two["_b"]).join(one, F.col("a") == one["_a"])
    return map_arrow(rows.select("a", "b", "ha", "hb"), run, "a long, b long")


def _between(pairs: DataFrame, comps: DataFrame | None) -> DataFrame:
    """The pairs whose ends aren't in one component yet."""
    if comps is None:
        return pairs
    for k in "ab":
        c = comps.select(F.col("node").alias(f"_{k}"), F.col("component").alias(f"_c{k}"))
        pairs = pairs.join(c, pairs[k] == c[f"_{k}"], "left")
    return pairs.where(F.coalesce("_ca", "a") != F.coalesce("_cb", "b")).select("a", "b")


def _block_links(table_: pa.Table) -> pa.Table:
    """Links between the two sides of a block pair, one for each node of the first and component of the second.

    The work is held in strips, of tokens while common hashes are counted and of rows while links are found; what is
    free at the end goes back to the machine, as the worker lives on."""
    out = _links(*(table_.column(c).to_numpy() for c in ("side", "node", "component")), [np.frombuffer(x.as_py(), dtype=np.uint64) for x in table_.column("hashes")])
    trim()
    return out


def _links(side: np.ndarray, node: np.ndarray, comp: np.ndarray, sets: list[np.ndarray]) -> pa.Table:
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    x, y = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    if len(left) and len(right):
        right = right[np.argsort(comp[right], kind="stable")]
        size = np.array([len(s) for s in sets])
        same = _common(left, right, sets, size)
        starts = np.flatnonzero(np.concatenate(([True], comp[right][1:] != comp[right][:-1])))
        cols = np.arange(len(right), dtype=np.int32)
        for lo in range(0, len(left), BLOCK_ROWS):
            l, s = left[lo : lo + BLOCK_ROWS], same[lo : lo + BLOCK_ROWS].astype(np.int64)
            linked = 100 * s >= 75 * (size[l][:, None] + size[right][None, :] - s)
            linked &= comp[l][:, None] != comp[right][None, :]
            first = np.minimum.reduceat(np.where(linked, cols, np.int32(len(right))), starts, axis=1)
            i, k = np.nonzero(first < len(right))
            x.append(node[l[i]])
            y.append(node[right[first[i, k]]])
    x, y = np.concatenate(x), np.concatenate(y)
    return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)})


def _common(left: np.ndarray, right: np.ndarray, sets: list[np.ndarray], size: np.ndarray) -> np.ndarray:
    """How many hashes each set of the left and each of the right have in common."""
    token = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), size)
    shared = np.bincount(token)[token] > 1
    token, owner = np.unique(token[shared], return_inverse=True)[1], owner[shared]
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    place, mine = np.empty(len(sets), dtype=np.int64), np.zeros(len(sets), dtype=bool)
    place[left], place[right], mine[left] = np.arange(len(left)), np.arange(len(right)), True
    same = np.zeros((len(left), len(right)), dtype=np.float32)
    m = [np.zeros((n, BLOCK_TOKENS), dtype=np.float32) for n in same.shape]
    part = np.empty_like(same)
    for at in range(0, int(token[-1]) + 1 if len(token) else 0, BLOCK_TOKENS):
        lo, hi = np.searchsorted(token, (at, at + BLOCK_TOKENS))
        t, o = token[lo:hi] - at, owner[lo:hi]
        for k, own in enumerate((mine[o], ~mine[o])):
            m[k][:] = 0
            m[k][place[o[own]], t[own]] = 1
        same += np.matmul(m[0], m[1].T, out=part)
    return same


def _in_blocks(rows: DataFrame, comps: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between different components inside the large buckets that are left.

    The buckets with one central member form a cluster. Each member outside the cluster's largest component
    is compared with all members, a block of sets against another at a time; a set travels once for
    each block it is compared with, and no pair is written but links.
    """
    centre = rows.groupBy("key").agg(F.max(F.struct("w", "node")).alias("m")).select(F.col("key").alias("_k"), F.col("m.node").alias("c"))
    members = rows.join(centre, rows["key"] == centre["_k"]).select("c", "node", "n").distinct()
    cc = comps.select(F.col("node").alias("_n"), "component")
    members = members.join(cc, members["node"] == cc["_n"], "left").select("c", "node", "n", F.coalesce("component", "node").alias("component"))
    per = members.groupBy("c", "component").agg(F.count("*").alias("k"), F.sum("n").alias("t"))
    per = per.groupBy(F.col("c").alias("_c")).agg(F.max_by(F.struct("component", "k", "t"), F.struct("k", "component")).alias("main"), F.sum("k").alias("k"), F.sum("t").alias("t"))
    members = members.join(per, members["c"] == per["_c"])
    blocks = lambda k, t: F.greatest(F.ceil(k / BLOCK), F.ceil(t / BLOCK_HASHES), F.lit(1))
    lefts, rights = blocks(F.col("k") - F.col("main.k"), F.col("t") - F.col("main.t")), blocks(F.col("k"), F.col("t"))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    h = F.xxhash64("node")
    left = members.where(F.col("component") != F.col("main.component")).select("c", F.pmod(h, lefts).alias("i"), upto(rights).alias("j"), F.lit(0).alias("side"), "node", "component")
    right = members.select("c", upto(lefts).alias("i"), F.pmod(h, rights).alias("j"), F.lit(1).alias("side"), "node", "component")
    both = left.union(right)
    s = sets.select(F.col("node").alias("_s"), "hashes")
    return both.join(s, both["node"] == s["_s"]).drop("_s").groupBy("c", "i", "j").applyInArrow(_block_links, "a long, b long")


def link_classes(docs: DataFrame, classes: DataFrame, words: int = WORDS, bucket: int = BUCKET, stars: int = STARS) -> DataFrame | None:
    """node, component of the classes that have links; None without any candidate."""
    total = classes.agg(F.sum(F.col("e_own") + F.col("e_low"))).first()[0] or 0
    parts = max(16, int(total) // PARTITION_SIGNATURES + 1)
    met = saved(buckets(signatures(docs, parts, words), parts, bucket))
    short_id = F.shiftrightunsigned("y", 2)
    low_role = F.col("y").bitwiseAND(F.lit(1)) == 1
    large = met.where("kind = 1")
    lost = large.groupBy(short_id.alias("_i")).agg(F.count_if(~low_role).alias("lost_own"), F.count_if(low_role).alias("lost_low"))
    c = classes.withColumn("_s", F.shiftrightunsigned("node", 18)).join(lost, F.col("_s") == lost["_i"], "left").drop("_i", "_s")
    c = c.withColumns({"b1_own": F.col("e_own") - F.coalesce("lost_own", F.lit(0)), "b1_low": F.col("e_low") - F.coalesce("lost_low", F.lit(0))}).drop("lost_own", "lost_low")
    c = saved(c)
    own_need = F.floor((F.col("n") + F.floor(F.col("n") * 4 / 3)) / 7) + 1
    low_need = F.floor((F.col("low_top") + F.col("n")) / 7) + 1
    short_own, short_low = F.col("b1_own") < own_need, (F.col("e_low") > 0) & (F.col("b1_low") < low_need)
    short = saved(c.where(short_own | short_low))
    pairs = met.where("kind = 0").select("x", "y", F.col("c").alias("l1"), F.lit(0).cast("long").alias("l2"))
    rows, null = None, F.lit(None).cast("long")
    if short.isEmpty():
        c = c.withColumns({"b2_own": null, "b2_low": null})
    else:
        second = _picked(docs, short).select("text")
        more = max(16, int(short.agg(F.sum(F.col("e_own") + F.col("e_low") + 2 * F.col("n"))).first()[0]) // PARTITION_SIGNATURES + 1)
        deleted = saved(buckets(signatures(second, more, words, deletions=True), more, bucket, deletions=True))
        pairs = pairs.unionByName(deleted.where("kind = 0").select("x", "y", F.lit(0).cast("long").alias("l1"), F.col("c").alias("l2")))
        lost2 = deleted.where("kind = 1").groupBy(short_id.alias("_i")).agg(F.count_if(~low_role).alias("o"), F.count_if(low_role).alias("l"))
        s2 = short.withColumn("_s", F.shiftrightunsigned("node", 18)).join(lost2, F.col("_s") == lost2["_i"], "left")
        s2 = saved(s2.withColumns({"b2_own": 2 * F.col("b1_own") - F.col("s_own") - F.coalesce("o", F.lit(0)), "b2_low": 2 * F.col("b1_low") - F.col("s_low") - F.coalesce("l", F.lit(0))}).drop("_i", "o", "l"))
        b2 = s2.select(F.col("node").alias("_n"), "b2_own", "b2_low")
        c = c.join(b2, c["node"] == b2["_n"], "left").drop("_n")
        role = lambda r, b1, e, s, need, bad: F.struct(F.lit(r).cast("long").alias("role"), F.col(e).alias("e"), F.col(s).alias("s"), need.alias("need"), (need - F.col(b1)).alias("lack"), bad.alias("bad"))
        still = s2.select("_s", "node", "n", "band", F.explode(F.array(role(0, "b1_own", "e_own", "s_own", own_need, short_own & (F.col("b2_own") < own_need)), role(1, "b1_low", "e_low", "s_low", low_need, short_low & (F.col("b2_low") < low_need)))).alias("r"))
        still = saved(still.where("r.bad").select(F.shiftleft("_s", 2).bitwiseOR(F.col("r.role")).alias("id"), "node", "n", F.col("band") - F.col("r.role"), "r.e", "r.s", "r.need", "r.lack").toDF("id", "node", "n", "band", "e", "s", "need", "lack"))
        if not still.isEmpty():
            # An entity with enough non-empty segments agrees with a partner in all but H of them at most. In one order
            # of all buckets (small ones first, then the largest) the first they share is among the first H + 1 of
            # either, so the small ones and as many large ones as credits lack do. The others need all, deletions too.
            few = still.where(F.col("e") < F.col("need")).select(F.col("id").alias("_i"))
            places = large.select("x", F.col("y").alias("i"), F.col("c").alias("size"))
            places = places.union(deleted.where("kind = 1").select(F.col("x") + (1 << 62), F.col("y").bitwiseAND(F.lit(-3)).alias("i"), "c").join(few, F.col("i") == F.col("_i"), "left_semi"))
            rows = places.join(still.select("id", "node", "n", "e", "need", "lack"), F.col("i") == F.col("id"))
            rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("size"), "x"))).where((F.col("e") < F.col("need")) | (F.col("_r") <= F.col("lack")))
            rows = rows.select(F.col("x").alias("key"), "node", "n", "size")
            # sets with too few segments for any allocation meet in a bucket of their band
            whole = still.where(2 * F.col("e") - F.col("s") < F.col("need"))
            rows = rows.union(whole.select((-1 - F.col("band")).cast("long"), "node", "n", F.lit(0).cast("long"))).distinct()
    named = saved(_named(pairs, c))
    if rows is not None:
        weight = rows.groupBy(F.col("node").alias("_n")).agg(F.count("*").alias("w"))
        rows = rows.join(weight, rows["node"] == weight["_n"]).drop("_n")
        rows = saved(rows)
    if named.isEmpty() and rows is None:
        return None
    nodes = named.select(F.col("a").alias("node")).union(named.select("b"))
    if rows is not None:
        nodes = nodes.union(rows.select("node"))
    picked = saved(classes.join(nodes.distinct(), "node", "left_semi").select("rep", "node"))
    sets = saved(sets_of(docs, picked, words).repartition("node"))

    def near(p):
        """Sizes that allow a link, in order."""
        return p.where(F.col("a") != F.col("b")).where(4 * F.least("an", "bn") >= 3 * F.greatest("an", "bn")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    # first each node with its least candidate, and each member of large buckets with the most central one of its largest
    first = named.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links, comps, open_rows = None, None, rows
    for turn in range(max(2, stars)):  # all candidates are verified in the second turn, whatever the number of stars
        batch = first if turn == 0 else _between(named, comps) if turn == 1 else None
        starred = open_rows is not None and turn < stars
        if starred:
            met_in = open_rows if turn else open_rows.groupBy("node", "n", "w").agg(F.max(F.struct("size", "key")).alias("m")).select("m.key", "node", "n", "w")
            centre = met_in.groupBy("key").agg(F.max(F.struct("w", "node", "n")).alias("m")).select(F.col("key").alias("_k"), F.col("m.node").alias("c"), F.col("m.n").alias("cn"))
            spokes = met_in.join(centre, met_in["key"] == centre["_k"]).select(F.col("c").alias("a"), F.col("cn").alias("an"), F.col("node").alias("b"), F.col("n").alias("bn"))
            spokes = _between(near(spokes), comps)
            batch = spokes if batch is None else batch.union(spokes).distinct()
        if batch is None:
            break
        new = saved(verified(batch, sets))
        links = new if links is None else links.union(new)
        comps = components(links)
        if starred:
            # after the first turn a centre has met its whole bucket; buckets within one component are done
            left = open_rows if turn == 0 else open_rows.join(centre, open_rows["key"] == centre["_k"]).where(F.col("node") != F.col("c")).select("key", "node", "n", "w", "size")
            c = comps.select(F.col("node").alias("_n"), "component")
            left = left.join(c, left["node"] == c["_n"], "left").withColumn("component", F.coalesce("component", "node"))
            alive = left.groupBy(F.col("key").alias("_k")).agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
            open_rows = saved(left.join(alive, left["key"] == alive["_k"], "left_semi").select("key", "node", "n", "w", "size"))
            if open_rows.isEmpty():
                open_rows = None
    if open_rows is not None:
        links = links.union(saved(_in_blocks(open_rows, comps, sets)))
        comps = components(links)
    return comps


def join_components(docs: DataFrame, words: int = WORDS, bucket: int = BUCKET, stars: int = STARS) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs."""
    found = saved(profile(docs, words))
    linkable = found.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = saved(linkable.groupBy("node", "n", "e_own", "e_low", "s_own", "s_low", "band", "low_top").agg(F.min("doc_id").alias("rep")))
    comps = link_classes(docs, classes, words, bucket, stars)
    label = classes.select("node", "rep")
    if comps is not None:
        comps = comps.select(F.col("node").alias("_n"), "component")
        label = label.join(comps, label["node"] == comps["_n"], "left").withColumn("component", F.coalesce("component", "node"))
        least = label.groupBy(F.col("component").alias("_c")).agg(F.min("rep").alias("component_id"))
        label = label.join(least, label["component"] == least["_c"])
    else:
        label = label.withColumn("component_id", F.col("rep"))
    label = label.select(F.col("node").alias("_n"), "component_id")
    out = found.join(label, (found["node"] == label["_n"]) & (found["n"] > 0) & found["doc_id"].isNotNull(), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


@guarded("doc_id", "text")
def without_near_copies(docs: DataFrame, **how) -> DataFrame:
    """docs with one document, the least doc_id, of each component; rows with a null doc_id stay."""
    keep = join_components(docs, **how).where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_d")).distinct()
    kept = docs.join(keep, docs["doc_id"] == keep["_d"], "left_semi")
    return kept.unionByName(docs.where(F.col("doc_id").isNull()))


def op1(spark, sf_dir):
    return join_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i+4], ' ') END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))),
r AS (SELECT doc_id AS u, doc_id AS c FROM documents UNION SELECT l.v, r.c FROM r JOIN l ON l.u = r.u)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT u, min(c) AS c FROM r GROUP BY u) c ON c.u = d.doc_id
"""
