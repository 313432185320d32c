"""HTML extraction: flat text blocks, judged by a decision tree.

The page is cut into blocks at block-level tags, in time linear in its length. Each block has its number of
words and link density, those of its neighbours, whether it is a heading or a paragraph, and whether it stands
in an article or, within that, in an element whose tag or class names a frame part. A small tree fitted on the
labelled blocks of ``html_labels`` says which blocks are the article. Null and empty pages have the empty text.
Rows are judged one by one, so repeated rows get equal results. No block and no character is capped. Extra
columns may have any name; text and n_chars replace input columns so named.
"""

from __future__ import annotations

import functools
import html as _html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grantmill.llm.common import guarded, map_arrow, table

_RAW = frozenset("script style noscript template iframe object svg math title head".split())
_BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
_PARAGRAPH = frozenset("p li blockquote pre dd dt".split())
_CONTAINER = frozenset("article aside body details dialog div dl fieldset figure footer form header main menu nav ol section select table ul".split())
_FRAME_TAG = frozenset("nav footer aside form menu select button dialog fieldset textarea option label".split())
_FRAME_NAME = re.compile(r"(?<![a-z])(nav|navbar|navigation|menu|foot|footer|header|masthead|side|sidebar|ad|ads|advert|advertisement|adverts|promo|promotion|sponsor|sponsored|cookie|cookies|consent|gdpr|notice|alert|banner|comment|comments|reply|replies|disqus|share|sharing|social|related|recommended|more|subscribe|subscription|newsletter|signup|login|breadcrumb|breadcrumbs|popup|modal|overlay|widget|toolbar|pagination|pager|tags|meta|byline|copyright|legal|skip)(?![a-z])", re.I)
_SPACE = frozenset(" \t\n\f\r\v")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"[\s/]*([^\s/>=]+|=[^\s/>=]*)\s*")
_BARE = re.compile(r"[^\s>]*")
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in _RAW} | {"head": re.compile(r"</head\s*>|(?=<body\b)", re.I)}
_BARRIER = ("article", "main")
FEATURES = ("words", "link_density", "prev_words", "prev_link_density", "next_words", "next_link_density", "in_article", "framed", "heading", "paragraph")


class _Tags:
    """The tags of a page from left to right, in time linear in its length.

    A quote only matters in the place of an attribute's value. One that nothing closes, or whose closing quote
    stands where no value can end, is taken as a slip: the tag ends at the next >."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.quotes: dict[str, int] = {}  # where the next of each quote is: found once, however many tags ask

    def quote(self, q: str, at: int) -> int:
        if self.quotes.get(q, -2) < at and self.quotes.get(q) != -1:
            self.quotes[q] = self.page.find(q, at)
        return self.quotes[q]

    def tag(self, at: int) -> tuple[int, dict[str, str]]:
        """The end of the tag whose name ends at this place, and its attributes."""
        page, attrs = self.page, {}
        while at <= self.last:
            m = _ATTR.match(page, at)
            if not m:
                end = page.find(">", at)
                return end + 1, attrs
            name, at = m[1].lower(), m.end()
            value = ""
            if page[at : at + 1] == "=":
                at += 1
                while page[at : at + 1] in _SPACE and at < len(page):
                    at += 1
                q = page[at : at + 1]
                if q in ("'", '"'):
                    end = self.quote(q, at + 1)
                    if end < 0 or not (page[end + 1 : end + 2] in _SPACE or page[end + 1 : end + 2] in (">", "/", "")):
                        return page.find(">", at) + 1, attrs
                    value, at = page[at + 1 : end], end + 1
                else:
                    m = _BARE.match(page, at)
                    value, at = m[0], m.end()
            attrs.setdefault(name, value)
        return len(page), attrs


def blocks(page: str, labelled: bool = False) -> list[tuple[str, int, int, bool, bool, bool, bool, str]]:
    """(text, words, words in links, in an article, framed, heading, paragraph, label) of each block with text, in order.

    A < that starts no tag, or that no > follows, is text. Only pages of the labelled table have labels."""
    out, parts = [], []
    stack = [("", False, False)]  # tag, in an article, framed since that article began
    scopes: list[dict[str, int]] = [{}]  # open containers by tag, since the last article began
    tags = _Tags(page)
    linked, link, label, label_framed = 0, False, "", False
    heading = paragraph = False
    headless = False

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(_html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                n = len(text.split())
                out.append((text, n, min(linked, n), stack[-1][1], stack[-1][2] or label_framed, heading, paragraph, label))
        linked = 0

    def said(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if link:
                linked += len(_html.unescape(text).split())

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0 or lt > tags.last and not page.startswith("<!--", lt):
            said(page[at:])
            break
        said(page[at:lt])
        at = lt
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = n if end < 0 else end + 3
            continue
        if page[at + 1 : at + 2] in ("!", "?"):
            at = page.find(">", at) + 1
            continue
        closing = page[at + 1 : at + 2] == "/"
        m = _NAME.match(page, at + 1 + closing)
        if not m:
            if closing:  # an end tag without a name is no text
                at = page.find(">", at) + 1
            else:
                said("<")
                at += 1
            continue
        tag = m[0].lower()
        at, attrs = tags.tag(m.end())
        alone = page[at - 2 : at] == "/>"
        if tag in _RAW:
            if not closing and not (alone and tag in ("svg", "math")) and not (tag == "head" and headless):
                end = _ENDS[tag].search(page, at)
                if tag == "head":  # may lack its end tag: then nothing is skipped
                    headless = end is None
                    at = end.end() if end else at
                else:
                    at = end.end() if end else n
            continue
        if tag == "a":
            link = not closing
        elif tag in ("br", "img", "input", "wbr"):
            parts.append(" ")
        elif tag in _BLOCK:
            flush()
            heading = not closing and len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
            paragraph = not closing and (heading or tag in _PARAGRAPH)
            label = attrs.get("data-y", "") if labelled and not closing else ""
            names = " ".join(attrs.get(k, "") for k in ("class", "id", "role")) if attrs and not closing else ""
            named = bool(names and _FRAME_NAME.search(names))
            label_framed = False
            if tag in _CONTAINER and tag != "body":
                if closing:
                    if scopes[-1].get(tag):
                        while True:
                            top = stack.pop()[0]
                            scopes[-1][top] -= 1
                            if top == tag:
                                break
                    elif tag in _BARRIER and len(scopes) > 1:
                        while stack.pop()[0] not in _BARRIER:
                            pass
                        scopes.pop()
                elif not alone:
                    inside, framed = stack[-1][1:]
                    if tag in _BARRIER:  # what stands around an article doesn't make it a frame
                        stack.append((tag, True, False))
                        scopes.append({})
                    else:
                        stack.append((tag, inside, framed or named or tag in _FRAME_TAG or (tag == "header" and not inside)))
                        scopes[-1][tag] = scopes[-1].get(tag, 0) + 1
            elif not closing:
                label_framed = named or tag in _FRAME_TAG
    flush()
    return out


def features(found: list[tuple]) -> np.ndarray:
    words = np.array([0, *(b[1] for b in found), 0], dtype=float)
    density = np.array([0, *(b[2] / b[1] for b in found), 0], dtype=float)
    flags = np.array([b[3:7] for b in found], dtype=float).reshape(-1, 4)
    return np.column_stack([words[1:-1], density[1:-1], words[:-2], density[:-2], words[2:], density[2:], flags])


def fit_tree(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 2) -> tuple:
    """A binary tree (feature, limit, below or equal, above) with the class share at its leaves; splits by Gini impurity."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0) or len(y) < 2 * least:
        return (share,)
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, s = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y) + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            cost = s * (1 - s / n) + (s[-1] - s) * (1 - (s[-1] - s) / (len(y) - n))
        cut = np.flatnonzero((v[:-1] < v[1:]) & (n[:-1] >= least) & (len(y) - n[:-1] >= least))
        if len(cut):
            at = cut[np.argmin(cost[cut])]
            if best is None or cost[at] < best[0] - 1e-12:
                best = (cost[at], f, (v[at] + v[at + 1]) / 2)
    if best is None:
        return (share,)
    low = x[:, best[1]] <= best[2]
    return (best[1], best[2], fit_tree(x[low], y[low], depth - 1, least), fit_tree(x[~low], y[~low], depth - 1, least))


def predict(tree: tuple, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0] >= 0.5)
    low = x[:, tree[0]] <= tree[1]
    out = np.empty(len(x), dtype=bool)
    out[low], out[~low] = predict(tree[2], x[low]), predict(tree[3], x[~low])
    return out


@functools.lru_cache(1)
def model() -> tuple:
    from grantmill.llm.html_labels import pages

    xs, ys = [], []
    for page in pages():
        found = blocks(page, labelled=True)
        xs.append(features(found))
        ys.append(np.array([b[7] == "1" for b in found], dtype=float))
    return fit_tree(np.concatenate(xs), np.concatenate(ys))


def main_text(page: str | None, tree: tuple) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    return "\n".join(b[0] for b, keep in zip(found, predict(tree, features(found)), strict=True) if keep)


@guarded(named=("html",))
def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages without the HTML, with text and n_chars."""
    rest = [c for c in pages.columns if c.lower() not in (html.lower(), "text", "n_chars")]
    schema = T.StructType([*(pages.schema[c] for c in rest), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    tree = model()

    def run(batches):
        for b in batches:
            text = [main_text(x.as_py(), tree) for x in b.column(len(rest))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(rest))), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], [f.name for f in schema])

    return map_arrow(pages.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{html}`")), run, schema)


def op9(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
