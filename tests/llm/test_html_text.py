"""HTML extraction on slips of markup, on very long pages, and on layouts that the labelled table doesn't have."""

import time

import pytest

from grantmill.llm import html_text

A = "A ferry ran aground on the northern bank at dawn, and all who were on board were brought ashore in small boats."
B = "The owner could not be reached."
C = "By noon the tide had lifted her again and she went on under her own power to the yard, where divers will look at the hull."
BODIES = [(A, B, C), (B, A, C, A), (A + " " + C, C), (C, B, B, A), (A, C, "It was the third such case this year."), (A, A, A, A, B, C)]
LAYOUTS = [
    "<html><body><div id=nav><a href=1>Front</a> <a href=2>World</a></div><article>{p}</article><div class=footer>All rights reserved</div></body></html>",
    "<body><header><h2>The Bank Observer</h2></header><main role=main>{p}<aside><p>Also read: the history of the ferry, in ten parts.</p></aside></main></body>",
    "<body><ul class=menu><li><a href=1>a</a></li></ul><div class=story><h1>Ferry aground</h1>{p}</div><div class='comments'><p>" + A + "</p></div></body>",
    "<body><p><a href=1>Front</a> | <a href=2>World</a></p>{p}<p><a href=3>Older</a> <a href=4>Newer</a></p></body>",
    "<body>{p}</body>",
    "<body><div class=wrap><div class=col>{p}</div></div></body>",
    "<!doctype html><head><title>x</title><body><nav><a href=1>Front</a></nav><article><header><h1>Ferry aground</h1></header>{p}<div class=newsletter><p>Write to us and get the paper by mail every week.</p></div></article>",
    "<body><!-- <article>no</article> --><article>{p}<script>document.write('<p>' + 1)</script><style>p {{}}</style><form><p>Search the whole archive of the paper here.</p></form></article></body>",
    "<body><section class=alert><p>" + B + "</p></section><article>{p}</article><section class=related><a href=7>" + A + "</a></section></body>",
    "<table><tr><td><a href=1>Front</a><td><a href=2>World</a></table>{p}<hr><address><a href=m>Write to us</a></address>",
]


@pytest.mark.parametrize("layout", range(len(LAYOUTS)))
def test_layouts_outside_the_labelled_table(layout):
    """60 pages, each with the article's paragraphs known."""
    for body in BODIES:
        page = LAYOUTS[layout].format(p="".join(f"<p>{x}</p>\n" for x in body))
        want = [*(["Ferry aground"] if "Ferry" in LAYOUTS[layout] else []), *body]
        assert html_text.main_text(page, html_text.model()) == "\n".join(want)


def test_slips_of_markup():
    text = lambda page: html_text.main_text(page, html_text.model())
    assert text(f"<p>{A}<p title=\"it>{C}</p><p class=\"x\">{A}</p>") == f"{A}\n{C}\n{A}"
    assert text(f"<article><p data-x='a > b' title=\"<i>\">{A}</p><p>1 < 2 &lt; 3</p></article>") == f"{A}\n1 < 2 < 3"
    assert text(f"<article><p>{A}</p></div></section><p>x</p></article>") == f"{A}\nx"
    assert text(f"<div data-y=framed><p>{A}</p><p data-y=framed>{C}</p></div>") == f"{A}\n{C}"
    assert text(f"<article><p>{A}</p><!-- open") == A
    assert text("") == text(None) == text("<p>") == ""


@pytest.mark.parametrize("page", ["<a " * 300_000, "<a " * 300_000 + ">", '<a b="> ' * 120_000, "<div>a" * 160_000, "<div><article>" + "<section>" * 50_000 + "</div>" * 80_000, "<head>" * 160_000, '<a b="' * 160_000 + ">", "<" * 1_000_000, "<script>" * 120_000, "<p title='" * 100_000, "<!--" * 250_000])
def test_time_is_linear_on_hostile_pages(page):
    html_text.model()
    began = time.perf_counter()
    html_text.main_text(page, html_text.model())
    assert time.perf_counter() - began < 20


def test_empty_table_and_names(spark):
    df = spark.createDataFrame([(1, f"<p>{A}</p>", "a", 7), (1, f"<p>{A}</p>", "a", 7), (None, None, None, None)], "page_id long, HTML string, text string, `extra__0` int")
    got = html_text.extract(df).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars, str(r["extra__0"])) for r in got) == [("1", A, len(A), "7")] * 2 + [("None", "", 0, "None")]
    assert html_text.extract(df.where("false")).count() == 0
