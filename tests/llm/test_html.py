import itertools
import random
import time
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import html as H
from tests.llm import pages


def test_min_cut_is_minimal():
    rnd = random.Random(7)
    for _ in range(600):
        n = rnd.randrange(1, 9)
        odds = [rnd.choice([-3, -1, -0.5, 0, 0.5, 1, 4]) for _ in range(n)]
        edges = [(i, j, rnd.choice([0.3, 0.7, 2.0])) for i in range(n) for j in range(i) if rnd.random() < 0.5]
        cost = lambda x: sum(-o if o < 0 else 0 for o, k in zip(odds, x) if k) + sum(o for o, k in zip(odds, x) if o > 0 and not k) + sum(w for a, b, w in edges if x[a] != x[b])
        cut, costs = H.min_cut(odds, edges), {x: cost(x) for x in itertools.product((False, True), repeat=n)}
        least = min(costs.values())
        assert abs(cost(cut) - least) < 1e-9
        # of all minimum cuts the one that keeps least
        assert cut == [all(x[i] for x, c in costs.items() if c - least < 1e-9) for i in range(n)]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site"><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="cookie-notice"><p>We use cookies on this site.</p></div>
<aside class="sidebar"><p>Related things to read that are rather long, so that only their place tells what they are.</p></aside>
<article><h1>Title &amp; more</h1><p><b>First   one.<br><p>Second&nbsp;one
 goes on.</p><div class="ad">Buy this now, it is a good thing to buy.</div><ul><li>Item</li><li>Short</li></ul><p>x &lt; y</p></article>
<section id="comments"><h3>Comments</h3><p>Reader says something at length, as readers do when they have the time.</p></section>
<form><p>Your name</p><input name=q></form><footer>&copy; me</footer></body></html>"""


def test_page():
    assert H.main_text(PAGE) == "Title & more\nFirst one.\nSecond one goes on.\nItem\nShort\nx < y"


def test_broken_pages():
    assert H.main_text(None) == H.main_text("") == H.main_text("<") == ""
    assert H.main_text("<article><p>cut off in the mid &am") == "cut off in the mid &am"
    assert H.main_text("<article><p>one<p>two<!-- three") == "one\ntwo"
    assert H.main_text("<article><p>one<script>if (a<b) x") == "one"
    assert len(H.main_text("<article>" + "<p>word word</p>" * 5000 + "</article>").split("\n")) == 5000


def test_extract_keeps_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (None, None, None, None)], "page_id long, url string, html string, text string")
    rows = H.extract(df).collect()
    assert sorted(len(r.text) for r in rows) == [0, len(H.main_text(PAGE)), len(H.main_text(PAGE))]
    assert H.extract(df.limit(0)).count() == 0


LONG = "This is a paragraph that says a good deal about its subject, so that nobody would take it for anything else. " * 4


@pytest.mark.parametrize(
    "page",
    [
        "<body class='has-sidebar'><div><p>{}</p></div></body>",
        "<body class='no-banner'><article><p>{}</p></article></body>",
        "<body><article class='post share-enabled'><p>{}</p></article></body>",
        "<body><form id='aspnetForm'><div><p>{}</p></div></form></body>",
        "<body><form id='aspnetForm'><nav><a href='/'>Home</a></nav><div><p>{}</p></div><div class='sidebar'><p>Other things to read.</p></div></form></body>",
    ],
)
def test_frames_of_whole_pages(page):
    assert H.main_text(page.format(LONG)) == " ".join(LONG.split())


def test_short_page():
    assert H.main_text("<body><div><p>Yes it is.</p></div></body>") == "Yes it is."


def agreement(rows):
    """Precision and recall of blocks, and pages that are as they should be."""
    hit = got_n = want_n = same = 0
    for page, want in rows:
        got = H.main_text(page)
        a, b = Counter(got.split("\n")), Counter(want.split("\n"))
        hit, got_n, want_n, same = hit + (a & b).total(), got_n + a.total(), want_n + b.total(), same + (got == want)
    return hit / got_n, hit / want_n, same / len(rows)


def test_labelled_pages():
    """The weights are those of the first pages; other pages are read as labelled."""
    x, y = [], []
    for page, want in pages.labelled(range(660)):
        p, main = H.Page(page), set(want.split("\n"))
        x.append(p.features())
        y += [t in main for t in p.texts]
    w = H.fit(np.concatenate(x), np.array(y, float))
    assert np.allclose(w, [H.WEIGHTS[f] for f in H.FEATURES], atol=0.01)
    precision, recall, same = agreement(pages.labelled(range(10_000, 10_660)))
    assert precision > 0.99 and recall > 0.99 and same > 0.98


def test_long_pages_take_linear_time():
    page = "<article>" + "<p>A paragraph of some words.</p><p><a href='/x'>a link of words</a></p>" * 70_000 + "</article>"
    weak = [(0.3, -0.3, 0.1)[i % 3] for i in range(30_000)]
    began = time.process_time()
    assert len(H.main_text(page).split("\n")) >= 70_000
    H.min_cut(weak, [(i, i + 1, 0.4) for i in range(len(weak) - 1)])
    assert time.process_time() - began < 15


STORY = ["First part of the story, which is told at some length.", "Second part of the story, which is no shorter than that.", "It's the last part, and it ends here for good."]


@pytest.mark.parametrize(
    "attributes",
    [
        "title=O'Brien", 'title="it"s"', "title='it's'", "alt=5'", 'alt=5"', "data-x=\"a>b\"", "data-x='a>b \"c'", "x=a=b", "x==y", "=x", "x = 'y' z", "x= \"y z\"", 'href=/a?b="c"', "'", '"', "x=''", "x=\"\"y=''", "a'b=\"c d\"", "x=a\"b>c\"d"[:5], "/x/='q'/", "\u00a0\"",
    ],
)
def test_attributes_by_the_grammar_of_html(attributes):
    page = f"<body><article><p {attributes}>{STORY[0]}</p><p>{STORY[1]}</p><p {attributes}>{STORY[2]}</p></article></body>"
    assert H.main_text(page).split("\n") == STORY


def test_a_quotation_mark_hides_no_class():
    page = f"<article title=O'Brien class=post><p>{STORY[0]}</p></article><div data-x='y' class = \"ad\" id=z'>{STORY[1]}</div>"
    assert H.main_text(page) == STORY[0]


@pytest.mark.parametrize("piece", ["<p x", "<p x='", '<p x="', "<p x=", "</div>", "<p>", "<div>", "<p x='a\" ", "<script ", "<!--", "<", "<a href='", "<b>x</i>", "=\"", "<p class=\"", "<ul><li>", "<style x='>"])
def test_broken_pages_take_linear_time(piece):
    for end in ("", '"', "'>", ">"):
        page = piece * (1_250_000 // len(piece)) + end
        began = time.process_time()
        H.Page(page)
        assert time.process_time() - began < 5, end


def test_links_that_an_article_has_itself():
    page = f"<nav><ul><li><a>Home</a></li></ul></nav><article><p>{STORY[0]}</p><ul><li><a>First source of all</a></li><li><a>Second source</a></li></ul><p><a>{STORY[1]}</a></p></article><aside><ul><li><a>Other things</a></li></ul></aside>"
    assert H.main_text(page).split("\n") == [STORY[0], "First source of all", "Second source", STORY[1]]
