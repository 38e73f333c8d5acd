import re
import time
from html import unescape

import pytest

from tessella.llm import html_text as H

PAGE = """<html><head><title>no</title><style>p{}</style></head><body><div class="cookie-notice">We use cookies to make this site work and more, please accept them all now.</div>
<header><div class=logo>Site</div></header><div id="menu"><ul><li><a href=1>Home</a><li><a href=2>About</a></ul></div>
<div class="content"><h1>Title &amp; more</h1><p>First paragraph that is long enough to be seen as the text of the article, with <a href=x>a link</a> inside.</p><p>Short.</p>
<p>Another &lt;paragraph&gt; with a good amount of text<br>over two lines so that it counts, and more and more.<script>var t = "</p>";</script></p></div>
<div class="sidebar"><p>Related stories that are long enough to be text, but they are in the side bar, and should go.</p></div>
<form><p>Subscribe to our newsletter today and get the best of it every morning, free of charge.</p></form>
<div class="comments"><p>A reader writes a long comment that is not part of the article, but looks like it, really.</p></div><footer>Copyright 2020</footer></body></html>"""


def test_page():
    assert H.main_text(PAGE) == (
        "Title & more\nFirst paragraph that is long enough to be seen as the text of the article, with a link inside.\nShort.\n"
        "Another <paragraph> with a good amount of text over two lines so that it counts, and more and more."
    )


def test_comments_inside_the_article_go():
    page = "<article><h1>Head of it</h1><p>Words of the article.</p><section class='comments'><p>Words of a reader, many of them, more than the article has itself.</p></section></article>"
    assert H.main_text(page) == "Head of it\nWords of the article."


def test_layout_names_say_nothing():
    page = '<div class="content with-sidebar"><p>Words of the article, enough of them to count as a paragraph.</p></div><div class="side-bar sidebar"><p>Words beside it.</p></div>'
    assert H.main_text(page) == "Words of the article, enough of them to count as a paragraph."


def test_odd_pages():
    assert H.main_text("") == "" and H.main_text("<p>") == "" and H.main_text("<!-- <p>x</p>") == ""
    assert H.main_text("<p>one<p>two &nbsp; three") == "one\ntwo three"
    assert H.main_text("no markup at all") == "no markup at all"
    assert H.main_text("<article><p><b>a<br><p>b</article>") == "a\nb"
    assert H.main_text("<article><p title='a > b'>x</p><p title=\"open>y</article>") != ""
    assert len(H.main_text("<article>" + "<p>word</p>" * 3000 + "</article>").split("\n")) == 3000


@pytest.mark.parametrize("n", [10, 4000, 5000, 300_000])
def test_values_of_any_length(n):
    value = "x" * n + " => y <nav> menu class='sidebar' hidden "
    body = "<p>Words of the article, enough of them to count as a paragraph.</p>"
    assert H.main_text(f'<article data-x="{value}">{body}</article>') == "Words of the article, enough of them to count as a paragraph."
    assert H.main_text(f"<article data-x='{value.replace(chr(39), chr(34))}'>{body}</article>") == "Words of the article, enough of them to count as a paragraph."
    stray = f"<article><p title=it's>Words one, enough of them to count as a paragraph of text.</p>{'<p>more of these words here</p>' * (n // 30)}<p>don't</p></article>"
    assert H.main_text(stray).startswith("Words one, enough") and H.main_text(stray).endswith("don't")


def brute(odds, edges):
    best = None
    for mask in range(1 << len(odds)):
        side = [mask >> i & 1 for i in range(len(odds))]
        cost = sum(max(o, 0) if not s else max(-o, 0) for o, s in zip(odds, side, strict=True)) + sum(w for a, b, w in edges if side[a] != side[b])
        if best is None or cost < best - 1e-12:
            best = cost
    return best


@pytest.mark.parametrize("seed", range(20))
def test_cut_is_minimal(seed):
    import random

    rnd = random.Random(seed)
    n = rnd.randint(1, 9)
    odds = [rnd.uniform(-3, 3) for _ in range(n)]
    edges = [(i, j, rnd.uniform(0, 2)) for i in range(n) for j in range(i + 1, n) if rnd.random() < 0.5]
    kept = H.min_cut(odds, edges)
    cost = sum(max(o, 0) if not s else max(-o, 0) for o, s in zip(odds, kept, strict=True)) + sum(w for a, b, w in edges if kept[a] != kept[b])
    assert cost == pytest.approx(brute(odds, edges))


def both(html):
    """The blocks' texts that the signs of their log-odds keep, and those that the cut keeps."""
    blocks = H.blocks_of(html)
    odds = [H.log_odds(b) for b in blocks]
    kept = H.min_cut(odds, H.smoothness(blocks))
    return [b.text for b, o in zip(blocks, odds, strict=True) if o > 0], [b.text for b, k in zip(blocks, kept, strict=True) if k]


def test_cut_overturns_single_blocks():
    long = "Words of the article, a good many of them, so that nobody could take them for anything but text. " * 2
    short = f"<div><p>{long}</p><div>Half past four.</div><p>{long}</p></div>"
    by_sign, by_cut = both(short)
    assert "Half past four." not in by_sign and "Half past four." in by_cut
    lists = "<ul>" + "<li><a href=x>Some place</a></li>" * 3
    alone = f"<div>{lists}<li>And a line of plain text that is long enough to be seen as such</li>{'<li><a href=x>Some place</a></li>' * 3}</ul></div>"
    by_sign, by_cut = both(alone)
    assert by_sign and not by_cut


def blind(html):
    """The page without names, its telling elements made plain ones."""
    html = re.sub(r"""\s(?:class|id|role)\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+)""", "", html)
    return re.sub(r"<(/?)(?:article|main|nav|footer|aside|form|menu|dialog|header|section)\b", r"<\1div", html)


def test_cut_on_pages_without_telling_markup(spark, sf):
    """Labels come from the pages as they are; the cut must find them on the blind pages better than the odds alone."""
    n = by_sign = by_cut = changed = 0
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        html = r["html"] or ""
        article = set(H.main_text(html).split("\n"))
        blocks = H.blocks_of(blind(html))
        odds = [H.log_odds(b) for b in blocks]
        for b, o, k in zip(blocks, odds, H.min_cut(odds, H.smoothness(blocks)), strict=True):
            n, by_sign, by_cut, changed = n + 1, by_sign + ((o > 0) == (b.text in article)), by_cut + (k == (b.text in article)), changed + (k != (o > 0))
    print(f"{n} blocks: {by_sign / n:.4f} right by sign, {by_cut / n:.4f} by the cut, which changed {changed}")
    assert changed > 0 and by_cut > by_sign and by_cut >= 0.99 * n


@pytest.mark.parametrize(
    "html",
    [
        "<div>" * 10_000 + "x" + "</div>" * 10_000,
        "<div>x " * 10_000,
        "<div>" * 10_000 + "</q>" * 10_000 + "</i>" * 10_000,
        "<b><div>" + "<i>" * 10_000 + "</b>" * 10_000,
        '<a href="' * 110_000,
        "<a x=\"> <b y='>" * 70_000,
        "<a b=c " * 140_000,
        "<!" * 500_000,
        "<script>" + "</script" * 100_000,
    ],
    ids=["nested", "nested text", "stray ends", "stray inline ends", "open quotes", "mixed quotes", "open tags", "declarations", "script ends"],
)
def test_broken_pages_take_linear_time(html):
    begun = time.time()
    H.main_text(html)
    assert time.time() - begun < 5


def test_tags_that_never_end():
    assert H.main_text("<p>a</p><b <!-- c") == "a\n<b"
    assert H.main_text("a < b <") == "a < b <"
    assert H.main_text("<p title = 'x > y' id=it's>a</p>") == "a"


def test_test_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in H.extract(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [" ".join(unescape(re.sub(r"<[^>]*>", " " if "<br>" in x else "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert got[r["page_id"]] == "\n".join(p for p in parts if p)


def test_odd_tables(spark):
    rows = [(1, "u", None, "x"), (None, None, "<p>This is a paragraph of some text that is long enough.</p>", "y")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in H.extract(df).collect()}
    assert got == {1: "", None: "This is a paragraph of some text that is long enough."}
    assert H.extract(df.limit(0)).count() == 0
