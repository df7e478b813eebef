"""Main text of generated pages: layouts, omitted end tags, wrapping forms, several containers, and marked boxes."""

import itertools

import numpy as np
import pytest

from ledgerscope.llm import html_extract

NAV = "<nav><ul><li><a href=/a>Home</a><li><a href=/b>All the news of today</a></ul></nav>"
FOOT = "<footer><p>Some company, all rights reserved, in a long line of text.</p></footer>"
BOXES = [
    "<div class='ad'>Buy this now, it is cheap and good and everybody has one.</div>", "<div class=cookie-notice><p>We use cookies to make this site better for all readers.</p></div>",
    "<aside><p>Related: another story that you may like to read as well.</p></aside>", "<div id='sidebar-left'><a href=x>One</a> <a href=y>Two</a></div>",
    "<form><label>Mail</label><input><p>Sign up for our letter with your address.</p></form>", "<div style='display: none'>Nobody sees this line of text at all.</div>", "<script>var p = '<p>not text</p>';</script>",
    "<section class='comments-list'><div class=comment><p>A reader writes a long comment about the article here, longer than most.</p></div></section>", "<div class=siteSearch>Search</div>",
]
WRAPS = ["{}", "<div class='layout has-sidebar'>{}</div>", "<div class='page with-banner'><div class=content>{}</div></div>", "<form method=post action=/>{}<input type=hidden></form>", "<main>{}</main>", "<article>{}</article>", "<table><tr><td>{}</table>", "<div id=sidebar-layout><main>{}</main></div>"]
HEADS = ["<html><head><title>t</title><style>p{}</style></head><body>", "<html><head><title>t</title><meta charset=utf-8><body>", "<title>t</title>", "<html><head><script>x()</script>", "<!doctype html>"]


def article(rng, closed):
    words = lambda n: " ".join(rng.choice(["river", "stone", "caf\u00e9", "A&B", "green", "of", "the", "<x>"], n))
    blocks = [("h1", words(4)), *[("p", words(int(n))) for n in rng.integers(12, 60, 3)], ("h2", words(3)), ("p", words(2)), *[("p", words(int(n))) for n in rng.integers(12, 60, 2)]]
    escape = lambda t: t.replace("&", "&amp;").replace("<", "&lt;").replace("\u00e9", "&eacute;").replace(" of ", "\n  of ")
    html = "".join(f"<{k}>{escape(t)}" + (f"</{k}>" if closed or k != "p" else "") for k, t in blocks)
    return html, "\n".join(t for _, t in blocks)


@pytest.mark.parametrize("seed", range(4))
def test_generated_pages(seed):
    rng = np.random.default_rng(seed)
    for head, wrap, closed in itertools.product(HEADS, WRAPS, (True, False)):
        html, text = article(rng, closed)
        boxes = [BOXES[k] for k in rng.permutation(len(BOXES))[:4]]
        if "<form" in wrap:  # forms do not nest
            boxes = [b for b in boxes if "<form" not in b]
        page = head + NAV + wrap.format(boxes[0] + html + "".join(boxes[1:])) + FOOT
        assert html_extract.main_text(page) == text, (head, wrap, closed, boxes)


def test_marked_sections_of_an_article_stay():
    share = "<section id='market-share'><h2>Shares</h2><p>The share of the firm in the market grew by a tenth, and that of all others fell.</p></section>"
    body = "<article><h1>Firm</h1><p>A long first paragraph about the firm and about its market.</p>" + share + "<div class='share-buttons'>Share this with friends</div></article>"
    assert html_extract.main_text(NAV + body) == "Firm\nA long first paragraph about the firm and about its market.\nShares\nThe share of the firm in the market grew by a tenth, and that of all others fell."
    assert html_extract.main_text("<article><h2 id=related>Related work</h2><p>What others have done before, in a few words.</p></article>").startswith("Related work")


def test_pages_without_content_are_empty():
    for page in (None, "", " ", NAV, NAV + FOOT, "<script>x</script>", "<html><head><title>t</title></head></html>"):
        assert html_extract.main_text(page) == ""


def test_odd_markup():
    assert html_extract.main_text("<div><p>One <b>two<p>three</div>four five six seven eight") != ""
    assert html_extract.main_text("plain text only, without any tag at all") == "plain text only, without any tag at all"
    assert html_extract.main_text("<select><option>a<option>b<p>Text after an open list, long enough.</p>") == "Text after an open list, long enough."
    long_ = "word " * 200_000
    assert html_extract.main_text(f"<body>{NAV}<p>{long_}</p>{FOOT}") == long_.strip()
    nested = "<div>" * 3000 + "deep text here" + "</div>" * 3000
    assert html_extract.main_text(nested) == "deep text here"


def test_table_of_pages(spark):
    pages = spark.createDataFrame([(1, "u", None, 5), (2, "u", "<article><p>\u00e9</p></article>", 6), (2, "u", "<article><p>\u00e9</p></article>", 6), (None, None, "<p>x", None)], "page_id long, url string, html string, n_chars long")
    out = html_extract.extract(pages)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in out.collect()) == [(0, "x", 1), (1, "", 0), (2, "\u00e9", 1), (2, "\u00e9", 1)]
    assert html_extract.extract(pages.limit(0)).count() == 0
