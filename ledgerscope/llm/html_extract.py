"""HTML extraction: parser events, text-to-tag ratio per line, Gaussian smoothing and threshold clustering."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose text is never shown or never content.
SILENT = {"script", "style", "noscript", "template", "head", "title", "svg", "iframe", "object", "canvas", "select", "option", "button", "textarea", "datalist"}
BOILERPLATE = {"nav", "footer", "aside", "menu", "dialog"}
#: Elements that are boilerplate only where the content is elsewhere.
SOFT = {"form", "fieldset"}
#: Elements that leave an open head open, and silent ones that any block ends.
IN_HEAD = {"title", "meta", "link", "style", "script", "noscript", "base", "template"}
ENDED = {"select", "option", "datalist"}
#: Elements that begin and end a line.
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1",
    "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Elements that can be the container of an article, and those without an end tag.
CONTAINERS = {"article", "main", "section", "div", "td", "body", "table", "center", "blockquote"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Words in class, id or role that name what is not the article.
MARKS = {
    "ad", "ads", "adbox", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs",
    "sidebar", "aside", "footer", "masthead", "topbar", "cookie", "cookies", "consent", "notice", "notices", "popup", "modal", "newsletter", "subscribe", "signup",
    "comment", "comments", "reply", "replies", "discussion", "disqus", "related", "recommended", "share", "sharing", "social", "toolbar", "pagination", "pager", "widget", "login", "search",
    "copyright", "legal", "gdpr", "complementary", "contentinfo", "skip",
}
#: Words beside a mark that leave it one, as in site-footer, and words that say what a page or box has or is, as in has-sidebar.
PLAIN = {
    "site", "page", "main", "global", "top", "bottom", "left", "right", "post", "article", "entry", "content", "user", "reader", "primary", "secondary", "header", "sub", "inner", "outer", "block", "box", "section",
    "area", "container", "wrapper", "wrap", "list", "item", "bar", "panel", "zone", "slot", "unit", "privacy", "fixed", "sticky", "mobile", "desktop", "site", "wp", "js", "the", "my", "google", "blog", "news",
}
STATES = {"has", "with", "no", "without", "is", "show", "hide", "layout", "enabled", "disabled", "theme"}
#: Elements whose start ends an open one of the same kind (or of the listed kinds).
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_SCOPE = {"article", "section", "div", "main", "body", "table", "ul", "ol", "dl", "nav", "footer", "header", "aside", "form", "blockquote"}
_WHITE = re.compile(r"\s+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_TOKEN = re.compile(r"[a-z]+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

#: How sure it is that a marked element is not the article.
HIDDEN, STRONG, SOFTLY, WEAK = 4, 3, 2, 1


def _named(value: str) -> int:
    """How surely a class, id or role names what is not the article: by words of its own, or by a part of a compound."""
    found = 0
    for token in value.split():
        words = _TOKEN.findall(_CAMEL.sub("-", token).lower())
        marked = [w in MARKS for w in words]
        if not any(marked) or not STATES.isdisjoint(words):
            continue
        rest = {w for w, m in zip(words, marked, strict=True) if not m}
        found = max(found, STRONG if marked[0] or rest <= PLAIN else WEAK)
    return found


class _Lines(HTMLParser):
    """Turns events into lines: text, tags met in it, length of link text, its innermost marked element, and its container."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int, int]] = []  # tag, and silent, mark and container before it
        self.parents: list[int] = [-1]
        self.kinds: list[str] = ["root"]
        self.marks: list[tuple[int, int]] = []  # the marked element around it, and how sure its mark is
        self.holds: set[int] = set()  # marked elements with an article, main or h1 in them
        self.lines: list[tuple[str, int, int, int, int]] = []
        self.text: list[str] = []
        self.tags = self.linked = self.links = 0
        self.at = (False, -1, 0)

    def _end_line(self) -> None:
        if self.text:
            t = _WHITE.sub(" ", "".join(self.text)).strip()
            if t:
                self.lines.append((t, self.tags, self.linked, self.at[1], self.at[2]))
                self.tags = self.linked = 0
            self.text = []

    def _mark(self, tag: str, attrs: list[tuple[str, str | None]]) -> int:
        sure = STRONG if tag in BOILERPLATE else SOFTLY if tag in SOFT else 0
        heading = len(tag) == 2 and tag[0] == "h"
        for k, v in attrs:
            if k == "hidden" or (k == "aria-hidden" and v != "false") or (k == "style" and v and _UNSEEN.search(v.lower())):
                return HIDDEN
            if v and tag not in ("body", "html", "article", "main") and (k in ("class", "role") or (k == "id" and not heading)):
                sure = max(sure, _named(v))
                if k != "role" and not heading and "header" in v.lower().split():
                    sure = max(sure, self._header())
        return max(sure, self._header()) if tag == "header" else sure

    def _header(self) -> int:
        """A header is the page's own unless it is that of an article."""
        return 0 if any(t in ("article", "main") for t, *_ in self.stack) else STRONG

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self._end_line()
        if self.at[0]:
            self._end_silence(tag)
        self.tags += 1
        if tag in VOID:
            return
        if tag in _CLOSES:
            self._close_open(_CLOSES[tag])
        elif tag in BLOCKS:
            self._close_open({"p"})
        silent, mark, box = self.at
        sure = self._mark(tag, attrs)
        self.stack.append((tag, *self.at))
        if sure:
            self.marks.append((mark, sure))
            mark = len(self.marks) - 1
        if tag in ("article", "main", "h1"):
            k = mark
            while k >= 0:
                self.holds.add(k)
                k = self.marks[k][0]
        if tag in CONTAINERS:
            self.parents.append(box)
            self.kinds.append(tag)
            box = len(self.parents) - 1
        self.at = (silent or tag in SILENT, mark, box)
        if tag == "a":
            self.links += 1

    def _end_silence(self, tag: str) -> None:
        """A head without an end tag ends where the body begins; an open list of options ends with any block."""
        for k, (open_, *_) in enumerate(self.stack):
            if (open_ == "head" and tag not in IN_HEAD) or (open_ in ENDED and tag in BLOCKS):
                self._pop_to(k)
                return

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self._end_line()
        self.tags += 1

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._end_line()
        self.tags += 1
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self._pop_to(k)
                return
            if self.stack[k][0] in _SCOPE and tag not in _SCOPE:
                return

    def _close_open(self, tags: set[str]) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] in tags:
                self._pop_to(k)
                return
            if self.stack[k][0] in _SCOPE:
                return

    def _pop_to(self, k: int) -> None:
        self.links -= sum(t == "a" for t, *_ in self.stack[k:])
        self.at = self.stack[k][1:]
        del self.stack[k:]

    def handle_data(self, data: str) -> None:
        if not self.at[0]:
            self.text.append(data)
            if self.links > 0:
                self.linked += len(data)

    def close(self) -> None:
        super().close()
        self._end_line()


#: A weakly marked element of more characters than this outside links is content.
_WEAK_CHARS = 80


def _boilerplate(parser: _Lines) -> np.ndarray:
    """Whether each marked element is boilerplate. Names weigh, and the text decides: what holds the content is none.

    With an element's text outside links, less that of marked elements in it, against the page's text without any mark:
    a weakly marked one is content if it has more than a phrase and is not mostly links; a form if it holds more than
    all unmarked text; a strongly marked one only if there is next to nothing else and an article, main or h1 is in it.
    """
    n = len(parser.marks)
    own, linked, free = np.zeros(n), np.zeros(n), 0
    for t, _, link, mark, _ in parser.lines:
        if mark < 0:
            free += max(len(t) - link, 0)
        else:
            own[mark] += max(len(t) - link, 0)
            linked[mark] += link
    dead = np.zeros(n, bool)
    for k, (around, sure) in enumerate(parser.marks):
        if around >= 0 and dead[around]:
            dead[k] = True
        elif sure == WEAK:
            dead[k] = own[k] <= _WEAK_CHARS or linked[k] > own[k]
        elif sure == SOFTLY:
            dead[k] = own[k] <= free
        elif sure == STRONG:
            inside = own[k] + sum(own[j] for j in range(k + 1, n) if parser.marks[j][0] == k and parser.marks[j][1] < STRONG)
            dead[k] = not (k in parser.holds and inside > 4 * free)
        else:
            dead[k] = True
    return dead


def _smooth(x: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing over neighbouring lines; the kernel is normalised at the ends."""
    r = int(3 * sigma)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(x, k)[r : r + len(x)] / np.convolve(np.ones(len(x)), k)[r : r + len(x)]


def main_text(html: str | None) -> str:
    """The main text of a page: its blocks in page order, joined by line breaks; empty if there is none.

    A line is the text of one block. Its text-to-tag ratio is its characters outside links over its tags; boilerplate
    lines (see ``_boilerplate``: menus, footers, forms, adverts, comments, by element or by class, id or role) have ratio
    0. The ratios are smoothed, and lines above their spread are the cluster of content. The region is the innermost container that
    holds at least nine tenths of the cluster's characters (an article or main element is preferred); all its lines
    but boilerplate are returned, whatever their own ratio, so short paragraphs inside the article stay.
    """
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    lines, parents = parser.lines, parser.parents
    if not lines:
        return ""
    dead = np.append(_boilerplate(parser), False)  # the last: no mark
    boiler = dead[[mark for *_, mark, _ in lines]]
    size = np.where(boiler, 0, [max(len(t) - linked, 0) for t, _, linked, *_ in lines]).astype(float)
    ratio = size / np.array([max(tags, 1) for _, tags, *_ in lines], float)
    smooth = _smooth(ratio)
    core = (size > 0) & (smooth >= smooth.std())
    if not core.any():
        core = size > 0
        if not core.any():
            return ""
    held = np.zeros(len(parents))
    np.add.at(held, [box for *_, box in lines], size * core)
    for k in range(len(parents) - 1, 0, -1):
        held[parents[k]] += held[k]
    good = [k for k in range(len(parents)) if held[k] >= 0.9 * held[0]]
    named = [k for k in range(len(parents)) if parser.kinds[k] == "article" and held[k] >= 0.3 * held[0]] or [
        k for k in range(len(parents)) if parser.kinds[k] == "main" and held[k] >= 0.3 * held[0]
    ]
    regions = set(named or [max(good)])
    inside = np.zeros(len(parents), bool)
    for k in range(len(parents)):
        inside[k] = k in regions or (k > 0 and inside[parents[k]])
    return "\n".join(t for (t, *_, box), b in zip(lines, boiler, strict=True) if inside[box] and not b)


def extract(pages: DataFrame, id: str = "page_id", html: str = "html") -> DataFrame:
    """Every row with ``text`` and ``n_chars`` (code points) in place of the html and of columns with those names.

    A null or empty html, and one without content, has an empty text. Rows are independent; broken markup is read as the
    standard-library parser reads it, and an element that is never closed ends with its parent.
    """
    keep = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    rows = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html}`").alias("__html"))
    schema = rows.drop("__html").withColumn("text", F.lit("")).schema

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            text = [main_text(h) for h in part["__html"]]
            yield part.drop(columns="__html").assign(text=text)

    return rows.mapInPandas(run, schema).withColumn("n_chars", F.length("text").cast("long"))
