"""Operator 1: main text of HTML pages by line-block distribution.

Markup is stripped into lines, one for each block element, in page order. What stands in elements that never hold main text
(menus, footers, scripts, adverts, reader comments: by tag, role or class words) is no line. A line weighs its characters
outside of links, and more in a main part that the page marks (article, main; or by class or id): a mark is a factor.
Weights are summed over a sliding window of lines. A run of lines dives where a window holds nothing but links; it is kept if
its sums surge above ``SURGE`` somewhere, so in marked parts, too, runs of links and crumbs between them go. Where no run of a marked
part surges, or none of the page, it is a short one and all its runs are kept. Within a marked run lines that are links alone are text like the
others; elsewhere they are left out.

Windows don't reach across the border of a marked part, and lines outside of it go unless they surge and outweigh it, as the
body of a page does whose articles are teasers; then both are kept. Forms go unless they hold a main part, or the page
has no other text (a form around the whole page).

Plain density cannot tell a short paragraph from an advert of the same length, so marks weigh and bound as well.

Defined results: null or empty html, and pages without text, give an empty text; rows are independent (repeated rows give
repeated results); an empty table gives no rows; columns other than page_id, url and html are not read; texts are whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table

#: Lines in a window; weight that a run's largest sum must pass; factor of each step of a mark (two for an element or role).
WINDOW, SURGE, FACTOR = 3, 80, 3

MARKUP = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*+)>?|<[!?][^>]*>?", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

# HTML element names, by what they do to text.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
NEVER = {"nav", "footer", "aside", "script", "style", "noscript", "iframe", "svg", "math", "button", "select", "textarea", "dialog", "menu", "template", "object", "canvas", "head", "title", "datalist", "audio", "video"}
#: A start tag of these ends an open element of the same group.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words of a class or id, and roles, that name what is not main text.
WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "widget", "widgets", "footer", "masthead", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "comment", "comments", "commentlist", "disqus", "adsbygoogle", "replies", "reply", "respond", "responses", "reactions", "discussion", "feedback", "talkback", "related", "recommended", "share", "sharing", "social", "searchform", "toolbar", "pagination", "pager", "copyright", "disclaimer", "skip"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
OUTSIDE_ONLY = {"header"}
#: Whole class or id values that mark a main part where no element or role does.
MARKS = {"content", "main", "article", "post", "entry", "main-content", "page-content", "post-content", "article-content", "entry-content", "article-body", "post-body", "story-body", "story"}
#: What follows the first of these is what a page has, and an element that ends in the others holds more than what a word inside names.
WITH = {"has", "no", "with", "without"}
WRAPS = {"wrap", "wrapper", "container", "area", "layout", "inner", "outer", "content", "page", "row", "grid", "main", "body"}
#: Headings of reader comments; what follows them in their element is comments.
COMMENTS = re.compile(r"(?i)\d[\d.,]* (?:reader |user )?comments?|(?:reader |user )?comments? \(\d[\d.,]*\)|(?:reader|user) comments|leave a (?:comment|reply)")
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Why a part is off: a form, class words, its kind.
FORM, WORDED, OFF = 1, 2, 3
CLASS_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)}


def aside(name: str, text: str, in_main: bool) -> int:
    """``OFF`` for an element that never holds main text, ``WORDED`` for one that only its class or id words call so, ``FORM``, else 0."""
    if name in NEVER or name in OUTSIDE_ONLY and not in_main:
        return OFF
    form = FORM if name == "form" else 0
    if not text or name in ("html", "body", "main"):
        return form
    a = attributes(text)
    role = a.get("role", "").lower()
    if role in ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", a.get("style", "")):
        return OFF
    if role == "form":
        form = FORM
    for one in f"{a.get('class', '')} {a.get('id', '')}".split():
        found = [w.lower() for w in CLASS_WORD.findall(one)]
        said = found[: next((i for i, w in enumerate(found) if w in WITH), len(found))]
        if mark(name, text):  # a post's labels (category-social, tag-menu) hold any word
            said = said if len(found) == 1 else []
        elif found and found[-1] in WRAPS:
            said = said[:1]
        if not WORDS.isdisjoint(said):
            return WORDED
    return OFF if "header" in f"{a.get('class', '')} {a.get('id', '')}".lower().split() and not in_main else form


def mark(name: str, text: str) -> int:
    """2 for a main part by element or role, 1 by class or id, else 0."""
    if name in ("article", "main"):
        return 2
    if not text or name not in ("div", "section", "td"):
        return 0
    a = attributes(text)
    if a.get("role") in ("main", "article"):
        return 2
    return int(not MARKS.isdisjoint(f"{a.get('class', '')} {a.get('id', '')}".lower().split()))


def lines(html: str, lift: bool = False) -> list[tuple[str, int, int]]:
    """(text, characters outside of links, ``mark`` of the main part it is in) of each block with text, in page order.

    A main element within an element that class words put aside counts all the same, and an article or main element in a form does;
    with ``lift`` any main part does, and forms are no reason.
    """
    out: list[tuple[str, int, int]] = []
    text: list[str] = []
    free = 0
    stack: list[tuple[str, int, int, bool]] = []  # name, ``aside``, mark of the main part, in a link
    off, main, link = 0, 0, False

    def close() -> None:
        nonlocal text, free
        if text:
            line = " ".join(unescape("".join(text)).split())
            if line:
                out.append((line, min(free, len(line)), main))
        text, free = [], 0

    def add(part: str) -> None:
        nonlocal free
        if part and not off:
            text.append(part)
            if not link:
                free += len(part.strip())

    at, end = 0, len(html)
    while at < end:
        m = MARKUP.search(html, at)
        if not m:
            add(html[at:])
            break
        add(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name, before = m[2].lower(), len(out)
        if name in BLOCK:
            close()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    off, main, link = stack[-1][1:] if stack else (0, 0, False)
                    break
            if name in HEADINGS and len(out) > before and COMMENTS.fullmatch(out[-1][0]):
                out.pop()
                off, main = OFF, 0
                if stack:
                    stack[-1] = (stack[-1][0], off, main, link)
            continue
        if name in RAW:
            stop = re.compile(f"</{name}", re.I).search(html, at)
            at = stop.start() if stop else end
            tail = html.find(">", at)
            at = end if tail < 0 else tail + 1
            continue
        if name in VOID or m[3].endswith("/") and name in ("svg", "math"):
            continue
        if name in ENDS or name in BLOCK:
            ends = ENDS.get(name, {"p"})
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ends:
                    del stack[k:]
                    break
                if stack[k][0] in BLOCK:
                    break
            off, main, link = stack[-1][1:] if stack else (0, 0, False)
        own, marked = aside(name, m[3], main > 0), mark(name, m[3])
        if lift and (own == FORM or own == WORDED and marked):
            own = 0
        is_main = name == "main" or attributes(m[3]).get("role") == "main"
        if not own and marked and (off == FORM and marked > 1 or off == WORDED and (lift or is_main)):
            off = 0
        off = max(off, own)
        main = 0 if off else max(main, marked)
        link = link or name == "a"
        stack.append((name, off, main, link))
    close()
    return out


def main_text(html: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    found = lines(html or "")
    text = chosen(found, window, surge)
    if len(text) <= surge and not any(inside for _, _, inside in found):  # what there is may stand in what class words or a form put aside
        text = max(text, chosen(lines(html or "", lift=True), window, surge), key=len)
    return text


def runs(weights: list[int], sums: list[int], inside: list[int]) -> list[tuple[int, int]]:
    """(begin, end) of the lines from each rise of the weights to the next dive, within a part."""
    out, begin = [], None
    for i, (weight, total) in enumerate(zip(weights, sums, strict=True)):
        if begin is not None and (not total or inside[i] != inside[begin]):
            out.append((begin, i))
            begin = None
        if begin is None and weight:
            begin = i
    return out if begin is None else [*out, (begin, len(weights))]


def chosen(found: list[tuple[str, int, int]], window: int, surge: int) -> str:
    inside = [x for _, _, x in found]
    weights = [free * FACTOR**x if x or 2 * free >= len(t) else 0 for t, free, x in found]
    sums = [sum(w for w, x in zip(weights[i : i + window], inside[i : i + window]) if x == inside[i]) for i in range(len(found))]
    top = level = max(inside, default=0)
    mass = {m: sum(w for w, x in zip(weights, inside) if x == m) for m in range(top + 1)}
    for m in range(top - 1, -1, -1):
        if mass[m] > mass[level] and any(s > surge for s, x in zip(sums, inside) if x == m):
            level = m
    kept = [(a, b) for a, b in runs(weights, sums, inside) if inside[a] >= level]
    part = [0] * len(found)  # stretches of lines of one mark
    for i in range(1, len(found)):
        part[i] = part[i - 1] + (inside[i] != inside[i - 1])
    surging = {(a, b) for a, b in kept if max(sums[a:b]) > surge}
    full = {part[a] for a, _ in surging}
    # a marked part that never surges is a short one, as is a page
    kept = [r for r in kept if not surging or r in surging or inside[r[0]] and part[r[0]] not in full]
    return " ".join(found[i][0] for a, b in kept for i in range(a, b) if weights[i] or inside[i])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
