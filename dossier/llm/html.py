"""Operator 5: main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block element, and each line has a weight: the length of its text outside
links. Markup only adds evidence: a line of an article counts more, one of a menu, header, footer, form or comment
section, or of an element marked as an advert or notice, counts against. Weights are summed over sliding windows of
the lines that have text. A surge opens the text: a line with weight whose window holds a share of the page's heaviest
window, or the least that a paragraph has. A dive closes it: a line whose window, ahead, holds less than an article's
single line has, unless it stands in the same element as a paragraph of the text, as a short last sentence does. What lies
between is the text, without the lines that count against, so that an advert between two paragraphs goes and a list of
links between them stays. Short lines at either end of such a stretch go too if they are no headings, not in an
article, and no paragraph shares their element: plain menus and legal lines. Each line has decoded references and single spaces.

A mark is a whole word of class, id or role, or part of a compound for the few words that name nothing else. Words that also stand for
articles (search, share, related, ...) take from a line's weight what a short line has, so a paragraph under such a
mark stays and a row of buttons goes. No mark can empty a page: where nothing would be left, words of class, id and role don't count. Hidden
elements are text as others are.

One pass without a shuffle, a page at a time. Null and empty pages have empty text; pages without a line of
weight have none. Unclosed and stray tags, repeated rows and further columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from dossier.llm.common import pick, small

#: Lines of a window; a surge's least sum, and its share of the page's heaviest window where that has less.
WINDOW, SURGE, SHARE = 3, 60, 0.5
#: What a line with text outside links weighs more within an article, and less under a mark that may mean either.
EVIDENCE, DOUBT = 20, 60
#: The least weight of a line that makes its element one of text.
PARAGRAPH = 30
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|select|svg|iframe|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
INLINE = set("math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle semantics object a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
NEVER_OPEN = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements, and words of class, id or role, that stand for what is not the article; words that may.
ASIDE = set("nav aside footer header form button menu dialog".split())
ASIDE_WORDS = set("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comments commentlist contentinfo cookie cookies disqus footer gdpr masthead nav navbar navigation newsletter notice notices sidebar sponsored subscribe subscription".split())
DOUBT_WORDS = set("comment complementary consent copyright dropdown header login menu modal pager pagination popup promo promotion related replies respond search share sharing signup skip social sponsor toolbar widget widgets".split())
MAIN = {"article", "main"}
MARK = re.compile(r"(?:\bclass|\bid|\brole)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Words of ASIDE_WORDS that stand for the same as a part of a compound, as in cookie-notice.
ASIDE_PARTS = set("advertisement breadcrumb breadcrumbs commentlist comments cookie cookies disqus footer gdpr masthead navbar newsletter sidebar sponsored".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold one line of a text; what is around them is the element that it shares with others.
LEAVES = HEADINGS | set("p li dt dd blockquote pre figcaption td th tr".split())
#: What an opening element closes if it is still open.
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}


def _against(name: str, attributes: str, in_main: bool, words_count: bool) -> int:
    """2 for an element that stands for what is not the article, 1 for one that may, 0 for others."""
    if name in ("html", "body") or name in MAIN:
        return 0
    if name in ASIDE:
        return 0 if name == "header" and in_main else 2  # an article's own header holds its title
    if not attributes or not words_count:
        return 0
    words = {w for m in MARK.finditer(attributes) for w in (m[1] or m[2] or m[3] or "").lower().split()}
    parts = {p for w in words for p in re.split("[-_]+", w)}
    return 2 if words & ASIDE_WORDS or parts & ASIDE_PARTS else 1 if words & DOUBT_WORDS and not (in_main and words & {"header"}) else 0


class Line(NamedTuple):
    text: str
    weight: int
    #: The element that it shares with others, by number.
    within: int
    #: Stands in an article or is a heading.
    firm: bool


def lines_of(html: str, words_count: bool = True) -> list[Line]:
    """The lines that have text; words of class, id and role count unless words_count is False."""
    lines: list[Line] = []
    buffer: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, int, bool, int]] = []  # name, what counts against it, main, number
    marks = [0, 0, 0]  # open elements by what counts against them
    mains = links = number = 0

    def end_line() -> None:
        text = " ".join(unescape("".join(buffer)).split())
        if text:
            n = len(text) - len(" ".join(unescape("".join(linked)).split()))
            if marks[2]:
                n = -len(text)
            elif n:
                n += EVIDENCE * (mains > 0) - DOUBT * (marks[1] > 0)
            within = next((k for name, _, _, k in reversed(stack) if name not in LEAVES and name not in INLINE), 0)
            lines.append(Line(text, n, within, mains > 0 or any(name in HEADINGS for name, *_ in stack)))
        buffer.clear()
        linked.clear()

    def close(k: int) -> None:
        nonlocal mains
        for _, against, main, _ in stack[k:]:
            marks[against] -= 1
            mains -= main
        del stack[k:]

    def take(text: str) -> None:
        if text:
            buffer.append(text)
            if links:
                linked.append(text)

    at = 0
    for m in TOKEN.finditer(html):
        if m.start() > at:
            take(html[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        inline = name in INLINE
        if not inline:
            end_line()
        if m[2]:
            if name == "a":
                links = max(0, links - 1)
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if inline:
                        end_line()
                    close(k)
                    break
            continue
        if name in NEVER_OPEN:
            continue
        if name == "a":
            links += 1
        if not inline:
            shut = CLOSES.get(name, {"p"})
            while stack and stack[-1][0] in shut:
                close(len(stack) - 1)
        against = _against(name, m[4], mains > 0, words_count)
        main = name in MAIN or bool(m[4]) and "role" in m[4] and re.search(r"role\s*=\s*[\"']?main\b", m[4], re.I) is not None
        if against and inline:  # an inline element that counts against is a line of its own
            end_line()
        if against or not inline:
            number += 1
            stack.append((name, against, main, number))
            marks[against] += 1
            mains += main
    take(html[at:])
    end_line()
    return lines


def windows(weights: list[int]) -> list[int]:
    """The sum of each line's weight and those of the next lines, WINDOW in all; lines that count against hold none."""
    held = [max(w, 0) for w in weights]
    return [sum(held[k : k + WINDOW]) for k in range(len(held))]


def stretches(lines: list[Line]) -> list[tuple[int, int]]:
    """The lines from each surge to its dive."""
    ahead = windows([x.weight for x in lines])
    surge = min(SURGE, SHARE * max(ahead, default=0))
    dive = min(EVIDENCE, surge)
    texts = {x.within for x in lines if x.weight >= PARAGRAPH}
    found: list[tuple[int, int]] = []
    opened = None
    for k, (line, block) in enumerate(zip(lines, ahead, strict=True)):
        if line.weight > 0 and block >= surge:
            opened = k if opened is None else opened
        elif opened is not None and not (line.weight > 0 and line.within in texts) and (block < dive or line.weight <= 0 and not block):
            found.append((opened, k))
            opened = None
    if opened is not None:
        found.append((opened, len(lines)))
    loose = [not x.firm and x.weight < PARAGRAPH and x.within not in texts for x in lines]
    trimmed = []
    for begin, end in found:
        if not all(loose[begin:end]):  # else the page has nothing longer: a stretch of short lines is its text
            while loose[begin]:
                begin += 1
            while loose[end - 1]:
                end -= 1
        trimmed.append((begin, end))
    return trimmed


def main_text(html: str) -> str:
    for words_count in (True, False):
        lines = lines_of(html, words_count)
        kept = [x.text for begin, end in stretches(lines) for x in lines[begin:end] if x.weight >= 0]
        if kept:
            break
    return "\n".join(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            texts = [main_text(h or "") for h in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pick(pages, page_id=id_col, url=url_col, html=html_col).mapInArrow(run, "page_id long, url string, text string, n_chars long")
