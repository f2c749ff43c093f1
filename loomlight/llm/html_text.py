"""Main text of web pages by two passes of block rules.

First each block is judged on its own: by the element it is in, by its share of link
text, its share of stop words and its length. An article element speaks for a block, but
does not decide alone, and so does a class name that only in part sounds like a menu or
notice (``social-history``) speak against it. Blocks that are too short to tell, and those of
few links in a language without known stop words, stay open. Then each open block takes the
label of the nearest decided blocks: that of both neighbours if they agree, else that of the
nearer one, the main text on a tie.

A page is one row, and pages are independent, so the work is one pass without a shuffle.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlight.llm.frames import ROW, field, map_texts, packed, pick

# Names of elements, and the most frequent function words of four languages.
RAW = frozenset("script style noscript template svg math iframe object textarea select option canvas head title".split())
ASIDE = frozenset("nav header footer aside form menu dialog button fieldset label figcaption".split())
MAIN = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
#: Words of class and id attributes that mark what is not the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar "
    "navigation breadcrumb breadcrumbs footer masthead header cookie cookies consent notice notices gdpr popup modal "
    "newsletter subscribe subscription signup login share sharing social related recommended widget toolbar comment "
    "comments respond reply replies disqus pagination pager".split()
)
#: Words beside a mark that leave its meaning as it is, those that make a head the article's own, and such heads.
LAYOUT = frozenset(
    "site page top bottom left right main global box bar block area wrap wrapper container inner outer section list item "
    "items link links button buttons slot unit row col widget body text content form policy message overlay".split()
)
OWN = frozenset("article post entry story title headline chapter section content".split())
HEADS = frozenset("header masthead banner".split())
STOP_WORDS = frozenset(
    "the of and to a in is it that was for on with as be by at this are or from an not you have he she they we "
    "le la les de des du un une et est en que qui dans pour sur au aux pas par ce il elle ne se avec "
    "der die das und ist nicht ein eine den dem von zu mit auf für im sich des auch es als an wie "
    "el los las del y en que no una por con para su al lo como más se".split()
)

LINKED = 0.5
SHORT = 70
LONG = 200
LOW, HIGH = 0.12, 0.25
#: Share of link text up to which a block of unknown language stays open.
FEW_LINKS = 0.2
#: What an article element adds to the share of stop words, for blocks of few links and for others.
BONUS, LINKED_BONUS = HIGH, HIGH - LOW

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*?)(>|\Z)|</[^>]*(?:>|\Z)",
    re.S,
)
_MARKED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_ENDS = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I) for tag in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "select", "object", "canvas")}


def _marked(attributes: str) -> tuple[bool, bool]:
    """Whether class, id or role say that an element is beside the article, and whether they may say so.

    They say so by a name made of marks and layout words (``cookie-box``) or ending in a mark
    (``post-comments``). Other names with a mark (``social-history``) may, but those of the
    article's own head (``article-header``) do not.
    """
    says = may = False
    for found in _MARKED.finditer(attributes):
        for name in (found[1] or found[2] or found[3] or "").lower().split():
            words = [w for w in re.split(r"[^a-z]+", name) if w]
            marks = MARKS.intersection(words)
            if not marks or (marks <= HEADS and not OWN.isdisjoint(words)):
                continue
            if words[-1] in MARKS or all(w in MARKS or w in LAYOUT for w in words):
                says = True
            else:
                may = True
    return says, may


def blocks(page: str) -> list[tuple[str, int, bool, bool, bool]]:
    """The blocks of a page with text: (text, characters in links, in a side element, in what may be one, in the article)."""
    out: list[tuple[str, int, bool, bool, bool]] = []
    parts: list[str] = []
    state = {"linked": 0, "in_link": 0}
    stack: list[tuple[str, tuple[bool, bool, bool]]] = []
    open_of: Counter[str] = Counter()  # elements on the stack by tag, and those that are, may be aside, or are main
    around = [0, 0, 0]

    def push(tag: str, kinds: tuple[bool, bool, bool]) -> None:
        stack.append((tag, kinds))
        open_of[tag] += 1
        for i, x in enumerate(kinds):
            around[i] += x

    def pop() -> str:
        tag, kinds = stack.pop()
        open_of[tag] -= 1
        for i, x in enumerate(kinds):
            around[i] -= x
        return tag

    def end() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append((text, state["linked"], around[0] > 0, around[1] > 0, around[2] > 0))
        parts.clear()
        state["linked"] = 0

    at = 0
    while True:
        found = _TOKEN.search(page, at)
        text = page[at : found.start() if found else len(page)]
        if text:
            parts.append(text)
            if state["in_link"]:
                state["linked"] += len("".join(text.split()))
        if not found:
            break
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if tag in INLINE:
            if tag == "a":
                state["in_link"] = 0 if found[1] else 1
            elif tag == "br":
                parts.append(" ")
            if tag != "span" or found[1] or not _marked(found[3])[0]:
                if tag == "span" and found[1] and stack and stack[-1][0] == "span":
                    end()
                    pop()
                continue
        end()
        if found[1]:
            if open_of[tag]:
                while pop() != tag:
                    pass
            continue
        if tag in VOID:
            continue
        if tag in _ENDS:
            close = _ENDS[tag].search(page, at)
            at = close.end() if close else len(page)
            continue
        if stack and stack[-1][0] in ("p", "li", "dt", "dd", "tr", "td", "th") and stack[-1][0] == tag:
            pop()
        elif stack and stack[-1][0] == "p":
            pop()
        says, may = _marked(found[3])
        push(tag, (says or tag in RAW or tag in ASIDE, may, tag in MAIN))
    end()
    return out


def judge(found: list[tuple[str, int, bool, bool, bool]]) -> list[bool | None]:
    """First pass: True for main text, False for what is not, None where the block alone does not say."""
    out: list[bool | None] = []
    for text, linked, side, doubtful, main in found:
        size = len(text)
        words = text.lower().split()
        common = sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words)
        main = main and not doubtful
        if main:
            common += BONUS if linked <= FEW_LINKS * size else LINKED_BONUS
        if side or linked > (FEW_LINKS if doubtful else LINKED) * size:
            out.append(False)
        elif size < SHORT:
            out.append(None if main and linked else True if main else False if linked else None)
        elif common >= HIGH or (common >= LOW and size >= LONG):
            out.append(True)
        elif common >= LOW or linked <= FEW_LINKS * size:
            out.append(None)
        else:
            out.append(False)
    if True not in out:  # a page in a language without stop words: its long blocks of few links
        for i, (text, linked, *_) in enumerate(found):
            if out[i] is None and len(text) >= SHORT and linked <= FEW_LINKS * len(text):
                out[i] = True
    return out


def settle(labels: list[bool | None]) -> list[bool]:
    """Second pass: open blocks inherit from the nearest decided ones; with none, nothing is main text."""
    n = len(labels)
    before: list[tuple[int, bool] | None] = []
    last = None
    for i, x in enumerate(labels):
        if x is not None:
            last = (i, x)
        before.append(last)
    out, following = [False] * n, None
    for i in range(n - 1, -1, -1):
        x = labels[i]
        if x is not None:
            following = (i, x)
            out[i] = x
            continue
        left = before[i]
        if left is None or following is None:
            side = left or following
            out[i] = bool(side and side[1])
        elif left[1] == following[1]:
            out[i] = left[1]
        else:
            gap = (i - left[0]) - (following[0] - i)
            out[i] = True if gap == 0 else (left if gap < 0 else following)[1]
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return "\n".join(x[0] for x, keep in zip(found, settle(judge(found))) if keep)


def extracted(pages: DataFrame, carry: list[str]) -> DataFrame:
    """``carry`` and the main text of each row of ``pages`` (html and ``carry``).

    Null and empty pages, and pages without main text, have the empty text. Broken
    markup is read as far as it goes: an open comment, script or tag reaches to the end.
    """

    def make():
        return lambda pages: [pa.array([main_text(x) for x in pages.to_pylist()], pa.string())]

    return map_texts(pages, "html", carry, [field("text", "string")], make)


def with_text(pages: DataFrame, name: str = "main_text") -> DataFrame:
    """All columns of ``pages``, and the main text as column ``name``, which replaces one of that name."""
    found = extracted(packed(pages, html="string"), [ROW])
    kept = [(i, c) for i, c in enumerate(pages.columns) if c != name]
    out = found.select(*[F.col(ROW)[f"_c{i}"].alias(f"_c{i}") for i, _ in kept], "text")
    return out.toDF(*[c for _, c in kept], name)


def report(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    found = extracted(pick(pages, page_id="bigint", url="string", html="string"), ["page_id", "url"])
    return found.withColumn("n_chars", F.length("text").cast("bigint"))
