"""Main text of web pages: the contiguous region of tokens with the greatest score.

A page is cut into tags and runs of text. Words score above zero and tags below, by weights
learnt from labelled pages: those that mark their article themselves, with one ``article``
element that is opened and closed. One pass over the page finds the run of tokens with the
greatest sum. What can never be article text, such as scripts, forms, menus and elements named
as adverts or comments, is taken out first and has no say in the sum. A name alone takes out no
element that is or holds an article, nor one with most of the words of a page that marks no article
elsewhere: its tags weigh ``NAMED``, and the sum decides.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from math import log

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from boardsight.llm.common import appended, small_batches

FIT_PAGES = 2_000  # labelled pages to learn from, the first by a digest of their id
BORDER = -1e4  # weight of the tags that the labels themselves are made of
LIGHT = -0.01  # the least a tag costs
NAMED = -20.0  # weight of the tags of an element that is named as something else, but kept

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*"[^"]*"|=\s*'[^']*'|=)*)>?""", re.DOTALL)  # a quote opens a value only after "="
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?|"[^"]*"|'[^']*'""")

# Fixed lists of element names, from the HTML standard.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
DROPPED = frozenset("nav header footer aside form button select option datalist fieldset menu dialog svg math object applet audio video canvas map head".split())
PAGE_PARTS = frozenset("nav header footer aside head".split())
ENDS_ITSELF = frozenset("p li dt dd option".split())
BORDERS = frozenset(("article", "/article", "main", "/main", "named article", "/named article", "named main", "/named main"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
# Parts of class and id names that mark what is not the article.
CHROME = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|adbox|banner|promo(?:tion)?s?|sponsor(?:ed|s)?|nav|navbar|navigation|menu|sidebar|side-bar|breadcrumbs?|footer"
    r"|header|masthead|topbar|toolbar|cookies?|consent|gdpr|notices?|alert|popup|pop-up|modal|overlay|newsletter|subscribe|subscription|signup|sign-up|login"
    r"|shar(?:e|ing)|social|related|recommend(?:ed|ations?)?|comments?|comment-list|commentlist|discussion|disqus|repl(?:y|ies)|respond|widgets?|pagination|pager|skip-link)(?:$|[\s_-])",
    re.IGNORECASE)
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog alertdialog".split())


def furniture(attributes: str) -> str:
    """What an element's attributes say against it: "hidden", "named" as something else than article text, or nothing."""
    named = ""
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.IGNORECASE):
            return "hidden"
        if name in ("class", "id") and CHROME.search(value) or name == "role" and value.lower() in ROLES:
            named = "named"
    return named


def main_holders(page: str) -> dict[int, int]:
    """Elements that a name must not take out, by where their opening tags begin: where their closing tags do, or -1.

    They are or hold an article or main element, or have most of the page's words and no such
    element stands outside them. One pass, with a stack for each element name.
    """
    found: list[tuple[int, int, int, int]] = []  # opening, closing, words, articles
    opened: dict[str, list[tuple[int, int, int]]] = {}
    at = words = marks = 0

    def close(name: str, where: int) -> None:
        if opened.get(name):
            start, before, marked = opened[name].pop()
            found.append((start, where, words - before, marks - marked))

    for m in iter(lambda: TOKEN.search(page, at), None):
        words += len(page[at:m.start()].split())
        at = m.end()
        closing, name, attributes = m.group(1), (m.group(2) or "").lower(), m.group(3) or ""
        if not name:
            continue
        if name not in INLINE | VOID:
            close("p", m.start() if closing and name == "p" else -1)
        if closing:
            if name in ("ul", "ol"):
                close("li", -1)
            close(name, m.start())
        elif name in RAW:
            at = after_raw(page, name, at)
        elif name not in VOID and not attributes.rstrip().endswith("/"):
            if name in ENDS_ITSELF:
                close(name, -1)
            opened.setdefault(name, []).append((m.start(), words, marks))
            marks += name in ("article", "main")
    words += len(page[at:].split())
    for name, left in opened.items():
        while left:
            close(name, -1)
    return {start: end for start, end, own, marked in found if marked or not marks and 2 * own > words}


def tokens(page: str) -> list[tuple[str, str]]:
    """("text", run) and (tag, "") in page order; tags are "p", "/p" and so on, and "gone" stands for what is taken out."""
    out: list[tuple[str, str]] = []
    at = 0  # where the text after the last tag begins
    gone, depth = "", 0  # the element that is being taken out, and how many of its name are open
    by_name = False  # it is taken out for its attributes
    holders: dict[int, int] | None = None
    named: set[int] = set()  # where the closing tags of kept elements stand
    while True:
        m = TOKEN.search(page, at)
        if not m:
            break
        if not gone and m.start() > at:
            out.append(("text", page[at:m.start()]))
        at = m.end()
        closing, name, attributes = m.group(1), (m.group(2) or "").lower(), m.group(3) or ""
        if not name:
            continue
        if gone:
            if name == gone and not (name in ENDS_ITSELF and not closing):
                depth += -1 if closing else not attributes.rstrip().endswith("/")
                if depth <= 0:
                    gone = ""
                continue
            if name == gone:
                gone = ""  # the one before ends where the next begins
            elif not closing and name in ("article", "main") and gone in PAGE_PARTS and not by_name or not closing and name == "body" and gone == "head":
                gone = ""  # it was never closed
            elif gone == "p" and name not in INLINE | VOID:
                gone = ""  # a paragraph ends where a block begins or its parent ends
            elif closing and gone == "li" and name in ("ul", "ol"):
                gone = ""
            else:
                if not closing and name in RAW:
                    at = after_raw(page, name, at)
                continue
        if not closing and name in RAW:
            at = after_raw(page, name, at)
            continue
        if not closing and name not in VOID and not attributes.rstrip().endswith("/"):
            against = furniture(attributes) if name not in ("html", "body") else ""
            if against == "named":
                holders = main_holders(page) if holders is None else holders
            kept = against == "named" and m.start() in holders
            by_name = bool(against) and not kept
            if by_name or name in DROPPED:
                gone, depth = name, 1
                out.append(("gone", ""))
                continue
            if kept:
                named.add(holders[m.start()])
                name = "named " + name
        elif closing and m.start() in named:
            name = "named " + name
        out.append((closing + name, ""))
    if not gone and at < len(page):
        out.append(("text", page[at:]))
    return out


def after_raw(page: str, name: str, at: int) -> int:
    """Where the content of a raw element ends, with its closing tag; the page's end if it has none."""
    m = re.compile(rf"</{re.escape(name)}[^>]*>", re.IGNORECASE).search(page, at)
    return m.end() if m else len(page)


def region(found: list[tuple[str, str]], weights: dict[str, float]) -> tuple[int, int]:
    """The tokens from and up to which the sum of scores is greatest, by one scan; the first and shortest of equals.

    Inside an element that the page itself marks as its article, no tag weighs more than a
    paragraph's would, so short headings at its edges are not cut off; nor do inline tags anywhere.
    """
    best, span, total, start, inside = 0.0, (0, 0), 0.0, 0, False
    word, other = weights.get("word", 1.0), weights.get("tag", -1.0)
    for i, (tag, run) in enumerate(found):
        if tag == "text":
            total += word * len(run.split())
        elif tag in BORDERS:
            inside = tag[0] != "/"
            total += weights.get(tag, BORDER if "named " in tag else other)
        elif "named " in tag:
            total += weights.get("named", NAMED)
        elif inside or tag.lstrip("/") in INLINE:
            total += LIGHT
        elif tag != "gone":
            total += weights.get(tag, other)
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, span = total, (start, i + 1)
    return span


def main_text(page: str | None, weights: dict[str, float]) -> str:
    found = tokens(page or "")
    start, end = region(found, weights)
    text = "".join(entities.unescape(run) if tag == "text" else "" if tag.lstrip("/") in INLINE else " " for tag, run in found[start:end])
    return " ".join(text.split())


def unnamed(found: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Tokens outside elements that are named as something else: what labels are learnt from."""
    out, depth = [], 0
    for tag, run in found:
        if tag.startswith("named "):
            depth += 1
        if not depth:
            out.append((tag, run))
        if tag.startswith("/named "):
            depth -= 1
    return out


def _count(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Tokens inside and outside the article of labelled pages, counted by task."""
    inside, outside = Counter(), Counter()
    for frame in frames:
        for page in frame["html"]:
            found = unnamed(tokens(page))
            marks = [i for i, (tag, _) in enumerate(found) if tag in ("article", "/article")]
            if len(marks) != 2 or found[marks[0]][0] != "article":
                continue
            for i, (tag, run) in enumerate(found):
                (inside if marks[0] < i < marks[1] else outside)["word" if tag == "text" else tag] += len(run.split()) if tag == "text" else 1
    yield pd.DataFrame([(k, inside[k], outside[k]) for k in inside | outside], columns=["token", "inside", "outside"])


def learn_weights(pages: DataFrame, page_id: str = "page_id", html: str = "html", rows: int = FIT_PAGES) -> dict[str, float]:
    """Weight of a word ("word"), of each tag, and of tags never seen ("tag").

    A word weighs 1. A tag weighs the logarithm of how much more often it is inside an article
    than outside, at most ``LIGHT``; the borders of articles weigh ``BORDER``. With no labelled page
    other tags weigh -1. Only counts by tag reach the driver.
    """
    digest = F.md5(F.col(page_id).cast("string"))
    marked = pages.filter(F.col(html).contains("<article"))
    chosen = marked.select(digest.alias("d")).orderBy("d").limit(rows).distinct()
    picked = marked.join(F.broadcast(chosen), digest == F.col("d"), "left_semi").select(F.col(html).alias("html"))
    got = small_batches(picked).mapInPandas(_count, "token string, inside long, outside long").groupBy("token").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o")).collect()
    weights = {"word": 1.0, "tag": -1.0} | {r["token"]: min(LIGHT, log((r["i"] + 0.5) / (r["o"] + 0.5))) for r in got if r["token"] not in ("word", "gone")}
    return weights | dict.fromkeys(BORDERS, BORDER)


def extract(pages: DataFrame, weights: dict[str, float], html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Columns ``keep`` with text (the main text) and n_chars (its code points), for every row.

    The whole page is read; character references are decoded, blanks inside a block become one
    space, and blocks are joined by one. A null page, and one without words, has empty text.
    """
    def texts(values: list) -> Iterator[tuple[str, int]]:
        for page in values:
            text = main_text(page, weights)
            yield text, len(text)

    return appended(pages.select(*keep, F.col(html).alias("html_")), "html_", lambda: texts, "text string, n_chars long", drop=True)
