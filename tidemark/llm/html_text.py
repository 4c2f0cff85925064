"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block of the page, with the parts that are never main text left out. Each
line weighs as many characters as it has outside links. Sums over sliding windows of lines rise at a surge point, where
the main text begins, and fall to nothing at a dive point, where it ends; the lines between are kept. Lines that the
page marks as its article or main part weigh more: all of their characters count, and at least as many as make a surge.
An element in it whose name leaves in doubt what it is stays if its own lines make a surge.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

WINDOW = 3
SURGE = 80

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
RAW = frozenset("script style title textarea noscript template iframe svg math canvas object audio video select head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
OUTSIDE = frozenset("nav footer aside form menu dialog button header".split())
CONTAINER = frozenset(("article", "main"))
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar status".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement adsense sponsor sponsored sponsors promo promotion promotions banner nav navbar navigation menu menus breadcrumb breadcrumbs "
    "sidebar rail aside footer masthead topbar header comment comments commentlist disqus respond reply replies discussion cookie cookies consent gdpr notice notices notification "
    "alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations widget widgets toolbar pagination pager skip "
    "copyright legal disclaimer login register search form".split()
)
RIGHTS = re.compile(r"(?:©|\(c\) ?\d|copyright\b)", re.I)
#: words that go with the names above; a name of these two kinds only is that of a part of the page around the text
NEUTRAL = frozenset(
    "site page post posts article articles entry main content contents container wrapper wrap box boxes block blocks list lists item items section sections area areas bar bars left right top bottom "
    "head inner outer col column columns row panel group region element module unit slot card cards side global primary secondary mobile desktop sticky fixed floating small large text link links icon "
    "icons button buttons btn id user users thread info policy tool tools media message messages law trail field input story stories reading news strip line warning danger success mega sub body title "
    "heading label close open fade show image img inline bottombar topnav level default class type style big mini full width center".split()
)
#: names with one of these are always taken as such
SURE = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
#: a name with such a word is made from a title
SLUG = frozenset("a an and for in of on or the to und der die das et la le de los el y".split())
#: elements whose id is an anchor made from their text
ANCHORED = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd td figure".split())
#: Not a statement on the element itself: "with-sidebar", "no-ads".
ABOUT_OTHERS = frozenset(("with", "has", "no", "without", "is", "wp", "js"))
SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
KEPT, DOUBTFUL, UNWANTED = range(3)


def judged(tag: str, attributes: str, inside: bool) -> int:
    """Whether an element and all it holds are left out, or left to what its lines weigh.

    inside: within an article or main element. There, an element that is named partly by a word that such parts have,
    and partly by others, is in doubt.
    """
    if tag in OUTSIDE and not (tag == "header" and inside):
        return UNWANTED
    if not attributes or tag in ("html", "body", "main"):
        return KEPT
    out = KEPT
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return UNWANTED
        if key == "role" and value.strip().lower() in ROLES:
            return UNWANTED
        if key == "class" or key == "id" and tag not in ANCHORED:
            for name in value.split():
                parts = [p.lower() for p in SPLIT.split(name) if p]
                if not parts or parts[0] in ABOUT_OTHERS or (inside and "header" in parts) or not NAMES.intersection(parts) or SLUG.intersection(parts[1:]):
                    continue
                if not inside or SURE.intersection(parts) or all(p in NAMES or p in NEUTRAL or len(p) == 1 for p in parts):
                    return UNWANTED
                out = DOUBTFUL
    return out


def tags(page: str) -> list[tuple[int, int, str, bool, str]]:
    """(start, end, name, whether it is an end tag, attributes) of each piece of markup; the name is empty for comments and the like.

    A raw element, such as a script, is one piece with all it holds.
    """
    out, pos = [], 0
    while m := TAG.search(page, pos):
        start, pos = m.start(), m.end()
        tag, ends, attributes = (m[2] or m[5] or "").lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in RAW and not ends and not attributes.endswith("/"):
            close_at = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, pos)
            pos = close_at.end() if close_at else len(page)
        out.append((start, pos, tag, ends, attributes))
    return out


def ends_of(found: list[tuple[int, int, str, bool, str]]) -> list[int]:
    """For each start tag the number i of the piece behind its end tag; without one, -i - 1 of the next container or of the end.

    One pass: an end tag belongs to the last open start tag of its name.
    """
    after, open_tags = [-1] * len(found), {}
    for i, (_, _, tag, ends, attributes) in enumerate(found):
        if not tag or tag in RAW:
            continue
        if not ends:
            if tag not in VOID and not attributes.endswith("/"):
                open_tags.setdefault(tag, []).append(i)
        elif open_tags.get(tag):
            after[open_tags[tag].pop()] = i + 1
    next_container = len(found)
    for i in range(len(found) - 1, -1, -1):
        tag, ends = found[i][2:4]
        if after[i] < 0:
            after[i] = -(len(found) if tag in CONTAINER else next_container) - 1
        if tag in CONTAINER and not ends:
            next_container = i
    return after


def lines(page: str, surge: int = SURGE, window: int = WINDOW) -> list[tuple[str, int, bool]]:
    """(text, characters outside links, within an article or main element) of each block that has text."""
    out, parts, linked, depth, in_link, at = [], [], 0, 0, False, 0
    doubts: list[int] = []  # where the elements in doubt end, the innermost last
    regions: dict[int, list[int]] = {}  # the lines of each element in doubt, by its number
    numbers: list[int] = []

    def close() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            if numbers:
                regions[numbers[-1]].append(len(out))
            out.append((text, max(0, len(text) - linked), depth > 0))
        parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            parts.append(raw)
            if in_link:
                linked += len(" ".join(html.unescape(raw).split()))

    found = tags(page)
    after, i = ends_of(found), 0
    while i < len(found):
        start, end, tag, ends, attributes = found[i]
        add(page[at:start])
        at, i = end, i + 1
        while doubts and i > doubts[-1]:
            close()
            doubts.pop(), numbers.pop()
        if not tag:
            continue
        if not ends and tag not in VOID and not attributes.endswith("/"):
            if tag in RAW:
                if tag in BLOCK:
                    close()
                continue
            verdict = judged(tag, attributes, depth > 0)
            if verdict == UNWANTED:
                close()
                behind = after[i - 1]
                i = behind if behind >= 0 else -behind - 1
                at = found[i - 1][1] if behind >= 0 else found[i][0] if i < len(found) else len(page)
                continue
            if verdict == DOUBTFUL:
                close()
                doubts.append(after[i - 1] if after[i - 1] >= 0 else -after[i - 1] - 1)
                numbers.append(i - 1)
                regions[i - 1] = []
        if tag in BLOCK:
            close()
            in_link = False
        elif tag == "br":
            parts.append(" ")
        if tag == "a":
            in_link = not ends
        if tag in CONTAINER:
            depth = max(0, depth + (-1 if ends else 1))
    add(page[at:])
    close()
    light = {n for own in regions.values() if not spans([out[n][1] for n in own], surge, window) for n in own}
    return [line for n, line in enumerate(out) if n not in light]


def spans(weights: list[int], surge: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """(first, last) line of each stretch from a surge point to a dive point."""
    n, out, i = len(weights), [], 0
    sums = [sum(weights[j : j + window]) for j in range(n)]
    while i < n:
        if sums[i] < surge or not weights[i]:
            i += 1
            continue
        last = j = i
        while j < n and sums[j]:
            if weights[j]:
                last = j
            j += 1
        out.append((i, last))
        i = j + 1
    return out


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The main text of a page, a line for each block; empty for a null or empty page."""
    found = lines(page or "", surge, window)
    weights = [max(len(t), surge) if kept else 0 if RIGHTS.match(t) else n for t, n, kept in found]
    if not any(weights):
        return ""
    least = min(surge, max(sum(weights[j : j + window]) for j in range(len(weights))) // 2 or 1)
    return "\n".join(t for a, b in spans(weights, least, window) for t, *_ in found[a : b + 1])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    A null or empty page, or one without main text, gives an empty text. Rows that repeat get equal results, null ids and
    urls are kept, other columns are ignored, an empty table gives no rows.
    """

    def run(batches):
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", F.col("html").cast("string")).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
