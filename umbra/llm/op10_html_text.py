"""Main text of web pages by line-block distribution.

Markup is stripped to lines: every block element begins and ends one, inline markup leaves no trace. A line weighs as
many characters as it has outside links. The weights are summed over a sliding window of ``WINDOW`` lines; a stretch
begins where the sums surge from nothing and ends where they dive to nothing again, and it is text if its sums get up to
``SURGE`` (or no stretch's do). So what only links fill, such as a menu without a name, and short lines far from the
text are left out, while short lines and links amid the text stay. If the page marks an article or main element, the
lines outside weigh nothing and every stretch inside is text. Pages of links only are kept whole.

Before that, scripts, styles and the like are cut out, and so is page furniture: by element (nav, footer, aside, ...), by
role, and by words of the class or id. What such a word names is no furniture if it holds most of the page's text, less
than half of it in links, and is what the text stands in: it holds the page's first article, main or h1 element, or the
page has none, or it lies in an article itself (readers' comments count only if they hold the first of these, or nearly
all text). Body and html are never furniture, article and main only as readers' comments.

Pages are read in one pass, in time that grows with their length, however broken they are.

Defined cases: a null or empty page gives an empty text and 0 characters; pages of any length are read whole; elements
that are never closed end where the next piece of the page's structure begins; a tag, comment or script that is never
closed ends the page; repeated rows repeat; an empty table stays empty. Columns of the input stay, but ``text`` and
``n_chars`` replace columns of those names.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from umbra.llm.common import table

#: Lines of a window, and the characters outside links that the sums of a text get up to where no element marks it.
WINDOW, SURGE = 3, 80

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
#: The rest of a tag. Quotes count behind an equals sign only. Possessive, so that nothing is read twice.
_REST = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>")
_RAW = {x: re.compile(rf"</{x}(?![\w-])", re.I) for x in ("script", "style", "textarea", "title", "noscript", "iframe", "template")}
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(\"[^\"]*+\"|'[^']*+'|[^\s>]+)", re.I)
_HREF = re.compile(r"(?<![\w-])href\s*=", re.I)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CUT = frozenset("head title nav header footer aside noscript template svg math button select textarea iframe object audio video canvas dialog menu fieldset map script style".split())
_STRUCTURE = frozenset("body article main section h1 nav header footer aside".split())
_HEADS = frozenset("article main h1".split())
_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar".split())
_FURNITURE = frozenset(
    "ad ads adv advert advertisement advertising adbox banner breadcrumb breadcrumbs comment comments consent cookie cookies"
    " copyright disqus footer header masthead menu modal nav navbar navigation newsletter notice notices pager pagination"
    " popup promo promotion related respond share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar widget".split()
)
_COMMENTS = frozenset("comment comments disqus respond".split())
_KEEP, _WEIGH, _READERS, _DROP = range(4)


def tags_of(page: str) -> list[tuple[int, int, str, bool, str]]:
    """(begin, end, name, closing, attributes) of all tags; comments and raw elements' contents are parts of one."""
    out, at, quotes = [], 0, True
    while (begin := page.find("<", at)) >= 0:
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4) + 3
            if end == 2:
                out.append((begin, len(page), "", False, ""))
                break
            out.append((begin, end, "", False, ""))
            at = end
            continue
        m = _NAME.match(page, begin)
        if not m:
            if page[begin + 1 : begin + 2] not in ("!", "?", "/"):  # a sign, not a tag
                at = begin + 1
                continue
            end = page.find(">", begin) + 1
            out.append((begin, end or len(page), "", False, ""))
            if not end:
                break
            at = end
            continue
        name = m[2].lower()
        rest = _REST.match(page, m.end()) if quotes else None
        if rest:
            end = rest.end()
        else:
            quotes = False  # a quote is never closed: from here on none count
            end = page.find(">", m.end()) + 1
            if not end:
                out.append((begin, len(page), "", False, ""))
                break
        at = end
        closing, attributes = bool(m[1]), page[m.end() : end - 1]
        if name in _RAW and not closing:
            close = _RAW[name].search(page, end)
            # Up to the closing tag all is content; it follows as a tag of its own, and without it the page is over.
            if name in ("script", "style") or not close:
                at = page.find(">", close.end()) + 1 if close else 0
                out.append((begin, at or len(page), "", False, ""))
                if not at:
                    break
                continue
            at = close.start()
        out.append((begin, end, name, closing, attributes))
    return out


def _kind(name: str, attributes: str) -> int:
    """Whether an element is furniture: no, if its size allows it, the same as readers' comments, or in any case."""
    if name in _CUT:
        return _DROP
    if name in ("body", "html"):
        return _KEEP
    kind = _WEIGH if name == "form" else _KEEP
    if "=" not in attributes:
        return kind
    for key, value in _ATTRIBUTE.findall(attributes):
        value = value.strip("\"'").lower()
        if key.lower() == "role":
            if value in _ROLES and name not in ("article", "main"):
                return _DROP
            continue
        words = re.split(r"[\s_-]+", value)
        if not _COMMENTS.isdisjoint(words):
            kind = _READERS
        elif kind == _KEEP and name not in ("article", "main") and not _FURNITURE.isdisjoint(words):
            kind = _WEIGH
    return kind


@dataclass(slots=True)
class Element:
    """What may be furniture: the tags where it begins and ends, and the characters in it, all and those in links."""

    parent: int
    begin: int
    end: int
    kind: int
    in_article: bool
    size: int = 0
    linked: int = 0


def lines_of(page: str) -> list[tuple[str, int, bool]]:
    """(text, its characters outside links, inside an article element) of each line that is no furniture."""
    tags = tags_of(page)
    opened, end_of = defaultdict(list), {}
    for k, (_, _, name, closing, _) in enumerate(tags):
        if closing:
            if opened[name]:
                end_of[opened[name].pop()] = k
        elif name and name not in _VOID:
            opened[name].append(k)
    structure = [k for k, t in enumerate(tags) if not t[3] and t[2] in _STRUCTURE]
    blocks = [k for k, t in enumerate(tags) if t[2] and t[2] not in _INLINE]

    def after(places: list[int], k: int) -> int:
        """The first of ``places`` behind ``k``."""
        x = bisect_right(places, k)
        return places[x] if x < len(places) else len(tags)

    elements: list[Element] = []
    stack: list[int] = []
    lines: list[tuple[list[tuple[str, int, bool]], bool]] = []
    pieces: list[tuple[str, int, bool]] = []
    inside, link_end, total, head = 0, -1, 0, None

    def put(raw: str) -> None:
        nonlocal total
        if raw:
            linked = link_end >= 0
            pieces.append((raw, stack[-1] if stack else -1, linked))
            size = len(" ".join(raw.split()))
            total += size
            if stack:
                elements[stack[-1]].size += size
                elements[stack[-1]].linked += size * linked

    def end_line() -> None:
        nonlocal pieces
        if pieces:
            lines.append((pieces, inside > 0))
            pieces = []

    at, k = 0, 0
    while k < len(tags):
        begin, end, name, closing, attributes = tags[k]
        put(page[at:begin])
        at = end
        while stack and elements[stack[-1]].end <= k:
            stack.pop()
        if link_end <= k:
            link_end = -1
        if name:
            if name not in _INLINE:
                end_line()
            if closing:
                if name in ("article", "main"):
                    inside = max(0, inside - 1)
            elif name not in _VOID:
                kind = _kind(name, attributes)
                if kind:
                    last = after(blocks, k) if name == "p" else end_of.get(k)
                    shut = after(structure, k) if last is None else last
                    if kind == _DROP:
                        if last is None:  # what ends it is no part of it
                            at, k = (tags[shut][0] if shut < len(tags) else len(page)), shut
                        else:
                            at, k = (tags[shut][1], shut + 1) if shut < len(tags) else (len(page), shut)
                        continue
                    if stack:
                        shut = min(shut, elements[stack[-1]].end)
                    elements.append(Element(stack[-1] if stack else -1, k, shut, kind, inside > 0))
                    stack.append(len(elements) - 1)
                if name in _HEADS and head is None:
                    head = k
                if name in ("article", "main"):
                    inside += 1
                elif name == "a" and k in end_of and _HREF.search(attributes):
                    link_end = end_of[k]
        k += 1
    put(page[at:])
    end_line()

    for e in reversed(elements):
        if e.parent >= 0:
            elements[e.parent].size += e.size
            elements[e.parent].linked += e.linked
    gone: list[bool] = []
    for e in elements:
        readers = e.kind == _READERS
        holds = head is not None and e.begin <= head < e.end or head is None and (not readers or e.size > 0.9 * total) or e.in_article and not readers
        gone.append(e.parent >= 0 and gone[e.parent] or not (holds and 2 * e.size > total and 2 * e.linked <= e.size))
    out = []
    for some, marked in lines:
        kept = [(raw, linked) for raw, e, linked in some if e < 0 or not gone[e]]
        text = " ".join(html.unescape("".join(raw for raw, _ in kept)).split())
        if text:
            links = sum(len(" ".join(html.unescape(raw).split())) for raw, linked in kept if linked)
            out.append((text, max(0, len(text) - links) if any(not linked and not raw.isspace() for raw, linked in kept) else 0, marked))
    return out


def stretches(weights: list[int], surge: int) -> list[tuple[int, int]]:
    """(begin, end) of the lines between a surge of the window's sums and the dive behind it."""
    n = len(weights)
    before = [0, *accumulate(weights)]
    sums = [before[min(n, k + WINDOW)] - before[k] for k in range(n)]
    out, begin, high = [], None, []
    for k, total in enumerate([*sums, 0]):
        if total and begin is None:
            begin = k
            high.append(0)
        if begin is None:
            continue
        if total:
            high[-1] = max(high[-1], total)
            continue
        while not weights[begin]:
            begin += 1
        out.append((begin, k))
        begin = None
    least = surge if max(high, default=0) >= surge else 0
    return [x for x, peak in zip(out, high, strict=True) if peak >= least]


def main_text(page: str | None) -> str:
    lines = lines_of(page or "")
    marked = any(inside for _, _, inside in lines)
    weights = [weight if inside or not marked else 0 for _, weight, inside in lines]
    found = stretches(weights, 0 if marked else SURGE) or [(0, len(lines))]
    return " ".join(text for begin, end in found for text, _, inside in lines[begin:end] if inside or not marked)


def extract(df: DataFrame, page: str = "html") -> DataFrame:
    """``df`` without its markup column but with the ``text`` of each whole page and its length ``n_chars``."""
    kept = [x for x in df.columns if x not in (page, "text", "n_chars")]
    schema = df.select(kept).schema.add("text", "string").add("n_chars", "long")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                made = [main_text(x) for x in batch.column(page).to_pylist()]
                arrays = [pa.array(made, pa.string()), pa.array(map(len, made), pa.int64())]
                yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in kept), *arrays], [*kept, "text", "n_chars"])

    return df.mapInArrow(work, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


#: The same for pages like those of the test tables: one article element without furniture in it, and the references
#: that stand there. A tag that breaks the line becomes a blank.
ORACLE = r"""
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM (
  SELECT page_id, url, trim(regexp_replace(replace(replace(replace(body, '&quot;', '"'), '&amp;', '&'), '&amp', '&'), '\s+', ' ', 'g')) AS text FROM (
    SELECT page_id, url, regexp_replace(regexp_replace(coalesce(regexp_extract(html, '(?s)<article>(.*?)(</article>|$)', 1), ''), '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS body FROM pages))
"""
