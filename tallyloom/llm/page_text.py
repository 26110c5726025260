"""Main text of pages by differencing pages with near URLs (operator 12).

Pages are sorted by host and path. Each is compared with the pages next to it on its host:
their text lines (one per block of markup) are aligned by longest common subsequence, and
lines shared with at least half of these neighbours go as the site's, not the page's. What
markup says is checked after that: lines of menus, footers, forms, adverts, notices and
comments go as well, and paragraphs inside an article's own element stay, as an article
may quote another page, or be a copy of it.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from math import isqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.markup import attributes, tokens
from tallyloom.llm.url_filters import host_of, path_of

#: Pages compared on either side of a page. Cuts of the sorted pages are taken from a sample of keys: EVERY-th of at most KEYS.
NEAR, EVERY, KEYS, LEAST_BLOCK = 2, 4, 65_536, 64
#: What an element's lines are: nobody's (scripts), the site's, the page's, those of a main element, those of an article.
SITE, PAGE, MAIN, ARTICLE = range(4)
PARSED = "block int, halo boolean, host string, path string, key_id long, page_id long, url string, lines array<struct<text:string,zone:tinyint,prose:boolean,linked:boolean>>"

#: Names of markup.
_BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frame "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre search section "
    "select summary table tbody td tfoot th thead title tr ul video audio canvas".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NEVER = frozenset("script style template head title iframe noembed noframes object svg math canvas audio video textarea select".split())
_OF_SITE = frozenset("nav footer aside form button dialog menu search noscript".split())
_INLINE = frozenset("a abbr b cite code em i mark q s small strong sub sup time u".split())
#: Elements nested deeper belong to their parent.
_DEEPEST = 512
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre td th caption figcaption".split())
#: Elements that another of the same kind, or a block, closes where their own closing tag is missing.
_CLOSED_BY = {"p": _BLOCKS - {"br"}, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option", "optgroup"])}
#: Words that sites use in classes and ids for what is not the article, and for what is.
_SITE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "popup modal overlay newsletter subscribe subscription signup nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside "
    "widget widgets footer foot masthead topbar comment comments commentlist disqus replies respond share sharing social related recommended "
    "recommendations trending toolbar pagination pager login search copyright legal disclaimer skip header".split()
)
_MAIN_WORDS = frozenset("article articlebody content main story entry post".split())
_SITE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar note".split())
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _named(given: dict[str, str]) -> list[str]:
    """Words of class and id; those after has, no or with say what is elsewhere."""
    words = [w.lower() for w in _WORD.findall(f"{given.get('class', '')} {given.get('id', '')}")]
    return [w for before, w in zip(["", *words], words) if before not in ("has", "no", "with", "without")]


def _zone(name: str, written: str, inside: int) -> int:
    """The zone of an element inside another zone; the site's stays the site's."""
    if inside == SITE or name in _OF_SITE:
        return SITE
    given = attributes(written) if written.strip(" /") else {}
    if "hidden" in given or given.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(given.get("style", "")):
        return SITE
    role, words = given.get("role", "").lower(), () if name in ("html", "body") or name in _INLINE else _named(given)
    if role in _SITE_ROLES:
        return SITE
    if name == "article" or role == "article" or given.get("itemprop", "").lower() == "articlebody":
        return SITE if {"comment", "comments", "reply", "related", "teaser", "promo"} & set(words) else ARTICLE
    if name == "main" or role == "main":
        return max(inside, MAIN)
    if inside == ARTICLE and name == "header" or name[0] == "h" and name[1:].isdigit():
        return inside  # an article's heading
    if name == "header":
        return SITE
    if _SITE_WORDS & set(words):
        return inside if "header" in words and _MAIN_WORDS & set(words) else SITE
    return max(inside, MAIN) if _MAIN_WORDS & set(words) else inside


def text_lines(html: str | None) -> list[tuple[str, int, bool, bool]]:
    """The page's blocks of text as (text, zone, in a paragraph or the like, only links), white space collapsed and trimmed.

    Tags that are not closed end with their parent. White space is what HTML calls so, and the no-break space. What scripts, styles and the like hold is no text.
    """
    out, stack, parts = [], [("", PAGE, False)], []  # open elements: name, zone, prose
    silent = links = loose = 0

    def flush():
        nonlocal loose
        text = " ".join("".join(parts).split())
        if text:
            out.append((text, stack[-1][1], stack[-1][2], not loose))
        parts.clear()
        loose = 0

    def leave(depth: int):
        nonlocal silent, links
        for name, _, _ in stack[depth:]:
            silent -= name in _NEVER
            links -= name == "a"
        if any(name in _BLOCKS for name, _, _ in stack[depth:]):
            flush()
        del stack[depth:]

    for kind, value, written in tokens(html or ""):
        if kind == "text":
            if not silent:
                parts.append(value)
                loose += not links and not value.isspace()
        elif kind == "open":
            for depth in range(len(stack) - 1, 0, -1):
                name = stack[depth][0]
                if value in _CLOSED_BY.get(name, ()):
                    leave(depth)
                    break
                if name in _BLOCKS or name in _CLOSED_BY:
                    break
            if value in _BLOCKS:
                flush()
            if value not in _VOID and (len(stack) < _DEEPEST or value in _NEVER) and not (value in ("svg", "math") and written.endswith("/")):
                zone = _zone(value, written, stack[-1][1])
                if zone != stack[-1][1]:
                    flush()
                stack.append((value, zone, value in _PROSE or stack[-1][2]))
                silent += value in _NEVER
                links += value == "a"
        else:
            if value in _BLOCKS:
                flush()
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == value:
                    leave(depth)
                    break
    flush()
    return out


def common_lines(a: list, b: list) -> list[tuple[int, int]]:
    """One longest common subsequence of two lists of hashables, as pairs of places.

    Rows of the table are integers of a bit per line of b, a 0 where the length grows. Lines of one list alone are left
    out first; of many rows every isqrt-th is kept and the others are made again, so that memory stays small.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    both = set(a[head : len(a) - tail]) & set(b[head : len(b) - tail])
    left = [i for i in range(head, len(a) - tail) if a[i] in both]
    right = [j for j in range(head, len(b) - tail) if b[j] in both]
    at: dict = {}
    for j, place in enumerate(right):
        at[b[place]] = at.get(b[place], 0) | 1 << j
    full = (1 << len(right)) - 1
    grow = lambda row, i: ((row + (row & at[a[left[i]]])) | (row & ~at[a[left[i]]])) & full
    step = max(1, isqrt(len(left)))
    kept, row = [full], full
    for i in range(len(left)):
        row = grow(row, i)
        if (i + 1) % step == 0:
            kept.append(row)
    pairs, j = [], len(right)
    for block in range(len(left) // step, -1, -1):
        rows = [kept[block]]
        for i in range(block * step, min((block + 1) * step, len(left))):
            rows.append(grow(rows[-1], i))
        i = len(rows) - 1
        while i and j:
            if rows[i] >> (j - 1) & 1:
                j -= 1
            elif not rows[i - 1] >> (j - 1) & 1:
                i -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((left[block * step + i], right[j]))
    return [(k, k) for k in range(head)] + pairs[::-1] + [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]


def main_text(lines: list[tuple[str, int, bool, bool]], shared: list[int], neighbours: int) -> str:
    """The page's own lines, joined by spaces; shared: with how many of the neighbours each line is shared."""
    zone = max((z for _, z, _, _ in lines), default=PAGE)
    own = []
    for k, (text, at, prose, linked) in enumerate(lines):
        of_site = neighbours > 0 and 2 * shared[k] >= neighbours
        menu = zone < ARTICLE and linked and any(0 <= j < len(lines) and lines[j][3] for j in (k - 1, k + 1))
        if at == zone and zone > SITE and (at == ARTICLE and prose or not of_site and not menu):
            own.append(text)
    return " ".join(own)


def _parsed(cuts: list[tuple[str, str, int]], edges: dict):
    def of_batches(batches) -> Iterator:
        import pyarrow as pa

        line = pa.struct([("text", pa.string()), ("zone", pa.int8()), ("prose", pa.bool_()), ("linked", pa.bool_())])
        names = ["block", "halo", "host", "path", "key_id", "page_id", "url", "lines"]
        types = [pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(line)]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            rows, size = [], 0
            for page_id, url, host, path, key_id, html in zip(*(batch.column(c) for c in ("page_id", "url", "host", "path", "key_id", "html"))):
                key = (host.as_py(), path.as_py(), key_id.as_py())
                lines = [dict(zip(("text", "zone", "prose", "linked"), l)) for l in text_lines(html.as_py())]
                for block, halo in ((bisect_right(cuts, key), False), *((b, True) for b in edges.get(key, ()))):
                    rows.append((block, halo, *key, page_id.as_py(), url.as_py(), lines))
                size += sum(len(l["text"]) for l in lines)
                if size > 4_000_000:
                    yield batch_of(rows)
                    rows, size = [], 0
            if rows:
                yield batch_of(rows)

    return of_batches


class _Page:
    def __init__(self, block, halo, host, path, page_id, url, lines):
        self.block, self.halo, self.host, self.page_id, self.url = block, halo, host, page_id, url
        self.lines = [(l["text"], l["zone"], l["prose"], l["linked"]) for l in lines]
        self.texts = [l[0] for l in self.lines]
        self.shared, self.neighbours = [0] * len(lines), 0

    def meet(self, other) -> None:
        """Compare two pages of a host; pages of the same lines tell nothing about each other."""
        if self.host and (self.block, self.host) == (other.block, other.host) and self.texts != other.texts:
            for i, j in common_lines(self.texts, other.texts):
                self.shared[i] += 1
                other.shared[j] += 1
            self.neighbours += 1
            other.neighbours += 1


def _compared(batches) -> Iterator:
    import pyarrow as pa

    def batch_of(rows):
        kinds = (pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["page_id", "url", "text"])

    def done():
        last: deque[_Page] = deque()
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("block", "halo", "host", "path", "page_id", "url", "lines"))):
                page = _Page(*(v.as_py() for v in row))
                for other in last:
                    page.meet(other)
                last.append(page)
                if len(last) > NEAR:
                    yield last.popleft()
        yield from last

    rows, size = [], 0
    for page in done():
        if not page.halo:
            rows.append((page.page_id, page.url, main_text(page.lines, page.shared, page.neighbours)))
            size += len(rows[-1][2])
            if size > 4_000_000:
                yield batch_of(rows)
                rows, size = [], 0
    if rows:
        yield batch_of(rows)


def _with_block(cuts: list):
    def of_batches(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("host", "path", "key_id")))
            yield batch.append_column("block", pa.array([bisect_right(cuts, key) for key in keys], pa.int32()))

    return of_batches


def _blocks(keys: DataFrame) -> tuple[list, dict]:
    """Cuts of the sorted keys into blocks, and the keys next to a cut with the blocks that need them too.

    Cuts are every EVERY-th of a sample that a checksum picks, at most about KEYS, so they do not depend on how rows
    are dealt, and every block but the last has EVERY keys at least. Both are bounded, whatever the number of pages.
    """
    keys = keys.distinct()
    rate = max(LEAST_BLOCK // EVERY, -(-keys.count() // KEYS))
    sample = keys.where(F.pmod(F.xxhash64("host", "path", "key_id"), F.lit(rate)) == 0).collect()
    cuts = sorted(tuple(r) for r in sample)[EVERY::EVERY]
    edges: dict = {}
    if cuts:
        blocks = keys.mapInArrow(_with_block(cuts), "host string, path string, key_id long, block int")
        for order, step in ((F.asc, -1), (F.desc, 1)):
            within = Window.partitionBy("block").orderBy(*(order(c) for c in ("host", "path", "key_id")))
            for block, *key in blocks.withColumn("n", F.row_number().over(within)).where(F.col("n") <= NEAR).select("block", "host", "path", "key_id").collect():
                edges.setdefault(tuple(key), []).append(block + step)
    return cuts, edges


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) for every page: its main text, blocks joined by single spaces, '' where there is none.

    A page's neighbours are the NEAR pages before and after it on its host, by path and then id; pages with the very
    same lines do not count, nor do pages of an empty host. Without neighbours only markup decides. Where markup names
    no article or main element, lines of links only that stand together go as menus.

    Null and empty pages give ''. A page is parsed whole. Rows with one id and url, or with none, are pages of their
    own, further columns are not read, and a table without rows gives none. Pages are cut by key order into blocks
    with a few pages of the next ones added, so that a host of any size is spread over tasks and every page has the
    neighbours it would have in one sorted list. A task holds NEAR + 1 pages at a time.
    """
    rows = pages.select(
        pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), host_of(pages[url_col]).alias("host"),
        path_of(pages[url_col]).alias("path"), F.coalesce(pages[id_col].cast("long"), F.lit(-1)).alias("key_id"), pages[html_col].cast("string").alias("html"),
    )
    cuts, edges = _blocks(rows.select("host", "path", "key_id"))
    parsed = rows.mapInArrow(_parsed(cuts, edges), PARSED)
    order = ("block", "host", "path", "key_id", "page_id", "url", "lines")
    return parsed.repartition("block").sortWithinPartitions(*order).mapInArrow(_compared, "page_id long, url string, text string")


def page_texts(pages: DataFrame) -> DataFrame:
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))
