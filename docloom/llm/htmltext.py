"""Main text of web pages by nearest-URL page differencing, with the page's own markup as a guard.

Pages are ordered by host and URL path; each is paired with the page of its host whose path shares the longest beginning. Copies of
a page say nothing about furniture, so the nearest pages before and after it that differ from it are its neighbours. All text lines
of both pages, menus, adverts and footers included, are aligned by longest common subsequence and the shared ones deleted.

Differencing alone cannot give right results: it keeps menus and adverts that differ from page to page, and would delete passages
that articles share. So markup guards both sides: lines in elements that are never main text go even where no neighbour shares
them, and lines inside an <article> or <main> stay even where one does. Each result row counts its lines by what decided on them.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_right
from collections import deque
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .fingerprints import _bounds, bucket_count

#: Share of a page's characters from which a page that shares them is a copy of it and says nothing about furniture.
COPY = 0.9
#: Runs of copies looked at before and after a page for one that differs.
LOOK = 8
#: Bits of the alignment table held at once; larger alignments are halved first.
TABLE = 1 << 26
#: What markup says of a line: nothing, inside the main element, inside an element that holds no main text.
OPEN, MAIN, GUARD = 0, 1, 2

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements without text lines: scripts, styles, forms, what is not shown.
NEVER = frozenset("script style noscript template textarea title head form button select option iframe object audio video canvas xmp noembed noframes datalist".split())
#: Elements whose lines are no main text.
FURNITURE = frozenset("nav footer aside menu dialog".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
#: An open element of the key is closed by a start tag of the value; the search stops at the third set.
CLOSES = {
    "p": BLOCKS - {"body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot", "thead"},
    "td": {"td", "th", "tr", "tbody", "tfoot", "thead"}, "th": {"td", "th", "tr", "tbody", "tfoot", "thead"}, "option": {"option", "optgroup"},
    "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}, "head": {"body"},
}
#: The same, by the tag that closes.
CLOSED_BY = {t: frozenset(k for k, v in CLOSES.items() if t in v) for t in frozenset().union(*CLOSES.values())}
SCOPE = frozenset("html body table td th ul ol dl div section article main aside nav header footer form blockquote figure details".split())
#: Words in class, id and role that mark what is not main text.
NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|adsense|adslot|sponsor(?:ed|s)?|promo(?:s|tion|ted)?|banners?|cookies?|cookie(?:bar|notice|consent|banner)|consent|gdpr|notices?|popup|overlay|modal|newsletter|subscri(?:be|ption)|signup|sidebar|sidenav|widgets?|related|recommend(?:ed|ations)?|sharing|share-?(?:bar|buttons?|links?|tools)|social|comments?|commentlist|disqus|menu|menubar|nav|navbar|navigation|topnav|breadcrumbs?|footer|site-?header|page-?header|masthead|topbar|toolbar|search-?(?:box|form|bar)|pagination|pager|skip-?link|contentinfo|complementary)(?:$|[\s_-])",
    re.I,
)
HEADER_WORD = re.compile(r"(?:^|\s)(?:header|banner)(?:$|\s)", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
MAIN_WORD = re.compile(r"(?:^|\s)(?:main|article-?body|articlebody|post-?content|entry-?content|article-?content|story-?body|main-?content|post-?body)(?:$|\s)", re.I)
TAG = re.compile(r"<!--|<[!?]|<(/?)([a-zA-Z][^\s/>]*)")
REST = re.compile(r"""((?:"[^"]*"|'[^']*'|[^'">])*+)>""")
ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile(r"\s+")
#: References that no character has; int() would refuse the longest ones.
HUGE = re.compile(r"&#(?:[0-9]{200,}|[xX][0-9a-fA-F]{200,});?")


class _Node:
    __slots__ = ("tag", "parent", "scope", "held", "never", "noise", "main", "state")

    def __init__(self, tag, parent, never=False, noise=False, main=0):
        self.tag, self.parent, self.never, self.noise, self.main, self.state = tag, parent, never, noise, main, None
        #: The element that bounds implied ends, and what it has open that a start tag may close.
        self.scope = self if parent is None or tag in SCOPE else parent.scope
        self.held: dict[str, int] = {}


def _unescape(s: str) -> str:
    return html.unescape(HUGE.sub("�", s)) if "&" in s else s


def _element(tag: str, attrs: str, parent: _Node) -> _Node:
    never, noise, main = tag in NEVER, tag in FURNITURE, 2 if tag == "article" else 1 if tag == "main" else 0
    if attrs and attrs != "/":
        a = {m[1].lower(): _unescape(m[2] or m[3] or m[4] or "") for m in ATTR.finditer(attrs)}
        if "hidden" in a or a.get("aria-hidden") == "true" or HIDDEN.search(a.get("style", "")):
            never = True
        words = f"{a.get('class', '')} {a.get('id', '')} {a.get('role', '')}"
        if tag not in ("html", "body"):
            noise = noise or bool(NOISE.search(words)) or (tag != "article" and bool(HEADER_WORD.search(words)))
        if not main and (a.get("role", "").lower() in ("main", "article") or MAIN_WORD.search(words) or a.get("itemprop", "").lower() == "articlebody"):
            main = 1
    return _Node(tag, parent, never, noise, 0 if noise or never else main)


def _state(node: _Node) -> tuple:
    """(never, noise, main, in a list item, in a header outside the main element) of an element with all around it."""
    path = []
    while node.state is None:
        path.append(node)
        node = node.parent
    for n in reversed(path):
        never, noise, main, item, header = n.parent.state
        main = max(main, n.main)
        n.state = (never or n.never, noise or n.noise, main, item or n.tag == "li", header or (n.tag == "header" and not main))
    return path[0].state if path else node.state


def _parse(page: str) -> tuple[list, list, list]:
    """Text blocks (element, text, only links), all elements, and main elements, in one pass over the tags."""
    root = _Node("", None)
    root.state = (False, False, 0, False, False)
    node = root
    found: list[tuple[_Node, str, bool]] = []
    part: list[str] = []
    mains, nodes = [], []
    linked = plain = links = 0
    open_: dict[str, int] = {}
    no_close: set[str] = set()
    quotes = True  # until a quote that nothing closes

    def flush():
        nonlocal part, linked, plain
        if part:
            text = SPACE.sub(" ", _unescape("".join(part))).strip()
            if text:
                found.append((node, text, linked > 4 * plain))
            part = []
        linked = plain = 0

    def leave(upto: _Node):
        """Close all elements below `upto` and it."""
        nonlocal node, links
        while True:
            gone, node = node, node.parent
            open_[gone.tag] -= 1
            if gone.tag in CLOSES:
                node.scope.held[gone.tag] -= 1
            if gone.tag == "a":
                links = max(0, links - 1)
            if gone is upto:
                return

    at, size = 0, len(page)
    while at < size:
        m = TAG.search(page, at)
        end = m.start() if m else size
        if end > at:
            piece = page[at:end]
            part.append(piece)
            n = len(piece) - piece.count(" ")
            if links:
                linked += n
            else:
                plain += n
        if not m:
            break
        at = m.end()
        if m[2] is None:
            stop = "-->" if m[0] == "<!--" else ">"
            close = page.find(stop, at)
            at = close + len(stop) if close >= 0 else size
            continue
        rest = REST.match(page, at) if quotes else None
        if rest:
            attrs, at = rest[1].strip(), rest.end()
        else:
            quotes = False
            close = page.find(">", at)
            if close < 0:  # no tag ends from here on
                part.append(page[m.start() :])
                plain += 1
                break
            attrs, at = page[at:close].strip(), close + 1
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                part.append(" ")
            elif open_.get(tag):
                up = node
                while up.tag != tag:
                    up = up.parent
                if tag in BLOCKS or up.never or up.noise or up.main:
                    flush()
                leave(up)
            elif tag == "p":
                flush()
            continue
        if tag in BLOCKS or tag in NEVER:
            flush()
        if tag in ("br", "td", "th", "img", "input"):
            part.append(" ")
        ends = CLOSED_BY.get(tag, ())
        while any(node.scope.held.get(t) for t in ends):
            up = node
            while up.tag not in ends:
                up = up.parent
            flush()
            leave(up)
        if tag in VOID:
            continue
        fresh = _element(tag, attrs, node)
        if fresh.never or fresh.noise or fresh.main:
            flush()
        if tag in RAW:
            close = None if tag in no_close else re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            if not close:
                no_close.add(tag)
                if tag in ("title", "textarea"):
                    continue
                break
            gt = page.find(">", close.start())
            at = gt + 1 if gt >= 0 else size
            continue
        if tag == "a":
            links += 1
        if fresh.main:
            mains.append(fresh)
        nodes.append(fresh)
        open_[tag] = open_.get(tag, 0) + 1
        if tag in CLOSES:
            node.scope.held[tag] = node.scope.held.get(tag, 0) + 1
        node = fresh
    flush()
    return found, nodes, mains


def blocks(page: str | None) -> list[tuple[str, int]]:
    """(text, OPEN, MAIN or GUARD) per text line of a page in its order, scripts, forms and what is hidden left out.

    If the page has a main element, its lines are MAIN and all others GUARD; of articles in a <main>, the articles count. A form or
    an element with a furniture word around the only main element does not hide it. Time and memory follow the page's length.
    """
    found, nodes, mains = _parse(page or "")

    def judged():
        return [(*_state(n)[:3], _state(n)[3] and only_links, _state(n)[4], text) for n, text, only_links in found]

    lines = judged()
    if mains and not any(main and not never and not noise for never, noise, main, *_ in lines):
        seen = set()
        for n in mains:  # what holds the main text is no furniture
            up = n.parent
            while up.parent is not None and id(up) not in seen:
                seen.add(id(up))
                up.noise = False
                up.never = up.never and up.tag != "form"
                up = up.parent
        for n in nodes:
            n.state = None
        lines = judged()
    top = max((main for never, noise, main, *_ in lines if not never and not noise), default=0)
    return [(text, GUARD if noise or main < top or (not top and (menu or header)) else MAIN if top else OPEN) for never, noise, main, menu, header,
            text in lines if not never]


def _vector(x: list, y: list) -> np.ndarray:
    """Lengths of longest common subsequences of x with each beginning of y."""
    masks: dict = {}
    for j, line in enumerate(y):
        masks[line] = masks.get(line, 0) | 1 << j
    full = (1 << len(y)) - 1
    v = full
    for line in x:
        u = v & masks.get(line, 0)
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(y) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(y)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _aligned(x: list, y: list, low: int, out: set[int]) -> None:
    """Put the positions in x, from low on, of one longest common subsequence of x and y into out."""
    if not x or not y:
        return
    if len(x) * len(y) > TABLE and len(x) > 1:
        mid = len(x) // 2
        j = int((_vector(x[:mid], y) + _vector(x[:mid - 1 : -1], y[::-1])[::-1]).argmax())
        _aligned(x[:mid], y[:j], low, out)
        _aligned(x[mid:], y[j:], low + mid, out)
        return
    masks: dict = {}
    for j, line in enumerate(y):
        masks[line] = masks.get(line, 0) | 1 << j
    full = (1 << len(y)) - 1
    v, history = full, []
    for line in x:
        u = v & masks.get(line, 0)
        v = ((v + u) | (v - u)) & full
        history.append(v)
    j = len(y) - 1
    for i in range(len(x) - 1, -1, -1):  # a zero bit of row i marks a place where the length grows
        while j >= 0 and history[i] >> j & 1:
            j -= 1
        if j < 0:
            break
        if i and not history[i - 1] >> j & 1:
            continue
        out.add(low + i)
        j -= 1


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Positions in a of one longest common subsequence of a and b, by bit-parallel dynamic programming in bounded memory."""
    low = 0
    while low < len(a) and low < len(b) and a[low] == b[low]:
        low += 1
    ea, eb = len(a), len(b)
    while ea > low and eb > low and a[ea - 1] == b[eb - 1]:
        ea, eb = ea - 1, eb - 1
    both = set(a[low:ea]) & set(b[low:eb])
    at = [i for i in range(low, ea) if a[i] in both]
    inner: set[int] = set()
    _aligned([a[i] for i in at], [x for x in b[low:eb] if x in both], 0, inner)
    return {*range(low), *range(ea, len(a)), *(at[i] for i in inner)}


def shared_blocks(own: list, other: list) -> set[int] | None:
    """Positions in own of the lines that the other page shares; None if they hold COPY or more of own's characters: a copy of it."""
    if own == other:
        return None
    shared = common_lines([t for t, _ in own], [t for t, _ in other])
    return None if sum(len(own[i][0]) for i in shared) >= COPY * sum(len(t) for t, _ in own) else shared


def difference(own: list, shared: set[int] | frozenset = frozenset()) -> str:
    """Own lines without shared ones, those of the main element excepted, and without guarded ones; joined by a blank line."""
    return "\n\n".join(t for i, (t, kind) in enumerate(own) if kind == MAIN or (kind == OPEN and i not in shared))


def place(url: str | None) -> tuple[str, str]:
    """Host and path with query of a URL; empty strings where there are none."""
    try:
        s = urlsplit((url or "").strip())
        return (s.hostname or "").lower(), s.path + ("?" + s.query if s.query else "")
    except ValueError:
        return "", url or ""


def _shared_path(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars per row of pages (page_id, url, html), then n_lines (text lines of the page), n_shared (deleted
    by differencing), n_guarded (not shared; deleted by markup) and n_spared (shared, but inside the main element).

    Null html counts as empty; null urls form a host of their own. A page alone on its host is compared with none, and where only
    copies are found no line is deleted for being shared. Pages equal in host and path follow each other by page_id, then by a hash
    of the page; repeated rows give their text each. Of neighbours whose paths share as much, the one before counts. Other columns
    are ignored. Pages are parsed once; their lines, compressed, are shuffled once into buckets of neighbouring URLs, the pages at
    a bucket's ends into the buckets beside it too. A task holds the compressed lines of a run of copies in one bucket at most.
    """
    spark = pages.sparkSession
    common.bounded_batches(spark, 1000)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    tie = F.xxhash64("html").alias("tie")
    tasks, buckets = bucket_count(spark, pages.count())

    def key(page_id, url, tie) -> str:
        host, path = place(url)
        return f"{host}\0{path}\0{(page_id if page_id is not None else -1) + (1 << 63):020d}\0{tie + (1 << 63):020d}"

    def keys(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([key(*x) for x in zip(*(c.to_pylist() for c in b.columns))], pa.string())], ["k"])

    bounds = _bounds(rows.select("page_id", "url", tie).mapInArrow(keys, "k string"), ["k"], buckets)

    def ends(batches):
        for b in batches:
            held: dict[int, list[str]] = {}
            for x in zip(*(c.to_pylist() for c in b.columns)):
                k = key(*x)
                low_high = held.setdefault(bisect_right(bounds, (k,)), [k, k])
                low_high[0], low_high[1] = min(low_high[0], k), max(low_high[1], k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.int32()), pa.array([v[0] for v in held.values()], pa.string()),
                        pa.array([v[1] for v in held.values()], pa.string())], ["bucket", "low", "high"]
            )

    found = rows.select("page_id", "url", tie).mapInArrow(ends, "bucket int, low string, high string").groupBy("bucket").agg(F.min("low"), F.max("high"))
    limits = sorted(tuple(r) for r in found.collect())  # a row per bucket
    visit: dict[str, list[int]] = {}
    for (b0, _, high), (b1, low, _) in zip(limits, limits[1:]):
        visit.setdefault(high, []).append(b1)
        visit.setdefault(low, []).append(b0)

    def deal(batches):
        pack = zstandard.ZstdCompressor(level=3)
        types = (pa.int32(), pa.bool_(), pa.string(), pa.int64(), pa.string(), pa.binary())
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for page_id, url, page, tie in zip(*(c.to_pylist() for c in b.columns)):
                k = key(page_id, url, tie)
                z = pack.compress(json.dumps(blocks(page)).encode())
                for bucket, own in ((bisect_right(bounds, (k,)), True), *((x, False) for x in visit.get(k, ()))):
                    for column, v in zip(out, (bucket, own, k, page_id, url, z)):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["bucket", "own", "k", "page_id", "url", "z"])

    def compare(batches):
        unpack = zstandard.ZstdDecompressor()

        def lines(z: bytes) -> list:
            return json.loads(unpack.decompress(z))

        def stream():
            for b in batches:
                for bucket, own, page_id, url, z in zip(*(b.column(c).to_pylist() for c in ("bucket", "own", "page_id", "url", "z"))):
                    yield bucket, own, page_id, url, *place(url), z
            yield None

        def row(page, own: list, shared) -> tuple:
            deleted = sum(kind != MAIN for _, kind in (own[i] for i in shared))
            guarded = sum(kind == GUARD and i not in shared for i, (_, kind) in enumerate(own))
            return page[2], page[3], difference(own, shared), len(own), deleted, guarded, len(shared) - deleted

        def results():
            place_, runs, waiting = None, deque(maxlen=LOOK + 1), []  # runs: the last page of each run of copies
            for now in stream():
                here = now and (now[0], now[4])
                if here != place_:
                    for page, shared, _, _ in waiting:
                        yield row(page, lines(page[6]), shared)
                    place_, waiting = here, []
                    runs.clear()
                if now is None:
                    break
                path, own = now[5], lines(now[6])
                copy = bool(runs) and shared_blocks(own, runs[-1][1]) is None
                if not copy:  # the page ends the wait of those before it that it differs from
                    left = []
                    for page, shared, n, tries in waiting:
                        theirs = lines(page[6])
                        if (s := shared_blocks(theirs, own)) is not None:
                            yield row(page, theirs, s if _shared_path(path, page[5]) > n else shared)
                        elif tries + 1 < LOOK:
                            left.append((page, shared, n, tries + 1))
                        else:
                            yield row(page, theirs, shared)
                    waiting = left
                if now[1]:
                    shared, n = frozenset(), -1
                    for other_path, other in reversed(runs):
                        if (s := shared_blocks(own, other)) is not None:
                            shared, n = s, _shared_path(other_path, path)
                            break
                    waiting.append((now, shared, n, 0))
                if copy:
                    runs.pop()
                runs.append((path, own))

        held: list[tuple] = []
        size = 0
        for r in results():
            held.append(r)
            size += len(r[2])
            if len(held) >= 1000 or size > 16 << 20:
                yield _batch(held)
                held, size = [], 0
        yield _batch(held)

    dealt = rows.withColumn("tie", tie).mapInArrow(deal, "bucket int, own boolean, k string, page_id long, url string, z binary")
    ordered = dealt.repartitionById(tasks, F.pmod("bucket", F.lit(tasks))).sortWithinPartitions("bucket", "k")
    return ordered.mapInArrow(compare, "page_id long, url string, text string, n_chars long, n_lines long, n_shared long, n_guarded long, n_spared long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    ids, urls, texts, *counts = zip(*rows) if rows else ((),) * 7
    columns = [pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
    return pa.RecordBatch.from_arrays([*columns, *(pa.array(c, pa.int64()) for c in counts)],
            ["page_id", "url", "text", "n_chars", "n_lines", "n_shared", "n_guarded", "n_spared"])
