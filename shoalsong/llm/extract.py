"""Main text of web pages by page structure and a suffix array per host.

A page becomes blocks of text, each in a zone: CHROME (menus, headers, footers,
asides, forms, adverts, notices, comments, by tag, role and class names), MAIN
(the article) or OPEN (pages that mark no article). Markup, scripts, styles and
hidden parts are no text.

The blocks of all pages of a host are one stream of words with a mark between
pages. A suffix array of it, sorted to RUN words deep by prefix doubling, brings
equal runs together; runs on PAGES or more distinct pages of the host are
boilerplate, also where the host is so large that it has several arrays. It is
cut from open blocks, where the unique runs stay, whatever their share. The words
of a marked article stay even where other pages, or their footers and adverts,
repeat them: sentences that many articles share are no boilerplate.

Pages with the same set of words count as one, so a page that was merely copied
keeps its text.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalsong.llm import words
from shoalsong.llm.tables import not_null_key, staged

RUN, PAGES = 8, 3
#: Share of a block's characters from which it is a link.
LINKED = 0.8
#: Characters of html in one suffix array; larger hosts have several, with pages dealt by digest.
ARRAY_CHARS = 8 << 20

CHROME, MAIN, OPEN = 0, 1, 2

RAW = frozenset("script style noscript template iframe object svg math canvas audio video select datalist textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
CHROME_TAGS = frozenset("nav footer aside form button menu dialog head".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar "
                         "toolbar form".split())
CHROME_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar footer cookie cookies consent gdpr notice notification alert popup modal overlay "
    "newsletter subscribe subscription signup login search share sharing social related recommended comment comments "
    "commentlist disqus reply replies respond pagination pager toolbar widget copyright disclaimer masthead skip".split())
#: What may follow one of those names, joined by hyphens, in the name of a part of a page.
CHROME_PARTS = frozenset(
    "area badge banner bar bars block body bottom box button buttons container content form header heading icon icons inner "
    "item items left link links list main message overlay panel post posts right row section slot text title top unit wrap "
    "wrapper".split())
#: Tags that may stand in the head of a page; any other ends an open one.
HEAD_TAGS = frozenset("html head base link meta title".split())
#: An opening tag ends an open element of these kinds.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(text)} if text.strip(" /") else {}


def _is_chrome(tag: str, at: dict[str, str], in_article: bool) -> bool:
    if tag in CHROME_TAGS or tag == "header" and not in_article:
        return True
    if not at or tag in ("html", "body", "article", "main") and "hidden" not in at:
        return bool(at) and tag == "article" and _named(at) and bool(_names(at) & {"comment", "comments", "reply"})
    if at.get("role", "").lower() in CHROME_ROLES or "hidden" in at or at.get("aria-hidden", "").lower() == "true":
        return True
    if "display:none" in at.get("style", "").replace(" ", "").lower():
        return True
    names = _names(at)
    return bool(names & CHROME_NAMES) or "header" in names and not in_article


def _named(at: dict[str, str]) -> bool:
    return "class" in at or "id" in at


def _names(at: dict[str, str]) -> set[str]:
    """Class names and the id. Of a joined name (site-footer, nav-bar) the last part counts, and the first
    if all that follow are parts of pages: search-engine-history names no search box."""
    names = set()
    for name in f"{at.get('class', '')} {at.get('id', '')}".lower().split():
        parts = [p for p in re.split("[_-]+", name) if p]
        names.update(parts[-1:])
        if all(p in CHROME_PARTS or p in CHROME_NAMES or p.isdigit() for p in parts[1:]):
            names.update(parts[:1])
    return names


def blocks(page: str) -> list[tuple[int, str, float]]:
    """(zone, text, share of linked characters) of the blocks of a page with text, in order.

    Where all articles stand inside chrome, such as a menu whose end is missing, only chrome inside
    of them counts.
    """
    out: list[list] = []
    stack: list[tuple[str, bool, bool, bool, bool]] = []  # tag, chrome, article, main, chrome inside of these; inherited
    text: list[str] = []
    linked = 0
    at = 0

    def state() -> tuple[str, bool, bool, bool, bool]:
        return stack[-1] if stack else ("", False, False, False, False)

    def flush() -> None:
        nonlocal linked
        plain = " ".join(html.unescape("".join(text)).split())
        if plain:
            _, chrome, article, main, inner = state()
            out.append([chrome, article, main, plain, min(1.0, linked / len(plain)), inner])
        text.clear()
        linked = 0

    def pop(kinds, until=()) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in kinds:
                del stack[i:]
                return
            if stack[i][0] in until:
                return

    while at < len(page):
        found = TOKEN.search(page, at)
        piece = page[at : found.start() if found else len(page)]
        if piece:
            if stack and stack[-1][0] == "head" and piece.strip():
                pop({"head"})
            text.append(piece)
            if any(x[0] == "a" for x in stack[-4:]):
                linked += len(piece)
        if not found:
            break
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if tag in RAW:
            if not found[1] and not found[3].endswith("/"):
                end = re.compile(f"</{re.escape(tag)}", re.I).search(page, at)
                at = page.find(">", end.end()) + 1 or len(page) if end else len(page)
            continue
        if tag == "br" or tag == "wbr":
            text.append(" " if tag == "br" else "")
            continue
        if tag not in INLINE:
            flush()
        if found[1]:
            pop({tag})
            continue
        if tag in VOID:
            continue
        if tag not in HEAD_TAGS:
            pop({"head"})
        if tag not in INLINE:
            pop({"p"}, {"article", "main", "div", "section", "td", "th", "li", "body", "blockquote"})
        if tag in CLOSES:
            pop(CLOSES[tag], {"ul", "ol", "table", "dl", "select", "menu"})
        if tag in ("article", "main"):
            pop({"nav", "header"})
        attributes = _attributes(found[3])
        _, chrome, article, main, inner = state()
        is_chrome = _is_chrome(tag, attributes, article or main)
        chrome, inner = chrome or is_chrome, inner or is_chrome and (article or main or tag in ("article", "main"))
        article = article or tag == "article" or attributes.get("itemprop", "").lower() == "articlebody"
        main = main or tag == "main" or attributes.get("role", "").lower() == "main"
        if not found[3].endswith("/") or tag not in INLINE:
            stack.append((tag, chrome, article, main, inner))
    flush()
    if not any(b[3] and not b[0] and (b[1] or b[2]) for b in out) and any((b[1] or b[2]) and not b[5] for b in out):
        for b in out:
            b[0] = b[5] if b[1] or b[2] else b[0]
    in_article = sum(len(b[3]) for b in out if b[1] and not b[0])
    in_main = sum(len(b[3]) for b in out if b[2] and not b[0])
    article_is_main = in_article and in_article >= 0.3 * in_main

    def zone(chrome, article, main) -> int:
        if chrome:
            return CHROME
        if not in_article and not in_main:
            return OPEN
        return MAIN if (article if article_is_main else main) else CHROME

    return [(zone(b[0], b[1], b[2]), b[3], b[4]) for b in out]


def repeated(tokens: np.ndarray, page: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of a token stream, `run` tokens deep: (order, rank). Suffixes of equal rank
    begin with the same `run` tokens; a run that meets the end of its page equals no other."""
    n = len(tokens)
    ends = np.r_[np.flatnonzero(np.diff(page)), n - 1] if n else np.empty(0, np.int64)
    _, rank = np.unique(tokens, return_inverse=True)
    depth = 1
    while depth < run:
        step = min(depth, run - depth)
        # Past the end of the stream or page every suffix has a key of its own.
        after = np.arange(n) + step
        last = ends[np.searchsorted(ends, np.arange(n))] if n else ends
        outside = after > last
        second = np.where(outside, n + np.arange(n), rank[np.minimum(after, max(n - 1, 0))])
        _, rank = np.unique(rank.astype(np.int64) * (2 * n) + second, return_inverse=True)
        depth += step
    return np.argsort(rank, kind="stable"), rank


def _groups(tokens, page, copy, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes in order, the group of equal runs each is in, and the distinct (group, copy) pairs by group."""
    order, rank = repeated(tokens, page, run)
    first = np.r_[0, np.flatnonzero(np.diff(rank[order])) + 1]
    groups = np.arange(len(first)).repeat(np.diff(np.r_[first, len(tokens)]))
    many = int(copy.max()) + 1
    pairs = np.unique(groups * many + copy[order])
    return order, groups, pairs // many, pairs % many


def _covered(at: np.ndarray, n: int, run: int) -> np.ndarray:
    """Per token of n whether a run that begins at one of the places covers it."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, at, 1)
    np.add.at(marks, np.minimum(at + run, n), -1)
    return np.cumsum(marks)[:n] > 0


def boilerplate(tokens, page, copy, run: int = RUN, pages: int = PAGES) -> np.ndarray:
    """Per token whether a run repeated on enough distinct pages covers it. `copy` numbers pages by
    content: equal pages count once."""
    n = len(tokens)
    if n < run:
        return np.zeros(n, bool)
    order, groups, pair_group, _ = _groups(tokens, page, copy, run)
    on_pages = np.bincount(pair_group, minlength=groups[-1] + 1)
    return _covered(order[(on_pages >= pages)[groups]], n, run)


class Stream:
    """The words of all pages of an array, hashed, with the block and page of each."""

    def __init__(self, pages: list[list[tuple[int, str, float]]]) -> None:
        self.pages = pages
        self.flat = [b for page in pages for b in page]
        owner = np.repeat(np.arange(len(pages)), [len(p) for p in pages])
        hasher, hashes, block = words.Hasher(), [], []
        for rows, starts, ends, data in words.pieces(pa.array([b[1] for b in self.flat], pa.string())):
            hashes.append(hasher(starts, ends, data))
            block.append(rows)
        self.tokens = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        self.block = np.concatenate(block) if block else np.empty(0, np.int64)
        self.page = owner[self.block]
        self.is_open = np.array([b[0] == OPEN for b in self.flat], bool)
        # Pages by their sets of words, the same in all arrays.
        self.keys = np.zeros(len(pages), np.int64)
        edges = np.searchsorted(self.page, np.arange(len(pages) + 1))
        for i, (begin, end) in enumerate(zip(edges[:-1], edges[1:])):
            self.keys[i] = words.mixed(np.unique(self.tokens[begin:end]).sum(dtype=np.uint64, keepdims=True)).view(np.int64)[0]

    def copies(self) -> np.ndarray:
        """The number of its page's content, per word."""
        return np.unique(self.keys, return_inverse=True)[1][self.page]

    def runs(self, run: int = RUN) -> np.ndarray:
        """A 64-bit hash of the run that begins at each word, as far as there are so many words."""
        n = max(0, len(self.tokens) - run + 1)
        out = np.zeros(n, np.uint64)
        for k in range(run):
            out = words.mixed(out * words.BASE + self.tokens[k : k + n])
        return out.view(np.int64)


def host_runs(pages: list[list[tuple[int, str, float]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, copy, whether it touches an open block) of the runs of one of several arrays of a host.

    A run names at most PAGES distinct pages: with that, the runs on PAGES or more pages of all arrays
    together are exactly known.
    """
    stream = Stream(pages)
    n = len(stream.tokens)
    if n < RUN:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    order, groups, pair_group, pair_copy = _groups(stream.tokens, stream.page, stream.copies(), RUN)
    opened = np.r_[0, np.cumsum(stream.is_open[stream.block])]
    within = np.zeros(n, bool)
    within[: n - RUN + 1] = stream.page[: n - RUN + 1] == stream.page[RUN - 1 :]
    touches = np.zeros(n, bool)
    touches[: n - RUN + 1] = opened[RUN:] > opened[: n - RUN + 1]
    count = groups[-1] + 1
    first = np.searchsorted(groups, np.arange(count))
    open_group = np.bincount(groups, weights=touches[order], minlength=count) > 0
    # A run that meets the end of its page is alone in its group.
    place = np.arange(len(pair_group)) - np.searchsorted(pair_group, np.arange(count))[pair_group]
    kept = (place < PAGES) & within[order[first]][pair_group]
    at = order[first][pair_group[kept]]
    return stream.runs()[at], np.unique(stream.keys)[pair_copy[kept]], open_group[pair_group[kept]]


def host_texts(pages: list[list[tuple[int, str, float]]], frequent: np.ndarray | None = None) -> list[str]:
    """The main text of each page, given the blocks of all pages of an array.

    `frequent` are the runs that are boilerplate; without it the array holds the whole host and tells them.
    """
    stream = Stream(pages)
    flat, size = stream.flat, np.bincount(stream.block, minlength=len(stream.flat))
    if frequent is None:
        covered = boilerplate(stream.tokens, stream.page, stream.copies())
    else:
        covered = _covered(np.flatnonzero(np.isin(stream.runs(), frequent)), len(stream.tokens), RUN)
    begin = np.cumsum(size) - size
    out, at = [], 0
    for page in pages:
        kept = []
        links = [b[0] == OPEN and b[2] >= LINKED for b in page]
        for i, (zone, text, _) in enumerate(page):
            if zone == MAIN:
                kept.append(text)
            elif zone == OPEN and not (links[i] and (i > 0 and links[i - 1] or i + 1 < len(page) and links[i + 1])):
                marks = covered[begin[at + i] : begin[at + i] + size[at + i]]
                if marks.any():
                    text = " ".join(w for w, gone in zip(text.split(" "), marks) if not gone)
                if text:
                    kept.append(text)
        out.append("\n".join(kept))
        at += len(page)
    return out


def _pack(page: list[tuple[int, str, float]], codec) -> tuple[bytes, int]:
    data = "\n".join(f"{zone}{int(linked >= LINKED)}{text}" for zone, text, linked in page).encode()
    return codec.compress(data, asbytes=True), len(data)


def _unpack(data: bytes, size: int, codec) -> list[tuple[int, str, float]]:
    text = codec.decompress(data, size, asbytes=True).decode() if size else ""
    return [(int(b[0]), b[2:], float(b[1])) for b in text.split("\n")] if text else []


def main_texts(pages: DataFrame, array_chars: int = ARRAY_CHARS) -> DataFrame:
    """(page_id, url, text) per row of `pages` (page_id, url, html).

    Character references are decoded, white space inside a block is one space,
    blocks are joined by a newline. A null or empty html, or one without main
    text, has an empty text. Pages without a host in their url are one host.
    Repeated rows and copies are extracted alike and count as one page. Other
    columns are ignored. Pages are read whole, whatever their length.

    An open block that is a link counts as a menu's next to another such one;
    an open block of which nothing is left has no line. An empty table gives an
    empty result.

    The pages of a host larger than array_chars are dealt to several arrays by
    the digest of their html, each of about that size. There, the arrays name
    their runs and up to PAGES pages of each, Spark counts pages over all arrays,
    and each array gets those of its runs that are boilerplate: the texts are the
    same whatever the size of an array (but for equal 64-bit hashes of two runs).
    Hosts without open blocks have nothing to cut and name no runs.
    """
    host = F.regexp_extract(F.lower(F.coalesce("url", F.lit(""))), r"^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)", 1)
    keyed = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), not_null_key(host).alias("host"))
    sizes = keyed.groupBy("host").agg(F.ceil(F.sum(F.length("html")) / array_chars).cast("int").alias("arrays"))
    large = staged(sizes.where("arrays > 1"), "hosts")
    dealt = keyed.join(large, "host", "left")
    part = F.pmod(F.xxhash64("html"), F.coalesce("arrays", F.lit(1))).cast("int")
    dealt = dealt.select("host", part.alias("part"), "page_id", "url", "html", F.col("arrays").isNotNull().alias("large"))
    page_id = f"page_id {dict(dealt.dtypes)['page_id']}"

    def parse(batches):
        codec = pa.Codec("zstd", 3)
        for batch in batches:
            found = [blocks(x) for x in batch.column("html").to_pylist()]
            packed = [_pack(x, codec) for x in found]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array([p for p, _ in packed], pa.binary()), pa.array([n for _, n in packed], pa.int64()),
                 pa.array([any(b[0] == OPEN for b in x) for x in found], pa.bool_())],
                ["host", "part", "page_id", "url", "blocks", "size", "open"])

    def unpacked(table: pa.Table) -> list[list[tuple[int, str, float]]]:
        codec = pa.Codec("zstd", 3)
        return [_unpack(b, n, codec) for b, n in zip(table.column("blocks").to_pylist(), table.column("size").to_pylist())]

    def texts(table: pa.Table, frequent: np.ndarray | None = None) -> pa.Table:
        return pa.table({"page_id": table.column("page_id"), "url": table.column("url"),
                         "text": pa.array(host_texts(unpacked(table), frequent), pa.string())})

    def run(table: pa.Table) -> pa.Table:
        return texts(table)

    def name_runs(key, table):
        runs, copies, opened = host_runs(unpacked(table))
        return pa.table({"host": pa.array([key[0].as_py()] * len(runs), pa.string()),
                         "part": pa.array([key[1].as_py()] * len(runs), pa.int32()),
                         "run": runs, "copy": copies, "open": opened})

    def cut(table: pa.Table, runs: pa.Table) -> pa.Table:
        return texts(table, runs.column("run").to_numpy())

    schema = f"{page_id}, url string, text string"

    def parsed(rows: DataFrame) -> DataFrame:
        return rows.drop("large").mapInArrow(
            parse, f"host string, part int, {page_id}, url string, blocks binary, size bigint, open boolean")

    whole = parsed(dealt.where("not large")).groupBy("host", "part").applyInArrow(run, schema)
    if large.isEmpty():
        return whole
    split = staged(parsed(dealt.where("large")), "blocks")
    cuttable = split.join(split.where("open").select("host").distinct(), "host", "left_semi")
    named = staged(cuttable.groupBy("host", "part").applyInArrow(
        name_runs, "host string, part int, run bigint, copy bigint, open boolean"), "runs")
    frequent = named.groupBy("host", "run").agg(F.count_distinct("copy").alias("pages")).where(F.col("pages") >= PAGES)
    cuts = named.where("open").select("host", "part", "run").distinct().join(frequent, ["host", "run"], "left_semi")
    both = split.groupBy("host", "part").cogroup(cuts.groupBy("host", "part"))
    return whole.unionByName(both.applyInArrow(cut, schema))
