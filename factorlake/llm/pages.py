"""Main text of web pages: a suffix array over token streams finds what pages of a host repeat, markup the rest.

Each page becomes blocks of text: sure main text (inside article or main), sure furniture (menus, headers, footers,
sidebars, notices, adverts, forms, comments), doubtful blocks (inside main text, in a container whose class has a word of
furniture among others, as in share-price) and open blocks. A token is a word with its host and the path of elements
around it, so a menu's words are other tokens than the same words in a paragraph. Pages are dealt by host into shards,
large hosts into several; in each shard the streams of all blocks of all pages, main text too, are put one after another,
the suffixes are sorted by up to RUN tokens by prefix doubling, and equal neighbours tell how many distinct pages hold a
run of RUN tokens. Sums over a host's shards say which runs are repeated. Blocks of less than RUN tokens outside of main
text are counted whole.

Every page's text is decided by these counts. Where a page has an article or main element, markup checks what they say of
it: licence lines and whole articles do repeat across pages of a host, and stay where they stand among the article's own
text; a container of its own inside the article (a box, a list) that half of the host's pages hold goes, whatever its
class. What pages of the host repeat is removed from doubtful blocks. Elsewhere repeated runs are removed from the open
blocks, and unique ones are kept: see keep_unique().
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest


#: Tokens of a substring that counts as long (a power of two), and distinct pages that must hold it.
RUN, PAGES = 16, 3
#: Bytes of html whose streams are one shard, about.
SHARD_BYTES = 4 << 20
#: Of a host in several shards a run of main text is summed only if in its shard one page in so many holds it, for only
#: what half of the host's pages hold is asked for there. Shards with fewer pages than FEW of the host sum every run.
SHARE, FEW = 4, 512
MAIN_TEXT, OPEN, ASIDE, DOUBTFUL = 0, 1, 2, 3  # kinds of blocks
PACK = pa.Codec("zstd")

# Elements that never hold text of a page, those that are furniture, and those that end a block.
SILENT = {"script", "style", "template", "noscript", "svg", "iframe", "object", "head", "title", "textarea", "select", "canvas", "math", "audio", "video"}
FURNITURE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button"}
MAIN = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer",
    "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody",
    "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Words in class, id or role that tell furniture.
MARKS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "banner", "sponsor", "sponsored", "promo", "cookie", "cookies", "consent", "gdpr", "notice", "newsletter", "subscribe",
    "popup", "modal", "comment", "comments", "disqus", "replies", "sidebar", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "footer", "masthead", "share",
    "sharing", "social", "related", "recommended", "widget", "toolbar", "pagination", "pager", "search", "complementary", "contentinfo", "adbox", "adslot", "adsense", "alert", "privacy", "responses",
}
#: Words that say nothing of what a container holds: with marks alone beside them, as in comment-list, it is furniture.
PLAIN = {
    "area", "bar", "block", "box", "button", "buttons", "container", "content", "form", "group", "icons", "inner", "item", "items", "link", "links", "list", "module", "outer", "panel",
    "posts", "row", "section", "slot", "thread", "unit", "wrap", "wrapper",
}
#: Elements that hold text itself, not blocks: inside of main text their class says nothing of furniture.
TEXTUAL = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "pre", "td", "th", "caption", "figcaption", "summary", "blockquote", "address", "legend"}
#: Words that tell it outside of main text only: an article has a header of its own.
OUTER_MARKS = {"header", "topbar", "logo", "copyright", "legal", "disclaimer"}
CLOSED_BY = {"p": BLOCK - {"p"} | {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I | re.S)


def furniture_kind(name: str, attributes: str, inner: bool = False) -> int | None:
    """ASIDE for an element that is furniture, DOUBTFUL for one that may be, None for others; `inner` is inside of main text.

    There a heading's or section's id is a slug of the article's own words, so only a container's class or role, or a
    div's id that is a mark as a whole, tell; and a class whose words aren't all marks or plain leaves a doubt."""
    if name in FURNITURE:
        return ASIDE
    if name in ("body", "html") or name in MAIN or not attributes:
        return None
    textual = inner and (name in TEXTUAL or name not in BLOCK)
    kind_ = None
    for m in ATTRIBUTE.finditer(attributes):
        kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if kind == "hidden" or kind == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return ASIDE
        if kind not in ("class", "id", "role") or textual:
            continue
        if inner and kind == "id":
            if name == "div" and value.strip().lower() in MARKS:
                return ASIDE
            continue
        for one in value.lower().split():
            words = set(re.split(r"[^a-z0-9]+", one)) - {""}
            if MARKS.isdisjoint(words) and (inner or OUTER_MARKS.isdisjoint(words)):
                continue
            if not inner or words <= MARKS | PLAIN:
                return ASIDE
            kind_ = DOUBTFUL
    return kind_


class Element(NamedTuple):
    """An open element: its number in the page, and what its end restores."""

    name: str
    label: str
    number: int
    aside: bool
    main: bool
    doubt: bool


class Block(NamedTuple):
    kind: int
    container: int  # the number of the element that holds the block and its neighbours
    path: str  # the block elements around it
    text: str


def blocks_of(page: str) -> list[Block]:
    """The page's blocks that aren't empty, in order. A header in an article is part of it unless it is marked as furniture."""
    found: list[Block] = []
    buffer: list[str] = []
    stack: list[Element] = []
    aside = main = doubt = False
    at, end, number = 0, len(page), 0

    def flush() -> None:
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            if text:
                kind = ASIDE if aside else OPEN if not main else DOUBTFUL if doubt else MAIN_TEXT
                holder = next((e.number for e in reversed(stack) if e.name in BLOCK and e.name not in TEXTUAL), 0)
                found.append(Block(kind, holder, "/".join(e.label for e in stack if e.name in BLOCK), text))
            buffer.clear()

    def leave(depth: int) -> None:
        nonlocal aside, main, doubt
        aside, main, doubt = stack[depth].aside, stack[depth].main, stack[depth].doubt
        del stack[depth:]

    while at < end:
        m = TAG.search(page, at)
        if m is None:
            buffer.append(page[at:])
            break
        if m.start() > at:
            buffer.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name, attributes = m[2].lower(), m[3]
        if m[1]:
            if name in BLOCK:
                flush()
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].name == name), None)
            if depth is not None and (name in BLOCK or not any(e.name in BLOCK for e in stack[depth:])):
                if stack[depth].aside != aside:
                    flush()
                leave(depth)
            continue
        if name == "br":
            buffer.append(" ")
            continue
        if name in SILENT:
            if attributes.endswith("/"):
                continue
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            if close:
                at = close.end()
            elif name not in ("head", "title"):
                at = end
            continue
        if name in BLOCK:
            flush()
        if name in VOID or attributes.endswith("/") and name not in BLOCK:
            continue
        for i in range(len(stack) - 1, max(-1, len(stack) - 4), -1):
            if name in CLOSED_BY.get(stack[i].name, ()):
                leave(i)
                break
            if stack[i].name in BLOCK:
                break
        told = None if aside else furniture_kind("div" if name == "header" and main else name, attributes, main)
        starts_aside = told == ASIDE
        if starts_aside:
            flush()
        number += 1
        named = next((m[2] or m[3] or m[4] for m in ATTRIBUTE.finditer(attributes) if m[1].lower() == "class"), None) if attributes else None
        stack.append(Element(name, f"{name}.{' '.join(named.split())}" if named else name, number, aside, main, doubt))
        doubt = doubt or told == DOUBTFUL
        if starts_aside:
            aside = True
        elif name in MAIN and not aside:
            main = True
    flush()
    return found


def stream_of(host: str, blocks: list[Block]) -> tuple[np.ndarray, int]:
    """The tokens of all blocks, 64-bit hashes of host, path and word, main text last; and how many stand before it."""
    rest, main = ([b for b in blocks if (b.kind == MAIN_TEXT) == own] for own in (False, True))
    words, around, sizes = [], [], []
    for b in (*rest, *main):
        own = b.text.split()
        words += own
        sizes.append(len(own))
        around.append(xxh64_intdigest(f"{host} {b.kind == MAIN_TEXT} {b.path}".encode()))
    if not words:
        return np.zeros(0, np.uint64), 0
    hashes = pd.util.hash_array(np.array(words, object), categorize=False)
    return (hashes ^ np.repeat(np.array(around, np.uint64), sizes)) * np.uint64(0x9E3779B97F4A7C15), sum(sizes[: len(rest)])


def packed(blocks: list[Block]) -> bytes:
    """Blocks as bytes: a line of kind, container, path and text each; neither path nor text has tabs or line ends."""
    lines = "\n".join(f"{b.kind}\t{b.container}\t{b.path}\t{b.text}" for b in blocks).encode()
    return len(lines).to_bytes(8) + PACK.compress(lines, asbytes=True) if lines else b""


def unpacked(data: bytes) -> list[Block]:
    lines = PACK.decompress(data[8:], decompressed_size=int.from_bytes(data[:8]), asbytes=True).decode().split("\n") if data else []
    return [Block(int(kind), int(container), path, text) for kind, container, path, text in (x.split("\t") for x in lines)]


def marks_of(host: str, blocks: list[Block], run: int) -> np.ndarray:
    """64-bit hashes of what is counted whole: the host, then each block of the stream with less than `run` words."""
    short = [b for b in blocks if b.kind != MAIN_TEXT and len(b.text.split()) < run]
    return np.array([xxh64_intdigest(x.encode(), 1) for x in (host, *(f"{host} {b.path} {b.text}" for b in short))], np.uint64)


def run_hashes(tokens: np.ndarray, run: int) -> np.ndarray:
    """A hash of the `run` tokens from each place on that has so many."""
    n = max(0, len(tokens) - run + 1)
    made = np.zeros(n, np.uint64)
    for j in range(run if n else 0):
        made = made * np.uint64(0x9E3779B97F4A7C15) + (tokens[j : j + n] ^ (tokens[j : j + n] >> np.uint64(29)))
    return made


def repeated_runs(tokens: np.ndarray, page: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, pages): for each distinct run of `run` tokens within one page, a place where it stands and how many
    distinct pages hold it. `page` has the pages' numbers, ascending.

    Suffixes are ranked by their first 1, 2, 4, ... run tokens; those that end before are left out. Equal ranks stand
    together in the suffix array; a group's distinct pages count.
    """
    n = len(tokens)
    ends = np.searchsorted(page, page, "right")
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    length = 1
    while length < run:
        whole = np.flatnonzero(np.arange(n) + 2 * length <= ends)
        if not len(whole):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pair = rank[whole] * (int(rank.max()) + 1) + rank[whole + length]
        rank = np.full(n, -1, np.int64)
        rank[whole] = np.unique(pair, return_inverse=True)[1]
        length *= 2
    whole = np.flatnonzero(np.arange(n) + run <= ends)
    order = whole[np.argsort(rank[whole], kind="stable")]  # equal ranks by place, so by page
    if not len(order):
        return order, order
    new = np.concatenate(([True], rank[order[1:]] != rank[order[:-1]]))
    fresh = new | np.concatenate(([True], page[order[1:]] != page[order[:-1]]))
    begins = np.flatnonzero(new)
    return order[begins], np.add.reduceat(fresh.astype(np.int64), begins)


def covering(starts: np.ndarray, pages: np.ndarray, n: int, run: int) -> np.ndarray:
    """For each of n tokens the most pages that hold a repeated run over it: runs begin at `starts`."""
    most = np.zeros(n, np.int64)
    for j in range(run):
        np.maximum.at(most, starts + j, pages)
    return most


def without(words: list[str], hit: np.ndarray, run: int) -> str:
    """The words less those of `hit` that stand in a row of `run` or are the whole block: a shorter row ends another
    block's run, and stays."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    gone = np.zeros(len(hit), bool)
    for a, z in zip(edges[::2], edges[1::2], strict=True):
        gone[a:z] = z - a >= run or z - a == len(hit)
    return " ".join(x for x, g in zip(words, gone.tolist(), strict=True) if not g)


def boxes(blocks: list[Block], wide: np.ndarray, run: int) -> set[int]:
    """The containers in a page's main text that are the host's furniture. `wide` tells for each token of the main text
    whether at least half of the host's pages hold a run over it.

    The container with the most tokens of its own holds the article and stays whole, licence lines and quotes too. Others
    go if they have `run` tokens or more and all are wide; but on a page whose article is itself wide for at least a half,
    which may be a copy, all stay.
    """
    by: dict[int, list[int]] = {}
    at = 0
    for b in blocks:
        if b.kind == MAIN_TEXT:
            size = len(b.text.split())
            own = by.setdefault(b.container, [0, 0])
            own[0] += size
            own[1] += int(wide[at : at + size].sum())
            at += size
    if len(by) < 2 or not wide.any():
        return set()
    article = max(by, key=lambda c: (by[c][0] - by[c][1], -c))
    if 2 * by[article][1] >= by[article][0]:
        return set()
    return {c for c, (size, hits) in by.items() if c != article and run <= size == hits}


def keep_unique(blocks: list[Block], pages: np.ndarray, run: int, host_pages: int = 0, main_pages: np.ndarray | None = None) -> str:
    """The text of a page. `pages` has for each token of the page's blocks but main text how many pages of the host, of
    `host_pages`, repeat it, 0 for none; `main_pages` the same for each token of its main text.

    With a main element: its sure text less boxes(), and its doubtful blocks less repeated runs; if nothing is left, all of it.

    Without: the open blocks less repeated runs. The container with the most unique tokens holds the page's text and
    stays, with licence lines and quotes that other pages hold too, but for leading blocks that at least half of the
    host's pages hold. From other containers that are repeated for at least a half, repeated runs go and unique ones stay.
    On a page with fewer than `run` unique tokens, which may be a copy, what is on no more pages than its `run` least
    repeated tokens stays too, unless at least half of the host's pages hold it: that is the host's furniture.
    """
    words = [b.text.split() for b in blocks if b.kind != MAIN_TEXT]
    ends = np.cumsum([len(w) for w in words])
    counts = iter([(w, pages[e - len(w) : e]) for w, e in zip(words, ends.tolist(), strict=True)])
    parts = [(b, *(next(counts) if b.kind != MAIN_TEXT else (None, None))) for b in blocks]
    sure = [(b, w, p) for b, w, p in parts if b.kind in (MAIN_TEXT, DOUBTFUL)]
    if sure:
        gone = boxes(blocks, (main_pages > 0) & (2 * main_pages >= host_pages), run) if main_pages is not None and host_pages else set()
        made = [without(w, p > 0, run) if w is not None else "" if b.container in gone else b.text for b, w, p in sure]
        return "\n\n".join([t for t in made if t] or [b.text for b, _, _ in sure])
    parts = [x for x in parts if x[0].kind == OPEN]
    if not parts:
        return ""
    every = np.concatenate([p for _, _, p in parts])
    bar = 0
    if (every == 0).sum() < run <= (every > 0).sum():
        bar = int(np.sort(every[every > 0])[run - 1])
    widely = lambda p: (p > 0) & (2 * p >= host_pages) if host_pages else np.zeros(len(p), bool)
    if widely(every).all():
        widely = lambda p: np.zeros(len(p), bool)
    repeated = lambda p: (p > bar) | widely(p)
    by: dict[int, list[int]] = {}
    for b, _, p in parts:
        own = by.setdefault(b.container, [0, 0])
        own[0] += len(p)
        own[1] += int(repeated(p).sum())
    main = max(by, key=lambda c: (by[c][0] - by[c][1], -c))
    texts, leading = [], True
    for b, w, p in parts:
        size, hits = by[b.container]
        if b.container == main:
            leading = leading and bool(widely(p).all())
            if not leading:
                texts.append(b.text)
        elif 2 * hits < size:
            texts.append(b.text)
        else:
            texts.append(without(w, repeated(p), run))
    return "\n\n".join(t for t in texts if t)


def extract_text(df: DataFrame, run: int = RUN, least: int = PAGES, markup: str = "html", key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, url, text) of every row of `df`.

    Pages are distinct by host and content: rows that repeat, and copies within a host, count as one page and each
    get their text. A null or empty page has an empty text; pages whose url is null or has no host share the host ''.
    An empty table gives an empty result; other columns of `df`, whatever their names, are left out.

    Blocks are shuffled once, by shard; both the suffix arrays and the texts are made from that shuffle. Pages of one
    host share shards: a host of more than SHARD_BYTES of html has several, dealt by content. Copies that come in one
    batch of rows travel as one. What comes to the driver are the hosts of more than SHARD_BYTES.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = df.select(F.col(key).alias("key"), F.col(url).alias("url"), F.coalesce(F.col(markup), F.lit("")).alias("html"), host.alias("host"))
    sizes = rows.groupBy("host").agg(F.sum(F.octet_length("html").cast("long")).alias("size"))
    large = F.when(F.col("size") > SHARD_BYTES, F.struct("host", F.ceil(F.col("size") / SHARD_BYTES).cast("int").alias("parts")))
    total, hosts = sizes.agg(F.sum("size"), F.collect_list(large)).first()
    shards = max(1, -(-(total or 0) // SHARD_BYTES))
    several = df.sparkSession.createDataFrame([tuple(h) for h in hosts], "host string, parts int")
    dealt = rows.join(F.broadcast(several), "host", "left").select("key", "url", "html", "host", F.coalesce("parts", F.lit(1)).alias("parts"))
    member = f"struct<key:{df.schema[key].dataType.simpleString()},url:{df.schema[url].dataType.simpleString()}>"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The blocks of every page; rows of a batch with equal blocks are one."""
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                hosts = part.column(3).to_pylist()
                found = [blocks_of(x) for x in part.column(2).to_pylist()]
                data = [packed(f) for f in found]
                which: dict[tuple, list[int]] = {}
                for i, same in enumerate(zip(hosts, data, strict=True)):
                    which.setdefault(same, []).append(i)
                firsts, order = [own[0] for own in which.values()], pa.array([i for own in which.values() for i in own])
                ends = np.cumsum([0, *map(len, which.values())])
                members = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([part.column(0).take(order), part.column(1).take(order)], ["key", "url"]))
                content = [xxh64_intdigest("\n".join([hosts[i], *[b.text for b in found[i]]]).encode()) >> 1 for i in firsts]
                yield pa.RecordBatch.from_arrays(
                    [members, pa.array([hosts[i] for i in firsts]), part.column(4).take(pa.array(firsts)), pa.array(content, pa.int64()), pa.array([data[i] for i in firsts], pa.binary())],
                    names=["members", "host", "parts", "content", "blocks"],
                )

    pages = dealt.mapInArrow(parse, f"members array<{member}>, host string, parts int, content long, blocks binary")
    sub = F.pmod("content", F.col("parts"))
    pages = pages.withColumn("shard", F.when(F.col("parts") > 1, F.xxhash64("host", sub)).otherwise(F.pmod(F.xxhash64("host"), F.lit(shards))))

    def count(table: pa.Table) -> pa.Table:
        """A shard's distinct runs and whole blocks that may be repeated: their hashes and how many of its pages hold them."""
        own: dict[int, tuple] = {}
        for host, parts, content, data in zip(*(table.column(c).to_pylist() for c in ("host", "parts", "content", "blocks")), strict=True):
            if content not in own or data < own[content][2]:
                own[content] = (host, parts, data)
        tokens, rests, marks = [], [], {True: [], False: []}
        for host, parts, data in own.values():
            blocks = unpacked(data)
            stream, rest = stream_of(host, blocks)
            tokens.append(stream)
            rests.append((rest, len(stream) - rest))
            marks[parts > 1].append(np.unique(marks_of(host, blocks, run)))
        parted = np.array([parts > 1 for _, parts, _ in own.values()])
        here = Counter(host for host, *_ in own.values())
        every = np.concatenate(tokens)
        segment = np.repeat(np.arange(2 * len(own)), np.array(rests).ravel())  # a page's rest and its main text
        place, n = repeated_runs(every, segment, run)
        page, main = segment[place] // 2, segment[place] % 2 == 1
        pages_here = np.array([here[host] for host, *_ in own.values()], np.int64)[page]
        keep = np.where(parted[page], ~main | (SHARE * n >= pages_here) | (pages_here < FEW), n >= least)
        hashes = [run_hashes(every, run)[place[keep]] if len(place) else np.zeros(0, np.uint64)]
        counts = [n[keep]]
        for several, parts in marks.items():
            found, held = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            hashes.append(found if several else found[held >= least])
            counts.append(held if several else held[held >= least])
        runs = np.concatenate(hashes).view(np.int64)
        return pa.table({"shard": pa.array(np.full(len(runs), table.column("shard")[0].as_py(), np.int64)), "run": pa.array(runs), "n": pa.array(np.concatenate(counts), pa.int64())})

    runs = pages.groupBy("shard").applyInArrow(count, "shard long, run long, n long")
    found = runs.groupBy("run").agg(F.sum("n").alias("n"), F.collect_list("shard").alias("shards")).filter(F.col("n") >= least).select("run", "n", F.explode("shards").alias("shard"))

    def finish(own: pa.Table, hits: pa.Table) -> pa.Table:
        hashes, n = hits.column("run").to_numpy().astype(np.int64), hits.column("n").to_numpy()
        order = np.argsort(hashes)
        hashes, n = hashes[order], n[order]
        texts = []

        def pages_of(wanted: np.ndarray) -> np.ndarray:
            """How many pages hold each of the wanted hashes, 0 where they aren't repeated."""
            if not len(hashes):
                return np.zeros(len(wanted), np.int64)
            at = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
            return np.where(hashes[at] == wanted, n[at], 0)

        for host, data in zip(own.column("host").to_pylist(), own.column("blocks").to_pylist(), strict=True):
            blocks = unpacked(data)
            tokens, rest = stream_of(host, blocks)
            held = pages_of(run_hashes(tokens, run).view(np.int64))
            starts = np.flatnonzero(held)
            most = covering(starts, held[starts], len(tokens), run)
            host_pages, *whole = pages_of(marks_of(host, blocks, run).view(np.int64)).tolist()
            at, short = 0, iter(whole)
            for b in blocks:
                if b.kind != MAIN_TEXT:
                    size = len(b.text.split())
                    if size < run:
                        most[at : at + size] = np.maximum(most[at : at + size], next(short))
                    at += size
            texts.append(keep_unique(blocks, most[:rest], run, host_pages, most[rest:]))
        return pa.table({"members": own.column("members"), "text": pa.array(texts, pa.string())})

    made = pages.groupBy("shard").cogroup(found.groupBy("shard")).applyInArrow(finish, f"members array<{member}>, text string")
    return made.select(F.explode("members").alias("m"), "text").select("m.key", "m.url", "text")
