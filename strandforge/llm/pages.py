"""Main text of web pages by suffix arrays of each host's token streams, with markup for what stands only once.

A page is cut into blocks. Its container elements mark blocks as article text (``article``, ``main``, content classes),
as boilerplate (``nav``, ``footer``, ``aside``, forms, adverts, notices, comments, ...), or as neither. All blocks make
up the page's token stream: each block a mark and its words.

Streams of a host are searched for substrings of ``RUN`` tokens or more that stand on distinct pages. Each task builds
suffix arrays over bounded stretches of its own pages (prefix doubling to depth ``RUN``; neighbours in suffix order and
their common length give the runs, overlapping ones merge into longer). Runs that repeat there are known at once; of
every distinct run one row goes on, keyed by a 128-bit hash of the host and the run, so that runs repeated across tasks
are found by an aggregate. A host with a third of all pages thus stays spread over its tasks, and sends each run once per
stretch. In an ``article`` a run counts only as a whole block, and only if it stands on more than ``SHARE`` of the host's
pages, ``LEAST`` at least: articles quote each other, and a quoted passage is text. Each stretch sends the pages of each of its
article blocks, as a hash and a number, and the sums of all stretches are compared: what is found does not depend on how
pages are dealt. Tags are scanned in time linear in the page, whatever is left unclosed in it.

What runs cover by half of its words or more is repeated boilerplate and goes, whatever its markup. Markup then rules out
those marked blocks that are unique. The text is what is left, in page order.

Nulls and edge cases: a null or empty html gives an empty text; null page_id and url are carried through; identical
rows count as one page in the search for runs, as often as they stand in the shares, and each keep their result; a page of one endless block is a block like others; of
equal runs on more than two pages all count alike; an empty table gives no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, slices, stash

#: Tokens of a run, a power of two; tokens of one suffix array.
RUN, STRETCH = 8, 1 << 20
#: Share of a host's pages, and pages at least, on which a whole block within an article is boilerplate.
SHARE, LEAST = 0.5, 10
#: Parts of a host's pages when they look for the host's blocks.
SALTS = 64
ARTICLE, MAIN, CONTENT, OPEN, MARKED = 3, 2, 1, 0, -1
LEVELS = "mocna"  # letters for the levels, from MARKED up

# Element names and words of class names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav noscript ol option p pre section select summary table tbody td template tfoot th thead title tr ul".split()
)
BOILERPLATE = frozenset("nav footer aside form menu dialog noscript template head select button canvas svg math object video audio iframe".split())
RAW = "script|style|textarea|title|iframe|xmp"
MARKED_WORDS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo banner cookie cookies consent notice notices sidebar menu menus nav navbar navigation"
    " breadcrumb breadcrumbs footer header comment comments disqus related share sharing social newsletter subscribe popup modal pagination pager".split()
)
LAYOUT_WORDS = frozenset("has with without no is".split())
CONTENT_WORDS = frozenset("content article story".split())

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_RAW = re.compile(rf"<({RAW})\b", re.I)
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW.split("|")}
_QUOTE_OR_END = re.compile("[\"'>]")
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def tags(html: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(begin, end, whether it closes, name in lower case, attributes) of each tag; comments and raw text have no name.

    A tag ends at the first ``>`` outside of quotes or, where there is none, at the first one. No character is looked at
    more than a few times: quotes from which no end was found are remembered.
    """
    at, last = 0, html.rfind(">")
    last_quote = {q: html.rfind(q) for q in "\"'"}
    dead: set[int] = set()
    while (begin := html.find("<", at)) >= 0:
        if html.startswith("<!--", begin):
            end = html.find("-->", begin + 4)
            at = len(html) if end < 0 else end + 3
            yield begin, at, False, "", ""
            continue
        if begin > last:
            # no tag ends any more, but a comment without an end reaches to that of the page
            if (at := html.find("<!--", begin)) < 0:
                return
            continue
        if raw := _RAW.match(html, begin):
            end = _RAW_END[raw[1].lower()].search(html, html.find(">", raw.end()) + 1)
            at = end.end() if end else len(html)
            yield begin, at, False, "", ""
        elif name := _NAME.match(html, begin):
            at = _tag_end(html, name.end(), last_quote, dead)
            yield begin, at, bool(name[1]), name[2].lower(), html[name.end() : at - 1]
        elif html[begin + 1] in "!?/":
            at = html.find(">", begin + 2) + 1
            yield begin, at, False, "", ""
        else:
            at = begin + 1


def _tag_end(html: str, at: int, last_quote: dict[str, int], dead: set[int]) -> int:
    """Where the tag ends whose attributes begin at ``at``; there is a ``>`` behind it."""
    passed, place = [], at
    while found := _QUOTE_OR_END.search(html, place):
        if found[0] == ">":
            return found.end()
        passed.append(found.start())
        if found.start() in dead or last_quote[found[0]] == found.start():
            break
        place = html.find(found[0], found.end()) + 1
    dead.update(passed)
    return html.find(">", at) + 1


def _level(tag: str, attributes: str, now: int) -> int:
    """What an element makes of the text in it, within an element that made it ``now``."""
    if now == MARKED or tag in BOILERPLATE or (tag == "header" and now == OPEN):
        return MARKED
    level = max(now, {"article": ARTICLE, "main": MAIN}.get(tag, OPEN))
    if not attributes or tag in ("html", "body"):
        return level
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        for one in (a or b or c).lower().split():
            words = re.split(r"[-_:]+", one)
            if one == "articlebody" or (name.lower() == "role" and one == "main"):
                level = max(level, ARTICLE if one == "articlebody" else MAIN)
            elif words[0] in LAYOUT_WORDS or (now > OPEN and words[-1] == "header"):
                continue
            elif tag != "main" and (words[-1] in MARKED_WORDS or words[0] in MARKED_WORDS):
                return MARKED
            elif words[-1] in CONTENT_WORDS or (len(words) > 1 and words[-1] == "body"):
                level = max(level, CONTENT)
    return level


def blocks(html: str | None) -> list[tuple[str, int]]:
    """(text, level) of each block with text, in page order."""
    html = html or ""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, int]] = []
    open_: Counter[str] = Counter()  # of the stack
    held: list[str] = []
    now, at = OPEN, 0

    def flush() -> None:
        if held:
            if text := " ".join(entities.unescape("".join(held)).split()):
                out.append((text, now))
            held.clear()

    for begin, end, closes, tag, attributes in tags(html):
        if begin > at:
            held.append(html[at:begin])
        at = end
        if not tag:
            continue
        if tag == "br":
            held.append(" ")
            continue
        block = tag in BLOCKS
        if block:
            flush()
        if closes:
            if open_[tag]:
                if not block:
                    flush()
                name = ""
                while name != tag:
                    name, now = stack.pop()
                    open_[name] -= 1
        elif tag not in VOID and (block or tag in BOILERPLATE):
            if stack and stack[-1][0] in ("p", "li") and (stack[-1][0] == tag or stack[-1][0] == "p"):
                name, now = stack.pop()  # an open paragraph ends where a block begins
                open_[name] -= 1
            if not block:
                flush()
            stack.append((tag, now))
            open_[tag] += 1
            now = _level(tag, attributes, now)
    if at < len(html):
        held.append(html[at:])
    flush()
    return out


def suffix_ranks(tokens: np.ndarray, depth: int = RUN) -> np.ndarray:
    """Place of each suffix in the order of suffixes by their first ``depth`` tokens; equal ones share a place."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    width = 1
    while width < depth:
        behind = np.zeros(len(rank), np.int64)
        behind[:-width] = rank[width:] + 1
        rank = np.unique(rank * (len(rank) + 1) + behind, return_inverse=True)[1].astype(np.int64)
        width *= 2
    return rank


def _host(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def longest_runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the maximal stretches that runs of RUN tokens at ``starts`` (sorted) cover without a gap between their starts."""
    if not len(starts):
        return starts, starts
    gap = np.diff(starts) != 1
    return starts[np.concatenate([[True], gap])], starts[np.concatenate([gap, [True]])] + RUN


def _gram_hash(tokens: np.ndarray, first: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of the RUN tokens at each of ``first``."""
    out = np.full(len(first), seed, np.uint64)
    for n in range(RUN):
        out = (out ^ tokens[first + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def repeats(pages: np.ndarray, sizes: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of RUN tokens in some streams, by a suffix array: (a first place of each distinct run, whether it stands on distinct pages,
    the pages it stands on, places of all runs that do). ``pages``: the page of each stream; no run crosses the end of a stream."""
    stream = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    ids = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    # an own end mark behind each stream keeps runs within it
    rank = suffix_ranks(np.insert(ids, np.cumsum(sizes), len(ids) + np.arange(len(sizes))))
    rank = rank[np.arange(len(ids)) + stream]
    whole = np.flatnonzero(at + RUN <= np.repeat(sizes, sizes))
    order = whole[np.lexsort((pages[stream[whole]], rank[whole]))]
    if not len(order):
        return order, np.zeros(0, bool), order, order
    new_rank = np.concatenate([[True], np.diff(rank[order]) != 0])
    new_page = new_rank | np.concatenate([[True], np.diff(pages[stream[order]]) != 0])
    starts = np.flatnonzero(new_rank)
    n_pages = np.add.reduceat(new_page.astype(np.int64), starts)
    repeated = order[np.repeat(n_pages > 1, np.diff(np.append(starts, len(order))))]
    return order[starts], n_pages > 1, n_pages, np.sort(repeated)


RUNS = "kind int, g1 long, g2 long, k1 long, k2 long, at int, stop int, many boolean, n long"
#: Kinds of rows: a distinct run of a stretch (g) with a page (k); what repeated runs cover of a page (k); a block in articles (g1) of a
#: host (k) and its pages; a host (g) and its pages; a page (k) of a host (g).
RUN_ROW, SPAN_ROW, BLOCK_ROW, HOST_ROW, PAGE_ROW = range(5)


def _host_ids(host: str) -> tuple[int, int]:
    return xxhash.xxh3_64_intdigest(host), xxhash.xxh3_64_intdigest(host, 1)


def _block_id(text: str, host: tuple[int, int]) -> int:
    """Of a block among those of its host."""
    return xxhash.xxh3_64_intdigest(text, host[1])


class Stretch:
    """Token streams of some pages, at most about STRETCH tokens of them; blocks in articles are held as hashes."""

    def __init__(self) -> None:
        self.keys: list[tuple[int, int]] = []
        self.hosts: list[tuple[int, int]] = []
        self.streams: list[tuple[int, int, list[int]]] = []  # page, first place in it, tokens
        self.inside: list[tuple[int, int]] = []  # page, hash of a block
        self.words: dict[str, int] = {}
        self.size = 0

    def add(self, key: tuple[int, int], host: str, found: list[tuple[str, int]]) -> None:
        page, words, place = len(self.keys), self.words, 0
        ids = _host_ids(host)
        row: list[int] | None = None
        for text, level in found:
            if level == ARTICLE:
                stop = place + 2 + text.count(" ")
                if stop - place > RUN:
                    self.inside.append((page, _block_id(text, ids)))
                    self.size += RUN
                place, row = stop, None
                continue
            if row is None:
                row = []
                self.streams.append((page, place, row))
            before = len(row)
            row.append(1)
            for word in text.split(" "):
                if (h := words.get(word)) is None:
                    h = words[word] = xxhash.xxh3_64_intdigest(word)
                row.append(h)
            place += len(row) - before
            self.size += len(row) - before
        self.size += 1
        self.keys.append(key)
        self.hosts.append(ids)

    def rows(self) -> pa.RecordBatch:
        keys, hosts = np.array(self.keys, np.int64).reshape(-1, 2), np.array(self.hosts, np.uint64).reshape(-1, 2)
        sizes = np.array([len(s[2]) for s in self.streams], np.int64)
        page = np.array([s[0] for s in self.streams], np.int64)
        # place of a token in its page, less its place in all tokens
        shift = np.array([s[1] for s in self.streams], np.int64) - (np.cumsum(sizes) - sizes)
        plain = np.concatenate([*(np.array(s[2], np.uint64) for s in self.streams), np.zeros(0, np.uint64)])
        stream = np.repeat(np.arange(len(sizes)), sizes)
        # runs count within a host: tokens are mixed with it
        tokens = (plain + np.uint64(1)) * (hosts[page[stream], 0] | np.uint64(1))
        same = np.unique(keys, axis=0, return_index=True, return_inverse=True)
        first, many, n_pages, repeated = repeats(same[2].reshape(-1)[page], sizes, tokens)
        lo, hi = longest_runs(repeated)
        one = same[1]
        distinct, host_of, n_host = np.unique(hosts, axis=0, return_inverse=True, return_counts=True)
        host_of = host_of.reshape(-1)
        # distinct (block, row), then rows of each block
        inside = np.unique(np.array(self.inside, np.uint64).reshape(-1, 2), axis=0)
        inside[:, 0] = host_of[inside[:, 0].astype(np.int64)]
        block, n_block = np.unique(inside, axis=0, return_counts=True)
        own_host, block = block[:, 0].astype(np.int64), block[:, 1].view(np.int64)
        distinct, hosts = distinct.view(np.int64), hosts.view(np.int64)
        zero = lambda n: np.zeros(n, np.int64)
        parts = [
            (RUN_ROW, _gram_hash(tokens, first, 0), _gram_hash(tokens, first, 1), keys[page[stream[first]]], first + shift[stream[first]], first + shift[stream[first]] + RUN, many, n_pages),
            (SPAN_ROW, zero(len(lo)), zero(len(lo)), keys[page[stream[lo]]], lo + shift[stream[lo]], hi + shift[stream[lo]], lo >= 0, zero(len(lo))),
            (BLOCK_ROW, block, zero(len(block)), distinct[own_host], zero(len(block)), zero(len(block)), n_block < 0, n_block),
            (HOST_ROW, distinct[:, 0], distinct[:, 1], np.zeros_like(distinct), zero(len(distinct)), zero(len(distinct)), n_host < 0, n_host),
            (PAGE_ROW, hosts[one, 0], hosts[one, 1], keys[one], zero(len(one)), zero(len(one)), one < 0, zero(len(one))),
        ]
        columns = [np.concatenate([np.full(len(p[1]), p[0], np.int32) for p in parts])]
        columns += [np.concatenate([p[n] for p in parts]) for n in (1, 2)]
        columns += [np.concatenate([p[3][:, n] for p in parts]) for n in range(2)]
        columns += [np.concatenate([p[n] for p in parts]).astype(t) for n, t in ((4, np.int32), (5, np.int32), (6, bool), (7, np.int64))]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[f.split(" ")[0] for f in RUNS.split(", ")])


def run_rows(pages: DataFrame) -> DataFrame:
    """RUNS rows of pages with k1, k2, url, html: what each stretch knows (see Stretch)."""
    bound_batches(pages.sparkSession)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Stretch()
        for batch in slices(batches, "html"):
            for k1, k2, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.add((k1, k2), _host(url), blocks(html))
                if held.size >= STRETCH:
                    yield held.rows()
                    held = Stretch()
        if held.keys:
            yield held.rows()

    return pages.select("k1", "k2", "url", "html").mapInArrow(find, RUNS)


def repeated_runs(pages: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """k1, k2, spans (at, stop), gone: what runs repeated on distinct pages of a host cover of each page's token stream outside of
    articles, and the hashes of article blocks that are boilerplate on its host."""
    seen = stash(run_rows(pages), "runs")
    gram, key = ["g1", "g2"], ["k1", "k2"]
    own = seen.where(F.col("kind") == RUN_ROW)
    across = own.groupBy(*gram).agg(F.min("k1").alias("lo"), F.max("k1").alias("hi"), F.max("many").alias("known")).where((F.col("lo") != F.col("hi")) | F.col("known"))
    # a run that is known as repeated in its own stretch has its spans already
    more = own.where(~F.col("many")).join(across.select(*gram), gram, "left_semi")
    found = seen.where(F.col("kind") == SPAN_ROW).select(*key, "at", "stop").unionByName(more.select(*key, "at", "stop"))
    spans = found.groupBy(*key).agg(F.collect_list(F.struct("at", "stop")).alias("spans"))
    # blocks in articles: pages of the block against those of its host
    host = ["h1", "h2"]
    as_host = lambda c: [F.col(f"{c}1").alias("h1"), F.col(f"{c}2").alias("h2")]
    totals = seen.where(F.col("kind") == HOST_ROW).groupBy(*as_host("g")).agg(F.sum("n").alias("host_pages"))
    often = seen.where(F.col("kind") == BLOCK_ROW).groupBy("g1", *as_host("k")).agg(F.sum("n").alias("pages")).where(F.col("pages") >= least)
    often = often.join(totals, host).where(F.col("pages") > share * F.col("host_pages")).groupBy(*host).agg(F.collect_list("g1").alias("gone"))  # fewer than 1 / SHARE pages have blocks
    # a host may have a third of all pages: its list, if it has one, goes to each of SALTS parts of them
    often = often.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    members = seen.where(F.col("kind") == PAGE_ROW).select(*key, *as_host("g"), F.pmod("k1", F.lit(SALTS)).cast("long").alias("salt"))
    members = members.join(often, [*host, "salt"]).select(*key, "gone").dropDuplicates(key)
    return spans.join(members, key, "full_outer")


def decided(url: str | None, found: list[tuple[str, int, int]], spans: list[dict[str, int]] | None, gone: list[int] | None) -> tuple[str, int, int, int]:
    """(text, blocks that runs rule out, those of them that markup does not mark, blocks that markup alone rules out) of a page's blocks."""
    covered = np.zeros(sum(1 + n for _, _, n in found), bool)
    for s in spans or []:
        covered[s["at"] : s["stop"]] = True
    out = {g % (1 << 64) for g in gone or []}
    host = _host_ids(_host(url)) if out else (0, 0)
    kept, repeated, unmarked, marked, begin = [], 0, 0, 0, 0
    for text, level, size in found:
        if level == ARTICLE:
            over = bool(out) and size >= RUN and _block_id(text, host) in out
        else:
            over = 2 * int(covered[begin + 1 : begin + 1 + size].sum()) >= size
        begin += 1 + size
        repeated += over
        unmarked += over and level != MARKED
        marked += not over and level == MARKED
        if not over and level != MARKED:
            kept.append(text)
    return "\n\n".join(kept), repeated, unmarked, marked


def packed(found: list[tuple[str, int]]) -> str:
    """Blocks as one string: a letter for the level before each text; a text holds no separator, which counts as white space.

    Of marked blocks, which are never part of the text, only the number of words is kept.
    """
    return "\x1e".join(f"m{1 + text.count(' ')}" if level == MARKED else LEVELS[level - MARKED] + text for text, level in found)


def unpacked(body: str) -> list[tuple[str, int, int]]:
    """(text, level, words) of each block."""
    parts = [(b[1:], LEVELS.index(b[0]) + MARKED) for b in body.split("\x1e")] if body else []
    return [("", level, int(text)) if level == MARKED else (text, level, 1 + text.count(" ")) for text, level in parts]


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", share: float = SHARE, least: int = LEAST) -> DataFrame:
    """page_id, url, text, n_chars, repeated_blocks, unmarked_blocks, marked_blocks for each row of ``pages``.

    The counts are blocks that runs rule out, those of them that no markup marks, and blocks that markup alone rules out.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    # 128 bits of the page's content: identical rows are one page
    rows = rows.withColumns({"k1": F.xxhash64(F.lit(1), "page_id", "url", "html"), "k2": F.xxhash64(F.lit(2), "page_id", "url", "html")})
    kind = dict(rows.dtypes)["page_id"]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            bodies = pa.array([packed(blocks(h)) for h in batch.column(4).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in range(4)), bodies], names=["k1", "k2", "page_id", "url", "body"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body"):
            found = [decided(u, unpacked(b), s, g) for u, b, s, g in zip(*(batch.column(n).to_pylist() for n in range(1, 5)), strict=True)]
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([len(f[0]) for f in found], pa.int64()), *(pa.array([f[n] for f in found], pa.int64()) for n in (1, 2, 3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["page_id", "url", "text", "n_chars", "repeated_blocks", "unmarked_blocks", "marked_blocks"])

    parsed = rows.select("k1", "k2", "page_id", "url", "html").mapInArrow(parse, f"k1 long, k2 long, page_id {kind}, url string, body string")
    with_spans = parsed.join(repeated_runs(rows, share, least), ["k1", "k2"], "left").select("page_id", "url", "body", "spans", "gone")
    return with_spans.mapInArrow(finish, f"page_id {kind}, url string, text string, n_chars long, repeated_blocks long, unmarked_blocks long, marked_blocks long")
