"""The main text of web pages: runs that a host repeats go, what is unique stays.

Method: a host suffix array. A page is a stream of tokens, block marks and words, cut
into regions (an article, a menu, a footer, the blocks between two of these). All
suffixes of the regions of a host are grouped by their first RUN tokens: a group is the
stretch of the host's suffix array whose common prefix has that length, and one with two
distinct pages is a long repeated substring. Overlapping ones cover longer runs. A block
with more than half of its tokens covered is repeated by its host; blocks that are not
covered are unique runs. Spark sorts the suffixes by shuffle in ranges of their keys, as
one host may hold a third of all pages; equal regions of a batch are one and count for
all pages that have them.

What the array can't see is settled by the marks of the page in the same step: a
region in a menu, footer, advert or the like goes even if no other page has it, and
the blocks of an ``article`` element stay although another page has a copy of them,
as a copied article is still the main text (``n_repeated`` counts them). Pages without that element keep the
unique blocks that are not mostly links, of their content element if there is one.

A block is the text between two block tags; its character references are decoded and
its white space (as Unicode has it) becomes single spaces.

Defined cases: null or empty html gives an empty text; a null url is a host of its own
(""); rows of a host with equal html are one page, so copies and repeated rows are no
evidence of each other; a page without an article whose blocks its host repeats all has
no text; broken markup is read as far as it goes, and what follows an open comment or
script is part of it; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievebase.llm.common import key_filter, materialize, may_hold, mix, span_hashes, word_bounds

RUN = 8
SALTS = 32
RANGE_BITS = 5  # at least two to this power ranges of keys
RANGE_KEYS = 1 << 21  # about so many in one

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Their content is never text of the page.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
ASIDE = frozenset(
    "nav footer aside form header menu dialog button select option datalist noscript template svg math canvas audio video object label head".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id and role that name what is not main text.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsors sponsored promo promos promotion banner banners "
    "cookie cookies consent gdpr notice notices notification notifications alert popup modal newsletter subscribe subscription signup login "
    "menu menus nav navbar navigation breadcrumb breadcrumbs sidebar sidebars widget widgets complementary contentinfo footer footers header "
    "masthead topbar toolbar comment comments disqus reply replies respond related recommended recommendations share sharing social "
    "pagination pager copyright search form".split()
)
CONTENT_WORDS = frozenset("main content article articlebody maincontent post entry story".split())
#: ``with-sidebar`` says that there is one somewhere inside.
LAYOUT_WORDS = frozenset("with has no without".split())

_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_PART = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}

ARTICLE, CONTENT, OPEN = 2, 1, 0


class Block(NamedTuple):
    """A block's text, how near it is to the article, whether marks set it aside, its region."""

    text: str
    level: int
    aside: bool
    linked: bool
    region: int


class _Element(NamedTuple):
    name: str
    level: int
    aside: bool
    header: bool


def _tag_end(html: str, at: int) -> tuple[int, str]:
    """Where a tag that begins its attributes at ``at`` ends, and its attributes as they stand."""
    end = html.find(">", at)
    if end < 0:
        return len(html), html[at:]
    found = html[at:end]
    if found.count('"') % 2 == 0 and found.count("'") % 2 == 0:
        return end + 1, found
    place = at
    while place < len(html):
        step = _ATTRIBUTE.match(html, place)
        if not step:
            break
        place = step.end()
    end = html.find(">", place)
    end = len(html) if end < 0 else end
    return end + 1, html[at:end]


def _marks(attributes: str) -> tuple[set[str], bool]:
    """The words of class, id and role, and whether the element is hidden."""
    words: set[str] = set()
    hidden = False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role", "itemprop"):
            for one in value.split():
                parts = [p.lower() for p in _PART.findall(one)]
                if not LAYOUT_WORDS & set(parts):
                    words.update(parts)
                    words.add("".join(parts))
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.IGNORECASE)):
            hidden = True
    return words, hidden


class _Page:
    """Reads one page from left to right; ``blocks`` are its blocks in order."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.open: list[_Element] = []
        self.names: dict[str, int] = {}
        self.parts: list[str] = []
        self.words = self.linked = 0
        self.link = False
        self.region = -1
        self.last: object = None

    def text(self, found: str) -> None:
        self.parts.append(found)
        if self.link:
            self.linked += len(found.split())

    def close_block(self) -> None:
        if not self.parts:
            return
        words = "".join(unescape(p) if "&" in p else p for p in self.parts).split()
        self.parts, linked, self.linked = [], self.linked, 0
        if not words:
            return
        level, aside = (self.open[-1].level, self.open[-1].aside) if self.open else (OPEN, False)
        # A region ends where another element sets aside, or stops to; an article is one as well.
        first = next((k for k, e in enumerate(self.open) if e.aside), None) if aside else None
        here = (level, first, self.open[first].name if first is not None else "")
        if here != self.last:
            self.region, self.last = self.region + 1, here
        self.blocks.append(Block(" ".join(words), level, aside, 2 * linked >= len(words), self.region))

    def pop_to(self, name: str) -> None:
        while self.open:
            last = self.open.pop()
            self.names[last.name] -= 1
            if last.name == name:
                return

    def start(self, name: str, attributes: str) -> None:
        if name == "br":
            self.parts.append(" ")
            return
        if name == "a":
            self.link = True
        block = name in BLOCKS
        if block:
            self.close_block()
            if self.names.get("p") and name not in ("body", "html"):
                self.pop_to("p")
            if name in ("li", "tr", "dd", "dt"):
                self.close_item(name)
            if name == "body" and self.names.get("head"):
                self.pop_to("head")
        if name in VOID or name in ("html", "body"):
            return
        level, aside, header = (self.open[-1].level, self.open[-1].aside, self.open[-1].header) if self.open else (OPEN, False, False)
        words, hidden = _marks(attributes) if attributes and ("=" in attributes or "hidden" in attributes) else (set(), False)
        marked = ASIDE_WORDS & words if name != "main" else set()
        if header and name in HEADINGS and not marked and not hidden:
            aside = False
        elif (name == "header" or marked == {"header"}) and level >= CONTENT and not aside:
            aside = header = True
        elif name in ASIDE or marked or hidden:
            aside, header = True, False
        if not aside:
            if name == "article" or words & {"articlebody"}:
                level = ARTICLE
            elif name == "main" or words & CONTENT_WORDS:
                level = max(level, CONTENT)
        if block or name in ASIDE or (aside, level) != ((self.open[-1].aside, self.open[-1].level) if self.open else (False, OPEN)):
            if aside and not (self.open and self.open[-1].aside):
                self.close_block()
            self.open.append(_Element(name, level, aside, header))
            self.names[name] = self.names.get(name, 0) + 1

    def close_item(self, name: str) -> None:
        """An item that is still open in the same list or table ends where the next one starts."""
        for k in range(len(self.open) - 1, -1, -1):
            found = self.open[k].name
            if found == name or {found, name} == {"dd", "dt"}:
                self.pop_to(found)
                return
            if found in ("ul", "ol", "dl", "table", "div", "article", "section", "nav", "menu"):
                return

    def end(self, name: str) -> None:
        if name == "a":
            self.link = False
        if name in BLOCKS:
            self.close_block()
        if not self.names.get(name):
            return
        if name not in BLOCKS and name not in ASIDE and self.open[-1].name != name:
            return
        if self.open[-1].aside:
            self.close_block()
        self.pop_to(name)


def blocks_of(html: str) -> list[Block]:
    """The blocks of a page in page order, raw elements and comments left out."""
    page, at, n = _Page(), 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            page.text(html[at:])
            break
        if lt > at:
            page.text(html[at:lt])
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        following = html[lt + 1 : lt + 2]
        if following in ("!", "?"):
            end = html.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        closing = following == "/"
        name = _NAME.match(html, lt + 1 + closing)
        if not name:
            if closing and lt + 2 < n:
                end = html.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                page.text("<")
                at = lt + 1
            continue
        tag = name[0].lower()
        at, attributes = _tag_end(html, name.end())
        if closing:
            page.end(tag)
        elif tag in RAW:
            found = _RAW_END[tag].search(html, at)
            if found:
                at, _ = _tag_end(html, found.end())
            elif tag != "title":
                at = n
        else:
            page.start(tag, attributes)
            if attributes.endswith("/") and tag in ("svg", "math") and page.open and page.open[-1].name == tag:
                page.end(tag)
    page.close_block()
    return page.blocks


# --- regions ----------------------------------------------------------------------------------

_MARK = np.uint64(0x9E3779B97F4A7C15)


def region_tokens(blocks: list[Block]) -> dict[int, tuple[np.ndarray, list[int]]]:
    """Per region: token hashes (a mark, then the words of each block) and where its blocks begin."""
    texts: dict[int, list[str]] = {}
    for block in blocks:
        texts.setdefault(block.region, []).append(block.text)
    out = {}
    for region, found in texts.items():
        data = np.frombuffer("\n".join(f". {t}" for t in found).encode("utf-8", "surrogatepass"), np.uint8)
        starts, ends, _ = word_bounds(data, np.array([0, len(data)]))
        hashes = span_hashes(data, starts, ends)
        # Blocks have no line ends of their own, so each line is a mark and a block's words.
        marks = np.searchsorted(starts, np.concatenate([[0], np.flatnonzero(data == 10) + 1]))
        hashes[marks] = _MARK
        out[region] = hashes, marks.tolist()
    return out


def prefix_keys(tokens: np.ndarray, run: int = RUN) -> np.ndarray:
    """Of each suffix the hash of its first ``run`` tokens; a shorter stream has one key for the whole."""
    n = max(1, len(tokens) - run + 1)
    keys = np.full(n, min(run, len(tokens)), np.uint64)
    for k in range(min(run, len(tokens))):
        keys = mix(keys + tokens[k : k + n])
    return keys


def suffix_keys(tokens: np.ndarray, bounds: np.ndarray, hosts: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``prefix_keys`` of many streams at once, joined with the host: the stream, the place in it and the key of each suffix."""
    sizes = np.diff(bounds)
    n = np.maximum(1, sizes - run + 1)
    row = np.repeat(np.arange(len(sizes)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    length, place = np.minimum(run, sizes)[row], bounds[row] + at
    keys = length.astype(np.uint64)
    for k in range(run):
        step = mix(keys + tokens[np.minimum(place + k, len(tokens) - 1)])
        keys = np.where(k < length, step, keys)
    return row, at, mix(keys + hosts[row])


def covered_blocks(n: int, starts: list[int], repeated: list[int], run: int = RUN) -> list[bool]:
    """For each block whether more than half of its tokens lie in repeated runs that begin at the given places."""
    change = np.zeros(n + 1, np.int64)
    for p in repeated:
        change[p] += 1
        change[min(n, p + run)] -= 1
    inside = np.concatenate([[0], np.cumsum(np.cumsum(change[:-1]) > 0)])
    bounds = [*starts, n]
    return [2 * int(inside[b] - inside[a]) > b - a for a, b in zip(bounds, bounds[1:])]


def located(pages: DataFrame) -> DataFrame:
    """page_id, url, html, the host and a hash of host and html, the page's place."""
    html, url = F.coalesce(F.col("html").cast("string"), F.lit("")), F.col("url").cast("string")
    host = F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1)), F.lit(""))
    return pages.select("page_id", url.alias("url"), F.xxhash64(host).alias("host"), F.xxhash64(host, html).alias("loc"), html.alias("html"))


def regions_of(pages: DataFrame) -> DataFrame:
    """The regions of all pages, written: loc, region, host, content, n (tokens) and starts of its blocks; and once for those
    of a batch that are equal: tokens, and the least and greatest page of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            first: dict[tuple[int, int], int] = {}
            pages_of: dict[tuple[int, int], tuple[int, int]] = {}
            for host, loc, html in zip(*(batch.column(k).to_pylist() for k in range(3))):
                for region, (tokens, starts) in region_tokens(blocks_of(html)).items():
                    content = int(mix(np.array([mix(tokens + np.arange(1, len(tokens) + 1, dtype=np.uint64) * _MARK).sum(dtype=np.uint64)], np.uint64))[0].view(np.int64))
                    key = host, content
                    new = key not in first
                    first.setdefault(key, len(rows))
                    lo, hi = pages_of.get(key, (loc, loc))
                    pages_of[key] = min(lo, loc), max(hi, loc)
                    rows.append((loc, region, host, content, len(tokens), starts, tokens.view(np.int64) if new else None))
            if rows:
                loc, region, host, content, n, starts, tokens = zip(*rows)
                held = {at: pages_of[key] for key, at in first.items()}
                lo, hi = ([held[k][i] if k in held else None for k in range(len(rows))] for i in (0, 1))
                long = pa.int64()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(loc, long), pa.array(region, pa.int32()), pa.array(host, long), pa.array(content, long), pa.array(n, pa.int32()), pa.array(starts, pa.list_(pa.int32())), pa.array(tokens, pa.list_(long)), pa.array(lo, long), pa.array(hi, long)],
                    names=["loc", "region", "host", "content", "n", "starts", "tokens", "lo", "hi"],
                )

    schema = "loc long, region int, host long, content long, n int, starts array<int>, tokens array<long>, lo long, hi long"
    return materialize(pages.select("host", "loc", "html").mapInArrow(run, schema), "regions")


def _streams(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of a batch's regions one after another, where each begins (and the last ends), and the regions' hosts."""
    lists = batch.column(batch.schema.get_field_index("tokens"))
    hosts = batch.column(batch.schema.get_field_index("host")).to_numpy(zero_copy_only=False)
    bounds = lists.offsets.to_numpy().astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), bounds - bounds[0], hosts.astype(np.int64).view(np.uint64)


def repeated_keys(regions: DataFrame) -> DataFrame:
    """(key): the suffixes' first tokens that stand on two distinct pages of a host, written.

    Keys and pages go packed: a batch gives one row for each range of keys, and there are as many ranges as the windows need.
    """
    windows = regions.agg(F.sum("n")).first()[0] or 0
    bits = max(RANGE_BITS, (windows // RANGE_KEYS).bit_length())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, _, keys = suffix_keys(*_streams(batch))
            lo, hi = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("lo", "hi"))
            twice = (lo < hi)[row]
            keys, pages = np.concatenate([keys, keys[twice]]), np.concatenate([lo[row], hi[row][twice]])
            order = np.argsort(keys)
            keys, pages = keys[order], pages[order]
            part = keys >> np.uint64(64 - bits)
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(keys)]
            rows = []
            for i, j in zip(cuts, cuts[1:]):
                if i < j:
                    known, at = np.unique(pages[i:j], return_inverse=True)
                    rows.append((int(part[i]), keys[i:j].tobytes(), known.tobytes(), at.astype(np.uint16 if len(known) < 1 << 16 else np.uint32).tobytes()))
            if rows:
                columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "keys", "known", "at"])

    def meet(table: pa.Table) -> pa.Table:
        keys, pages = [], []
        for k, known, at in zip(*(table.column(c).to_pylist() for c in ("keys", "known", "at"))):
            keys.append(np.frombuffer(k, np.uint64))
            width = np.uint16 if len(at) == len(k) // 4 else np.uint32
            pages.append(np.frombuffer(known, np.int64)[np.frombuffer(at, width)])
        keys, pages = np.concatenate(keys), np.concatenate(pages)
        order = np.argsort(keys)
        keys, pages = keys[order], pages[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        found = np.minimum.reduceat(pages, first) < np.maximum.reduceat(pages, first)
        return pa.table({"key": pa.array(keys[first][found].view(np.int64))})

    packed = regions.filter("tokens is not null").select("host", "lo", "hi", "tokens").mapInArrow(pack, "part long, keys binary, known binary, at binary")
    return materialize(packed.groupBy("part").applyInArrow(meet, "key long"), "shared")


def repeated_blocks(regions: DataFrame) -> DataFrame:
    """(host, content, gone): for each block of a distinct region whether its host repeats it."""
    shared = repeated_keys(regions)
    # The filter only thins rows before the exact join.
    packed = regions.sparkSession.sparkContext.broadcast(key_filter(shared, shared.count()))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at, keys = suffix_keys(*_streams(batch))
            held = np.flatnonzero(may_hold(packed.value, keys.view(np.int64)))
            host, content = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)[row[held]] for c in ("host", "content"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(host), pa.array(content), pa.array(at[held].astype(np.int32)), pa.array(keys[held].view(np.int64))], names=["host", "content", "at", "key"]
            )

    # A suffix that many regions begin with is spread over SALTS places.
    salted = shared.withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
    places = regions.filter("tokens is not null").select("host", "content", "tokens").mapInArrow(likely, "host long, content long, at int, key long")
    places = places.withColumn("salt", F.pmod("content", F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"])
    places = places.groupBy("host", "content").agg(F.collect_set("at").alias("places"))

    @F.udf("array<boolean>", useArrow=True)
    def gone(n: int, starts: list[int], found: list[int]) -> list[bool]:
        return covered_blocks(n, list(starts), list(found) if found is not None else [])

    distinct = regions.groupBy("host", "content").agg(F.first("n").alias("n"), F.first("starts").alias("starts"))
    return distinct.join(places, ["host", "content"], "left").select("host", "content", gone("n", "starts", "places").alias("gone"))


# --- texts ------------------------------------------------------------------------------------


class Candidate(NamedTuple):
    """A block that stays if its host does not repeat it; ``region`` -1 stays anyway. ``k``: its place in the region."""

    text: str
    region: int
    k: int


def candidates(blocks: list[Block]) -> list[Candidate]:
    """The blocks that the marks of the page leave, nearest to its article."""
    best = max((b.level for b in blocks if not b.aside), default=OPEN)
    seen: dict[int, int] = {}
    found = []
    for block in blocks:
        k = seen.get(block.region, 0)
        seen[block.region] = k + 1
        if not block.aside and block.level == best and (best == ARTICLE or not block.linked):
            found.append(Candidate(block.text, -1 if best == ARTICLE else block.region, k))
    return found


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars, n_blocks (blocks of the page) and n_repeated (those that its host repeats)."""
    rows = located(pages)
    regions = regions_of(rows)
    verdicts = repeated_blocks(regions).withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
    known = regions.select("loc", "region", "host", "content").withColumn("salt", F.pmod("loc", F.lit(SALTS)).cast("int")).join(verdicts, ["host", "content", "salt"])
    # Equal pages of a host have one place.
    known = known.groupBy("loc").agg(F.collect_set(F.struct("region", "gone")).alias("known"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("text", pa.string()), ("region", pa.int32()), ("k", pa.int32())]))
        for batch in batches:
            pages = [blocks_of(html) for html in batch.column(3).to_pylist()]
            found = pa.array([[b._asdict() for b in candidates(blocks)] for blocks in pages], kind)
            counts = pa.array([len(blocks) for blocks in pages], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), counts, found], names=["page_id", "url", "loc", "n_blocks", "found"])

    ident = dict(pages.dtypes)["page_id"]
    schema = f"page_id {ident}, url string, loc long, n_blocks long, found array<struct<text: string, region: int, k: int>>"
    parsed = rows.select("page_id", "url", "loc", "html").mapInArrow(parse, schema).join(known, "loc", "left")
    gone = F.map_from_entries(F.coalesce("known", F.array().cast("array<struct<region: int, gone: array<boolean>>>")))
    stays = lambda b: (b["region"] < 0) | ~F.get(F.col("_gone")[b["region"]], b["k"])
    text = F.array_join(F.transform(F.filter("found", stays), lambda b: b["text"]), "\n")
    repeated = F.filter(F.flatten(F.map_values("_gone")), lambda x: x)
    found = parsed.withColumn("_gone", gone).withColumn("text", text)
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks", F.size(repeated).cast("long").alias("n_repeated"))
