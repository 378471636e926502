"""Main text of web pages: blocks by markup, and runs that pages of a host repeat by suffix arrays.

HTML says of some blocks what they are: text in an article or main element belongs to the page, text in
nav, footer, aside, form and the like does not. All other visible blocks are open: the token streams of
the distinct pages of a host, made of their open blocks, go into suffix arrays, and blocks that runs
repeated on two or more pages cover are boilerplate. Class and id names alone settle a block only where
they say nothing else (``ad-slot``, ``comment-list``); a name with other words in it (``related-work``)
needs a second sign: repetition, or text that is mostly links.
"""

from __future__ import annotations

import html
import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fmindex import suffix_order
from .shared import SPACE_SEPARATED, Block, PrefixHash, map_texts, materialise
from .urls import host_of

#: Bytes of token streams that one suffix array holds; results do not depend on it.
SHARD_BYTES = 1 << 19
#: Words that a run must have to count as repeated, and the share of a block that such runs must cover.
MIN_RUN = 6
MIN_COVER = 0.8
#: So many blocks of links in a row are a menu, where markup is silent.
MENU_BLOCKS = 3

# Fixed element names of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span"
    " strike strong sub sup time tt u var img wbr nobr br"
    " math mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mstyle mspace mpadded mphantom"
    " menclose mtable mtr mtd semantics svg g text tspan path circle rect line polyline polygon ellipse defs use symbol".split()
)
#: Inline elements that part words.
SPACED = set("br img mtr mtd text tspan".split())
RAW = "script|style|noscript|template|iframe|object|canvas|audio|video|textarea|select|title|xmp|annotation-xml|annotation"
BOILERPLATE = set("nav footer aside form menu dialog button fieldset head".split())
HINTS = set(
    "ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored nav navbar navigation menu"
    " breadcrumb breadcrumbs footer sidebar widget widgets comment comments commentlist disqus reply replies respond cookie"
    " cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share"
    " sharing social related recommended toolbar pagination pager masthead skip".split()
)
#: Words of names that say where or in what form something stands; with only these beside it, a hint is a plain statement.
NEUTRAL = set(
    "area article articles bar block blog body bottom box button buttons btn col column container desktop entry first fixed"
    " float global group head header holder hidden icons inner item items js large last layer left link links list main middle"
    " mobile outer page pane panel post posts primary reader region right row secondary section site slot small sticky stories"
    " story text title top unit user visible wrap wrapper zone".split()
)
HEADER_HINTS = {"header", "topbar"}
ROLES = set("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
MAIN_HINTS = {"article", "post", "entry", "story", "content", "main"}
MAIN_NAMES = {"articlebody", "article-body", "post-content", "entry-content", "main-content", "article-content", "post-body"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<({RAW})(?=[\s/>])[^<>]*>.*?(?:</\1\s*>|\Z)"
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^"'<>]|"[^"<]*"|'[^'<]*')*+[^<>]*)>""",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: Names such as has-sidebar say what else the page has.
_ABOUT_OTHERS = re.compile(r"\b(?:has|with|no|without|is)[-_][a-z0-9]+")

#: What is known of a block: nothing, a container named like the main part, an article or main element, a
#: container named like boilerplate, or an element that is no part of the text.
PLAIN, NAMED, MAIN, HINTED, OUT = range(5)
_HEADER = 5
_zones: dict[tuple[str, str], tuple[int, bool]] = {}


def _zone(name: str, attributes: str) -> tuple[int, bool]:
    """What an element says of itself, and whether a name in it only hints at boilerplate.

    A header (_HEADER) is out unless it stands in a main part.
    """
    if name in BOILERPLATE:
        return OUT, False
    found = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
    if "hidden" in found or found.get("aria-hidden") == "true" or _HIDDEN.search(found.get("style", "")):
        return OUT, False
    if found.get("role") in ROLES:
        return OUT, False
    names = f"{found.get('class', '')} {found.get('id', '')}".split()
    words = [set(re.split(r"[^a-z0-9]+", _ABOUT_OTHERS.sub(" ", n))) - {""} for n in names]
    hinted = [w for w in words if w & HINTS]
    plainly = any(all(x in HINTS or x in NEUTRAL or x.isdigit() for x in w) for w in hinted)
    if name in ("article", "main") or found.get("role") in ("main", "article") or found.get("itemprop") == "articlebody":
        return (HINTED, False) if plainly else (MAIN, bool(hinted))
    if name == "body" or name == "html":
        return PLAIN, False
    if plainly:
        return HINTED, False
    if name == "header" or any(w & HEADER_HINTS for w in words):
        return _HEADER, bool(hinted)
    named = any(w & MAIN_HINTS for w in words) or set(names) & MAIN_NAMES
    return (NAMED if named and not hinted else PLAIN), bool(hinted)


#: A block: zone, under a name that hints at boilerplate, mostly links, text.
PageBlock = tuple[int, bool, bool, str]


def blocks_of(page: str) -> list[PageBlock]:
    """All blocks with text, in page order, but those of elements that are no part of the text.

    Scripts, styles, comments and controls are no text. Block elements and ends of them divide blocks; inline
    elements and line breaks do not. Elements that stay open end with their parent or as HTML implies.
    """
    out: list[PageBlock] = []
    # Open elements with what is known within each, and where in the stack elements of a name stand.
    stack: list[tuple[str, int, bool]] = [("", PLAIN, False)]
    places: dict[str, list[int]] = {}
    parts: list[str] = []
    in_link, linked = False, 0

    def close() -> None:
        nonlocal linked
        if parts:
            _, zone, hint = stack[-1]
            if zone != OUT:
                raw = "".join(parts)
                text = " ".join(html.unescape(raw).split())
                if text:
                    out.append((zone, hint, 2 * linked >= len(raw.strip()), text))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if in_link:
            linked += len(text)

    def end(names: tuple[str, ...], within: tuple[str, ...] = ()) -> None:
        at = max([places[n][-1] for n in names if places.get(n)], default=0)
        if not at or any(places[w][-1] > at for w in within if places.get(w)):
            return
        for name, _, _ in stack[at:]:
            places[name].pop()
        del stack[at:]

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if name in INLINE:
            if name == "a":
                in_link = not m[2]
            elif name in SPACED:
                parts.append(" ")
            continue
        close()
        if m[2]:
            end((name,), ("article", "main", "body") if name == "p" else ())
            continue
        if name in ("li", "dt", "dd", "tr", "td", "th", "option"):
            end(("dt", "dd") if name in ("dt", "dd") else ("td", "th") if name in ("td", "th") else (name,), ("ul", "ol", "dl", "table", "div"))
        else:
            end(("p",), ("div", "li", "td", "blockquote", "section", "article", "main", "nav", "aside", "footer", "header", "form"))
        if name in VOID or m[4].rstrip().endswith("/"):
            continue
        key = (name, m[4])
        known = _zones.get(key)
        if known is None:
            if len(_zones) > 50_000:
                _zones.clear()
            known = _zones[key] = _zone(name, m[4])
        _, around, hint = stack[-1]
        zone = known[0]
        if zone == _HEADER:
            zone = around if around in (MAIN, NAMED) else OUT
        places.setdefault(name, []).append(len(stack))
        stack.append((name, max(around, zone), hint or known[1]))
    tail = page[at:]
    if tail:
        # A tag that the page breaks off in is no text.
        cut = re.search(r"<[/a-zA-Z!?][^>]*\Z", tail)
        add(tail[: cut.start()] if cut else tail)
    close()
    return out


def is_open(block: PageBlock) -> bool:
    """Whether elements leave it open what the block is."""
    return block[0] != MAIN or block[1]


def undecided(blocks: list[PageBlock]) -> bool:
    """Whether the text of the page depends on repetition."""
    if any(zone == MAIN for zone, *_ in blocks):
        return any(hint for zone, hint, *_ in blocks if zone == MAIN)
    return any(zone != HINTED for zone, *_ in blocks)


def main_text(blocks: list[PageBlock], repeated: list[bool]) -> str:
    """The article; ``repeated`` says of every block whether pages of the host repeat it.

    Blocks in article or main elements are the text. Where there are none, all blocks that nothing speaks
    against are, or those in containers named like the main part, if they hold most of the words.
    """
    menu = [False] * len(blocks)
    run = 0
    for i, (_, _, linked, _) in enumerate([*blocks, (PLAIN, False, False, "")]):
        if linked:
            run += 1
            continue
        if run >= MENU_BLOCKS:
            menu[i - run : i] = [True] * run
        run = 0
    main = any(zone == MAIN for zone, *_ in blocks)
    kept = []
    for (zone, hint, linked, text), again, listed in zip(blocks, repeated, menu):
        if zone == HINTED or main and zone != MAIN:
            continue
        against = hint and (again or linked) if zone == MAIN else again or listed or hint and linked
        if not against:
            kept.append((zone, text))
    named = [text for zone, text in kept if zone == NAMED]
    plain = [text for zone, text in kept if zone == PLAIN]
    if named and sum(len(t.split()) for t in named) >= sum(len(t.split()) for t in plain):
        return "\n\n".join(named)
    return "\n\n".join(text for _, text in kept)


class Streams:
    """Suffix array over the token streams of pages, each a list of blocks (UTF-8).

    Suffixes that share their first ``min_run`` words, none of them in another page, are a group; its
    hash is that of the words and so the same in every suffix array.
    """

    def __init__(self, pages: list[list[bytes]], min_run: int = MIN_RUN):
        self.pages, self.min_run = pages, min_run
        self.block = block = Block([b for page in pages for b in page], SPACE_SEPARATED, lower=True)
        self.starts, self.group = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.hashes, self.several = np.zeros(0, np.uint64), np.zeros(0, bool)
        n = len(block.word_starts)
        if n < min_run:
            return
        page_of = np.repeat(np.arange(len(pages)), [len(p) for p in pages])
        values = PrefixHash(block.raw).spans(block.word_starts, block.word_ends)
        words = np.unique(values, return_inverse=True)[1].reshape(-1) + 1
        owner = page_of[block.word_text()]
        breaks = np.flatnonzero(np.diff(owner)) + 1
        text = np.insert(words, np.concatenate((breaks, [n])), 0)
        word = np.insert(np.arange(n), np.concatenate((breaks, [n])), -1)
        order = suffix_order(text)
        zeros = np.cumsum(np.concatenate(([0], text == 0)))
        order = order[order + min_run <= len(text)]
        starts = word[order[zeros[order + min_run] == zeros[order]]]
        if not len(starts):
            return
        runs = PrefixHash(values).spans(starts, starts + min_run)
        first = np.concatenate(([True], runs[1:] != runs[:-1]))
        head = np.flatnonzero(first)
        pages_at = owner[starts]
        self.starts, self.group, self.hashes = starts, np.cumsum(first) - 1, runs[head]
        self.several = np.minimum.reduceat(pages_at, head) != np.maximum.reduceat(pages_at, head)

    def repeated(self, elsewhere: np.ndarray | None = None) -> list[list[tuple[int, int]]]:
        """(words, words in repeated runs) of each block of each page.

        Runs on several pages here, and runs whose hash is in ``elsewhere``, cover all their occurrences,
        so that every repeated run of the least length or more is covered from end to end.
        """
        known = self.several if elsewhere is None else self.several | np.isin(self.hashes, elsewhere)
        starts = self.starts[known[self.group]] if len(self.starts) else self.starts
        edge = np.zeros(len(self.block.word_starts) + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + self.min_run, -1)
        hits = self.block.per_words(np.cumsum(edge[:-1]) > 0)
        pairs = list(zip(self.block.n_words.tolist(), hits.tolist()))
        bounds = np.cumsum([0] + [len(p) for p in self.pages])
        return [pairs[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def _pack(blocks: list[PageBlock]) -> bytes:
    # Texts of blocks hold no line feed.
    return zlib.compress("\n".join(f"{z}{int(h)}{int(k)}{t}" for z, h, k, t in blocks).encode("utf-8", "replace"), 1)


def _unpack(raw: bytes) -> list[PageBlock]:
    return [(int(x[0]), x[1] == "1", x[2] == "1", x[3:]) for x in zlib.decompress(raw).decode().split("\n")]


def _parse(batches):
    kinds = {"text": pa.string(), "page": pa.binary(), "stream": pa.binary(), "stream_bytes": pa.int64(), "blocks": pa.binary()}
    for batch in batches:
        found: dict[str, list] = {k: [] for k in kinds}
        for page in batch.column(batch.schema.get_field_index("html")):
            blocks = blocks_of(page.as_py() or "")
            stream = "\n".join(b[3] for b in blocks if is_open(b)).encode("utf-8", "replace")
            open_ = undecided(blocks)
            found["text"].append(None if open_ else main_text(blocks, [False] * len(blocks)))
            found["page"].append(xxhash.xxh3_128_digest(stream) if stream else None)
            found["stream"].append(zlib.compress(stream, 1) if stream else None)
            found["stream_bytes"].append(len(stream))
            found["blocks"].append(_pack(blocks) if open_ else None)
        rest = batch.drop_columns(["html"])
        columns = [pa.array(found[k], kind) for k, kind in kinds.items()]
        yield pa.RecordBatch.from_arrays([*rest.columns, *columns], [*rest.schema.names, *kinds])


def _streams(table: pa.Table) -> Streams:
    return Streams([zlib.decompress(x).split(b"\n") for x in table.column("stream").to_pylist()])


def _runs(table: pa.Table) -> pa.Table:
    runs = np.unique(_streams(table).hashes).view(np.int64)
    return pa.table({"host": [table.column("host")[0].as_py()] * len(runs), "shard": pa.array([table.column("shard")[0].as_py()] * len(runs), pa.int32()), "run": runs})


def _judge(table: pa.Table, elsewhere: pa.Table) -> pa.Table:
    if not table.num_rows:
        return pa.table({"host": pa.array([], pa.string()), "page": pa.array([], pa.binary()), "covered": pa.array([], pa.list_(pa.bool_()))})
    found = _streams(table).repeated(elsewhere.column("run").to_numpy().view(np.uint64))
    covered = [[hit >= MIN_COVER * n for n, hit in page] for page in found]
    return pa.table({"host": table.column("host"), "page": table.column("page"), "covered": pa.array(covered, pa.list_(pa.bool_()))})


def _decide(batches):
    for batch in batches:
        texts = []
        for raw, covered in zip(batch.column(batch.schema.get_field_index("blocks")), batch.column(batch.schema.get_field_index("covered"))):
            blocks, verdicts = _unpack(raw.as_py()), iter(covered.as_py())
            texts.append(main_text(blocks, [next(verdicts) if is_open(b) else False for b in blocks]))
        yield pa.RecordBatch.from_arrays([*batch.select(["page_id", "url"]).columns, pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """page_id, url, text and by_repetition of every row of ``pages``.

    by_repetition tells whether markup left anything open. A null html is empty and has the empty text;
    rows without a host (null urls too) form a host; equal rows get equal results; an empty table gives
    none; a very long page is taken whole; other columns are not read.

    Pages of a host with the same open blocks count once. Hosts whose streams exceed ``shard_bytes`` are dealt by
    a hash into shards with a suffix array each. Every shard of such a host sends the hashes of its distinct
    runs, those found in two shards or more are handed back, and so a run on any two pages of a host is
    found whatever its size. Only open blocks are shuffled, and the packed blocks of undecided pages.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host_of(F.col("url")).alias("host"), "html")
    schema = "page_id long, url string, host string, text string, page binary, stream binary, stream_bytes long, blocks binary"
    parsed = materialise(map_texts(rows, _parse, schema), "page-blocks")
    distinct = parsed.filter("page is not null").groupBy("host", "page").agg(F.first("stream").alias("stream"), F.first("stream_bytes").alias("bytes"))
    distinct = materialise(distinct, "page-streams")
    hosts = distinct.groupBy("host").agg(F.ceil(F.sum("bytes") / shard_bytes).cast("int").alias("shards"))
    large = materialise(hosts.filter("shards > 1"), "large-hosts")
    dealt = distinct.join(large, "host", "left").select(
        "host", "page", "stream", "shards", F.pmod(F.xxhash64("page"), F.coalesce("shards", F.lit(1))).cast("int").alias("shard")
    )
    runs = dealt.filter("shards > 1").groupBy("host", "shard").applyInArrow(_runs, "host string, shard int, run long")
    runs = materialise(runs, "page-runs")
    several = runs.groupBy("host", "run").agg(F.count("*").alias("n")).filter("n > 1")
    told = runs.join(several, ["host", "run"], "left_semi")
    verdicts = dealt.groupBy("host", "shard").cogroup(told.groupBy("host", "shard")).applyInArrow(
        _judge, "host string, page binary, covered array<boolean>"
    )
    open_ = parsed.filter("blocks is not null").select("page_id", "url", "host", "page", "blocks")
    open_ = map_texts(open_.join(verdicts, ["host", "page"]).select("page_id", "url", "blocks", "covered"), _decide, "page_id long, url string, text string")
    settled = parsed.filter("blocks is null").select("page_id", "url", "text", F.lit(False).alias("by_repetition"))
    return settled.union(open_.withColumn("by_repetition", F.lit(True)))


def op7(pages: DataFrame) -> DataFrame:
    """The columns of the extraction contract."""
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
