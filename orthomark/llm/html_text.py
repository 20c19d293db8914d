"""Main text of web pages, with boilerplate found by a suffix array over the pages of a host.

1. A page is read once into runs of text with a zone: inside an article, inside the main element,
   page furniture (menus, headers, footers, sidebars, notices, adverts, forms, reader comments, told
   by element, role or class), or neither. Scripts, styles and markup vanish.
2. The pages of a host come together in shards of about ``SHARD`` pages, so that a host of any size
   spreads over many tasks. In a host of one shard the tokens outside of articles, one stream a page,
   are concatenated with a mark of its own after each page and their suffixes sorted by prefix
   doubling, up to ``RUN`` tokens. Suffixes that stand together in the suffix array with equal first
   ``RUN`` tokens and come from enough distinct streams (``enough``) are repeated. A block that such
   runs cover whole is boilerplate, and so is what a run inside of one block covers. Shorter repeats
   count only as whole blocks: a block of at least ``LEAST`` tokens, or the fewest whole blocks side
   by side that have as many, are boilerplate if enough distinct streams hold them as such. Of a host of
   many shards the distinct streams of runs and blocks are counted over the whole host, by 64-bit
   codes, and each shard gets back the repeated ones it holds; that is the same set.
3. The main text is the article if the page has one, else the main element, else the unique runs
   outside of furniture: what no repeated substring covers. Where unique runs of ``LONG`` tokens or more
   inside of blocks outside of furniture have more tokens than the article (or main element), that is a
   teaser, and these runs belong to the main text as well, in page order. Text of an article is never
   removed, however often it occurs elsewhere.

Defined results: a null or empty page has an empty text; repeated rows count as one stream and are
extracted alike; pages without a url form a host of their own.
"""

from __future__ import annotations

import hashlib
import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthomark.llm import words as W
from orthomark.llm.labelled import with_marks
from orthomark.operators.walk import arranged, whole_groups
from orthomark.session import cut_lineage

SHARD, RUN, LEAST, LONG = 512, 32, 6, 20
#: Repeated is what PAGES distinct streams and a SHARE of those of the host hold, or MANY streams of a host of any size.
PAGES, SHARE, MANY = 3, 0.01, 100
#: White space like any other for the main text.
BLOCK = "\x1e"
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|iframe|svg|select|object|canvas)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE)
#: Elements that do not separate words.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
FURNITURE = frozenset("nav footer aside form menu dialog button fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)
#: A part of a class name, between - and _, that marks furniture, and whole names that do.
PARTS = frozenset("ad ads advert advertisement adverts advertising sponsor sponsored promo cookie cookies consent sidebar comment comments "
                  "breadcrumb breadcrumbs newsletter related share sharing social popup modal subscribe disqus".split())
NAMES = frozenset("nav navbar navigation menu header footer notice notices banner login search widget masthead toolbar".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())


def is_furniture(attributes: str) -> bool:
    for name, *values in ATTRIBUTE.findall(attributes):
        value, name = "".join(values).lower(), name.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in ROLES:
            return True
        if name in ("class", "id"):
            for word in value.split():
                if word in NAMES or not PARTS.isdisjoint(re.split("[-_]+", word)):
                    return True
                if re.fullmatch(r"(?:site|page|main|top|global)[-_](?:header|footer|menu|nav|navigation|banner)", word):
                    return True
    return False


def read_page(source: str) -> list[tuple[str, str]]:
    """(zone, text) runs in page order: a article, m main, f furniture, n neither. Block ends are marked by
    BLOCK, inline elements leave nothing."""
    runs: list[tuple[str, str]] = []
    skipped: str | None = None  # element that began the furniture being read
    depth = articles = mains = at = 0

    def put(text: str) -> None:
        if text:
            zone = "f" if skipped else "a" if articles else "m" if mains else "n"
            if runs and runs[-1][0] == zone:
                runs[-1] = (zone, runs[-1][1] + text)
            else:
                runs.append((zone, text))

    head = re.search(r"<head\b[^>]*>.*?(?:</head\s*>|(?=<body\b))", source, re.DOTALL | re.IGNORECASE)
    if head:
        source = source[:head.start()] + source[head.end():]
    for tag in TAG.finditer(source):
        if tag.start() > at:
            put(html.unescape(source[at:tag.start()]).replace(BLOCK, " "))
        at = tag.end()
        name = (tag["name"] or tag["name2"] or "").lower()
        if not name:
            if tag["raw"]:
                put(BLOCK)
            continue
        closing = bool(tag["end"] or tag["end2"])
        if name not in INLINE:
            put(BLOCK)
        if skipped:
            if name == "article" and not closing and not is_furniture(tag["rest"] or tag["rest2"] or "") and skipped != "article" and not articles:
                skipped = None  # an article ends furniture that was never closed
            elif name == skipped and name not in VOID:
                depth += -1 if closing else 1
                if not depth:
                    skipped = None
                continue
            else:
                continue
        if closing:
            if name == "article" and articles:
                articles -= 1
            elif name == "main" and mains:
                mains -= 1
            continue
        rest = tag["rest"] or tag["rest2"] or ""
        if name in VOID or rest.endswith("/") and name not in ("article", "main"):
            continue
        if name in FURNITURE or name == "header" and not articles or ("=" in rest or "hidden" in rest) and name not in ("body", "html", "main") and is_furniture(rest):
            skipped, depth = name, 1
        elif name == "article":
            articles += 1
        elif name == "main":
            mains += 1
    if at < len(source):
        put(html.unescape(source[at:]).replace(BLOCK, " "))
    return runs


def enough(streams: int) -> int:
    """Of how many distinct streams a host has, how many must hold a repeated passage."""
    return min(max(PAGES, math.ceil(SHARE * streams)), max(PAGES, MANY))


def repeated(streams: list[list[list[str]]]) -> list[np.ndarray]:
    """For every page, given as its blocks of tokens, which tokens repeated runs of ``RUN`` tokens make
    boilerplate."""
    whole: dict[tuple, int] = {}
    owner = [whole.setdefault(tuple(map(tuple, s)), len(whole)) for s in streams]
    distinct = list(whole)
    codes: dict[str, int] = {}
    values, blocks, ends, block = [], [], [], 0
    for k, stream in enumerate(distinct):
        for tokens in stream:
            values.extend(codes.setdefault(t, len(codes)) for t in tokens)
            blocks.extend([block] * len(tokens))
            block += 1
        values.append(-1 - k)  # a mark that occurs once
        blocks.append(block)
        block += 1
        ends.append(len(values))
    text, block_of = np.array(values, np.int64), np.array(blocks, np.int64)
    page = np.repeat(np.arange(len(distinct)), np.diff([0, *ends]))
    rank = np.unique(text, return_inverse=True)[1]
    length = 1
    while length < RUN and len(text):  # ranks of the first `length` tokens of every suffix, doubled
        step = min(length, RUN - length)
        after = np.concatenate([rank[step:], np.full(min(step, len(rank)), -1)])[:len(rank)] + 1
        rank = np.unique(rank * (len(rank) + 2) + after, return_inverse=True)[1]
        length += step
    array = np.lexsort((page, rank))  # the suffix array, equal suffixes by page
    start = np.zeros(0, np.int64)
    if len(array):
        fresh_rank = np.concatenate([[True], np.diff(rank[array]) > 0])
        fresh_page = fresh_rank | np.concatenate([[True], np.diff(page[array]) > 0])
        group = np.cumsum(fresh_rank) - 1
        start = array[np.bincount(group, fresh_page)[group] >= enough(len(distinct))]
        start = start[start + RUN <= len(text)]

    marked = mark(start, block_of)
    parts = [marked[b - sum(map(len, s)) - 1:b - 1] for s, b in zip(distinct, ends)]
    return [parts[o] for o in owner]


def mark(start: np.ndarray, block_of: np.ndarray) -> np.ndarray:
    """Which tokens repeated runs from ``start`` on make boilerplate; ``block_of`` has the block of every token."""
    def covered(starts: np.ndarray) -> np.ndarray:
        change = np.bincount(starts, minlength=len(block_of) + 1) - np.bincount(starts + RUN, minlength=len(block_of) + 1)
        return np.cumsum(change[:len(block_of)]) > 0

    inside, anywhere = covered(start[block_of[start] == block_of[start + RUN - 1]]), covered(start)
    left = np.bincount(block_of[~anywhere], minlength=block_of.max(initial=0) + 1)
    return inside | (anywhere & (left[block_of] == 0))


class Runs:
    """Codes of the passages of some pages, each given as its blocks of tokens: the runs of ``RUN`` tokens, and
    the fewest whole blocks side by side, from and up to every block, that have ``LEAST`` tokens."""

    def __init__(self, streams: list[list[list[str]]]):
        tokens = [t for s in streams for block in s for t in block]
        sizes = [sum(map(len, s)) for s in streams]
        lengths = [len(block) for s in streams for block in s]
        self.bounds = np.cumsum([0, *sizes])
        self.block_of = np.repeat(np.arange(len(lengths)), lengths)
        page = np.repeat(np.arange(len(streams)), sizes)
        values = pd.util.hash_array(np.array(tokens, object)) if tokens else np.zeros(0, W.U64)
        codes, self.start = W.windows(values, page, RUN)
        edges = np.unique(np.cumsum([0, *lengths]))  # of blocks that have tokens
        first, last = edges[:-1], edges[1:]
        if len(first):
            to = np.searchsorted(last, first + LEAST)
            ahead = to < len(last)
            since = np.searchsorted(first, last - LEAST, side="right") - 1
            behind = since >= 0
            spans = np.unique(np.concatenate([np.stack([first[ahead], last[to[ahead]]], axis=1), np.stack([first[since[behind]], last[behind]], axis=1)]), axis=0)
            spans = spans[page[spans[:, 0]] == page[spans[:, 1] - 1]]
        else:
            spans = np.zeros((0, 2), np.int64)
        self.begin, self.end = spans[:, 0], spans[:, 1]
        sums = np.zeros(len(values) + 1, W.U64)
        np.cumsum(values * W._powers(W._P, len(values) + 1)[:-1], out=sums[1:])
        whole = (sums[self.end] - sums[self.begin]) * W._powers(W._P_INVERSE, len(values) + 1)[self.begin]
        # Blocks and runs are counted apart.
        blocks = W.mix(W.mix(whole) + (self.end - self.begin).astype(W.U64) + W.U64(1 << 32))
        self.run_codes, self.block_codes = codes.view(np.int64), blocks.view(np.int64)
        self.codes = np.concatenate([self.run_codes, self.block_codes])
        at = np.concatenate([self.start, self.begin])
        self.page = page[at] if len(page) else at

    def of_pages(self) -> list[np.ndarray]:
        """The distinct codes of every page."""
        order = np.argsort(self.page, kind="stable")
        cuts = np.searchsorted(self.page[order], np.arange(len(self.bounds)))
        return [np.unique(self.codes[order[a:b]]) for a, b in zip(cuts[:-1], cuts[1:])]

    def _split(self, marked: np.ndarray) -> list[np.ndarray]:
        return [marked[a:b] for a, b in zip(self.bounds[:-1], self.bounds[1:])]

    def run_marks(self, kept: np.ndarray) -> list[np.ndarray]:
        """What repeated() returns, where the runs with codes ``kept`` are the repeated ones."""
        return self._split(mark(self.start[np.isin(self.run_codes, kept)], self.block_of))

    def block_marks(self, kept: np.ndarray) -> list[np.ndarray]:
        """For every page, which tokens are in whole blocks with codes ``kept``."""
        own, n = np.isin(self.block_codes, kept), int(self.bounds[-1])
        change = np.bincount(self.begin[own], minlength=n + 1) - np.bincount(self.end[own], minlength=n + 1)
        return self._split(np.cumsum(change[:n]) > 0)


def boilerplate(streams: list[list[list[str]]], kept: np.ndarray | None = None) -> list[np.ndarray]:
    """For every page which tokens are boilerplate: by the ``kept`` codes of a larger host, else as counted in
    these pages, which are the whole host."""
    found = Runs(streams)
    if kept is not None:
        runs = found.run_marks(kept)
    else:
        distinct = {stream_code(s): codes for s, codes in zip(streams, found.of_pages())}
        codes, n = np.unique(np.concatenate([np.zeros(0, np.int64), *distinct.values()]), return_counts=True)
        runs, kept = repeated(streams), codes[n >= enough(len(distinct))]
    return [a | b for a, b in zip(runs, found.block_marks(kept))]


def outside_of(runs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The runs of a page with those of articles blanked."""
    return [(z if z != "a" else "f", t if z != "a" else "") for z, t in runs]


def blocks_of(runs: list[tuple[str, str]]) -> list[list[str]]:
    return [b.split() for _, t in runs for b in t.split(BLOCK)]


def stream_code(blocks: list[list[str]]) -> int:
    whole = BLOCK.join(" ".join(b) for b in blocks)
    return int.from_bytes(hashlib.blake2b(whole.encode(errors="replace"), digest_size=8).digest(), "little", signed=True)


def shared_runs(pages: DataFrame) -> DataFrame:
    """(host, shard, kept): codes of the passages in a shard that enough distinct streams of its host hold,
    from rows (host, shard, html). Only codes are moved; one that all pages share is added up in every
    task first."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[str, int, int]] = set()
        for frame in batches:
            for at in range(0, len(frame), 256):
                rows, streams = [], []
                for host, shard, source in frame[["host", "shard", "html"]].iloc[at:at + 256].itertuples(index=False):
                    blocks = blocks_of(outside_of(read_page(source))) if isinstance(source, str) else []
                    row = (host, shard, stream_code(blocks))
                    if row not in seen:
                        seen.add(row)
                        rows.append(row)
                        streams.append(blocks)
                yield pd.DataFrame(rows, columns=["host", "shard", "stream"]).assign(runs=Runs(streams).of_pages())

    found = pages.mapInPandas(read, "host string, shard int, stream long, runs array<long>")
    # Copies of one stream in many shards count once.
    streams = cut_lineage(found.groupBy("host", "stream").agg(F.first("runs").alias("runs"), F.collect_set("shard").alias("shards")))
    listed = streams.select("host", "shards", F.explode("runs").alias("run"))
    least = F.least(F.greatest(F.lit(PAGES), F.ceil(F.count("*") * SHARE)), F.lit(max(PAGES, MANY)))
    hosts = cut_lineage(streams.groupBy("host").agg(least.alias("least")))
    counted = with_marks(listed.groupBy("host", "run").agg(F.count("*").alias("n")).filter(F.col("n") >= PAGES), hosts, "host")
    kept = cut_lineage(counted.filter("n >= least").select("host", "run", F.lit(True).alias("repeated")))
    held = with_marks(listed, kept, ["host", "run"]).filter("repeated").select("host", F.explode("shards").alias("shard"), "run")
    return held.groupBy("host", "shard").agg(F.collect_set("run").alias("kept"))


def unique_runs(text: str, covered: np.ndarray) -> list[list[str]]:
    """Tokens of every uncovered stretch inside of one block."""
    out, at = [], 0
    for block in text.split(BLOCK):
        tokens = block.split()
        edges = np.flatnonzero(np.diff(np.concatenate([[True], covered[at:at + len(tokens)], [True]]).astype(np.int8)))
        out.extend(tokens[s:e] for s, e in zip(edges[0::2], edges[1::2]))
        at += len(tokens)
    return out


def main_text(runs: list[tuple[str, str]], covered: np.ndarray) -> str:
    """The article, else the main element, with longer unique runs around a teaser; else the uncovered tokens
    outside of furniture. ``covered`` counts the tokens outside of articles."""
    unique, at = [], 0
    for zone, text in runs:
        n = 0 if zone == "a" else len(text.split())
        unique.append(unique_runs(text, covered[at:at + n]) if zone in "mn" else [])
        at += n
    for zone, around in (("a", "mn"), ("m", "n")):
        parts = [text.split() if z == zone else [] for z, text in runs]
        own = sum(map(len, parts))
        if own:
            long = [[t for run in found if len(run) >= LONG for t in run] if z in around else [] for (z, _), found in zip(runs, unique)]
            teaser = sum(map(len, long)) > own
            return " ".join(t for part, rest in zip(parts, long) for t in (part or (rest if teaser else [])))
    return " ".join(t for (z, _), found in zip(runs, unique) if z == "n" for run in found for t in run)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_repeated) of every row of ``pages`` (page_id, url, html); n_repeated
    counts the tokens outside of articles that boilerplate covers."""
    host = F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit(""))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), F.lower(host).alias("host"))
    # Only hosts of more than one shard are listed.
    large = cut_lineage(keyed.groupBy("host").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards")).filter("shards > 1"))
    shard = F.pmod(F.xxhash64("page_id", "url"), F.coalesce("shards", F.lit(1))).cast("int")
    placed = with_marks(keyed, large, "host").select("host", shard.alias("shard"), F.col("shards").isNotNull().alias("large"), "page_id", "url", "html")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            runs = [read_page(h) if isinstance(h, str) else [] for h in frame["html"]]
            yield frame.drop(columns="html").assign(zones=["".join(z for z, _ in r) for r in runs], texts=[[t for _, t in r] for r in runs])

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, starts in whole_groups(batches, ["host", "shard"]):
            texts, counts = [], []
            for s, e in zip(starts[:-1], starts[1:]):
                group = frame.iloc[s:e]
                kept = [k for k in group["kept"] if k is not None]
                group = group[group["zones"].notna()]
                runs = [list(zip(z, t)) for z, t in zip(group["zones"], group["texts"])]
                streams = [blocks_of(outside_of(r)) for r in runs]
                covered = boilerplate(streams, np.concatenate([np.zeros(0, np.int64), *kept]) if group["large"].any() else None)
                for page, marks in zip(runs, covered):
                    texts.append(main_text(page, marks))
                    counts.append(int(marks.sum()))
            pages = frame[frame["zones"].notna()]
            yield pd.DataFrame({"page_id": pages["page_id"].array, "url": pages["url"].array, "text": texts, "n_chars": [len(t) for t in texts], "n_repeated": counts})

    parsed = placed.mapInPandas(read, "host string, shard int, large boolean, page_id long, url string, zones string, texts array<string>")
    known = shared_runs(placed.filter("large").select("host", "shard", "html"))
    everything = parsed.unionByName(known, allowMissingColumns=True)
    return arranged(everything, ["host", "shard"], [F.col("page_id")]).mapInPandas(judge, "page_id long, url string, text string, n_chars long, n_repeated long")
