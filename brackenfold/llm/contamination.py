"""Evaluation items that leaked into training text.

Pigeonhole edit matching: an item is cut into segments with an error budget; a
segment within the budget holds at least one of its budget-plus-one pieces
exactly, so only documents with exact piece hits are looked at, and the
segments around the hits are verified with Myers' bit-parallel distance.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
import uuid
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens of a piece, pieces of a segment. The error budget is pieces - 1 tokens a segment.
PIECE, PIECES = 3, 4
#: Code points of item text that one pass over the documents holds in memory.
BLOCK_CHARS = 16_000_000

TAG = re.compile(r"</?[a-zA-Z!][^<>]{0,300}>")
ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})|\\([nrt\"'/\\])")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
BREAK = re.compile(r"(?<=[^\W\d_])[-‐]\s*\n\s*(?=[^\W\d_])|[­​-‍⁠﻿]")
#: A token is a run of letters and digits, or one character of a script written without spaces.
TOKEN = re.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿]|[^\\W_฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿]+")


def tokens(text: str) -> list[str]:
    """Without case, punctuation, spacing, markup and escapes."""
    if "\\" in text:
        text = ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else {"n": "\n", "r": "\n", "t": " "}.get(m[3], m[3]), text)
    if "&" in text:
        text = html.unescape(text)
    if "%" in text:
        text = PERCENT.sub(lambda m: bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace"), text)
    if "<" in text:
        text = TAG.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return TOKEN.findall(BREAK.sub("", text).casefold())


def myers(pattern: list[str], text: list[str]) -> tuple[int, int]:
    """(distance, end): the least edit distance of pattern to a part of text, and where that part ends."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, t in enumerate(pattern):
        peq[t] = peq.get(t, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, (m, 0)
    for j, t in enumerate(text):
        eq = peq.get(t, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
        if score < best[0]:
            best = (score, j + 1)
    return best


class Items:
    """Test items by their pieces."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.tokens, self.weight, self.total, self.segments = {}, {}, {}, {}
        self.grams: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
        #: items too short for a piece, whole
        self.short: dict[tuple, list[int]] = defaultdict(list)
        for item, text in rows:
            t = tokens(text or "")
            if len(t) < PIECE:
                if t:
                    self.short[tuple(t)].append(item)
                continue
            self.tokens[item], self.weight[item] = t, [len(x) for x in t]
            self.total[item] = sum(map(len, t))
            size = PIECE * PIECES
            cuts = [*range(0, max(1, len(t) - size // 2), size), len(t)]
            self.segments[item] = list(zip(cuts, cuts[1:]))
            for i in range(len(t) - PIECE + 1):
                self.grams[tuple(t[i : i + PIECE])].append((item, i))

    def found(self, text: str, share: float) -> Iterator[tuple[int, float, int]]:
        """(item, share of its characters held in order, segments verified) of the items that text holds."""
        t = tokens(text)
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        get = self.grams.get
        for j, gram in enumerate(zip(*(t[k:] for k in range(PIECE)))):
            if (places := get(gram)) is not None:
                for item, i in places:
                    hits[item].append((i, j))
        for size in {len(s) for s in self.short}:
            for whole in {g for g in zip(*(t[k:] for k in range(size))) if g in self.short}:
                for item in self.short[whole]:
                    yield item, 1.0, 1
        for item, at in hits.items():
            held, verified = self.verify(item, at, t, share)
            if held >= share:
                yield item, held, verified

    def verify(self, item: int, at: list[tuple[int, int]], t: list[str], share: float) -> tuple[float, int]:
        own, weight, total, segments = self.tokens[item], self.weight[item], self.total[item], self.segments[item]
        # a segment within its budget has an exact piece hit: without enough of these nothing can come of it
        starts = [a for a, _ in segments]
        by: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, j in at:
            for x in {i, i + PIECE - 1}:
                k = max(0, bisect_left(starts, x + 1) - 1)
                by[k].append((i, j))
        if sum(sum(weight[slice(*segments[k])]) for k in by) < share * total:
            return 0.0, 0
        matches = []  # (segment, end in the document, distance)
        for k, near in by.items():
            a, b = segments[k]
            budget, ends = (b - a) // PIECE - 1, set()
            for shift in sorted({j - i for i, j in near}):
                lo = max(0, a + shift - budget - 1)
                distance, end = myers(own[a:b], t[lo : b + shift + budget + 1])
                if distance <= budget and lo + end not in ends:
                    ends.add(lo + end)
                    matches.append((k, lo + end, distance))
        # the heaviest chain in which both segments and places ascend
        matches.sort()
        worth = []
        for x, (k, end, distance) in enumerate(matches):
            a, b = segments[k]
            mine = sum(weight[a:b]) * (1 - distance / (b - a))
            before = max(((worth[y][0], y) for y in range(x) if matches[y][0] < k and matches[y][1] < end), default=(0, -1))
            worth.append((mine + before[0], before[1]))
        if not worth:
            return 0.0, 0
        chain, x = [], max(range(len(worth)), key=lambda y: worth[y][0])
        held = worth[x][0]
        while x >= 0:
            chain.append(matches[x])
            x = worth[x][1]
        chain.reverse()
        # cut-off segments: exact pieces in the right order between or beside those of the chain
        covered: set[int] = set()
        done = {k for k, _, _ in chain}
        slack = 2 * PIECE * PIECES
        for i, j in at:
            for x, y in ((i + c, j + c) for c in range(PIECE)):
                k = max(0, bisect_left(starts, x + 1) - 1)
                if k in done or x in covered:
                    continue
                low = max((end for s, end, _ in chain if s < k), default=chain[0][1] - slack - PIECE * PIECES * (chain[0][0] - k + 1))
                high = min((end for s, end, _ in chain if s > k), default=chain[-1][1] + slack + PIECE * PIECES * (k - chain[-1][0]))
                if low <= y <= high:
                    covered.add(x)
        return (held + sum(weight[x] for x in covered)) / total, len(chain)


_BUILT: dict[str, Items] = {}


def built(name: str, rows: list) -> Items:
    """The index of a block of items, built once in each worker process."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Items(rows)
    return _BUILT[name]


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = 0.5) -> DataFrame:
    """(item_id, doc_id, held, segments): documents that hold at least ``share`` of an item's characters, in order.

    Whole texts of all documents are read, in one pass without a shuffle, each
    against a block of items of at most BLOCK_CHARS; a larger item table takes
    several passes. Case, punctuation, spacing, line breaks, markup and escapes
    don't count; up to a quarter of the words of a segment may differ. Items of
    one or two tokens have no pieces and are looked for whole. Null ids or texts
    and items without a token give nothing. A repeated document id or item id
    gives one row.
    """
    size = items.select(F.coalesce(F.sum(F.length(item_text)), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, math.ceil(size / BLOCK_CHARS))
    usable = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).alias("i"), F.col(item_text).alias("t"))
    out = None
    for k in range(blocks):
        rows = [(r["i"], r["t"]) for r in usable.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k).distinct().collect()]
        part = _against(docs, rows, doc_id, text, item_id, items.schema[item_id].dataType.simpleString(), share)
        out = part if out is None else out.unionByName(part)
    return out.groupBy(item_id, doc_id).agg(F.max("held").alias("held"), F.max("segments").alias("segments"))


def _against(docs: DataFrame, rows: list, doc_id: str, text: str, item_id: str, item_type: str, share: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(rows)
    name = uuid.uuid4().hex

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = built(name, shared.value)
        for b in batches:
            out = [(item, d, held, n) for d, t in zip(b["d"], b["t"]) for item, held, n in index.found(t, share)]
            yield pd.DataFrame(out, columns=[item_id, doc_id, "held", "segments"])

    read = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("d"), F.col(text).alias("t"))
    return read.mapInPandas(match, f"{item_id} {item_type}, {doc_id} {docs.schema[doc_id].dataType.simpleString()}, held double, segments int")
