"""Cutting oversized texts into pieces at natural boundaries, with overlap."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The code points with the Unicode property White_Space.
SPACE = "\t-\r \x85\xa0  -     　"
WORD = re.compile(f"[^{SPACE}]+")
JAVA_WORD = r"[^\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

#: How natural a cut is, by strength; a cut inside running words has strength 0.
BOUNDARIES = ("word", "clause", "line", "sentence", "block end", "paragraph")
ENDS = re.compile(r"[.!?…。！？؟।॥｡۔;;}\])]*[.!?…。！？؟।॥｡۔][\"'”’»)\]」』）]*$")
CLAUSE = re.compile(r"[,;:،、，；：—–]$")
ABBREVIATED = re.compile(r"(?:^|[(\"“„«'])(?:[^\W\d_]|(?:[^\W\d_]\.)+[^\W\d_]|(?:Dr|Mr|Mrs|Ms|Prof|Sra?|Dra|St|No|Nr|Figs?|Secs?|Abb|vs|cf|vgl|bzw|ca|approx|aprox|pág|Проф|см|рис|стр|bkz|vb|σελ))\.$")
LIST_MARK = re.compile(r"(?:[-*+•#]+|\d+[.)]|//|/\*|#.*)$")


def strength(word: str, gap: str, following: str) -> int:
    """Of the boundary between two words: an index into BOUNDARIES."""
    lines = gap.count("\n") or len(re.findall("[\x0b\x0c\r\x85  ]", gap))
    if lines > 1:
        return 5
    ended = bool(ENDS.search(word)) and not ABBREVIATED.search(word)
    if lines and (word[-1] in "};{" or LIST_MARK.match(following)):
        return 4
    if ended and not following[:1].islower():
        return 4 if lines else 3
    if lines:
        return 2
    return int(bool(CLAUSE.search(word)))


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, int, int]]:
    """(first word, first own word, end word, char start, char end) of each piece.

    Agglomerative merging: every word starts as a segment of its own, adjacent
    pairs wait in a heap, and the pair with the weakest boundary (then the
    smallest joint size, then the leftmost) is merged while its size and the
    overlap that a piece takes from the piece before fit ``limit``. The first
    piece takes no overlap and holds at least ``overlap`` words, so that the
    next one can share them.
    """
    spans = [m.span() for m in WORD.finditer(text)]
    n = len(spans)
    if n <= limit:
        return [(0, 0, n, spans[0][0], spans[-1][1])] if n else []
    start = list(range(n))  # of the segment whose right end is at this word
    right = list(range(1, n + 1))  # end of the segment that starts at this word
    first = max(1, overlap)
    for i in range(1, first):
        right[i] = 0
    right[0], start[first - 1] = first, 0
    words = [text[a:b] for a, b in spans]
    force = [0] + [strength(words[i - 1], text[spans[i - 1][1] : spans[i][0]], words[i]) for i in range(1, n)]
    heap = [(force[i], i + 1 - start[i - 1], i) for i in range(first, n)]
    heapq.heapify(heap)
    while heap:
        _, size, at = heapq.heappop(heap)
        left, end = start[at - 1], right[at]
        if end - left > (limit - overlap if left else limit):
            continue  # segments only grow: this boundary stays
        if end - left != size:
            heapq.heappush(heap, (force[at], end - left, at))
            continue
        right[left], right[at], start[end - 1] = end, 0, left
    out, left = [], 0
    while left < n:
        lead = max(0, left - overlap)
        out.append((lead, left, right[left], spans[lead][0], spans[right[left] - 1][1]))
        left = right[left]
    return out


def byte_offsets(text: str) -> np.ndarray | range:
    """Bytes in UTF-8 up to each character and to the end."""
    if text.isascii():
        return range(len(text) + 1)
    o = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return np.concatenate([[0], np.cumsum(1 + (o > 0x7F) + (o > 0x7FF).astype(int) + (o > 0xFFFF))])


OUT = "n_words int, piece_index int, n_pieces int, first_word int, piece_words int, overlap_words int, text_start int, text_end int, byte_start bigint, byte_end bigint, boundary string, text string"


def split_oversized(df: DataFrame, limits: DataFrame, on: str = "chunker_id", text: str = "text", limit: str = "max_chunk_size", overlap: str = "overlap", start: str = "start_offset", end: str = "end_offset") -> DataFrame:
    """Pieces of the rows of ``df`` whose ``text`` has more words than the limit of their settings.

    ``limits`` has one row per ``on``. A word is a longest run of characters
    that aren't Unicode white space; nothing else is cut, so a row of one
    endless word isn't oversized. Columns: those of ``df`` besides ``text`` and
    the offsets, then n_words (of the whole text), piece_index, n_pieces, first_word (its
    position, overlap included), piece_words, overlap_words (shared with the piece
    before), text_start and text_end (code points in ``text``), the offsets in
    the source in bytes, boundary (the kind of cut that ends the piece; null for
    the last) and the piece's text, which is text[text_start:text_end].

    The offsets of the outer ends are those of the row. Inner ones are known
    where the text has as many bytes as its span; otherwise the blanks of text
    and source differ and they are null. Rows with null or short text, null or
    unknown settings, or a limit under 1 give nothing. An overlap of the limit
    or more counts as limit - 1, a null or negative one as 0. Repeated rows are
    cut once. Names in ``df`` that clash with new columns get the suffix _in.
    """
    made = {x.split()[0] for x in OUT.split(", ")} - {text} | {limit, overlap}
    df = df.withColumnsRenamed({c: f"{c}_in" for c in df.columns if c in made and c not in (text, on, start, end)})
    keep = [c for c in df.columns if c not in (text, start, end)]
    settings = limits.where(F.col(limit) >= 1).select(on, F.col(limit).cast("int").alias("_limit"), F.least(F.col(limit) - 1, F.greatest(F.lit(0), F.coalesce(F.col(overlap), F.lit(0)))).cast("int").alias("_overlap"))
    # n words take at least 2n - 1 bytes: most rows need no count
    over = (
        df.join(settings, on)
        .where((F.octet_length(text) > 2 * F.col("_limit")) & (F.regexp_count(text, F.lit(JAVA_WORD)) > F.col("_limit")))
        .dropDuplicates()
        .withColumn("_text", F.col(text))
    )
    schema = ", ".join(f"`{c}` {over.schema[c].dataType.simpleString()}" for c in keep) + ", " + OUT.replace("byte_start", start).replace("byte_end", end).replace("text string", f"`{text}` string")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.to_dict("records"):
                whole, got = r["_text"], pieces(r["_text"], r["_limit"], r["_overlap"])
                a, z = (None if pd.isna(r[x]) else int(r[x]) for x in (start, end))
                bytes_to = byte_offsets(whole)
                exact = a is not None and z is not None and int(bytes_to[-1]) == z - a
                n = got[-1][2]
                for k, (lead, own, stop, c0, c1) in enumerate(got):
                    if exact:
                        b0, b1 = a + int(bytes_to[c0]), a + int(bytes_to[c1])
                    else:
                        b0, b1 = a if k == 0 else None, z if stop == n else None
                    kind = None
                    if stop < n:
                        tail = WORD.search(whole, c1)
                        last = re.search(f"[^{SPACE}]+$", whole[max(c0, c1 - 200) : c1])
                        kind = BOUNDARIES[strength(last[0], whole[c1 : tail.start()], tail[0])]
                    rows.append([*(r[c] for c in keep), n, k, len(got), lead, stop - lead, own - lead, c0, c1, b0, b1, kind, whole[c0:c1]])
            out = pd.DataFrame(rows, columns=[*keep, *(x.split()[0] for x in OUT.split(", "))]).rename(columns={"byte_start": start, "byte_end": end, "text": text})
            for c in (start, end):
                out[c] = out[c].astype("Int64")
            yield out

    return over.mapInPandas(cut, schema)
