"""Word chunker: overlapping windows of words with byte offsets."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brackenfold.functions import text as tx

# The code points with the Unicode property White_Space.
SPACES = "\t\n\x0b\x0c\r \x85\xa0                　"
WORD = re.compile(f"[^{re.escape(SPACES)}]+")


def check_window(limit: int, overlap: int) -> None:
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and under the chunk size")


def windows(text: str, limit: int, overlap: int) -> Iterator[tuple[int, int, int, str]]:
    """(chunk_index, start, end, words joined by one blank), offsets in UTF-8 bytes; linear in the text."""
    spans = [m.span() for m in WORD.finditer(text)]
    n, step = len(spans), limit - overlap
    if not n:
        return
    if text.isascii():
        at = None
    else:
        # bytes beyond one per character, at each character that has any
        wide = [(i, len(c.encode()) - 1) for i, c in enumerate(text) if c > "\x7f"]
        places = [i for i, _ in wide]
        extra = [0]
        for _, x in wide:
            extra.append(extra[-1] + x)
        at = lambda i: i + extra[bisect_right(places, i - 1)]
    k = first = 0
    while True:
        last = min(first + limit, n)
        a, b = spans[first][0], spans[last - 1][1]
        yield k, at(a) if at else a, at(b) if at else b, " ".join(text[x:y] for x, y in spans[first:last])
        if last == n:
            return
        k, first = k + 1, first + step


def word_chunks(df: DataFrame, limit: int = 512, overlap: int = 64, source: str = "source", text: str = "text") -> DataFrame:
    """(source, chunk_index, start_offset, end_offset, text): windows of ``limit`` words, ``overlap`` shared.

    Blank and null texts have no chunks; a null source is kept. The offsets are
    those of the first and last word in the text's UTF-8 bytes. Other columns of
    ``df`` aren't carried along.
    """
    check_window(limit, overlap)
    kind = df.schema[source].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, rows = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for r in windows(t, limit, overlap):
                    keys.append(i)
                    rows.append(r)
                if len(rows) > 5000:
                    yield record(b, keys, rows)
                    keys, rows = [], []
            yield record(b, keys, rows)

    def record(b: pa.RecordBatch, keys: list, rows: list) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [[], [], [], []]
        types = (pa.int32(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keys, pa.int64())), *[pa.array(c, t) for c, t in zip(cols, types)]], ["k", "chunk_index", "start_offset", "end_offset", "text"])

    read = df.where(F.col(text).isNotNull()).select(F.col(source).alias("k"), F.col(text).alias("t"))
    return read.mapInArrow(cut, f"k {kind.simpleString()}, chunk_index int, start_offset bigint, end_offset bigint, text string").withColumnRenamed("k", source)


def chunk_counts(df: DataFrame, limit: int = 512, overlap: int = 64, source: str = "source", text: str = "text") -> DataFrame:
    """(source, n_words, n_chunks), all in the JVM."""
    check_window(limit, overlap)
    return df.where(F.col(text).isNotNull()).select(source, F.regexp_count(text, F.lit(r"(?U)\S+")).alias("n_words")).select(source, "n_words", tx.chunk_total(F.col("n_words"), limit, overlap).alias("n_chunks"))


def chunk_id(source: str = "source", index: str = "chunk_index", text: str = "text"):
    """A stable id, the same whenever the same chunk is cut again."""
    return F.sha2(F.concat_ws("\x1f", F.col(source), F.col(index).cast("string"), F.col(text)), 256)
