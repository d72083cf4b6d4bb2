"""Exact cosine search: one query, many queries, with a source filter.

Scores are computed on (id, embedding) alone; payload columns are joined back
for the k hits only, so a wide text column is never read for rows that lose.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brackenfold import schemas as s
from brackenfold.functions import vectors as v

#: Bytes of query vectors that are sent to all tasks at once; more queries go in blocks.
QUERY_BLOCK_BYTES = 16 << 20
#: Distances that a task holds at a time.
PAIRS = 2_000_000


def check_query(query: list[float], dim: int) -> None:
    if len(query) != dim:
        raise s.DimensionMismatch(dim, len(query))
    if not all(math.isfinite(x) for x in query):
        raise s.NaNDistance
    if not any(query):
        raise s.ZeroVector


def effective_ef(k: int, ef: int, deleted: int = 0) -> int:
    """Breadth of an approximate search for k hits."""
    return max(ef, 2 * k) + min(deleted, 32) if k <= 100 else max(ef, 4 * k) + min(deleted, 64)


def rag_ef(k: int) -> int:
    return min(200, max(40, 4 * k))


def scored(rows: DataFrame, query: list[float], id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, distance, score) of every row but zero vectors, which are never found."""
    q = v.literal(query)
    size = math.sqrt(math.fsum(x * x for x in query))
    near = rows.where(~v.is_placeholder(vector)).select(id_col, v.distance_of(v.similarity(F.col(vector), q, norm_b=F.lit(size))).alias("distance"))
    return near.select(id_col, "distance", v.score_of("distance").alias("score"))


def top_k(rows: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, distance, score): the k rows nearest to the query, ties by id. Zero vectors are never found."""
    return scored(rows, query, id_col, vector).orderBy("distance", id_col).limit(k)


def search(rows: DataFrame, query: list[float], k: int, dim: int, where: Column | None = None, id_col: str = "vec_id", vector: str = "embedding", payload: list[str] = ()) -> DataFrame:
    """(rank, id, distance, score, *payload) of the k nearest rows that satisfy ``where``.

    The filter comes first and reaches the scan. Raises on a query of wrong
    length, with values that aren't finite, or of zeros, also on an empty table.
    """
    check_query(query, dim)
    rows = rows if where is None else rows.where(where)
    return ranked(top_k(rows, query, k, id_col, vector), rows, id_col, payload)


def ranked(hits: DataFrame, rows: DataFrame, id_col: str, payload: list[str] = ()) -> DataFrame:
    # at most k rows: their window in one task is bounded
    out = hits.withColumn("rank", F.row_number().over(Window.orderBy("distance", id_col)))
    if payload:
        # k rows, so the broadcast is bounded by the caller's k
        out = rows.select(id_col, *payload).join(F.broadcast(out), id_col)
    return out.select("rank", id_col, "distance", "score", *payload)


def search_postfilter(rows: DataFrame, query: list[float], k: int, dim: int, where: Column, id_col: str = "vec_id", vector: str = "embedding", payload: list[str] = ()) -> DataFrame:
    """As ``search``, but takes max(4k, k + 100) hits first and filters them: may return fewer than k."""
    check_query(query, dim)
    wide = top_k(rows, query, max(4 * k, k + 100), id_col, vector)
    kept = rows.where(where).select(id_col).join(F.broadcast(wide), id_col).orderBy("distance", id_col).limit(k)
    return ranked(kept, rows, id_col, payload)


def knn(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", query_id: str = "query_id", query_vector: str = "embedding", exclude_same: bool = False) -> DataFrame:
    """(query_id, id, rank, distance, score): exact k nearest rows of every query.

    A stated set of queries against all rows, in blocks of at most
    QUERY_BLOCK_BYTES. Each task keeps k hits per query of its rows, so the
    shuffle holds k rows per query and task, whatever the size of the table.
    Zero queries have no hits. ``exclude_same`` leaves out a row with the query's id.
    """
    usable = queries.where(F.col(query_vector).isNotNull() & ~v.is_placeholder(query_vector)).select(F.col(query_id).alias("q"), F.col(query_vector).cast("array<double>").alias("x"))
    n, width = usable.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(1))).first()
    blocks = max(1, math.ceil(n * width * 8 / QUERY_BLOCK_BYTES))
    parts = [_block(rows, usable.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b), k, id_col, vector, exclude_same) for b in range(blocks)]
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    rank = F.row_number().over(Window.partitionBy("q").orderBy("distance", "i"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("q").alias(query_id), F.col("i").alias(id_col), "rank", "distance", v.score_of("distance").alias("score"))


def _best(at: np.ndarray, dist: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k hits (query, distance, id) of each query with the least distance, then the smallest id."""
    order = np.lexsort((ids, dist, at))
    at, dist, ids = at[order], dist[order], ids[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
    rank = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
    return at[rank < k], dist[rank < k], ids[rank < k]


def _block(rows: DataFrame, queries: DataFrame, k: int, id_col: str, vector: str, exclude_same: bool) -> DataFrame:
    table = queries.orderBy("q").toArrow()
    spark = rows.sparkSession
    qtype, itype = queries.schema["q"].dataType.simpleString(), rows.schema[id_col].dataType.simpleString()
    qids = table.column("q").combine_chunks() if table.num_rows else pa.array([], pa.int64())
    x = np.array(table.column("x").to_pylist(), dtype=np.float64) if table.num_rows else np.zeros((0, 1))
    shared = spark.sparkContext.broadcast((qids, x, np.sqrt((x * x).sum(axis=1))))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, x, qn = shared.value
        plain = lambda x: x.astype(str) if x.dtype == object else x
        names = plain(qids.to_numpy(zero_copy_only=False))
        at, dist, ids = np.zeros(0, np.int64), np.zeros(0, np.float32), None
        for b in batches:
            if not len(qids) or not b.num_rows:
                continue
            own = plain(b.column(0).to_numpy(zero_copy_only=False))
            y = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float64)
            yn = np.sqrt((y * y).sum(axis=1))
            step = max(1, PAIRS // len(own))
            new = [(at, dist, own[:0] if ids is None else ids)]
            for lo in range(0, len(names), step):
                d = (1 - np.clip((x[lo : lo + step] @ y.T) / qn[lo : lo + step, None] / yn, -1, 1)).astype(np.float32)
                if exclude_same:
                    d[names[lo : lo + step, None] == own] = np.inf
                # all rows up to the k-th distance, ties included
                edge = np.partition(d, min(k, len(own)) - 1, axis=1)[:, min(k, len(own)) - 1]
                row, col = np.nonzero((d <= edge[:, None]) & (d < np.inf))
                new.append((row + lo, d[row, col], own[col]))
            at, dist, ids = _best(*(np.concatenate(part) for part in zip(*new)), k)
        if ids is not None:
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(at)), pa.array(ids, b_type), pa.array(dist, pa.float32())], ["q", "i", "distance"])

    from pyspark.sql.pandas.types import to_arrow_type

    b_type = to_arrow_type(rows.schema[id_col].dataType)
    read = rows.where(F.col(vector).isNotNull() & ~v.is_placeholder(vector)).select(id_col, F.col(vector))
    return read.mapInArrow(score, f"q {qtype}, i {itype}, distance float")


def pairwise(a: DataFrame, b: DataFrame, keys: tuple[str, str] = ("id_a", "id_b"), id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Distances of corresponding rows: ``a`` and ``b`` are joined on ``pair``."""
    left = a.select("pair", F.col(id_col).alias(keys[0]), F.col(vector).alias("_a"))
    right = b.select("pair", F.col(id_col).alias(keys[1]), F.col(vector).alias("_b"))
    return left.join(right, "pair").select(*keys, v.cosine_distance("_a", "_b").alias("distance"))
