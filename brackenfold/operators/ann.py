"""Approximate search: inverted cells of a spherical k-means, exact scores within the cells probed."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brackenfold.functions import vectors as v
from brackenfold.operators import search as se

#: Rows the cells are fitted on, at most; cells at most. Every row is assigned.
SAMPLE_ROWS, MAX_CELLS = 100_000, 4_096
#: Share of the NEAREST rows next to ASK_ROWS rows of the sample that the cells probed must hold.
TARGET, NEAREST, ASK_ROWS = 0.95, 10, 500


@dataclass(frozen=True)
class CellIndex:
    """Rows with a ``cell`` column, and the unit centres of the cells."""

    rows: DataFrame
    centres: np.ndarray
    size: int
    least: int = 1

    def probe(self, query: list[float], ef: int) -> list[int]:
        """The cells nearest to the query that hold about ``ef`` in each ``size`` rows, ``least`` at least."""
        n = max(1, math.ceil(len(self.centres) * min(1.0, ef / max(1, self.size))))
        q = np.array(query, np.float64)
        near = np.argsort(-(self.centres @ q), kind="stable")
        # neighbours straddle borders: a few cells more than the share of rows asks for
        return [int(c) for c in near[: min(len(near), max(self.least, n + max(2, len(near) // 8)))]]

    def search(self, query: list[float], k: int, ef: int = 40, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """(rank, id, distance, score); the filter on ``cell`` prunes partitions if the rows are stored by cell."""
        se.check_query(query, self.centres.shape[1])
        rows = self.rows.where(F.col("cell").isin(self.probe(query, se.effective_ef(k, ef))))
        return se.ranked(se.top_k(rows, query, k, id_col, vector), rows, id_col)

    def search_all(self, queries: DataFrame, k: int, ef: int = 40, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """(query_id, id, rank, distance, score): as ``search`` for each row (query_id, vector) of queries, without the row of its id."""
        bare, breadth = CellIndex(None, self.centres, self.size, self.least), se.effective_ef(k, ef)
        asked = queries.where(F.col(vector).isNotNull() & ~v.is_placeholder(vector) & v.is_finite(vector)).select("query_id", F.col(vector).alias("_x"))

        def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cells = [bare.probe(x, breadth) for x in b.column(1).to_pylist()]
                sent = b.take(pa.array([i for i, c in enumerate(cells) for _ in c], pa.int64()))
                yield pa.RecordBatch.from_arrays([*sent.columns, pa.array([x for c in cells for x in c], pa.int32())], ["query_id", "_x", "cell"])

        types = {f.name: f.dataType.simpleString() for f in asked.schema}
        sent = asked.mapInArrow(probes, f"query_id {types['query_id']}, _x {types['_x']}, cell int")
        hits = sent.join(self.rows.select(id_col, vector, "cell"), "cell").where(F.col(id_col) != F.col("query_id")).select("query_id", id_col, v.cosine_distance(vector, "_x").alias("distance"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", id_col))
        return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", id_col, "rank", "distance", v.score_of("distance").alias("score"))


def build_cells(rows: DataFrame, cells: int | None = None, id_col: str = "vec_id", vector: str = "embedding", rounds: int = 10) -> CellIndex:
    """Cells fitted on a bounded sample by hash of the id, then all rows assigned in one pass. Zero vectors are left out."""
    rows = rows.where(F.col(vector).isNotNull() & ~v.is_placeholder(vector) & v.is_finite(vector))
    n = rows.count()
    if not n:
        return CellIndex(rows.withColumn("cell", F.lit(0)), np.zeros((1, 1)), 0)
    share = min(1.0, 1.1 * SAMPLE_ROWS / n)
    sample = rows.where(F.pmod(F.xxhash64(id_col), F.lit(1_000_003)) < share * 1_000_003).select(vector).limit(SAMPLE_ROWS).toArrow().column(vector).combine_chunks()
    x = sample.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(sample), -1) if len(sample) else np.array([rows.first()[vector]], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    k = min(cells or max(1, round(math.sqrt(n))), MAX_CELLS, len(x))
    centres = x[np.random.default_rng(11).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-12), centres)
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = b.column(b.schema.get_field_index(vector)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((y @ shared.value.T).argmax(axis=1) if len(y) else [], pa.int32())], [*b.schema.names, "cell"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", cell int"
    return CellIndex(rows.mapInArrow(assign, schema), centres, n, _least(x, centres))


def _least(x: np.ndarray, centres: np.ndarray) -> int:
    """Cells to probe for TARGET of the rows nearest to rows of the sample, in the sample."""
    k = min(NEAREST, len(x) - 1)
    if k < 1:
        return 1
    home, ranks = (x @ centres.T).argmax(axis=1), []
    ask = np.linspace(0, len(x) - 1, min(ASK_ROWS, len(x))).astype(int)
    for part in np.array_split(ask, math.ceil(len(ask) / 25)):
        s = x[part] @ x.T
        s[np.arange(len(part)), part] = -3
        order = np.argsort(np.argsort(-(x[part] @ centres.T), axis=1, kind="stable"), axis=1)
        ranks.append(np.take_along_axis(order, home[np.argpartition(s, -k, axis=1)[:, -k:]], axis=1).ravel())
    return int(np.quantile(np.concatenate(ranks), TARGET, method="higher")) + 1


def recall(exact: DataFrame, approximate: DataFrame, on: list[str]) -> DataFrame:
    """(hits, expected, recall): the share of the exact result that the approximate one holds."""
    both = exact.select(*on).distinct().withColumn("_e", F.lit(1)).join(approximate.select(*on).distinct().withColumn("_a", F.lit(1)), on, "left")
    return both.agg(F.coalesce(F.sum("_a"), F.lit(0)).alias("hits"), F.count("*").alias("expected")).withColumn("recall", F.col("hits") / F.greatest("expected", F.lit(1)))
