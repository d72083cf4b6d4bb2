"""State of indexed sources: change detection, upsert, deletion, listings, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brackenfold.functions import vectors
from brackenfold.operators.numbering import running_totals


def latest_documents(entries: DataFrame, key: str = "source", order: tuple[str, ...] = ("indexed_at", "loaded_at")) -> DataFrame:
    """One row per source: the latest by ``order``, then the largest of the rest. Null sources are left out.

    One maximum of a struct: repeated and late rows don't matter.
    """
    rest = [c for c in entries.columns if c not in (key, *order)]
    best = entries.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("_b"))
    return best.select(key, *[F.col(f"_b.{c}") for c in (*order, *rest)])


def change_status(incoming: DataFrame, documents: DataFrame, key: str = "source", digest: str = "content_hash") -> DataFrame:
    """``incoming`` plus status: new, unchanged (same hash under the same source) or changed. A null hash is changed."""
    known = documents.select(key, F.col(digest).alias("_known"), F.lit(True).alias("_there"))
    status = F.when(F.col("_there").isNull(), "new").when(F.coalesce(F.col(digest) == F.col("_known"), F.lit(False)), "unchanged").otherwise("changed")
    return incoming.join(known, key, "left").withColumn("status", status).drop("_known", "_there")


def upsert(current: DataFrame, incoming: DataFrame, key: str = "source") -> DataFrame:
    """Rows of ``incoming``, and those of ``current`` whose key isn't among them."""
    return current.join(incoming.select(key).distinct(), key, "left_anti").select(*current.columns).unionByName(incoming.select(*current.columns))


def delete_sources(rows: DataFrame, sources: DataFrame, key: str = "source") -> DataFrame:
    """``rows`` without those of ``sources``; unknown sources change nothing. Rows with a null key stay."""
    return rows.join(sources.select(key).distinct(), key, "left_anti").select(*rows.columns)


def list_sources(chunks: DataFrame, key: str = "source") -> DataFrame:
    """Distinct sources with at least one chunk, in binary order."""
    return chunks.where(F.col(key).isNotNull()).select(key).distinct().orderBy(key)


def chunks_per_source(chunks: DataFrame, key: str = "source", unit: str = "vec_id") -> DataFrame:
    return chunks.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(unit).alias("n_chunks"))


def status_of(documents: DataFrame, asked: DataFrame, key: str = "source") -> DataFrame:
    """One row per asked source: found, and the document's columns or nulls."""
    there = documents.withColumn("found", F.lit(True))
    return asked.select(key).distinct().join(there, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def deletion_stats(rows: DataFrame, deleted: str = "deleted") -> DataFrame:
    """(deleted, total, live, ratio, compact): one pass; ratio is a float, 0 for an empty table, compact if over 0.3."""
    gone = F.count_if(F.coalesce(F.col(deleted), F.lit(True)))
    out = rows.agg(gone.alias("deleted"), F.count("*").alias("total"))
    ratio = F.when(F.col("total") == 0, 0.0).otherwise(F.col("deleted") / F.col("total"))
    return out.select("deleted", "total", (F.col("total") - F.col("deleted")).alias("live"), ratio.cast("float").alias("ratio"), should_compact(F.col("deleted"), F.col("total")).alias("compact"))


def should_compact(deleted: Column, total: Column) -> Column:
    """Strictly more than 30 %, in whole numbers."""
    return (total > 0) & (10 * deleted > 3 * total)


def duplicates(rows: DataFrame, key: str, digest: Column) -> DataFrame:
    """(content_hash, copies, first): contents that occur under several keys."""
    return rows.select(key, digest.alias("content_hash")).where(F.col("content_hash").isNotNull()).groupBy("content_hash").agg(F.count_distinct(key).alias("copies"), F.min(key).alias("first")).where("copies > 1")


def retained_segments(segments: DataFrame, max_bytes: int, max_count: int, segment: str = "segment", size: str = "bytes", safe: str = "checkpointed") -> DataFrame:
    """``segments`` that stay: the oldest go while the rest is over a limit, as long as they were checkpointed.

    All from the first one on that has to stay do; what is over a limit is told
    by totals over range partitions, so that no task sees all segments.
    """
    marked = running_totals(segments.withColumn("_one", F.lit(1).cast("bigint")), [segment], {"_bytes_to": size, "_count_to": "_one"})
    whole = marked.agg(F.max("_bytes_to").alias("b"), F.max("_count_to").alias("n")).first()
    if not whole["n"]:
        return segments
    over = (F.lit(whole["b"]) - F.col("_bytes_to") + F.col(size) > max_bytes) | (F.lit(whole["n"]) - F.col("_count_to") + 1 > max_count)
    first = marked.where(~(over & F.col(safe))).agg(F.min(segment).alias("s")).first()["s"]
    return segments.where(F.col(segment) >= F.lit(first)) if first is not None else segments.where(F.lit(False))


def first_indexable(rows: DataFrame, id_col: str, vector: str, dims: int) -> DataFrame:
    """(id): the smallest id with ``dims`` finite numbers that aren't all zero; null if there is none."""
    x = F.col(vector)
    usable = (F.size(x) == dims) & F.forall(x, lambda v: v.isNotNull()) & vectors.is_finite(vector) & ~vectors.is_placeholder(vector)
    return rows.where(usable).agg(F.min(id_col).alias(id_col))
