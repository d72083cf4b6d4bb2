"""Queries over the state of sources and the operation log."""

from __future__ import annotations

from pyspark.sql import functions as F

from brackenfold.operators import change_feed as cf
from brackenfold.operators import index_state as ix
from brackenfold.plans.changes import OP_SQL
from brackenfold.tables import table

CHECKPOINT = 500


def _entries(spark, d):
    return ix.latest_documents(table(spark, d, "index_entries").select("source", "content_hash", "indexed_at", "chunk_count", "loaded_at"))


def latest_documents(spark, d):
    return _entries(spark, d).select("source", "content_hash", "indexed_at", "chunk_count")


def sources_list(spark, d):
    return ix.list_sources(table(spark, d, "chunks"))


def chunks_per_source(spark, d):
    return ix.chunks_per_source(table(spark, d, "chunks"))


def document_status(spark, d):
    """Every source of chunks, asked for among the indexed ones."""
    asked = table(spark, d, "chunks").where("source is not null")
    return ix.status_of(_entries(spark, d), asked).select("source", "found", "content_hash", "indexed_at", "chunk_count")


def change_detection(spark, d):
    """All states ever delivered, against the latest ones."""
    incoming = table(spark, d, "index_entries").where("source is not null").select("source", "content_hash").distinct()
    return ix.change_status(incoming, _entries(spark, d))


def upsert_documents(spark, d):
    """Documents that were found again take the place of their entries."""
    current = _entries(spark, d).select("source", "content_hash", "chunk_count")
    incoming = ix.chunks_per_source(table(spark, d, "chunks")).select("source", F.lit("again").alias("content_hash"), F.col("n_chunks").cast("int").alias("chunk_count"))
    return ix.upsert(current, incoming)


def delete_sources(spark, d):
    """Chunks of the sources whose last entry has no content hash or no chunk count are deleted, to be indexed anew."""
    chunks = table(spark, d, "chunks").select("vec_id", "source").distinct()
    return ix.delete_sources(chunks, _entries(spark, d).where("content_hash is null or chunk_count is null"))


def _wal(spark, d):
    return table(spark, d, "wal_records")


def oplog_replay(spark, d):
    return cf.terminal_state(_wal(spark, d), "vector_id", "lsn", "op_type", []).select("vector_id", "lsn", "deleted")


def oplog_from_checkpoint(spark, d):
    return cf.terminal_state(_wal(spark, d), "vector_id", "lsn", "op_type", [], CHECKPOINT).select("vector_id", "lsn", "deleted")


def deletion_stats(spark, d):
    return ix.deletion_stats(oplog_replay(spark, d))


def last_lsn(spark, d):
    return _wal(spark, d).agg((F.max("lsn") + 1).alias("next_lsn"), F.count_distinct("lsn").alias("records"))


def op_counts(spark, d):
    ops = _wal(spark, d).select("lsn", cf.operation(F.col("op_type")).alias("op")).distinct()
    return ops.groupBy("op").agg(F.count("*").alias("n"))


def metadata_json(spark, d):
    """Decodes row metadata; what isn't JSON is left out."""
    text = F.col("metadata").cast("string")
    rows = _wal(spark, d).where("metadata is not null").select("lsn", F.get_json_object(text, "$.source").alias("source"), F.try_variant_get(F.try_parse_json(text), "$.chunk_index", "int").alias("chunk_index"))
    return rows.where("source is not null").distinct()


def retention(spark, d):
    """Log segments of 200 sequence numbers under a byte and a count limit; the newest quarter isn't checkpointed."""
    size = F.coalesce(4 * F.size("vector_data"), F.lit(0)) + F.coalesce(F.octet_length("metadata"), F.lit(0)) + 38
    rows = _wal(spark, d).groupBy("lsn").agg(F.max(size).alias("bytes"))
    top = rows.agg(F.max("lsn").alias("top"))
    segments = rows.groupBy(F.floor(F.col("lsn") / 200).alias("segment")).agg(F.sum("bytes").alias("bytes"))
    marked = segments.join(F.broadcast(top)).select("segment", "bytes", (F.col("segment") < F.floor(F.col("top") * 3 / 4 / 200)).alias("checkpointed"))
    return ix.retained_segments(marked, 256_000, 12).select("segment", "bytes")


ENTRY_SQL = "e as (select source, content_hash, indexed_at, chunk_count from (select *, row_number() over (partition by source order by indexed_at desc nulls last, loaded_at desc nulls last, content_hash desc nulls last, chunk_count desc nulls last) r from index_entries where source is not null) where r = 1)"
TERMINAL_SQL = f"""w as (select vector_id, lsn, {OP_SQL} op from wal_records where vector_id is not null),
f as (select vector_id, max(case when op = 'D' then 1 else 0 end) = 1 deleted, max(lsn) last, max(case when op <> 'D' then lsn end) best from w where op in ('I', 'U', 'D') {{where}} group by 1),
t as (select vector_id, case when deleted then last else best end lsn, deleted from f)"""
QUERIES = {
    "latest_documents": latest_documents,
    "sources_list": sources_list,
    "chunks_per_source": chunks_per_source,
    "document_status": document_status,
    "change_detection": change_detection,
    "upsert_documents": upsert_documents,
    "delete_sources": delete_sources,
    "oplog_replay": oplog_replay,
    "oplog_from_checkpoint": oplog_from_checkpoint,
    "deletion_stats": deletion_stats,
    "last_lsn": last_lsn,
    "op_counts": op_counts,
    "metadata_json": metadata_json,
    "retention": retention,
}
ORACLES = {
    "metadata_json": """with t as (select lsn, case when json_valid(x) then x end j from (select lsn, try(decode(metadata)) x from wal_records where metadata is not null))
select distinct lsn, json_extract_string(j, '$.source') source, try_cast(json_extract_string(j, '$.chunk_index') as int) chunk_index from t where json_extract_string(j, '$.source') is not null""",
    "latest_documents": f"with {ENTRY_SQL} select * from e",
    "sources_list": "select distinct source from chunks where source is not null",
    "chunks_per_source": "select source, count(distinct vec_id) n_chunks from chunks where source is not null group by 1",
    "document_status": f"with {ENTRY_SQL} select s.source, e.source is not null as found, content_hash, indexed_at, chunk_count from (select distinct source from chunks where source is not null) s left join e on e.source = s.source",
    "change_detection": f"with {ENTRY_SQL} select i.source, i.content_hash, case when e.source is null then 'new' when i.content_hash = e.content_hash then 'unchanged' else 'changed' end status from (select distinct source, content_hash from index_entries where source is not null) i left join e on e.source = i.source",
    "upsert_documents": f"with {ENTRY_SQL}, c as (select source, count(distinct vec_id)::int n from chunks where source is not null group by 1) select source, content_hash, chunk_count from e where source not in (select source from c) union all select source, 'again', n from c",
    "delete_sources": f"with {ENTRY_SQL} select distinct vec_id, source from chunks where source is null or source not in (select source from e where content_hash is null or chunk_count is null)",
    "oplog_replay": f"with {TERMINAL_SQL.format(where='')} select vector_id, lsn, deleted from t",
    "oplog_from_checkpoint": f"with {TERMINAL_SQL.format(where=f'and lsn >= {CHECKPOINT}')} select vector_id, lsn, deleted from t",
    "deletion_stats": f"with {TERMINAL_SQL.format(where='')} select count(*) filter (deleted) deleted, count(*) total, count(*) filter (not deleted) live, (count(*) filter (deleted) / count(*))::float ratio, 10 * count(*) filter (deleted) > 3 * count(*) compact from t",
    "last_lsn": "select max(lsn) + 1 next_lsn, count(distinct lsn) records from wal_records",
    "op_counts": f"select op, count(*) n from (select distinct lsn, {OP_SQL} op from wal_records) group by 1",
    "retention": """with r as (select lsn, max(coalesce(4 * len(vector_data), 0) + coalesce(octet_length(metadata), 0) + 38) bytes from wal_records group by 1),
s as (select (lsn // 200)::bigint segment, sum(bytes)::bigint bytes from r group by 1),
m as (select *, segment < floor((select max(lsn) from r) * 3 / 4.0 / 200) safe, sum(bytes) over (order by segment desc) nb, count(*) over (order by segment desc) nc from s),
k as (select *, max(case when (nb > 256000 or nc > 12) and safe then 0 else 1 end) over (order by segment) keep from m)
select segment, bytes from k where keep = 1""",
}
