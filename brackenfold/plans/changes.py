"""Queries over the write-ahead log."""

from __future__ import annotations

from pyspark.sql import functions as F

from brackenfold.operators import change_feed as cf
from brackenfold.tables import table

OP_SQL = """case lower(regexp_replace(op_type, '^\\s+|\\s+$', '', 'g'))
    when 'insert' then 'I' when 'i' then 'I' when '1' then 'I'
    when 'delete' then 'D' when 'd' then 'D' when '2' then 'D'
    when 'update' then 'U' when 'u' then 'U' when '3' then 'U'
    when 'checkpoint' then 'C' when 'c' then 'C' when '4' then 'C' end"""


def p2_found(spark, d):
    return cf.live_state(cf.merged_state(table(spark, d, "wal_records"), "vector_id", "lsn", "op_type", []), "vector_id", "lsn", [])


def p2_state(spark, d):
    out = cf.current_state(table(spark, d, "wal_records"), "vector_id", "lsn", "op_type", ["vector_data", "metadata"])
    return out.select("vector_id", "lsn", F.coalesce(F.size("vector_data"), F.lit(-1)).alias("dims"), F.octet_length("metadata").alias("metadata_bytes"))


def p2_merged(spark, d):
    """The log in two parts, later records first: merged as if it had come at once."""
    log = table(spark, d, "wal_records")
    late = F.col("lsn") > log.agg(F.percentile_approx("lsn", 0.5)).first()[0]
    state = cf.merged_state(log.where(late), "vector_id", "lsn", "op_type", [])
    return cf.live_state(cf.merged_state(log.where(~late), "vector_id", "lsn", "op_type", [], state), "vector_id", "lsn", [])


def p2_latest(spark, d):
    return cf.latest_state(table(spark, d, "wal_records"), "vector_id", "lsn", "op_type", []).select("vector_id", "lsn", "deleted")


LIVE_SQL = f"""
w as (select distinct vector_id, lsn, {OP_SQL} op from wal_records where vector_id is not null),
o as (select vector_id, list(struct_pack(lsn := lsn, op := op) order by lsn) ops from w where op in ('I', 'U', 'D') group by 1),
s as (select vector_id, list_reduce(ops, lambda a, b: case
        when b.op = 'D' then struct_pack(lsn := b.lsn, op := 'D')
        when b.op = 'I' and a.op = 'D' then struct_pack(lsn := b.lsn, op := 'L')
        when b.op = 'U' and a.op = 'L' then struct_pack(lsn := b.lsn, op := 'L')
        else a end, struct_pack(lsn := -1::bigint, op := 'D')) z from o),
live as (select vector_id, z.lsn lsn from s where z.op = 'L')
"""

QUERIES = {"p2_found": p2_found, "p2_state": p2_state, "p2_merged": p2_merged, "p2_latest": p2_latest}
ORACLES = {
    "p2_found": f"with {LIVE_SQL} select vector_id, lsn from live",
    "p2_merged": f"with {LIVE_SQL} select vector_id, lsn from live",
    "p2_state": f"""with {LIVE_SQL},
b as (select w.vector_id, w.lsn, w.vector_data, w.metadata, row_number() over (partition by w.lsn order by (w.vector_data is not null)::int + (w.metadata is not null)::int desc) r
      from wal_records w join live l on w.vector_id = l.vector_id and w.lsn = l.lsn)
select vector_id, lsn, coalesce(len(vector_data)::int, -1) dims, octet_length(metadata)::int metadata_bytes from b where r = 1""",
    "p2_latest": f"""with w as (select vector_id, lsn, {OP_SQL} op, row_number() over (partition by vector_id order by lsn desc) r from wal_records where vector_id is not null and {OP_SQL} is not null)
select vector_id, lsn, op = 'D' deleted from w where r = 1""",
}
