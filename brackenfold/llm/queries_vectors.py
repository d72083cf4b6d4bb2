"""Queries over vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from brackenfold.llm import neighbours
from brackenfold.tables import table


def p5_found(spark, d):
    near = neighbours.nearest(table(spark, d, "wal_records"), "lsn", "vector_data", dims=64, k=10, min_score=0.9)
    return neighbours.close_pairs(near, "lsn_a", "lsn_b", 0.9)


def p5_neighbours(spark, d):
    near = neighbours.nearest(table(spark, d, "wal_records"), "lsn", "vector_data", dims=64, k=10)
    return near.select(F.col("item").alias("lsn"), F.col("neighbour").alias("neighbour_lsn"), "rank", F.round("score", 6).alias("score"))


QUERIES = {"p5_found": p5_found, "p5_neighbours": p5_neighbours}
NEAR_SQL = """i as (select distinct lsn, vector_data::double[] d from wal_records where len(vector_data) = 64 and len(list_filter(vector_data, lambda x: x is null or not isfinite(x))) = 0
      and len(list_filter(vector_data, lambda x: x <> 0)) > 0),
u as (select lsn, list_transform(d, lambda x: x / sqrt(list_dot_product(d, d))) d from i),
s as (select a.lsn, b.lsn neighbour_lsn, round(list_dot_product(a.d, b.d), 9) score from u a join u b on a.lsn <> b.lsn),
n as (select *, row_number() over (partition by lsn order by score desc, neighbour_lsn) as "rank" from s qualify "rank" <= 10)
"""
ORACLES = {
    "p5_found": f"with {NEAR_SQL} select distinct least(lsn, neighbour_lsn) lsn_a, greatest(lsn, neighbour_lsn) lsn_b from n where score >= 0.9",
    "p5_neighbours": f'with {NEAR_SQL} select lsn, neighbour_lsn, "rank"::int as "rank", round(score, 6) score from n',
}
