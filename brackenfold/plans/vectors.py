"""Queries over vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from brackenfold.functions import vectors as v
from brackenfold.operators import ann, index_state, search
from brackenfold.operators import change_feed as cf
from brackenfold.operators.numbering import dense_numbers
from brackenfold.plans.changes import LIVE_SQL
from brackenfold.plans.state import TERMINAL_SQL
from brackenfold.tables import table

DIM, K = 64, 10


def _query(rows) -> list[float]:
    """The stored vector with the smallest id asks the question."""
    return list(rows.orderBy("vec_id").select("embedding").first()[0])


def vector_norms(spark, d):
    rows = table(spark, d, "embeddings")
    return rows.select("vec_id", F.size("embedding").alias("dims"), v.norm("embedding").cast("float").alias("norm"))


def cosine_pairs(spark, d):
    """Each vector with the next id's."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    return search.pairwise(rows.withColumn("pair", F.col("vec_id")), rows.withColumn("pair", F.col("vec_id") - 1)).select("id_a", "id_b", F.round(F.col("distance").cast("double"), 6).alias("distance"))


def placeholder_rows(spark, d):
    w = table(spark, d, "wal_records").where("vector_data is not null")
    return w.select("lsn", v.is_placeholder("vector_data").alias("placeholder")).distinct()


def finite_check(spark, d):
    w = table(spark, d, "wal_records").where("vector_data is not null")
    return w.select("lsn", v.is_finite("vector_data").alias("finite")).distinct()


def _shown(hits):
    return hits.select("rank", "vec_id", F.round(F.col("score").cast("double"), 5).alias("score"))


def topk_exact(spark, d):
    rows = table(spark, d, "embeddings")
    return _shown(search.search(rows, _query(rows), K, DIM))


def topk_filtered(spark, d):
    rows = table(spark, d, "embeddings")
    return _shown(search.search(rows, _query(rows), K, DIM, where=F.col("label") == 1))


def topk_postfilter(spark, d):
    rows = table(spark, d, "embeddings")
    return _shown(search.search_postfilter(rows, _query(rows), K, DIM, F.col("label") == 1))


def score_clamp(spark, d):
    """Negative similarities score 0 and keep their order by distance."""
    rows = table(spark, d, "embeddings")
    q = [-x for x in _query(rows)]
    return search.scored(rows, q).agg(F.count("*").alias("n"), F.count_if(F.col("score") == 0).alias("zero"), F.count_if(F.col("distance") >= 1).alias("opposite"))


def _asked(rows):
    return rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def knn_batch(spark, d):
    rows = table(spark, d, "embeddings")
    return search.knn(rows, _asked(rows), K, exclude_same=True).select("query_id", "vec_id", "rank", F.round(F.col("score").cast("double"), 5).alias("score"))


def ivf_topk(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    hits = ann.build_cells(rows).search_all(_asked(rows), K, search.rag_ef(K))
    return hits.select("query_id", "vec_id", "rank", F.round(F.col("score").cast("double"), 5).alias("score"))


def ivf_recall(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    index, asked = ann.build_cells(rows), _asked(rows)
    return ann.recall(search.knn(rows, asked, K, exclude_same=True), index.search_all(asked, K, search.rag_ef(K)), ["query_id", "vec_id"])


def ivf_quality(spark, d):
    """Whether the cells find at least nine tenths of the true neighbours of every id divisible by 20."""
    asked = _asked(table(spark, d, "embeddings")).count()
    return ivf_recall(spark, d).select(F.lit(asked).cast("bigint").alias("asked"), F.col("expected"), (F.col("recall") >= 0.9).alias("enough"))


def point_lookup(spark, d):
    return table(spark, d, "embeddings").where("vec_id = 7").select("vec_id", "label", F.element_at("embedding", 1).cast("double").alias("x0"))


def compact_renumber(spark, d):
    """Vectors that the operation log leaves live get dense ids in the old order."""
    live = cf.terminal_state(table(spark, d, "wal_records"), "vector_id", "lsn", "op_type", []).where("not deleted").select(F.col("vector_id").alias("old_id"))
    return dense_numbers(live, ["old_id"], "vec_id")


def first_indexable(spark, d):
    """Where an index may start: the live vector with the smallest id that has numbers to search by."""
    state = cf.current_state(table(spark, d, "wal_records"), "vector_id", "lsn", "op_type", ["vector_data"])
    return index_state.first_indexable(state, "vector_id", "vector_data", DIM)


_Q = "q as (select embedding::double[] x from embeddings order by vec_id limit 1)"
_S = f"{_Q}, s as (select vec_id, label, (1 - list_cosine_similarity(embedding::double[], x))::float dist from embeddings, q)"
_OUT = "round(greatest(0, 1 - dist::double), 5) score"
QUERIES = {
    "vector_norms": vector_norms,
    "cosine_pairs": cosine_pairs,
    "placeholder_rows": placeholder_rows,
    "finite_check": finite_check,
    "topk_exact": topk_exact,
    "topk_filtered": topk_filtered,
    "topk_postfilter": topk_postfilter,
    "score_clamp": score_clamp,
    "knn_batch": knn_batch,
    "ivf_topk": ivf_topk,
    "ivf_recall": ivf_recall,
    "ivf_quality": ivf_quality,
    "point_lookup": point_lookup,
    "compact_renumber": compact_renumber,
    "first_indexable": first_indexable,
}
ORACLES = {
    "vector_norms": "select vec_id, len(embedding)::int dims, sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x)))::float norm from embeddings",
    "cosine_pairs": "select a.vec_id id_a, b.vec_id id_b, round((1 - list_cosine_similarity(a.embedding::double[], b.embedding::double[]))::float::double, 6) distance from embeddings a join embeddings b on b.vec_id = a.vec_id + 1",
    "placeholder_rows": "select distinct lsn, len(list_filter(vector_data, lambda x: x <> 0)) = 0 placeholder from wal_records where vector_data is not null",
    "finite_check": "select distinct lsn, len(list_filter(vector_data, lambda x: not isfinite(x))) = 0 finite from wal_records where vector_data is not null",
    "topk_exact": f"with {_S}, r as (select *, row_number() over (order by dist, vec_id) k from s) select k::int as rank, vec_id, {_OUT} from r where k <= {K}",
    "topk_filtered": f"with {_S}, r as (select *, row_number() over (order by dist, vec_id) k from s where label = 1) select k::int as rank, vec_id, {_OUT} from r where k <= {K}",
    "topk_postfilter": f"with {_S}, w as (select * from s order by dist, vec_id limit {max(4 * K, K + 100)}), r as (select *, row_number() over (order by dist, vec_id) k from w where label = 1) select k::int as rank, vec_id, {_OUT} from r where k <= {K}",
    "score_clamp": f"with {_Q}, s as (select (1 - list_cosine_similarity(embedding::double[], list_transform(x, lambda y: -y)))::float dist from embeddings, q) select count(*) n, count(*) filter (greatest(0, 1 - dist::double)::float = 0) zero, count(*) filter (dist >= 1) opposite from s",
    "knn_batch": f"""with s as (select a.vec_id query_id, b.vec_id, (1 - list_cosine_similarity(b.embedding::double[], a.embedding::double[]))::float dist from embeddings a join embeddings b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by query_id order by dist, vec_id) k from s) select query_id, vec_id, k::int as rank, {_OUT} from r where k <= {K}""",
    "ivf_quality": f"select count(*) asked, {K} * count(*) expected, true enough from embeddings where vec_id % 20 = 0",
    "point_lookup": "select vec_id, label, embedding[1]::double x0 from embeddings where vec_id = 7",
    "compact_renumber": f"with {TERMINAL_SQL.format(where='')} select vector_id old_id, row_number() over (order by vector_id) - 1 vec_id from t where not deleted",
    "first_indexable": f"""with {LIVE_SQL} select min(w.vector_id) vector_id from wal_records w join live l on w.vector_id = l.vector_id and w.lsn = l.lsn
where len(vector_data) = 64 and len(list_filter(vector_data, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(vector_data, lambda x: x <> 0)) > 0""",
}
