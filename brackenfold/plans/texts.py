"""Queries over texts and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from brackenfold.functions import embed
from brackenfold.functions import text as tx
from brackenfold.operators import index_state, search
from brackenfold.operators.syntax_chunks import routed_chunks
from brackenfold.operators.word_chunks import chunk_counts as count_chunks
from brackenfold.operators.word_chunks import word_chunks as cut_words
from brackenfold.tables import checkpoint, table

LIMIT, OVERLAP, DIM = 64, 8, 64
QUESTION = "Which segment does the vector index keep after a restart?"


def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.content_hash("text").alias("content_hash"))


def duplicates(spark, d):
    return index_state.duplicates(table(spark, d, "documents"), "doc_id", tx.content_hash("text"))


def ext_filter(spark, d):
    sources = table(spark, d, "chunks").where("source is not null").select("source").distinct()
    return sources.select("source", tx.extension("source").alias("ext"), tx.supported_extension("source").alias("supported"))


def lang_routing(spark, d):
    sources = table(spark, d, "chunks").where("source is not null").select("source").distinct()
    return sources.select("source", tx.language("source").alias("language"))


def word_chunks(spark, d):
    return cut_words(table(spark, d, "documents"), LIMIT, OVERLAP, "doc_id")


def chunk_counts(spark, d):
    return count_chunks(table(spark, d, "documents"), LIMIT, OVERLAP, "doc_id")


def syntax_chunks(spark, d):
    """Every text under its source's language; a source's texts are told apart by their vector ids."""
    rows = table(spark, d, "chunks").where("source is not null and text is not null").select(F.concat_ws("#", F.col("vec_id").cast("string"), "source").alias("source"), "text").distinct()
    return routed_chunks(rows, LIMIT, OVERLAP)


def embed_terms(spark, d):
    return embed.term_counts(table(spark, d, "documents"), "doc_id", "text", DIM)


def embed_vectors(spark, d):
    """Dense vectors, as sums that sparse ones must equal."""
    e = embed.HashingEmbedder(DIM)
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", e.column(F.col("text")).alias("v"))
    return rows.select("doc_id", F.posexplode("v").alias("bucket", "x")).where("x <> 0").select("doc_id", "bucket", F.col("x").cast("bigint").alias("value"))


def rag_search(spark, d):
    """Documents to chunks to vectors to the five best hits for a question."""
    e = embed.HashingEmbedder(DIM)
    chunks = cut_words(table(spark, d, "documents"), LIMIT, OVERLAP, "doc_id")
    rows = chunks.withColumn("vec_id", F.col("doc_id") * 1_000_000 + F.col("chunk_index")).withColumn("embedding", e.column(F.col("text")))
    hits = search.search(rows.select("vec_id", "embedding"), e.query(QUESTION), 5, DIM)
    return hits.select("rank", "vec_id", F.round(F.col("score").cast("double"), 5).alias("score"))


def rag_search_batch(spark, d):
    """Every document whose id is divisible by 20, by its whole text, against all chunks."""
    e = embed.HashingEmbedder(DIM)
    chunks = checkpoint(cut_words(table(spark, d, "documents"), LIMIT, OVERLAP, "doc_id"))
    rows = chunks.select((F.col("doc_id") * 1_000_000 + F.col("chunk_index")).alias("vec_id"), e.column(F.col("text")).alias("embedding"))
    asked = table(spark, d, "documents").where("doc_id % 20 = 0 and text is not null").select(F.col("doc_id").alias("query_id"), e.column(F.col("text")).alias("embedding"))
    return search.knn(rows, asked, 5).select("query_id", "vec_id", "rank", F.round(F.col("score").cast("double"), 5).alias("score"))


def model_catalogue(spark, d):
    return embed.list_models(spark)


# white space as Unicode defines it; \s of the SQL engine is ASCII only
_SP = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
CHUNK_SQL = f"""
w as (select doc_id, regexp_extract_all(text, '[^{_SP}]+') words, regexp_extract_all(regexp_replace(regexp_replace(text, '^[{_SP}]+', ''), '[{_SP}]+$', ''), '[{_SP}]+') seps,
             strlen(text) - strlen(regexp_replace(text, '^[{_SP}]+', '')) lead from documents where text is not null),
c as (select *, len(words) n, unnest(range(0, 1 + greatest(0, ceil((len(words) - {LIMIT}) / {LIMIT - OVERLAP}.0))::int)) ci from w where len(words) > 0),
e as (select *, ci * {LIMIT - OVERLAP} sw, least(ci * {LIMIT - OVERLAP} + {LIMIT}, n) ew from c),
o as (select *, lead + coalesce(list_sum(list_transform(words[1:sw], lambda x: strlen(x))), 0) + coalesce(list_sum(list_transform(seps[1:sw], lambda x: strlen(x))), 0) so from e),
ch as (select doc_id, ci::int chunk_index, so::bigint start_offset,
       (so + coalesce(list_sum(list_transform(words[sw + 1:ew], lambda x: strlen(x))), 0) + coalesce(list_sum(list_transform(seps[sw + 1:ew - 1], lambda x: strlen(x))), 0))::bigint end_offset,
       array_to_string(words[sw + 1:ew], ' ') as text from o)
"""
TERM_SQL = f"""
t as (select KEY, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) tok from TABLE),
tc as (select KEY, ((('0x' || substr(md5(tok), 1, 8))::bigint) % {DIM})::int bucket,
       sum(case when (('0x' || substr(md5(tok), 9, 1))::bigint) % 2 = 0 then 1 else -1 end)::bigint as value from t group by 1, 2 having sum(case when (('0x' || substr(md5(tok), 9, 1))::bigint) % 2 = 0 then 1 else -1 end) <> 0)
"""
EXTS = ", ".join(f"'{e}'" for e in tx.INDEXABLE)
LANGS = " ".join(f"when '{e}' then '{lang}'" for e, lang in tx.LANGUAGE_OF.items())

QUERIES = {
    "content_hash": content_hash,
    "exact_duplicates": duplicates,
    "ext_filter": ext_filter,
    "lang_routing": lang_routing,
    "word_chunks": word_chunks,
    "chunk_counts": chunk_counts,
    "syntax_chunks": syntax_chunks,
    "hash_embed_terms": embed_terms,
    "hash_embed_vectors": embed_vectors,
    "rag_search": rag_search,
    "rag_search_batch": rag_search_batch,
    "model_catalogue": model_catalogue,
}
_TERMS = "with " + TERM_SQL.replace("KEY", "doc_id").replace("TABLE", "documents") + " select doc_id, bucket, value from tc"
ORACLES = {
    "content_hash": "select doc_id, sha256(text) content_hash from documents",
    "exact_duplicates": "select sha256(text) content_hash, count(distinct doc_id) copies, min(doc_id) \"first\" from documents where text is not null group by 1 having count(distinct doc_id) > 1",
    "ext_filter": f"select source, lower(regexp_extract(source, '[^/]\\.([^./]+)$', 1)) ext, lower(regexp_extract(source, '[^/]\\.([^./]+)$', 1)) in ({EXTS}) supported from (select distinct source from chunks where source is not null)",
    "lang_routing": f"select source, case lower(split_part(source, '.', -1)) {LANGS} end as language from (select distinct source from chunks where source is not null)",
    "word_chunks": f"with {CHUNK_SQL} select doc_id, chunk_index, start_offset, end_offset, text from ch",
    "chunk_counts": f"select doc_id, len(regexp_extract_all(text, '[^{_SP}]+'))::int n_words, (case when len(regexp_extract_all(text, '[^{_SP}]+')) = 0 then 0 else 1 + greatest(0, ceil((len(regexp_extract_all(text, '[^{_SP}]+')) - {LIMIT}) / {LIMIT - OVERLAP}.0)) end)::int n_chunks from documents where text is not null",
    "hash_embed_terms": _TERMS,
    "hash_embed_vectors": _TERMS,
    "rag_search": f"""with {CHUNK_SQL}, k as (select doc_id * 1000000 + chunk_index vec_id, text from ch), {TERM_SQL.replace("KEY", "vec_id").replace("TABLE", "k")},
qt as (select unnest(regexp_extract_all(lower('{QUESTION}'), '[\\p{{L}}\\p{{N}}_]+')) tok),
q as (select ((('0x' || substr(md5(tok), 1, 8))::bigint) % {DIM})::int bucket, sum(case when (('0x' || substr(md5(tok), 9, 1))::bigint) % 2 = 0 then 1 else -1 end)::double as value from qt group by 1),
nn as (select vec_id, sqrt(sum((value * value)::double)) n from tc group by 1),
s as (select nn.vec_id, (1 - coalesce(sum(q.value * tc.value), 0) / any_value(nn.n) / (select sqrt(sum(value * value)) from q))::float dist from nn left join tc on nn.vec_id = tc.vec_id left join q on q.bucket = tc.bucket group by 1),
r as (select *, row_number() over (order by dist, vec_id) as rank from s)
select rank::int as rank, vec_id, round(greatest(0, 1 - dist::double), 5) score from r where rank <= 5""",
    "model_catalogue": "select * from (values " + ", ".join(f"({i}, '{m}')" for i, m in enumerate(embed.MODELS)) + ") t(position, model)",
}
