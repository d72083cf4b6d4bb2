"""Queries over texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from brackenfold.llm import contamination, encoding, mixing, provenance, sentences, splitting
from brackenfold.tables import table


def p1_pieces(spark, d):
    return splitting.split_oversized(table(spark, d, "chunks"), table(spark, d, "chunkers"))


def p1_found(spark, d):
    return p1_pieces(spark, d).where("piece_index = 0").select("vec_id").distinct()


def p1_cover(spark, d):
    """Per cut chunk: its words, those of its pieces without their overlaps, and whether all pieces fit and share what they should."""
    pieces = p1_pieces(spark, d).join(table(spark, d, "chunkers").select("chunker_id", "max_chunk_size", "overlap"), "chunker_id")
    shared = F.when(F.col("piece_index") == 0, F.col("overlap_words") == 0).otherwise(F.col("overlap_words") == F.least("overlap", F.col("max_chunk_size") - 1))
    return pieces.groupBy("vec_id").agg(F.max("n_words").cast("bigint").alias("n_words"), F.sum(F.col("piece_words") - F.col("overlap_words")).alias("own_words"), F.min((F.col("piece_words") <= F.col("max_chunk_size")) & shared).alias("fits"))


def p3_repaired(spark, d):
    return encoding.find_garbled(table(spark, d, "chunks").select("vec_id", "source", "text")).distinct()


def p3_found(spark, d):
    return p3_repaired(spark, d).select("vec_id").distinct()


def p4_sources(spark, d):
    return provenance.provenance(table(spark, d, "chunks"))


def p4_found(spark, d):
    return p4_sources(spark, d).where("reason is not null").select("source")


def p6_leaks(spark, d):
    return contamination.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("item_id", "doc_id", F.round("held", 6).alias("held"), "segments")


def p6_found(spark, d):
    return p6_leaks(spark, d).select("item_id", "doc_id")


def p7_mix(spark, d):
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_report(spark, d):
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p7_found(spark, d):
    return mixing.unreachable(p7_report(spark, d))


def p8_sentences(spark, d):
    return _sentences(table(spark, d, "documents"))


def p8_found(spark, d):
    return _sentences(table(spark, d, "documents").where(F.col("kind").isin("prose", "note"))).select("doc_id", "end_char")


def _sentences(docs):
    return sentences.sentences(docs, "doc_id", "text", by_line=F.col("kind") == "note")


QUERIES = {"p1_found": p1_found, "p1_cover": p1_cover, "p1_pieces": p1_pieces, "p3_found": p3_found, "p3_repaired": p3_repaired, "p4_found": p4_found, "p4_sources": p4_sources, "p6_found": p6_found, "p6_leaks": p6_leaks, "p7_found": p7_found, "p7_mix": p7_mix, "p7_report": p7_report, "p8_found": p8_found, "p8_sentences": p8_sentences}
WORDS_SQL = r"len(regexp_extract_all(text, '[^\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'))"
ORACLES = {
    "p1_cover": f"with w as (select distinct vec_id, {WORDS_SQL} n, max_chunk_size from chunks join chunkers using (chunker_id)) select vec_id, n n_words, n own_words, true fits from w where n > max_chunk_size",
    "p1_found": r"""select distinct vec_id from chunks join chunkers using (chunker_id)
where len(regexp_extract_all(text, '[^\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+')) > max_chunk_size""",
}
