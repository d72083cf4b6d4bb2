"""Indexing and searching texts: the engine's main entry point."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brackenfold import schemas as s
from brackenfold.functions import text as tx
from brackenfold.functions import vectors as v
from brackenfold.functions.embed import Embedder, resolve
from brackenfold.operators import index_state, search
from brackenfold.operators.numbering import dense_numbers
from brackenfold.operators.syntax_chunks import routed_chunks
from brackenfold.operators.word_chunks import check_window, chunk_id
from brackenfold.sources import files as fs
from brackenfold.store import Files
from brackenfold.tables import checkpoint


#: Replaced or deleted sources that are sent to all tasks, at most; more are joined by shuffle.
GONE_ROWS = 200_000


class RagEngine:
    """Documents and chunks in versioned Parquet, one commit per call.

    A version names the folders that make up ``chunks`` and ``documents``.
    Replaced and deleted sources are recorded in ``gone`` (source, before): rows
    of that source written before that version don't count. ``compact`` folds
    all of it into fresh folders.
    """

    def __init__(self, spark: SparkSession, path: str, embedder: Embedder, chunk_size: int, overlap: int, clock: Callable[[], float]):
        check_window(chunk_size, overlap)
        self.spark, self.path, self.embedder, self.chunk_size, self.overlap, self.clock = spark, path, embedder, chunk_size, overlap, clock
        self.files = Files(spark, path)
        self.version, self.manifest = -1, {"chunks": [], "documents": [], "gone": [], "next_id": 0}

    @classmethod
    def open(cls, spark: SparkSession, path: str, dim: int = 384, embedder: Embedder | str = "Xenova/bge-small-en-v1.5", chunk_size: int = 512, overlap: int = 64, clock: Callable[[], float] = time.time) -> RagEngine:
        engine = cls(spark, path, resolve(embedder, dim) if isinstance(embedder, str) else embedder, chunk_size, overlap, clock)
        meta = engine.files.read("meta.json")
        if meta is None:
            engine.files.create("meta.json", {"format": 1, "dim": dim, "embedder": engine.embedder.name})
        elif meta["dim"] != dim:
            raise s.DimensionMismatch(meta["dim"], dim)
        elif meta["embedder"] != engine.embedder.name:
            raise s.ConfigMismatch(f"indexed with {meta['embedder']}, opened with {engine.embedder.name}")
        engine.refresh()
        return engine

    def refresh(self) -> None:
        found = [int(x.removesuffix(".json")) for x in self.files.names("versions") if x.endswith(".json")]
        if found and max(found) != self.version:
            self.version = max(found)
            self.manifest = self.files.read(f"versions/{self.version}.json")

    def _commit(self, **changes) -> None:
        manifest = self.manifest | changes
        if not self.files.create(f"versions/{self.version + 1}.json", manifest):
            raise s.CommitConflict(f"version {self.version + 1} was committed by another writer")
        self.version, self.manifest = self.version + 1, manifest

    def _folder(self, df: DataFrame, columns) -> str:
        name = f"data/{uuid.uuid4().hex}"
        df.select(*[F.col(f.name).cast(f.dataType.simpleString()) for f in columns], F.lit(self.version + 1).alias("version")).write.parquet(f"{self.path}/{name}")
        return name

    def _table(self, name: str, schema) -> DataFrame:
        from pyspark.sql import types as T

        full = T.StructType([*schema.fields, T.StructField("version", T.IntegerType())])
        if not self.manifest[name]:
            return self.spark.createDataFrame([], full)
        df = self.spark.read.schema(full).parquet(*[f"{self.path}/{p}" for p in self.manifest[name]])
        if self.manifest["gone"]:
            gone = self.spark.read.schema("source string, before int").parquet(*[f"{self.path}/{p}" for p in self.manifest["gone"]])
            last = gone.groupBy("source").agg(F.max("before").alias("before"))
            # replaced and deleted sources are few; one source may hold a large part of all rows, so they don't meet by source
            if last.count() <= GONE_ROWS:
                last = F.broadcast(last)
            df = df.join(last, "source", "left").where(F.col("before").isNull() | (F.col("version") >= F.col("before"))).drop("before")
        return df.select(*full.names)

    def chunks(self) -> DataFrame:
        return self._table("chunks", s.CHUNKS)

    def documents(self) -> DataFrame:
        return self._table("documents", s.DOCUMENTS)

    # indexing

    def index_path(self, paths: list[str] | str) -> DataFrame:
        """(source, status, chunks, error) of every file with an accepted extension below ``paths``: indexed, skipped or failed."""
        found = fs.scan(self.spark, [paths] if isinstance(paths, str) else paths)
        known = index_state.change_status(found.drop("content"), self.documents())
        wanted = found.join(known.where("status <> 'unchanged'").select("source"), "source", "left_semi")
        texts = checkpoint(fs.read_texts(wanted))
        return self._index(texts.where("error is null").drop("error"), known, texts.where("error is not null").select("source", F.lit("failed").alias("status"), F.lit(None).cast("int").alias("chunks"), "error"))

    def index_texts(self, df: DataFrame) -> DataFrame:
        """(source, status, chunks, error) of texts under any unique name. Of several texts with one source the largest counts; nulls are left out."""
        texts = df.where(F.col("source").isNotNull() & F.col("text").isNotNull()).groupBy("source").agg(F.max("text").alias("text")).withColumn("content_hash", tx.content_hash("text"))
        known = index_state.change_status(texts.drop("text"), self.documents())
        wanted = checkpoint(texts.join(known.where("status <> 'unchanged'").select("source"), "source", "left_semi"))
        return self._index(wanted, known, None)

    def index_text(self, text: str, source: str) -> DataFrame:
        return self.index_texts(self.spark.createDataFrame([(source, text)], "source string, text string"))

    def _index(self, texts: DataFrame, known: DataFrame, failed: DataFrame | None) -> DataFrame:
        known = checkpoint(known.select("source", "status"))
        skipped = known.where("status = 'unchanged'").select("source", F.lit("skipped").alias("status"), F.lit(None).cast("int").alias("chunks"), F.lit(None).cast("string").alias("error"))
        cut = routed_chunks(texts, self.chunk_size, self.overlap).withColumn("id", chunk_id()).withColumn("embedding", self.embedder.column(F.col("text")))
        numbered = dense_numbers(cut, ["source", "chunk_index"], "vec_id", self.manifest["next_id"])
        counts = checkpoint(texts.select("source", "content_hash").join(numbered.groupBy("source").agg(F.count("*").cast("int").alias("n")), "source", "left").select("source", "content_hash", F.coalesce("n", F.lit(0)).alias("chunk_count"), F.lit(int(self.clock())).cast("bigint").alias("indexed_at")))
        m, n_docs = self.manifest, counts.count()
        if n_docs:
            n = numbered.count()
            changed = known.where("status = 'changed'").join(counts.select("source"), "source", "left_semi")
            gone = m["gone"]
            if not changed.isEmpty():
                gone = [*gone, self._gone(changed)]
            self._commit(chunks=[*m["chunks"], self._folder(numbered, s.CHUNKS)], documents=[*m["documents"], self._folder(counts, s.DOCUMENTS)], gone=gone, next_id=m["next_id"] + n)
        out = skipped.unionByName(counts.select("source", F.lit("indexed").alias("status"), F.col("chunk_count").alias("chunks"), F.lit(None).cast("string").alias("error")))
        return out if failed is None else out.unionByName(failed)

    def _gone(self, sources: DataFrame) -> str:
        name = f"data/{uuid.uuid4().hex}"
        sources.select("source", F.lit(self.version + 1).alias("before")).distinct().write.parquet(f"{self.path}/{name}")
        return name

    def delete_source(self, source: str) -> None:
        """An unknown source is no error."""
        if self.documents().where(F.col("source") == source).isEmpty():
            return
        self._commit(gone=[*self.manifest["gone"], self._gone(self.spark.createDataFrame([(source,)], "source string"))])

    def compact(self) -> bool:
        """Rewrites live rows, clustered by source, with ids from 0; False if nothing was deleted."""
        if not self.manifest["gone"]:
            return False
        rows = dense_numbers(self.chunks().drop("vec_id"), ["source", "chunk_index"], "vec_id")
        n = rows.count()
        self._commit(chunks=[self._folder(rows, s.CHUNKS)], documents=[self._folder(self.documents(), s.DOCUMENTS)], gone=[], next_id=n)
        return True

    # queries

    def search(self, query: str, top_k: int = 5, source: str | None = None, mode: str = "exact") -> DataFrame:
        """(rank, score, source, chunk_index, text, start_offset, end_offset). ``mode`` postfilter looks for the source among the overall best only."""
        payload = ["source", "chunk_index", "text", "start_offset", "end_offset"]
        where = None if source is None else F.col("source") == source
        dim = self.files.read("meta.json")["dim"]
        vector = self.embedder.query(query)
        if source is not None and mode == "postfilter":
            out = search.search_postfilter(self.chunks(), vector, top_k, dim, where, payload=payload)
        else:
            out = search.search(self.chunks(), vector, top_k, dim, where, payload=payload)
        return out.select("rank", F.col("score").cast("double").alias("score"), *payload).orderBy("rank")

    def search_batch(self, queries: DataFrame, top_k: int = 5) -> DataFrame:
        """(query_id, rank, score, source, chunk_index, text) for queries (query_id, query)."""
        asked = queries.select("query_id", self.embedder.column(F.col("query")).alias("embedding"))
        hits = search.knn(self.chunks(), checkpoint(asked), top_k)
        return hits.join(self.chunks().select("vec_id", "source", "chunk_index", "text"), "vec_id").select("query_id", "rank", "score", "source", "chunk_index", "text")

    def document_status(self, source: str) -> dict | None:
        row = self.documents().where(F.col("source") == source).first()
        return None if row is None else {k: row[k] for k in ("source", "content_hash", "indexed_at", "chunk_count")}

    def list_sources(self) -> list[str]:
        return [r["source"] for r in index_state.list_sources(self.chunks()).toLocalIterator()]

    def stats(self) -> dict:
        """row_count counts every row ever written, one per document included; live_chunk_count only chunks in effect."""
        live = self.chunks().count()
        docs = self.documents().count()
        rows = sum(self.spark.read.parquet(f"{self.path}/{p}").count() for t in ("chunks", "documents") for p in self.manifest[t])
        return {"row_count": rows, "live_chunk_count": live, "documents": docs, "sources": self.chunks().select("source").distinct().count()}

    def flush(self) -> None:
        """Every call commits; there is nothing to write."""

    def close(self) -> None:
        pass


def embed_valid(df: DataFrame) -> DataFrame:
    """Rows that a search can find: a vector that isn't zero."""
    return df.where(~v.is_placeholder("embedding"))
