"""Incremental ingestion with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from brackenfold.functions import text as tx
from brackenfold.operators import change_feed
from brackenfold.rag import RagEngine
from brackenfold.sources import files as fs
from brackenfold.store import Files


def watch_files(spark: SparkSession, path: str) -> DataFrame:
    """A stream of (source, content, content_hash) of new files with an accepted extension."""
    # the schema of binaryFile is fixed
    raw = spark.readStream.schema("path string, modificationTime timestamp, length bigint, content binary").format("binaryFile").option("recursiveFileLookup", "true").load(path)
    read = raw.select(F.regexp_replace("path", "^file:(//)?", "").alias("source"), "content")
    return read.where(tx.supported_extension("source")).withColumn("content_hash", tx.content_hash("content"))


def index_stream(engine: RagEngine, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Indexes each batch of new files in one commit. A batch that is replayed after a failure finds its hashes unchanged and does nothing."""

    def batch(df: DataFrame, _: int) -> None:
        texts = fs.read_texts(df).where("error is null").select("source", "text")
        if not texts.isEmpty():
            engine.refresh()
            engine.index_texts(texts).count()

    writer = watch_files(engine.spark, path).writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(availableNow=True) if once else writer).start()


#: Parts of the state by hash of the key; a batch rewrites those it touches.
BUCKETS = 64


def apply_changes_stream(changes: DataFrame, key: str, seq: str, op: str, payload: list[str], state_path: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Keeps the last-writer-wins state of a change stream in versions under ``state_path``.

    The state lies in ``buckets`` parts by hash of the key. A batch folds into
    those parts of the version before that hold its keys, writes them anew and
    refers to the others where they are; a replayed batch writes the same again.
    Parts that the last two versions don't refer to are removed. Tombstones stay,
    so late records are safe.
    """
    spark = changes.sparkSession
    files = Files(spark, state_path)
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def batch(df: DataFrame, n: int) -> None:
        df = df.where(F.col(key).isNotNull()).withColumn("_bucket", bucket)
        before = _version(files, n - 1)
        # as many numbers as there are buckets at most
        touched = sorted(str(r["_bucket"]) for r in df.select("_bucket").distinct().collect())
        old = _parts(spark, state_path, {b: v for b, v in before.items() if b in touched})
        state = change_feed.latest_state(df, key, seq, op, payload, old).withColumn("_bucket", bucket)
        state.write.mode("overwrite").partitionBy("_bucket").parquet(f"{state_path}/data/{n}")
        # of nothing but records without effect there is no part
        made = {name.removeprefix("_bucket=") for name in files.names(f"data/{n}") if name.startswith("_bucket=")}
        after = before | {b: n for b in touched if b in made}
        files.delete(f"versions/{n}.json")
        files.create(f"versions/{n}.json", after)
        used = {*before.values(), *after.values(), n}
        for name in files.names("data"):
            if int(name) not in used:
                files.delete(f"data/{name}")

    return changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(availableNow=True).start()


def _version(files: Files, version: int) -> dict[str, int]:
    """Batch that wrote each bucket, as of a version."""
    return files.read(f"versions/{version}.json") or {}


def _parts(spark: SparkSession, state_path: str, parts: dict[str, int]) -> DataFrame | None:
    paths = [f"{state_path}/data/{n}/_bucket={b}" for b, n in parts.items()]
    return spark.read.parquet(*paths) if paths else None


def read_state(spark: SparkSession, state_path: str, version: int) -> DataFrame | None:
    """The state as of a batch, the last or the one before it; None before the first."""
    return _parts(spark, state_path, _version(Files(spark, state_path), version))
