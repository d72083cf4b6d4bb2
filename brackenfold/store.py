"""A versioned vector table on Parquet with an operation log.

Layout under a path: ``meta.json`` (dimension, fixed at creation), ``data/*``
(Parquet parts, each in its own folder) and ``versions/N.json``. A version names
the snapshot of the last checkpoint, one row per id, and the parts of the log
since, and is created exclusively: of two writers of the same version one fails
with CommitConflict, and a reader sees a version entirely or not at all. State
is the fold of snapshot and log in which a delete is final, as ids are never
reused. Only ids that the log since the checkpoint names are folded; all others
are read off the snapshot without a shuffle.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brackenfold import schemas as s
from brackenfold.functions import vectors as v
from brackenfold.operators import change_feed, index_state, search
from brackenfold.operators.numbering import dense_numbers


#: Parts of the log since the checkpoint from which an append merges them into one.
MERGE_PARTS = 32
#: Versions that stay readable, and age in seconds from which parts that no version names are taken for those of a writer that died.
KEEP_VERSIONS, ORPHAN_SECONDS = 2, 24 * 3600


class Files:
    """Small files through Hadoop's file system, so that any store Spark writes to serves."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.path = lambda name: self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def read(self, name: str) -> dict | None:
        if not self.fs.exists(self.path(name)):
            return None
        stream = self.fs.open(self.path(name))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError as e:
            raise s.Corruption(f"{name}: {e}") from e
        finally:
            stream.close()

    def create(self, name: str, value: dict) -> bool:
        """False if the file is there already."""
        try:
            stream = self.fs.create(self.path(name), False)
        except Exception as e:  # noqa: BLE001
            if "exist" in str(e).lower():
                return False
            raise
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()
        return True

    def names(self, folder: str) -> list[str]:
        if not self.fs.exists(self.path(folder)):
            return []
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self.path(folder)))

    def aged(self, folder: str, seconds: float) -> list[str]:
        """Entries that haven't changed for so long."""
        if not self.fs.exists(self.path(folder)):
            return []
        before = (time.time() - seconds) * 1000
        return [x.getPath().getName() for x in self.fs.listStatus(self.path(folder)) if x.getModificationTime() < before]

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class VectorTable:
    def __init__(self, spark: SparkSession, path: str, config: s.Config, clock: Callable[[], float] = time.time):
        self.spark, self.path, self.config, self.clock = spark, path, config, clock
        self.files = Files(spark, path)
        self._state: DataFrame | None = None

    @classmethod
    def open(cls, spark: SparkSession, path: str, config: s.Config | None = None, clock: Callable[[], float] = time.time) -> VectorTable:
        """Opens or creates. A dimension other than that at creation is an error."""
        config = config or s.Config()
        table = cls(spark, path, config, clock)
        meta = table.files.read("meta.json")
        if meta is None:
            if not table.files.create("meta.json", {"format": 1, "dim": config.dim}):
                meta = table.files.read("meta.json")
        if meta is not None and meta.get("dim") != config.dim:
            raise s.DimensionMismatch(meta.get("dim"), config.dim)
        if meta is not None and meta.get("format") != 1:
            raise s.Corruption("unknown format")
        table.version = -1
        table.manifest = {"snapshot": None, "parts": [], "next_id": 0, "next_lsn": 0, "checkpoint_lsn": 0}
        table.refresh()
        return table

    # versions

    def refresh(self) -> None:
        found = [int(x.removesuffix(".json")) for x in self.files.names("versions") if x.endswith(".json")]
        if found and max(found) != self.version:
            self.version = max(found)
            self.manifest = self.files.read(f"versions/{self.version}.json")
            self._state = None

    def _commit(self, **changes) -> None:
        manifest = self.manifest | changes
        if not self.files.create(f"versions/{self.version + 1}.json", manifest):
            raise s.CommitConflict(f"version {self.version + 1} was committed by another writer")
        self.version, self.manifest, self._state = self.version + 1, manifest, None

    def _write(self, log: DataFrame) -> str:
        part = f"data/{uuid.uuid4().hex}"
        log.select(*[F.col(f.name).cast(f.dataType.simpleString()) for f in s.OPLOG]).write.parquet(f"{self.path}/{part}")
        return part

    def _append(self, log: DataFrame, ids: int, lsns: int) -> None:
        m = self.manifest
        if len(m["parts"]) + 1 < MERGE_PARTS:
            self._commit(parts=[*m["parts"], self._write(log)], next_id=m["next_id"] + ids, next_lsn=m["next_lsn"] + lsns)
            return
        # single inserts make small parts: many become one, so that neither files nor versions grow without end
        merged = self._write(self._read(m["parts"]).unionByName(log))
        self._commit(parts=[merged], next_id=m["next_id"] + ids, next_lsn=m["next_lsn"] + lsns)
        self.vacuum()

    def _ms(self) -> int:
        return int(self.clock() * 1000)

    def _read(self, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], s.OPLOG)
        return self.spark.read.schema(s.OPLOG).parquet(*[f"{self.path}/{p}" for p in parts])

    def _snapshot(self) -> DataFrame:
        return self._read([self.manifest["snapshot"]] if self.manifest["snapshot"] else [])

    def log(self) -> DataFrame:
        """The snapshot's rows as inserts and deletes, and the log since."""
        return self._snapshot().unionByName(self._read(self.manifest["parts"]))

    def state(self) -> DataFrame:
        """(vec_id, embedding, metadata, deleted): one row per id ever used."""
        if self._state is None:
            snapshot, delta = self._snapshot(), self._read(self.manifest["parts"])
            kept = snapshot.select("vec_id", "embedding", "metadata", (F.col("op") == "D").alias("deleted"))
            if self.manifest["parts"]:
                touched = delta.select("vec_id")
                feed = snapshot.join(touched, "vec_id", "left_semi").unionByName(delta)
                folded = change_feed.terminal_state(feed, "vec_id", "lsn", "op", ["embedding", "metadata"])
                kept = kept.join(touched, "vec_id", "left_anti").unionByName(folded.select("vec_id", "embedding", "metadata", "deleted"))
            self._state = kept.withColumn("metadata", F.coalesce("metadata", F.lit(b"")))
        return self._state

    def live(self) -> DataFrame:
        return self.state().where("not deleted").drop("deleted")

    # mutations

    def _check(self, vector: list[float]) -> None:
        if len(vector) != self.config.dim:
            raise s.DimensionMismatch(self.config.dim, len(vector))
        if any(x != x or x in (float("inf"), float("-inf")) for x in vector):
            raise s.NaNDistance

    def _one(self, op: str, vec_id: int, vector: list[float] | None, metadata: bytes | None) -> DataFrame:
        row = (self.manifest["next_lsn"], self._ms(), op, vec_id, None if vector is None else [float(x) for x in vector], metadata)
        return self.spark.createDataFrame([row], s.OPLOG)

    def insert(self, vector: list[float], metadata: bytes | None = None) -> int:
        self._check(vector)
        vec_id = self.manifest["next_id"]
        self._append(self._one("I", vec_id, vector, metadata or b""), 1, 1)
        return vec_id

    def insert_batch(self, vectors: list[list[float]], metadata: list[bytes | None] | None = None) -> list[int]:
        """The ids of many vectors, inserted in one commit; a wrong one among them changes nothing."""
        for x in vectors:
            self._check(x)
        if not vectors:
            return []
        m, now = self.manifest, self._ms()
        payload = metadata or [None] * len(vectors)
        rows = [(m["next_lsn"] + i, now, "I", m["next_id"] + i, [float(y) for y in x], d or b"") for i, (x, d) in enumerate(zip(vectors, payload))]
        self._append(self.spark.createDataFrame(rows, s.OPLOG), len(rows), len(rows))
        return [r[3] for r in rows]

    def insert_raw(self, vector: list[float], metadata: bytes | None = None) -> int:
        """As ``insert``, but of any finite values or none: a row of the wrong length takes an id and is never found."""
        vec_id = self.manifest["next_id"]
        fits = len(vector) == self.config.dim and all(x == x and x not in (float("inf"), float("-inf")) for x in vector)
        self._append(self._one("I", vec_id, vector if fits else [0.0] * self.config.dim, metadata or b""), 1, 1)
        return vec_id

    def recover(self, log: DataFrame) -> int:
        """Appends the records of ``log`` (see ``wal_segments``) that this table doesn't have yet; their number.

        Records from before the checkpoint or without an effect on state are left
        out, so replaying the same segments again changes nothing.
        """
        m = self.manifest
        known = self._read(m["parts"]).select("lsn")
        new = log.where((F.col("lsn") >= m["checkpoint_lsn"]) & (F.col("op") != "C") & F.col("vec_id").isNotNull()).select(*[f.name for f in s.OPLOG]).dropDuplicates(["lsn"]).join(known, "lsn", "left_anti")
        ends = new.agg(F.count("*").alias("n"), F.max("lsn").alias("lsn"), F.max("vec_id").alias("id")).first()
        if ends["n"]:
            part = self._write(new)
            self._commit(parts=[*m["parts"], part], next_id=max(m["next_id"], ends["id"] + 1), next_lsn=max(m["next_lsn"], ends["lsn"] + 1))
        return ends["n"]

    def insert_many(self, rows: DataFrame, order_by: list[str]) -> tuple[int, int]:
        """(first id, number): rows (embedding, metadata) get ids in the order of ``order_by``, in one commit.

        Vectors of a wrong length or with values that aren't finite fail the write and change nothing.
        """
        m = self.manifest
        e = F.col("embedding")
        checked = rows.withColumn(
            "embedding",
            F.when(F.size(e) != self.config.dim, F.raise_error(F.lit(f"DimensionMismatch: expected {self.config.dim}")).cast("array<float>")).when(~v.is_finite(e), F.raise_error(F.lit("NaNDistance")).cast("array<float>")).otherwise(e),
        )
        numbered = dense_numbers(checked, order_by, "vec_id", m["next_id"])
        n = numbered.count()
        if n:
            log = numbered.select((F.col("vec_id") - m["next_id"] + m["next_lsn"]).alias("lsn"), F.lit(self._ms()).alias("ts_ms"), F.lit("I").alias("op"), "vec_id", "embedding", F.coalesce("metadata", F.lit(b"")).alias("metadata"))
            self._append(log, n, n)
        return m["next_id"], n

    def update(self, vec_id: int, vector: list[float], metadata: bytes | None = None) -> None:
        """Missing metadata overwrites with empty."""
        self._check(vector)
        if not 0 <= vec_id < self.manifest["next_id"]:
            raise s.IdOutOfBounds(vec_id, self.manifest["next_id"])
        if self.is_deleted(vec_id):
            raise s.UpdateDeletedVector
        self._append(self._one("U", vec_id, vector, metadata or b""), 0, 1)

    def delete(self, vec_id: int) -> bool:
        """False for an unknown or deleted id."""
        if not 0 <= vec_id < self.manifest["next_id"] or self.is_deleted(vec_id):
            return False
        self._append(self._one("D", vec_id, None, None), 0, 1)
        return True

    def delete_many(self, ids: DataFrame) -> int:
        gone = dense_numbers(ids.select("vec_id").distinct().join(self.live().select("vec_id"), "vec_id"), ["vec_id"], "lsn", self.manifest["next_lsn"])
        n = gone.count()
        if n:
            nothing = F.lit(None)
            self._append(gone.select("lsn", F.lit(self._ms()).alias("ts_ms"), F.lit("D").alias("op"), "vec_id", nothing.alias("embedding"), nothing.alias("metadata")), 0, n)
        return n

    # lookups

    def _row(self, vec_id: int):
        return self.state().where(F.col("vec_id") == vec_id).first()

    def get(self, vec_id: int) -> list[float] | None:
        row = self._row(vec_id)
        return None if row is None or row["deleted"] else list(row["embedding"])

    def get_meta(self, vec_id: int) -> bytes | None:
        if not 0 <= vec_id < self.manifest["next_id"]:
            raise s.IdOutOfBounds(vec_id, self.manifest["next_id"])
        row = self._row(vec_id)
        return None if row is None or row["deleted"] else bytes(row["metadata"])

    def is_deleted(self, vec_id: int) -> bool:
        """Unknown ids count as deleted."""
        row = self._row(vec_id)
        return row is None or row["deleted"]

    def __len__(self) -> int:
        return self.manifest["next_id"]

    def is_empty(self) -> bool:
        return len(self) == 0

    def live_len(self) -> int:
        return self.live().count()

    def deletion_stats(self) -> tuple[int, int, float]:
        r = index_state.deletion_stats(self.state()).first()
        return r["deleted"], r["total"], r["ratio"]

    def deleted_count(self) -> int:
        return self.deletion_stats()[0]

    def should_compact(self) -> bool:
        gone, total, _ = self.deletion_stats()
        return total > 0 and gone > self.config.compaction_ratio * total

    def last_written_lsn(self) -> int:
        return self.manifest["next_lsn"]

    # search

    def search(self, query: list[float], k: int, ef: int = 0) -> DataFrame:
        """(rank, vec_id, distance, score, metadata). Exact, so ``ef`` changes nothing."""
        return search.search(self.live(), query, k, self.config.dim, payload=["metadata"])

    def search_with_source_filter(self, query: list[float], k: int, ef: int, source: str, mode: str = "prefilter") -> DataFrame:
        """Rows whose JSON metadata has this ``source``; metadata that isn't JSON never matches."""
        here = F.get_json_object(F.col("metadata").cast("string"), "$.source") == source
        how = search.search_postfilter if mode == "postfilter" else search.search
        return how(self.live(), query, k, self.config.dim, where=here, payload=["metadata"])

    # maintenance

    def flush(self) -> None:
        """Replaces the log by one snapshot of the state, as of a checkpoint that takes a sequence number."""
        if not self.manifest["parts"]:
            return
        m = self.manifest
        rows = self.state().select(F.col("vec_id").alias("lsn"), F.lit(self._ms()).alias("ts_ms"), F.when(F.col("deleted"), "D").otherwise("I").alias("op"), "vec_id", "embedding", "metadata")
        self._commit(snapshot=self._write(rows), parts=[], checkpoint_lsn=m["next_lsn"], next_lsn=m["next_lsn"] + 1)
        self.vacuum()

    def compact(self) -> bool:
        """Drops deleted rows and renumbers the live ones in id order; False if there was nothing to drop."""
        if not self.deletion_stats()[0]:
            return False
        m = self.manifest
        kept = dense_numbers(self.live().withColumnRenamed("vec_id", "_old"), ["_old"], "vec_id")
        n = kept.count()
        part = self._write(kept.select(F.col("vec_id").alias("lsn"), F.lit(self._ms()).alias("ts_ms"), F.lit("I").alias("op"), "vec_id", "embedding", "metadata"))
        self._commit(snapshot=part, parts=[], next_id=n, checkpoint_lsn=m["next_lsn"], next_lsn=m["next_lsn"] + 1)
        self.vacuum()
        return True

    def vacuum(self) -> None:
        """Drops all but the last KEEP_VERSIONS versions, the parts that only they named, and parts no version ever named."""
        found = sorted(int(x.removesuffix(".json")) for x in self.files.names("versions") if x.endswith(".json"))

        def named(n: int) -> set[str]:
            version = self.files.read(f"versions/{n}.json") or {}
            return {p for p in (version.get("snapshot"), *version.get("parts", [])) if p}

        kept = set().union(*map(named, found[-KEEP_VERSIONS:]))
        for n in found[:-KEEP_VERSIONS]:
            for p in named(n) - kept:
                self.files.delete(p)
            self.files.delete(f"versions/{n}.json")
        for p in self.files.aged("data", ORPHAN_SECONDS):
            if f"data/{p}" not in kept:
                self.files.delete(f"data/{p}")

    def close(self) -> None:
        self._state = None
