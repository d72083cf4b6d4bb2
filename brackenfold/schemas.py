"""Schemas, configuration and errors of the retrieval tables."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import types as T

CHUNKS = T.StructType(
    [
        T.StructField("vec_id", T.LongType(), False),
        T.StructField("id", T.StringType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("chunk_index", T.IntegerType(), False),
        T.StructField("start_offset", T.LongType(), False),
        T.StructField("end_offset", T.LongType(), False),
        T.StructField("text", T.StringType(), False),
        T.StructField("embedding", T.ArrayType(T.FloatType(), False), False),
    ]
)
DOCUMENTS = T.StructType(
    [
        T.StructField("source", T.StringType(), False),
        T.StructField("content_hash", T.StringType(), False),
        T.StructField("indexed_at", T.LongType(), False),
        T.StructField("chunk_count", T.IntegerType(), False),
    ]
)
VECTORS = T.StructType(
    [
        T.StructField("vec_id", T.LongType(), False),
        T.StructField("embedding", T.ArrayType(T.FloatType(), False), False),
        T.StructField("metadata", T.BinaryType(), False),
        T.StructField("deleted", T.BooleanType(), False),
    ]
)
OPLOG = T.StructType(
    [
        T.StructField("lsn", T.LongType(), False),
        T.StructField("ts_ms", T.LongType(), False),
        T.StructField("op", T.StringType(), False),
        T.StructField("vec_id", T.LongType(), False),
        T.StructField("embedding", T.ArrayType(T.FloatType(), False), True),
        T.StructField("metadata", T.BinaryType(), True),
    ]
)


class EngineError(Exception):
    """Base of all errors raised by the engine."""


class DimensionMismatch(EngineError):
    def __init__(self, expected: int, got: int):
        super().__init__(f"Dimension mismatch: expected {expected}, got {got}")
        self.expected, self.got = expected, got


class IdOutOfBounds(EngineError):
    def __init__(self, vec_id: int, size: int):
        super().__init__(f"ID {vec_id} out of bounds, table has {size} rows")


class UpdateDeletedVector(EngineError):
    def __init__(self):
        super().__init__("Cannot update a deleted vector; insert a new one instead")


class Corruption(EngineError):
    pass


class ConfigMismatch(EngineError):
    pass


class CommitConflict(EngineError):
    """Another writer committed the same version first."""


class ZeroVector(EngineError):
    def __init__(self):
        super().__init__("cosine distance is undefined for a zero vector")


class NaNDistance(EngineError):
    def __init__(self):
        super().__init__("a vector has a value that isn't finite")


@dataclass(frozen=True)
class Config:
    """Settings of a vector table: its dimension, the share of deleted rows beyond which it
    should be compacted, and for its log (``SegmentLog``) the bytes from which a segment is
    closed and the bytes and number of segments that are kept. Graph parameters of other
    engines have no counterpart."""

    dim: int = 384
    compaction_ratio: float = 0.30
    log_segment_bytes: int = 64 << 20
    log_total_bytes: int = 256 << 20
    log_segments: int = 16

    def __post_init__(self):
        if self.dim < 1:
            raise ConfigMismatch("dim must be positive")

    def with_(self, **changes) -> Config:
        return replace(self, **changes)
