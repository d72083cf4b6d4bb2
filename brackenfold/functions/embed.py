"""Text embedding: a registry of embedders and the built-in feature hashing."""

from __future__ import annotations

import hashlib
import logging
import re
from dataclasses import dataclass
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# Names of public embedding models that callers may ask for.
MODELS = """sentence-transformers/all-MiniLM-L6-v2
Quantized sentence-transformers/all-MiniLM-L6-v2
sentence-transformers/all-MiniLM-L12-v2
Quantized sentence-transformers/all-MiniLM-L12-v2
sentence-transformers/all-mpnet-base-v2
BAAI/bge-base-en-v1.5
Quantized BAAI/bge-base-en-v1.5
BAAI/bge-large-en-v1.5
Quantized BAAI/bge-large-en-v1.5
BAAI/bge-small-en-v1.5 - Default
Quantized BAAI/bge-small-en-v1.5
nomic-ai/nomic-embed-text-v1
nomic-ai/nomic-embed-text-v1.5
Quantized v1.5 nomic-ai/nomic-embed-text-v1.5
sentence-transformers/paraphrase-MiniLM-L6-v2
Quantized sentence-transformers/paraphrase-MiniLM-L6-v2
sentence-transformers/paraphrase-mpnet-base-v2
BAAI/bge-small-zh-v1.5
BAAI/bge-large-zh-v1.5
BAAI/bge-m3
lightonai/modernbert-embed-large
intfloat/multilingual-e5-small
intfloat/multilingual-e5-base
intfloat/multilingual-e5-large
mixedbread-ai/mxbai-embed-large-v1
Quantized mixedbread-ai/mxbai-embed-large-v1
Alibaba-NLP/gte-base-en-v1.5
Quantized Alibaba-NLP/gte-base-en-v1.5
Alibaba-NLP/gte-large-en-v1.5
Quantized Alibaba-NLP/gte-large-en-v1.5
Qdrant/clip-ViT-B-32-text
jinaai/jina-embeddings-v2-base-code
jinaai/jina-embeddings-v2-base-en
onnx-community/embeddinggemma-300m-ONNX
Quantized (4-bit) onnx-community/embeddinggemma-300m-ONNX
Quantized onnx-community/embeddinggemma-300m-ONNX
snowflake/snowflake-arctic-embed-xs
Quantized snowflake/snowflake-arctic-embed-xs
snowflake/snowflake-arctic-embed-s
Quantized snowflake/snowflake-arctic-embed-s
snowflake/snowflake-arctic-embed-m
Quantized snowflake/snowflake-arctic-embed-m
snowflake/snowflake-arctic-embed-m-long
Quantized snowflake/snowflake-arctic-embed-m-long
snowflake/snowflake-arctic-embed-l
Quantized snowflake/snowflake-arctic-embed-l""".splitlines()
#: Accepted besides the listed names.
ALIASES = {"Xenova/bge-small-en-v1.5": "BAAI/bge-small-en-v1.5 - Default"}
FALLBACK = MODELS[0]
TOKEN = r"[\p{L}\p{N}_]+"


class Embedder(Protocol):
    """Turns a text column into array<float>, and one query text into a list."""

    name: str
    dim: int

    def column(self, text: Column) -> Column: ...

    def query(self, text: str) -> list[float]: ...


@dataclass(frozen=True)
class HashingEmbedder:
    """Signed feature hashing of lower-cased words; counts, not scaled, since cosine doesn't depend on length.

    bucket = first 8 hex digits of the word's MD5 modulo dim, sign = parity of
    the ninth. A text without words becomes a zero vector, which is never found.
    """

    dim: int = 384
    name: str = "feature-hashing"

    def column(self, text: Column) -> Column:
        dim = self.dim

        @pandas_udf("array<float>")
        def embed(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: None if t is None else hashed(t, dim))

        return embed(text)

    def query(self, text: str) -> list[float]:
        return hashed(text, self.dim).tolist()


WORD = re.compile(r"\w+")


@lru_cache(maxsize=1 << 18)
def feature(word: str, dim: int) -> tuple[int, int]:
    """(bucket, sign) of a word; each worker hashes a word once."""
    h = hashlib.md5(word.encode()).hexdigest()
    return int(h[:8], 16) % dim, 1 - 2 * (int(h[8], 16) % 2)


def hashed(text: str, dim: int) -> np.ndarray:
    found = [feature(w, dim) for w in WORD.findall(text.lower())]
    if not found:
        return np.zeros(dim, np.float32)
    at, sign = zip(*found)
    return np.bincount(at, weights=sign, minlength=dim).astype(np.float32)


def resolve(name: str, dim: int = 384) -> Embedder:
    """The embedder of a name. Weights of the listed models aren't shipped: they
    resolve to feature hashing under their name; unknown names fall back with a warning."""
    known = ALIASES.get(name, name)
    if known not in MODELS and known != HashingEmbedder.name:
        logging.getLogger(__name__).warning("unknown model %s, using %s", name, FALLBACK)
        known = FALLBACK
    return HashingEmbedder(dim, known)


def list_models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, m) for i, m in enumerate(MODELS)], "position int, model string")


def term_counts(df: DataFrame, key: str, text: str, dim: int) -> DataFrame:
    """(key, bucket, value): the hashed features in sparse form, all in the JVM."""
    t = F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(TOKEN), F.lit(0)))
    h = F.md5("token")
    bucket = F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint"), F.lit(dim)).cast("int")
    sign = F.when(F.conv(F.substring(h, 9, 1), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    return df.select(key, t.alias("token")).groupBy(key, bucket.alias("bucket")).agg(F.sum(sign).cast("bigint").alias("value")).where("value <> 0")
