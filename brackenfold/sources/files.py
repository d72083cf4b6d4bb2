"""Scanning directories: listing, type filter, content, hash and text."""

from __future__ import annotations

import logging
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brackenfold.functions import text as tx
from brackenfold.sources import extract

LISTING = "path string, size bigint"


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Paths that are there; missing ones are logged and skipped."""
    out = []
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            out.append(p)
        else:
            logging.getLogger(__name__).warning("no such path: %s", p)
    return out


def scan(spark: SparkSession, paths: list[str], extensions: tuple[str, ...] = tx.INDEXABLE) -> DataFrame:
    """(source, content, content_hash): all files below ``paths`` with an accepted extension, in no order.

    The type filter is pushed to the listing, so other files are never opened.
    Zero-length files are included.
    """
    schema = "source string, content binary, content_hash string"
    paths = existing(spark, paths)
    if not paths:
        return spark.createDataFrame([], schema)
    globs = "*.{" + ",".join(sorted({x for e in extensions for x in (e, e.upper())})) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", globs).load(paths)
    local = F.regexp_replace("path", "^file:(//)?", "")
    read = files.select(local.alias("source"), "content").where(tx.extension(F.col("source")).isin(*extensions))
    empty = spark.createDataFrame([(p, bytearray()) for p in _empty_files(spark, paths)], "source string, content binary").where(tx.extension(F.col("source")).isin(*extensions))
    both = read.where(F.length("content") > 0).unionByName(empty)
    return both.withColumn("content_hash", tx.content_hash("content"))


def _empty_files(spark: SparkSession, paths: list[str]) -> list[str]:
    """binaryFile leaves out files without content: their names come from the listing."""
    out = []
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.getFileStatus(path).isFile():
            found = [fs.getFileStatus(path)]
        else:
            it, found = fs.listFiles(path, True), []
            while it.hasNext():
                found.append(it.next())
        out += [os.path.normpath(x.getPath().toUri().getPath()) for x in found if x.getLen() == 0]
    return out


def read_texts(files: DataFrame) -> DataFrame:
    """(source, content_hash, text, error): the text of each file by its type; one of text and error is null."""
    return files.mapInPandas(extract.texts, "source string, content_hash string, text string, error string")
