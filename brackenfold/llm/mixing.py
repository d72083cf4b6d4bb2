"""Mixing sources to target weights.

Soft-membership mixing: a classifier fitted on labelled documents predicts to
which domain each document belongs, with its label, if it has one, as further
evidence; projected gradient descent fits nonnegative rates per document whose
expected domain totals, in tokens, come as near to the targets as the caps allow.
"""

from __future__ import annotations

import base64
import math
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brackenfold.tables import checkpoint

#: A public tokenizer's ranks and its pattern of pieces (byte-level BPE with 50,256 ids).
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how that tokenizer cuts text before merging.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Documents, drawn by a hash of the key, whose words the classifier is fitted on, about, and its hashed features.
SAMPLE_DOCS, FEATURES = 20_000, 1 << 15
#: Of these, one in so many is held out; how far the evidence of the words may count (see ``calibrated``).
HELD_OUT, SCALES = 10, [2.0**-i for i in range(9)]
#: Share of labels that are taken to be wrong.
LABEL_NOISE = 0.01
#: Steps in which a posterior counts, gradient steps at most, and the change of a total, in its target, that ends them.
POSTERIOR_STEPS, MAX_STEPS, TOLERANCE = 32, 60, 1e-4
WORDS = re.compile(r"[^\W_]+|[^\w\s]")


def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def collection(source: Column) -> Column:
    """Names are compared without case and outer blanks."""
    return F.lower(F.regexp_replace(source, r"(?U)^\s+|\s+$", ""))


@lru_cache(1 << 16)
def _feature(word: str) -> int:
    return zlib.crc32(word.encode()) % FEATURES


def features(text: str) -> np.ndarray:
    return np.fromiter({_feature(w) for w in WORDS.findall(text.lower())}, np.int64)


class Classifier:
    """Naive Bayes over the hashed words of a text. Words aren't independent: ``scale`` says how far their evidence counts."""

    def __init__(self, names: list[str]):
        self.names = names
        self.log = np.zeros((FEATURES, len(names)), np.float32)
        self.prior = np.zeros(len(names))
        self.scale = 1.0

    def fit(self, docs: np.ndarray, seen: np.ndarray) -> Classifier:
        """From the documents by name, and those by name and feature; of a name without documents nothing is expected."""
        # a feature is as usual as in all documents as long as a name has few
        usual = (seen.sum(axis=0) + 0.01) / (docs.sum() + 1)
        self.log = np.ascontiguousarray(np.log((seen + 2 * usual) / (docs[:, None] + 2)).T, np.float32)
        with np.errstate(divide="ignore"):
            self.prior = np.log(docs / max(1.0, docs.sum()))
        return self

    def evidence(self, text: str) -> np.ndarray:
        """Logarithm of how likely the text is in each name, per root of its words."""
        f = features(text or "")
        return self.log[f].sum(axis=0) / max(1.0, len(f) ** 0.5)

    def posterior(self, text: str, label: str | None = None) -> np.ndarray:
        """Of each name, given the text and the label, which is wrong in LABEL_NOISE of all cases."""
        z = self.prior + self.scale * self.evidence(text)
        if label in self.names:
            z = z + np.where(np.arange(len(self.names)) == self.names.index(label), math.log(1 - LABEL_NOISE), math.log(LABEL_NOISE / max(1, len(self.names) - 1)))
        return _shares(z)


def _shares(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max()) if np.isfinite(z).any() else np.ones(len(z))
    return p / p.sum()


def calibrated(model: Classifier, held: DataFrame) -> Classifier:
    """The model with the scale under which the labels of documents it hasn't seen are least surprising."""
    shared = held.sparkSession.sparkContext.broadcast(model)

    def loss(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        at, total = {n: i for i, n in enumerate(m.names)}, np.zeros(len(SCALES))
        for b in batches:
            for t, n in zip(b["text"], b["name"]):
                e = m.evidence(t)
                total -= [math.log(_shares(m.prior + s * e)[at[n]] + 1e-9) for s in SCALES]
        yield pd.DataFrame({"s": SCALES, "loss": total})

    best = held.mapInPandas(loss, "s double, loss double").groupBy("s").agg(F.sum("loss").alias("loss")).orderBy("loss", "s").first()
    model.scale = best["s"] if best else 1.0
    return model


def counted(read: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(documents by name, documents by name and feature) of labelled documents, counted where they are."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = {n: i for i, n in enumerate(names)}
        docs, seen = np.zeros(len(names), np.int64), np.zeros((len(names), FEATURES), np.int64)
        for b in batches:
            for t, n in zip(b["text"], b["name"]):
                docs[at[n]] += 1
                seen[at[n], features(t)] += 1
        i, f = np.nonzero(seen)
        yield pd.DataFrame({"i": np.concatenate([np.arange(len(names)), i]), "f": np.concatenate([np.full(len(names), -1), f]), "n": np.concatenate([docs, seen[i, f]])})

    # a row per name and feature at most
    rows = read.mapInPandas(count, "i int, f int, n bigint").groupBy("i", "f").agg(F.sum("n").alias("n")).toPandas()
    docs, seen = np.zeros(len(names)), np.zeros((len(names), FEATURES))
    whole = rows["f"] < 0
    docs[rows["i"][whole]] = rows["n"][whole]
    seen[rows["i"][~whole], rows["f"][~whole]] = rows["n"][~whole]
    return docs, seen


def measured(docs: DataFrame, targets: DataFrame, key: str, text: str, source: str, path: str) -> tuple[DataFrame, list]:
    """(id, name, tokens, p, cap): collection, size, posterior over the targets and most copies of each document; and the targets."""
    goal = targets.where(F.col(source).isNotNull()).select(collection(F.col(source)).alias("name"), F.col(source).alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("share"), F.greatest(F.lit(0), F.coalesce("max_repeats", F.lit(1))).alias("cap")).dropDuplicates(["name"]).orderBy("name").collect()
    names, caps = [r["name"] for r in goal], [int(r["cap"]) for r in goal]
    read = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), collection(F.col(source)).alias("name"))
    sc = docs.sparkSession.sparkContext
    labelled = read.where(F.col("name").isin(names) if names else F.lit(False))
    draw = SAMPLE_DOCS / max(1, docs.count())
    if draw < 1:
        labelled = labelled.where(F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1 << 30)) < draw * (1 << 30))
    model = None
    if names:
        # one document in HELD_OUT isn't fitted on
        held = F.pmod(F.xxhash64("id", F.lit("held out")), F.lit(HELD_OUT)) == 0
        model = Classifier(names).fit(*counted(labelled.where(~held).select("text", "name"), names))
        model = calibrated(model, labelled.where(held).select("text", "name"))
    shared = sc.broadcast((names, caps, model))
    # executors get the tokenizer from the driver
    sc.addFile(path)
    file = os.path.basename(path)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = tokenizer(SparkFiles.get(file))
        names, caps, model = shared.value
        known = set(names)
        for b in batches:
            ids, labels, p, most = b["id"], [], [], []
            for t, n in zip(b["text"], b["name"]):
                q = model.posterior(t, n) if model else np.zeros(0)
                label = n if n in known or not names else names[int(q.argmax())]
                labels.append(label)
                most.append(caps[names.index(label)] if label in known else 0)
                p.append(np.round(q * POSTERIOR_STEPS).tolist())
            yield pd.DataFrame({"id": ids, "name": labels, "tokens": [len(encoding.encode_ordinary(t)) for t in b["text"]], "p": p, "cap": most})

    kind = docs.schema[key].dataType.simpleString()
    out = read.mapInPandas(measure, f"id {kind}, name string, tokens bigint, p array<double>, cap int")
    # tokenizing is the costly step: its narrow result is written once
    whole = F.greatest(F.lit(1.0), F.aggregate("p", F.lit(0.0), lambda a, y: a + y))
    return checkpoint(out.select("id", "name", "tokens", F.transform("p", lambda x: x / whole).alias("p"), "cap")), goal


def _dot(p: Column, z: Column) -> Column:
    return F.aggregate(F.zip_with(p, z, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)


def _vector(x) -> Column:
    return F.array(*[F.lit(float(v)) for v in x])


def fitted(sized: DataFrame, goal: list) -> tuple[Column, np.ndarray, np.ndarray, float]:
    """(rate of a document as an expression of p and cap, expected tokens and available tokens by target, tokens of all documents).

    Documents with the same posterior and cap have the same rate, so the steps run
    over their sums, which are written once. A step takes each rate back by the excess of the totals it feeds,
    in proportion to what there is of each, and projects it on [0, cap]; the rate
    is a fold over the steps made so far, so no state is kept between jobs.
    """
    k = len(goal)
    sums = checkpoint(sized.groupBy("p", "cap").agg(F.sum("tokens").alias("w")))
    corpus = float(sized.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0])
    if not k:
        return F.lit(0.0), np.zeros(0), np.zeros(0), corpus
    cap = F.col("cap").cast("double")
    want = np.array([r["share"] for r in goal]) * corpus

    def totals(rate: Column) -> np.ndarray:
        row = sums.select(*[F.sum(F.col("p")[s] * F.col("w") * rate).alias(f"e{s}") for s in range(k)]).first()
        return np.array([x or 0.0 for x in row])

    there = totals(F.lit(1.0))
    steps: list[np.ndarray] = []
    rate, got = F.lit(0.0), np.zeros(k)
    for _ in range(MAX_STEPS):
        z = (got - want) / np.maximum(there, 1.0)
        steps.append(z)
        rate = F.aggregate(F.array(*[_vector(s) for s in steps]), F.lit(0.0), lambda r, z: F.least(cap, F.greatest(F.lit(0.0), r - _dot(F.col("p"), z))))
        new = totals(rate)
        moved = np.abs(new - got).max() / max(1.0, want.max())
        got = new
        if moved < TOLERANCE:
            break
    return rate, got, there, corpus


def whole_copies(rated: DataFrame) -> DataFrame:
    """``rated`` (id, name, tokens, cap, rate) with copies: rates made whole numbers whose token totals stay those of the rates.

    In each collection the documents stand in order of their size, and one gets
    a copy more than the whole part of its rate wherever the running total of
    the parts left over passes a whole number. So the copies up to any size add
    up to the rates up to there, and a collection misses its total by about one
    document. Running totals are those of range partitions plus what is before.
    """
    part = rated.withColumn("_f", F.col("rate") - F.floor(F.col("rate") + 1e-9)).withColumn("_h", F.xxhash64("id", F.lit("copies")))
    parts = checkpoint(part.repartitionByRange("name", "tokens", "_h").withColumn("_part", F.spark_partition_id()))
    sums = parts.groupBy("name", "_part").agg(F.sum("_f").alias("_s"))
    # a row per name and partition: the parts before each
    before = sums.withColumn("_before", F.coalesce(F.sum("_s").over(Window.partitionBy("name").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).select("name", "_part", "_before")
    upto = F.sum("_f").over(Window.partitionBy("_part", "name").orderBy("tokens", "_h", "id").rowsBetween(Window.unboundedPreceding, 0))
    run = parts.withColumn("_upto", upto).join(F.broadcast(before), ["name", "_part"])
    end = F.col("_before") + F.col("_upto") + 0.5
    extra = F.floor(end + 1e-9) - F.floor(end - F.col("_f") + 1e-9)
    return run.withColumn("copies", F.least("cap", (F.floor(F.col("rate") + 1e-9) + extra).cast("int"))).drop("_f", "_h", "_part", "_upto", "_before")


def mix(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", path: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(the mixed set, its report).

    The set has (key, source, tokens, rate, copies) with copies >= 1 for each
    document used, never more than the cap of its collection. Its source is its
    label where that is a target, else the collection that the classifier finds
    most likely. The report has one row per target: source, target_share,
    max_repeats, tokens (available, expected under the posteriors),
    expected_share under the posteriors and actual_share by the sources of the
    set, both of the tokens of all documents, since the set is to be as large as
    the corpus.

    Names are compared without case and outer blanks. The classifier is fitted
    on the words of about SAMPLE_DOCS documents and gives each document its
    posteriors; a label counts as evidence that is wrong in LABEL_NOISE of all
    cases. A document whose source is null or no target is where its text says;
    it counts in the corpus size. Null texts have no tokens. A null share is 0, a
    null cap 1. Of targets with the same name one counts. Empty tables give an
    empty set and shares of 0.
    """
    spark = docs.sparkSession
    sized, goal = measured(docs, targets, key, text, source, path)
    rate, expected, there, corpus = fitted(sized, goal)
    rated = sized.where(F.col("name").isNotNull()).withColumn("rate", rate).drop("p")
    # soft members count in several collections, but a document of the set in one: its rates are brought to the fitted totals
    named = {r["name"]: float(r["t"]) for r in rated.groupBy("name").agg(F.sum(F.col("tokens") * F.col("rate")).alias("t")).collect()}
    lift = [(r["name"], e / named[r["name"]]) for r, e in zip(goal, expected) if named.get(r["name"], 0.0) > 0]
    if lift:
        factor = F.create_map(*[F.lit(x) for pair in lift for x in pair])[F.col("name")]
        rated = rated.withColumn("rate", F.least(F.col("cap").cast("double"), F.col("rate") * F.coalesce(factor, F.lit(1.0))))
    chosen = checkpoint(whole_copies(rated).where("copies > 0"))
    mixed = chosen.select(F.col("id").alias(key), F.col("name").alias(source), "tokens", "rate", "copies")
    # a row per target
    actual = {r["name"]: float(r["t"]) for r in chosen.groupBy("name").agg(F.sum(F.col("tokens") * F.col("copies")).alias("t")).collect()}
    size = max(corpus, 1.0)
    rows = [(r["source"], float(r["share"]), int(r["cap"]), float(t), float(e / size), actual.get(r["name"], 0.0) / size) for r, t, e in zip(goal, there, expected)]
    report = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, tokens double, expected_share double, actual_share double")
    return mixed, report


def unreachable(report: DataFrame, slack: float = 0.005) -> DataFrame:
    """(source): targets above 0 that the fitted rates, at their caps, don't reach."""
    return report.where((F.col("target_share") > 0) & (F.col("expected_share") < F.col("target_share") * (1 - slack))).select("source")
