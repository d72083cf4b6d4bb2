import os
import random

import numpy as np
import pytest

from brackenfold.llm import mixing as mx

pytestmark = pytest.mark.skipif(not os.path.exists(mx.TOKENIZER), reason="tokenizer files are absent")
DOCS = "doc_id bigint, text string, source string, tokens int"
TARGETS = "source string, target_share double, max_repeats int"
WORDS = {"code": "let mut fn return struct match vec".split(), "news": "minister said parliament budget vote week".split(), "food": "flour water salt bake bread oven".split()}


def text(kind, seed, n=40):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS[kind]) for _ in range(n))


def docs(spark, n=300, unlabelled=0):
    names = {"code": [" Code", "CODE", "code "], "news": ["news"], "food": ["food"]}
    r = random.Random(0)
    rows = []
    for i in range(n):
        kind = r.choices(["code", "news", "food"], [6, 3, 1])[0]
        rows.append((i, text(kind, i), r.choice(names[kind]), 1))
    rows += [(n + i, text("code", 10_000 + i), None if i % 2 else "other", 1) for i in range(unlabelled)]
    return spark.createDataFrame(rows, DOCS)


def test_targets_and_caps(spark):
    targets = spark.createDataFrame([("code", 0.3, 2), ("news", 0.5, 4), ("food", 0.2, 1), ("none", 0.0, 3), ("gone", 0.0, None)], TARGETS)
    mixed, report = mx.mix(docs(spark), targets)
    r = {x["source"]: x for x in report.collect()}
    total = sum(x["tokens"] for x in r.values())
    for name, share, cap in (("code", 0.3, 2), ("news", 0.5, 4), ("food", 0.2, 1)):
        reach = min(share, cap * r[name]["tokens"] / total)
        assert r[name]["expected_share"] == pytest.approx(reach, rel=0.01)
        assert r[name]["actual_share"] == pytest.approx(reach, abs=0.04)
    assert {x[0] for x in mx.unreachable(report).collect()} == {"food"}
    caps = {"code": 2, "news": 4, "food": 1}
    assert all(1 <= m["copies"] <= caps[m["source"]] for m in mixed.collect())
    assert mixed.columns == ["doc_id", "source", "tokens", "rate", "copies"]


def test_unlabelled_documents_go_where_the_classifier_says(spark):
    targets = spark.createDataFrame([("code", 0.4, 3), ("news", 0.4, 3), ("food", 0.2, 5)], TARGETS)
    sized, goal = mx.measured(docs(spark, 300, 60), targets, "doc_id", "text", "source", mx.TOKENIZER)
    at = [g["name"] for g in goal].index("code")
    p = [r["p"] for r in sized.where("id >= 300").collect()]
    assert len(p) == 60 and sum(x[at] > 0.8 for x in p) >= 54
    _, report = mx.mix(docs(spark, 300, 60), targets)
    for x in report.collect():
        assert x["expected_share"] == pytest.approx(x["target_share"], rel=0.02)


def test_held_out_accuracy():
    docs, seen = np.zeros(3), np.zeros((3, mx.FEATURES))
    for i, k in enumerate(WORDS):
        for n in range(150):
            docs[i] += 1
            seen[i, mx.features(text(k, n))] += 1
    model = mx.Classifier(list(WORDS)).fit(docs, seen)
    right = sum(model.names[model.posterior(text(k, 5000 + i)).argmax()] == k for i in range(50) for k in WORDS)
    assert right >= 140
    # a label weighs more than a doubtful text and less than a clear one
    assert model.posterior("the of", "news").argmax() == 1
    assert model.posterior(text("food", 1, 4000), "news")[2] > 0.3


def test_counts_are_those_of_all_documents(spark):
    got, seen = mx.counted(spark.createDataFrame([("a b a", "x"), ("b", "y"), ("b c", "y"), ("", "x")], "text string, name string").repartition(3), ["x", "y"])
    assert got.tolist() == [2, 2] and seen.sum() == 5 and seen[1, mx.features("b")].tolist() == [2]


def test_caps_hold_for_documents_without_a_label(spark):
    targets = spark.createDataFrame([("code", 0.6, 1), ("news", 0.4, 4)], TARGETS)
    rows = [(i, text("code", i), "code") for i in range(60)] + [(100 + i, text("news", i), "news") for i in range(60)]
    rows += [(200 + i, text("code", i, 20) + " " + text("news", i, 20), None) for i in range(40)]
    mixed, _ = mx.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), targets)
    caps = {"code": 1, "news": 4}
    got = mixed.collect()
    assert got and all(1 <= m["copies"] <= caps[m["source"]] for m in got)


def test_reachable_targets_are_met_within_a_hundredth(spark):
    targets = spark.createDataFrame([("code", 0.47, 3), ("news", 0.33, 3), ("food", 0.2, 9)], TARGETS)
    r = random.Random(5)
    rows = [(i, text(k, i, r.randint(5, 200)), k) for i, k in enumerate(r.choices(["code", "news", "food"], [5, 4, 1], k=1500))]
    _, report = mx.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), targets)
    for x in report.collect():
        assert x["actual_share"] == pytest.approx(x["target_share"], rel=0.01)


def test_nulls_and_empty(spark):
    targets = spark.createDataFrame([("code", 0.5, 2), ("CODE ", 0.9, 1), (None, 0.5, 1), ("news", None, None)], TARGETS)
    rows = spark.createDataFrame([(1, None, "code", 1), (2, "", "code", 1), (3, "a b c", None, 1), (None, "x y", "code", 1)], DOCS)
    _, report = mx.mix(rows, targets)
    assert {r["source"].strip().lower() for r in report.collect()} == {"code", "news"}
    mixed, report = mx.mix(rows.where("false"), targets)
    assert mixed.count() == 0 and report.count() == 2
    mixed, report = mx.mix(rows, targets.where("false"))
    assert mixed.count() == 0 and report.count() == 0


def test_token_counts_are_those_of_the_tokenizer(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(mx.TOKENIZER, "rb"))}
    own = tiktoken.Encoding("own", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={})
    for t in ("Hello world, it's 2026!", "  spaces \n\n and 漢字 ", "<|endoftext|>"):
        assert mx.tokenizer(mx.TOKENIZER).encode_ordinary(t) == own.encode_ordinary(t)
