import random

import pytest

from brackenfold.llm import contamination as ct

ITEMS = "item_id bigint, text string"
DOCS = "doc_id bigint, text string, held string"
R = random.Random(4)
VOCABULARY = ["".join(R.choice("abcdefghijklmnop") for _ in range(R.randint(3, 8))) for _ in range(400)]


def passage(seed, n=60):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def distance(a, b):
    """Least edit distance of a to any part of b, by the textbook table."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_myers_against_table():
    r = random.Random(1)
    for _ in range(300):
        a, b = [r.choice("abc") for _ in range(r.randint(1, 12))], [r.choice("abc") for _ in range(r.randint(0, 20))]
        assert ct.myers(a, b)[0] == distance(a, b)


def test_tokens():
    assert ct.tokens("<b>Hello</b>,\nWORLD &amp; caf\\u00e9 na%C3%AFve co-\noperate") == ["hello", "world", "café", "naïve", "cooperate"]
    assert ct.tokens("漢字とa1") == ["漢", "字", "と", "a1"]


def find(items, docs):
    index = ct.Items(items)
    return {(i, d) for d, t in docs for i, _, _ in index.found(t, 0.5)}


def test_whole_half_altered_and_disguised():
    a, b = passage(10), passage(11)
    w = a.split()
    r = random.Random(2)
    altered = " ".join(x[::-1] if r.random() < 0.1 else x for x in w)
    docs = [
        (1, f"before {a} after"),
        (2, passage(12) + " " + " ".join(w[:36]) + " " + passage(13)),
        (3, passage(14) + altered + passage(15)),
        (4, "\n".join(x.upper() + "," for x in w)),
        (5, " ".join(w[:20]) + " " + passage(16, 40) + " " + " ".join(w[20:42])),
        (6, "<p>" + "</p><p>".join(" ".join(w[i : i + 7]) for i in range(0, 60, 7)) + "</p>"),
        (7, " ".join(w[:15])),
        (8, " ".join(w[30:48]) + passage(17) + " ".join(w[0:15])),
        (9, passage(18, 600)),
        (10, ""),
    ]
    assert find([(1, a), (2, b)], docs) == {(1, d) for d in range(1, 7)}


def test_operator(spark, monkeypatch):
    a, b, c = passage(20), passage(21), passage(22)
    items = spark.createDataFrame([(1, a), (2, b), (2, b), (3, None), (4, ""), (None, c), (5, "two words")], ITEMS)
    docs = spark.createDataFrame([(1, a, "x"), (1, a, "x"), (2, f"{b} {a}", None), (3, None, "y"), (None, a, "z"), (4, passage(23, 50_000) + b, "w")], DOCS)
    want = {(1, 1), (1, 2), (2, 2), (2, 4)}
    short = spark.createDataFrame([(7, "Two WORDS"), (8, "漢"), (9, "..")], ITEMS)
    texts = spark.createDataFrame([(1, "it takes two <b>words</b> here", ""), (2, "words two", ""), (3, "在漢字", "")], DOCS)
    assert {(r["item_id"], r["doc_id"]) for r in ct.leaks(texts, short).collect()} == {(7, 1), (8, 3)}
    for size in (ct.BLOCK_CHARS, 300):
        monkeypatch.setattr(ct, "BLOCK_CHARS", size)
        got = ct.leaks(docs, items).collect()
        assert {(r["item_id"], r["doc_id"]) for r in got} == want and len(got) == 4 and all(r["held"] > 0.9 for r in got)
    assert ct.leaks(docs.where("false"), items).count() == 0
    assert ct.leaks(docs, items.where("false")).count() == 0


@pytest.mark.parametrize("part, found", [(0.7, True), (0.3, False)])
def test_share(part, found):
    a = passage(30, 80).split()
    text = passage(31) + " " + " ".join(a[: int(80 * part)]) + " " + passage(32)
    assert bool(find([(1, " ".join(a))], [(1, text)])) is found
