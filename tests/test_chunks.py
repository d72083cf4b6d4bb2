import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brackenfold.functions import text as tx
from brackenfold.operators import syntax_chunks as sc
from brackenfold.operators.word_chunks import chunk_counts, windows, word_chunks

RUST = "use std::fs;\n\n/// Adds one to the value given here.\nfn first(a: u32) -> u32 {\n    let b = a + 1;\n    b\n}\n\nfn second(a: u32) -> u32 {\n    let c = a * 2;\n    c\n}\n"


def test_windows():
    assert [w[3] for w in windows("hello world", 10, 2)] == ["hello world"]
    assert list(windows("", 5, 1)) == [] and list(windows("  \n\t ", 5, 1)) == []
    got = [w[3].split() for w in windows("a b c d e f g h i j", 3, 1)]
    assert all(a[-1] == b[0] for a, b in zip(got, got[1:])) and got[-1][-1] == "j"


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aé漢 \n\t  b🎉", max_size=120), st.integers(1, 7), st.integers(0, 6))
def test_windows_invariants(text, limit, overlap):
    if overlap >= limit:
        return
    data, got = text.encode(), list(windows(text, limit, overlap))
    words = text.replace(" ", " ").split()
    assert [w for _, _, _, t in got[:1] for w in t.split(" ")] == words[:limit] or not words
    for _, a, b, t in got:
        assert data[a:b].decode().split() == t.split()
    step = limit - overlap
    assert len(got) == (0 if not words else 1 + max(0, -(-(len(words) - limit) // step)))


def test_word_chunks_keep_to_their_columns(spark):
    df = spark.createDataFrame([("s", "a b c", 1), (None, "x y", 2), ("n", None, 3)], "source string, text string, chunk_index int")
    got = sorted(map(tuple, word_chunks(df, 2, 1).collect()), key=str)
    assert got == sorted([("s", 0, 0, 3, "a b"), ("s", 1, 2, 5, "b c"), (None, 0, 0, 3, "x y")], key=str)
    assert {tuple(r) for r in chunk_counts(df, 2, 1).collect()} == {("s", 3, 2), (None, 2, 1)}
    with pytest.raises(ValueError):
        word_chunks(df, 2, 2)


def test_long_text_is_linear(spark):
    df = spark.createDataFrame([("big", "wörd " * 200_000)], "source string, text string")
    assert word_chunks(df, 64, 8).count() == chunk_counts(df, 64, 8).first()["n_chunks"]


def test_languages(spark):
    df = spark.createDataFrame([(x,) for x in ("a.RS", "b.tsx", "Makefile", "x.unknown", "dir.py/readme", None)], "p string")
    assert [r[0] for r in df.select(tx.language("p")).collect()][:4] == ["rust", "typescript", "make", None]
    assert [r[0] for r in df.select(tx.supported_extension("p")).collect()][:4] == [True, False, False, False]


def test_two_functions_give_two_chunks():
    got = sc.chunks_of(RUST, "a.rs", 20, 4)
    assert len(got) >= 2
    data = RUST.encode()
    for _, a, b, t in got:
        assert 0 <= a < b <= len(data) and data[a:b].decode() == t
    assert any("fn second" in t and "fn first" not in t for *_, t in got)
    assert all(len(t.split()) >= 2 for *_, t in got)


def test_json_is_one_chunk():
    text = '{"a": 1, "b": [1, 2, 3]}'
    assert [c[3] for c in sc.chunks_of(text, "x.json", 512, 64)] == [text]


def test_python_classes_and_functions():
    text = "import os\n\n\nclass A:\n    # a comment with words\n    def f(self):\n        return 1\n\n    def g(self):\n        return 2\n\n\n@dec\ndef h():\n    return 3\n"
    whole = sc.chunks_of(text, "a.py", 512, 8)
    assert len(whole) == 1
    parts = sc.chunks_of(text, "a.py", 8, 0)
    assert len(parts) > 2 and any("def g" in c[3] for c in parts)


def test_broken_sources_and_fallbacks():
    assert [c[3] for c in sc.chunks_of("def f(:\n x", "a.py", 512, 8)] == ["def f(: x"]
    assert len(sc.chunks_of("hello world this is a test", "t.xyz", 3, 1)) > 1
    assert sc.chunks_of("   ", "a.rs", 5, 1) == []
    for text in ("}}}{{{", "fn x() {", '"unterminated', "/* open", "use a::b;\nuse c::d;\n"):
        for _, a, b, t in sc.chunks_of(text, "a.rs", 3, 1):
            assert text.encode()[a:b].decode("utf-8", "ignore") == t or t == " ".join(t.split())


def test_large_class():
    text = "".join(f"import a.b.C{i};\n" for i in range(50)) + "public class Big {\n" + "".join(f"  public int m{i}(int x) {{\n    int y = x + {i};\n    return y;\n  }}\n" for i in range(30)) + "}\n"
    got = sc.chunks_of(text, "Big.java", 10, 2)
    assert len(got) > 5 and all(a < b for _, a, b, _ in got)


def test_routed(spark):
    df = spark.createDataFrame([("a.rs", RUST), ("b.txt", "one two three"), ("c", None)], "source string, text string")
    got = sc.routed_chunks(df, 20, 4).collect()
    assert {r["source"] for r in got} == {"a.rs", "b.txt"}
