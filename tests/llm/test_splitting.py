import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brackenfold.llm import splitting as sp

LIMITS = "chunker_id int, max_chunk_size int, overlap int"
ROWS = "vec_id bigint, source string, start_offset bigint, end_offset bigint, text string, chunker_id int"


def check(text, limit, overlap):
    words = sp.WORD.findall(text)
    got = sp.pieces(text, limit, overlap)
    assert got[0][0] == 0 and got[-1][2] == len(words)
    for lead, own, stop, a, b in got:
        assert 0 < stop - lead <= limit and sp.WORD.findall(text[a:b]) == words[lead:stop]
    for p, q in zip(got, got[1:]):
        assert q[1] == p[2] and q[0] == p[2] - overlap and p[0] <= q[0]
    return got


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.", "C!", "word,", "x;\n", "}\n", "\n\n", "Dr.", "漢字。", "　"]), min_size=1, max_size=150), st.integers(1, 20), st.integers(0, 19))
def test_pieces_hold_the_limit_and_share_words(parts, limit, overlap):
    text = " ".join(parts)
    if overlap < limit and sp.WORD.search(text):
        check(text, limit, overlap)


def test_cuts_at_natural_boundaries():
    text = "One two three. " * 3 + "\n\n" + "Four five six seven. " * 2
    got = check(text, 9, 0)
    assert [text[a:b].strip() for *_, a, b in got] == [("One two three. " * 3).strip(), ("Four five six seven. " * 2).strip()]
    got = check("Dr. Who met A. B. Smith there. Then he left the house at once.", 8, 2)
    assert got[0][2] == 7


def test_unicode_white_space_only():
    assert len(sp.WORD.findall("a\x1cb c​d e　f\x85g")) == 5  # U+001C and U+200B aren't white space


def test_operator(spark):
    limits = spark.createDataFrame([(1, 4, 1), (2, 100, 0), (3, None, 1), (4, 3, 9)], LIMITS)
    text = "alpha beta gamma. delta epsilon zeta eta"
    rows = [
        (1, "s", 10, 10 + len(text), text, 1),
        (1, "s", 10, 10 + len(text), text, 1),
        (2, "s", 10, 99, text, 1),
        (3, None, None, None, text, 1),
        (4, "s", 0, 5, text, 2),
        (5, "s", 0, 5, text, 3),
        (6, "s", 0, 5, None, 1),
        (7, "s", 0, 5, "", 1),
        (8, "s", 0, 9, "x" * 10_000, 1),
        (9, "s", 0, 9, "a b c d e f", 4),
        (10, "s", 0, 9, text, None),
    ]
    got = sp.split_oversized(spark.createDataFrame(rows, ROWS), limits).toPandas()
    assert sorted(set(got.vec_id)) == [1, 2, 3, 9]
    one = got[got.vec_id == 1].sort_values("piece_index")
    assert list(one.piece_index) == list(range(len(one))) and (one.piece_words <= 4).all() and list(one.overlap_words)[0] == 0
    assert all(text[int(r.start_offset) - 10 : int(r.end_offset) - 10] == r.text == text[r.text_start : r.text_end] for r in one.itertuples())
    two = got[got.vec_id == 2].sort_values("piece_index")
    assert two.start_offset.iloc[0] == 10 and two.end_offset.iloc[-1] == 99 and pd.isna(two.end_offset.iloc[0])
    assert sp.split_oversized(spark.createDataFrame([], ROWS), limits).count() == 0


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "s", 0, 13, "a b c d e f g", 1, 5, "x")], ROWS + ", piece_index int, boundary string")
    got = sp.split_oversized(df, spark.createDataFrame([(1, 4, 1)], LIMITS))
    assert {r["piece_index_in"] for r in got.collect()} == {5} and "boundary_in" in got.columns


def test_byte_offsets_in_one_pass():
    text = "añ漢😀b" * 50_000
    at = sp.byte_offsets(text)
    assert len(at) == len(text) + 1 and at[-1] == len(text.encode()) and all(at[i] == len(text[:i].encode()) for i in range(40))
    assert list(sp.byte_offsets("abc")) == [0, 1, 2, 3]


def test_long_text():
    text = "Some words here. " * 40_000
    got = check(text, 64, 8)
    assert len(got) < 4_500


@pytest.mark.parametrize("word, gap, following, kind", [("end.", " ", "Next", "sentence"), ("Mr.", " ", "X", "word"), ("x,", " ", "y", "clause"), ("a", "\n\n", "b", "paragraph"), ("}", "\n", "fn", "block end"), ("a", "\n", "b", "line")])
def test_boundaries(word, gap, following, kind):
    assert sp.BOUNDARIES[sp.strength(word, gap, following)] == kind
