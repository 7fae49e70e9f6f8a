import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscale.llm.splitting import RangeMaximum, boundary_strengths, pieces, split_oversized
from folioscale.session import local_session

TEXTS = st.lists(st.sampled_from(["word", "a", ". ", ", ", " ", "\n", "\n\n", "é", "é", "👩‍🔬", "🇩🇪", "…", "。", "x" * 40]), max_size=300).map("".join)


@settings(max_examples=80, deadline=None)
@given(TEXTS, st.integers(12, 90), st.integers(0, 5))
def test_pieces_cover_the_text_within_the_limit(text, limit, overlap):
    spans = pieces(text, limit, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(b - a <= limit for a, b in spans)
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert a < c and b < d and 0 <= b - c <= overlap


def test_the_strongest_cut_in_reach_is_taken_and_ties_go_right():
    text = "One two. " * 3 + "\n\n" + "three four " * 3
    assert pieces(text, 40, 0)[0] == (0, 29)
    assert pieces("aa bb cc dd ee", 12, 0)[0] == (0, 12)


def test_no_cut_inside_a_combined_character():
    for text in ("é" * 30, "🇩🇪" * 30, "👍🏽" * 30, "कि" * 30):
        strength = boundary_strengths(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32))
        assert (strength[1:-1][::2] == -1).all() and all(a % 2 == 0 and b % 2 == 0 for a, b in pieces(text, 12, 3)), text


def test_range_maximum_against_brute_force():
    keys = np.random.default_rng(1).integers(0, 50, 200)
    table = RangeMaximum(keys, 64)
    for i in range(0, 130, 7):
        for n in (1, 2, 3, 17, 63, 64):
            assert table.largest(i, i + n) == keys[i : i + n].max()


def test_rows_within_the_limit_nulls_and_other_columns():
    spark = local_session(2, 2, "1g")
    rows = [("a", "x " * 40, 1), ("b", "short", 2), ("c", None, 3), ("d", "", 4)]
    table = spark.createDataFrame(rows, "id string, text string, piece int")
    got = split_oversized(table, ["id"], "text", limit=30, overlap=4).collect()
    assert {r.id for r in got} == {"a"} and all(r.piece_text == ("x " * 40)[r.char_start : r.char_end] for r in got)
    assert split_oversized(table.limit(0), ["id"], "text").count() == 0
    with pytest.raises(ValueError):
        pieces("x" * 50, 10, 6)
