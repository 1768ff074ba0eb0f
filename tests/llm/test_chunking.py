import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.llm.chunking import Text, split_items
from foliospark.llm.tokens import DEFAULT_VOCABULARY, Sizer


@pytest.fixture(scope="module")
def sizer():
    with open(DEFAULT_VOCABULARY, "rb") as f:
        return Sizer(f.read())


def prose(n, seed=1):
    rng = random.Random(seed)
    return "".join(rng.choice(["alpha", "beta", "Gamma", "delta", "x1"]) + rng.choice([" ", " ", " ", ". ", "\n", "\n\n"]) for _ in range(n))


def check(sizer, text, limit, overlap):
    t = Text(text, sizer, limit // 4)
    pieces = t.pieces(limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for i, (a, b, n) in enumerate(pieces):
        assert a < b and sizer.count(text[a:b]) <= limit and n <= limit
        if i:
            assert a <= pieces[i - 1][1] < b
            shared = sizer.count(text[a : pieces[i - 1][1]])
            assert abs(shared - overlap) <= 3 or t.sliced and 0 < shared <= 2 * overlap
    return pieces


@pytest.mark.parametrize(("limit", "overlap"), [(64, 8), (256, 32), (512, 0)])
def test_prose(sizer, limit, overlap):
    text = prose(4000)
    pieces = check(sizer, text, limit, overlap)
    assert sum(text[b].isspace() for _, b, _ in pieces[:-1]) == len(pieces) - 1
    assert all(n == sizer.count(text[a:b]) for a, b, n in pieces)


@pytest.mark.parametrize("text", ["a" * 9000, "字母" * 3000, "QUJDRA==" * 900 + "\n" + "x" * 5000, " " * 4000, "\n" * 3000, "é½²x " * 700])
def test_without_breaks(sizer, text):
    check(sizer, text, 128, 16)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=400))
def test_any_text(sizer, text):
    text = text.encode("utf-8", "replace").decode()
    if sizer.count(text) > 24:
        pieces = Text(text, sizer, 6).pieces(24, 4)
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text) and all(p[0] <= q[1] for q, p in zip(pieces, pieces[1:]))
        assert all(sizer.count(text[a:b]) <= 24 + 2 for a, b, _ in pieces)


def test_edit_changes_neighbours_only(sizer):
    text = prose(6000)
    at = text.index(" ", len(text) // 2)
    edited = text[:at] + " some new words here" + text[at:]
    old = {text[a:b] for a, b, _ in Text(text, sizer).pieces(128, 0)}
    new = [edited[a:b] for a, b, _ in Text(edited, sizer).pieces(128, 0)]
    assert sum(p not in old for p in new) <= 8 < len(new)


def test_operator(spark, sizer):
    rows = [(1, prose(800), 5), (2, "short", 5), (3, "", 5), (4, None, 5), (1, prose(800), 5)]
    df = spark.createDataFrame(rows, "id bigint, text string, piece int")
    got = split_items(df, "id", "text", [(64, 8), (256, 32)]).collect()
    assert {r["id"] for r in got} == {1} and {r["size_limit"] for r in got} == {64, 256}
    assert all(r["text"] == rows[0][1][r["start_char"] : r["end_char"]] and sizer.count(r["text"]) == r["n_tokens"] for r in got)
    assert split_items(df.limit(0), "id", "text", [(64, 8)]).count() == 0
    with pytest.raises(ValueError, match="overlap"):
        split_items(df, "id", "text", [(8, 8)])
