import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.llm.packing import batches, bucket_bounds, pack
from foliospark.llm.tokens import DEFAULT_VOCABULARY, Sizer, sized


@pytest.fixture(scope="module")
def sizer():
    with open(DEFAULT_VOCABULARY, "rb") as f:
        return Sizer(f.read())


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_words_are_independent(sizer, text):
    text = text.encode("utf-8", "replace").decode()
    words = sizer.words(text)
    assert "".join(words) == text
    assert sum(map(sizer.count, words)) == sizer.count(text)


def cost(counts, bounds):
    return sum(int(c) * (next(b for b in bounds if b >= i) - i) for i, c in enumerate(counts) if c and i)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=2, max_size=9), st.integers(1, 4))
def test_bounds_are_optimal(counts, k):
    counts = np.array([0, *counts])
    lengths = [int(i) for i in np.flatnonzero(counts)]
    got = bucket_bounds(counts, k)
    if not lengths:
        assert got == []
        return
    best = min(cost(counts, [*c, lengths[-1]]) for r in range(min(k, len(lengths))) for c in itertools.combinations(lengths[:-1], r))
    assert len(got) <= max(k, 1) and got[-1] == lengths[-1] and cost(counts, got) == best


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), min_size=1, max_size=8))
def test_batches_use_all(items):
    bounds = sorted(items)
    used = dict.fromkeys(range(len(bounds)), 0)
    for times, batch in batches(bounds, [items[b] for b in bounds], 30):
        assert times > 0 and sum(bounds[b] * c for b, c in batch) <= 30
        for b, c in batch:
            used[b] += c * times
    assert [used[i] for i in range(len(bounds))] == [items[b] for b in bounds]


def test_pack(spark):
    rng = np.random.default_rng(5)
    sizes = [int(x) for x in np.clip(rng.lognormal(3, 1.2, 3000), 1, None)] + [0, 0, 100, 200, 250, 1001] + [40] * 1500
    items = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)] + [(99_999, None)], "id bigint, n bigint")
    rows = pack(items, 100, buckets=20).collect()
    total, load, seen = {}, {}, set()
    for r in rows:
        total[r["id"]] = total.get(r["id"], 0) + r["n"]
        assert (r["id"], r["piece"]) not in seen
        seen.add((r["id"], r["piece"]))
        if r["container"] is None:
            assert r["n"] == 0
            continue
        assert r["first_token"] == r["piece"] * 100
        load.setdefault(r["container"], []).append((r["slot"], r["n"]))
    assert total == {**dict(enumerate(sizes)), 99_999: 0}
    assert sorted(load) == list(range(len(load)))
    assert all(sum(n for _, n in v) <= 100 and len({s for s, _ in v}) == len(v) for v in load.values())
    assert all(sum(1 for r in rows if r["id"] == i) == 1 for i, n in enumerate(sizes[:200]) if n <= 100)
    assert sum(sizes) / len(load) / 100 > 0.93
    assert pack(items.limit(0), 100).count() == 0


def test_sized(spark, sizer):
    texts = ["", None, "Hello\n\n  world", "字" * 5000, "a" * 100_000]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc bigint, body string, n2 string")
    assert {r["id"]: r["n"] for r in sized(df, "doc", "body", ["n2"]).collect()} == {i: sizer.count(t) for i, t in enumerate(texts)}


def test_null_ids(spark):
    big = 2**60 + 1
    df = spark.createDataFrame([(big, "one two"), (None, "three")], "id bigint, text string")
    items = sized(df, "id", "text")
    assert {(r["id"], r["n"]) for r in items.collect()} == {(big, 2), (None, 1)}
    assert {r["id"] for r in pack(items, 100).collect()} == {big, None}
