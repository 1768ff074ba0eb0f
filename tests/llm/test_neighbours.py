import itertools

import numpy as np
import pytest

from foliospark.llm.neighbours import hilbert_keys, nearest, window_neighbours


def brute(rows, k):
    out = set()
    for i, *p in rows:
        near = sorted((float(np.sqrt(sum((a - b) ** 2 for a, b in zip(p, q)))), j) for j, *q in rows if j != i)
        out |= {(i, j) for _, j in near[:k]}
    return out


def test_curve_visits_neighbours():
    for m, bits in ((2, 4), (3, 3)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=m)))
        keys = hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        path = cells[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_recall_and_ties(spark):
    rng = np.random.default_rng(3)
    rows = [(i, *map(float, p)) for i, p in enumerate(np.concatenate([rng.normal(0, 1, (900, 3)), rng.normal(9, 0.2, (900, 3))]))]
    df = spark.createDataFrame(rows, "id bigint, x double, y double, z double")
    got = {tuple(r) for r in nearest(df, "id", ["x", "y", "z"], 8, block_rows=256).collect()}
    want = brute(rows, 8)
    assert len(got & want) / len(want) > 0.95 and len(got) == len(want)


def test_crowded_places_and_dirt(spark):
    rows = [(i, 1.0, 2.0, 3.0) for i in range(40)] + [(100 + i, 5.0 + i, 0.0, 0.0) for i in range(5)] + [(7, 1.0, 2.0, 3.0)]
    bad = [(900, None, 0.0, 0.0), (901, float("nan"), 0.0, 0.0), (None, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows + bad, "id bigint, x double, y double, z double")
    got = [tuple(r) for r in nearest(df, "id", ["x", "y", "z"], 8).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(sorted(set(rows)), 8)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few(spark, n):
    df = spark.createDataFrame([(i, float(i), 0.0) for i in range(n)], "id bigint, a double, b double")
    assert nearest(df, "id", ["a", "b"], 8).count() == n * max(0, n - 1)


def test_windows_hold_what_brute_force_finds():
    rng = np.random.default_rng(1)
    v = np.round(rng.normal(size=(60, 2)), 1)
    ids = rng.permutation(60).astype(np.int64)
    for k, window in ((3, 5), (8, 4), (4, 80)):
        for first, last in ((0, 60), (7, 31)):
            dd, oo = window_neighbours(v, ids, first, last, k, window)
            for r, i in enumerate(range(first, last)):
                near = sorted((float(np.sqrt(((v[i] - v[j]) ** 2).sum())), int(ids[j])) for j in range(max(0, i - window), min(60, i + window + 1)) if j != i)[:k]
                got = [(float(a), int(b)) for a, b in zip(dd[r], oo[r]) if np.isfinite(a)]
                assert [b for _, b in got] == [b for _, b in near] and np.allclose([a for a, _ in got], [a for a, _ in near])


def test_partitions_are_walked_in_batches(spark):
    rng = np.random.default_rng(5)
    rows = [(i, *map(float, p)) for i, p in enumerate(rng.normal(size=(1500, 3)))]
    df = spark.createDataFrame(rows, "id bigint, x double, y double, z double")
    want = {tuple(r) for r in nearest(df, "id", ["x", "y", "z"], 8).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        assert {tuple(r) for r in nearest(df, "id", ["x", "y", "z"], 8).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("kind", ["normal 16", "clusters 64"])
def test_recall_in_many_dimensions(spark, kind):
    rng = np.random.default_rng(7)
    n, d = 3000, int(kind.split()[1])
    v = rng.normal(size=(n, d)) + (rng.normal(size=(40, d))[rng.integers(0, 40, n)] * 3 if kind.startswith("clusters") else 0)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, v array<double>")
    got = {tuple(r) for r in nearest(df, "id", "v", 8).collect()}
    dist = (v * v).sum(1)[:, None] + (v * v).sum(1)[None] - 2 * v @ v.T
    np.fill_diagonal(dist, np.inf)
    want = {(i, int(j)) for i, row in enumerate(np.argpartition(dist, 8, axis=1)[:, :8]) for j in row}
    assert len(got) == 8 * n and len(got & want) > 0.9 * len(want)
