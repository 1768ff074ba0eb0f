import numpy as np

from foliospark.llm.mixing import fit_rates, memberships, mix, reached

TARGETS = [("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.1, 2), ("gone", 0.1, 2)]


def targets(spark, rows=TARGETS):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_exact_shares(spark):
    rng = np.random.default_rng(2)
    docs = [(i, s, "word " * int(rng.integers(1, 60))) for i, s in enumerate(rng.choice(["a", "b", "c", "x"], 2500, p=[0.6, 0.05, 0.15, 0.2]).tolist())] + [(9000, "a", ""), (9001, "a", None)]
    df = spark.createDataFrame(docs, "id bigint, source string, text string")
    t = targets(spark)
    mixed = mix(memberships(df, "id", "text", "source", ["a", "b", "c", "gone"]), t)
    rows = mixed.collect()
    cap = {s: m for s, _, m in TARGETS}
    assert len({r["id"] for r in rows}) == len(rows) and all(1 <= r["repeats"] <= cap[r["source"]] for r in rows)
    share = {r["source"]: r["reached_share"] for r in reached(mixed, t).collect()}
    assert share["gone"] == 0 and "x" not in share
    for s, want in (("a", 0.5), ("b", 0.3), ("c", 0.1)):
        assert abs(share[s] - want / 0.9) < 0.005
    # the scarcest source is used up
    assert sum(r["repeats"] for r in rows if r["source"] == "b") >= 3 * sum(1 for d in docs if d[1] == "b") - 3


def test_unlabelled_by_classifier(spark):
    rng = np.random.default_rng(4)
    words = {"a": ["apple", "pear", "plum", "fig"], "b": ["bolt", "nut", "screw", "gear"]}
    docs = [(i, None if i % 5 == 0 else s, " ".join(rng.choice(words[s], 30))) for i, s in enumerate(rng.choice(["a", "b"], 400).tolist())]
    truth = {i: ("a" if any(w in t.split() for w in words["a"]) else "b") for i, _, t in docs}
    df = spark.createDataFrame(docs, "id bigint, source string, text string")
    rows = memberships(df, "id", "text", "source", ["a", "b"]).collect()
    soft = [r for r in rows if r["source"] is None]
    assert len(soft) == 80 and np.mean([(r["p"][0] > 0.5) == (truth[r["id"]] == "a") for r in soft]) > 0.95
    assert all(r["p"] == [float(r["source"] == "a"), float(r["source"] == "b")] for r in rows if r["source"])
    mixed = mix(memberships(df, "id", "text", "source", ["a", "b"]), targets(spark, [("a", 0.7, 1), ("b", 0.3, 1)])).collect()
    got = sum(r["n"] * r["repeats"] for r in mixed if truth[r["id"]] == "a") / sum(r["n"] * r["repeats"] for r in mixed)
    assert abs(got - 0.7) < 0.05


def test_nothing_to_mix(spark):
    df = spark.createDataFrame([(1, "x", "t")], "id bigint, source string, text string")
    assert mix(memberships(df, "id", "text", "source", ["a"]), targets(spark, [("a", 1.0, 1)])).count() == 0
    assert mix(memberships(df.limit(0), "id", "text", "source", ["a"]), targets(spark, [("a", 1.0, 1)])).count() == 0


def test_fit_goes_to_the_end(spark):
    # domains that overlap: the gap is closed where it can be, else the squared gap is the least there is
    rng = np.random.default_rng(5)
    p = rng.dirichlet([1.0, 1.0, 1.0], 300)
    n = rng.integers(10, 90, 300)
    members = spark.createDataFrame([(i, "x", int(k), q.tolist()) for i, (k, q) in enumerate(zip(n, p))], "id bigint, source string, n bigint, p array<double>").repartition(3).cache()
    caps, shares = np.array([1.0, 1.0, 1.0]), np.array([0.4, 0.35, 0.25])
    for total in (0.3 * n.sum(), None):
        potential, goal = fit_rates(members, shares, caps, total)
        rate = np.clip(p @ potential, 0, p @ caps)
        gap, scale = goal - (n * rate) @ p, n @ p
        r = gap / scale
        if total is not None:
            assert np.abs(gap).max() <= 1e-6 * total
        else:
            toward = p @ r
            could_save = (n * np.where(toward > 0, toward * (p @ caps - rate), -toward * rate)).sum()
            assert np.abs(gap).max() > 1e-3 * goal.sum() and could_save <= 5e-3 * (gap @ r) / 2


def test_empty_partition_of_labelled(spark):
    df = spark.createDataFrame([(1, "a", "apple pear"), (2, "b", "bolt nut")], "id bigint, source string, text string").repartition(6)
    rows = memberships(df, "id", "text", "source", ["a", "b"], trust_labels=False).collect()
    assert len(rows) == 2 and all(abs(sum(r["p"]) - 1) < 1e-9 for r in rows)


def test_scarce_domain_does_not_shrink_the_mixture(spark):
    # a domain with next to no membership anywhere is short; the others keep their proportions
    rng = np.random.default_rng(6)
    rows = []
    for i in range(600):
        q = rng.dirichlet([1.0, 1.0]) * (1 - 1e-7)
        rows.append((i, None, int(rng.integers(10, 90)), [float(q[0]), float(q[1]), 1e-7], False))
    members = spark.createDataFrame(rows, "id bigint, source string, n bigint, p array<double>, labelled boolean").repartition(3).cache()
    mixed = mix(members, targets(spark, [("a", 0.5, 1), ("b", 0.3, 1), ("c", 0.2, 1)])).collect()
    everything = sum(r[2] for r in rows)
    assert sum(r["n"] * r["repeats"] for r in mixed) >= 0.01 * everything and len(mixed) > 10


def test_label_outside_the_targets_is_not_used(spark):
    df = spark.createDataFrame([(i, "x" if i % 2 else "a", "apple pear plum " * 5) for i in range(60)], "id bigint, source string, text string")
    rows = mix(memberships(df, "id", "text", "source", ["a"]), targets(spark, [("a", 1.0, 1)])).collect()
    assert {r["source"] for r in rows} == {"a"} and len(rows) == 30
