import itertools
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from foliospark.operators import orphans as O

T0 = datetime(2025, 1, 1)


def day(n):
    return None if n is None else T0 + timedelta(days=n)


def brute(links, target):
    out = set()
    for link, s, t, at in links:
        for side, k in (("s", s), ("t", t)):
            if k is not None and not any(k == i and a is not None and at is not None and a <= at and (d is None or d > at) for i, a, d in target):
                out.add((link, side))
    return out


LINKS = [(1, 1, 2, day(5)), (1, 1, 2, day(5)), (2, 1, 9, day(1)), (3, None, 3, day(50)), (4, 2, 2, day(100)), (5, 4, 1, None), (None, 9, 1, day(3)), (6, 3, 5, day(20))]
LINKS += [(100 + i, 7, i % 5, day(i % 90)) for i in range(200)]  # key 7 is hot
TARGET = [(1, day(0), None), (1, day(0), None), (2, day(2), day(60)), (2, day(70), day(80)), (3, day(51), None), (4, None, None), (5, day(0), day(20)), (7, day(10), day(40)), (7, day(30), day(50)), (7, day(60), None)]


@pytest.mark.parametrize(("share", "spans"), [(1 / 256, 200_000), (0.2, 200_000), (0.2, 0), (1.0, 10)])
def test_against_brute_force(spark, share, spans):
    links = spark.createDataFrame(LINKS, "link_id bigint, s bigint, t bigint, loaded_at timestamp").withColumn("key", F.lit("x"))
    target = spark.createDataFrame(TARGET, "id bigint, loaded_at timestamp, deleted_at timestamp")
    refs, live = O.references(links, "links"), O.live_spans(target, F.col("id"))
    got = [(r["link_id"], r["side"]) for r in O.orphan_references(refs, live, share, spans).select("link_id", "side").distinct().collect()]
    assert len(got) == len(set(got)) and set(got) == brute(LINKS, TARGET)


def test_spans_are_disjoint(spark):
    target = spark.createDataFrame(TARGET, "id bigint, loaded_at timestamp, deleted_at timestamp")
    rows = sorted(map(tuple, O.live_spans(target, F.col("id")).collect()))
    assert all(a[0] != b[0] or a[2] < b[1] for a, b in itertools.pairwise(rows))


def test_keys_and_empty(spark):
    df = spark.createDataFrame([(" A\t",), ("a",), ("None",), ("",), (None,)], "k string")
    assert [r[0] for r in df.select(O.plain_key("k")).collect()] == ["a", "a", None, None, None]
    links = spark.createDataFrame([], "link_id bigint, s bigint, t bigint, loaded_at timestamp")
    target = spark.createDataFrame([], "id bigint, loaded_at timestamp, deleted_at timestamp")
    dead = O.orphan_references(O.references(links, "links"), O.live_spans(target, F.col("id")))
    assert dead.count() == 0 and O.orphan_counts(dead).count() == 0
