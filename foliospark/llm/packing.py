"""Filling fixed-capacity containers with items of varying length (p7): optimal length buckets.

Only the histogram of lengths (capacity bins at most) reaches the driver. Dynamic programming over it places the bucket
bounds so that rounding every length up to its bucket's bound costs least. Token-budget batches then form on the
buckets: a batch starts inside the largest bucket that has items, takes as many as fit, and fills the rest of its budget
from the smaller buckets; it is repeated while its items last. Items are numbered inside their buckets in parallel, and
an item's number alone tells its container.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.sources.tables import checkpointed, safe_key

BUCKETS = 192
#: Rows numbered by one task.
RANKED_ROWS = 1_000_000


def bucket_bounds(counts: np.ndarray, k: int = BUCKETS) -> list[int]:
    """At most k upper bounds of buckets, the last the greatest length, with the least sum of bound - length.

    counts[i]: items of length i. Exact: layer by layer, each solved with a lower hull of lines, since the cost of a
    bucket is a line in its bound.
    """
    lengths = np.flatnonzero(counts)
    lengths = lengths[lengths > 0].tolist()
    if len(lengths) <= k:
        return lengths
    n, s = [0], [0]
    for x in lengths:
        n.append(n[-1] + int(counts[x]))
        s.append(s[-1] + int(counts[x]) * x)
    h = len(lengths)
    inf = float("inf")
    cost = [0.0] + [inf] * h  # of the first j lengths in the buckets so far
    froms: list[list[int]] = []
    for _ in range(k):
        new, src = [inf] * (h + 1), [0] * (h + 1)
        hull: list[tuple[int, float, int]] = []  # (slope, offset, i); slopes fall, bounds rise
        head = 0
        for j in range(1, h + 1):
            i = j - 1
            if cost[i] < inf:
                m, c = -n[i], cost[i] + s[i]
                while len(hull) - head >= 2 and (c - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - m):
                    hull.pop()
                hull.append((m, c, i))
                head = min(head, len(hull) - 1)
            b = lengths[j - 1]
            while len(hull) - head >= 2 and hull[head + 1][0] * b + hull[head + 1][1] <= hull[head][0] * b + hull[head][1]:
                head += 1
            if hull:
                new[j] = hull[head][0] * b + hull[head][1] + b * n[j] - s[j]
                src[j] = hull[head][2]
        froms.append(src)
        cost = new
    bounds, j = [], h
    for src in reversed(froms):
        if not j:
            break
        bounds.append(lengths[j - 1])
        j = src[j]
    return bounds[::-1]


def batches(bounds: list[int], items: list[int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(repeats, [(bucket, items of it)]) of batches that use up all items, by bounds as sizes."""
    left, out = list(items), []
    top = len(bounds) - 1
    while True:
        while top >= 0 and not left[top]:
            top -= 1
        if top < 0:
            return out
        room, batch, at = capacity, [], top
        while at >= 0 and room > 0:
            while at >= 0 and (not left[at] or bounds[at] > room):
                at -= 1
            if at >= 0:
                c = min(left[at], room // bounds[at])
                batch.append((at, c))
                room -= c * bounds[at]
                at -= 1
        times = max(1, min(left[b] // c for b, c in batch))
        for b, c in batch:
            left[b] -= c * times
        out.append((times, batch))


def pack(items: DataFrame, capacity: int, buckets: int = BUCKETS) -> DataFrame:
    """(id, piece, container, slot, first_token, n): every item in a container of `capacity` tokens.

    items: (id, n), ids unique. An item above the capacity fills containers of its own and its rest is an item again;
    no other is divided. Items without tokens need no room and get a null container. Containers hold at most `capacity`
    tokens and are numbered from 0 without gaps. Items of one length are alike, so ties need no rule but their order by
    hash; an empty table gives an empty result.
    """
    id_, kind, outer = safe_key(items, "id")
    items = items.withColumn("id", id_)
    whole = F.floor(F.col("n") / capacity)
    rest = (F.col("n") % capacity).cast("int")
    parts = items.withColumn("whole", whole).withColumn("rest", rest)
    base = checkpointed(parts.filter("n > 0"))
    hist = base.filter("rest > 0").groupBy("rest").agg(F.count("*").alias("k")).collect()  # capacity rows at most
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in hist:
        counts[r[0]] = r[1]
    bounds = bucket_bounds(counts, buckets)
    edges = np.array([0, *bounds])
    per = [int(counts[a + 1 : b + 1].sum()) for a, b in zip(edges, edges[1:])]
    plan = batches(bounds, per, capacity)
    # bucket -> where its items' numbers begin in each batch kind
    begins: list[list[tuple[int, int, int, int]]] = [[] for _ in bounds]
    used, first = [0] * len(bounds), 0
    for times, batch in plan:
        slot = 0
        for b, c in batch:
            begins[b].append((used[b], c, first, slot))
            used[b] += c * times
            slot += c
        first += times
    total = int(counts.sum())
    salts = max(8, total // RANKED_ROWS)
    spark = items.sparkSession
    small = base.filter("rest > 0").select("id", "n", "whole", "rest", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt"))
    shared = spark.sparkContext.broadcast((np.array(bounds), [np.array(x, dtype=np.int64).reshape(-1, 4) for x in begins]))

    def label(batches_: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bounds_, _ = shared.value
        for pdf in batches_:
            yield pdf.assign(bucket=np.searchsorted(bounds_, pdf["rest"].to_numpy(), side="left").astype("int32"))

    cols = f"id {kind}, n bigint, whole bigint, rest int, salt bigint"
    labelled = small.mapInPandas(label, cols + ", bucket int")
    sizes = labelled.groupBy("bucket", "salt").agg(F.count("*").alias("k"))
    offsets = sizes.select("bucket", "salt", (F.sum("k").over(Window.partitionBy("bucket").orderBy("salt")) - F.col("k")).alias("before"))
    ranked = labelled.withColumn("r", F.row_number().over(Window.partitionBy("bucket", "salt").orderBy(F.xxhash64(F.lit(1), "id"), "id")))
    ranked = ranked.join(offsets, ["bucket", "salt"]).select("id", "n", "whole", "rest", "bucket", (F.col("r") - 1 + F.col("before")).alias("rank"))

    def place(batches_: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, begins_ = shared.value
        for pdf in batches_:
            container, slot = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            rank, where = pdf["rank"].to_numpy(), pdf["bucket"].to_numpy()
            for b in np.unique(where):
                rows, t = np.flatnonzero(where == b), begins_[b]
                k = np.searchsorted(t[:, 0], rank[rows], side="right") - 1
                inner = rank[rows] - t[k, 0]
                container[rows], slot[rows] = t[k, 2] + inner // t[k, 1], t[k, 3] + inner % t[k, 1]
            yield pdf[["id", "n", "whole", "rest"]].assign(container=container, slot=slot.astype("int32"))

    placed = ranked.mapInPandas(place, f"id {kind}, n bigint, whole bigint, rest int, container bigint, slot int")
    out = placed.select("id", F.col("whole").cast("int").alias("piece"), "container", "slot", (F.col("whole") * capacity).alias("first_token"), F.col("rest").cast("bigint").alias("n"))
    # containers that one long item fills: numbered after the others, by running sums over salts
    big = base.filter("whole > 0").select("id", "whole", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt"))
    sums = big.groupBy("salt").agg(F.sum("whole").alias("k"))
    starts = sums.select("salt", (F.sum("k").over(Window.orderBy("salt")) - F.col("k")).alias("before"))  # one row per salt
    run = big.withColumn("s", F.sum("whole").over(Window.partitionBy("salt").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("whole"))
    full = run.join(F.broadcast(starts), "salt").select("id", F.posexplode(F.sequence(F.lit(0).cast("bigint"), F.col("whole") - 1)).alias("p", "piece"), (F.lit(first) + F.col("before") + F.col("s")).alias("c"))
    out = out.unionByName(full.select("id", F.col("piece").cast("int").alias("piece"), (F.col("c") + F.col("piece")).alias("container"), F.lit(0).alias("slot"), (F.col("piece") * capacity).alias("first_token"), F.lit(capacity).cast("bigint").alias("n")))
    none = parts.filter("n = 0 or n is null").select("id", F.lit(0).alias("piece"), F.lit(None).cast("bigint").alias("container"), F.lit(None).cast("int").alias("slot"), F.lit(0).cast("bigint").alias("first_token"), F.lit(0).cast("bigint").alias("n"))
    return out.unionByName(none).withColumn("id", F.col("id").cast(outer))
