"""Most similar vectors for every vector (p5): shifted Hilbert curves, range-partitioned, windows merged and reranked.

Each curve turns the vectors (a seeded orthonormal projection), shifts them and orders them by their Hilbert key. The
order is made by range partitioning; each partition is walked once as a stream, in which every vector meets its `window`
followers and predecessors, so no group grows with the data's density. The first curve gives every vector a list; the
others send on only what beats that list and isn't on it. The nearest of all curves are merged, reranked by true distance
and cut to k. Vectors at one place are one node with their smallest ids, so a crowded place costs nothing.

Curves fill at most HILBERT_AXES dimensions. Vectors of more have longer lists, and rounds of rematching follow: the
vectors on one list meet each other, and every list takes what is nearer than its last. The pairs of a list are bounded
by its length squared, and only those that improve a list are sent on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.sources.tables import checkpointed

CURVES, WINDOW, BLOCK_ROWS = 6, 72, 16_384
HILBERT_AXES = 6
#: Above HILBERT_AXES dimensions: entries of a list, and rounds in which the lists rematch.
WIDE, ROUNDS = 24, 4
#: Places with more than this share of all rows are few (1 / share at most) and joined by broadcast.
CROWDED_SHARE = 1 / 256
_NEAR = "array<struct<d:double,node:bigint>>"


def projection(d: int, m: int, seed: int) -> np.ndarray:
    """d x m with orthonormal columns, drawn by seed."""
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, max(m, 1))))
    return q[:, :m]


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of rows of m cell numbers below 2**bits; m * bits may not pass 63."""
    x = cells.astype(np.int64).T.copy()
    m = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(m):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, m):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[m - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(m):
            key = key << 1 | (x[i] >> b & 1)
    return key


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows; in few dimensions summed in the order of the columns, as anyone would who checks them."""
    if a.shape[1] > HILBERT_AXES:
        return np.einsum("ij,ij->i", a - b, a - b)
    s = np.zeros(len(a))
    for j in range(a.shape[1]):
        s += (a[:, j] - b[:, j]) ** 2
    return s


def window_neighbours(v: np.ndarray, ids: np.ndarray, first: int, last: int, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(distances, ids) of the nearest k by (distance, id) of the rows first to last among the `window` before and after
    each; infinite where there are fewer."""
    n, m = len(v), last - first
    dist = np.full((m, 2 * window), np.inf)
    for o in range(1, window + 1):
        lo, hi = max(0, first - o), min(n - o, last)
        if lo >= hi:
            continue
        d = _squares(v[lo:hi], v[lo + o : hi + o])  # of row i and i + o, i from lo to hi
        a = max(lo, first)
        if hi > a:
            dist[a - first : hi - first, window + o - 1] = d[a - lo :]
        b = min(hi, last - o)  # rows i + o that lie within
        if b > lo:
            dist[lo + o - first : b + o - first, window - o] = d[: b - lo]
    steps = np.concatenate([np.arange(-window, 0), np.arange(1, window + 1)])
    near = np.clip(np.arange(first, last)[:, None] + steps[None, :], 0, n - 1)
    take, rows = min(k, 2 * window), np.arange(m)[:, None]
    some = min(2 * window, take + 4)
    pick = np.argpartition(dist, some - 1, axis=1)[:, :some] if some < 2 * window else np.broadcast_to(np.arange(2 * window), dist.shape)
    dd, oo = np.sqrt(dist[rows, pick]), ids[near[rows, pick]]
    order = np.lexsort((oo, dd))
    dd, oo = dd[rows, order], oo[rows, order]
    # as near as the last, all that were picked: there may be more ties, and all are ranked
    for r in np.flatnonzero((dd[:, take - 1] == dd[:, -1]) & np.isfinite(dd[:, -1])) if some < 2 * window else []:
        d = np.sqrt(dist[r])
        full = np.lexsort((ids[near[r]], d))[:take]
        dd[r, :take], oo[r, :take] = d[full], ids[near[r, full]]
    return dd[:, :take], oo[:, :take]


def _rows_of(column: pa.Array, n: int) -> np.ndarray:
    """A column of arrays of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _as_lists(counts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def _entries(d: np.ndarray, node: np.ndarray) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(d, pa.float64()), pa.array(node, pa.int64())], names=["d", "node"])


def _walk(batches: Iterator[pa.RecordBatch], k: int, window: int, first: bool) -> Iterator[pa.RecordBatch]:
    """Lists of the rows of one partition, which come in curve order; rows are held until their followers have come. With
    `first` every list and the vector with it, else what beats `bound` and is not `known`."""
    held: list[np.ndarray] = []  # node, v and, but for the first curve, bound and known
    done = 0  # held rows that have their lists already

    def lists(lo: int, hi: int) -> pa.RecordBatch | None:
        node, v = held[:2]
        dd, oo = window_neighbours(v, node, lo, hi, k, window)
        keep = np.isfinite(dd)
        if first:
            vectors = _as_lists(np.full(hi - lo, v.shape[1]), pa.array(v[lo:hi].ravel(), pa.float64()))
            return pa.RecordBatch.from_arrays([pa.array(node[lo:hi], pa.int64()), vectors, _as_lists(keep.sum(axis=1), _entries(dd[keep], oo[keep]))], ["node", "v", "near"])
        bound, known = held[2][lo:hi], held[3][lo:hi]
        keep &= dd <= bound[:, None]
        for j in range(known.shape[1]):
            keep &= oo != known[:, j : j + 1]
        some = keep.any(axis=1)
        if not some.any():
            return None
        return pa.RecordBatch.from_arrays([pa.array(node[lo:hi][some], pa.int64()), _as_lists(keep[some].sum(axis=1), _entries(dd[keep], oo[keep]))], ["node", "near"])

    for b in batches:
        n = b.num_rows
        if not n:
            continue
        new = [b.column("node").to_numpy(), _rows_of(b.column("v"), n)]
        if not first:
            new += [b.column("bound").to_numpy(zero_copy_only=False), _rows_of(b.column("known"), n)]
        held = [np.concatenate(x) for x in zip(held, new)] if held else new
        ready = len(held[0]) - window
        if ready > done:
            if (out := lists(done, ready)) is not None:
                yield out
            cut = max(0, ready - window)
            held, done = [x[cut:] for x in held], ready - cut
    if held and len(held[0]) > done and (out := lists(done, len(held[0]))) is not None:
        yield out


def curve_neighbours(nodes: DataFrame, k: int, curves: int = CURVES, window: int = WINDOW, block_rows: int = BLOCK_ROWS, wide: int = WIDE, rounds: int = ROUNDS) -> DataFrame:
    """(node, near array<struct<d, node>>): up to k other nodes by (distance, id); nodes: (node bigint, v array<double>).

    block_rows: the least rows of a range partition; at its ends a vector misses what lies beyond, on this curve only.
    """
    spark = nodes.sparkSession
    size, span, total = nodes.agg(F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))), F.count("*")).head()
    dim = size or 0
    if dim < 1:
        return spark.createDataFrame([], f"node bigint, near {_NEAR}")
    m = min(dim, HILBERT_AXES)
    bits = 60 // m
    span = float(span or 1.0) * np.sqrt(dim) * 1.001 or 1.0
    parts = max(1, min(spark.sparkContext.defaultParallelism * 4, total // block_rows))
    most = max(k, wide) if dim > m else k

    def along(rows: DataFrame, c: int, first: bool) -> DataFrame:
        turn = projection(dim, m, c) if c or m < dim else np.eye(dim)
        shift = np.random.default_rng(1000 + c).uniform(0, 0.5, m)

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                v = _rows_of(b.column("v"), b.num_rows).reshape(b.num_rows, dim)
                unit = (v @ turn / span + 1) / 2  # in 0..1
                cells = np.clip((unit + shift) / 1.5 * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)
                yield b.append_column("key", pa.array(hilbert_keys(cells, bits), pa.int64()))

        extra = "" if first else ", bound double, known array<bigint>"
        ordered = rows.mapInArrow(keyed, f"node bigint, v array<double>{extra}, key bigint").repartitionByRange(parts, "key", "node").sortWithinPartitions("key", "node").drop("key")
        out = f"node bigint, v array<double>, near {_NEAR}" if first else f"node bigint, near {_NEAR}"
        return ordered.mapInArrow(lambda batches: _walk(batches, most, window, first), out)

    start = checkpointed(along(nodes, 0, True))
    found = start.select("node", "near")
    if curves > 1:
        full = F.size("near") == most
        none = F.array_repeat(F.lit(-1 << 63).cast("bigint"), most)
        bound = F.when(full, F.element_at("near.d", -1)).otherwise(F.lit(float("inf")))
        rest = start.select("node", "v", bound.alias("bound"), F.slice(F.concat("near.node", none), 1, most).alias("known"))
        for c in range(1, curves):
            found = found.unionByName(along(rest, c, False))
    near = _best(found, most)
    if dim > m:
        for _ in range(rounds):
            near = _best(near.unionByName(rematch(checkpointed(near), nodes)), most)
        near = near.select("node", F.slice("near", 1, k).alias("near"))
    return near


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each node over all its lists, each a few entries."""
    merged = found.groupBy("node").agg(F.flatten(F.collect_list("near")).alias("near"))
    return merged.select("node", F.slice(F.array_sort(F.array_distinct("near")), 1, k).alias("near"))


def rematch(near: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, near): for the nodes on one list with its owner, what they are to each other, where it is nearer than the
    last of their own lists and not on them."""
    own = near.select("node", F.col("near.node").alias("known"), F.element_at("near.d", -1).alias("bound"))
    with_v = nodes.join(own, "node").select(F.col("node").alias("a"), F.struct("node", "v", "bound", "known").alias("x"))
    member = near.select(F.col("node").alias("u"), F.explode(F.concat(F.array("node"), "near.node")).alias("a"))
    groups = member.join(with_v, "a").groupBy("u").agg(F.collect_list("x").alias("xs"))  # a list and its owner

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            node, lists = [], []
            for xs in pdf["xs"]:
                ids = np.array([x["node"] for x in xs], np.int64)
                v = np.array([x["v"] for x in xs], dtype=float)
                bound = np.array([x["bound"] for x in xs])
                dots = v @ v.T
                sq = np.diag(dots)
                good = (sq[:, None] + sq[None, :] - 2 * dots <= (bound * bound)[:, None] * (1 + 1e-9) + 1e-12) & (ids[:, None] != ids[None, :])
                for i in np.flatnonzero(good.any(axis=1)):
                    j = np.flatnonzero(good[i] & ~np.isin(ids, xs[i]["known"]))
                    if len(j):
                        d = np.sqrt(_squares(np.broadcast_to(v[i], (len(j), v.shape[1])), v[j]))
                        node.append(ids[i])
                        lists.append(list(zip(d.tolist(), ids[j].tolist())))
            if node:
                yield pd.DataFrame({"node": np.array(node, np.int64), "near": lists})

    return groups.mapInPandas(meet, f"node bigint, near {_NEAR}")


def nearest(df: DataFrame, id_col: str, coords: list[str] | str, k: int = 8, **curve) -> DataFrame:
    """(id, other): the k nearest other ids of every id by Euclidean distance, of equally far ones the smaller id.

    coords: the columns of the coordinates, or one column of arrays, all of one length. Rows with a null or NaN coordinate or a null id do not count; repeated rows count once; extra columns are ignored.
    Fewer than k others give fewer rows; an empty table gives none.
    """
    v = F.transform(coords, lambda x: x.cast("double") + 0.0) if isinstance(coords, str) else F.array(*(F.col(c).cast("double") + 0.0 for c in coords))
    pts = df.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x))).dropDuplicates(["id"])
    pts = checkpointed(pts)
    place = Window.partitionBy("v").orderBy("id")
    firsts = pts.withColumn("r", F.row_number().over(place)).filter(F.col("r") <= k + 1)  # cut before the shuffle
    nodes = firsts.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    nodes = checkpointed(nodes.select(F.col("ids")[0].alias("node"), "v", "ids"))
    near = curve_neighbours(nodes.select("node", "v"), k, **curve)
    several = nodes.filter(F.size("ids") > 1).select(F.col("node").alias("m"), F.col("ids").alias("mids"))
    flat = near.select("node", F.explode("near").alias("x")).select("node", "x.d", F.col("x.node").alias("m"))
    flat = flat.join(several, "m", "left").select("node", "d", F.explode(F.coalesce("mids", F.array("m"))).alias("other"))
    around = flat.groupBy("node").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "other"))), 1, k).alias("around"))  # k x (k + 1) entries at most
    own = nodes.join(around, "node", "left").select("ids", F.coalesce("around", F.array().cast("array<struct<d:double,other:bigint>>")).alias("around"))
    mine = own.select(F.explode("ids").alias("id"), "ids", "around")
    zero = F.transform(F.array_remove(F.col("ids"), F.col("id")), lambda o: F.struct(F.lit(0.0).alias("d"), o.alias("other")))
    out = mine.select("id", F.explode(F.slice(F.concat(zero, "around"), 1, k)).alias("x")).select("id", F.col("x.other").alias("other"))
    # ids of a crowded place beyond its first k + 1 have all their neighbours there
    full = nodes.filter(F.size("ids") == k + 1).select("v", F.slice("ids", 1, k).alias("ids"), F.col("ids")[k].alias("last"))
    if full.head(1):
        total = pts.count()
        sizes = pts.join(F.broadcast(full.select("v")) if full.count() < 10_000 else full.select("v"), "v", "left_semi").groupBy("v").agg(F.count("*").alias("n"))
        big = sizes.filter(F.col("n") > max(1000, total * CROWDED_SHARE)).select("v")
        parts = ((full.join(big, "v", "left_semi"), True), (full.join(big, "v", "left_anti"), False))
        for some, few in parts:
            rest = pts.join(F.broadcast(some) if few else some, "v").filter("id > last").select("id", F.explode("ids").alias("other"))
            out = out.unionByName(rest)
    return out
