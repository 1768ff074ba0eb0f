"""Graphs as two tables: homophily, cross-class edges, induced subgraphs, neighbour search, mean similarities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors of one broadcast block.
QUERY_BLOCK = 4096
#: Edges of a node from which it is a hub, and hubs split off at most.
HUB_EDGES, HUBS = 100_000, 1_000
#: Similarities that a task holds at a time.
PRODUCTS = 4_000_000


def with_ends(edges: DataFrame, nodes: DataFrame, node_id: str, value: str, hub_edges: int = HUB_EDGES) -> DataFrame:
    """Edges (s, t, ...) with the value of both ends as vs and vt; edges with an unknown end fall away.

    The values of hubs, ends of more than hub_edges edges, meet the edges by broadcast, those of the other nodes by
    shuffle. At most HUBS are split off, the greatest; the split changes no result.
    """
    ends = edges.select(F.explode(F.array("s", "t")).alias("k")).filter("k is not null").groupBy("k").agg(F.count("*").alias("n"))
    hubs = [r[0] for r in ends.filter(F.col("n") > hub_edges).orderBy(F.desc("n")).limit(HUBS).select("k").collect()]
    value_of = nodes.select(F.col(node_id).alias("k"), F.col(value).alias("v"))
    for end, v in (("s", "vs"), ("t", "vt")):
        named = value_of.select(F.col("k").alias(end), F.col("v").alias(v))
        if not hubs:
            edges = edges.join(named, end)
            continue
        hot = F.col(end).isin(hubs)
        edges = edges.filter(hot).join(F.broadcast(named.filter(hot)), end).unionByName(edges.filter(~hot).join(named, end))
    return edges


def homophily(ends: DataFrame) -> DataFrame:
    """One row: edges, same-valued edges, and percentages over all and by the value 1 or 0 of the source; null if none."""
    same = F.col("vs") == F.col("vt")
    pct = lambda c: 100 * F.avg(c.cast("double"))
    return ends.agg(F.count("*").alias("edges"), F.count_if(same).alias("same"), pct(same).alias("same_pct"), pct(F.when(F.col("vs") == 1, same)).alias("gen_pct"), pct(F.when(F.col("vs") == 0, same)).alias("real_pct"))


def dangling(edges: DataFrame, nodes: DataFrame, node_id: str) -> DataFrame:
    """Edges of which an end is null or no node; the strict reading of a graph demands none."""
    known = nodes.select(F.col(node_id).alias("k")).distinct()
    s = edges.join(known.withColumnRenamed("k", "s"), "s", "left_semi").select(edges.columns)
    kept = s.join(known.withColumnRenamed("k", "t"), "t", "left_semi").select(edges.columns)
    return edges.agg(F.count("*").alias("edges")).crossJoin(kept.agg(F.count("*").alias("kept"))).select("edges", (F.col("edges") - F.col("kept")).alias("dangling"))  # two single rows


def induced(ends: DataFrame, value) -> DataFrame:
    """Edges with both ends of the value; all edges for None."""
    return ends if value is None else ends.filter((F.col("vs") == value) & (F.col("vt") == value))


def nearest_cosine(vectors: DataFrame, id_col: str, vec_col: str, queries: DataFrame, k: int = 8) -> DataFrame:
    """(s, t, sim, rank): for each query vector the k most similar others, exactly, ties by smaller id.

    The query set is cut into blocks of bounded size; each is broadcast and multiplied with every partition of the
    vectors, which sends on only its own k best per query. Null and zero vectors are no neighbours.
    """
    spark = vectors.sparkSession
    ids = queries.select(F.col(id_col).cast("bigint").alias("s")).distinct()
    q = vectors.select(F.col(id_col).cast("bigint").alias("s"), F.col(vec_col).alias("v")).filter("v is not null").join(ids, "s", "left_semi")
    count = q.count()
    blocks = max(1, -(-count // QUERY_BLOCK))
    base = vectors.select(F.col(id_col).cast("bigint").alias("t"), F.col(vec_col).alias("v")).filter("v is not null")
    found = None
    for b in range(blocks):
        part = q if blocks == 1 else q.filter(F.pmod(F.xxhash64("s"), F.lit(blocks)) == b)
        rows = part.collect()  # about QUERY_BLOCK vectors
        shared = spark.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float)))

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            qid, qv = shared.value
            if not len(qid):
                return
            qn = np.sqrt((qv * qv).sum(1))
            for pdf in batches:
                if not len(pdf):
                    continue
                all_ids, all_v = pdf["t"].to_numpy(), np.array(pdf["v"].tolist(), float)
                step = max(1, PRODUCTS // len(qid))
                for at in range(0, len(all_ids), step):
                    tid, tv = all_ids[at : at + step], all_v[at : at + step]
                    with np.errstate(invalid="ignore", divide="ignore"):
                        sim = qv @ tv.T / (qn[:, None] * np.sqrt((tv * tv).sum(1))[None, :])
                    sim[(qid[:, None] == tid[None, :]) | ~np.isfinite(sim)] = -np.inf
                    take = min(k, len(tid))
                    # all that are as near as the k-th, so that ties go by id
                    least = np.partition(sim, len(tid) - take, axis=1)[:, len(tid) - take, None]
                    r, c = np.nonzero((sim >= least) & np.isfinite(sim))
                    s = sim[r, c]
                    order = np.lexsort((tid[c], -s, r))
                    r, c, s = r[order], c[order], s[order]
                    place = np.arange(len(r)) - np.searchsorted(r, r, side="left")
                    keep = place < take
                    yield pd.DataFrame({"s": qid[r[keep]], "t": tid[c[keep]], "sim": s[keep]})

        got = base.mapInPandas(search, "s bigint, t bigint, sim double")
        found = got if found is None else found.unionByName(got)
    w = Window.partitionBy("s").orderBy(F.desc("sim"), "t")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def mean_similarities(vectors: DataFrame, vec_col: str, flag: str, d: int) -> DataFrame:
    """(pair, similarity): mean cosine of pairs across and within two classes, pairs of a vector with itself left out.

    The mean over all pairs is the product of summed unit vectors, so one aggregation replaces all pairs.
    """
    v = F.transform(vec_col, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    unit = vectors.select(F.col(flag).alias("g"), F.transform(v, lambda x: x / norm).alias("u"))
    sums = unit.groupBy("g").agg(F.count("*").alias("n"), *(F.sum(F.col("u")[i]).alias(f"s{i}") for i in range(d)))
    arr = sums.select("g", "n", F.array(*(F.col(f"s{i}") for i in range(d))).alias("s"))
    prod = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    within = arr.select(F.when(F.col("g"), "g2g").otherwise("r2r").alias("pair"), F.try_divide(prod("s", "s") - F.col("n"), F.col("n") * (F.col("n") - 1)).alias("similarity"))
    a, b = arr.filter("g").select(F.col("s").alias("a"), F.col("n").alias("na")), arr.filter("not g").select(F.col("s").alias("b"), F.col("n").alias("nb"))
    across = a.crossJoin(b).select(F.lit("g2r").alias("pair"), F.try_divide(prod("a", "b"), F.col("na") * F.col("nb")).alias("similarity"))  # two single rows
    return across.unionByName(within)


def principal_axes(vectors: DataFrame, vec_col: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, d x k axes) of the standardised unit vectors, each axis with its largest entry positive.

    Partitions send d x d sums of products, whatever the number of vectors.
    """

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, c = 0, None, None
        for pdf in batches:
            x = np.array([v for v in pdf["v"] if v is not None], float)
            if not len(x):
                continue
            x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)
            n, s, c = n + len(x), x.sum(0) + (0 if s is None else s), x.T @ x + (0 if c is None else c)
        if n:
            yield pd.DataFrame({"n": [n], "s": [s.tolist()], "c": [c.ravel().tolist()]})

    parts = vectors.select(F.col(vec_col).alias("v")).mapInPandas(sums, "n bigint, s array<double>, c array<double>").collect()
    n = sum(r[0] for r in parts)
    s = sum(np.array(r[1]) for r in parts)
    d = len(s)
    c = sum(np.array(r[2]) for r in parts).reshape(d, d)
    mean = s / n
    cov = c / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-300))
    _, axes = np.linalg.eigh(cov / np.outer(sd, sd))
    axes = axes[:, ::-1][:, :k]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    return mean, axes / sd[:, None]
