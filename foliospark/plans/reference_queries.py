"""Queries of the graph, statistics and text operators, each over its whole tables, with the SQL that checks it.

A figure's or paper's row in force is the last loaded one, unless that is a deletion. Classes: c = 1 generated, 0 real.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import exprs as X
from foliospark.functions import text as T
from foliospark.operators import graph as G
from foliospark.operators import image as I
from foliospark.operators import lda as L
from foliospark.operators import relational as R
from foliospark.operators import stats as S
from foliospark.sources import generators
from foliospark.sources.tables import checkpointed, load

PIXELS = ["edge", "ink", "colf", "sat", "ent", "white", "ar"]
METRICS = ["clip", "cplx", "gib", "rep"]
PROBES = [(1, 0.0, 0.0), (2, 25.0, 10.0), (3, -30.0, -20.0), (4, 40.0, -10.0), (5, 500.0, 500.0)]
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- tables in force ------------------------------------------------------------------------------------------------


def figures(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Figures in force with their class, metrics and the given columns; others are never read or shuffled."""
    keep = dict.fromkeys(["id", "c", *METRICS, "loaded_at", "deleted_at", *cols])
    f = load(spark, d, "figures").select(*keep, F.col("p.edge").alias("edge_"))
    f = R.current(f, "id", [*METRICS, "edge_"]).drop("edge_")
    return f.withColumn("is_generated", F.col("c") == 1).withColumn("is_real", (F.col("c") == 0).cast("int"))


def points(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return figures(spark, d, "x", "y", "z", *cols).filter(X.is_number(F.col("x")) & X.is_number(F.col("y")) & X.is_number(F.col("z")))


def papers(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Papers in force with cluster, topic, structure, closest title and the given columns."""
    ties = ["closest", "struct", "topic", "cluster"]
    return R.current(load(spark, d, "papers").select(*dict.fromkeys(["f", *ties, "loaded_at", "deleted_at", *cols])), "f", ties)


def pixels(spark: SparkSession, d: str) -> DataFrame:
    return S.unpivot(figures(spark, d, "p"), ["id", "is_generated", "is_real"], {k: F.col(f"p.{k}") for k in PIXELS})


def metrics(spark: SparkSession, d: str) -> DataFrame:
    return S.unpivot(figures(spark, d).filter("is_generated"), ["id"], {k: F.col(k) for k in METRICS})


_FIG = """fig AS (SELECT *, c = 1 AS is_generated, CAST(c = 0 AS INTEGER) AS is_real FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST,
 deleted_at DESC NULLS LAST, clip DESC NULLS LAST, cplx DESC NULLS LAST, gib DESC NULLS LAST, rep DESC NULLS LAST, p.edge DESC NULLS LAST) AS rn FROM figures)
 WHERE rn = 1 AND deleted_at IS NULL)"""
_PTS = _FIG + ", pts AS (SELECT * FROM fig WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) AND NOT isnan(z))"
_PAP = """pap AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY loaded_at DESC NULLS LAST, deleted_at DESC NULLS LAST,
 closest DESC NULLS LAST, struct DESC NULLS LAST, topic DESC NULLS LAST, cluster DESC NULLS LAST) AS rn FROM papers) WHERE rn = 1 AND deleted_at IS NULL)"""
_PIX = _FIG + ", pix AS (" + " UNION ALL ".join(f"SELECT id, is_generated, is_real, '{k}' AS feature, p.{k} AS v FROM fig WHERE p.{k} IS NOT NULL AND NOT isnan(p.{k})" for k in PIXELS) + ")"
_MET = _FIG + ", met AS (" + " UNION ALL ".join(f"SELECT id, '{k}' AS feature, CAST({k} AS DOUBLE) AS v FROM fig WHERE c = 1 AND {k} IS NOT NULL AND NOT isnan(CAST({k} AS DOUBLE))" for k in METRICS) + ")"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _strip(c: str) -> str:
    return _STRIP.format(c)


# --- classes and summaries ------------------------------------------------------------------------------------------


@query(f"WITH {_FIG} SELECT is_generated, is_real, count(*) AS n FROM fig GROUP BY 1, 2")
def class_counts(spark, d):
    """Figures per class, under both encodings of the class."""
    return figures(spark, d).groupBy("is_generated", "is_real").agg(F.count("*").alias("n"))


@query(f"WITH {_FIG} SELECT round(greatest(avg(is_real), 1 - avg(is_real)), 6) AS baseline FROM fig")
def majority_baseline(spark, d):
    """Accuracy of always naming the larger class."""
    m = F.avg("is_real")
    return figures(spark, d).agg(F.round(F.greatest(m, 1 - m), 6).alias("baseline"))


@query(f"WITH {_MET} SELECT feature, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, min(v) AS min, max(v) AS max, round(median(v), 6) AS med FROM met GROUP BY feature")
def metric_summary(spark, d):
    """Mean, sample deviation, extremes and median of each metric of the generated figures."""
    s = S.summary(metrics(spark, d))
    return s.select("feature", "n", *(F.round(c, 6).alias(c) if c in ("mean", "sd", "med") else F.col(c) for c in ("mean", "sd", "min", "max", "med")))


@query(
    f"WITH {_FIG} "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round(coalesce(covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0), 0), 6) AS r FROM fig WHERE c = 1 AND {a} IS NOT NULL AND {b} IS NOT NULL"
        for i, a in enumerate(METRICS)
        for b in METRICS[i + 1 :]
    )
)
def metric_corr(spark, d):
    """Pearson correlation of every pair of metrics, in one pass."""
    f = figures(spark, d).filter("is_generated")
    pairs = [(a, b) for i, a in enumerate(METRICS) for b in METRICS[i + 1 :]]
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    on = lambda a, b, c: F.when(both(a, b), F.col(c).cast("double"))
    one = f.agg(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count_if(both(a, b)).alias("n"), F.round(S.pearson(on(a, b, a), on(a, b, b)), 6).alias("r")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)))
    return one.select(F.explode(F.array(*(f"p{i}" for i in range(len(pairs))))).alias("x")).select("x.*")


@query(f"WITH {_FIG} SELECT id, clip AS xv, gib AS yv FROM fig WHERE c = 1 AND clip IS NOT NULL")
def metric_scatter(spark, d):
    """The chosen pair of metrics of every generated figure that has them."""
    return figures(spark, d).filter("is_generated and clip is not null").select("id", F.col("clip").alias("xv"), F.col("gib").alias("yv"))


@query(f"WITH {_PTS} SELECT is_generated, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM pts GROUP BY 1")
def class_centroids(spark, d):
    """Mean point of each class."""
    return S.centroids(points(spark, d), "is_generated", ["x", "y", "z"]).select("is_generated", "n", *(F.round(a, 6).alias(a) for a in "xyz"))


@query(
    f"WITH {_PTS}, m AS (SELECT " + ", ".join(f"avg({a}) FILTER (WHERE c = 1) - avg({a}) FILTER (WHERE c = 0) AS d{a}" for a in "xyz") + " FROM pts) SELECT round(sqrt(dx*dx + dy*dy + dz*dz), 6) AS distance FROM m"
)
def centroid_distance(spark, d):
    """Distance between the mean points of the classes."""
    g = lambda a, v: F.avg(F.when(F.col("is_generated") == v, F.col(a)))
    m = points(spark, d).agg(*((g(a, True) - g(a, False)).alias(a) for a in "xyz"))
    return m.select(F.round(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")), 6).alias("distance"))


@query(
    f"WITH {_PTS}, m AS (SELECT is_generated, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM pts GROUP BY 1) SELECT is_generated, round(avg(sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy)+(z-cz)*(z-cz))), 6) AS spread FROM pts JOIN m USING (is_generated) GROUP BY 1"
)
def class_spread(spark, d):
    """Mean distance of the figures of a class to its mean point."""
    return S.spreads(points(spark, d), "is_generated", ["x", "y", "z"]).select("is_generated", F.round("spread", 6).alias("spread"))


@query(f"WITH {_PTS} SELECT " + ", ".join(f"round(covar_samp({a}, {b}), 4) AS {a}{b}" for i, a in enumerate("xyz") for b in "xyz"[i:]) + " FROM pts")
def covariance(spark, d):
    """Sample covariance of the coordinates over both classes."""
    return points(spark, d).agg(*(F.round(F.covar_samp(a, b), 4).alias(a + b) for i, a in enumerate("xyz") for b in "xyz"[i:]))


@query(f"WITH {_PIX}, s AS (SELECT feature, avg(v) AS m, stddev_pop(v) AS s FROM pix GROUP BY 1), a AS (SELECT feature, avg(v) FILTER (WHERE is_generated) AS g, avg(v) FILTER (WHERE NOT is_generated) AS r FROM pix GROUP BY 1) SELECT feature, round(g, 6) AS gen_raw, round(r, 6) AS real_raw, round((g - m) / nullif(s, 0), 6) AS gen_z, round((r - m) / nullif(s, 0), 6) AS real_z FROM s JOIN a USING (feature)")
def zscore_features(spark, d):
    """Class means of each pixel statistic, raw and standardised."""
    return S.class_means(pixels(spark, d), "is_generated").select("feature", *(F.round(c, 6).alias(c) for c in ("gen_raw", "real_raw", "gen_z", "real_z")))


@query(f"WITH {_PIX}, r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY v, id) AS k FROM pix), a AS (SELECT feature, sum(k) FILTER (WHERE is_generated) AS rs, count(*) FILTER (WHERE is_generated) AS n1, count(*) FILTER (WHERE NOT is_generated) AS n2 FROM r GROUP BY 1), b AS (SELECT feature, (rs - n1 * (n1 + 1) / 2.0) / (n1 * n2) AS auc FROM a) SELECT feature, round(auc, 6) AS auc, round(greatest(auc, 1 - auc), 3) AS auc_free, round((greatest(auc, 1 - auc) - 0.5) * 200, 4) AS bar FROM b")
def feature_auc(spark, d):
    """Area under the ROC curve of each pixel statistic, best first."""
    a = S.rank_auc(pixels(spark, d), "is_generated", "id")
    out = a.select("feature", F.round("auc", 6).alias("auc"), F.round("auc_free", 3).alias("auc_free"), F.round((F.col("auc_free") - 0.5) * 200, 4).alias("bar"))
    return out.orderBy(F.desc("auc_free"), "feature")


@query(f"WITH {_PIX}, b AS (SELECT feature, least(64, CAST(floor(v * 64) AS INTEGER) + 1) AS bin FROM pix WHERE v BETWEEN 0 AND 1), c AS (SELECT feature, bin, count(*) AS cnt FROM b GROUP BY 1, 2) SELECT feature, bin, cnt, round(cnt / sum(cnt) OVER (PARTITION BY feature), 6) AS share FROM c")
def histogram64(spark, d):
    """Histograms of the pixel statistics in 64 bins over [0, 1]."""
    return S.unit_histogram(pixels(spark, d)).withColumn("share", F.round("share", 6))


@query(f"WITH {_PIX}, b AS (SELECT feature, least(64, CAST(floor(v * 64) AS INTEGER) + 1) AS bin FROM pix WHERE v BETWEEN 0 AND 1), c AS (SELECT feature, bin, count(*) AS cnt FROM b GROUP BY 1, 2), s AS (SELECT feature, cnt / sum(cnt) OVER (PARTITION BY feature) AS share FROM c) SELECT feature, round(-sum(share * log2(share)), 6) AS bits FROM s GROUP BY 1")
def tone_entropy(spark, d):
    """Entropy of each histogram in bits."""
    return S.entropy(S.unit_histogram(pixels(spark, d))).withColumn("bits", F.round("bits", 6))


@query(f"WITH {_FIG} SELECT count(*) AS n, round(avg(CAST(p.ink < 0.85 AS DOUBLE)), 6) AS inked, round(avg(CAST(p.white > 0.95 AS DOUBLE)), 6) AS blank, (SELECT round(avg(CAST(l_discount > 0.05 AS DOUBLE)), 6) FROM lineitem) AS discounted FROM fig WHERE p IS NOT NULL")
def threshold_shares(spark, d):
    """Shares of rows beyond a threshold."""
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    a = figures(spark, d, "p").filter("p is not null").agg(F.count("*").alias("n"), share(F.col("p.ink") < 0.85).alias("inked"), share(F.col("p.white") > 0.95).alias("blank"))
    return a.crossJoin(load(spark, d, "lineitem").agg(share(F.col("l_discount") > 0.05).alias("discounted")))  # two single rows


@query(f"WITH {_PTS}, e AS (SELECT min(x) - (max(x) - min(x)) * 0.04 AS lo, max(x) + (max(x) - min(x)) * 0.04 AS hi FROM pts), b AS (SELECT id, c, least(45, greatest(0, CAST(floor((x - lo) / (hi - lo) * 46) AS INTEGER))) AS bin FROM pts, e) SELECT id, bin, row_number() OVER (PARTITION BY bin ORDER BY c, id) - 1 AS stack FROM b")
def strip_layout(spark, d):
    """Bin and place in the bin of every figure, real ones below."""
    p = points(spark, d).select("id", "c", "x")
    e = S.extents(p.select(F.lit("x").alias("feature"), F.col("x").alias("v")), 0.04)
    binned = p.crossJoin(F.broadcast(e.select("lo", "hi"))).select("id", "c", X.bin_index(F.col("x"), F.col("lo"), F.col("hi"), 46).alias("bin"))  # one row
    return R.ordinal_ranks(binned, "bin", ["c", "id"]).select("id", "bin", (F.col("rank") - 1).alias("stack"))


@query(f"WITH {_PTS}, e AS (SELECT min(x) - (max(x) - min(x)) * 0.04 AS lo, max(x) + (max(x) - min(x)) * 0.04 AS hi FROM pts), b AS (SELECT least(45, greatest(0, CAST(floor((x - lo) / (hi - lo) * 46) AS INTEGER))) AS bin, count(*) AS n FROM pts, e GROUP BY 1) SELECT max(n) AS highest, count(*) AS bins FROM b")
def strip_height(spark, d):
    """The greatest stack of the layout."""
    p = points(spark, d).select("x")
    e = S.extents(p.select(F.lit("x").alias("feature"), F.col("x").alias("v")), 0.04)
    binned = p.crossJoin(F.broadcast(e.select("lo", "hi"))).select(X.bin_index(F.col("x"), F.col("lo"), F.col("hi"), 46).alias("bin"))  # one row
    return binned.groupBy("bin").agg(F.count("*").alias("n")).agg(F.max("n").alias("highest"), F.count("*").alias("bins"))


@query(f"WITH {_MET} SELECT feature, round(min(v) - (max(v) - min(v)) * 0.06, 6) AS lo, round(max(v) + (max(v) - min(v)) * 0.06, 6) AS hi FROM met GROUP BY 1")
def axis_extent(spark, d):
    """Padded extent of each metric."""
    return S.extents(metrics(spark, d)).select("feature", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query(f"WITH {_MET}, e AS (SELECT feature, min(v) - (max(v) - min(v)) * 0.06 AS lo, max(v) + (max(v) - min(v)) * 0.06 AS hi FROM met GROUP BY 1), b AS (SELECT *, pow(10, floor(log10((hi - lo) / 5))) AS base FROM e), s AS (SELECT *, base * CASE WHEN (hi - lo) / 5 / base >= 7.5 THEN 10 WHEN (hi - lo) / 5 / base >= 3.5 THEN 5 WHEN (hi - lo) / 5 / base >= 1.5 THEN 2 ELSE 1 END AS step FROM b) SELECT feature, round(k * step, 6) AS tick FROM s, unnest(range(CAST(ceil(lo / step) AS BIGINT), CAST(floor(hi / step + 1e-6) AS BIGINT) + 1)) AS t(k)")
def axis_ticks(spark, d):
    """Ticks of each metric's axis."""
    return S.extents(metrics(spark, d)).select("feature", F.explode(X.ticks(F.col("lo"), F.col("hi"), 5)).alias("tick")).select("feature", F.round("tick", 6).alias("tick"))


# --- discriminant ---------------------------------------------------------------------------------------------------

_FIT2 = (
    _PTS
    + ", a AS (SELECT var_samp(x) + 1e-6 AS sxx, var_samp(y) + 1e-6 AS syy, covar_samp(x, y) AS sxy, avg(x) FILTER (WHERE c = 0) AS rx, avg(y) FILTER (WHERE c = 0) AS ry, avg(x) FILTER (WHERE c = 1) AS gx, avg(y) FILTER (WHERE c = 1) AS gy FROM pts)"
    + ", w AS (SELECT (syy * (rx - gx) - sxy * (ry - gy)) / (sxx * syy - sxy * sxy) AS w0, (sxx * (ry - gy) - sxy * (rx - gx)) / (sxx * syy - sxy * sxy) AS w1, * FROM a), f AS (SELECT w0, w1, (w0 * (rx + gx) + w1 * (ry + gy)) / 2 AS t FROM w)"
)


@query(f"WITH {_FIT2} SELECT round(w0, 6) AS w0, round(w1, 6) AS w1, round(t, 6) AS t FROM f")
def lda_fit2(spark, d):
    """The discriminant of the first two coordinates."""
    w, t = L.fit(L.moments(points(spark, d), ["x", "y"], "is_real"))
    return spark.range(1).select(F.round(F.lit(float(w[0])), 6).alias("w0"), F.round(F.lit(float(w[1])), 6).alias("w1"), F.round(F.lit(t), 6).alias("t"))


@query(f"WITH {_FIT2} SELECT id, round(w0 * x + w1 * y - t, 6) AS score, (w0 * x + w1 * y - t > 0) AS says_real, ((w0 * x + w1 * y - t > 0) = (c = 0)) AS hit FROM pts, f")
def lda_scores(spark, d):
    """Score, predicted class and verdict of every figure."""
    p = points(spark, d)
    s = L.score(["x", "y"], *L.fit(L.moments(p, ["x", "y"], "is_real")))
    return p.select("id", F.round(s, 6).alias("score"), (s > 0).alias("says_real"), ((s > 0) == (F.col("c") == 0)).alias("hit"))


@query(f"WITH {_FIT2} SELECT count(*) FILTER (WHERE (w0 * x + w1 * y - t > 0) <> (c = 0)) AS misses, count(*) AS n FROM pts, f")
def lda_misses(spark, d):
    """Figures on the wrong side of the discriminant fitted to all."""
    p = points(spark, d)
    s = L.score(["x", "y"], *L.fit(L.moments(p, ["x", "y"], "is_real")))
    return p.agg(F.count_if((s > 0) != (F.col("c") == 0)).alias("misses"), F.count("*").alias("n"))


@query(f"WITH {_FIT2}, e AS (SELECT min(x) AS lo, max(x) AS hi FROM pts) SELECT e.k AS k, round(v, 4) AS x, round((t - w0 * v) / nullif(w1, 0), 4) AS y FROM f, (SELECT 'lo' AS k, lo AS v FROM e UNION ALL SELECT 'hi', hi FROM e) e")
def decision_line(spark, d):
    """The line on which the discriminant is zero, at both ends of the x axis."""
    p = points(spark, d)
    w, t = L.fit(L.moments(p, ["x", "y"], "is_real"))
    e = p.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).select(F.expr("stack(2, 'lo', lo, 'hi', hi) as (k, v)"))
    return e.select("k", F.round("v", 4).alias("x"), F.round(F.try_divide(F.lit(t) - F.lit(float(w[0])) * F.col("v"), F.lit(float(w[1]))), 4).alias("y"))


_LOO1 = """, m AS (SELECT q.k, q.v AS qv, q.yy, avg(o.v) FILTER (WHERE o.yy = 0) AS m0, avg(o.v) FILTER (WHERE o.yy = 1) AS m1, var_samp(o.v) AS s
 FROM one q JOIN one o ON o.k = q.k AND o.id <> q.id GROUP BY q.id, q.k, q.v, q.yy)
 SELECT k AS name, count(*) FILTER (WHERE ((m1 - m0) / (s + 1e-6) * (qv - (m0 + m1) / 2) > 0) = (yy = 1)) AS hits, count(*) AS n FROM m GROUP BY k"""


@query(f"WITH {_PTS}, one AS (SELECT id, 'x' AS k, x AS v, is_real AS yy FROM pts)" + _LOO1)
def lda_loo_1d(spark, d):
    """Leave-one-out hits of the discriminant on the first coordinate."""
    return L.leave_one_out(points(spark, d), ["x"], "is_real", "x")


@query(
    f"WITH {_PTS}, m AS (SELECT q.x AS qx, q.y AS qy, q.is_real AS yy, var_samp(o.x) + 1e-6 AS a, var_samp(o.y) + 1e-6 AS b, covar_samp(o.x, o.y) AS s, avg(o.x) FILTER (WHERE o.c = 1) AS gx, avg(o.y) FILTER (WHERE o.c = 1) AS gy, avg(o.x) FILTER (WHERE o.c = 0) AS rx, avg(o.y) FILTER (WHERE o.c = 0) AS ry FROM pts q JOIN pts o ON o.id <> q.id GROUP BY q.id, q.x, q.y, q.is_real),"
    " w AS (SELECT *, (b * (rx - gx) - s * (ry - gy)) / (a * b - s * s) AS w0, (a * (ry - gy) - s * (rx - gx)) / (a * b - s * s) AS w1 FROM m)"
    " SELECT 'x+y' AS name, count(*) FILTER (WHERE (w0 * (qx - (gx + rx) / 2) + w1 * (qy - (gy + ry) / 2) > 0) = (yy = 1)) AS hits, count(*) AS n FROM w"
)
def lda_loo_2d(spark, d):
    """Leave-one-out hits of the discriminant on two coordinates."""
    return L.leave_one_out(points(spark, d), ["x", "y"], "is_real", "x+y")


@query(f"WITH {_PIX}, one AS (SELECT id, feature AS k, v, is_real AS yy FROM pix)" + _LOO1)
def pixel_loo(spark, d):
    """Leave-one-out hits of each pixel statistic alone."""
    f = figures(spark, d, "p")
    flat = f.select("is_real", *(F.col(f"p.{k}").alias(k) for k in PIXELS))
    return L.leave_one_out_sets(flat, {k: [k] for k in PIXELS}, "is_real")


def _loo_sql(name: str, axes: list[str]) -> str:
    """Hits of every row by the fit without it: moments less the row, solved by elimination, one pivot a step."""
    d = len(axes)
    n = d + 1
    row = "[" + ", ".join(axes) + "]"
    sums = lambda cond: "[" + ", ".join(f"sum({a}){cond}" for a in axes) + "]"
    cross = "[" + ", ".join(f"sum({a} * {b})" for a in axes for b in axes) + "]"
    cell = f"(products[least(i * {d} + j, {d * d - 1}) + 1] - x[i + 1] * x[j + 1] - (t0[i + 1] + t1[i + 1] - x[i + 1]) * (t0[j + 1] + t1[j + 1] - x[j + 1]) / (n - 1)) / (n - 2) + CASE WHEN i = j THEN 1e-6 ELSE 0 END"
    mean = lambda c: f"((t{c}[i + 1] - CASE WHEN yy = {c} THEN x[i + 1] ELSE 0 END) / (n{c} - CASE WHEN yy = {c} THEN 1 ELSE 0 END))"
    start = f"list_transform(range(0, {d * n}), lambda e: list_transform([e // {n}], lambda i: list_transform([e % {n}], lambda j: CASE WHEN j = {d} THEN {mean(1)} - {mean(0)} ELSE {cell} END)[1])[1])"
    step = f"list_transform(range(0, {d * n}), lambda e: CASE WHEN e // {n} = k THEN a[e + 1] / a[k * {n} + k + 1] ELSE a[e + 1] - a[(e // {n}) * {n} + k + 1] * a[k * {n} + e % {n} + 1] / a[k * {n} + k + 1] END)"
    middle = f"list_transform(range(0, {d}), lambda i: x[i + 1] - ({mean(0)} + {mean(1)}) / 2)"
    return (
        f"SELECT '{name}' AS name, count(*) FILTER (WHERE (list_sum(list_transform(range(0, {d}), lambda i: a[i * {n} + {d} + 1] * mid[i + 1])) > 0) = (yy = 1)) AS hits, count(*) AS n FROM ("
        f"WITH RECURSIVE tot AS (SELECT count(*) AS n, count(*) FILTER (WHERE yy = 0) AS n0, count(*) FILTER (WHERE yy = 1) AS n1, {sums(' FILTER (WHERE yy = 0)')} AS t0, {sums(' FILTER (WHERE yy = 1)')} AS t1, {cross} AS products FROM flat),"
        f" one AS (SELECT id, yy, {row} AS x FROM flat), solve(id, yy, mid, k, a) AS (SELECT id, yy, {middle}, 0, {start} FROM one, tot UNION ALL SELECT id, yy, mid, k + 1, {step} FROM solve WHERE k < {d})"
        f" SELECT * FROM solve WHERE k = {d})"
    )


_FLAT = (
    _PTS
    + ", raw AS (SELECT id, is_real AS yy, x, y, " + ", ".join(f"p.{k} AS {k}" for k in PIXELS) + " FROM pts WHERE " + " AND ".join(f"p.{k} IS NOT NULL AND NOT isnan(p.{k})" for k in PIXELS) + ")"
    + ", flat AS (SELECT id, yy, x - avg(x) OVER () AS x, y - avg(y) OVER () AS y, " + ", ".join(f"({k} - avg({k}) OVER ()) / stddev_pop({k}) OVER () AS {k}" for k in PIXELS) + " FROM raw)"
)


@query(
    f"WITH {_FLAT}, r AS (SELECT 'majority' AS name, greatest(sum(yy), count(*) - sum(yy)) AS hits, count(*) AS n FROM flat UNION ALL "
    + " UNION ALL ".join(f"SELECT * FROM ({_loo_sql(k, v)})" for k, v in {"pixels": PIXELS, "x": ["x"], "x+y": ["x", "y"], "x+y+pixels": ["x", "y", *PIXELS]}.items())
    + ") SELECT name, CAST(hits AS BIGINT) AS hits, n, round(hits / n, 4) AS acc FROM r"
)
def ablation(spark, d):
    """Accuracy of growing feature sets, from the majority class to coordinates with pixel statistics."""
    f = points(spark, d, "p")
    flat = f.select("is_real", "x", "y", "z", *(F.col(f"p.{k}").alias(k) for k in PIXELS)).dropna()
    flat = checkpointed(flat)
    base = flat.agg(F.count("*").alias("n"), F.sum("is_real").alias("r")).select(F.lit("majority").alias("name"), F.coalesce(F.greatest("r", F.col("n") - F.col("r")), F.lit(0)).alias("hits"), "n")
    sets = {"pixels": PIXELS, "x": ["x"], "x+y": ["x", "y"], "x+y+pixels": ["x", "y", *PIXELS]}
    out = base.unionByName(L.leave_one_out_sets(flat, sets, "is_real", unit=PIXELS))
    return out.select("name", "hits", "n", F.round(F.try_divide(F.col("hits"), F.col("n")), 4).alias("acc"))


# --- graphs ---------------------------------------------------------------------------------------------------------

_NN = """q AS (SELECT vec_id AS s, embedding AS e FROM embeddings WHERE vec_id % 20 = 0),
 sim AS (SELECT q.s, o.vec_id AS t, list_cosine_similarity(CAST(q.e AS DOUBLE[]), CAST(o.embedding AS DOUBLE[])) AS sim FROM q JOIN embeddings o ON o.vec_id <> q.s),
 nn AS (SELECT s, t, sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY sim DESC, t) AS rank FROM sim) WHERE rank <= 8)"""


def _neighbours(spark, d):
    e = load(spark, d, "embeddings")
    return G.nearest_cosine(e, "vec_id", "embedding", e.filter("vec_id % 20 = 0"), 8)


@query(f"WITH {_NN} SELECT s, t, rank, round(sim, 6) AS sim FROM nn")
def knn_edges(spark, d):
    """The 8 most similar embeddings, among all, of every one in the query set."""
    return _neighbours(spark, d).select("s", "t", F.col("rank").cast("bigint").alias("rank"), F.round("sim", 6).alias("sim"))


@query(f"WITH {_NN} SELECT a.label AS label, count(*) AS edges, count(*) FILTER (WHERE a.label = b.label) AS same FROM nn JOIN embeddings a ON a.vec_id = nn.s JOIN embeddings b ON b.vec_id = nn.t GROUP BY 1")
def knn_homophily(spark, d):
    """Neighbours that share the label of the query, by label."""
    ends = G.with_ends(_neighbours(spark, d).select("s", "t"), load(spark, d, "embeddings"), "vec_id", "label")
    return ends.groupBy(F.col("vs").alias("label")).agg(F.count("*").alias("edges"), F.count_if(F.col("vs") == F.col("vt")).alias("same"))


_ENDS = _FIG + ", e AS (SELECT DISTINCT s, t, map_id FROM links), ends AS (SELECT e.*, a.c AS vs, b.c AS vt FROM e JOIN fig a ON a.id = e.s JOIN fig b ON b.id = e.t)"


def _ends(spark, d):
    return G.with_ends(load(spark, d, "links").select("s", "t", "map_id").distinct(), figures(spark, d), "id", "c")


@query(f"WITH {_ENDS} SELECT count(*) AS edges, count(*) FILTER (WHERE vs = vt) AS same, round(100 * avg(CAST(vs = vt AS DOUBLE)), 6) AS same_pct, round(100 * avg(CAST(vs = vt AS DOUBLE)) FILTER (WHERE vs = 1), 6) AS gen_pct, round(100 * avg(CAST(vs = vt AS DOUBLE)) FILTER (WHERE vs = 0), 6) AS real_pct FROM ends")
def link_homophily(spark, d):
    """Links between figures of one class, overall and by class of the source."""
    return G.homophily(_ends(spark, d)).select("edges", "same", *(F.round(c, 6).alias(c) for c in ("same_pct", "gen_pct", "real_pct")))


@query(f"WITH {_FIG}, e AS (SELECT DISTINCT s, t, map_id FROM links) SELECT count(*) AS edges, count(*) FILTER (WHERE s IS NULL OR t IS NULL OR s NOT IN (SELECT id FROM fig) OR t NOT IN (SELECT id FROM fig)) AS dangling FROM e")
def dangling_links(spark, d):
    """Links without two figures in force."""
    return G.dangling(load(spark, d, "links").select("s", "t", "map_id").distinct(), figures(spark, d), "id")


@query(f"WITH {_ENDS} SELECT map_id, count(*) AS edges, count(*) FILTER (WHERE vs <> vt) AS crossing FROM ends GROUP BY 1")
def cross_class_edges(spark, d):
    """Links between the classes, per map."""
    return _ends(spark, d).groupBy("map_id").agg(F.count("*").alias("edges"), F.count_if(F.col("vs") != F.col("vt")).alias("crossing"))


@query(f"WITH {_ENDS} SELECT DISTINCT s, t FROM ends WHERE vs = 1 AND vt = 1")
def induced_subgraph(spark, d):
    """Links with both ends generated."""
    return G.induced(_ends(spark, d), 1).select("s", "t").distinct()


@query(f"WITH {_PAP}, e AS (SELECT DISTINCT s, t, w FROM paper_links) SELECT e.s, e.t, round(e.w, 4) AS w FROM e JOIN pap a ON a.f = e.s JOIN pap b ON b.f = e.t WHERE a.cluster = 3 AND b.cluster = 3")
def cluster_subgraph(spark, d):
    """Paper links with both ends in one cluster."""
    e = load(spark, d, "paper_links").select("s", "t", "w").distinct()
    return G.induced(G.with_ends(e, papers(spark, d), "f", "cluster"), 3).select("s", "t", F.round("w", 4).alias("w"))


@query("""WITH v AS (SELECT vec_id, label < 5 AS g, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT CASE WHEN a.g AND b.g THEN 'g2g' WHEN NOT a.g AND NOT b.g THEN 'r2r' ELSE 'g2r' END AS pair, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id) SELECT pair, round(avg(s), 6) AS similarity FROM p GROUP BY 1""")
def population_similarity(spark, d):
    """Mean cosine within and across two groups of embeddings."""
    e = load(spark, d, "embeddings").withColumn("g", F.col("label") < 5)
    return G.mean_similarities(e, "embedding", "g", 64).withColumn("similarity", F.round("similarity", 6))


@query()
def principal_components(spark, d):
    """Every embedding on the first two principal axes of the standardised unit vectors."""
    e = load(spark, d, "embeddings")
    mean, axes = G.principal_axes(e, "embedding", 2)
    norm = X.l2(F.col("embedding"))
    on = lambda j: X.dot(F.col("embedding"), F.array(*(F.lit(float(a)) for a in axes[:, j]))) / norm - F.lit(float(mean @ axes[:, j]))
    return e.select("vec_id", F.round(on(0), 6).alias("pc1"), F.round(on(1), 6).alias("pc2"))


@query("SELECT vec_id, round(list_avg(list_transform(range(1, 64), lambda i: abs(CAST(embedding[i + 1] AS DOUBLE) - CAST(embedding[i] AS DOUBLE)))), 6) AS gradient FROM embeddings")
def adjacent_gradient(spark, d):
    """Mean absolute difference of neighbouring entries."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    e = load(spark, d, "embeddings").select("vec_id", v.alias("v"))
    n = F.size("v") - 1
    diff = F.zip_with(F.slice("v", 2, n), F.slice("v", 1, n), lambda a, b: F.abs(a - b))
    return e.select("vec_id", F.round(F.aggregate(diff, F.lit(0.0), lambda s, x: s + x) / n, 6).alias("gradient"))


@query(
    f"WITH {_PTS}, q AS (SELECT * FROM (VALUES "
    + ", ".join(f"({i}, {a}, {b})" for i, a, b in PROBES)
    + ") AS t(probe, px, py)), h AS (SELECT probe, id, (x - px) * (x - px) + (y - py) * (y - py) AS d2 FROM pts, q), r AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY d2, id) AS k FROM h WHERE d2 < 324) SELECT probe, id, round(d2, 6) AS d2 FROM r WHERE k = 1"
)
def nearest_point_radius(spark, d):
    """The figure nearest to each probe within a radius."""
    return R.nearest_within(points(spark, d), "id", "x", "y", PROBES, 18.0).withColumn("d2", F.round("d2", 6))


@query(f"WITH {_PTS} SELECT id, " + ", ".join(f"round(CASE WHEN sqrt(x*x + y*y + z*z) = 0 THEN {40.0 if a == 'x' else 0.0} ELSE {a} * (1 + 40 / sqrt(x*x + y*y + z*z)) END, 5) AS {a}" for a in "xyz") + " FROM pts")
def pushed_points(spark, d):
    """Every figure pushed away from the centre of the map."""
    out = X.pushed_out([F.col("x"), F.col("y"), F.col("z")], 40.0)
    return points(spark, d).select("id", *(F.round(c, 5).alias(a) for a, c in zip("xyz", out)))


# --- enrichment, order, samples -------------------------------------------------------------------------------------


@query(f"WITH {_FIG}, m AS (SELECT n, max(clip) AS clip, max(CAST(trunc(rep) AS INTEGER)) AS rep FROM fig WHERE clip IS NOT NULL GROUP BY n) SELECT fig.id, fig.c, m.clip, m.rep FROM fig LEFT JOIN m ON m.n = fig.n AND fig.c = 1")
def enrich_left_conditional(spark, d):
    """Figures with the metrics of their file name, for generated ones only."""
    f = figures(spark, d, "n")
    m = f.filter("clip is not null").groupBy("n").agg(F.max("clip").alias("clip"), F.max(F.col("rep").cast("int")).alias("rep"))
    return R.enrich_where(f.select("id", "n", "c"), m, "n", F.col("c") == 1).select("id", "c", "clip", "rep")


@query("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def enrich_dim_chain(spark, d):
    """Customers with nation and region; the dimensions are fixed small tables, broadcast by their size."""
    c, n, r = (load(spark, d, t) for t in ("customer", "nation", "region"))
    return c.join(n, c["c_nationkey"] == n["n_nationkey"], "left").join(r, n["n_regionkey"] == r["r_regionkey"], "left").select("c_custkey", "n_name", "r_name")


@query(f"WITH {_PAP} SELECT f, CASE WHEN coalesce(title, '') IN ('', 'None') THEN regexp_replace(f, '\\.[^.]+$', '') ELSE title END AS title, coalesce(name, CASE WHEN topic NOT IN ('', 'None') THEN topic END, 'unclustered') AS label FROM pap LEFT JOIN clusters ON clusters.id = pap.cluster")
def paper_enrich(spark, d):
    """Papers with a title to show and the name of their cluster, their topic, or 'unclustered'."""
    c = load(spark, d, "clusters").select(F.col("id").alias("cluster"), "name")
    p = papers(spark, d, "title").join(c, "cluster", "left")
    title = F.when(F.coalesce("title", F.lit("")).isin("", "None"), T.stem(F.col("f"))).otherwise(F.col("title"))
    return p.select("f", title.alias("title"), F.coalesce("name", T.first_filled(F.col("topic")), F.lit("unclustered")).alias("label"))


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def dedup_last_wins(spark, d):
    """The last event of each user."""
    return R.last_wins(load(spark, d, "events").select("user_id", "event_id", "event_type", "value", "ts"), "user_id", ["ts", "event_id"]).drop("ts")


@query(f"WITH {_FIG} SELECT id, c, clip, rep FROM fig")
def current_figures(spark, d):
    """The figures in force: last write wins, deletions left out."""
    return figures(spark, d).select("id", "c", "clip", "rep")


@query(f"WITH {_FIG}, h AS (SELECT id, c, ((id * 1664525 + 1013904223) % 4294967296) AS h FROM fig), r AS (SELECT id, c, row_number() OVER (PARTITION BY c ORDER BY h, id) AS k FROM h) SELECT a.k AS round, a.id AS id_a, b.id AS id_b FROM r a JOIN r b ON a.k = b.k WHERE a.c = 1 AND b.c = 0 AND a.k <= 8")
def pair_sample(spark, d):
    """Eight sampled generated figures, each with a sampled real one."""
    return R.sampled_pairs(figures(spark, d), "id", F.col("is_generated"), 8, X.portable_hash(F.col("id"))).withColumn("round", F.col("round").cast("bigint"))


@query("SELECT event_id, user_id, row_number() OVER w AS round, sum(CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END) OVER w AS hits FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def quiz_running_score(spark, d):
    """Rounds and hits so far in each user's log of answers."""
    hit = F.col("event_type").isin("view", "click").cast("int")
    log = load(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    return R.running(log, "user_id", ["ts", "event_id"], {"round": F.lit(1), "hits": hit}).select("event_id", "user_id", "round", "hits")


@query("WITH c AS (SELECT o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1) SELECT label, n, round(100.0 * n / (SELECT max(n) FROM c), 6) AS width, CASE WHEN label LIKE '1%' OR label LIKE '2%' THEN 'high' ELSE 'other' END AS kind FROM c ORDER BY n DESC, label LIMIT 10")
def bars_scaled(spark, d):
    """The ten commonest priorities as bars, the longest 100 wide."""
    c = load(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("label")).agg(F.count("*").alias("n"))
    top = c.crossJoin(F.broadcast(c.agg(F.max("n").alias("most"))))  # one row
    kind = F.when(F.col("label").startswith("1") | F.col("label").startswith("2"), "high").otherwise("other")
    return top.select("label", "n", F.round(100.0 * F.col("n") / F.col("most"), 6).alias("width"), kind.alias("kind")).orderBy(F.desc("n"), "label").limit(10)


@query("SELECT event_type, count(*) AS n, sum(CAST(props->>'k' AS BIGINT)) AS k_sum, min(CAST(props->>'k' AS BIGINT)) AS k_min FROM events GROUP BY 1")
def json_props(spark, d):
    """Numbers parsed out of JSON properties."""
    k = F.from_json("props", "k bigint")["k"]
    return load(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k_sum"), F.min(k).alias("k_min"))


# --- text -----------------------------------------------------------------------------------------------------------


def _exc(c: str, n: int) -> str:
    return f"substr(CASE WHEN coalesce({_strip(c)}, '') = 'None' THEN '' ELSE coalesce({_strip(c)}, '') END, 1, {n})"


@query(f"WITH {_PAP} SELECT f, {_exc('abstract', 1400)} AS abstract, {_exc('refs', 900)} AS refs FROM pap")
def text_excerpt(spark, d):
    """Beginnings of abstracts and references."""
    return papers(spark, d, "abstract", "refs").select("f", T.excerpt(F.col("abstract"), 1400).alias("abstract"), T.excerpt(F.col("refs"), 900).alias("refs"))


@query(rf"""WITH {_PAP} SELECT f, regexp_replace({_strip("regexp_replace(" + _strip("closest") + r", '^s\d+\s*=\s*" + '"' + r"?', '')")}, '^"+|"+$', '', 'g') AS closest FROM pap""")
def clean_prefix(spark, d):
    """Closest titles without stray prefixes and quotes."""
    return papers(spark, d).select("f", T.without_assignment(F.col("closest")).alias("closest"))


@query(f"WITH {_PAP} SELECT f, coalesce(TRY_CAST(nullif(regexp_replace(f, '[^0-9]', '', 'g'), '') AS BIGINT), 0) AS num FROM pap")
def numeric_name_sort(spark, d):
    """Papers in order of the number in their name."""
    return papers(spark, d).select("f", T.number_in(F.col("f")).alias("num")).orderBy("num", "f")


@query(f"WITH {_FIG} SELECT id, regexp_replace(n, '\\.png$', '.jpg', 'i') AS thumb, regexp_replace(n, '\\.[^.]+$', '') AS stem, concat(CASE WHEN c = 1 THEN 'figures/' ELSE 'real-figures/' END, n) AS path, string_split(concat('a/b/', n), '/')[-1] AS base FROM fig")
def file_names(spark, d):
    """Thumbnail, stem, path by class and base name of every figure's file."""
    n = F.col("n")
    path = F.concat(F.when(F.col("is_generated"), "figures/").otherwise("real-figures/"), n)
    return figures(spark, d, "n").select("id", T.extension_to(n, "png", "jpg").alias("thumb"), T.stem(n).alias("stem"), path.alias("path"), T.basename(F.concat(F.lit("a/b/"), n)).alias("base"))


@query(r"""WITH k AS (SELECT map_id, kind, regexp_replace(map_id, '^map[_\-\s]*', '', 'i') AS rest FROM maps), m AS (SELECT kind, map_id, CASE WHEN regexp_extract(rest, '(\d{1,2}(:\d{2})?\s*(am|pm)?|\d{3,4})', 1, 'i') <> '' THEN regexp_extract(rest, '(\d{1,2}(:\d{2})?\s*(am|pm)?|\d{3,4})', 1, 'i') ELSE rest END AS key FROM k) SELECT kind, 'Map time: ' || min(key) AS label, string_agg(map_id, ',' ORDER BY map_id) AS members FROM m GROUP BY kind""")
def key_group_collect(spark, d):
    """Maps (a fixed table) grouped, with the first of their keys and their sorted members."""
    m = load(spark, d, "maps").select("kind", "map_id", T.time_key(F.col("map_id")).alias("key"))
    return m.groupBy("kind").agg(F.concat(F.lit("Map time: "), F.min("key")).alias("label"), F.array_join(F.sort_array(F.collect_list("map_id")), ",").alias("members"))


_FLAGS = """list_distinct(list_filter([CASE WHEN coalesce(title, '') IN ('', 'None') THEN 'no title' END, CASE WHEN lower(struct) LIKE '%missing%' AND lower(struct) LIKE '%affil%' THEN 'no affiliations' END,
 CASE WHEN (lower(struct) LIKE '%missing%' AND lower(struct) LIKE '%ref%') OR coalesce(refs, '') = '' THEN 'no references' END], lambda x: x IS NOT NULL))"""


@query(f"WITH {_PAP} SELECT f, array_to_string(list_sort({_FLAGS}), '|') AS flags, CASE WHEN len({_FLAGS}) > 0 THEN 'broken' ELSE 'clean' END AS state FROM pap")
def struct_flags(spark, d):
    """Defects of every paper."""
    flags = T.paper_flags(F.col("title"), F.col("struct"), F.col("refs"))
    return papers(spark, d, "title", "refs").select("f", F.array_join(F.sort_array(flags), "|").alias("flags"), F.when(F.size(flags) > 0, "broken").otherwise("clean").alias("state"))


@query(f"WITH {_PAP} SELECT f FROM pap WHERE len({_FLAGS}) = 0 AND CAST(cluster AS VARCHAR) = '3'")
def flag_filter(spark, d):
    """Papers without defects in one cluster, chosen as text."""
    p = papers(spark, d, "title", "refs")
    return p.filter((F.size(T.paper_flags(F.col("title"), F.col("struct"), F.col("refs"))) == 0) & (F.col("cluster").cast("string") == "3")).select("f")


@query(f"WITH {_PAP} SELECT count(*) AS papers, count(*) FILTER (WHERE coalesce(title, '') IN ('', 'None')) AS untitled, count(*) FILTER (WHERE coalesce(closest, '') = '') AS no_closest FROM pap")
def missing_counts(spark, d):
    """Papers without title and without closest title."""
    return papers(spark, d, "title").agg(F.count("*").alias("papers"), F.count_if(F.coalesce("title", F.lit("")).isin("", "None")).alias("untitled"), F.count_if(F.coalesce("closest", F.lit("")) == "").alias("no_closest"))


_TOK = _PAP + r", tok AS (SELECT f, unnest(string_split_regex(lower(abstract), '[^a-z]+')) AS w FROM pap), t AS (SELECT * FROM tok WHERE w <> '')"


def _tokens(spark, d):
    return papers(spark, d, "abstract").select("f", F.explode(F.split(F.lower("abstract"), "[^a-z]+")).alias("w")).filter("w <> ''")


@query(f"WITH {_TOK}, v AS (SELECT w FROM t GROUP BY w HAVING count(DISTINCT f) >= 5) SELECT f, count(*) AS tokens, count(*) FILTER (WHERE w NOT IN (SELECT w FROM v)) AS unknown, round(count(*) FILTER (WHERE w NOT IN (SELECT w FROM v)) / count(*), 6) AS ratio FROM t GROUP BY f")
def gibberish_ratio(spark, d):
    """Share of an abstract's words that fewer than five papers have."""
    t = _tokens(spark, d).groupBy("f", "w").agg(F.count("*").alias("k"))
    t = checkpointed(t)
    papers_of = checkpointed(t.groupBy("w").agg(F.count("*").alias("papers")))
    # words that fill a partition are known without a join: they are few, and in more than five papers
    least = max(5, (papers_of.agg(F.sum("papers")).head()[0] or 0) // 256)
    common = [r[0] for r in papers_of.filter(F.col("papers") > least).select("w").collect()]  # at most 256
    known, rest = t.filter(F.col("w").isin(common)).withColumn("papers", F.lit(5).cast("bigint")), t.filter(~F.col("w").isin(common))
    v = papers_of.filter("papers >= 5")
    both = rest.join(v, "w", "left").unionByName(known)
    both = both.groupBy("f").agg(F.sum("k").alias("tokens"), F.sum(F.when(F.col("papers").isNull(), F.col("k")).otherwise(0)).alias("unknown"))
    return both.withColumn("ratio", F.round(F.col("unknown") / F.col("tokens"), 6))


@query(f"WITH {_TOK} SELECT f, count(*) - count(DISTINCT w) AS repeats FROM t GROUP BY f")
def repetition_count(spark, d):
    """Words of an abstract that it has already used."""
    return _tokens(spark, d).groupBy("f", "w").agg(F.count("*").alias("k")).groupBy("f").agg((F.sum("k") - F.count("*")).alias("repeats"))


# --- literals and generated rows ------------------------------------------------------------------------------------


@query("SELECT 'fig_' || i || '.png' AS name, i AS i FROM range(1, 101) t(i) UNION ALL SELECT 'frames/' || lpad(CAST(i AS VARCHAR), 6, '0') || '.jpg', i FROM range(0, 240) t(i)")
def file_list(spark, d):
    """Numbered file names and zero-padded frame paths."""
    return generators.file_list(spark, "fig_", 100).unionByName(generators.frame_list(spark, "frames/", 240))


@query("WITH RECURSIVE s(i, v) AS (SELECT CAST(0 AS BIGINT), CAST(42 AS BIGINT) UNION ALL SELECT i + 1, (1664525 * v + 1013904223) % 4294967296 FROM s WHERE i < 50) SELECT i, v, round(v / 4294967296.0, 6) AS u FROM s WHERE i > 0")
def lcg_sequence(spark, d):
    """The first numbers of the seeded generator."""
    return generators.lcg(spark, 42, 50)


@query("SELECT name, n, kind, round(100.0 * n / 340, 2) AS pct FROM (VALUES " + ", ".join(f"('{a}', {n}, '{k}')" for a, n, k in generators.AFFILIATIONS) + ") AS t(name, n, kind)")
def literal_tallies(spark, d):
    """A table written in the code, with shares of a total that its rows don't add up to."""
    return generators.literal(spark, generators.AFFILIATIONS, "name string, n bigint, kind string").withColumn("pct", F.round(100.0 * F.col("n") / 340, 2))


@query(f"WITH {_FIG}, {_PAP}, k AS (SELECT (SELECT count(*) FROM pap) AS papers, count(*) FILTER (WHERE c = 1) AS gen, count(*) FILTER (WHERE c = 0) AS rl, avg(gib) FILTER (WHERE c = 1) AS g, max(clip) FILTER (WHERE c = 1) AS cm, avg(CAST(c = 1 AS DOUBLE)) AS s FROM fig) SELECT unnest(['papers', 'gen-figs', 'real-figs', 'gib-mean', 'clip-max', 'gen-pct']) AS key, unnest([CAST(papers AS VARCHAR), CAST(gen AS VARCHAR), CAST(rl AS VARCHAR), printf('%.3f', g), printf('%.3f', cm), printf('%.1f%%', floor(s * 1000 + 0.5) / 10)]) AS text FROM k")
def kpi_scalars(spark, d):
    """Named numbers as text."""
    gen = F.col("is_generated")
    a = figures(spark, d).agg(F.count_if(gen).alias("gen"), F.count_if(~gen).alias("rl"), F.avg(F.when(gen, F.col("gib"))).alias("g"), F.max(F.when(gen, F.col("clip"))).alias("cm"), F.avg(gen.cast("double")).alias("s"))
    k = a.crossJoin(papers(spark, d).agg(F.count("*").alias("papers")))  # two single rows
    rows = {"papers": F.col("papers").cast("string"), "gen-figs": F.col("gen").cast("string"), "real-figs": F.col("rl").cast("string"), "gib-mean": F.format_string("%.3f", "g"), "clip-max": F.format_string("%.3f", "cm"), "gen-pct": X.percent(X.half_up(F.col("s") * 100, 1))}
    return k.select(F.explode(F.array(*(F.struct(F.lit(n).alias("key"), c.alias("text")) for n, c in rows.items()))).alias("x")).select("x.*")


@query("SELECT o_orderkey, CASE WHEN o_totalprice >= 1000 THEN regexp_replace(CAST(o_totalprice / 1000 AS VARCHAR), '\\.0$', '') || 'k' ELSE regexp_replace(CAST(floor(o_totalprice * 1000 + 0.5) / 1000 AS VARCHAR), '\\.0$', '') END AS short FROM orders")
def compact_numbers(spark, d):
    """Order totals as short texts."""
    return load(spark, d, "orders").select("o_orderkey", X.compact(F.col("o_totalprice")).alias("short"))


# --- pieces of a page -----------------------------------------------------------------------------------------------


@query("SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 5) AS norm, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(list_reverse(embedding) AS DOUBLE[])), 5) AS mirrored FROM embeddings")
def vector_products(spark, d):
    """Length of every embedding, and its product with itself read backwards."""
    e = F.col("embedding")
    return load(spark, d, "embeddings").select("vec_id", F.round(X.l2(e), 5).alias("norm"), F.round(X.dot(e, F.reverse(e)), 5).alias("mirrored"))


@query(f"WITH {_PTS}, e AS (SELECT min(x) AS lo, max(x) AS hi FROM pts), p AS (SELECT id, lo, hi, 40 + (x - lo) / (hi - lo) * (600 - 40) AS px FROM pts, e) SELECT id, round(px, 6) AS px, round(lo + (px - 40) / (600 - 40) * (hi - lo), 6) AS back FROM p")
def scale_round_trip(spark, d):
    """Every figure's x as a place on an axis of 40 to 600 pixels, and what is read back from there."""
    p = points(spark, d)
    e = p.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    at = p.crossJoin(F.broadcast(e)).withColumn("px", X.scaled(F.col("x"), (F.col("lo"), F.col("hi")), (40, 600)))  # one row
    return at.select("id", F.round("px", 6).alias("px"), F.round(X.scaled(F.col("px"), (40, 600), (F.col("lo"), F.col("hi"))), 6).alias("back"))


@query(r"""WITH k AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN substr(o_orderpriority, 3) ELSE (o_orderkey % 977) || o_orderpriority END AS key FROM orders), n AS (SELECT *, TRY_CAST(nullif(regexp_extract(key, '^\s*([+-]?\d+(?:\.\d+)?)', 1), '') AS DOUBLE) AS num FROM k)
 SELECT key, count(*) AS n, min(p) AS first_place FROM (SELECT *, row_number() OVER (ORDER BY num IS NULL, num, key) AS p FROM n) GROUP BY key""")
def mixed_key_order(spark, d):
    """Keys in mixed order, those that begin with a number by it and then the others: where each first comes."""
    k = load(spark, d, "orders").select(F.when(F.col("o_orderkey") % 3 == 0, F.substring("o_orderpriority", 3, 99)).otherwise(F.concat((F.col("o_orderkey") % 977).cast("string"), "o_orderpriority")).alias("key"))
    return R.mixed_order(k, "key").groupBy("key").agg(F.count("*").alias("n"), F.min("place").alias("first_place"))


@query("""WITH a AS (SELECT user_id, CAST(props->>'k' AS BIGINT) AS question, ts, event_id, event_type IN ('view', 'click') AS hit FROM events), f AS (SELECT *, row_number() OVER (PARTITION BY user_id, question ORDER BY ts, event_id) AS k FROM a), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS round FROM f WHERE k = 1)
 SELECT user_id, count(*) AS rounds, count(*) FILTER (WHERE hit) AS hits, CAST(floor(100.0 * count(*) FILTER (WHERE hit) / count(*) + 0.5) AS BIGINT) AS pct FROM r WHERE round <= 8 GROUP BY user_id""")
def quiz_result(spark, d):
    """Each user's first eight questions: hits and per cent; only the first answer to a question counts."""
    hit = F.col("event_type").isin("view", "click")
    log = load(spark, d, "events").select("user_id", F.from_json("props", "k bigint")["k"].alias("question"), F.struct("ts", "event_id").alias("at"), hit.alias("hit"))
    first = log.groupBy("user_id", "question").agg(F.min_by(F.struct("at", "hit"), "at").alias("x")).select("user_id", "x.at", "x.hit")
    rounds = R.ordinal_ranks(first, "user_id", ["at"]).filter("rank <= 8")
    out = rounds.groupBy("user_id").agg(F.count("*").alias("rounds"), F.count_if("hit").alias("hits"))
    return out.withColumn("pct", F.floor(100.0 * F.col("hits") / F.col("rounds") + 0.5).cast("bigint"))


def _literals() -> list[tuple[str, str, str, float]]:
    g = generators
    rows = [("clusters", str(i), name, float(n)) for i, name, n in g.CLUSTERS] + [("structure", "", name, float(n)) for name, n in g.STRUCTURE]
    rows += [("names", kind, name, float(n)) for kind, some in g.NAMES.items() for name, n in some] + [("similarity", "", name, v) for name, v in g.SIMILARITIES]
    return rows + [("totals", "", "authors", float(g.AUTHORS)), ("totals", "", "affiliations", float(g.AFFILIATED))]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{r}', '{k}', '{n}', CAST({v!r} AS DOUBLE))" for r, k, n, v in _literals()) + ") AS t(relation, kind, name, n)")
def literal_relations(spark, d):
    """The other tables written in the code."""
    return generators.literal(spark, _literals(), "relation string, kind string, name string, n double")


_IMG = """WITH e AS (SELECT vec_id, list_transform(range(0, 64), lambda i: greatest(0, least(255, floor((CAST(embedding[i + 1] AS DOUBLE) * 4 + 1) * 127.5))) / 255.0) AS q FROM embeddings),
 px AS (SELECT vec_id, i // 8 AS yy, i % 8 AS xx, q[i + 1] AS r, q[64 - i] AS g, q[(i * 7) % 64 + 1] AS b FROM e, range(0, 64) t(i)),
 g AS (SELECT *, 0.299 * r + 0.587 * g + 0.114 * b AS grey, r - g AS rg, (r + g) / 2 - b AS yb, CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) ELSE 0 END AS s FROM px),
 base AS (SELECT vec_id, avg(CAST(grey < 0.85 AS DOUBLE)) AS ink, avg(CAST(grey > 0.95 AS DOUBLE)) AS white, sqrt(var_pop(rg) + var_pop(yb)) + 0.3 * sqrt(avg(rg) * avg(rg) + avg(yb) * avg(yb)) AS colf, avg(s) AS sat FROM g GROUP BY 1),
 ed AS (SELECT a.vec_id, avg(sqrt((b.grey - a.grey) * (b.grey - a.grey) + (c.grey - a.grey) * (c.grey - a.grey))) AS edge FROM g a JOIN g b ON b.vec_id = a.vec_id AND b.yy = a.yy AND b.xx = a.xx + 1 JOIN g c ON c.vec_id = a.vec_id AND c.xx = a.xx AND c.yy = a.yy + 1 GROUP BY 1),
 h AS (SELECT vec_id, least(63, CAST(floor(grey * 64) AS INTEGER)) AS bin, count(*) / 64.0 AS sh FROM g GROUP BY 1, 2), en AS (SELECT vec_id, -sum(sh * log2(sh)) AS ent FROM h GROUP BY 1)
 SELECT vec_id, round(edge, 3) AS edge, round(ink, 3) AS ink, round(colf, 3) AS colf, round(sat, 3) AS sat, round(ent, 3) AS ent, round(white, 3) AS white, 1.0::DOUBLE AS ar FROM base JOIN ed USING (vec_id) JOIN en USING (vec_id)"""


@query(_IMG)
def image_statistics(spark, d):
    """The seven appearance statistics of images: every embedding is drawn as a small one, encoded and decoded again."""
    level = F.transform("embedding", lambda x: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor((x.cast("double") * 4 + 1) * 127.5).cast("double"))).cast("int"))

    def draw(batches):
        for pdf in batches:
            content = []
            for q in pdf["q"]:
                q, i = np.asarray(q, np.uint8), np.arange(64)
                content.append(I.encode_png(np.stack([q, q[63 - i], q[i * 7 % 64]], axis=1).reshape(8, 8, 3)))
            yield pd.DataFrame({"name": pdf["name"], "content": content})

    files = load(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("name"), level.alias("q")).mapInPandas(draw, "name string, content binary")
    return I.image_features(files).select(F.col("name").cast("bigint").alias("vec_id"), *(F.round(c, 3).alias(c) for c in I.FEATURES))


def _more_scalars(spark, d) -> dict:
    """Named numbers of a page, each a one-row table with the column v."""
    one = lambda df, c: df.select(c.alias("v"))
    f, p = checkpointed(figures(spark, d)), points(spark, d)
    gen, rate = F.col("is_generated"), lambda c: X.percent(X.half_up(c * 100, 1))
    lit = lambda v: spark.range(1).select(F.lit(v).alias("v"))
    mean = lambda c, fn, places: F.format_string(f"%.{places}f", fn(F.when(gen, F.col(c))))
    ends, sets = checkpointed(link_homophily(spark, d)), checkpointed(ablation(spark, d))  # a few rows each
    tally = {name: 100.0 * n / generators.AUTHORS for name, n, _ in generators.AFFILIATIONS[:2]}
    return {
        "total-figs": f.agg(F.count("*").cast("string").alias("v")),
        "authors": lit(str(generators.AUTHORS)), "affiliations": lit(str(generators.AFFILIATED)),
        **{k: one(ends, X.percent(F.round(c, 1))) for k, c in (("knn-same", "same_pct"), ("knn-gen", "gen_pct"), ("knn-real", "real_pct"))},
        "knn-edges": one(ends, F.col("edges").cast("string")),
        "lda-acc": one(lda_loo_2d(spark, d), rate(F.col("hits") / F.col("n"))), "lda-pc1": one(lda_loo_1d(spark, d), rate(F.col("hits") / F.col("n"))),
        "lda-base": p.agg(rate(F.greatest(F.avg("is_real"), 1 - F.avg("is_real"))).alias("v")), "lda-miss": one(lda_misses(spark, d), F.col("misses").cast("string")),
        **{f"sim-{k}": lit(f"{v:.3f}") for k, v in generators.SIMILARITIES},
        "gib-max": f.agg(mean("gib", F.max, 3).alias("v")), "clip-mean": f.agg(mean("clip", F.avg, 3).alias("v")), "clip-min": f.agg(mean("clip", F.min, 3).alias("v")), "cplx-mean": f.agg(mean("cplx", F.avg, 1).alias("v")),
        "hall-pct": lit(f"{list(tally.values())[0]:.1f}%"), "mut-pct": lit(f"{list(tally.values())[1]:.1f}%"),
        "notitle": one(missing_counts(spark, d), F.col("untitled").cast("string")),
        **{k: one(sets.filter(F.col("name") == n), F.concat(F.format_string("%.1f", F.col("acc") * 100), F.lit("%"))) for k, n in (("pixel-acc", "pixels"), ("both-acc", "x+y+pixels"))},
        "pixel-best-auc": feature_auc(spark, d).agg(F.format_string("%.3f", F.max("auc_free")).alias("v")),
    }


def _scalar_sql() -> str:
    half = lambda e: f"printf('%.1f%%', floor(({e}) * 1000 + 0.5) / 10)"
    gen = lambda fn, c, places: f"printf('%.{places}f', {fn}({c}) FILTER (WHERE c = 1))"
    fig = lambda e: f"(WITH {_FIG} SELECT {e} AS v FROM fig)"
    of = lambda q, e, where="": f"(SELECT {e} AS v FROM ({SQL[q]}) {where})"
    tally = [f"{100.0 * n / generators.AUTHORS:.1f}%" for _, n, _ in generators.AFFILIATIONS[:2]]
    rows = {
        "total-figs": fig("CAST(count(*) AS VARCHAR)"), "authors": f"(SELECT '{generators.AUTHORS}' AS v)", "affiliations": f"(SELECT '{generators.AFFILIATED}' AS v)",
        **{k: of("link_homophily", f"printf('%.1f%%', round({c}, 1))") for k, c in (("knn-same", "same_pct"), ("knn-gen", "gen_pct"), ("knn-real", "real_pct"))},
        "knn-edges": of("link_homophily", "CAST(edges AS VARCHAR)"), "lda-acc": of("lda_loo_2d", half("hits / n")), "lda-pc1": of("lda_loo_1d", half("hits / n")),
        "lda-base": f"(WITH {_PTS} SELECT {half('greatest(avg(is_real), 1 - avg(is_real))')} AS v FROM pts)", "lda-miss": of("lda_misses", "CAST(misses AS VARCHAR)"),
        **{f"sim-{k}": f"(SELECT '{v:.3f}' AS v)" for k, v in generators.SIMILARITIES},
        "gib-max": fig(gen("max", "gib", 3)), "clip-mean": fig(gen("avg", "clip", 3)), "clip-min": fig(gen("min", "clip", 3)), "cplx-mean": fig(gen("avg", "cplx", 1)),
        "hall-pct": f"(SELECT '{tally[0]}' AS v)", "mut-pct": f"(SELECT '{tally[1]}' AS v)", "notitle": of("missing_counts", "CAST(untitled AS VARCHAR)"),
        **{k: of("ablation", "printf('%.1f%%', acc * 100)", f"WHERE name = '{n}'") for k, n in (("pixel-acc", "pixels"), ("both-acc", "x+y+pixels"))},
        "pixel-best-auc": of("feature_auc", "printf('%.3f', max(auc_free))"),
    }
    return " UNION ALL ".join(f"SELECT '{k}' AS key, v AS text FROM {q}" for k, q in rows.items())


@query(_scalar_sql())
def page_scalars(spark, d):
    """The other named numbers as text."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("key"), F.col("v").alias("text")) for k, df in _more_scalars(spark, d).items()])


@query(f"WITH {_PAP}, o AS (SELECT DISTINCT f, title FROM papers) SELECT o.f AS f, count(*) AS titles FROM o WHERE f IN (SELECT f FROM pap) GROUP BY 1")
def known_titles(spark, d):
    """Titles written for papers in force; those of unknown papers are left out."""
    written = load(spark, d, "papers").select("f", "title").distinct()
    return written.join(papers(spark, d).select("f"), "f", "left_semi").groupBy("f").agg(F.count("*").alias("titles"))


@query(f"WITH {_FIG}, t AS (SELECT n AS label, min(id) AS id FROM fig GROUP BY 1) SELECT fig.id AS id, t.id AS first_id FROM fig JOIN t ON t.label = fig.n")
def first_of_name(spark, d):
    """Every figure with the first one of its name."""
    f = figures(spark, d, "n")
    first = f.groupBy("n").agg(F.min("id").alias("first_id"))
    return f.join(first, "n").select("id", "first_id")
