"""Two-class linear discriminant with exact leave-one-out evaluation.

One aggregation gives the moments (class counts, class sums, cross products), from which the fit follows on the driver
as a d x d solve. Leaving a row out is a downdate of the moments, so evaluation is one more pass over the rows, with the
moments as its only side input, instead of one fit per row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from foliospark.functions.exprs import is_number
from foliospark.sources.tables import checkpointed

RIDGE = 1e-6


@dataclass(frozen=True)
class Moments:
    """n, sums: per class (0, 1); cross: sum of x x' over both; centre: subtracted from all rows."""

    n: np.ndarray
    sums: np.ndarray
    cross: np.ndarray
    centre: np.ndarray


def moments(df: DataFrame, axes: list[str], y: str) -> Moments:
    """Two passes: the mean, then moments about it, which limits cancellation. Rows with a null count nowhere."""
    return set_moments(df, {"": axes}, y)[""]


def set_moments(df: DataFrame, sets: dict[str, list[str]], y: str) -> dict[str, Moments]:
    """Moments of several sets of axes in the same two passes; for each set its own rows without null and NaN count."""
    names = list(sets)
    whole = {k: reduce(lambda a, b: a & b, (is_number(F.col(c).cast("double")) for c in axes), F.col(y).isNotNull()) for k, axes in sets.items()}
    of = lambda k, c: F.when(whole[k], c)
    got = list(df.agg(*(F.avg(of(k, F.col(c).cast("double"))) for k in names for c in sets[k])).head())
    centre = {k: np.array([got.pop(0) or 0.0 for _ in sets[k]]) for k in names}
    aggs = []
    for k in names:
        x = [F.col(c).cast("double") - float(m) for c, m in zip(sets[k], centre[k])]
        d = len(x)
        aggs += [F.count_if(whole[k] & (F.col(y).cast("int") == c)) for c in (0, 1)]
        aggs += [F.sum(F.when(whole[k] & (F.col(y).cast("int") == c), x[i])) for c in (0, 1) for i in range(d)]
        aggs += [F.sum(of(k, x[i] * x[j])) for i in range(d) for j in range(i, d)]
    got = [v or 0 for v in df.agg(*aggs).head()]
    out = {}
    for k in names:
        d = len(sets[k])
        n, sums = np.array([got.pop(0) for _ in range(2)], float), np.array([got.pop(0) for _ in range(2 * d)], float).reshape(2, d)
        cross = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                cross[i, j] = cross[j, i] = got.pop(0)
        out[k] = Moments(n, sums, cross, centre[k])
    return out


def standardised(m: Moments, columns: list[int]) -> tuple[Moments, np.ndarray]:
    """(moments, scale) with the given columns divided by their population deviation over both classes; 1 for constant ones."""
    scale, n = np.ones(len(m.centre)), max(m.n.sum(), 1.0)
    total = m.sums.sum(0)
    for j in columns:
        sd = np.sqrt(max(m.cross[j, j] / n - (total[j] / n) ** 2, 0.0))
        scale[j] = sd if sd > 0 else 1.0
    return Moments(m.n, m.sums / scale, m.cross / np.outer(scale, scale), m.centre), scale


def fit(m: Moments) -> tuple[np.ndarray, float]:
    """(w, t) on uncentred rows: class 1 where w . x > t. Zero weights if a class is empty."""
    d, n = len(m.centre), m.n.sum()
    if not m.n.all() or n < 2:
        return np.zeros(d), 0.0
    total = m.sums.sum(0)
    cov = (m.cross - np.outer(total, total) / n) / (n - 1) + RIDGE * np.eye(d)
    mean = m.sums / m.n[:, None]
    w = np.linalg.solve(cov, mean[1] - mean[0])
    return w, float(w @ (mean[0] + mean[1]) / 2 + w @ m.centre)


def score(axes: list[str], w: np.ndarray, t: float) -> Column:
    """w . x - t as a column."""
    return sum((F.col(a) * float(c) for a, c in zip(axes[1:], w[1:])), F.col(axes[0]) * float(w[0])) - F.lit(float(t))


def left_out_hits(x: np.ndarray, y: np.ndarray, m: Moments) -> np.ndarray:
    """Whether each row is classed right by the fit without it; NaN where its class would be empty."""
    n = m.n.sum()
    if n < 3 or not len(x):
        return np.full(len(x), np.nan)
    x = x - m.centre
    counts = np.tile(m.n, (len(x), 1))
    counts[np.arange(len(x)), y] -= 1
    sums = np.tile(m.sums, (len(x), 1, 1))
    sums[np.arange(len(x)), y] -= x
    total = sums.sum(1)
    cov = (m.cross - x[:, :, None] * x[:, None, :] - total[:, :, None] * total[:, None, :] / (n - 1)) / (n - 2) + RIDGE * np.eye(x.shape[1])
    ok = counts.min(1) > 0
    mean = sums / np.maximum(counts, 1)[:, :, None]
    w = np.linalg.solve(cov, (mean[:, 1] - mean[:, 0])[:, :, None])[:, :, 0]
    mid = (mean[:, 0] + mean[:, 1]) / 2
    said = np.einsum("ij,ij->i", w, x - mid) > 0
    return np.where(ok, said == (y == 1), np.nan)


def leave_one_out(df: DataFrame, axes: list[str], y: str, name: str) -> DataFrame:
    """(name, hits, n): rows classed right without themselves; rows whose class would be empty don't count."""
    return leave_one_out_sets(df, {name: axes}, y)


def leave_one_out_sets(df: DataFrame, sets: dict[str, list[str]], y: str, unit: list[str] | None = None) -> DataFrame:
    """(name, hits, n) of several sets of axes: the rows are written once, two passes give the moments of all sets, one
    more the hits of all. Axes in `unit` are standardised by their deviation over both classes before the ridge counts."""
    spark = df.sparkSession
    columns = list(dict.fromkeys(c for axes in sets.values() for c in axes))
    rows = checkpointed(df.select(F.col(y).cast("int").alias("__y"), *(F.col(c).cast("double").alias(c) for c in columns)))
    fits = {k: standardised(m, [j for j, c in enumerate(sets[k]) if c in (unit or [])]) for k, m in set_moments(rows, sets, "__y").items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hits, n = dict.fromkeys(sets, 0), dict.fromkeys(sets, 0)
        for pdf in batches:
            pdf = pdf[pdf["__y"].notna()]
            for k, axes in sets.items():
                x = pdf[axes].to_numpy(float)
                full = ~np.isnan(x).any(1)
                m, scale = fits[k]
                h = left_out_hits((x[full] - m.centre) / scale, pdf["__y"].to_numpy(int)[full], Moments(m.n, m.sums, m.cross, np.zeros(len(axes))))
                hits[k], n[k] = hits[k] + int(np.nansum(h)), n[k] + int((~np.isnan(h)).sum())
        yield pd.DataFrame({"name": list(sets), "hits": list(hits.values()), "n": list(n.values())})

    named = spark.createDataFrame([(k,) for k in sets], "name string")
    got = rows.mapInPandas(run, "name string, hits bigint, n bigint").groupBy("name").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n"))
    return named.join(got, "name", "left").select("name", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("n", F.lit(0)).alias("n"))
