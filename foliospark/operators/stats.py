"""Statistics as single aggregations: summaries, classes, histograms, ranks, correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from foliospark.functions.exprs import is_number, unit_bin
from foliospark.operators.relational import ordinal_ranks
from foliospark.sources.tables import checkpointed


def unpivot(df: DataFrame, ids: list[str], columns: dict[str, Column], name: str = "feature", value: str = "v") -> DataFrame:
    """One row per id and column, without null and NaN values."""
    pairs = F.array(*(F.struct(F.lit(k).alias(name), c.cast("double").alias(value)) for k, c in columns.items()))
    out = df.select(*ids, F.explode(pairs).alias("x")).select(*ids, f"x.{name}", f"x.{value}")
    return out.filter(is_number(F.col(value)))


def summary(long: DataFrame, by: str = "feature", value: str = "v") -> DataFrame:
    """n, mean, sample deviation, least, greatest and exact median per group.

    The median is the mean of the middle ranks, which range-partitioned running counts give: no task gets all values.
    """
    v = F.col(value)
    stats = long.groupBy(by).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max"))
    counts = checkpointed(long.groupBy(by, v.alias("__v")).agg(F.count("*").alias("__k")))
    ranks = ordinal_ranks(counts, by, ["__v"], weight=F.col("__k"))
    sizes = counts.groupBy(by).agg(F.sum("__k").alias("__n"))
    lo, hi = F.floor((F.col("__n") + 1) / 2), F.floor(F.col("__n") / 2) + 1
    within = lambda r: ((F.col("rank") >= r) & (F.col("rank") - F.col("__k") < r)).cast("int")
    middle = ranks.join(F.broadcast(sizes), by).select(by, "__v", (within(lo) + within(hi)).alias("__w")).filter("__w > 0")  # a row per group
    med = middle.groupBy(by).agg((F.sum(F.col("__v") * F.col("__w")) / 2).alias("med"))
    return stats.join(med, by)


def class_means(long: DataFrame, flag: str) -> DataFrame:
    """Per feature the mean of each class, raw and standardised over both (population deviation); null if constant."""
    stats = long.groupBy("feature").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    means = long.groupBy("feature").agg(F.avg(F.when(F.col(flag), F.col("v"))).alias("gen_raw"), F.avg(F.when(~F.col(flag), F.col("v"))).alias("real_raw"))
    out = means.join(stats, "feature")
    z = lambda c: F.try_divide(F.col(c) - F.col("m"), F.col("s"))
    return out.select("feature", "gen_raw", "real_raw", z("gen_raw").alias("gen_z"), z("real_raw").alias("real_z"))


def rank_auc(long: DataFrame, positive: str, tie: str) -> DataFrame:
    """Per feature the area under the ROC curve by ordinal ranks (ties in order of `tie`), and its direction-free form."""
    ranked = ordinal_ranks(long.select("feature", "v", tie, positive), "feature", ["v", tie])
    pos = F.col(positive)
    sums = ranked.groupBy("feature").agg(F.sum(F.when(pos, F.col("rank"))).alias("r"), F.count_if(pos).alias("n1"), F.count_if(~pos).alias("n2"))
    auc = F.try_divide(F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2, F.col("n1") * F.col("n2"))
    return sums.select("feature", auc.alias("auc")).withColumn("auc_free", F.greatest("auc", 1 - F.col("auc")))


def pearson(x: Column, y: Column) -> Column:
    """Correlation as an aggregate; 0 if either side is constant."""
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0))


def unit_histogram(long: DataFrame, n: int = 64) -> DataFrame:
    """(feature, bin, cnt, share) over [0, 1] in n bins, the last closed; values outside are left out."""
    counts = long.select("feature", unit_bin(F.col("v"), n).alias("bin")).filter("bin is not null").groupBy("feature", "bin").agg(F.count("*").alias("cnt"))
    totals = counts.groupBy("feature").agg(F.sum("cnt").alias("total"))
    return counts.join(totals, "feature").select("feature", "bin", "cnt", (F.col("cnt") / F.col("total")).alias("share"))


def entropy(hist: DataFrame) -> DataFrame:
    """Shannon entropy in bits of each histogram."""
    return hist.filter("share > 0").groupBy("feature").agg((-F.sum(F.col("share") * F.log2("share"))).alias("bits"))


def extents(long: DataFrame, pad: float = 0.06) -> DataFrame:
    """(feature, lo, hi): least and greatest value, padded by a share of the span."""
    e = long.groupBy("feature").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    return e.select("feature", (F.col("a") - (F.col("b") - F.col("a")) * pad).alias("lo"), (F.col("b") + (F.col("b") - F.col("a")) * pad).alias("hi"))


def centroids(points: DataFrame, flag: str, axes: list[str]) -> DataFrame:
    return points.groupBy(flag).agg(F.count("*").alias("n"), *(F.avg(a).alias(a) for a in axes))


def spreads(points: DataFrame, flag: str, axes: list[str]) -> DataFrame:
    """Mean distance of a class's points to its centroid; the centroids are two rows."""
    c = F.broadcast(centroids(points, flag, axes).select(flag, *(F.col(a).alias(f"c_{a}") for a in axes)))
    d = sum(((F.col(a) - F.col(f"c_{a}")) * (F.col(a) - F.col(f"c_{a}")) for a in axes[1:]), (F.col(axes[0]) - F.col(f"c_{axes[0]}")) * (F.col(axes[0]) - F.col(f"c_{axes[0]}")))
    return points.join(c, flag).groupBy(flag).agg(F.avg(F.sqrt(d)).alias("spread"))
