"""Keyed tables and order: last write wins, conditional enrichment, ranks without one big partition, small samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from foliospark.functions.text import leading_number
from foliospark.sources.tables import checkpointed


def last_wins(df: DataFrame, key: str | list[str], order: list[Column | str]) -> DataFrame:
    """One row per key: the one greatest in `order` (null lowest).

    An aggregation, not a window: rows are combined before the shuffle, so a hot key costs one row per task.
    """
    keys = [key] if isinstance(key, str) else key
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("__row"))
    return best.select("__row.*")


def current(df: DataFrame, key: str, ties: list[str]) -> DataFrame:
    """The rows in force: the last loaded row of each key, unless that one is a deletion."""
    order = ["loaded_at", "deleted_at", *ties]
    return last_wins(df, key, [F.col(c) for c in order]).filter("deleted_at is null")


def enrich_where(left: DataFrame, right: DataFrame, on: str, condition: Column) -> DataFrame:
    """Left join in which rows that fail the condition on the left keep null extras."""
    extra = [c for c in right.columns if c != on]
    r = right.select(F.col(on).alias("__on"), *extra)
    return left.join(r, (left[on] == r["__on"]) & condition, "left").drop("__on")


def ordinal_ranks(df: DataFrame, group: str, order: list[str], partitions: int | None = None, weight: Column | None = None) -> DataFrame:
    """df with `rank`: 1, 2, 3 ... within each group by order, ties as they come in `order`; a row of some weight stands
    for as many rows and has the rank of the last."""
    return running(df, group, order, {"rank": F.lit(1) if weight is None else weight}, partitions)


def running(df: DataFrame, group: str, order: list[str], sums: dict[str, Column], partitions: int | None = None) -> DataFrame:
    """df with running sums over each group in order, the row itself included.

    The order is made by range partitioning over group and order together, so one group may fill many partitions; a
    row's sum is that of the group's rows in earlier partitions plus the one inside its own. Totals travel as one row
    per partition and group.
    """
    spark = df.sparkSession
    n = partitions or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    named = df.select("*", *(c.cast("bigint").alias(f"__v_{k}") for k, c in sums.items()))
    ranged = checkpointed(named.repartitionByRange(n, group, *order).withColumn("__p", F.spark_partition_id()))
    totals = ranged.groupBy(group, "__p").agg(*(F.sum(f"__v_{k}").alias(f"__t_{k}") for k in sums))
    earlier = Window.partitionBy(group).orderBy("__p")
    before = totals.select(F.col(group).alias("__g"), F.col("__p").alias("__q"), *((F.sum(f"__t_{k}").over(earlier) - F.col(f"__t_{k}")).alias(f"__b_{k}") for k in sums))
    w = Window.partitionBy("__p", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inner = ranged.select("*", *(F.sum(f"__v_{k}").over(w).alias(f"__r_{k}") for k in sums))
    out = inner.join(before, inner[group].eqNullSafe(F.col("__g")) & (inner["__p"] == F.col("__q")))
    return out.select(*(inner[c] for c in df.columns), *((F.col(f"__r_{k}") + F.col(f"__b_{k}")).alias(k) for k in sums))


def mixed_order(df: DataFrame, key: str) -> DataFrame:
    """df with `place`: keys that begin with a number first, by it, then the others; equal ones by the text."""
    number = leading_number(F.col(key))
    ranked = ordinal_ranks(df.select("*", F.lit(0).alias("__all"), number.isNull().alias("__text"), number.alias("__number")), "__all", ["__text", "__number", key])
    return ranked.withColumnRenamed("rank", "place").drop("__all", "__text", "__number")


def sampled_pairs(df: DataFrame, id_col: str, side: Column, n: int, by: Column) -> DataFrame:
    """(round, id_a, id_b): the i-th of n sampled rows where side holds, with the i-th where it doesn't; by: the draw."""
    both = None
    for flag, name in ((True, "id_a"), (False, "id_b")):
        top = df.filter(side == F.lit(flag)).select(F.col(id_col).alias(name), by.alias("__h")).orderBy("__h", name).limit(n)
        one = top.withColumn("round", F.row_number().over(Window.orderBy("__h", name))).drop("__h")  # n rows
        both = one if both is None else both.join(one, "round")
    return both.select("round", "id_a", "id_b")


def nearest_within(points: DataFrame, id_col: str, x: str, y: str, probes: list[tuple[int, float, float]], radius: float) -> DataFrame:
    """(probe, id, d2): for each probe the nearest point within the radius, of equally near ones the smaller id.

    The probes are a literal list; points meet them map-side and only one row per probe and task is shuffled.
    """
    listed = F.array(*(F.struct(F.lit(i).alias("probe"), F.lit(float(a)).alias("px"), F.lit(float(b)).alias("py")) for i, a, b in probes))
    hit = points.select(F.col(id_col).alias("id"), F.col(x).alias("x"), F.col(y).alias("y"), F.explode(listed).alias("q"))
    d2 = (F.col("x") - F.col("q.px")) * (F.col("x") - F.col("q.px")) + (F.col("y") - F.col("q.py")) * (F.col("y") - F.col("q.py"))
    hit = hit.select("id", "q.probe", d2.alias("d2")).filter(F.col("d2") < radius * radius)
    return hit.groupBy("probe").agg(F.min(F.struct("d2", "id")).alias("b")).select("probe", "b.id", "b.d2")
