"""Generated and literal relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Audited tallies of author affiliations, clusters, structure, names and similarities.
AFFILIATIONS = [
    ("Hallucinated (institution does not exist)", 107, "fake"), ("Mutated (real institution, wrong name)", 77, "mutated"), ("Stanford", 44, "real"),
    ("None listed", 23, "none"), ("U Toronto", 23, "real"), ("MIT", 19, "real"), ("UC Berkeley", 16, "real"), ("Google / DeepMind", 15, "real"),
    ("CMU", 10, "real"), ("Georgia Tech", 7, "real"), ("UIUC", 6, "real"),
]


CLUSTERS = [(1, "Object detection", 21), (2, "Semantics / segmentation", 25), (3, "Image generation", 12), (4, "Localization / spatiotemporal", 18), (5, "Visual features / networks", 24)]
STRUCTURE = [("All features present", 69), ("Missing title", 19), ("Missing references", 8), ("Missing affiliations", 7)]
NAMES = {
    "last": [("Chen", 28), ("Zhang", 17), ("Wang", 11), ("Liu", 11), ("Lee", 10), ("Thompson", 9), ("Johnson", 9), ("Nguyen", 8), ("Smith", 8), ("Patel", 8), ("Doe", 7), ("Wu", 6), ("Wong", 5), ("Li", 5), ("Kim", 5), ("Xu", 5)],
    "first": [("Michael", 20), ("David", 17), ("Emily", 13), ("John", 13), ("Kevin", 11), ("Laura", 9), ("Rachel", 8), ("Alex", 7), ("Daniel", 6), ("Eric", 6), ("Jane", 6), ("Jason", 5), ("Thomas", 5), ("Alice", 5), ("James", 5)],
    "full": [("Kevin Chen", 4), ("David Chen", 4), ("John Doe", 4), ("Jacob Wang", 3), ("Emily Chen", 3), ("John Smith", 3), ("Jane Doe", 3), ("Alice Johnson", 3), ("Jane Smith", 3)],
}
SIMILARITIES = [("g2r", 0.44537696), ("g2g", 0.49628806), ("r2r", 0.4854793)]
AUTHORS, AFFILIATED = 340, 317


def file_list(spark: SparkSession, prefix: str, n: int, suffix: str = ".png") -> DataFrame:
    """(name, i) for i = 1..n."""
    return spark.range(1, n + 1).select(F.concat(F.lit(prefix), F.col("id").cast("string"), F.lit(suffix)).alias("name"), F.col("id").alias("i"))


def frame_list(spark: SparkSession, folder: str, n: int, width: int = 6) -> DataFrame:
    """(name, i) for i = 0..n-1, the number padded with zeros."""
    return spark.range(n).select(F.concat(F.lit(folder), F.lpad(F.col("id").cast("string"), width, "0"), F.lit(".jpg")).alias("name"), F.col("id").alias("i"))


def lcg(spark: SparkSession, seed: int, n: int) -> DataFrame:
    """(i, v, u): n steps of the 32-bit linear congruential generator. Each step needs the last, so one task makes them."""
    step = lambda s: F.pmod(s * F.lit(1664525) + F.lit(1013904223), F.lit(4294967296))
    made = F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.array(F.lit(seed).cast("bigint")), lambda a, _: F.concat(a, F.array(step(F.element_at(a, -1)))))
    rows = spark.range(1).select(F.posexplode(made).alias("i", "v")).filter("i > 0")
    return rows.select(F.col("i").cast("bigint").alias("i"), "v", F.round(F.col("v") / 4294967296.0, 6).alias("u"))


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)
