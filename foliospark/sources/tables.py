"""Table access: Parquet tables by name, and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the folder; a file or a folder of part files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Takes the folder of spark.checkpoint.dir. Where it is unset a local session (tests) gets a folder of this machine;
    on a cluster, whose executors could not share that, it is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="folio-ckpt-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder, its lineage cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def restarted(df: DataFrame) -> DataFrame:
    """df checkpointed, and its size unknown to the planner again; for what a loop carries from round to round.

    checkpoint() keeps the estimated size of the plan it cuts. That of a join is the product of its sides, so in a loop
    that joins its own results the digits of the estimate multiply each round, until the number alone fills the driver.
    """
    done = checkpointed(df)
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(done._jdf.queryExecution().toRdd(), done._jdf.schema(), False), spark)


def safe_key(df: DataFrame, name: str) -> tuple[Column, str, str]:
    """(column, its type, its type in the schema) of a key that goes through pandas: whole numbers go as text, for with a
    null among them pandas would make them floating-point numbers."""
    kind = df.schema[name].dataType.simpleString()
    whole = kind in ("tinyint", "smallint", "int", "bigint")
    return (F.col(name).cast("string"), "string", kind) if whole else (F.col(name), kind, kind)


def present(col: Column | str) -> Column:
    """True where a text holds something: not null, not blank and not 'None'."""
    c = F.col(col) if isinstance(col, str) else col
    return c.isNotNull() & ~F.trim(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")).isin("", "None")
