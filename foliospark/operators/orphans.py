"""References to records that do not exist: missing, already deleted, or loaded only afterwards.

A reference is live if some row of its key was loaded not after the reference's time and deleted after it or never.
The split by skew: references are counted per key and period, once; keys that would fill a shuffle partition alone are
heavy. There can be no more heavy keys than partitions, so a broadcast of them is bounded whatever the data; their live
spans are broadcast after a check of their number and meet the references without a shuffle, or, beyond that number,
meet them salted by month. The other keys go through a shuffled anti-join. Both give rows, and the union counts them per
table and period. References and spans are written once to the checkpoint folder, from which all steps read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from foliospark.sources.tables import checkpointed

#: A key is heavy from this share of all references, or from that of an average shuffle partition if that is less.
HEAVY_SHARE = 1 / 256
#: Heavy live spans above this number go through a salted shuffle instead of a broadcast.
MAX_BROADCAST_SPANS = 200_000
FOREVER = "9999-12-31 00:00:00"


def plain_key(col: Column | str) -> Column:
    """A text key for comparison: outer white space off, lower case; null for '' and 'None'."""
    c = F.regexp_replace(F.col(col) if isinstance(col, str) else col, r"(?U)^\s+|\s+$", "")
    return F.when(~c.isin("", "None"), F.lower(c))


def references(links: DataFrame, tbl: str, key=F.col) -> DataFrame:
    """(tbl, link_id, side, key, at) for the ends s and t of a link table; a null end is no reference.

    Copies of a row count once downstream, where results are made distinct.
    """
    return (
        links.select("link_id", F.col("loaded_at").alias("at"), F.explode(F.array(*(F.struct(F.lit(s).alias("side"), key(s).alias("key")) for s in ("s", "t")))).alias("r"))
        .select(F.lit(tbl).alias("tbl"), "link_id", "r.side", "r.key", "at")
        .filter("key is not null")
    )


def live_spans(target: DataFrame, key: Column) -> DataFrame:
    """(key, since, until): the times at which a key has a live row, as disjoint spans; until is exclusive.

    Rows are combined per key and loading time before the shuffle, so copies and reloads cost nothing; then spans that
    touch are merged in order of time. A row without loaded_at is never live.
    """
    until = F.coalesce(F.col("deleted_at"), F.lit(FOREVER).cast(target.schema["loaded_at"].dataType))
    rows = target.select(key.alias("key"), F.col("loaded_at").alias("since"), until.alias("until")).filter("key is not null and since is not null and until > since")
    rows = rows.groupBy("key", "since").agg(F.max("until").alias("until"))
    # first within months, so that no task sees all rows of a hot key, then what is left of each key
    return _merged(_merged(rows.withColumn("month", F.date_trunc("month", "since")), "key", "month").drop("month"), "key")


def _merged(rows: DataFrame, *by: str) -> DataFrame:
    """Overlapping and touching spans of a group become one."""
    order = Window.partitionBy(*by).orderBy("since")
    before = F.max("until").over(order.rowsBetween(Window.unboundedPreceding, -1))
    run = rows.withColumn("new", F.coalesce(F.col("since") > before, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(order))
    return run.groupBy(*by, "run").agg(F.min("since").alias("since"), F.max("until").alias("until")).drop("run")


def _dead(refs: DataFrame, spans: DataFrame) -> DataFrame:
    on = (refs["key"] == spans["key"]) & (spans["since"] <= refs["at"]) & (refs["at"] < spans["until"])
    return refs.join(spans, on, "left_anti")


def orphan_references(refs: DataFrame, spans: DataFrame, share: float = HEAVY_SHARE, max_spans: int = MAX_BROADCAST_SPANS) -> DataFrame:
    """Distinct (tbl, link_id, side, key, at) of the references without a live record at their time.

    refs as of references(), spans as of live_spans(). A reference without time is an orphan, for nothing is known to
    be live then; a null link_id stays null. Ties, repeated rows and empty tables need no care: the result is a set.
    """
    spark = refs.sparkSession
    refs, spans = checkpointed(refs), checkpointed(spans)
    counts = refs.groupBy("key", F.date_trunc("month", "at").alias("period")).agg(F.count("*").alias("n"))
    total = refs.count()
    least = max(1, int(total * min(share, 1 / int(spark.conf.get("spark.sql.shuffle.partitions")))))
    heavy = [r[0] for r in counts.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > least).select("key").collect()]  # as many as partitions
    if not heavy:
        return _dead(refs, spans).distinct()
    hot = F.col("key").isin(heavy) if len(heavy) < 16 else None
    if hot is None:
        keys = F.broadcast(spark.createDataFrame([(k,) for k in heavy], refs.select("key").schema))
        big, rest = refs.join(keys, "key", "left_semi").select(refs.columns), refs.join(keys, "key", "left_anti").select(refs.columns)
        big_spans = spans.join(keys, "key", "left_semi")
    else:
        big, rest, big_spans = refs.filter(hot), refs.filter(~hot), spans.filter(hot)
    if big_spans.limit(max_spans + 1).count() <= max_spans:
        dead = _dead(big, F.broadcast(big_spans))
    else:
        # spans of a key are disjoint and cut at month ends, so key and month spread a heavy key over partitions
        month = lambda c: F.date_trunc("month", c)
        cut = big_spans.withColumn("m", F.explode(F.sequence(month("since"), month(F.least("until", F.lit("2100-01-01").cast("timestamp"))), F.expr("interval 1 month"))))
        b = big.withColumn("m", month("at"))
        dead = b.join(cut, (b["key"] == cut["key"]) & (b["m"] == cut["m"]) & (cut["since"] <= b["at"]) & (b["at"] < cut["until"]), "left_anti").drop("m")
    return dead.unionByName(_dead(rest, spans)).distinct()


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """(tbl, period, side, orphans): orphan references per link table, month of loading and side."""
    return orphans.select("tbl", F.date_format("at", "yyyy-MM").alias("period"), "side", "link_id").distinct().groupBy("tbl", "period", "side").agg(F.count("*").alias("orphans"))
