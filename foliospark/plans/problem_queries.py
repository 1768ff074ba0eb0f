"""Queries of the general training-data operators: p1 (orphan references) and p4 (packed values)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import orphans as O
from foliospark.operators.split_values import split_values
from foliospark.sources.tables import load


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    figures = O.live_spans(load(spark, d, "figures").select("id", "loaded_at", "deleted_at"), F.col("id"))
    papers = O.live_spans(load(spark, d, "papers").select("f", "loaded_at", "deleted_at"), O.plain_key("f"))
    links = O.references(load(spark, d, "links").select("link_id", "s", "t", "loaded_at"), "links")
    paper_links = O.references(load(spark, d, "paper_links").select("link_id", "s", "t", "loaded_at"), "paper_links", O.plain_key)
    keep = ("tbl", "link_id", "side", "at")
    return O.orphan_references(links, figures).select(*keep).unionByName(O.orphan_references(paper_links, papers).select(*keep))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every reference of links and paper_links that held at its loading time no live record."""
    return _orphans(spark, d).select("tbl", "link_id", "side").distinct()


def p1_orphan_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per link table, month and side."""
    return O.orphan_counts(_orphans(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every value of papers.authors, papers.aff and papers.refs with its position."""
    papers = load(spark, d, "papers").select("f", "authors", "aff", "refs")
    return split_values(papers, "f", {"authors": "people", "aff": "places", "refs": "entries"}).distinct()


def p4_checks(spark: SparkSession, d: str) -> DataFrame:
    """Fields whose positions aren't 1, 2, 3 ..., values that are blank or 'None' alone in their field, and values with
    outer or repeated white space: any right result has none."""
    rows = p4_found(spark, d)
    fields = rows.groupBy("f", "field").agg(F.count("*").alias("n"), F.count_distinct("pos").alias("k"), F.max("pos").alias("last"), F.min("pos").alias("first"), F.min("value").alias("v"))
    gaps = fields.agg(F.count_if((F.col("n") != F.col("k")) | (F.col("n") != F.col("last")) | (F.col("first") != 1)).alias("gaps"), F.count_if((F.col("n") == 1) & (F.col("v") == "None")).alias("nothing"))
    loose = rows.agg(F.count_if(F.col("value").rlike(r"(?U)^\s|\s$|\s\s|^$")).alias("loose"))
    return gaps.crossJoin(loose)  # two single rows


QUERIES = {"p1_found": p1_found, "p1_orphan_report": p1_orphan_report, "p4_found": p4_found, "p4_checks": p4_checks}

_REFS = r"""
WITH refs AS (
  SELECT 'links' AS tbl, link_id, 's' AS side, CAST(s AS VARCHAR) AS key, loaded_at FROM links WHERE s IS NOT NULL
  UNION ALL SELECT 'links', link_id, 't', CAST(t AS VARCHAR), loaded_at FROM links WHERE t IS NOT NULL
  UNION ALL SELECT 'paper_links', link_id, 's', lower(regexp_replace(s, '^\s+|\s+$', '', 'g')), loaded_at FROM paper_links
    WHERE regexp_replace(s, '^\s+|\s+$', '', 'g') NOT IN ('', 'None')
  UNION ALL SELECT 'paper_links', link_id, 't', lower(regexp_replace(t, '^\s+|\s+$', '', 'g')), loaded_at FROM paper_links
    WHERE regexp_replace(t, '^\s+|\s+$', '', 'g') NOT IN ('', 'None')
), live AS (
  SELECT 'links' AS tbl, CAST(id AS VARCHAR) AS key, loaded_at, deleted_at FROM figures
  UNION ALL SELECT 'paper_links', lower(regexp_replace(f, '^\s+|\s+$', '', 'g')), loaded_at, deleted_at FROM papers
), dead AS (
  SELECT DISTINCT tbl, link_id, side, loaded_at FROM refs r WHERE NOT EXISTS (
    SELECT 1 FROM live v WHERE v.tbl = r.tbl AND v.key = r.key AND v.loaded_at <= r.loaded_at
      AND (v.deleted_at IS NULL OR v.deleted_at > r.loaded_at))
)
"""

SQL = {
    "p4_checks": "SELECT 0 AS gaps, 0 AS nothing, 0 AS loose",
    "p1_found": _REFS + "SELECT DISTINCT tbl, link_id, side FROM dead",
    "p1_orphan_report": _REFS + "SELECT tbl, strftime(loaded_at, '%Y-%m') AS period, side, count(DISTINCT link_id) AS orphans FROM dead GROUP BY 1, 2, 3",
}
