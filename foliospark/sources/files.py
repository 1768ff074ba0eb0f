"""File sources and sinks: graphs and bundles in JSON, metrics in CSV, spreadsheets, image folders.

Schemas are explicit. Readers of formats that Spark knows are Spark's own; spreadsheets and images are read as binary
files and decoded on the executors, one file per row.
"""

from __future__ import annotations

import io
import json
import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRAPH = "nodes array<struct<id:string,name:string,type:string,cluster:int,x:double,y:double,z:double>>, links array<struct<source:string,target:string,weight:double>>"
METRICS = "filename string, clip_similarity double, structural_complexity double, gibberish_ratio double, repetition double"
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, links (s, t, w)) of JSON documents {nodes, links}; a missing list is an empty one."""
    doc = spark.read.schema(GRAPH).json(path, multiLine=True)
    nodes = doc.select(F.explode("nodes").alias("x")).select("x.*")
    links = doc.select(F.explode("links").alias("x")).select(F.col("x.source").alias("s"), F.col("x.target").alias("t"), F.col("x.weight").alias("w"))
    return nodes, links


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(n, clip, cplx, gib, rep) of CSV files with a header; a number that can't be read aborts."""
    raw = spark.read.schema(METRICS).csv(path, header=True, mode="FAILFAST", enforceSchema=False)
    return raw.select(F.col("filename").alias("n"), F.col("clip_similarity").alias("clip"), F.col("structural_complexity").alias("cplx"), F.col("gibberish_ratio").alias("gib"), F.col("repetition").cast("int").alias("rep"))


def sheet_rows(data: bytes, sheet: str | None = None) -> list[list[str | None]]:
    """Cells of a workbook's sheet (the first one by default) as text, by rows; values, not formulas."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        strings = []
        if "xl/sharedStrings.xml" in names:
            root = ElementTree.fromstring(z.read("xl/sharedStrings.xml"))
            strings = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in root.iter(f"{_NS}si")]
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = [(s.get("name"), links[s.get(_REL)]) for s in book.iter(f"{_NS}sheet")]
        target = next((t for n, t in sheets if sheet is None or n == sheet), None)
        if target is None:
            raise ValueError(f"no sheet {sheet!r}")
        path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        rows = []
        for row in ElementTree.fromstring(z.read(path)).iter(f"{_NS}row"):
            cells: list[str | None] = []
            for c in row.iter(f"{_NS}c"):
                at = 0
                for ch in re.match(r"[A-Z]*", c.get("r") or "")[0]:
                    at = at * 26 + ord(ch) - 64
                at = at - 1 if at else len(cells)
                cells += [None] * (at + 1 - len(cells))
                v = c.find(f"{_NS}v")
                kind = c.get("t")
                if kind == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
                elif v is not None and v.text is not None:
                    cells[at] = strings[int(v.text)] if kind == "s" else v.text
            rows.append(cells)
        return rows


def read_sheet(spark: SparkSession, path: str, columns: list[str], sheet: str | None = None) -> DataFrame:
    """(ord, key, columns...) of workbooks: the first cell of a row is its key, columns are found by their header.

    Rows without key are skipped; keys and headers are stripped; a missing column or a short row gives ''.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    out = ", ".join(["ord bigint", "key string", *(f"`{c}` string" for c in columns)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for data in pdf["content"]:
                table = sheet_rows(bytes(data), sheet)
                head = {(h or "").strip(): i for i, h in enumerate(table[0])} if table else {}
                for k, row in enumerate(table[1:]):
                    if row and row[0]:
                        cell = lambda c, row=row: (row[head[c]] or "").strip() if c in head and head[c] < len(row) else ""
                        rows.append((k, row[0].strip(), *(cell(c) for c in columns)))
            yield pd.DataFrame(rows, columns=["ord", "key", *columns])

    return files.mapInPandas(run, out)


def read_images(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, name, content) of image files."""
    return spark.read.format("binaryFile").load(paths).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def with_fallback(df: DataFrame, listing: DataFrame, primary: str, fallback: str) -> DataFrame:
    """df with `source`: the primary file where the listing (name) has it, else the fallback."""
    there = listing.select(F.col("name").alias("__n")).distinct()
    return df.join(there, df[primary] == F.col("__n"), "left").withColumn("source", F.when(F.col("__n").isNotNull(), F.col(primary)).otherwise(F.col(fallback))).drop("__n")


def write_document(sections: dict[str, DataFrame], path: str) -> None:
    """All sections as one compact JSON document {section: [row, ...]} at a local path, replaced if it is there.

    One document has one writer; rows come to it partition by partition, so the driver never holds a whole section.
    """
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as out:
        for i, (name, df) in enumerate(sections.items()):
            out.write(("," if i else "{") + json.dumps(name) + ":[")
            for k, row in enumerate(df.select(F.to_json(F.struct(*df.columns)).alias("j")).toLocalIterator()):
                out.write(("," if k else "") + row[0])
            out.write("]")
        out.write("}" if sections else "{}")


def read_document(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """Sections of JSON documents {section: [row, ...]}; schemas: section -> its columns. A missing section is empty, a
    document that can't be parsed is an error."""
    doc = spark.read.schema(", ".join(f"`{n}` array<struct<{', '.join(_field(c) for c in s.split(', '))}>>" for n, s in schemas.items())).json(path, multiLine=True, mode="FAILFAST")
    return {n: doc.select(F.explode(n).alias("x")).select("x.*") for n in schemas}


def _field(column: str) -> str:
    name, kind = column.split(" ", 1)
    return f"{name}:{kind}"


def class_images(spark: SparkSession, files: DataFrame, generated: str, real: str) -> DataFrame:
    """(name, path, content): the image of each file (n, is_generated) from the folder of its class; null content where
    there is none."""
    found = read_images(spark, [generated, real])
    at = F.regexp_replace(found["path"], r"^file:/*", "/")
    want = files.select(F.col("n").alias("name"), F.concat(F.when(F.col("is_generated"), generated.rstrip("/") + "/").otherwise(real.rstrip("/") + "/"), F.col("n")).alias("path"))
    return want.join(found.select(at.alias("path"), "content"), "path", "left").select("name", "path", "content")


def write_bundle(sections: dict[str, DataFrame], folder: str) -> None:
    """Each section as compact JSON lines in a folder of its name, replaced if it is there; written by all tasks."""
    for name, df in sections.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")
