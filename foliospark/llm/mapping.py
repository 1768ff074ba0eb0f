"""Mapping free-entered values to a canonical list (p6): BK-tree search under the Levenshtein metric.

Levenshtein distance is a true metric, so the triangle inequality holds: at a node at distance d of the query only the
children whose edge lies within d - t and d + t can hold an entry within t, and every such entry is returned. The list
is broadcast as one tree while it is small; a longer one is cut by hash into shards of bounded size, each searched in
turn by all queries, and the shards' winners are merged by one rule.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.org_names import normal

#: Entries of one broadcast shard.
SHARD_ENTRIES = 50_000
#: Edits within which a value is taken for an entry.
THRESHOLD = 2


def levenshtein(a: str, b: str) -> int:
    """Edit distance by bit-parallel columns (one Python integer per column of the matrix)."""
    if a == b:
        return 0
    if not a or not b:
        return len(a) or len(b)
    peq: dict[str, int] = {}
    for i, c in enumerate(a):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    pv, mv, d = mask, 0, len(a)
    for c in b:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & mask), pv & xh
        d += (1 if ph & last else 0) - (1 if mh & last else 0)
        ph, mh = (ph << 1 | 1) & mask, mh << 1 & mask
        pv, mv = mh | (~(xv | ph) & mask), ph & xv
    return d


class BKTree:
    """Words by their distances; search(word, t) yields every (distance, word) within t."""

    def __init__(self, words: Iterator[str] | list[str]):
        self.root: tuple[str, dict] | None = None
        for w in words:
            self.add(w)

    def add(self, word: str) -> None:
        if self.root is None:
            self.root = (word, {})
            return
        node = self.root
        while True:
            d = levenshtein(word, node[0])
            if not d:
                return
            child = node[1].get(d)
            if child is None:
                node[1][d] = (word, {})
                return
            node = child

    def search(self, word: str, t: int) -> Iterator[tuple[int, str]]:
        stack = [self.root] if self.root else []
        while stack:
            w, children = stack.pop()
            d = levenshtein(word, w)
            if d <= t:
                yield d, w
            stack += [c for e, c in children.items() if d - t <= e <= d + t]


def _search_shard(queries: DataFrame, entries: list[tuple], threshold: int) -> DataFrame:
    """(value, kind, d, id): the shard's best entry of each kind for each query; kinds as in map_to_list. Nothing is
    decided here that another shard could decide otherwise."""
    names: dict[str, int] = {}
    shorts: dict[str, list[tuple[str, int]]] = {}
    for i, name, short, city in sorted((e for e in entries if e[0] is not None), key=lambda e: e[0]):
        if name:
            names.setdefault(normal(name).name, i)
        if short:
            shorts.setdefault(short, []).append(((city or "").lower(), i))
    shared = queries.sparkSession.sparkContext.broadcast((names, shorts))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, shorts = shared.value
        tree, short_tree = BKTree([n for n in names if n]), BKTree(shorts)
        seen: dict[str, tuple[int, int] | None] = {}

        def nearest(name: str) -> tuple[int, int] | None:
            if name not in seen:
                found = None
                for t in range(threshold + 1):  # narrow searches prune most
                    found = min(((d, names[w]) for d, w in tree.search(name, t)), default=None)
                    if found:
                        break
                seen[name] = found
            return seen[name]

        for pdf in batches:
            rows = []
            for v in pdf["value"]:
                o = normal(v)
                if o.name and not o.bare and (hit := nearest(o.name)):
                    rows.append((v, 0, *hit))
                for _, w in short_tree.search(o.acronym, 0) if o.acronym else ():
                    for away in (False, True):
                        ids = [i for city, i in shorts[w] if (bool(o.place) and city != o.place) == away]
                        if ids:
                            rows.append((v, 1 + away, 0, min(ids)))
            yield pd.DataFrame(rows, columns=["value", "kind", "d", "id"]).astype({"kind": "int32", "d": "int32", "id": "int64"})

    return queries.mapInPandas(run, "value string, kind int, d int, id bigint")


def map_to_list(values: DataFrame, column: str, entries: DataFrame, threshold: int = THRESHOLD, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """values with inst_id: the entry meant by `column`, or -1 if the list has none within the threshold.

    entries: (inst_id, name, short, city). The candidates of all shards are merged by kind, distance and id, so the answer
    doesn't depend on the shards. Kinds: 0 the name, 1 the acronym, and the place if one is written, 2 the acronym of an
    entry elsewhere. A bare acronym is held against acronyms only. Each distinct value is searched once, spread over all tasks, so a value that
    fills a third of the rows costs one search; the answers come back by a join. Ties go to the smaller id. A null or
    empty value maps to -1, entries without id are ignored, an empty list maps everything to -1. Columns of `values`
    named value, d or id are kept apart from the operator's own.
    """
    spark = values.sparkSession
    listed = entries.select("inst_id", "name", "short", "city").distinct()
    shards = max(1, math.ceil(listed.count() / shard_entries))
    distinct = values.select(F.col(column).alias("value")).filter("value is not null").distinct()
    distinct = distinct.repartition(max(1, spark.sparkContext.defaultParallelism))
    found = None
    for s in range(shards):
        part = listed if shards == 1 else listed.filter(F.pmod(F.xxhash64("inst_id"), F.lit(shards)) == s)
        got = _search_shard(distinct, [tuple(r) for r in part.collect()], threshold)
        found = got if found is None else found.unionByName(got)
    found = found.groupBy("value").agg(F.min(F.struct("kind", "d", "id")).alias("x")).select("value", "x.id")  # a few rows each
    found = found.select(F.col("value").alias("__value"), F.col("id").cast("int").alias("__id"))
    out = values.join(found, values[column] == F.col("__value"), "left")
    return out.select(*[values[c] for c in values.columns if c != "inst_id"], F.coalesce("__id", F.lit(-1)).alias("inst_id"))
