"""Queries of the llm operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm.chunking import split_items
from foliospark.llm.mapping import map_to_list
from foliospark.llm.mixing import memberships, mix, reached
from foliospark.llm.names import author_entities, org_entities, same_pairs
from foliospark.llm.neighbours import nearest
from foliospark.llm.packing import pack
from foliospark.llm.scans import mend, repaired_texts, repairs
from foliospark.llm.tokens import sized
from foliospark.operators.split_values import split_values
from foliospark.sources.tables import checkpointed, load


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of spellings in papers.authors and papers.aff that mean the same person or organisation."""
    papers = load(spark, d, "papers").select("f", "authors", "aff")
    values = split_values(papers, "f", {"authors": "people", "aff": "places"})
    values = checkpointed(values.groupBy("field", "value").agg(F.count("*").alias("n")))
    authors = author_entities(values.filter("field = 'authors'").select("value", "n"))
    orgs = org_entities(values.filter("field = 'aff'").select("value", "n"), load(spark, d, "institutions").select("name", "short"))
    return same_pairs(authors, "author").unionByName(same_pairs(orgs, "aff"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every repair of scanned titles, abstracts and references."""
    return repairs(load(spark, d, "papers").select("f", "title", "abstract", "refs"), "f", ["title", "abstract", "refs"])


def p3_text(spark: SparkSession, d: str) -> DataFrame:
    """The whole repaired text of every title, abstract and list of references: (f, field, text)."""
    return repaired_texts(load(spark, d, "papers").select("f", "title", "abstract", "refs"), "f", ["title", "abstract", "refs"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of figures of which one is among the 8 nearest of the other."""
    near = nearest(load(spark, d, "figures").select("id", "x", "y", "z"), "id", ["x", "y", "z"], 8)
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Every organisation written in papers.aff with its entry of institutions, or -1."""
    papers = load(spark, d, "papers").select("f", "aff")
    values = checkpointed(split_values(papers, "f", {"aff": "places"}).select("f", "pos", "value").distinct())
    return map_to_list(values, "value", load(spark, d, "institutions")).select("f", "pos", "inst_id")


def _packed(spark: SparkSession, d: str) -> DataFrame:
    limits = [r[0] for r in load(spark, d, "budgets").filter("task = 'pack'").select("size_limit").distinct().orderBy("size_limit").collect()]
    items = checkpointed(sized(load(spark, d, "documents").select("doc_id", "text"), "doc_id", "text"))
    out = None
    for limit in limits:
        one = pack(items, limit).select(F.lit(limit).alias("size_limit"), F.col("id").alias("doc_id"), "piece", "container", "slot", "first_token", F.col("n").alias("n_tokens"))
        out = one if out is None else out.unionByName(one)
    return out


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every document in a container of each pack size: (size_limit, doc_id, piece, container, slot, first_token, n_tokens)."""
    return _packed(spark, d)


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Per pack size the containers, the tokens in them and the share of their room that is used."""
    return _packed(spark, d).groupBy("size_limit").agg(F.count_distinct("container").alias("containers"), F.sum("n_tokens").alias("tokens")).withColumn("fill", F.col("tokens") / F.col("containers") / F.col("size_limit"))


def _mixed(spark: SparkSession, d: str, trust_labels: bool = True) -> tuple[DataFrame, DataFrame]:
    targets = load(spark, d, "mix_targets")
    domains = [r[0] for r in targets.select("source").distinct().orderBy("source").collect()]
    docs = load(spark, d, "documents").select("doc_id", "text", "source")
    members = memberships(docs, "doc_id", "text", "source", domains, trust_labels=trust_labels)
    return mix(members, targets), targets


def p8_mixed(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mixture: (doc_id, source, n_tokens, repeats)."""
    return _mixed(spark, d)[0].select(F.col("id").alias("doc_id"), "source", F.col("n").alias("n_tokens"), "repeats")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Per source its target share and the share reached by the mixture."""
    return reached(*_mixed(spark, d))


def p8_soft_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares of a mixture that knows sources only by the classifier, held against the written sources."""
    return reached(*_mixed(spark, d, trust_labels=False))


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of the documents longer than each split size."""
    sizes = [(r[0], r[1] or 0) for r in load(spark, d, "budgets").filter("task = 'split'").select("size_limit", "overlap").distinct().orderBy("size_limit").collect()]
    return split_items(load(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", sizes).withColumnRenamed("id", "doc_id")


# --- properties that any right result has, checked by SQL ------------------------------------------------------------


def p2_checks(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of equal or misordered spellings, pairs of which one spelling has more partners than the other, which a group
    can't have, and spellings in pairs that no paper has."""
    pairs = checkpointed(p2_found(spark, d))
    ends = pairs.select("kind", F.explode(F.array("name_a", "name_b")).alias("name"))
    partners = checkpointed(ends.groupBy("kind", "name").agg(F.count("*").alias("k")))
    both = pairs.join(partners.select("kind", F.col("name").alias("name_a"), F.col("k").alias("a")), ["kind", "name_a"]).join(partners.select("kind", F.col("name").alias("name_b"), F.col("k").alias("b")), ["kind", "name_b"])
    values = split_values(load(spark, d, "papers").select("f", "authors", "aff"), "f", {"authors": "people", "aff": "places"})
    there = values.select(F.when(F.col("field") == "authors", "author").otherwise("aff").alias("kind"), F.col("value").alias("name")).distinct()
    unknown = partners.join(there, ["kind", "name"], "left_anti").agg(F.count("*").alias("unknown"))
    return both.agg(F.count_if(F.col("name_a") >= F.col("name_b")).alias("misordered"), F.count_if(F.col("a") != F.col("b")).alias("unequal")).crossJoin(unknown)  # single rows


def p3_checks(spark: SparkSession, d: str) -> DataFrame:
    """Repaired words that their repaired text hasn't, repairs of fields without text, and texts with a break of a word left."""
    texts, made = mend(load(spark, d, "papers").select("f", "title", "abstract", "refs"), "f", ["title", "abstract", "refs"])
    both = made.join(texts, ["f", "field"], "left").agg(F.count_if(F.col("text").isNull()).alias("lost"), F.count_if(~F.contains("text", "repaired")).alias("missing"))
    return both.crossJoin(texts.agg(F.count_if(F.col("text").rlike("[\u00ac\u00ad][\r\n]")).alias("broken")))  # two single rows


def p5_checks(spark: SparkSession, d: str) -> DataFrame:
    """Figures with a point, those that come with fewer than 8 others, pairs out of order, and pairs with unknown ids."""
    good = load(spark, d, "figures").select("id", "x", "y", "z").filter("id is not null and x is not null and y is not null and z is not null and not isnan(x) and not isnan(y) and not isnan(z)").select("id").distinct()
    pairs = p5_found(spark, d)
    ends = pairs.select(F.explode(F.array("id_a", "id_b")).alias("id"), (F.col("id_a") >= F.col("id_b")).alias("odd"))
    n = ends.groupBy("id").agg(F.count("*").alias("k"), F.count_if("odd").alias("odd"))
    both = good.withColumn("known", F.lit(True)).join(n, "id", "full_outer")
    return both.agg(F.count_if("known").alias("figures"), F.count_if(F.col("known") & (F.coalesce("k", F.lit(0)) < 8)).alias("short"), F.coalesce(F.sum("odd"), F.lit(0)).alias("odd"), F.count_if(F.col("known").isNull()).alias("unknown"))


def p6_checks(spark: SparkSession, d: str) -> DataFrame:
    """Values of papers.aff that are an entry's name letter for letter and got another one, and ids that are no entry."""
    papers = load(spark, d, "papers").select("f", "aff")
    values = checkpointed(split_values(papers, "f", {"aff": "places"}).select("f", "pos", "value").distinct())
    entries = load(spark, d, "institutions")
    got = map_to_list(values, "value", entries)
    named = entries.groupBy(F.col("name").alias("value")).agg(F.collect_set("inst_id").alias("ids"))
    known = entries.select(F.col("inst_id"), F.lit(True).alias("known")).distinct()
    both = got.join(named, "value", "left").join(known, "inst_id", "left")
    return both.agg(F.count_if(F.col("ids").isNotNull() & ~F.array_contains("ids", F.col("inst_id"))).alias("wrong"), F.count_if((F.col("inst_id") != -1) & F.col("known").isNull()).alias("unknown"))


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per pack size the documents placed, containers above it, documents divided without need, places taken twice, and
    whether less than 98 % of the room is used."""
    rows = checkpointed(_packed(spark, d))
    room = rows.filter("container is not null").groupBy("size_limit", "container").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("k"), F.count_distinct("slot").alias("slots"))
    room = room.groupBy("size_limit").agg(F.count_if(F.col("n") > F.col("size_limit")).alias("overfull"), F.count_if(F.col("k") != F.col("slots")).alias("twice"), (F.sum("n") < 0.98 * F.count("*") * F.first("size_limit")).alias("loose"))
    docs = rows.groupBy("size_limit", "doc_id").agg(F.count("*").alias("k"), F.sum("n_tokens").alias("n"))
    docs = docs.groupBy("size_limit").agg(F.count("*").alias("documents"), F.count_if((F.col("k") > 1) & (F.col("n") <= F.col("size_limit"))).alias("divided"))
    return docs.join(room, "size_limit").select("size_limit", "documents", "overfull", "divided", "twice", "loose")


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """Documents used more often than their source allows or without being of a target, and targets with documents whose
    share differs by more than 2 % of itself from what it is among those."""
    mixed, targets = _mixed(spark, d)
    mixed = checkpointed(mixed)
    caps = targets.select("source", "max_repeats").distinct()
    used = mixed.join(F.broadcast(caps), "source", "left")
    shares = reached(mixed, targets).filter("target_share is not null and tokens > 0")
    total = shares.agg(F.sum("target_share").alias("all"))
    off = shares.crossJoin(F.broadcast(total)).agg(F.count_if(F.abs(F.col("reached_share") * F.col("all") / F.col("target_share") - 1) > 0.02).alias("off"))  # one row
    return used.agg(F.count_if(F.col("repeats") > F.col("max_repeats")).alias("too_often"), F.count_if(F.col("max_repeats").isNull()).alias("outside"), (F.count("*") - F.count_distinct("id")).alias("twice")).crossJoin(off)  # single rows


def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per split size the pieces above it, gaps between pieces, and texts not covered from their first to their last character."""
    pieces = p9_pieces(spark, d).select("size_limit", "doc_id", "piece", "start_char", "end_char", "n_tokens")
    w = Window.partitionBy("size_limit", "doc_id").orderBy("piece")  # the pieces of one text
    rows = pieces.withColumn("gap", F.col("start_char") > F.lag("end_char").over(w))
    texts = rows.groupBy("size_limit", "doc_id").agg(F.count_if(F.col("n_tokens") > F.col("size_limit")).alias("over"), F.count_if("gap").alias("gaps"), F.min("start_char").alias("a"), F.max("end_char").alias("b"))
    lengths = load(spark, d, "documents").select("doc_id", F.length("text").alias("n"))
    some = texts.join(lengths, "doc_id").groupBy("size_limit").agg(F.sum("over").alias("over"), F.sum("gaps").alias("gaps"), F.count_if((F.col("a") != 0) | (F.col("b") != F.col("n"))).alias("uncovered"))
    sizes = load(spark, d, "budgets").filter("task = 'split'").select("size_limit").distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return sizes.join(some, "size_limit", "left").select("size_limit", zero("over"), zero("gaps"), zero("uncovered"))


QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p3_text": p3_text, "p5_found": p5_found, "p6_found": p6_found, "p7_packed": p7_packed, "p7_fill": p7_fill, "p8_mixed": p8_mixed, "p8_shares": p8_shares, "p8_soft_shares": p8_soft_shares, "p9_pieces": p9_pieces, "p2_checks": p2_checks, "p3_checks": p3_checks, "p5_checks": p5_checks, "p6_checks": p6_checks, "p7_checks": p7_checks, "p8_checks": p8_checks, "p9_checks": p9_checks}
SQL: dict[str, str] = {
    "p2_checks": "SELECT 0 AS misordered, 0 AS unequal, 0 AS unknown",
    "p3_checks": "SELECT 0 AS lost, 0 AS missing, 0 AS broken",
    "p5_checks": "SELECT count(DISTINCT id) AS figures, 0 AS short, 0 AS odd, 0 AS unknown FROM figures WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) AND NOT isnan(z)",
    "p6_checks": "SELECT 0 AS wrong, 0 AS unknown",
    "p7_checks": "SELECT DISTINCT size_limit, (SELECT count(*) FROM documents) AS documents, 0 AS overfull, 0 AS divided, 0 AS twice, false AS loose FROM budgets WHERE task = 'pack'",
    "p8_checks": "SELECT 0 AS too_often, 0 AS outside, 0 AS twice, 0 AS off",
    "p9_checks": "SELECT DISTINCT size_limit, 0 AS over, 0 AS gaps, 0 AS uncovered FROM budgets WHERE task = 'split'",
}
