"""Variant spellings of people and organisations (p2): merge-and-rematch entity resolution.

A profile begins as one form (a surname, or the normal form of an organisation) with the marks that were written with
it: initials of given names, and how often. Profiles meet in blocks: the keys of a profile are hashes of all its forms
and of those with one character left out, so forms of any length that are one edit or one transposition apart always
share a block, and so do two that are a left-out character each from a third. In each block the other profiles are held
against the richest one only; no block is paired out. A match merges the poorer profile into the richer one: forms are
united, marks added up. Merged profiles enter their blocks again, until a round merges nothing. Any of a profile's forms
can bring it together with any of another's, so the order and the weights decide only which form names the result.

Two profiles stay apart if the poorer one has a life of its own: more than a few initials under which it is written at
least half as often as the richer one. A misspelling is always rare beside the right spelling with the same initial,
however many initials it is met with, and this holds at every size of the data.

People are then (surname profile, first initial): nicknames take the initial of the name they stand for, learned from
spellings that give both, and among several initials the one under which the surname is known best.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.org_names import fold, normal
from foliospark.sources.tables import checkpointed, restarted

#: A profile with more own initials than this is a surname of its own; in a form of under SHORT characters, where one
#: character is much of a name, with any.
OWN_INITIALS, SHORT = 3, 4
#: An initial is a profile's own if it is written with it more than this many times as often as with the richer one.
OWN_SHARE = 0.5
_TITLE = re.compile(r"^(?:dr|prof|mr|mrs|ms|sir|phd)\.?\s+", re.I)
_NICK = re.compile(r"[\"“(]\s*([^\"”()]+?)\s*[\"”)]")
_INITIAL = re.compile(r"^(?:[^\W\d_]\.?(?:-?[^\W\d_]\.)*|[^\W\d_])$")
# Common nicknames whose initial differs from the name's, for archives too small to teach them.
NICKNAMES = {
    "bob": "r", "rob": "r", "bill": "w", "will": "w", "dick": "r", "rick": "r", "ned": "e", "ted": "et", "ed": "e", "beth": "e", "liz": "e",
    "betty": "e", "tina": "c", "kate": "k", "bella": "i", "izzy": "i", "penny": "p", "sasha": "a", "dima": "d", "peggy": "m", "maggie": "m",
    "jack": "j", "hank": "h", "harry": "h", "nan": "a", "polly": "m", "tony": "a", "gene": "e", "drew": "a", "andy": "a", "sandy": "a", "nell": "e",
}


def parse_person(text: str) -> tuple[list[str], str, bool]:
    """(words of the name, nickname or '', was it `Surname, Given`), folded and in lower case, without title."""
    t = fold(text).lower()
    t = _TITLE.sub("", t)
    m = _NICK.search(t)
    nick = m[1] if m else ""
    t = _NICK.sub(" ", t)
    comma = "," in t
    if comma:
        last, _, first = t.partition(",")
        return [*first.split(), last.strip()], nick, True
    return t.split(), nick, False


def _people(values: DataFrame) -> DataFrame:
    """(value, n, a, b, sure, nick): the outer words of a name, b the surname if `sure`; a may be initials."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for v, n in zip(pdf["value"], pdf["n"]):
                w, nick, comma = parse_person(v)
                if not w:
                    continue
                a, b = w[0], w[-1]
                if len(w) == 1:
                    a = ""
                lead = bool(_INITIAL.match(a)) and len(a.replace(".", "")) <= 3 and ("." in a or len(a) == 1)
                tail = len(w) > 1 and bool(_INITIAL.match(b)) and ("." in b or len(b) == 1)
                sure = comma or lead or len(w) > 2 or not a
                if tail and not comma and not lead:
                    a, b, sure = b, w[0], True  # `Surname G.`
                rows.append((v, n, a.strip("."), b.strip(".,"), sure, nick))
            yield pd.DataFrame(rows, columns=["value", "n", "a", "b", "sure", "nick"])

    return values.mapInPandas(run, "value string, n bigint, a string, b string, sure boolean, nick string")


def _oriented(people: DataFrame) -> DataFrame:
    """(value, n, given, surname, nick): `Surname Given` without comma is turned round by how its words are used elsewhere."""
    use = people.select("n", "sure", F.explode(F.array(F.struct(F.col("a").alias("w"), F.lit(1).alias("g")), F.struct(F.col("b").alias("w"), F.lit(0).alias("g")))).alias("x"))
    # the share of a word's uses as a given name, over all spellings
    use = use.filter("x.w <> ''").groupBy("x.w").agg(F.sum(F.col("x.g") * F.col("n")).alias("given"), F.sum((1 - F.col("x.g")) * F.col("n")).alias("sur"))
    lean = use.select("w", F.log((F.col("given") + 0.5) / (F.col("sur") + 0.5)).alias("lean"))
    open_ = people.filter("not sure")
    la, lb = lean.select(F.col("w").alias("a"), F.col("lean").alias("la")), lean.select(F.col("w").alias("b"), F.col("lean").alias("lb"))
    turned = open_.join(la, "a", "left").join(lb, "b", "left").withColumn("turn", F.coalesce("la", F.lit(0.0)) < F.coalesce("lb", F.lit(0.0)))
    pick = lambda x, y: F.when(F.col("turn"), F.col(x)).otherwise(F.col(y))
    out = turned.select("value", "n", pick("b", "a").alias("given"), pick("a", "b").alias("surname"), "nick")
    return out.unionByName(people.filter("sure").select("value", "n", F.col("a").alias("given"), F.col("b").alias("surname"), "nick"))


def left_out_keys(form: str) -> np.ndarray:
    """Hashes of a form and of all forms with one of its characters left out, in time linear in its length: polynomial
    hashes of what is before and after each character, under two primes."""
    c = np.frombuffer(form.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64) + np.uint64(1)
    n, keys = len(c), np.zeros(len(c) + 1, np.uint64)
    for prime, base in ((2147483647, 911382323), (2147483629, 972663749)):
        power, before = [1] * (n + 1), [0] * (n + 1)
        for i, x in enumerate(c.tolist()):
            power[i + 1] = power[i] * base % prime
            before[i + 1] = (before[i] * base + x) % prime
        pw, be, m = np.array(power, np.uint64), np.array(before, np.uint64), np.uint64(prime)
        after = (be[n] + m - be[1:] * pw[:n][::-1] % m) % m  # of the characters behind i
        out = (be[:n] * pw[:n][::-1] + after) % m
        keys = keys * np.uint64(1 << 31) + np.append(out, be[n])
    return np.unique(keys.astype(np.int64))


def merge_and_rematch(forms: DataFrame, own: int = OWN_INITIALS) -> DataFrame:
    """(form, entity): every form with the form that names the profile it ended in, its richest.

    forms: (form, marks), one row per form, marks being array<struct<m string, w bigint>>, each m once; optionally
    `listed`: two listed profiles never merge. Instead of marks there may be (weight, breadth): as many marks of equal
    weight. Richer means listed, then more marks, then more weight; ties go by row. Empty input gives an empty result; null
    and empty forms are ignored. Each round is written to the checkpoint folder, which cuts the lineage of the loop;
    what goes on to the next round also begins its size estimate anew.
    """
    if "marks" not in forms.columns:
        each = F.greatest(F.lit(1), (F.col("weight") / F.col("breadth")).cast("bigint"))
        forms = forms.withColumn("marks", F.transform(F.sequence(F.lit(1), F.col("breadth")), lambda i: F.struct(i.cast("string").alias("m"), each.alias("w"))))
    listed = F.col("listed") if "listed" in forms.columns else F.lit(False)
    base = forms.filter("form is not null and form <> ''").select("form", "marks", listed.alias("listed"))
    base = checkpointed(base.withColumn("fid", F.monotonically_increasing_id()))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys = [left_out_keys(f) for f in pdf["form"]]
            sizes = [len(k) for k in keys]
            short = [len(f) < SHORT for f in pdf["form"]]
            yield pd.DataFrame({"fid": np.repeat(pdf["fid"].to_numpy(), sizes), "short": np.repeat(short, sizes), "key": np.concatenate([np.zeros(0, np.int64), *keys])})

    keys = base.select("fid", "form").mapInPandas(spread, "fid bigint, short boolean, key bigint")
    shared = keys.groupBy("key").agg(F.count("*").alias("k")).filter("k > 1").select("key")  # most keys are one form's
    keys = checkpointed(keys.join(shared, "key", "left_semi"))
    state = base.select("fid", F.col("fid").alias("eid"))
    marks = base.select("fid", "listed", F.explode("marks").alias("x")).select("fid", "listed", "x.m", "x.w")
    changed = None
    while True:
        prof = marks.join(state, "fid").groupBy("eid", "m").agg(F.sum("w").alias("w"), F.max("listed").alias("listed"))
        prof = prof.groupBy("eid").agg(F.count("*").alias("breadth"), F.sum("w").alias("weight"), F.max("listed").alias("listed"), F.map_from_entries(F.collect_list(F.struct("m", "w"))).alias("marks"))  # an alphabet at most
        prof = checkpointed(prof)
        met = keys.join(state, "fid").groupBy("key", "eid").agg(F.min("short").alias("short"))
        if changed is not None:  # only blocks with a profile that grew can bring anything new
            met = met.join(met.join(changed, "eid", "left_semi").select("key").distinct(), "key", "left_semi")
        met = checkpointed(met.join(prof.select("eid", F.struct("listed", "breadth", "weight", "eid").alias("rich")), "eid"))
        top = met.groupBy("key").agg(F.max("rich").alias("top"), F.count("*").alias("k")).filter("k > 1").drop("k")
        near = met.join(top, "key").filter("eid <> top.eid").groupBy("eid", "top").agg(F.min("short").alias("short"))
        a = prof.select("eid", F.col("marks").alias("mine"), F.col("listed").alias("listed_a"))
        b = prof.select(F.col("eid").alias("pid"), F.col("marks").alias("theirs"), F.col("listed").alias("listed_b"))
        near = near.withColumn("pid", F.col("top.eid")).join(a, "eid").join(b, "pid")
        alone = F.size(F.filter(F.map_entries("mine"), lambda x: x["value"] > OWN_SHARE * F.coalesce(F.try_element_at("theirs", x["key"]), F.lit(0))))
        same = (alone <= F.when(F.col("short"), 0).otherwise(own)) & ~(F.col("listed_a") & F.col("listed_b"))
        link = near.filter(same).groupBy("eid").agg(F.max("top").alias("top")).select(F.col("eid").alias("child"), F.col("top.eid").alias("parent"))
        link = checkpointed(link)
        if not link.head(1):
            best = base.join(state, "fid").select("form", "eid", F.struct("listed", F.size("marks"), F.aggregate("marks", F.lit(0).cast("bigint"), lambda t, x: t + x["w"]), "form").alias("rich"))
            named = best.groupBy("eid").agg(F.max("rich").alias("rich")).select("eid", F.col("rich.form").alias("entity"))
            return checkpointed(best.join(named, "eid").select("form", "entity"))
        # a parent that is itself merged in this round hands its children on; richer is a strict order, so there is no circle
        while True:
            up = link.select(F.col("child").alias("parent"), F.col("parent").alias("upper"))
            step = restarted(link.join(up, "parent", "left").select("child", F.coalesce("upper", "parent").alias("parent"), F.col("upper").isNotNull().alias("moved")))
            link = step.drop("moved")
            if not step.filter("moved").head(1):
                break
        changed = link.select(F.col("parent").alias("eid")).distinct()
        state = restarted(state.join(link, state["eid"] == link["child"], "left").select("fid", F.coalesce("parent", "eid").alias("eid")))


def author_entities(values: DataFrame) -> DataFrame:
    """(value, entity) of the spellings of people; values: (value, n)."""
    people = checkpointed(_oriented(_people(values)))
    # nickname -> initial of the name beside it
    taught = people.filter("nick <> '' and given <> ''").groupBy(F.col("nick").alias("given"), F.substring("given", 1, 1).alias("i")).agg(F.sum("n").alias("w"))
    fixed = people.sparkSession.createDataFrame([(k, c, 1) for k, v in NICKNAMES.items() for c in v], "given string, i string, w bigint")
    nicks = taught.unionByName(fixed).groupBy("given", "i").agg(F.sum("w").alias("w"))
    cand = checkpointed(people.join(nicks, "given", "left").select("value", "n", "surname", F.coalesce("i", F.substring("given", 1, 1)).alias("i"), F.coalesce("w", F.lit(0)).alias("w")))
    initials = cand.filter("i is not null").groupBy(F.col("surname").alias("form"), "i").agg(F.sum("n").alias("w"))
    forms = initials.groupBy("form").agg(F.collect_list(F.struct(F.col("i").alias("m"), "w")).alias("marks"))  # an alphabet at most
    ent = merge_and_rematch(forms)
    known = cand.join(ent, cand["surname"] == ent["form"]).select("value", "n", "entity", "i", "w")
    # a nickname of several names goes to the one under which the merged surname is known best
    known = checkpointed(known.withColumn("k", F.count("*").over(Window.partitionBy("value"))))
    support = known.filter("k = 1").groupBy("entity", "i").agg(F.sum("n").alias("s"))
    known = known.join(support, ["entity", "i"], "left")
    best = known.groupBy("value").agg(F.max_by(F.struct("entity", "i"), F.struct(F.coalesce("s", F.lit(0)), "w", "i")).alias("x"))
    return best.select("value", F.concat_ws("|", "x.entity", "x.i").alias("entity"))


def org_entities(values: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """(value, entity) of the spellings of organisations; values: (value, n); entries: a list (name, short) whose rows
    are profiles like any other, rich from the start."""
    seed = None if entries is None else entries.select(F.col("name").alias("value"), F.lit(0).cast("bigint").alias("n"), F.coalesce("short", F.lit("")).alias("short"))
    rows = values.select("value", "n", F.lit("").alias("short"))
    rows = rows if seed is None else rows.unionByName(seed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for v, n, short in zip(pdf["value"], pdf["n"], pdf["short"]):
                o = normal(v)
                out.append((v, n, o.name, short or o.acronym, o.bare))
            yield pd.DataFrame(out, columns=["value", "n", "form", "acronym", "bare"])

    orgs = checkpointed(rows.filter("value is not null").mapInPandas(run, "value string, n bigint, form string, acronym string, bare boolean"))
    # one mark for what is written, one more for the entries of the list, which makes them rich
    forms = orgs.filter("form <> ''").groupBy("form").agg(F.sum("n").alias("n"), F.max(F.col("n") == 0).alias("listed"))
    written = F.struct(F.lit("written").alias("m"), F.greatest(F.col("n"), F.lit(1)).alias("w"))
    forms = forms.select("form", "listed", F.when(F.col("listed"), F.array(written, F.struct(F.lit("listed").alias("m"), F.lit(1).cast("bigint").alias("w")))).otherwise(F.array(written)).alias("marks"))
    ent = merge_and_rematch(forms)
    named = checkpointed(orgs.filter("form <> ''").join(ent, "form").select("value", "n", "acronym", "entity"))
    # an acronym written beside a name joins that profile; alone it stands for the profile that it was written with most
    teach = named.filter("acronym <> ''").groupBy("acronym", "entity").agg(F.sum(F.col("n") + 1000 * (F.col("n") == 0).cast("int")).alias("w"))
    teach = teach.groupBy("acronym").agg(F.max_by("entity", F.struct("w", "entity")).alias("entity"))
    alone = orgs.filter("bare").join(teach, "acronym", "left").select("value", F.coalesce("entity", F.concat(F.lit("acronym "), "acronym")).alias("entity"))
    return named.filter("n > 0").select("value", "entity").unionByName(alone).distinct()


def same_pairs(entities: DataFrame, kind: str, per_task: int = 2_000) -> DataFrame:
    """(kind, name_a, name_b): every pair of different spellings of one entity, name_a first by code points.

    entities, (value, entity), is the result of the resolution; the pairs are its expansion. An entity with more than
    per_task spellings is cut into salts of about as many, so no task gets all pairs of one.
    """
    entities = checkpointed(entities)
    sizes = entities.groupBy("entity").agg(F.ceil(F.count("*") / per_task).alias("salts"))
    salted = checkpointed(entities.join(sizes, "entity"))
    a = salted.select("entity", F.pmod(F.xxhash64("value"), "salts").alias("salt"), F.col("value").alias("name_a"))
    b = salted.select("entity", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt"), F.col("value").alias("name_b"))
    return a.join(b, ["entity", "salt"]).filter("name_a < name_b").select(F.lit(kind).alias("kind"), "name_a", "name_b")
