"""Column builders for text: cleaning, fallbacks, keys in names, rule flags."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.column import Column


def strip(c: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def filled(c: Column, none_word: bool = False) -> Column:
    """Stripped text, '' for null; with none_word also for 'None'."""
    t = F.coalesce(strip(c), F.lit(""))
    return F.when(t == "None", "").otherwise(t) if none_word else t


def excerpt(c: Column, n: int) -> Column:
    """The first n characters of the stripped text, '' for null and 'None'."""
    return F.substring(filled(c, True), 1, n)


def without_assignment(c: Column) -> Column:
    """A cited title without a leading `s12 = "` and without quotes at its ends; null stays null."""
    return F.regexp_replace(strip(F.regexp_replace(strip(c), r'^s\d+\s*=\s*"?', "")), r'^"+|"+$', "")


def number_in(c: Column) -> Column:
    """All digits of a text as one number, 0 without any."""
    return F.coalesce(F.nullif(F.regexp_replace(c, r"[^0-9]", ""), F.lit("")).try_cast("bigint"), F.lit(0).cast("bigint"))


def first_filled(*cols: Column) -> Column:
    """The first text that is not null, '' or 'None'."""
    return F.coalesce(*(F.when(~c.isin("", "None"), c) for c in cols))


def extension_to(c: Column, old: str, new: str) -> Column:
    return F.regexp_replace(c, rf"(?i)\.{old}$", f".{new}")


def stem(c: Column) -> Column:
    return F.regexp_replace(c, r"\.[^.]+$", "")


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


# Fixed values, here and in paper_flags: the patterns of clock times and titles, and the words of the flags.
def time_key(name: Column) -> Column:
    """The clock-like part of a map's file name, else the name without `map`, else 'Unknown time'."""
    rest = F.regexp_replace(stem(name), r"(?i)^map[_\-\s]*", "")
    clock = F.regexp_extract(rest, r"(?i)(\d{1,2}(?::\d{2})?\s*(?:am|pm)?|\d{3,4})", 1)
    key = F.trim(F.regexp_replace(F.when(clock != "", clock).otherwise(rest), r"[_-]+", " "))
    return F.when(key == "", "Unknown time").otherwise(key)


def leading_number(c: Column) -> Column:
    """The number a text begins with, null without one."""
    return F.nullif(F.regexp_extract(c, r"^\s*([+-]?\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double")


def paper_flags(title: Column, struct: Column, refs: Column) -> Column:
    """Defects of a paper in fixed order, each once."""
    s = F.lower(F.coalesce(struct, F.lit("")))
    missing = s.contains("missing")
    no_refs = F.lit("no references")
    return F.array_distinct(
        F.array_compact(
            F.array(
                F.when(F.coalesce(title, F.lit("")).isin("", "None"), "no title"),
                F.when(missing & s.contains("affil"), "no affiliations"),
                F.when(missing & s.contains("ref"), no_refs),
                F.when(F.coalesce(refs, F.lit("")) == "", no_refs),
            )
        )
    )
