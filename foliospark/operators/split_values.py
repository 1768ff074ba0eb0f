"""Several values packed in one field: a quote-aware finite-state tokenizer.

The scanner walks the special characters of a field and keeps three things: whether it is inside quotes, whether the
next quote is an escape (a doubled quote or a backslash), and the nesting depth of brackets. A delimiter ends a value
only outside quotes and at depth 0. Written lists come in several hands, so what counts as a delimiter is a dialect:

people   ; | tab, line end, spaced slash, comma, `and`, `&`; `Surname, Given` keeps its comma
places   ; | tab, line end, spaced slash, comma; `Department, Institution` and `Institution, City` keep theirs
entries  item markers in counting order ([1] (1) 1. or bullets) if there are any, else | or // or ; or line ends
         that are followed by the beginning of an entry
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.sources.tables import present, safe_key

_WHITE = re.compile(r"\s+")
_MARKER = re.compile(r"^(?:\[\d{1,4}\]|\(\d{1,4}\)|\d{1,4}[.)](?=\s|[^\W\d])|[•·▪◦*‣]|[-–—](?=\s))\s*")
_SPECIAL = re.compile(r'["\\()\[\]{}]|;|\|+|\t|\r\n?|\n|(?<=\s)//?(?=\s)|,|(?<=\s)(?:and|&)(?=\s)')
_BLANKS = re.compile(" *")
_BRACKET = re.compile(r"[()\[\]{}]")
_HARD = frozenset(";\t\n\r")
_OPEN, _CLOSE = "([{", ")]}"


def tokens(text: str, soft: frozenset[str] = frozenset()) -> Iterator[tuple[str, str, bool]]:
    """Yields (value, delimiter that ended it, was it quoted): the finite-state pass over one field.

    soft: delimiters that count besides ; | / tab and line ends. A quote opens an enclosure only at a value's
    beginning; inside it a doubled quote and a backslashed quote stand for one quote. A quote within a value shields
    delimiters up to its partner, and is an ordinary character if it has none; the same holds for brackets, which nest.
    """
    n, at, start = len(text), 0, 0
    partners = _partners(text)
    buf: list[str] = []
    quoted = False
    while True:
        m = _SPECIAL.search(text, at)
        if m is None:
            buf.append(text[start:])
            yield "".join(buf), "", quoted
            return
        s, e, t = m.start(), m.end(), m.group()
        at = e
        if t == '"':
            if not quoted and not _MARKER.sub("", "".join(buf).strip() + text[start:s].strip(), count=1):
                end, inner = _enclosure(text, e)
                if end >= 0:
                    buf, start, at, quoted = [inner], end, end, True
                    continue
            close = text.find('"', e)
            if close > 0 and not quoted:
                at = close + 1
        elif t in _OPEN:
            at = partners.get(s, at - 1) + 1  # the depth is 0 again behind the partner
        elif t == "\\" or t in _CLOSE:
            at = min(n, e + (t == "\\"))
        elif t[0] in "|/" or t[0] in _HARD or t in soft:
            buf.append(text[start:s])
            yield "".join(buf), t, quoted
            buf, start, quoted = [], e, False


def _enclosure(text: str, at: int) -> tuple[int, str]:
    """(position after the closing quote, unescaped inside) of the enclosure whose inside begins at `at`; (-1, '') if it isn't one."""
    out, start = [], at
    while True:
        q = text.find('"', at)
        if q < 0:
            return -1, ""
        if q and text[q - 1] == "\\":
            out += [text[start : q - 1], '"']
            at = start = q + 1
        elif text[q + 1 : q + 2] == '"':
            out += [text[start:q], '"']
            at = start = q + 2
        else:
            after = _BLANKS.match(text, q + 1).end()
            if after < len(text) and text[after] not in ";|,\t\r\n/&" and not text.startswith("and ", after):
                return -1, ""
            out.append(text[start:q])
            return q + 1, "".join(out)


def _partners(text: str) -> dict[int, int]:
    """Position of each bracket's partner, at any depth, in one pass with a stack per kind; brackets without one are left out."""
    out: dict[int, int] = {}
    stacks: dict[str, list[int]] = {c: [] for c in _OPEN}
    for m in _BRACKET.finditer(text):
        i, c = m.start(), m.group()
        if c in _OPEN:
            stacks[c].append(i)
        elif stack := stacks[_OPEN[_CLOSE.index(c)]]:
            at = stack.pop()
            out[at] = i
            for other in stacks.values():  # openers inside a closed pair stay without partner
                while other and other[-1] > at:
                    other.pop()
    return out


def clean(value: str) -> str:
    """A value without outer white space and leading marker, each run of white space one space."""
    return _WHITE.sub(" ", _MARKER.sub("", value.strip(), count=1)).strip()


def _unquoted(value: str) -> str:
    value = clean(value)
    if len(value) > 1 and value[0] == value[-1] == '"' and '"' not in value[1:-1].replace('""', ""):
        value = value[1:-1].replace('""', '"')
    return clean(value)


# --- dialects -------------------------------------------------------------------------------------------------------

_PEOPLE_SOFT, _PLACES_SOFT = frozenset([",", "and", "&"]), frozenset([","])
# Words that make a phrase an organisation, and phrases that name a part of one.
_ORG_WORD = re.compile(
    r"(?i)\b(?:univ\w*|inst\w*|poly\w*|coll\w*|acad\w*|lab\w*|centers?|centre|ctr|tech\w*|school|department|dept|faculty"
    r"|group|hospital|college|research|res|science|sci|arts|design|campus|foundation|company|inc|ltd|gmbh|u|of|de|st|state|med|medical|natl|national)\b"
)
_PART = re.compile(r"(?i)^(?:the\s+)?(?:(?:school|faculty|department|dept\.?|division|div\.?|chair|section|unit|institute for|laborator(?:y|ies) (?:for|of)|lab for)\s+(?:of|for)?\s*.+|[\w/& -]+\s(?:group|team|unit)|(?!national|natl|research)[\w/]+\slab)$")


def _joins_people(left: str, right: str) -> bool:
    """`Surname, Given`: one word, then a given name or initials; two people would each bring two words."""
    return len(left.split()) == 1 and bool(right)


def _joins_places(left: str, right: str) -> bool:
    """`Department, Institution` or `Institution, City`: a part before, or a bare place after."""
    if _PART.match(left) and not _PART.match(right):
        return True
    capitals = sum(c.isupper() for c in right)
    return " " not in right and not _ORG_WORD.search(right) and "." not in right and (len(right) > 6 or capitals == 1 and len(right) > 3)


def _written(text: str, soft: frozenset[str], joins) -> list[str]:
    out: list[str] = []
    held = ""  # an unquoted value that ended with a comma and may take the next one
    for value, by, quoted in tokens(text, soft):
        value = clean(value) if quoted else _unquoted(value)
        if held:
            if value and not quoted and joins(held, value):
                value, held = f"{held}, {value}", ""
                out.append(value)
                continue
            out.append(held)
            held = ""
        if not value:
            continue
        if by == "," and not quoted:
            held = value
        else:
            out.append(value)
    return [*out, held] if held else out


_ENTRY = r"[\"“]?[^\W\d_]\.(?:[ -]?[^\W\d_]\.)*\s+[^\W\d_a-z][^\s,.()]*"
_ENTRY_LINE = re.compile(r"(?<!and)(?<!,)\s*(?:\r\n?|\n)+(?=" + _ENTRY + r"(?:,|\.|\s+\(|\s+and\b))")
_BULLET = re.compile(r"(?:(?<=\s)|^)[•·▪◦‣]\s*")
_FIRST = re.compile(r"\s*(?:(\[)1\]|(\()1\)|1(\.)(?=\s)|[•·▪◦‣])")


def _numbered(text: str, style: str) -> list[str] | None:
    """Values between the markers 1, 2, 3 ... of a style, taken in counting order."""
    cuts, at, k = [], 0, 1
    while True:
        mark = {"[": rf"\[{k}\]", "(": rf"\({k}\)", ".": rf"{k}\.(?=\s)"}[style]
        m = re.compile(rf"(?:(?<=\s)|^){mark}\s*").search(text, at)
        if m is None:
            break
        cuts.append((m.start(), m.end()))
        at, k = m.end(), k + 1
    if not cuts:
        return None
    return [text[: cuts[0][0]], *(text[e:s] for (_, e), (s, _) in zip(cuts, [*cuts[1:], (len(text), 0)]))]


def _entries(text: str) -> list[str]:
    first = _FIRST.match(text)
    if first:
        style = next((g for g in first.groups() if g), "")
        parts = _numbered(text, style) if style else _BULLET.split(text)
        return [v for v in map(_unquoted, parts or []) if v]
    kinds = {"|": 0, "//": 0, ";": 0}
    found = list(tokens(text))
    for (_, by, _), (after, _, _) in zip(found, [*found[1:], ("", "", False)]):
        key = "|" if by.startswith("|") else by
        if key in kinds and not (key == ";" and re.match(r"\s*part\s+[IVX]+\b", after)):
            kinds[key] += 1
    by = next((k for k in ("|", "//", ";") if kinds[k]), "")
    if not by:
        return [v for v in map(_unquoted, _ENTRY_LINE.split(text)) if v]
    out, held = [], ""
    pieces = list(tokens(text))
    for i, (value, ended, quoted) in enumerate(pieces):
        if quoted and not held.strip() and (ended == "" or ended[0] == by[0]):
            out.append(clean(value))
            continue
        held += (f'"{value.replace(chr(34), chr(34) * 2)}"' if quoted else value)
        after = pieces[i + 1][0] if i + 1 < len(pieces) else ""
        if ended == "" or ended[0] == by[0] and len(ended) >= len(by) and not (by == ";" and re.match(r"\s*part\s+[IVX]+\b", after)):
            out.append(_unquoted(held))
            held = ""
        else:
            held += ended
    return [v for v in out if v]


def split_text(text: str | None, dialect: str) -> list[str]:
    """The values of one field in written order; none for null, blank and 'None'."""
    if text is None or text.strip() in ("", "None"):
        return []
    if dialect == "people":
        return _written(text, _PEOPLE_SOFT, _joins_people)
    if dialect == "places":
        return _written(text, _PLACES_SOFT, _joins_places)
    if dialect == "entries":
        return _entries(text)
    raise ValueError(f"unknown dialect {dialect!r}")


def split_values(df: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """One row (key, field, pos, value) per value of the fields; fields: column -> dialect.

    Repeated rows (equal in the key and the fields) count once; a null key stays a key. Null, blank and 'None' fields
    give no row, empty elements no row and no position, an empty table an empty result. Other columns are ignored, so
    their names cannot clash. Texts are taken whole, whatever their length. The work is per row: the one shuffle
    removes repeated rows and combines on the map side, so a hot key costs nothing.
    """
    for dialect in fields.values():
        split_text(None, dialect)
        if dialect not in ("people", "places", "entries"):
            raise ValueError(f"unknown dialect {dialect!r}")
    cols = list(fields)
    k, inner, kind = safe_key(df, key)
    src = df.select(k.alias("k"), *(F.col(c).alias(f"v{i}") for i, c in enumerate(cols))).distinct()
    src = src.filter(F.greatest(*(present(f"v{i}").cast("int") for i in range(len(cols))), F.lit(0)) > 0)
    dialects = list(fields.values())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            keys = pdf["k"].tolist()
            for i, (name, dialect) in enumerate(zip(cols, dialects)):
                for k, text in zip(keys, pdf[f"v{i}"].tolist()):
                    rows += [(k, name, p, v) for p, v in enumerate(split_text(text, dialect), 1)]
            yield pd.DataFrame(rows, columns=["k", "field", "pos", "value"])

    out = src.mapInPandas(run, f"k {inner}, field string, pos int, value string")
    return out.select(F.col("k").cast(kind).alias(key), "field", "pos", "value")
