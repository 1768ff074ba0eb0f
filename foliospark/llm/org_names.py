"""Normal forms of organisation names: abbreviations spelled out, parts and places told apart.

Shared by the resolution of spellings (p2) and the mapping to the institution list (p6).
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

#: Abbreviation or foreign word -> the word it stands for.
ABBREVIATIONS = {
    "inst": "institute", "instit": "institute", "institut": "institute", "instituto": "institute",
    "tech": "technology", "technol": "technology", "tec": "technology",
    "sci": "science", "sciences": "science", "sc": "science",
    "univ": "university", "uni": "university", "u": "university", "universidad": "university", "universite": "university",
    "universitat": "university", "universita": "university", "universidade": "university", "universiteit": "university",
    "natl": "national", "nat'l": "national", "nat": "national",
    "lab": "laboratory", "labs": "laboratory", "laboratories": "laboratory",
    "res": "research", "coll": "college", "med": "medical", "acad": "academy", "ctr": "center", "centre": "center", "cent": "center",
    "comp": "computing", "comput": "computing", "vis": "visual", "st": "state", "poly": "polytechnic", "polytech": "polytechnic",
    "technische": "technical", "technique": "technical", "tecnica": "technical", "dept": "department",
}
#: Words without weight in a name.
STOP = frozenset("of for the and de la du des der & at in".split())
_TYPE_WORDS = frozenset("institute technology science university national laboratory research college medical academy center computing visual state polytechnic technical arts design school".split())
_FOLD = str.maketrans({"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "ß": "ss", "æ": "ae", "Æ": "AE", "’": "'"})
_PART = re.compile(r"^(?:the )?(?:school|faculty|department|dept\.?|division|section|chair) (?:of|for) .+$|^.+ (?:group|team|unit)$|^(?:[\w/]+ )?lab$")
_CAMPUS = re.compile(r"\s+[-–—]\s+(\w[\w' ]*?)\s+campus$|,?\s+(\w+)\s+campus$", re.I)
_PAREN = re.compile(r"\s*\(([^()]*)\)")


def fold(text: str) -> str:
    """Accents off, white space single."""
    plain = unicodedata.normalize("NFKD", text.translate(_FOLD))
    return " ".join("".join(c for c in plain if not unicodedata.combining(c)).split())


@dataclass(frozen=True)
class Org:
    """name: words of the normal form; acronym, place: as written beside it, folded; bare: only an acronym was written."""

    name: str
    acronym: str
    place: str
    bare: bool


def is_acronym(word: str) -> bool:
    """Short, without blank, and with capitals beyond the first letter."""
    return bool(re.fullmatch(r"[A-Za-z]{2,8}", word)) and (sum(c.isupper() for c in word) >= 2) and len(word) <= 6


def words(text: str) -> list[str]:
    out = []
    for w in re.findall(r"[\w']+|&", text.lower()):
        if w in STOP and w != "u":
            continue
        out.append(ABBREVIATIONS.get(w, w))
    return out


def normal(text: str) -> Org:
    """The normal form of one written organisation; department and campus are dropped."""
    t = fold(text)
    acronym = place = ""
    m = _CAMPUS.search(t)
    if m:
        t, place = t[: m.start()], (m[1] or m[2]).lower()
    for inside in _PAREN.findall(t):
        inside = inside.strip()
        if is_acronym(inside):
            acronym = inside
        elif inside:
            place = inside.lower()
    t = _PAREN.sub("", t)
    parts = [p.strip() for p in t.split(",") if p.strip()]
    if len(parts) > 1:
        parts = [p for p in parts if not _PART.match(p.lower())] or parts
    if len(parts) > 1:
        last = words(parts[-1])
        first = words(parts[0])
        if len(last) == 1 and last[0] not in _TYPE_WORDS:
            if first and all(w in _TYPE_WORDS for w in first) and not is_acronym(parts[0]):
                parts = [f"{parts[-1]} {parts[0]}"]  # `Inst. of Technology, Place`
            else:
                place, parts = last[0], parts[:-1]
    t = " ".join(parts)
    if is_acronym(t):
        return Org("", t, place, True)
    w = words(t)
    if w and w[0] == "technology" and len(w) > 1 and w[1] == "university":
        w[0] = "technical"
    if len(w) > 1 and w[0] == "tu":
        w = ["technical", "university", *w[1:]]
    if len(w) == 2 and w[1] == "technology":
        w = [w[0], "institute", "technology"]
    return Org(" ".join(w), acronym, place, False)
