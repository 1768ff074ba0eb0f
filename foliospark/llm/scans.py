"""Repair of text from scanned pages (p3).

Lines: a boosted classifier over pairs of neighbouring lines tells body lines from running headers and page numbers,
another tells a word broken at a line end from other line ends. They are trained on pages made here: clean texts are
wrapped, broken and furnished, so the labels are known. How many papers share a line's shape is counted over all papers.

Words: each word of the corpus asks for candidates through an inverted join of character trigrams; its rarest trigrams
suffice, since two misread places cannot touch them all. Which characters are taken for which is learned from the
corpus: every rare word is aligned with its commonest near candidate, and the pairs of differing strings are counted. A
boosted ranker, trained on words of the corpus that are corrupted with the learned confusions and with random ones,
scores the candidates; the best one replaces the word if its score is positive.

Text: `mend` gives the whole repaired texts and the list of the repairs, both of one pass.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.boost import BoostedTrees
from foliospark.llm.mapping import levenshtein
from foliospark.operators.split_values import _ENTRY_LINE
from foliospark.sources.tables import checkpointed, present, safe_key

#: Bounds of the training samples: texts for the line models, words for the ranker.
SAMPLE_TEXTS, SAMPLE_WORDS = 900, 1500
#: A shape counts as known if at least this share of the papers has it, so at most lines-per-paper / share are.
SHAPE_SHARE = 1e-4
#: A candidate must be in so many times the papers that the word is in.
RATIO = 6
#: Edits between a misread word and its candidates.
EDITS = 3
#: Corrections up to this number are broadcast, more are joined by shuffle.
MAX_BROADCAST = 300_000
MARKS = "-‐­¬"

#: A confusion is supported if so many words show it, and this share of all aligned words; so 1 / share are at most.
SUPPORTED, SUPPORT_SHARE = 1, 1e-4
#: What random misreadings put in: anything that a scanner may see for a letter.
NOISE = "abcdefghijklmnopqrstuvwxyz0123456789!|$@&/\\<>(){}[]+=*%#~^éíñüßøæ†£€¥"
#: Described words that a process keeps.
KEPT, KEPT_LENGTH = 400_000, 64
_LEAD, _TAIL = re.compile(r"^(?:\[\d+\]|\(\d+\))?[\"'“‘(\[{•]*"), re.compile(r"[\"'”’)\]},.;:?]*$")
_SPACE = re.compile(r"(\s+|[;|]+(?=\S))")
_ITEM = re.compile(r"\[\d{1,3}\]|\(\d{1,3}\)|\d{1,3}\.\s|[•·▪◦‣]")
_NUMBER_FOLLOWS = re.compile(r"\b(?:vol|pp?|no)\.$", re.I)
_ROMAN = re.compile(r"^[ivxlc]+$")
_PAGE = re.compile(r"^(?:[—–-]\s*)?(?:page|pg\.?|p\.?|seite)?\s*[\[(]?(\d{1,5}|[ivxlc]{1,8})[\])]?(?:\s*(?:/|of)\s*\d{1,5})?(?:\s*[—–-])?$", re.I)
FEATURES = 20


class _Kept(dict):
    """Makes values as they are asked for and keeps the first KEPT of short keys."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: str):
        v = self.make(key)
        if len(self) < KEPT and len(key) < KEPT_LENGTH:
            self[key] = v
        return v

    def __reduce__(self):  # sent to tasks empty
        return _Kept, (self.make,)


def word(token: str) -> str:
    """A token without adjoining punctuation."""
    return _TAIL.sub("", _LEAD.sub("", token, count=1), count=1)


#: Of a string without blanks: letters, capitals, does it begin with a letter, with a capital one.
_LOOKS = _Kept(lambda t: (sum(map(str.isalpha, t)), sum(map(str.isupper, t)), t[0].isalpha(), t[0].isalpha() and t[0].isupper()))
#: token -> its word, '' if that is no word of two characters with a letter.
_WORD = _Kept(lambda t: x if len(x := word(t)) > 1 and any(map(str.isalpha, x)) else "")
_DIGITS, _ET_AL = re.compile(r"\d+"), re.compile(r"^(.*?)\S+(?: and \S+)? et al\b")


def shape(line: str) -> str:
    """A line with digits as #, case off, and the name before `et al` left out."""
    s = _DIGITS.sub("#", " ".join(line.lower().split()))
    return _ET_AL.sub(r"\1et al", s) if "et al" in s else s


def _ends(line: str, chars: str) -> bool:
    return line[-1:] != "" and line[-1] in chars


def line_features(lines: list[str], known: dict[str, float], field: str) -> np.ndarray:
    """A row for each line, from it and its neighbours. known: shape -> log share of papers."""
    out = np.zeros((len(lines), FEATURES))
    stripped = [x.strip() for x in lines]
    width = max(map(len, stripped), default=1) or 1
    full = [i for i, s in enumerate(stripped) if s]
    for at, i in enumerate(full):
        s = stripped[i]
        prev, nxt = stripped[full[at - 1]] if at else "", stripped[full[at + 1]] if at + 1 < len(full) else ""
        w = s.split()
        letters, capitals, begin, begin_capital = map(sum, zip(*map(_LOOKS.__getitem__, w)))
        page = _PAGE.match(s) if len(s) < 64 else None
        out[i] = (
            letters / len(s), page is not None, bool(page and _ROMAN.match(page[1].lower())), len(s) / width, known.get(shape(s), -14.0),
            "et al" in s.lower(), begin_capital / max(1, begin), i > 0 and not stripped[i - 1], i + 1 < len(lines) and not stripped[i + 1],
            _ends(prev, ".!?;:\""), _ends(prev, ","), _ends(prev, MARKS), nxt[:1].islower(), _ends(s, ".;:"), _ends(s, ","), len(w), ("abstract", "refs", "title").index(field) if field in ("abstract", "refs", "title") else 3, capitals / max(1, letters), s[0].isdigit() or s[-1].isdigit(), at == 0 or at + 1 == len(full),
        )
    return out


def pair_features(line: str, nxt: str) -> list[float]:
    """Of a line that ends with a mark and the body line after it."""
    last, first = line.rstrip().split(" ")[-1], nxt.strip().split(" ")[0]
    stem = last[:-1]
    return [MARKS.find(last[-1:]), len(stem), stem[-1:].isalpha(), stem[-1:].isdigit(), first[:1].isalpha(), first[:1].islower(), first[:1].isdigit(), len(word(first)), "-" in stem]


def _wrap(text: str, width: int, rng: np.random.Generator) -> tuple[list[str], list[int]]:
    """Lines of a text, and 1 for each line whose last word goes on in the next."""
    lines, broken, cur = [], [], ""
    for w in text.split():
        if cur and len(cur) + 1 + len(w) > width:
            room = width - len(cur) - 2
            plain = re.fullmatch(r"[^\W\d_]{6,}[.,;:]?", w)
            if plain and room >= 3 and rng.random() < 0.7:
                k = int(rng.integers(2, min(room, len(w) - 3) + 1)) if min(room, len(w) - 3) >= 2 else 0
                if k:
                    lines.append(f"{cur} {w[:k]}{MARKS[int(rng.integers(len(MARKS)))]}")
                    broken.append(1)
                    cur = w[k:]
                    continue
            lines.append(cur if rng.random() > 0.03 else cur + " -")
            broken.append(0)
            cur = w
        else:
            cur = f"{cur} {w}" if cur else w
    lines.append(cur)
    broken.append(0)
    return lines, broken


def _furniture(titles: list[str], papers: list[str], rng: np.random.Generator) -> tuple[str, str]:
    n, t = int(rng.integers(1, 4000)), titles[int(rng.integers(len(titles)))]
    own, cut = papers[int(rng.integers(len(papers)))] if papers else t, int(rng.integers(32, 64))
    name = "".join(rng.permutation(list(t.split()[0].lower()))).capitalize()
    name = name.upper() if rng.random() < 0.15 else name.lower() if rng.random() < 0.1 else name
    if rng.random() < 0.5:
        heads = [t, t.upper(), f"{t}   {n}", f"{n}   {t}", f"{t}, Vol. {n % 60}", f"Preprint - {t}", f"{name} et al.  {n}", f"{name} et al.: {own}"[:cut], f"{name} et al.: {own}"[:cut], own.upper()[:cut], own.upper()[:cut], f"{n} {t}"]
        return heads[int(rng.integers(len(heads)))], "header"
    pages = [f"{n}", f"— {n} —", f"- {n} -", f"Page {n}", f"p. {n}", f"Pg {n}", f"{n} / {n + 3}", f"{n} of {n + 9}", f"[{n}]", "ivx"[n % 3] * (n % 3 + 1), "xiv", "vii"]
    return pages[int(rng.integers(len(pages)))], "pageno"


def train_lines(texts: list[tuple[str, str]], titles: list[str], papers: list[str], known: dict[str, float], seed: int = 7) -> dict[str, BoostedTrees]:
    """Models header, pageno and join, from clean texts (field, text) that are wrapped, broken and furnished here.

    titles: of journals, papers: of papers; running headers are made of them. Titles and lists of references are wrapped
    without furniture: lines of them look like headers and are body.
    """
    rng = np.random.default_rng(seed)
    xs, ys, px, py = [], [], [], []
    for field, text in texts:
        lines, broken = _wrap(text, int(rng.integers(38, 90) if field != "title" else rng.integers(18, 50)), rng)
        for i, b in enumerate(broken[:-1]):
            if _ends(lines[i], MARKS):
                px.append(pair_features(lines[i], lines[i + 1]))
                py.append(b)
        label = ["body"] * len(lines)
        if field == "abstract" and titles:
            for _ in range(1 + int(rng.random() < 0.3)):
                at = int(rng.integers(0, len(lines) + 1))
                line, kind = _furniture(titles, papers, rng)
                block = [(line, kind)]
                if rng.random() < 0.5:
                    block = [("", "body"), *block, ("", "body")]
                lines[at:at] = [x for x, _ in block]
                label[at:at] = [k for _, k in block]
            if rng.random() < 0.3 and len(lines) > 4:  # paragraphs
                at = int(rng.integers(1, len(lines)))
                lines.insert(at, "")
                label.insert(at, "body")
        f = line_features(lines, known, field)
        keep = [i for i, x in enumerate(lines) if x.strip()]
        xs.append(f[keep])
        ys += [label[i] for i in keep]
    x = np.concatenate(xs) if xs else np.zeros((1, FEATURES))
    y = np.array(ys or ["body"])
    pair = np.array(px or [[0.0] * 9]), np.array(py or [0])
    return {k: BoostedTrees().fit(x, y == k) for k in ("header", "pageno")} | {"join": BoostedTrees(rounds=20).fit(*pair)}


def read_pages(texts: list[str], fields: list[str], models: dict[str, BoostedTrees], known: dict[str, float]) -> list[tuple[bool, bool, list[tuple[str, bool]], list[tuple[str, str]], list[str], list[bool], list[str]]]:
    """Per text (has a header, has a page number, distinct (word, may be capital), distinct (left, right) of broken words,
    body lines, whether each one's last word goes on in the next, what stands before each one in continuous text). The
    models score all lines of all texts at once."""
    pages = [re.split(r"\r\n|\r|\n", t) for t in texts]
    rows = [line_features(p, known, f) if len(p) > 1 else np.zeros((len(p), FEATURES)) for p, f in zip(pages, fields)]
    ends = np.cumsum([0, *map(len, pages)])
    x = np.concatenate(rows) if rows else np.zeros((0, FEATURES))
    h, p = models["header"].score(x), models["pageno"].score(x)
    marks: list[tuple[bool, bool]] = []
    bodies: list[list[str]] = []
    glues: list[list[str]] = []
    pairs: list[list[float]] = []
    for k, lines in enumerate(pages):
        header = pageno = False
        body, glue = lines, [""]
        if len(lines) > 1:
            body, glue = [], []
            blank = furniture = False  # since the last body line
            for i, line in enumerate(lines, ends[k]):
                if not line.strip():
                    blank = True
                elif max(h[i], p[i]) > 0:
                    header, pageno = bool(header or h[i] >= p[i]), bool(pageno or p[i] > h[i])
                    furniture = True
                else:
                    glue.append(_glue(body[-1], line, blank and not furniture) if body else "")
                    body.append(line)
                    blank = furniture = False
        marks.append((header, pageno))
        bodies.append(body)
        glues.append(glue)
        pairs += [pair_features(a, b) for a, b in zip(body, body[1:]) if _marked(a) and b.strip()]
    joins = iter((models["join"].score(np.array(pairs)) > 0).tolist() if pairs else [])
    out = []
    for (header, pageno), body, glue in zip(marks, bodies, glues):
        goes_on = [*(_marked(a) and bool(b.strip()) and next(joins) for a, b in zip(body, body[1:])), False]
        out.append((header, pageno, *_words(body, goes_on), body, goes_on, glue))
    return out


#: What stands between two lines, as one letter.
_GLUES = {"": "0", " ": "1", "\n": "2", "\n\n": "3"}
_GLUE_OF = {v: k for k, v in _GLUES.items()}


def _flags(marks) -> str:
    return "".join("1" if x else "0" for x in marks)


def _marked(line: str) -> bool:
    s = line.rstrip()
    return len(s) > 1 and s[-1] in MARKS and not s[-2].isspace()


def _glue(line: str, nxt: str, blank: bool) -> str:
    """What stands between two body lines in continuous text; blank: blank lines and no furniture were between them.

    A blank line ends a paragraph, unless the sentence goes on in lower case; blank lines beside furniture belong to it.
    The entries of a list keep their lines. A mark at a line end that breaks no word is a hyphen inside a word.
    """
    a, b = line.rstrip(), nxt.lstrip()
    if blank and (a[-1] in ".!?:;\"'”’)]" or not b[0].islower()):
        return "\n\n"
    if _marked(a) and b[0].isalnum() and b.split()[0] not in ("and", "or", "to"):
        return ""
    if not a[-1].isalpha() and a[-1] not in "," + MARKS and (_ITEM.match(b) and not _NUMBER_FOLLOWS.search(a) or _ENTRY_LINE.search(f"{a[-5:]}\n{b}")):
        return "\n"
    return " "


def _tokens(body: list[str], goes_on: list[bool]) -> list[tuple[int, str, str, tuple[str, str, str, str] | None]]:
    """(line that the token begins or -1, separator before it, token, halves) of a text. halves, for a word broken after a
    line that goes on: (what is before it, left, right, what is after it); the token then still has the mark."""
    out = []
    carried = None  # the token with the left half of a broken word
    for at, (line, on) in enumerate(zip(body, goes_on)):
        begin, sep, w = at, "", []
        parts = _SPACE.split(line.strip())
        for token, after in zip(parts[0::2], [*parts[1::2], ""]):
            if token:
                w.append((begin, sep, token, None))
                begin, sep = -1, ""
            sep += after
        if w and carried is not None:
            left, right = carried[2], w[0][2]
            if on and len(w) == 1:  # broken over more than two lines
                carried = (*carried[:2], left[:-1] + right, None)
                continue
            a, b = _LEAD.sub("", left[:-1]), _TAIL.sub("", right)
            out.append((*carried[:2], left + w[0][1] + right, (left[: len(left) - 1 - len(a)], a, b, right[len(b) :])))
            w, carried = w[1:], None
        if w and on:
            carried = w.pop()
        out += w
    return out


def _may_start(tokens: list[tuple[int, str, str, tuple[str, str, str, str] | None]], i: int) -> bool:
    """May token i be capital, at a sentence's beginning or among capital words?"""
    if i == 0 or tokens[i - 1][2][-1] in ".?\"":
        return True
    if i + 1 == len(tokens):
        return False
    _, _, token, halves = tokens[i + 1]
    return ((halves[2] + halves[3]) if halves else token)[:1].isupper() and tokens[i][2][-1] not in ".,;:"


def _words(body: list[str], goes_on: list[bool]) -> tuple[list[tuple[str, bool]], list[tuple[str, str]]]:
    """Distinct (word, may be capital) and distinct (left, right) of the words broken after the lines that go on."""
    tokens = _tokens(body, goes_on)
    seen: dict[tuple[str, bool], None] = {}
    for i, (_, _, t, halves) in enumerate(tokens):
        if not halves and (x := _WORD[t]):
            seen[(x, _may_start(tokens, i))] = None
    return list(seen), list(dict.fromkeys(h[1:3] for _, _, _, h in tokens if h and h[1] and h[2]))


def mended(body: list[str], goes_on: list[bool], glue: list[str], fixes: dict[str, str], joins: dict[tuple[str, str], str]) -> str:
    """The continuous text of body lines; fixes: word -> right word in lower case, joins: halves -> whole word."""
    tokens = _tokens(body, goes_on)
    out = []
    for i, (begin, sep, t, halves) in enumerate(tokens):
        if halves:
            whole = joins.get(halves[1:3])
            t = t if whole is None else halves[0] + whole + halves[3]
        elif (x := word(t)) in fixes:
            at = _LEAD.match(t).end()
            t = t[:at] + recased(x, fixes[x], _may_start(tokens, i)) + t[at + len(x) :]
        out += [glue[begin] if begin >= 0 else "", sep, t]
    return "".join(out)


def sites(w: str, v: str) -> list[tuple[str, str]]:
    """The strings in which w, as read, and v, as printed, differ, in order."""
    k = 0
    while k < min(len(w), len(v)) and w[k] == v[k]:
        k += 1
    w, v, k = w[k:], v[k:], 0
    while k < min(len(w), len(v)) and w[-1 - k] == v[-1 - k]:
        k += 1
    w, v = w[: len(w) - k], v[: len(v) - k]
    if max(len(w), len(v)) <= 2:
        return [(w, v)] if w or v else []
    size, i, j = max(((k, i, j) for i in range(len(w)) for j in range(len(v)) if (k := _common(w[i:], v[j:]))), key=lambda x: (x[0], -abs(x[1] - x[2])), default=(0, 0, 0))
    return [*sites(w[:i], v[:j]), *sites(w[i + size :], v[j + size :])] if size else [(w, v)]


def _common(a: str, b: str) -> int:
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return k


def grams(w: str) -> list[str]:
    s = f"##{w}#"
    return sorted({s[i : i + 3] for i in range(len(s) - 2)})


RANKED = 14


def rank_features(w: str, n: float, v: str, nv: float, support: dict[tuple[str, str], int] | None = None, edits: int | None = None) -> list[float]:
    """Of a word w in n texts and the candidate v in nv; support: confusion -> words that show it."""
    a, b = set(grams(w)), set(grams(v))
    odd = sum(not (c.isalpha() and c.isascii() or c == "-") for c in w)
    where = sites(w, v)
    least = min((math.log1p((support or {}).get(x, 0)) for x in where), default=0.0)
    read, printed = [len(x) for x, _ in where] or [0], [len(x) for _, x in where] or [0]
    return [levenshtein(w, v) if edits is None else edits, len(where), least, max(read), max(printed), min(read + printed), math.log((nv + 1) / (n + 1)), 2 * len(a & b) / (len(a) + len(b)), odd, len(w), w[:1] == v[:1], w[-1:] == v[-1:], any("-" in x for x, _ in where), any(not (c.isascii() and c.isalpha()) for _, x in where for c in x)]


def corrupted(w: str, rng: np.random.Generator, by: dict[str, list[tuple[str, int]]]) -> str:
    """w with one place misread, sometimes two; by: printed -> (read, words that show it). Without by, or if nothing of it
    is in w, the misreading is random: one or two characters for one or two."""
    for _ in range(1 + int(rng.random() < 0.1)):
        fit = [g for g in by if g in w]
        if fit:  # rare confusions as often as common ones
            g = fit[int(rng.integers(len(fit)))]
            places = [at for at in range(len(w)) if w.startswith(g, at)]
            at = places[int(rng.integers(len(places)))]
            reads, often = zip(*by[g])
            b = reads[int(rng.choice(len(reads), p=np.array(often) / sum(often)))]
        else:
            kind = rng.random()
            size, new = (1, 1) if kind < 0.6 else (1, 2) if kind < 0.8 else (2, 1)
            last = max(0, len(w) - size)
            at = last if rng.random() < 0.2 else int(rng.integers(0, last + 1))  # a misread end looks like an inflection
            g, b = w[at : at + size], "".join(NOISE[int(x)] for x in rng.integers(0, len(NOISE), new))
        w = w[:at] + b + w[at + len(g) :]
    return w


def train_ranker(vocabulary: list[tuple[str, int]], support: dict[tuple[str, str], int] | None = None, seed: int = 7) -> BoostedTrees:
    """Ranker over (word, candidate), from corpus words that are misread here, half by the learned confusions and half at
    random; vocabulary: (word, texts that have it)."""
    rng = np.random.default_rng(seed)
    by: dict[str, list[tuple[str, int]]] = {}
    for (b, g), k in sorted((support or {}).items()):
        by.setdefault(g, []).append((b, k))
    words = [(w, n) for w, n in vocabulary if len(w) > 2 and re.fullmatch(r"[a-z-]+", w)]
    there = {w for w, _ in words}
    index: dict[str, list[int]] = {}
    for i, (w, _) in enumerate(words):
        for g in grams(w):
            index.setdefault(g, []).append(i)

    def near(w: str, k: int = 6) -> list[int]:
        return [i for i, _ in Counter(i for g in grams(w) for i in index.get(g, ())).most_common(2 * k) if words[i][0] != w and abs(len(words[i][0]) - len(w)) < 3][:k]

    x, y = [], []

    def add(bad: str, seen: int, v: str, n: int, right: bool) -> None:
        if n >= RATIO * seen and bad != v and (d := levenshtein(bad, v)) <= EDITS:  # others are never candidates
            x.append(rank_features(bad, seen, v, n, support, d))
            y.append(right)

    for i, (w, n) in enumerate(words):
        close = near(w)
        # words that look misread themselves teach nothing: they would count as clean here
        if any(words[j][1] >= RATIO * n and levenshtein(w, words[j][0]) <= 2 for j in close):
            continue
        for how in (by, by, by, {}, {}, {}):
            bad = corrupted(w, rng, how)
            if bad in there or len(bad) < 3:
                continue
            seen = int(n / RATIO ** rng.uniform(1, 6))
            for j in dict.fromkeys([i, *near(bad, 4)]):
                add(bad, seen, *words[j], j == i)
        # a spelling without accents is no misreading of the one with them
        at = int(rng.integers(0, len(w)))
        add(w, int(n / RATIO ** rng.uniform(1, 6)), w[:at] + "äéíöüñç"[int(rng.integers(7))] + w[at + 1 :], n, False)
        # the word itself, were it rare, has no correction: inflections, compounds and names must not be taken for misreadings
        cut = int(rng.integers(1, len(w)))
        for c in {w, w[:-1], w + "s", w[: len(w) // 2], w[len(w) // 2 :], w[:cut] + "-" + w[cut:], w.replace("-", "")}:
            if len(c) > 2:
                seen = int(n / RATIO ** rng.uniform(1, 6))
                for j in dict.fromkeys([*([i] if c != w else []), *near(c, 4)]):
                    add(c, seen, *words[j], False)
    if not any(y):
        x, y = [[9.0] * RANKED, [0.0] * RANKED], [False, True]
    return BoostedTrees(rounds=60, depth=4).fit(np.array(x), np.array(y))


def recased(token: str, right: str, capital: bool) -> str:
    """right in the case in which token was written; capital: for tokens whose first letter itself was misread."""
    letters = [c for c in token if c.isalpha()]
    if len(letters) > 2 and sum(c.isupper() for c in letters) > 0.7 * len(letters):
        return right.upper()
    first = token[0]
    if first.isalpha() and not (first == "I" and right[0] == "l") and first.isascii():
        upper = first.isupper()
    else:
        upper = capital and first in "508"
    return right[0].upper() + right[1:] if upper else right


def candidates(words: DataFrame) -> DataFrame:
    """(w, n, trusted, v, nv, edits): for each word the trusted ones within three edits that are in at least three texts
    and in RATIO times as many as the word; words: (w, n, trusted).

    The nine trigrams of a word that occur in the fewest candidates are joined with the candidates' inverted index. One
    misread place of up to two characters touches at most four trigrams, so of nine always one is left that a candidate
    with two such places shares; shorter words ask with all they have.
    """
    trigrams = F.expr("array_distinct(transform(sequence(1, length(w) + 1), i -> substr(concat('##', w, '#'), i, 3)))")
    able = words.filter((F.length("w") > 2) & F.col("w").rlike("[a-z]"))
    cand = able.filter("trusted and n >= 3")
    posting = cand.select(F.col("w").alias("v"), F.col("n").alias("nv"), F.explode(trigrams).alias("g"))
    often = posting.groupBy("g").agg(F.count("*").alias("k"))
    asked = able.select("w", "n", "trusted", F.explode(trigrams).alias("g")).join(often, "g")
    asked = asked.groupBy("w", "n", "trusted").agg(F.slice(F.array_sort(F.collect_list(F.struct("k", "g"))), 1, 9).alias("gs"))  # as many as letters
    pairs = asked.select("w", "n", "trusted", F.explode("gs.g").alias("g")).join(posting, "g").filter((F.col("nv") >= RATIO * F.greatest("n", F.lit(1))) & (F.abs(F.length("w") - F.length("v")) <= 2))
    return pairs.select("w", "n", "trusted", "v", "nv").distinct().withColumn("edits", F.levenshtein("w", "v")).filter(F.col("edits") <= EDITS)


def learned_confusions(pairs: DataFrame) -> dict[tuple[str, str], int]:
    """(read, printed) -> words that show it: each trusted word that has one nearest candidate is aligned with it; one place
    of up to two characters must explain it. Counted over all words; those with too little support are left out."""
    least = pairs.filter("trusted").groupBy("w", "edits").agg(F.count("*").alias("k"), F.min("v").alias("v"))
    best = least.groupBy("w").agg(F.min(F.struct("edits", "k", "v")).alias("x")).filter("x.k = 1").select("w", "x.v")

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [x[0] for w, v in zip(pdf["w"], pdf["v"]) if len(x := sites(w, v)) == 1 and all(0 < len(c) <= 2 for c in x[0])]
            yield pd.DataFrame(rows, columns=["b", "g"])

    counts = checkpointed(best.mapInPandas(align, "b string, g string").groupBy("b", "g").agg(F.count("*").alias("k")))
    total = counts.agg(F.sum("k")).head()[0] or 0
    return {(r[0], r[1]): r[2] for r in counts.filter(F.col("k") >= max(SUPPORTED, total * SUPPORT_SHARE)).collect()}  # at most 1 / SUPPORT_SHARE


def corrections(words: DataFrame) -> DataFrame:
    """(w, v, nv): the words with a correction; words: (w, n, trusted) with n texts each; only trusted ones are candidates.

    A correction wants evidence: a right word that is itself in under three texts, or in under RATIO times as many as
    the misread one, can't be told from it and is left.
    """
    pairs = checkpointed(candidates(words))
    support = learned_confusions(pairs)
    sample = [(r[0], r[1]) for r in words.filter("trusted and n >= 3 and length(w) > 2").orderBy(F.desc("n"), "w").limit(SAMPLE_WORDS).select("w", "n").collect()]
    shared = words.sparkSession.sparkContext.broadcast(cloudpickle.dumps((train_ranker(sample, support), support)))  # workers needn't have this package

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranker, support_ = pickle.loads(shared.value)
        for pdf in batches:
            x = np.array([rank_features(w, n, v, nv, support_, d) for w, n, v, nv, d in zip(pdf["w"], pdf["n"], pdf["v"], pdf["nv"], pdf["edits"])]).reshape(len(pdf), RANKED)
            yield pdf.assign(s=ranker.score(x))[["w", "v", "nv", "s"]]

    scored = pairs.mapInPandas(score, "w string, v string, nv bigint, s double").filter("s > 0")
    return scored.groupBy("w").agg(F.max(F.struct("s", "nv", "v")).alias("x")).select("w", F.col("x.v").alias("v"), F.col("x.nv").alias("nv"))


def repairs(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, kind, repaired): the repairs of `mend`."""
    return mend(df, key, fields)[1]


def repaired_texts(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, text): the whole texts of `mend`."""
    return mend(df, key, fields)[0]


def mend(df: DataFrame, key: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """((key, field, text), (key, field, kind, repaired)): the repaired texts and every repair made in them, of one pass.

    text is the whole field without furniture, broken words joined, misread ones put right, lines joined, paragraphs
    apart by a blank line; kind is hyphen, char, header or pageno. Rows equal in key and fields count once. Null, blank
    and 'None' fields need no repair and have no text; very long texts are read whole, a line without end is one line.
    Ties between candidates go to the one in more papers, then the greater word.
    """
    k, kind, outer = safe_key(df, key)
    src = df.select(k.alias("k"), *(F.col(c).alias(f"v{i}") for i, c in enumerate(fields))).distinct()
    long = src.select("k", F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"v{i}").alias("text")) for i, c in enumerate(fields)))).alias("x")).select("k", "x.field", "x.text").filter(present("text"))
    long = checkpointed(long.withColumn("row", F.monotonically_increasing_id()))  # a null key joins nothing, a row number does
    total = long.filter(F.col("field") == fields[0]).count() or 1
    # shapes shared by many papers: at most (lines of a paper) / SHAPE_SHARE of them
    line = F.explode(F.split("text", r"\r\n|\r|\n")).alias("line")
    numbers = F.regexp_replace(F.trim(F.regexp_replace(F.lower("line"), r"\s+", " ")), r"\d+", "#")
    short = long.filter(F.col("text").rlike(r"[\r\n]")).select(line).select(numbers.alias("s")).filter("s <> ''")
    s = F.when(F.col("s").contains("et al"), F.regexp_replace("s", r"^(.*?)\S+(?: and \S+)? et al\b", "$1et al")).otherwise(F.col("s"))
    shapes = short.select(s.alias("s")).filter("length(s) < 90")
    least = max(3, math.ceil(total * SHAPE_SHARE))
    known = {r[0]: math.log(r[1] / total) for r in shapes.groupBy("s").agg(F.count("*").alias("n")).filter(F.col("n") >= least).collect()}
    clean = long.filter(~F.col("text").rlike(r"[\r\n]") & (F.length("text") > F.when(F.col("field") == "title", 20).otherwise(200)))
    sample = [(r[0], r[1]) for r in clean.orderBy(F.xxhash64("k", "field"), "k").limit(SAMPLE_TEXTS).select("field", "text").collect()]
    found = Counter(t for f, x in sample if f == "refs" for t in re.findall(r"(?:\bin |[,.]\" |\. )([A-Z][^,.\d\"]{8,60}), (?:pp|vol)\.", x))
    titles = [t for t, _ in found.most_common(60)]
    models = df.sparkSession.sparkContext.broadcast(cloudpickle.dumps((train_lines(sample, titles, [x for f, x in sample if f == "title"], known), known)))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trained = pickle.loads(models.value)
        for pdf in batches:
            read_all = read_pages(pdf["text"].tolist(), pdf["field"].tolist(), *trained)
            # words and lines hold no line end, so one text carries a list of them, which costs Arrow least
            rows = [
                (row, k, field, header, pageno, "\n".join(w for w, _ in seen), _flags(c for _, c in seen), breaks, "\n".join(body), _flags(goes_on), "".join(_GLUES[g] for g in glue))
                for row, k, field, (header, pageno, seen, breaks, body, goes_on, glue) in zip(pdf["row"], pdf["k"], pdf["field"], read_all)
            ]
            yield pd.DataFrame(rows, columns=["row", "k", "field", "header", "pageno", "seen", "capital", "breaks", "body", "goes_on", "glue"])

    pages = checkpointed(long.mapInPandas(read, f"row bigint, k {kind}, field string, header boolean, pageno boolean, seen string, capital string, breaks array<struct<a:string,b:string>>, body string, goes_on string, glue string"))
    words_in = pages.filter("seen <> ''")
    seen = words_in.select("row", "k", "field", "capital", F.posexplode(F.split("seen", "\n")).alias("at", "token")).select("row", "k", "field", "token", (F.substring("capital", F.col("at") + 1, F.lit(1)) == "1").alias("capital"), F.lower("token").alias("w"))
    counts = words_in.select(F.explode(F.array_distinct(F.split(F.lower("seen"), "\n"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    broken = checkpointed(pages.select("row", "k", "field", F.explode("breaks").alias("x")).select("row", "k", "field", "x.a", "x.b"))
    forms = broken.select(F.explode(F.array(F.concat("a", "b"), F.concat("a", F.lit("-"), "b"))).alias("w")).select(F.lower("w").alias("w")).distinct()
    words = counts.withColumn("trusted", F.lit(True)).unionByName(forms.join(counts, "w", "left_anti").select("w", F.lit(0).cast("bigint").alias("n"), F.lit(False).alias("trusted")))
    words = checkpointed(words)
    fixes = checkpointed(corrections(words))
    few = fixes.count() <= MAX_BROADCAST
    fixed = F.broadcast(fixes) if few else fixes
    chars = seen.join(fixed, "w").select("row", "k", "field", "token", "v", "capital")
    # a broken word: whichever of its two joined forms, corrected if need be, is in more papers
    known_form = words.filter("n > 0").select("w", "n").join(fixes, "w", "left").select("w", F.coalesce("v", "w").alias("right"), F.coalesce("nv", "n").alias("m"), F.col("v").isNotNull().alias("misread"))
    lost = fixes.join(words.filter("n = 0").select("w"), "w", "left_semi").select("w", F.col("v").alias("right"), F.col("nv").alias("m"), F.lit(True).alias("misread"))
    table = known_form.unionByName(lost).join(forms, "w", "left_semi")
    both = broken.select("row", "k", "field", "a", "b", F.posexplode(F.array(F.concat("a", "b"), F.concat("a", F.lit("-"), "b")))).withColumnRenamed("col", "token").withColumn("w", F.lower("token"))
    both = both.join(table, "w", "left")
    plain = F.when(F.col("pos") == 0, ~F.col("a").contains("-")).otherwise(F.col("a").contains("-"))
    pick = both.groupBy("row", "k", "field", "a", "b").agg(F.max_by(F.struct("token", F.coalesce("right", "w").alias("right"), F.coalesce("misread", F.lit(False)).alias("misread")), F.struct(F.coalesce("m", F.lit(0)), plain.cast("int"))).alias("x"))
    pick = pick.select("row", "k", "field", "a", "b", "x.*")

    def case(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["repaired"] = [recased(t, v, c) if m else t for t, v, c, m in zip(pdf["token"], pdf["v"], pdf["capital"], pdf["misread"])]
            yield pdf[["k", "field", "kind", "repaired"]]

    cols = f"k {kind}, field string, kind string, repaired string"
    rows = chars.select("k", "field", F.lit("char").alias("kind"), "token", "v", "capital", F.lit(True).alias("misread"))
    rows = rows.unionByName(pick.select("k", "field", F.explode(F.when(F.col("misread"), F.array(F.lit("hyphen"), F.lit("char"))).otherwise(F.array(F.lit("hyphen")))).alias("kind"), "token", F.col("right").alias("v"), F.lit(False).alias("capital"), "misread"))
    out = rows.mapInPandas(case, cols)
    for mark in ("header", "pageno"):
        out = out.unionByName(pages.filter(mark).select("k", "field", F.lit(mark).alias("kind"), F.lit("").alias("repaired")))
    made = out.distinct().select(F.col("k").cast(outer).alias(key), "field", "kind", "repaired")
    words_of = chars.groupBy("row").agg(F.collect_set(F.struct("token", "v")).alias("fixes"))
    joins_of = pick.groupBy("row").agg(F.collect_list(F.struct("a", "b", "token", "right", "misread")).alias("joins"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = []
            for body, goes_on, glue, fix, join in zip(pdf["body"], pdf["goes_on"], pdf["glue"], pdf["fixes"], pdf["joins"]):
                right = {x["token"]: x["v"] for x in (fix if fix is not None else ())}
                whole = {(x["a"], x["b"]): recased(x["token"], x["right"], False) if x["misread"] else x["token"] for x in (join if join is not None else ())}
                texts.append(mended(body.split("\n") if glue else [], [x == "1" for x in goes_on], [_GLUE_OF[x] for x in glue], right, whole))
            yield pdf[["k", "field"]].assign(text=texts)

    texts = pages.select("row", "k", "field", "body", "goes_on", "glue").join(words_of, "row", "left").join(joins_of, "row", "left")
    texts = texts.drop("row").mapInPandas(write, f"k {kind}, field string, text string")
    return texts.distinct().select(F.col("k").cast(outer).alias(key), "field", "text"), made
