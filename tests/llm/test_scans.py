import random

import numpy as np
import pytest

from foliospark.llm import scans
from foliospark.llm.boost import BoostedTrees

WORDS = "representation normalization hierarchical boundary supervision calibration landmark transformer discriminative regularization kernel attention localization benchmark metric contour channel segment viewpoint embedding".split()


def clean_text(rng, n=60):
    return " ".join(" ".join(rng.choice(WORDS) for _ in range(9)).capitalize() + "." for _ in range(n // 9))


@pytest.fixture(scope="module")
def papers(spark):
    rng = random.Random(3)
    rows = [(f"c{i}", clean_text(rng, 90), f"A. Abc, \"Title one,\" Annals of Drawn Vision, vol. {i}, 1999. B. Bcd, \"Title two and more words to be long enough for a sample,\" Annals of Drawn Vision, vol. 3, 2001. {clean_text(rng, 18)}") for i in range(150)]
    # every word is broken, every text has furniture and one misreading
    for i in range(60):
        lines, marks = scans._wrap(clean_text(rng, 90), 48, np.random.default_rng(i))
        body = "\n".join(lines)
        lines = body.split("\n")
        lines[4:4] = ["", "Annals of Drawn Vision   %d" % i, ""]
        lines[9:9] = ["Page %d" % (i + 3)]
        w = WORDS[i % len(WORDS)]
        text = "\n".join(lines).replace(f" {w} ", f" {w.replace('e', 'c', 1)} ", 1)
        rows.append((f"s{i}", text, "None"))
    rows += [(None, "", None), ("empty", None, "None"), ("s0", rows[150][1], "None"), ("long", "Kernel attention " * 20_000, None)]
    return spark.createDataFrame([(*r, "x") for r in rows], "f string, abstract string, refs string, field string")


def test_repairs(spark, papers):
    got = [tuple(r) for r in scans.repairs(papers, "f", ["abstract", "refs"]).collect()]
    assert len(got) == len(set(got))
    by = {}
    for f, field, kind, r in got:
        by.setdefault(kind, set()).add((f, field, r))
    scanned = {f"s{i}" for i in range(60)}
    for kind in ("header", "pageno"):
        found = {f for f, field, r in by[kind] if field == "abstract" and r == ""}
        assert len(found & scanned) >= 55 and len(found - scanned) <= 3
    broken = {(f, w.lower().strip(".")) for f, text in ((r[0], r[1]) for r in papers.filter("f like 's%'").collect()) for w in _broken(text)}
    hits = {(f, r.lower()) for f, field, r in by["hyphen"] if field == "abstract"}
    assert len(broken & hits) > 0.9 * len(broken) and len(hits - broken) < 0.05 * len(hits)
    chars = {r.lower() for f, field, r in by["char"]}
    assert len(chars) > 10 and chars <= set(WORDS)


def _broken(text):
    lines = [x for x in text.split("\n") if x.strip() and not x.startswith(("Annals", "Page "))]
    for a, b in zip(lines, lines[1:]):
        if a[-1] in scans.MARKS and not a.endswith(" -"):
            yield a.split()[-1][:-1] + b.split()[0]


def test_sites():
    for w, v, want in (("mctric", "metric", [("c", "e")]), ("leaming", "learning", [("m", "rn")]), ("cahbration", "calibration", [("h", "li")]), ("layers", "layer", [("s", "")]), ("metric", "metric", []), ("althoiigh", "although", [("ii", "u")]), ("rnctric", "metric", [("rn", "m"), ("c", "e")])):
        got = scans.sites(w, v)
        assert got == want or (w == "rnctric" and "".join(b for b, _ in got) == "rnc")


def test_confusions_are_learned(spark):
    rows = [(w, 400, True) for w in WORDS] + [(w.replace("e", "q", 1), 3, True) for w in WORDS if "e" in w] + [(w + "s", 2, True) for w in WORDS]
    words = spark.createDataFrame(rows, "w string, n bigint, trusted boolean")
    pairs = scans.candidates(words)
    support = scans.learned_confusions(pairs)
    assert max(support, key=support.get) == ("q", "e") and all(b and g for b, g in support)
    fixed = {r["w"]: r["v"] for r in scans.corrections(words).collect()}
    assert all(fixed.get(w.replace("e", "q", 1)) == w for w in WORDS if "e" in w) and not set(fixed) & {w + "s" for w in WORDS}


def test_candidates_hold_every_word_with_two_misread_places(spark):
    rng = np.random.default_rng(2)
    common = ["".join(rng.choice(list("abcdefghij"), int(rng.integers(5, 13)))) for _ in range(150)]
    bad = {}
    for w in common:
        b = scans.corrupted(w, rng, {})
        b = b if len(b) < 8 else scans.corrupted(b, rng, {})
        if any(c.isalpha() for c in b):
            bad[b] = w
    words = spark.createDataFrame([(w, 90, True) for w in set(common)] + [(b, 2, True) for b in bad if b not in common], "w string, n bigint, trusted boolean")
    got = {(r["w"], r["v"]) for r in scans.candidates(words).collect()}
    want = {(b, w) for b in bad if b not in common for w in set(common) if scans.levenshtein(b, w) <= 3 and abs(len(b) - len(w)) <= 2 and len(b) > 6}
    near = {(b, w) for b, w in want if scans.levenshtein(b, w) <= 2}
    assert near and near <= got and len(want & got) >= 0.98 * len(want)


def test_unlisted_misreadings_are_ranked(spark):
    vocabulary = [(w + e, 900 - 7 * i) for i, w in enumerate(WORDS) for e in ("", "s", "ing")] + [(a + b, 500) for a in ("pro", "con", "inter", "sub", "re") for b in ("ject", "duct", "form", "struct", "pose", "spect", "vent", "scribe", "tract", "mission")]
    model = scans.train_ranker(vocabulary, {("c", "e"): 40, ("rn", "m"): 20})
    hits = n = 0
    for w, k in vocabulary:
        for read, printed in (("o", "a"), ("f", "t"), ("v", "r"), ("3", "e"), ("$", "s"), ("@", "a"), ("n", "h")):
            if printed in w[1:]:
                bad = w[0] + w[1:].replace(printed, read, 1)
                scored = [(model.score(np.array([scans.rank_features(bad, 1, v, m)]))[0], v) for v, m in vocabulary if abs(len(v) - len(bad)) < 3 and scans.levenshtein(bad, v) <= 3]
                n += 1
                hits += max(scored)[0] > 0 and max(scored)[1] == w
    assert n > 100 and hits > 0.8 * n


def test_recased():
    assert scans.recased("Leaming", "learning", False) == "Learning" and scans.recased("F1LTERS", "filters", False) == "FILTERS"
    assert scans.recased("5amples", "samples", False) == "samples" and scans.recased("5amples", "samples", True) == "Samples" and scans.recased("Iayer", "layer", True) == "layer"


def test_boosted_trees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = (x[:, 0] * x[:, 1] > 0) | (x[:, 2] > 1.5)
    m = BoostedTrees(rounds=60, depth=4).fit(x[:2000], y[:2000])
    assert ((m.score(x[2000:]) > 0) == y[2000:]).mean() > 0.9
    assert BoostedTrees().fit(np.zeros((4, 2)), np.array([0, 1, 0, 1])).score(np.zeros((0, 2))).shape == (0,)


def test_empty(spark, papers):
    assert scans.repairs(papers.limit(0), "f", ["abstract", "refs"]).count() == 0


def test_whole_texts(spark, papers):
    texts, made = scans.mend(papers, "f", ["abstract", "refs"])
    rows = [tuple(r) for r in texts.collect()]
    got = {(f, field): t for f, field, t in rows}
    assert len(rows) == len(got) == 150 * 2 + 60 + 1  # fields without text have no row
    whole = {(r[0]): r[1] for r in papers.filter("f like 'c%' or f = 'long'").collect()}
    assert all(got[f, "abstract"] == t.strip() for f, t in whole.items())
    scanned = {f: got[f, "abstract"] for f in (f"s{i}" for i in range(60))}
    written = {r[0]: r[1] for r in papers.select("f", "abstract").filter("f like 's%'").distinct().collect()}
    right = 0
    for i in range(60):
        w = WORDS[i % len(WORDS)]
        right += scanned[f"s{i}"].replace(" -", "") == _joined(written[f"s{i}"]).replace(f" {w.replace('e', 'c', 1)} ", f" {w} ")
    assert right >= 50
    # every repair listed is made in the text
    for f, field, kind, r in made.collect():
        assert kind in ("header", "pageno") or r in got[f, field]


def _joined(text):
    out = ""
    for line in (x for x in text.split("\n") if x.strip() and not x.startswith(("Annals", "Page "))):
        broken = out[-1:] != "" and out[-1] in scans.MARKS and not out.endswith(" -")
        out = out[:-1] + line if broken else f"{out} {line}" if out else line
    return out.replace(" -", "")


def test_mended():
    text = ["Thc (repre-", "senta-", "tion), semi-", "dense 3-", "5. It ends.", "New one;two", "[2] item"]
    on = [True, True, True, False, False, False, False]
    assert scans._words(text, on)[1] == [("representa", "tion"), ("semi", "dense")]
    glue = ["", " ", " ", " ", scans._glue(text[3], text[4], False), scans._glue(text[4], text[5], True), "\n"]
    got = scans.mended(text, on, glue, {"Thc": "the"}, {("representa", "tion"): "representation", ("semi", "dense"): "semi-dense"})
    assert got == "The (representation), semi-dense 3-5. It ends.\n\nNew one;two\n[2] item"
    assert scans._glue("in the middle", "of it", True) == " " and scans._glue("A. Abc, 1999.", "(2) B. Bcd", False) == "\n"
