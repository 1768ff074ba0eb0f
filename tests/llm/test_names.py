import numpy as np

from foliospark.llm.names import author_entities, left_out_keys, merge_and_rematch, org_entities, parse_person, same_pairs
from foliospark.llm.org_names import normal

PEOPLE = {
    "Robert Lelsebumi": 1, 'Robert "Bob" Lelsebumi': 1, "Bob Lelsebumi": 1, "R. Lelsebumi": 1, "Lelsebumi, R.": 1, "ROBERT LELSEBUMI": 1, "Dr. Robert Lesebumi": 1, "Lelsebumi Robert": 1,
    "Joaquín Kaglikenko": 2, "Joaquin Kaglikenko": 2, "J. Kgalikenko": 2, "Vera Kaglikenko": 3, "Vera Kagllikenko": 3, "Mei Kaglikenko": 4, "B. Lelsebumi": 5,
}


def groups(df):
    out = {}
    for v, e in df.collect():
        out.setdefault(e, set()).add(v)
    return sorted(map(sorted, out.values()))


def test_people(spark):
    values = spark.createDataFrame([(v, 3 if "." not in v else 1) for v in PEOPLE], "value string, n bigint")
    want = {}
    for v, g in PEOPLE.items():
        want.setdefault(g, set()).add(v)
    assert groups(author_entities(values)) == sorted(map(sorted, want.values()))


def test_orgs(spark):
    names = {
        "Nalhidaria State University": 1, "Nalhidaria State University (NSU)": 1, "NSU, Kezdipeville": 1, "Faculty of Engineering, Nalhidaria St. Univ.": 1, "NALHIDARIA STATE UNIVERSITY": 1, "Nalhidria State University": 1, "Nalhidaria State Univeristy": 1,
        "Nalhidaria State University - Kez campus": 1, "University of Zogzoganby": 2, "Universidad de Zogzoganby": 2, "U of Zogzoganby": 2, "Zogzoganby University": 3, "Inst. of Technology, Sudfegostad": 4, "Sudfegostad Tech": 4, "QQX": 5,
    }
    values = spark.createDataFrame([(v, 2) for v in names], "value string, n bigint")
    want = {}
    for v, g in names.items():
        want.setdefault(g, set()).add(v)
    got = groups(org_entities(values))
    assert got == sorted(map(sorted, want.values()))
    pairs = same_pairs(org_entities(values), "aff").collect()
    assert len(pairs) == 8 * 7 // 2 + 3 + 1 and all(r["name_a"] < r["name_b"] for r in pairs)


def test_rematch_after_merge(spark):
    # abcdefgX joins abcdefgh only; abcdefXX shares no block with abcdefgh but with the merged profile's other form
    forms = spark.createDataFrame([("abcdefgh", 9, 3), ("abcdefg", 2, 1), ("abcdeg", 1, 1), ("zyxwvuts", 5, 1), (None, 1, 1), ("", 1, 1)], "form string, weight bigint, breadth bigint")
    got = dict(map(tuple, merge_and_rematch(forms).collect()))
    assert got == {"abcdefgh": "abcdefgh", "abcdefg": "abcdefgh", "abcdeg": "abcdefgh", "zyxwvuts": "zyxwvuts"}


def test_two_known_surnames_stay_apart(spark):
    forms = spark.createDataFrame([("hidhahenko", 50, 9), ("hidhihenko", 40, 8)], "form string, weight bigint, breadth bigint")
    assert {r[1] for r in merge_and_rematch(forms).collect()} == {"hidhahenko", "hidhihenko"}


def test_empty(spark):
    none = spark.createDataFrame([], "value string, n bigint")
    assert author_entities(none).count() == 0 and org_entities(none).count() == 0


def test_parts():
    assert parse_person("Dr. Zoë (Zo) A. Abc") == (["zoe", "a.", "abc"], "zo", False)
    assert parse_person("Abc, Z.") == (["z.", "abc"], "", True)
    assert normal("Vision Lab, Abc Polytechnic").name == "abc polytechnic"
    assert normal("TUSo").bare and normal("Abc Univ.").name == "abc university"


def test_keys_of_left_out_characters():
    for a, b in (("thompson", "thompsn"), ("kim", "kin"), ("abcd", "abdc"), ("ab", "a"), ("é" * 500 + "x", "é" * 500), ("müller", "muller")):
        assert np.intersect1d(left_out_keys(a), left_out_keys(b)).size
    assert not np.intersect1d(left_out_keys("thompson"), left_out_keys("tompsan")).size
    assert len(left_out_keys("x" * 20_000 + "y")) == 3  # equal letters in a row leave out the same


def entities_of(spark, rows):
    return dict(map(tuple, merge_and_rematch(spark.createDataFrame(rows, "form string, weight bigint, breadth bigint")).collect()))


def test_chains_do_not_depend_on_weights(spark):
    chain = ["abcdefghij", "abcdefghiX", "abcdefgYiX", "abcdZfgYiX"]
    for weights in ((9, 7, 5, 3), (9, 5, 1, 3), (1, 1, 1, 1), (3, 9, 1, 7)):
        assert len(set(entities_of(spark, [(f, w, 1) for f, w in zip(chain, weights)]).values())) == 1


def test_misspelling_with_many_initials(spark):
    assert set(entities_of(spark, [("thompson", 2600, 26), ("thompsn", 21, 7)]).values()) == {"thompson"}
    assert set(entities_of(spark, [("thompson", 2600, 26), ("thompsn", 52, 26)]).values()) == {"thompson"}
    assert len(set(entities_of(spark, [("kim", 500, 20), ("kin", 400, 18)]).values())) == 2
    assert set(entities_of(spark, [("kim", 500, 20), ("kin", 2, 2)]).values()) == {"kim"}


def test_initials_are_united(spark):
    # b and c have two initials each; only together do they show what a's surname would have to explain
    rows = [("abcdefgh", [("x", 90), ("y", 90)]), ("abcdefg", [("x", 1), ("z", 2)]), ("abcdeg", [("z", 3), ("q", 1)])]
    forms = spark.createDataFrame([(f, m) for f, m in rows], "form string, marks array<struct<m:string,w:bigint>>")
    assert {r[1] for r in merge_and_rematch(forms).collect()} == {"abcdefgh"}


def test_listed_stay_apart(spark):
    forms = spark.createDataFrame([("abcdefgh", [("m", 1)], True), ("abcdefgi", [("m", 1)], True), ("abcdefg", [("m", 1)], False)], "form string, marks array<struct<m:string,w:bigint>>, listed boolean")
    got = dict(map(tuple, merge_and_rematch(forms).collect()))
    assert got["abcdefgh"] != got["abcdefgi"] and got["abcdefg"] in (got["abcdefgh"], got["abcdefgi"])


def test_pairs_of_a_large_entity(spark):
    ent = spark.createDataFrame([(f"v{i}", "e") for i in range(50)] + [("w", "f")], "value string, entity string")
    assert same_pairs(ent, "k", per_task=7).distinct().count() == same_pairs(ent, "k", per_task=7).count() == 50 * 49 // 2


def test_estimates_of_many_rounds_stay_small(spark):
    # a chain in which each form is an edit from the next takes several rounds; the planner's size of the result must not carry their products
    chain = ["abcdefghijklmnop"]
    for i in range(14):
        chain.append(chain[-1][:i] + "XYZ"[i % 3] + chain[-1][i + 1 :])
    got = merge_and_rematch(spark.createDataFrame([(f, 100 - 7 * i % 15, 1) for i, f in enumerate(chain)], "form string, weight bigint, breadth bigint"))
    assert len({r[1] for r in got.collect()}) == 1
    assert got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 1000
