import random

from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.llm.mapping import BKTree, levenshtein, map_to_list


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


word = st.text(alphabet="abcé", max_size=9)


@settings(max_examples=300, deadline=None)
@given(word, word)
def test_distance(a, b):
    assert levenshtein(a, b) == plain(a, b)


def test_tree_returns_every_entry_within_threshold():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    tree = BKTree(words)
    for q in words[:40]:
        for t in (0, 1, 2, 3):
            assert {w for _, w in tree.search(q, t)} == {w for w in words if plain(q, w) <= t}


ENTRIES = [(1, "Lovguvocove Institute of Technology", None, "Lov"), (2, "University of Zogzoganby", "UZ", "Zog"), (3, "Zogzoganby University", None, "Zog"), (9, "Lovguvocove Institute of Technology", None, "Lov"), (None, "Nobody", None, None)]
VALUES = {
    "Lovguovcove Institute of Technology": 1, "Faculty of X, Lovguvocove Inst. of Tech.": 1, "UZ": 2, "UZ, Zog": 2, "University of Zogzoganby (UZ)": 2, "Zogzoganby Univ.": 3, "ZOGZOGANBY UNIVERSITY": 3,
    "Zogzoganby Polytechnic": -1, "": -1, None: -1, "x" * 50_000: -1,
}


def test_mapping(spark):
    entries = spark.createDataFrame(ENTRIES, "inst_id int, name string, short string, city string")
    values = spark.createDataFrame([(i, v, "d") for i, v in enumerate(VALUES)] + [(77, "UZ", "d")], "id int, value string, d string")
    for shard in (50_000, 2):
        rows = map_to_list(values, "value", entries, shard_entries=shard).collect()
        assert {r["id"]: r["inst_id"] for r in rows} == {**dict(enumerate(VALUES.values())), 77: 2} and len(rows) == len(VALUES) + 1 and rows[0]["d"] == "d"
    assert {r["inst_id"] for r in map_to_list(values, "value", entries.limit(0)).collect()} == {-1}
    assert map_to_list(values.limit(0), "value", entries).count() == 0


def test_answers_do_not_depend_on_shards(spark):
    listed = [(1, "Zogzogamby University", "ABC", "Foo"), (2, "Kezdi Polytechnic", "ABC", "Kez"), (3, "Kezdi Institute of Technology", None, "Kez"), (4, "Zogzogamby College", "ABC", "Bar"), (5, "Kezdo Polytechnic", "KP", "Kez")]
    entries = spark.createDataFrame(listed, "inst_id int, name string, short string, city string")
    texts = ["Zogzogamby University (ABC)", "ABC, Bar", "Kezdi Polytechnix (ABC)", "ABC", "ABC, Elsewhere", "KP, Bar", "Kezdi Polytechnik", "Kezda Polytechnic", "Nowhere (KP)", "Unknown Academy", "Zogzogamby Univ."]
    values = spark.createDataFrame([(t,) for t in texts], "v string")
    got = [{r["v"]: r["inst_id"] for r in map_to_list(values, "v", entries, shard_entries=size).collect()} for size in (50_000, 3, 2, 1)]
    assert got[0] == got[1] == got[2] == got[3]
    assert [got[0][t] for t in texts] == [1, 4, 2, 1, 1, 5, 2, 2, 5, -1, 1]
