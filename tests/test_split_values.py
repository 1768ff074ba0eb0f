from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.operators.split_values import split_text, split_values, tokens

PEOPLE = {
    'Robert "Bob" Lelsebumi': ['Robert "Bob" Lelsebumi'],
    ' Quentin Zennzenorf;': ["Quentin Zennzenorf"],
    'A. Abc || B. Bcd ||  || Cde, Dora': ["A. Abc", "B. Bcd", "Cde, Dora"],
    "Mei P. Gad and Edward Sih": ["Mei P. Gad", "Edward Sih"],
    "A. Abc, Bea Bcd, and C Cde": ["A. Abc", "Bea Bcd", "C Cde"],
    'Yuto RAK,"Kag, J."': ["Yuto RAK", "Kag, J."],
    '"Quentin Tef", "Niv, H.", "Yolanda ""Yola"" Vab"': ["Quentin Tef", "Niv, H.", 'Yolanda "Yola" Vab'],
    "Pavel H. Zen, K. Rum;Vera Kag": ["Pavel H. Zen", "K. Rum", "Vera Kag"],
    "Pen Lov; Sos, Vera; Dmi (Dima; D) Par": ["Pen Lov", "Sos, Vera", "Dmi (Dima; D) Par"],
    "C. N. Nek\r\nXia Ron\n\nDal, Ul": ["C. N. Nek", "Xia Ron", "Dal, Ul"],
    "1. Ann Abc; 2. Bob  Bcd": ["Ann Abc", "Bob Bcd"],
    "[1] Ann Abc\t• Bob Bcd": ["Ann Abc", "Bob Bcd"],
    "": [], "None": [], "   ": [], " ; , ": [],
}
PLACES = {
    '"School of Info, Lik University", Pus Institute of Technology': ["School of Info, Lik University", "Pus Institute of Technology"],
    "FSU, Fizrevomere ; Gep State University - Gep campus": ["FSU, Fizrevomere", "Gep State University - Gep campus"],
    "AI/ML Group, Luf Natl. Lab / Abc National Lab, Univ of Xyz": ["AI/ML Group, Luf Natl. Lab", "Abc National Lab", "Univ of Xyz"],
    "Lov Institute of Technology,BIT": ["Lov Institute of Technology", "BIT"],
    "Arts & Design Academy|Poly (PP), Noffamedam": ["Arts & Design Academy", "Poly (PP), Noffamedam"],
}
ENTRIES = {
    "[1]A. Abc. One, 2001.\n[2]B. Bcd. Two;\npart II, 2002.": ["A. Abc. One, 2001.", "B. Bcd. Two; part II, 2002."],
    "1. A. Abc, One, 2001 2. B. Bcd, Two, vol. 2, 2002": ["A. Abc, One, 2001", "B. Bcd, Two, vol. 2, 2002"],
    "• A. Abc. One • B. Bcd. Two": ["A. Abc. One", "B. Bcd. Two"],
    'A. Abc, One, 2001;"B. Bcd, ""Two; part I,"" X, 2002"': ["A. Abc, One, 2001", 'B. Bcd, "Two; part I," X, 2002'],
    "A. Abc, One for\ntwo, 2001\nB. Bcd and C. Cde (2002). Two\nlines": ["A. Abc, One for two, 2001", "B. Bcd and C. Cde (2002). Two lines"],
    "A. Abc. One // B. Bcd. Two": ["A. Abc. One", "B. Bcd. Two"],
}


def test_dialects():
    for cases, dialect in ((PEOPLE, "people"), (PLACES, "places"), (ENTRIES, "entries")):
        for text, want in cases.items():
            assert split_text(text, dialect) == want, text
    assert split_text(None, "people") == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet='abc ,;|"()', min_size=1, max_size=12).map(str.strip).filter(lambda s: s and s.strip('" ()') and not s.startswith(('"', "(")) ), min_size=1, max_size=6))
def test_quoted_round_trip(values):
    values = [" ".join(v.split()) for v in values]
    text = "; ".join('"' + v.replace('"', '""') + '"' for v in values)
    assert [v.strip() for v, _, _ in tokens(text)] == values


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_ends(text):
    for dialect in ("people", "places", "entries"):
        for v in split_text(text, dialect):
            assert v and v == v.strip()


def test_operator(spark):
    rows = [("a", "X Yz; B Cd", "None", 1), ("a", "X Yz; B Cd", "None", 2), (None, "Q Rs", None, 1), ("b", "", "P" * 100_000, 1)]
    df = spark.createDataFrame(rows, "f string, authors string, aff string, pos int")
    got = {tuple(r) for r in split_values(df, "f", {"authors": "people", "aff": "places"}).collect()}
    assert got == {("a", "authors", 1, "X Yz"), ("a", "authors", 2, "B Cd"), (None, "authors", 1, "Q Rs"), ("b", "aff", 1, "P" * 100_000)}
    assert split_values(df.limit(0), "f", {"authors": "people"}).count() == 0


def test_null_among_whole_keys(spark):
    big = 2**60 + 1
    df = spark.createDataFrame([(big, "A Bc"), (None, "C De")], "f bigint, a string")
    assert {(r["f"], r["value"]) for r in split_values(df, "f", {"a": "people"}).collect()} == {(big, "A Bc"), (None, "C De")}


def test_bracket_under_many_openers():
    for k in (1, 7, 8, 9, 500):
        assert split_text(f"[a {'(' * k} b; c]; d", "places") == [f"[a {'(' * k} b; c]", "d"]


def test_no_limit_behind_a_quote_or_within_brackets():
    for blanks in (0, 1, 40, 400):
        assert split_text('"Ana; Bo"' + " " * blanks + "x", "people") == split_text('"Ana; Bo" x', "people") if blanks else True
        assert split_text('"Ana; Bo"' + " " * blanks + "; Cy", "people") == ["Ana; Bo", "Cy"]
    for depth in (1, 7, 8, 9, 50):
        assert split_text("{" + "[" * depth + " a; b } c", "people") == ["{" + "[" * depth + " a; b } c"]
