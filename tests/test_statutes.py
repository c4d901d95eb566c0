"""Statute trees of several jurisdictions, found level by level."""

import pytest

from codicil.operators import ingest as ig

ZA = """An Act to change the law
CHAPTER 2 Dispute resolution
Part A Commission
145. Review of arbitration awards
(1) Any party may apply
(a) within six weeks
(i) of service
(ii) of discovery
(b) later
(2) The court may stay
Provided that notice is given
146A. Exclusion
Part B Labour Court
151 Establishment
(1) A court is established"""
GB = """PART 1 General
CHAPTER 1 Terms
1 Interpretation
(1) In this Act
(g) gas
(h) heat
(i) ice
(j) jam
(2) Also
(h) heat
(i) first
(ii) second
(A) capital
Article 5 Liberty
(v) five
(vi) six"""
DE = """Buch 1 Allgemeines
Abschnitt 2 Personen
Titel 1 Natur
§ 1 Anfang
(1) Absatz
1. Nummer
a) Buchstabe
aa) doppelt
bb) zweimal
2. weiter
(2) Absatz zwei
§ 1a Zusatz
Buch 2 Schuld
§ 241 Pflichten"""
US = """Sec. 12 Scope
(a) first
(1) one
(A) capital
(i) roman
(ii) roman
(2) two
(b) second
§ 13 Next"""


@pytest.fixture(scope="module")
def trees(spark):
    rows = [(1, "za", "lra", ZA), (2, "gb", "era", GB), (3, "de", "bgb", DE), (4, "us", "code", US), (5, "gb", "e", ""), (6, None, "n", "(1) loose\n(a) more"), (7, "gb", "n", None)]
    docs = spark.createDataFrame(rows, "chunk_id bigint, jurisdiction string, act string, text string")
    return ig.detect_sections(docs), {r[0]: r[3] for r in rows}


def paths(trees, doc):
    return [(list(r.division), list(r.section_path), r.kind) for r in trees[0].where(f"chunk_id = {doc}").orderBy("first_line").collect()]


def test_za_chapters_hold_parts(trees):
    c, a, b = ["Chapter 2"], ["Chapter 2", "Part A"], ["Chapter 2", "Part B"]
    assert paths(trees, 1) == [
        ([], [], "preamble"), (c, [], "chapter"), (a, [], "part"), (a, ["145"], "section"), (a, ["145", "1"], "subsection"),
        (a, ["145", "1", "a"], "paragraph"), (a, ["145", "1", "a", "i"], "subparagraph"), (a, ["145", "1", "a", "ii"], "subparagraph"),
        (a, ["145", "1", "b"], "paragraph"), (a, ["145", "2"], "proviso"), (a, ["146A"], "section"),
        (b, [], "part"), (b, ["151"], "section"), (b, ["151", "1"], "subsection"),
    ]


def test_gb_letters_and_roman_numbers_are_told_apart(trees):
    got = [p for _, p, _ in paths(trees, 2)]
    assert got == [
        [], [], ["1"], ["1", "1"], ["1", "1", "g"], ["1", "1", "h"], ["1", "1", "i"], ["1", "1", "j"], ["1", "2"], ["1", "2", "h"],
        ["1", "2", "h", "i"], ["1", "2", "h", "ii"], ["1", "2", "h", "ii", "A"], ["5"], ["5", "v"], ["5", "vi"],
    ]
    assert paths(trees, 2)[5][0] == ["Part 1", "Chapter 1"]


def test_de_books_sections_and_numbers(trees):
    assert [(d, p) for d, p, _ in paths(trees, 3)][3:] == [
        (["Book 1", "Division 2", "Title 1"], p)
        for p in (["1"], ["1", "1"], ["1", "1", "1"], ["1", "1", "1", "a"], ["1", "1", "1", "a", "aa"], ["1", "1", "1", "a", "bb"], ["1", "1", "2"], ["1", "2"], ["1a"])
    ] + [(["Book 2"], []), (["Book 2"], ["241"])]


def test_us_order_of_parts(trees):
    assert [p for _, p, _ in paths(trees, 4)] == [
        ["12"], ["12", "a"], ["12", "a", "1"], ["12", "a", "1", "A"], ["12", "a", "1", "A", "i"], ["12", "a", "1", "A", "ii"],
        ["12", "a", "2"], ["12", "b"], ["13"],
    ]


def test_parents_headings_and_levels(trees):
    rows = {tuple(r.section_path): r for r in trees[0].where("chunk_id = 1").collect()}
    deep = rows["145", "1", "a", "ii"]
    assert (deep.section_no, deep.sub_no, deep.parent_no, deep.level, deep.heading) == ("145", "ii", "a", 4, "145. Review of arbitration awards")
    assert (rows["145",].sub_no, rows["145",].parent_no, rows["145",].level) == (None, None, 1)


def test_no_line_is_lost_and_loose_parts_are_kept(trees):
    for doc, text in trees[1].items():
        mine = trees[0].where(f"chunk_id = {doc}").orderBy("first_line").collect()
        assert "\n".join(r.text or "" for r in mine) == (text or "")
    assert [(r.level, r.section_no, r.sub_no, r.parent_no) for r in trees[0].where("chunk_id = 6").orderBy("first_line").collect()] == [
        (2, None, "1", None), (3, None, "a", "1")
    ]
