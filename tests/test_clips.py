"""Clips: what the registered queries over composed pages don't reach."""

import pytest
from pyspark.sql import functions as F

from quizloom.operators import clips, split, starts

WORD = "doc string, page int, x0 double, y0 double, x1 double, y1 double, text string"
PAGES = "doc string, page int, right double, bottom double"
BAND = "doc string, page int, question int, x0 double, y0 double, x1 double, y1 double"


def word(page, x, y, text, doc="d"):
    return (doc, page, float(x), float(y), float(x) + 8, float(y) + 10, text)


def line(page, y, text, x=70, doc="d"):
    return [word(page, x + 30 * i, y, t, doc) for i, t in enumerate(text.split())]


def pages_of(spark, n, doc="d"):
    return spark.createDataFrame([(doc, p, 595.0, 842.0) for p in range(1, n + 1)], PAGES)


def none(spark):
    return spark.createDataFrame([], "doc string, page int, x0 double, y0 double, x1 double, y1 double")


# ---------------------------------------------------------------- numbered lines


@pytest.mark.parametrize("body,after,style,want", [
    ("Which is it?", None, "mcq", True), ("hours", None, "mcq", False), ("Information about two substances is given in the table", None, "mcq", True), ("Information", None, "mcq", False),
    ("Blank page", None, "structured", False), ("Reactions of anions and their tests in solution", None, "structured", False), ("12 34", None, "mcq", False), ("Sodium", None, "mcq", True),
    ("Zinc oxide forms", None, "mcq", False), ("Zincoxideformsinairwhenitisheatedforlongenough", None, "mcq", True),
    ("", "Explain it", "mcq", True), ("", "A", "mcq", False), ("", "13", "mcq", False), ("", "Candidate number", "mcq", False), ("", None, "mcq", False),
    ("", "(a) State it", "structured", True), ("", "(a)(i) State it", "structured", True), ("", "(b) State it", "structured", False), ("", "Explain it", "structured", False), (None, None, "mcq", False),
])
def test_lines_that_may_open_a_question(spark, body, after, style, want):
    df = spark.createDataFrame([(body, after, style)], "body string, after string, style string")
    assert df.select(starts.plausible(F.col("body"), F.col("after"), F.col("style"))).first()[0] is want


@pytest.mark.parametrize("body,want", [("9 Bromine", starts.PAGE_NUMBER), ("1 mole of gas is heated", starts.STEM_LIKE), ("BLANK PAGE", starts.BLANK_PAGE), ("Which", starts.STEM_LIKE), ("", starts.PLAIN), ("x y z", starts.PLAIN)])
def test_classes_of_lines(spark, body, want):
    assert spark.range(1).select(starts.line_class(F.lit(body))).first()[0] == want


@pytest.mark.parametrize("rows,want", [
    ([(0, 1, 0), (3, 3, 0), (5, 2, 0), (9, 3, 0)], [0, 5, 9]),  # an early 3 is behind nothing
    ([(0, 1, 0), (2, 2, 1), (5, 2, 0), (9, 3, 1)], [0, 5, 9]),  # the better 2 wins though it comes later
    ([(0, 1, 0), (2, 2, 1), (5, 2, 1)], [0, 2]),  # the first of equals
    ([(0, 1, 2), (4, 2, 0), (5, 4, 0), (6, 3, 3)], [4, 5]),  # page numbers are never taken, gaps are left out
    ([(3, 2, 0), (1, 40, 0), (9, 40, 1)], [3, 9]), ([], []),
])
def test_the_best_line_after_the_last(spark, rows, want):
    df = spark.createDataFrame([(rows,)], "c array<struct<n:int,num:int,class:int>>")
    assert df.select(starts.best_picks(F.col("c"))).first()[0] == want


def test_a_paper_with_notes_behind_it(spark):
    text = "Answer all.\n1 Explain what is meant by this.\n(a) x\n2 Describe the flame of it here.\nQualitative analysis notes\n3 State what the notes say of it.\n"
    got = split.questions(spark.createDataFrame([("d", text)], "doc string, text string")).orderBy("ord").collect()
    assert [r.question for r in got] == ["1", "2"] and "notes" not in got[1].text


# ---------------------------------------------------------------- texts


def test_lines_of_a_band(spark):
    words = spark.createDataFrame([word(1, 90, 102, "b"), word(1, 60, 100, "a"), word(1, 60, 130, "c"), word(1, 10, 100, "left"), word(1, 60, 300, "low"), word(2, 60, 100, "page")], WORD)
    bands = spark.createDataFrame([("d", 1, 1, 40.0, 90.0, 563.0, 200.0), ("d", 3, 2, 40.0, 90.0, 563.0, 200.0)], BAND)
    got = {r.question: (r.lines, r.text, r.y1) for r in clips.band_texts(bands, words, ["doc", "page", "question"]).collect()}
    assert got == {1: (["a b", "c"], "a b\nc", 200.0), 2: ([], "", 200.0)}


@pytest.mark.parametrize("q,lines,want", [
    (3, ["3 Explain", "more", "A x"], True), (3, ["35 Explain", "more", "A x"], False), (3, ["– x+y+", "3Explain it", "more", "more"], True), (3, ["Cambridge Assessment is", "3 Explain", "a", "b"], True),
    (3, ["words first", "3 Explain", "a"], False), (3, ["3 Calcium reacts with water"], False), (31, ["31 Calcium reacts with water"], True), (3, ["3 Calcium is A or B or C"], True), (3, [], False), (3, ["3"], True),
])
def test_a_clip_shows_its_question(spark, q, lines, want):
    df = spark.createDataFrame([(q, lines)], "q int, lines array<string>")
    assert df.select(clips.shows_question(F.col("q"), F.col("lines"))).first()[0] is want


@pytest.mark.parametrize("q,text,want", [
    (1, "1 Stem\n2 Where is it", True), (1, "1 Stem\n2\t\x07Carbon is", True), (1, "1 Stem\n2\nB", False), (1, "1 Stem\n3 Where", False), (1, "1 Stem 2 Where", False), (1, "1 Stem\n2 Fig", False),
    (40, "40 Stem\n41 Where", False), (31, "31 Which\n32 Calcium\nresponses A to D\n33 x", False), (31, "31 Which\n32 Calcium\nresponses A to D\n32 Where is", True), (1, "", False), (1, None, False),
])
def test_a_clip_goes_on_into_the_next_question(spark, q, text, want):
    got = spark.createDataFrame([(q, text)], "q int, t string").select(F.coalesce(clips.opens_next(F.col("q"), F.col("t")), F.lit(False))).first()[0]
    assert got is want


# ---------------------------------------------------------------- questions over pages


def test_a_question_over_three_pages_and_what_stops_it(spark):
    rows = [word(1, 50, 100, "1"), *line(1, 100, "Explain the thing"), *line(1, 130, "more of it"), *line(1, 160, "and more"), *line(2, 200, "whole page"), *line(3, 80, "rest"),
            word(3, 50, 300, "2"), *line(3, 300, "Describe the other"), *line(3, 330, "more"), *line(3, 360, "more"), word(4, 50, 100, "1"), *line(4, 200, "Qualitative far too low"),
            word(5, 60, 100, "Qualitative"), word(5, 130, 100, "analysis"), *line(6, 300, "behind the heading")]
    got = clips.structured_clips(spark.createDataFrame(rows, WORD), pages_of(spark, 6), none(spark)).orderBy("question", "band").collect()
    assert [(r.question, r.band, r.page, r.y0, r.y1) for r in got] == [
        (1, 1, 1, 96.0, 180.0), (1, 2, 2, 48.0, 220.0), (1, 3, 3, 48.0, 100.0),
        (2, 1, 3, 296.0, 380.0), (2, 2, 4, 48.0, 220.0), (2, 3, 5, 48.0, 94.0),  # an earlier number on page 4 doesn't end question 2; a heading does
    ]


def test_the_first_valid_clip_wins(spark):
    rows = [word(1, 50, 100, "3"), *line(1, 100, "Calcium reacts with water"), word(2, 50, 100, "3"), *line(2, 100, "Explain the thing"), *line(2, 130, "more"), *line(2, 160, "more")]
    got = clips.structured_clips(spark.createDataFrame(rows, WORD), pages_of(spark, 2), none(spark)).collect()
    assert [(r.question, r.page) for r in got] == [(3, 2)]


def test_practical_papers_keep_their_right_margin(spark):
    rows = [word(1, 50, 100, "1"), *line(1, 100, "Explain the thing"), *line(1, 130, "more of it"), *line(1, 160, "and more")]
    pages = pages_of(spark, 1).withColumn("practical", F.lit(True))
    assert clips.structured_clips(spark.createDataFrame(rows, WORD), pages, none(spark)).first().x1 == 595.0


def key(page, y):
    return [*line(page, y, "responses A to D", 60), *line(page, y + 15, "A B C D", 60), *line(page, y + 30, "1, 2 and 3", 60), *line(page, y + 50, "No other combination of statements is used as a correct response.", 60)]


def asking(page, y, q):
    return [word(page, 50, y, str(q)), *line(page, y, "Which statements are correct?"), *[w for i, t in enumerate(("Apples", "Bears", "Cats"), 1) for w in line(page, y + 20 * i, f"{i} {t}", 71)]]


@pytest.mark.parametrize("keys,want", [
    ([(1, 20), (1, 400)], 398.0), ([(1, 20)], 18.0), ([(2, 20)], 18.0), ([(2, 600)], None), ([], None),
])
def test_the_key_below_before_the_one_above_before_the_next_page(spark, keys, want):
    rows = [*asking(1, 200, 31), word(1, 50, 300, "32"), *line(1, 300, "What is it"), *line(1, 330, "A x B y C z D w")] if keys and keys[0] != (2, 20) else asking(1, 200, 31)
    rows += [word(2, 50, 500, "33"), *line(2, 500, "What is it"), *line(2, 530, "A x B y C z D w")] + [w for k in keys for w in key(*k)]
    got = clips.choice_clips(spark.createDataFrame(rows, WORD), pages_of(spark, 2), none(spark)).filter("question = 31").orderBy("band").collect()
    assert [r.y0 for r in got] == ([196.0, want] if want is not None else [])


def test_a_key_two_pages_back_and_none_three_back(spark):
    rows = key(1, 20) + asking(3, 200, 31) + asking(4, 200, 32)
    got = clips.choice_clips(spark.createDataFrame(rows, WORD), pages_of(spark, 4), none(spark)).collect()
    assert sorted((r.question, r.band, r.page) for r in got) == [(31, 1, 3), (31, 2, 1)]


def test_options_must_show(spark):
    rows = [word(1, 50, 100, "1"), *line(1, 100, "What is it"), *line(1, 130, "A x B y C z"), word(1, 50, 300, "2"), *line(1, 300, "What is it"), *line(1, 330, "A x"), *line(1, 350, "B x"), *line(1, 370, "C x"), *line(1, 390, "D x")]
    got = clips.choice_clips(spark.createDataFrame(rows, WORD), pages_of(spark, 1), none(spark)).collect()
    assert [r.question for r in got] == [2]


# ---------------------------------------------------------------- parts


def test_parts_and_their_shared_stem(spark):
    rows = [word(1, 50, 100, "1"), *line(1, 100, "Explain"), *line(1, 150, "(a) State"), *line(1, 300, "(b) This is about it"), *line(1, 320, "(i) Give"), *line(2, 200, "(ii) Draw"), *line(2, 200, "(x) far", 200),
            word(3, 50, 100, "2"), *line(3, 100, "(a) Next"), *line(3, 200, "(v) no letter before? its letter is a"), *line(4, 100, "BLANK PAGE")]
    got = clips.part_clips(spark.createDataFrame(rows, WORD), pages_of(spark, 4)).orderBy("label", "band").collect()
    assert [(r.label, r.page, r.y0, r.y1) for r in got] == [
        ("1(a)", 1, 96.0, 298.0), ("1(b)(i)", 1, 96.0, 148.0), ("1(b)(i)", 1, 298.0, 806.0), ("1(b)(i)", 2, 48.0, 198.0),
        ("1(b)(ii)", 1, 96.0, 148.0), ("1(b)(ii)", 1, 298.0, 318.0), ("1(b)(ii)", 2, 198.0, 806.0), ("1(b)(ii)", 3, 48.0, 94.0),
        ("2(a)(v)", 3, 98.0, 806.0),
    ]


def test_bands_are_merged_only_on_their_page(spark):
    rows = [("d", "x", 1, 40.0, 100.0, 500.0, 200.0), ("d", "x", 1, 30.0, 212.0, 510.0, 300.0), ("d", "x", 1, 40.0, 150.0, 500.0, 160.0), ("d", "x", 1, 40.0, 313.0, 500.0, 320.0), ("d", "x", 2, 40.0, 320.0, 500.0, 330.0)]
    got = clips.merged(spark.createDataFrame(rows, "doc string, label string, page int, x0 double, y0 double, x1 double, y1 double"), ["doc", "label"]).orderBy("page", "y0").collect()
    assert [(r.page, r.x0, r.y0, r.x1, r.y1) for r in got] == [(1, 30.0, 100.0, 510.0, 300.0), (1, 40.0, 313.0, 500.0, 320.0), (2, 40.0, 320.0, 500.0, 330.0)]


def test_empty_tables(spark):
    words = spark.createDataFrame([], WORD)
    assert clips.structured_clips(words, pages_of(spark, 2), none(spark)).isEmpty() and clips.choice_clips(words, pages_of(spark, 2), none(spark)).isEmpty() and clips.part_clips(words, pages_of(spark, 2)).isEmpty()
    assert clips.scheme_rows(words, pages_of(spark, 2)).isEmpty()


def test_rows_of_a_scheme(spark):
    rows = [word(1, 50, 100, "1(a)"), word(1, 50, 105, "1(b)"), word(1, 50, 300, "1(a)"), word(2, 50, 570, "1(B)"), word(2, 50, 200, "2(a)(ii)"), word(2, 50, 400, "2(a)x")]
    got = clips.scheme_rows(spark.createDataFrame(rows, WORD), pages_of(spark, 2).withColumn("bottom", F.lit(595.0))).orderBy("label").collect()
    assert [(r.label, r.page, r.y0, r.y1) for r in got] == [("1(a)", 1, 52.0, 105.0), ("1(b)", 2, 570.0, 575.0), ("2(a)(ii)", 2, 52.0, 570.0)]
    assert [(r.question, r.page, r.band) for r in clips.scheme_clips(clips.scheme_rows(spark.createDataFrame(rows, WORD), pages_of(spark, 2))).orderBy("question", "band").collect()] == [(1, 1, 1), (1, 2, 2), (2, 2, 1)]
