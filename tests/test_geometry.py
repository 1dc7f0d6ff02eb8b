import pytest
from pyspark.sql import functions as F

from quizloom import schemas
from quizloom.functions import text
from quizloom.operators import geometry


def span(i, x0, y0, x1, y1, t, size=11.0):
    return ("d", 1, i, float(x0), float(y0), float(x1), float(y1), t, size)


def test_tokens_and_lines(spark):
    spans = spark.createDataFrame([
        span(0, 50, 100, 60, 111, "CO"), span(1, 60, 106, 64, 112, "2", 7.0), span(2, 70, 100, 90, 111, "  gas"), span(3, 91, 100, 95, 111, ","), span(4, 95.5, 100, 120, 111, "then"),
        span(5, 50, 130, 60, 141, "Ca"), span(6, 60, 128, 66, 134, "2+", 7.0), span(7, 50, 160, 55, 170, "   "),
    ], schemas.SPANS)
    assert [r.body for r in geometry.body_sizes(spans).collect()] == [11.0]
    t = geometry.tokens(spans)
    assert [r.text for r in t.orderBy("ord").collect()] == ["CO₂", "gas", ",", "then", "Ca²⁺"]
    assert t.filter("text = 'gas'").first().x0 == pytest.approx(70 + 2 * 11 * 0.33)
    assert [r.text for r in geometry.page_lines(t.repartition(3)).orderBy("line").collect()] == ["CO₂ gas, then", "Ca²⁺"]


WORD = "doc string, page int, ord int, x0 double, y0 double, x1 double, y1 double, text string"


def word(i, x, y, t, w=8.0):
    return ("d", 1, i, float(x), float(y), float(x) + w, float(y) + 10, t)


def test_option_rows(spark):
    bands = spark.createDataFrame([("d", 1, 1, 90.0, 200.0), ("d", 1, 2, 200.0, 300.0)], "doc string, page int, question int, y0 double, y1 double")
    row = [word(i, 60 + 90 * i, 150 + i, c) for i, c in enumerate("ABCD")] + [word(9, 60, 190, "A")]
    column = [word(20 + i, 60, 210 + 20 * i, c) for i, c in enumerate("ABCD")]
    got = geometry.option_rows(spark.createDataFrame(row + column, WORD), bands).collect()
    assert [(r.question, r.x0, r.y0, r.x1, r.y1) for r in got] == [(1, 60.0, 150.0, 338.0, 163.0)]


def test_bottoms(spark):
    bands = spark.createDataFrame([("d", 1, 1, 40.0, 100.0, 550.0, 400.0), ("d", 1, 2, 40.0, 400.0, 550.0, 840.0), ("d", 1, 3, 40.0, 20.0, 550.0, 60.0)], "doc string, page int, question int, x0 double, y0 double, x1 double, y1 double")
    words = spark.createDataFrame([word(1, 50, 120, "stem"), word(2, 50, 500, "last"), word(3, 50, 600, "Permission"), word(4, 50, 620, "more"), word(5, 600, 300, "margin")], WORD)
    drawings = spark.createDataFrame([("d", 1, 1, 60.0, 150.0, 200.0, 250.0), ("d", 1, 2, 40.0, 390.0, 540.0, 390.5)], schemas.BOXES)
    got = {r.question: r.y1 for r in geometry.content_bottoms(bands, words, drawings).collect()}
    assert got == {1: 260.0, 2: 520.0, 3: 60.0}


@pytest.mark.parametrize("value,want", [("A one\nB two\nC three\nD four", "ABCD"), ("A 1 B 2 C 3 D", "ABCD"), ("responses A to D", "ABCD"), ("A B C D", "ABCD"), ("A stem only", "A"), ("no", "")])
def test_option_letters(spark, value, want):
    assert spark.range(1).select(text.option_letters(F.lit(value))).first()[0] == list(want)


@pytest.mark.parametrize("value,want", [("C Br C Br C C Br", True), ("Cl H O Br", True), ("A C", False), ("B Cl–", False), ("carbon and C", False), ("| C | H |", False), ("⁺ –", True), ("O", True), ("A", False), ("", False), (None, False)])
def test_atom_salad(spark, value, want):
    assert spark.range(1).select(text.atom_salad(F.lit(value).cast("string"))).first()[0] is want
