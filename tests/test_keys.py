import pytest
from pyspark.sql import functions as F

from quizloom.functions import keys


def values(spark, kind, rows, column):
    return [r[0] for r in spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, v {kind}").orderBy("i").select(column).collect()]


def test_code_key_and_its_driver_twin(spark):
    codes = ["5", "5.1", "5.1b", " 23.1 ", "x", "x.2", "5.", "5.b", "2.10", ""]
    got = values(spark, "string", codes, keys.code_key(F.col("v")))
    assert [tuple(g) for g in got] == [keys.code_key_of(c) for c in codes]
    assert tuple(got[1]) == (5, 1) and tuple(got[2]) == (5, 1) and tuple(got[4]) == (keys.FAR, 0) and tuple(got[7]) == (5, keys.FAR)


def test_outcome_order(spark):
    los = ["5.1-10", "5.1-2", "5.2-1", "5.1-3b", "5.1-3a", "none"]
    df = spark.createDataFrame([(x,) for x in los], "v string")
    assert [r.v for r in df.orderBy(keys.outcome_key(F.col("v"))).collect()] == ["5.1-2", "5.1-3a", "5.1-3b", "5.1-10", "5.2-1", "none"]


def test_vocabulary_order(spark):
    df = spark.createDataFrame([("10",), ("2.1",), ("2",), ("2.10",), ("x",)], "v string")
    assert [r.v for r in df.orderBy(keys.vocabulary_key(F.col("v"))).collect()] == ["2", "2.1", "2.10", "10", "x"]


@pytest.mark.parametrize("label,want", [("2(a)(i)", (2, "a", "i")), ("2a-i", (2, "a", "i")), ("q12B", (12, "b", None)), ("3(c)", (3, "c", None)), ("x", None), ("2", None)])
def test_part_id(spark, label, want):
    (got,) = values(spark, "string", [label], keys.part_id(F.col("v")))
    assert (tuple(got) if got else None) == want


def test_part_order_and_names(spark):
    df = spark.createDataFrame([("q10a",), ("q2b",), ("q2a-ii",), ("q2a-i",), ("q2a-x",), ("q1",), ("zz",)], "v string")
    assert [r.v for r in df.orderBy(keys.part_key(F.col("v"))).collect()] == ["q1", "q2a-i", "q2a-ii", "q2a-x", "q2b", "q10a", "zz"]
    p = keys.part_id(F.col("v"))
    assert [tuple(r) for r in df.filter("v = 'q2a-ii'").select(keys.part_label(p), keys.part_slug(p)).collect()] == [("2(a)(ii)", "2a-ii")]


def test_names(spark):
    assert values(spark, "string", ["cie-9701-2021-mj-p21-q2a-i", "plain"], keys.id_prefix(F.col("v"))) == ["cie-9701-2021-mj-p21", "plain"]
    got = values(spark, "string", ["s21", "W80", "x21", "s2"], keys.season(F.col("v")))
    assert [tuple(g) if g else None for g in got] == [("MJ", 2021), ("ON", 1980), None, None]
    assert values(spark, "string", ["11", "1", "33", "42", "21", "x"], keys.paper_kind(F.col("v"))) == ["mcq", "mcq", "practical", "structured", "structured", "structured"]
    got = values(spark, "string", ["9701_s21_qp_12", "s21:12", "w20 4", "junk"], keys.paper_reference(F.col("v")))
    assert [tuple(g) if g else None for g in got] == [("s21", "12"), ("s21", "12"), ("w20", "4"), None]
    assert values(spark, "string", ["MJ", "on", "??"], keys.season_token(F.col("v"), F.lit(2005))) == ["s05", "w05", "x05"]
