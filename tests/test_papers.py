"""Operators that the registered queries over composed papers don't reach in full."""

import duckdb
import pytest

from pyspark.sql import functions as F

from quizloom import papers, queries
from quizloom.functions import keys, text
from quizloom.operators import assemble, enrich, relational, stats

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels".split()


@pytest.fixture(scope="module")
def plain():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", ["split_parts", "marks_bound_to_parts", "enrich_many_papers", "linked_ids", "grouped_handout", "drawing_lines", "report_questions"])
def test_queries_as_their_sql(spark, plain, name):
    got = queries.QUERIES[name](spark, SF)
    want = plain.execute(queries.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(map(repr, want.fetchall()))


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("line,salad", [(None, False), ("", False), ("  ", True), ("C H O", True), ("Cl− Br", True), ("C Cl", False), ("D OH", False), ("+ •", True), ("| C | H |", False), ("water H", False), ("XY Z C", False)])
def test_drawing_letters(spark, line, salad):
    assert one(spark, text.atom_salad(F.lit(line).cast("string"))) is salad


def test_options(spark):
    assert one(spark, text.option_lines(F.lit("A B C D\nx\nA 1 B 2 C 3"))) == "A\nB\nC\nD\nx\nA 1 B 2 C 3"
    body = "Stem\nA one\nB two\n\n\n\nend"
    assert one(spark, text.without_repeated_options(F.lit(body), F.lit(True))) == body
    assert one(spark, text.without_repeated_options(F.lit("s\nA one B two C six D ten\nB x"), F.lit(True))) == "s"


def test_names(spark):
    assert one(spark, keys.paper_meta(F.lit("notes"))) is None
    assert one(spark, keys.pairs(F.lit("a=1,b,a=2"))) == {"a": "2"} and one(spark, keys.pairs(F.lit(""))) == {}
    assert one(spark, text.last_marks(F.lit("no marks"))) is None


def test_reports_of_two_papers_stay_apart(spark):
    none = {c: None for c in (*enrich.KEPT_IF_NULL, *enrich.NULLED, "misconceptions", "common_errors", "er_year", "er_session", "er_paper", "examiner_report_source", "parent_question")}
    kinds = "id string, year int, session string, paper string, question string, difficulty int, parent_question string, misconceptions array<string>, common_errors array<string>, er_year int, er_session string, er_paper string, examiner_report_source string, examiner_band string, examiner_notes string, difficulty_source string, common_incorrect string, facility double, percent_correct double, discrimination double"
    rows = [{"id": f"{p}-{q}", "year": 2021, "session": "MJ", "paper": p, "question": q, "difficulty": 3} | none for p in ("11", "12", "13") for q in ("1", "2(a)")]
    questions = spark.createDataFrame([tuple(r[c.split()[0]] for c in kinds.split(", ")) for r in rows], kinds)
    reports = spark.createDataFrame([(2021, "MJ", "11", "1", "easy", 2, "C"), (2021, "MJ", "12", "1", "particularly_difficult", 5, None), (2021, "MJ", "12", "2", "easy", 2, None)], "year int, session string, paper string, question string, examiner_band string, difficulty int, common_incorrect string")
    reports = reports.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("common_errors", "array<string>"), ("examiner_notes", "string"), ("difficulty_source", "string"), *((c, "double") for c in enrich.NULLED))])
    got = {r.id: (r.difficulty, r.er_paper, r.misconceptions) for r in enrich.merge_reports(questions, reports, None, "er").collect()}
    assert got == {"11-1": (2, "11", ["Common wrong option: C"]), "11-2(a)": (3, "11", None), "12-1": (5, "12", []), "12-2(a)": (2, "12", []), "13-1": (3, None, None), "13-2(a)": (3, None, None)}


def test_numbers_and_states(spark):
    rows = spark.createDataFrame([(f"q{i}", i) for i in range(1, 9001, 3)], "id string, seq long")
    kept = assemble.prune(rows, rows.filter("seq % 2 = 1").select("seq")).orderBy("seq").collect()
    assert [r.seq for r in kept] == list(range(1, 1501)) and kept[1].id == "q7"
    states = spark.createDataFrame([("a", 2, True, 0), ("b", 1, False, 1), ("c", 0, False, 0)], "q string, seen int, ok boolean, mistakes int")
    assert stats.progress(states).first().asDict() == {"seen": 2, "wrong": 1, "acc": 50} and stats.progress(states.limit(0)).first().acc is None
    files = spark.createDataFrame([("b/1",), ("a/1",), ("../s",)], "path string")
    wanted = spark.createDataFrame([(1, ["../s", "c/1", "a/1", "b/1"]), (2, ["../s"])], "id long, c array<string>")
    assert [tuple(r) for r in relational.first_existing(wanted, F.col("c"), files, "id").collect()] == [(1, "a/1")]
    assert papers.SALAD.count(True) == 3
