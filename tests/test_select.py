import json

import pytest
from pyspark.sql import functions as F

from quizloom.operators import assemble, relational
from quizloom.plans.rules import RuleError, SelectRules, select
from quizloom.sources import readers, writers

RECORDS = [
    ("s18/tagged/q5", "b-2018-q5", 2018, "11", "5", 1, ["5.1"], "mcq", 2),
    ("s20a/tagged/q8", "b-2020-q8", 2020, "11", "8", 1, ["5.1"], "mcq", 3),
    ("s20b/tagged/q8", "b-2020-q8", 2020, "11", "8", 1, ["5.1"], "mcq", 3),
    ("s21/tagged/q9a", "b-2021-q9a", 2021, "21", "9(a)", 2, ["5.1"], "structured", 3),
    ("s22/tagged/q9", "b-2022-q9", 2022, "12", "9", 1, ["2.2"], "mcq", 1),
    ("s23/tagged/q10", "b-2023-q10", 2023, "11", "10", 1, ["5.1", "5.2"], "mcq", 4),
]


@pytest.fixture(scope="module")
def bank(spark):
    rows = [(*r, [f"Topic {r[6][0]}"]) for r in RECORDS]
    return spark.createDataFrame(rows, "_path string, id string, year int, paper string, question string, marks int, syllabus_codes array<string>, question_type string, difficulty int, topic_titles array<string>")


def ids(df):
    return [r.id[-3:].strip("-") for r in df.collect()]


@pytest.mark.parametrize(
    "rules,want",
    [
        ({"syllabus_codes": ["5.1"]}, ["-q5", "-q8", "q9a", "q10"]),
        ({"syllabus_codes": ["5.1"], "count": 2}, ["-q5", "-q8"]),
        ({"syllabus_codes": ["5.1"], "year_min": 2020, "year_max": 2021}, ["-q8", "q9a"]),
        ({"syllabus_codes": ["5.1"], "exclude_after": "5.2"}, ["-q5", "-q8", "q9a"]),
        ({"question_type": "STRUCTURED"}, ["q9a"]),
        ({"topic_title": "topic 2"}, ["-q9"]),
        ({"difficulty_min": 3, "difficulty_max": 3}, ["-q8", "q9a"]),
        ({"max_marks": 1, "sort": "question"}, ["-q5", "-q8", "-q9", "q10"]),
        ({"max_marks": 0}, []),
        ({"sort": ["marks", "year"]}, ["-q5", "-q8", "-q9", "q10", "q9a"]),
    ],
)
def test_rules(bank, rules, want):
    assert ids(select(bank, SelectRules.of({"title": "t"} | rules))) == [w.strip("-") for w in want]


def test_first_path_wins_however_rows_are_dealt(bank):
    for n in (1, 3, 7):
        rows = select(bank.repartition(n), SelectRules.of({"title": "t"})).filter("id = 'b-2020-q8'").collect()
        assert [r._path for r in rows] == ["s20a/tagged/q8"]


def test_shuffle_repeats_and_keeps_the_rows(bank):
    rules = SelectRules.of({"title": "t", "shuffle": True, "seed": 7})
    a, b = ids(select(bank, rules)), ids(select(bank.repartition(5), rules))
    assert a == b and sorted(a) == sorted(ids(select(bank, SelectRules.of({"title": "t"}))))


def test_missing_values(spark, bank):
    none = bank.limit(1).select(F.lit("z").alias("_path"), F.lit("n").alias("id"), *[F.lit(None).cast(t).alias(c) for c, t in bank.dtypes if c not in ("_path", "id")])
    both = bank.unionByName(none)
    assert "n" in [r.id for r in select(both, SelectRules.of({"title": "t", "exclude_after": "1.1"})).collect()]
    assert "n" not in [r.id for r in select(both, SelectRules.of({"title": "t", "year_min": 0})).collect()]
    assert select(bank.limit(0), SelectRules.of({"title": "t"})).count() == 0


@pytest.mark.parametrize("raw", [None, [], {}, {"title": " "}, {"title": "t", "syllabus_codes": []}, {"title": "t", "year_min": True}, {"title": "t", "count": "2"}, {"title": "t", "count": -1}, {"title": "t", "exclude_after": 5}, {"title": "t", "sort": []}, {"title": "t", "shuffle": 1}])
def test_bad_rules(raw):
    with pytest.raises(RuleError):
        SelectRules.of(raw)


def test_scan_keeps_what_can_be_used(spark, tmp_path):
    files = {
        "a/tagged/q1.json": {"id": "one", "year": "2021", "syllabus_codes": ["5.1", 5.2], "odd": {"x": 1}},
        "a/tagged/q2.json": [1, 2],
        "a/tagged/q3.json": "{broken",
        "a/tagged/q4.json": {"id": "", "year": 2020},
        "a/other/q5.json": {"id": "outside"},
        "b/tagged/q6.json": {"id": "two"},
    }
    for name, what in files.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(what if isinstance(what, str) else json.dumps(what))
    got = {r.id: r for r in readers.questions(spark, str(tmp_path)).collect()}
    assert set(got) == {"one", "two"} and got["one"].year == 2021 and got["two"].syllabus_codes == []
    assert sorted(r.reason for r in readers.rejected_questions(spark, str(tmp_path)).collect()) == ["no_id", "not_json", "not_object"]


def test_pick_round_trip(spark, bank, tmp_path):
    rules = SelectRules.of({"title": "Énergie 5.1 (demo)", "syllabus_codes": ["5.1"]})
    picked = relational.numbered(select(bank, rules), rules.order(), "ord")
    writers.write_pick(writers.pick_payload(picked, rules, bank), str(tmp_path / "pick"))
    back = readers.pick(spark, str(tmp_path / "pick")).orderBy("ord").collect()
    assert [r.id for r in back] == ["b-2018-q5", "b-2020-q8", "b-2021-q9a", "b-2023-q10"] and back[0].slug == "nergie-5-1--demo"


def test_numbers_run_on_over_buckets(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("b"))
    one = {r.id: r.seq for r in relational.numbered(df, [F.col("b"), F.col("id")]).collect()}
    assert one == {r.id: r.seq for r in relational.numbered(df, [F.col("b"), F.col("id")], bucket=F.col("b")).collect()}


def question(i, year, label, los, texts=None, marks=1):
    return (f"q{i}", year, "MJ", "11", label, marks, los, texts, i)


HANDOUT = "id string, year int, session string, paper string, question string, marks int, learning_outcomes array<string>, learning_outcome_texts array<string>, ord int"


def test_primary_outcome(spark):
    rows = [["5.1-2", "5.1-3b"], ["5.1-10", "5.1-2"], ["5.1-3a", "5.1-3b", "5.1-3"], [], None, [" "]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v array<string>").orderBy("i")
    assert [r[0] for r in df.select(assemble.primary_outcome(F.col("v"))).collect()] == ["5.1-2", "5.1-2", "5.1-3", "", "", ""]


def test_groups_and_numbers(spark):
    rows = [question(1, 2021, "9", ["5.1-10"]), question(2, 2018, "2", ["5.1-2"], ["energy"]), question(3, 2018, "1", ["5.1-2"], ["heat"]), question(4, 2000, "1", None)]
    got = assemble.grouped(spark.createDataFrame(rows, HANDOUT).repartition(3)).orderBy("seq").collect()
    assert [(r.id, r.seq, r.primary) for r in got] == [("q3", 1, "5.1-2"), ("q2", 2, "5.1-2"), ("q1", 3, "5.1-10"), ("q4", 4, "")]
    assert {r.group_text for r in got if r.primary == "5.1-2"} == {"heat"}
    lines = [r.text for r in assemble.render(spark.createDataFrame(rows, HANDOUT)).orderBy("seq", "line").collect()]
    assert lines[0] == "### 5.1-2 — heat" and "**第1题 · 2018 MJ · Q1 · 1 分**" in lines and "### （未标 LO）" in lines


def test_prune_numbers_anew(spark):
    df = spark.createDataFrame([(i, f"q{i}") for i in range(1, 5)], "seq long, id string")
    keep = spark.createDataFrame([(" 3,1, x,0,-2,1",)], "s string").select(F.explode(assemble.parse_keep(F.col("s"))).alias("seq")).select(F.col("seq").cast("long"))
    assert [(r.seq, r.id) for r in assemble.prune(df, keep).orderBy("seq").collect()] == [(1, "q1"), (2, "q3")]


def test_totals_and_figures(spark):
    df = spark.createDataFrame([(1, ["b", "a"], ["x.png", "q-paper.png"]), (None, ["a", "c"], ["x.png"])], "marks int, topic_titles array<string>, figures array<string>").withColumn("ord", F.monotonically_increasing_id())
    assert tuple(assemble.totals(df).first()) == (2, 1)
    assert [r.value for r in assemble.listed(df, "topic_titles").orderBy("ord").collect()] == ["b", "a", "c"]
    assert [r[0] for r in df.orderBy("ord").select(assemble.paper_figure(F.col("figures"))).collect()] == ["q-paper.png", "x.png"]
