import pytest
from pyspark.sql import functions as F

from quizloom import schemas
from quizloom.operators import audit, enrich, geometry, registry, relational
from quizloom.sources import readers, writers

TREE = """
topics:
  - code: 5
    title: Energetics
    level: AS
    subtopics:
      - code: "5.1"
        title: Enthalpy
        learning_outcomes: [{id: 5.1-1, text: define}, {id: 5.1-2a, text: use}]
  - code: 23
    title: Lattice
    level: A
    subtopics: [{code: "23.1", title: Cycles}]
"""


@pytest.fixture(scope="module")
def words(spark, tmp_path_factory):
    p = tmp_path_factory.mktemp("v") / "v.yaml"
    p.write_text(TREE)
    return enrich.vocabulary(readers.vocabulary(spark, str(p)))


def test_vocabulary(spark, words):
    codes, los = words
    assert {r.code: r.title for r in codes.collect()} == {"5": "Energetics [AS]", "5.1": "Enthalpy", "23": "Lattice [A]", "23.1": "Cycles"}
    assert {(r.lo_id, r.parent_code, r.level) for r in los.collect()} == {("5.1-1", "5.1", "AS"), ("5.1-2a", "5.1", "AS")}
    assert {r.code for r in enrich.of_level(codes.select("code"), codes).collect()} == {"5", "5.1"}
    q = spark.createDataFrame([("a", ["5.1-2a", "x", "5.1-1"]), ("b", [])], "id string, lo array<string>")
    assert [tuple(r) for r in enrich.unknown_values(q, "lo", los, "lo_id").collect()] == [("x", "a")]
    assert {r.id: r.texts for r in enrich.looked_up(q, "lo", los, "lo_id", "text", "texts").collect()} == {"a": ["use", "define"], "b": []}


def test_codes_cover_outcomes(spark):
    rows = [(["5.1"], ["5.1-1", "5.2-2a"]), (["5"], ["5.2-1"]), ([" 2.1", "2.1"], [])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, c array<string>, l array<string>").orderBy("i")
    assert [r[0] for r in df.select(enrich.covered_codes(F.col("c"), F.col("l"))).collect()] == [["5.1", "5.2"], ["5"], ["2.1"]]


def test_checked_tags(spark):
    df = spark.createDataFrame([("a", ["recall", "recall", "odd"], "essay", None, ["5.1"], None), ("b", None, None, 9, [], None)], "id string, skills array<string>, question_type string, difficulty int, syllabus_codes array<string>, learning_outcomes array<string>")
    got = {r.id: r for r in enrich.checked_tags(df).collect()}
    assert (got["a"].skills, got["a"].question_type, got["a"].difficulty, got["a"].problems) == (["recall"], "mcq", 2, [])
    assert got["b"].problems == ["no_codes", "difficulty_range"]


def question(i, label, parent=None, **more):
    row = dict.fromkeys(schemas.QUESTION.names) | {"id": i, "question": label, "parent_question": parent, "difficulty": 3} | more
    return tuple(row[n] for n in schemas.QUESTION.names)


def test_reports(spark):
    er = [(2021, "MJ", "11", "7", "C", "easy", 2, "q", None, None, None, None, None, None), (2021, "MJ", "11", "14", "A", "particularly_difficult", 5, "q", "C", ["Most chose C."], "Hard.", None, None, None)]
    reports = spark.createDataFrame(er, schemas.REPORT_QUESTION)
    rows = [question("a", "7", examiner_notes="kept"), question("b", "14(a)(i)", misconceptions=["old", "Most chose C."], facility=0.4), question("c", "14(b)", "14"), question("d", "1", er_year=1999, facility=0.5)]
    got = {r.id: r for r in enrich.merge_reports(spark.createDataFrame(rows, schemas.QUESTION), reports, {"year": 2021, "session": "MJ", "paper": "11"}, "er.json").collect()}
    assert (got["a"].difficulty, got["a"].examiner_notes, got["a"].examiner_band) == (2, "kept", "easy")
    assert (got["b"].difficulty, got["b"].facility, got["b"].misconceptions) == (5, None, ["old", "Most chose C.", "Common wrong option: C"])
    assert got["c"].common_incorrect == "C" and got["d"].difficulty == 3 and got["d"].er_year == 1999 and got["d"].er_session == "MJ" and got["d"].facility == 0.5


def test_audit(spark, words):
    rows = [("ok", "mcq", None, ["5.1-1"], ["5.1"], "![[assets/ok-paper.png]]\nA stem", None, None), ("bad", "mcq", None, [], ["9.9"], "Page 1 of 2 ", 0.5, None), ("p", "practical", "Brewing", [], [], "![[x]]", None, None)]
    notes = spark.createDataFrame(rows, "id string, question_type string, practical_topic string, learning_outcomes array<string>, syllabus_codes array<string>, body string, facility double, percent_correct double")
    files = spark.createDataFrame([("assets/ok-paper.png", 9000, 800, 400), ("assets/p-paper.png", 10, 8, 8)], schemas.FILES)
    found = audit.record_findings(notes).unionByName(audit.text_findings(notes)).unionByName(audit.vocabulary_findings(notes, *[w.select(w.columns[0]) for w in words])).unionByName(audit.file_findings(notes, files))
    got = {(r.id, r.code) for r in found.collect()}
    assert got == {("bad", "empty_LO"), ("bad", "invented_facility"), ("bad", "footer_leak"), ("bad", "pua_chars"), ("bad", "unknown_code"), ("bad", "missing_paper_png"), ("bad", "missing_paper_embed"),
                   ("p", "unknown_practical_topic"), ("p", "empty_question_body"), ("p", "missing_paper_embed"), ("p", "tiny_paper_png")}
    assert tuple(audit.summary(notes, found).first()) == (3, 2, 1)
    assert audit.by_code(found).first().code == "missing_paper_embed"


def test_registry(spark):
    old = spark.createDataFrame([("p1", 2021, "s21", "11", "notes", "pending"), ("p2", 2020, "w20", "21", "", "tagged")], "id string, year int, season string, paper string, notes string, status string")
    new = spark.createDataFrame([("p1", "", "exported"), ("p3", "n", "pending")], "id string, notes string, status string")
    got = {r.id: (r.notes, r.status, r.year) for r in registry.upsert(old, new).collect()}
    assert got == {"p1": ("notes", "exported", 2021), "p2": ("", "tagged", 2020), "p3": ("n", "pending", None)}
    some = lambda *i: spark.createDataFrame([(x,) for x in i], "id string")
    assert {r.id: r.status for r in registry.status(old, some("p1", "p2"), some("p2"), some()).collect()} == {"p1": "extracted", "p2": "tagged"}


def test_overrides_and_fallbacks(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, v string")
    assert {r.id: r.v for r in enrich.overridden(rows, spark.createDataFrame([("a", "z")], "id string, v string"), "id", ["v"]).collect()} == {"a": "z", "b": "y"}
    keyed = spark.createDataFrame([("k2", "second")], "key string, value string")
    got = enrich.with_fallback(spark.createDataFrame([("k1", "k2"), ("k0", "k9")], "a string, b string"), keyed, ["a", "b"], "text")
    assert {r.a: r.text for r in got.collect()} == {"k1": "second", "k0": None}


BOX = "doc string, page int, ord int, x0 double, y0 double, x1 double, y1 double"


def test_bands_and_overlap(spark):
    words_ = spark.createDataFrame([("d", 1, 1, 50.0, 100.0, 55.0, 110.0, "1"), ("d", 1, 2, 50.0, 300.0, 55.0, 310.0, "2"), ("d", 1, 3, 50.0, 500.0, 55.0, 510.0, "1"), ("d", 1, 4, 200.0, 90.0, 205.0, 99.0, "3"), ("d", 1, 5, 50.0, 90.0, 55.0, 99.0, "x")], BOX + ", text string")
    bands = geometry.question_bands(words_)
    assert {(r.question, r.y0, r.y1) for r in bands.collect()} == {(1, 100.0, 300.0), (2, 300.0, 800.0)}
    items = spark.createDataFrame([("d", 1, 1, 280.0, 340.0), ("d", 1, 2, 250.0, 330.0)], "doc string, page int, item int, y0 double, y1 double")
    assert {r.item: r.question for r in geometry.best_overlap(items, bands, ["doc", "page"]).collect()} == {1: 2, 2: 1}


def test_folds(spark):
    boxes = spark.createDataFrame([("d", 1, 1, 0.0, 0.0, 10.0, 10.0), ("d", 1, 2, 12.0, 2.0, 20.0, 12.0), ("d", 1, 3, 40.0, 4.0, 50.0, 12.0), ("d", 1, 4, 0.0, 60.0, 9.0, 70.0)], BOX)
    banded = geometry.bands(boxes)
    assert {r.ord: r.band for r in banded.collect()} == {1: 0, 2: 0, 3: 0, 4: 1}
    assert {r.ord: r.group for r in geometry.x_groups(banded).collect()} == {1: 1, 2: 1, 3: 2, 4: 1}
    over = spark.createDataFrame([("d", 1, 1, 0.0, 0.0, 10.0, 10.0), ("d", 1, 2, 1.0, 1.0, 9.0, 9.0), ("d", 1, 3, 8.0, 8.0, 20.0, 20.0)], BOX)
    assert sorted(r.ord for r in geometry.larger_of_overlapping(over).collect()) == [1, 3]
    inside = geometry.inside(boxes, over.filter("ord = 3")).collect()
    assert [(r.ord, r.box) for r in inside] == []


def test_notes_and_hubs(spark):
    df = spark.createDataFrame([("a", 2, ["a-paper.png"], "stem", None)], "id string, marks int, figures array<string>, body string, ms string")
    text = df.select(writers.note(["id", "marks"], {"Question": F.col("body"), "Mark scheme": F.col("ms")}, F.col("figures"))).first()[0]
    assert text == '---\n{"id":"a","marks":2}\n---\n\n![[a-paper.png]]\n\n## Question\n\nstem'
    index = spark.createDataFrame([("5.1", ["a", "b"])], "code string, ids array<string>")
    assert writers.hub(index, spark.createDataFrame([("5.1", "Enthalpy")], "code string, title string")).first().value == "# 5.1 Enthalpy\n\n- [[a]]\n- [[b]]"
    long_ = df.select(writers.wikilink(F.lit("x"), F.lit("y" * 200))).first()[0]
    assert long_.endswith("…]]") and len(long_) == len("[[x|") + 100 + 3


def test_find_or_create(spark):
    known = spark.createDataFrame([("a", "1")], "name string, no string")
    seen = spark.createDataFrame([("a", "1"), ("b", "2"), ("b", "2")], "name string, no string")
    assert [tuple(r) for r in relational.find_or_create(known, seen, ["name", "no"]).collect()] == [("b", "2")]
