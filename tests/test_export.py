"""Export, versions of notes, rules as rows, staging and drawn symbols: what the registered queries don't reach."""

import pytest
from pyspark.sql import functions as F

from quizloom.functions import classify, text
from quizloom.functions.keyword_tables import BODY_KEYWORDS, FALLBACK_KEYWORDS, OUTCOME_KEYWORDS, STEM_KEYWORDS
from quizloom.operators import enrich, export, staging, symbols, tagging
from quizloom.sources import store

RECORD = "paper_id string, id string, question string, parent_question string, syllabus_codes array<string>, learning_outcomes array<string>"
FIGURE = "paper_id string, question string, path string, ord int"


@pytest.fixture(scope="module")
def gathered(spark):
    records = spark.createDataFrame([
        ("p", "x-q1ai", "1(a)(i)", "1", ["5.1"], ["5.1-1"]), ("p", "x-q1b", "1(b)", "1", ["5.1", "2.2"], []), ("p", "x-q10", "10", None, ["5.1"], [" "]),
        ("q", "y-q1", "1", None, ["5.1"], []), ("r", "z-q1", "1", None, ["5.1"], []),
    ], RECORD)
    drafts = spark.createDataFrame([
        ("p", "q1a-i", "Say it.\n© UCLES 2021\n--- MARK SCHEME ---\nM1 a"), ("p", "q1b", "What?\nA one B two C six D ten\n--- MARK SCHEME ---\n1 1 1 1 1 1"), ("p", "q10", "Ten"), ("q", "q1", "No clip"),
    ], "paper_id string, stem string, text string")
    figures = spark.createDataFrame([
        ("p", "1(a)(i)", "a/x-paper.png", 2), ("p", "1(a)(i)", "a/x-2-paper.png", 1), ("p", "1(b)", "a/y-paper.png", 1), ("p", "1(b)", "a/y-ms.png", 2), ("p", "1(b)", "a/y-1.png", 3), ("p", "10", "a/z-paper.png", 1), ("r", "1", "a/r-paper.png", 1),
    ], FIGURE)
    return export.gathered(records, drafts, figures).cache()


def test_records_with_their_drafts_and_figures(gathered):
    got = {r.id: r for r in gathered.collect()}
    assert got["x-q1ai"].body == "Say it." and got["x-q1ai"].mark_scheme == "M1 a" and got["x-q1ai"].paper_figures == ["a/x-2-paper.png", "a/x-paper.png"]
    assert got["x-q1b"].body == "What?" and got["x-q1b"].mark_scheme == "" and (got["x-q1b"].ms_figures, got["x-q1b"].diagram_figures) == (["a/y-ms.png"], ["a/y-1.png"])
    assert got["x-q10"].mark_scheme is None and {i: r.problem for i, r in got.items() if r.problem} == {"y-q1": "missing_paper_clip", "z-q1": "missing_draft"}


def test_marks_may_be_asked_for(spark, gathered):
    rows = gathered.select("paper_id", "id", "question", "syllabus_codes")
    drafts = spark.createDataFrame([("p", "q1a-i", "x"), ("p", "q1b", "x"), ("p", "q10", "x")], "paper_id string, stem string, text string")
    figures = spark.createDataFrame([("p", q, f"{q}{k}.png", 1) for q, k in (("1(a)(i)", "-paper"), ("1(b)", "-paper"), ("1(b)", "-ms"))], FIGURE)
    got = {r.id: r.problem for r in export.gathered(rows.filter("paper_id = 'p'"), drafts, figures, F.col("question").contains("(")).collect()}
    assert got == {"x-q1ai": "missing_ms_clip", "x-q1b": None, "x-q10": "missing_paper_clip"}


def test_notes_link_to_each_other(spark, gathered):
    rows, found = export.whole_papers(gathered)
    assert sorted((r.paper_id, r.problem) for r in found.collect()) == [("q", "missing_paper_clip"), ("r", "missing_draft")]
    titles = spark.createDataFrame([("5.1", "Energy")], "code string, title string")
    outcomes = spark.createDataFrame([("5.1-1", "5.1", "know it")], "lo_id string, parent_code string, text string")
    got = {r.path: r.value for r in export.notes(rows, titles, outcomes, ["id"]).collect()}
    assert sorted(got) == ["papers/p.md", "questions/p-q1.md", "questions/x-q10.md", "questions/x-q1ai.md", "questions/x-q1b.md", "syllabus/2.2.md", "syllabus/2.md", "syllabus/5.1.md", "syllabus/5.md", "syllabus/lo/5.1-1.md"]
    assert got["papers/p.md"] == "# p\n\n- [[x-q1ai]]\n- [[x-q1b]]\n- [[x-q10]]" and got["questions/p-q1.md"].endswith("[[papers/p]]\n\n- [[x-q1ai]]\n- [[x-q1b]]")
    assert got["syllabus/5.1.md"].startswith("# 5.1 Energy\n\nAbove: [[syllabus/5]]") and got["syllabus/5.md"] == "# 5" and "know it" in got["syllabus/lo/5.1-1.md"]
    note = got["questions/x-q1b.md"]
    assert note.index("![[a/y-paper.png]]") < note.index("## Question\n\nWhat?") < note.index("## Diagram") < note.index("## Mark Scheme") < note.index("- [[syllabus/5.1]]") < note.index("## Related\n\n- [[x-q10]]\n- [[x-q1ai]]")


@pytest.mark.parametrize("body,want", [
    ("Stem\nSection B\n\n12\nA B C D\nStatement goes on\n12\nend", "Stem\nStatement goes on\n12\nend"), ("1, 2 and 3 are correct\nx", "x"), ("1 only\nx\n\n\n\ny", "x\n\ny"), ("Stem\nThe responses A to D should", "Stem"), (None, None), ("", ""),
])
def test_the_shared_key_leaves_a_body(spark, body, want):
    assert spark.createDataFrame([(body,)], "b string").select(text.without_key(F.col("b"))).first()[0] == want


# ---------------------------------------------------------------- versions


def table(spark, rows):
    return spark.createDataFrame([(p, "note", v) for p, v in rows], "path string, kind string, value string")


def test_only_what_changed_is_written(spark, tmp_path):
    root = f"file://{tmp_path}/notes"
    assert store.current(spark, root).isEmpty()
    first = store.publish(table(spark, [("a", "1"), ("b/c", "2"), ("d", "3")]), root)
    assert {r.change for r in first.collect()} == {"new"} and first.count() == 3
    second = store.publish(table(spark, [("a", "1"), ("b/c", "22"), ("e", "5")]), root)
    assert sorted((r.path, r.value, r.change) for r in second.collect()) == [("b/c", "22", "changed"), ("d", None, "gone"), ("e", "5", "new")]
    assert store.publish(table(spark, [("a", "1"), ("b/c", "22"), ("e", "5")]), root).isEmpty() and len(list((tmp_path / "notes").glob("v*"))) == 2
    state = lambda: sorted((r.path, r.value) for r in store.current(spark, root).collect())
    assert state() == [("a", "1"), ("b/c", "22"), ("e", "5")]
    lost = tmp_path / "notes" / "v00000003"  # what a lost job leaves has no success mark
    lost.mkdir()
    (lost / "part-0.parquet").write_bytes(b"broken")
    assert state() == [("a", "1"), ("b/c", "22"), ("e", "5")]
    store.compact(spark, root)
    third = store.publish(table(spark, [("d", "again")]), root)
    assert sorted((r.path, r.change) for r in third.collect()) == [("a", "gone"), ("b/c", "gone"), ("d", "new"), ("e", "gone")] and state() == [("d", "again")]
    for old in ("v00000001", "v00000002"):  # a base needs nothing before it
        for f in (tmp_path / "notes" / old).iterdir():
            f.unlink()
        (tmp_path / "notes" / old).rmdir()
    assert state() == [("d", "again")]


def test_notes_as_files(spark, tmp_path):
    root, folder = f"file://{tmp_path}/notes", tmp_path / "vault"
    store.write_files(store.publish(table(spark, [("a.md", "1"), ("b/c.md", "é")]), root), f"file://{folder}")
    assert (folder / "b" / "c.md").read_text(encoding="utf-8") == "é"
    changed = store.publish(table(spark, [("a.md", "2")]), root)
    for _ in range(2):  # a repeated write changes nothing
        store.write_files(changed, f"file://{folder}")
    assert sorted(str(p.relative_to(folder)) for p in folder.rglob("*") if p.is_file()) == ["a.md"] and (folder / "a.md").read_text() == "2"
    with pytest.raises(Exception, match="no path inside the folder"):
        store.write_files(spark.createDataFrame([("../x.md", "v", False)], "path string, value string, gone boolean"), f"file://{folder}")


# ---------------------------------------------------------------- rules as rows


@pytest.fixture(scope="module")
def known(spark):
    codes = sorted({c for rules in (STEM_KEYWORDS, BODY_KEYWORDS, FALLBACK_KEYWORDS) for r in rules for c in r[1].split()} | {c for r in OUTCOME_KEYWORDS for c in r[1].split()})
    los = sorted({o for r in OUTCOME_KEYWORDS for o in r[2].split()} | {f"{c}-1" for c in codes})
    return spark.createDataFrame([(c,) for c in codes], "code string"), spark.createDataFrame([(o, o.split("-")[0]) for o in los], "lo_id string, parent_code string")


TAGS = [
    ("Use Hess's law.", ["5.1", "5.2"], ["5.1-5"], ["calculate"]), ("Draw the dot-and-cross diagram", ["3.7"], ["3.7-1"], ["draw"]), ("Which isotope is it?", ["1.2"], ["1.2-1"], ["recall"]),
    ("Say it with a mole of it", ["2.2"], ["2.2-1"], ["calculate", "recall"]), ("nothing known", ["2.2"], ["2.2-1"], ["recall"]), ("the structure of C2H6", ["13.1"], ["13.1-1"], ["recall"]),
    ("Calculate the\nenthalpy of it", ["5.1", "5.2"], ["5.1-1", "5.2-1"], ["calculate"]), ("What is a conjugate base of a Brønsted acid", ["7.2"], ["7.2-3"], ["recall"]), (None, ["2.2"], ["2.2-1"], ["recall"]),
]


def test_curated_rules(spark, known):
    records = spark.createDataFrame([(i, t[0]) for i, t in enumerate(TAGS)], "id int, body string")
    got = {r.id: (r.syllabus_codes, r.learning_outcomes, r.skills) for r in tagging.tagged(records, tagging.rule_rows(spark), *known).collect()}
    assert got == {i: t[1:] for i, t in enumerate(TAGS)}


def test_a_rule_of_unknown_topics_is_no_rule(spark):
    codes, outcomes = spark.createDataFrame([("5.2",), ("13.1",), ("1.1",)], "code string"), spark.createDataFrame([("13.1-4", "13.1"), ("5.1-5", "5.1")], "lo_id string, parent_code string")
    usable = tagging.known_rules(tagging.rule_rows(spark), codes, outcomes)
    assert {tuple(r.codes) for r in usable.collect()} == {("5.2",), ("13.1",)}
    records = spark.createDataFrame([(1, "Hess"), (2, "the isotope of an alcohol"), (3, "a skeletal formula"), (4, "none")], "id int, body string")
    got = {r.id: (r.syllabus_codes, r.learning_outcomes) for r in tagging.tagged(records, tagging.rule_rows(spark), codes, outcomes).collect()}
    assert got == {1: (["5.2"], ["5.1-5"]), 2: (["13.1"], ["13.1-4"]), 3: (["13.1"], ["13.1-4"]), 4: (["1.1"], [])}


def test_rules_and_the_case_chain_agree(spark):
    rules = [classify.Rule("(?i)b", ("2",)), classify.Rule("(?i)a", ("1",)), classify.Rule("", ("0",), scope="body")]
    rows = spark.createDataFrame([(i, "body", r.pattern, list(r.codes), [], ["recall"], False) for i, r in enumerate(rules)], tagging.RULES)
    df = spark.createDataFrame([("ab",), ("xa",), ("x",)], "t string")
    got = df.select(tagging.first_place(rows, F.col("t"), F.col("t")).alias("p"), classify.first_match(F.col("t"), F.col("t"), rules)["rule"].alias("q")).collect()
    assert [r.p for r in got] == [r.q for r in got] == [0, 1, 2]


def test_a_vocabulary_keeps_its_order_and_other_fields(spark):
    topics = spark.createDataFrame([
        ("2", "Two", 7, [("2.2", "b", "x", [("old", "old")]), ("2.1", "a", "y", [])]), ("1", "One", 8, []), ("3", "Three", 9, None),
    ], "code string, title string, weight int, subtopics array<struct<code:string,title:string,note:string,learning_outcomes:array<struct<id:string,text:string>>>>")
    found = spark.createDataFrame([
        ("2.2", 2, "2", " plain \n text ", []), ("2.2", 1, "1", "shared", [("a", "first"), ("b", " second ")]), ("2.2", 3, "3", None, [("a", "alone")]), ("2.2", 4, "4", " ", []), ("9.9", 1, "1", "nowhere", []),
    ], "code string, ord int, num string, text string, parts array<struct<letter:string,text:string>>")
    out = enrich.merged_vocabulary(topics, found)
    assert out.columns == topics.columns
    got = {r.code: r for r in out.collect()}
    assert [(s.code, s.title, s.note) for s in got["2"].subtopics] == [("2.2", "b", "x"), ("2.1", "a", "y")] and got["2"].weight == 7
    assert [(o.id, o.text) for o in got["2"].subtopics[0].learning_outcomes] == [("2.2-1a", "shared (a) first"), ("2.2-1b", "shared (b) second"), ("2.2-2", "plain text"), ("2.2-3a", "alone")]
    assert got["2"].subtopics[1].learning_outcomes == [] and got["1"].subtopics == [] and got["3"].subtopics is None
    assert enrich.vocabulary_counts(out).first()[:] == (2, 4, 1)


# ---------------------------------------------------------------- stages


def test_a_broken_paper_does_not_stop_the_others(spark, tmp_path):
    root = f"file://{tmp_path}/run"
    papers = spark.createDataFrame([("good",), ("broken",), ("none",)], "paper_id string")
    qp = "1 Explain what is meant by this.\n(a) State it.\n(b) Name it."
    documents = lambda broken: spark.createDataFrame([("good", "qp", qp), ("good", "ms", "1(a)\nM1"), ("broken", "qp", broken), ("broken", "er", "no session"), ("stray", "qp", qp)], "paper_id string, kind string, text string")
    rows = lambda df: sorted((r.paper_id, r.stage, r.run, r.status, r.detail) for r in df.collect())
    first = rows(staging.run(spark, root, papers, documents("\x00 garbage")))
    assert first == [("broken", "split", 1, "failed", "no_questions"), ("good", "marks", 1, "ok", None), ("good", "report", 1, "skipped", "no_report"), ("good", "split", 1, "ok", None), ("none", "split", 1, "failed", "no_paper")]
    assert rows(staging.run(spark, root, papers, documents("\x00 garbage"))) == first  # nothing is done again
    assert sorted((r.paper_id, r.state, r.detail) for r in staging.progress(papers, staging.outcomes(spark, root)).collect()) == [("broken", "failed", "no_questions"), ("good", "extracted", None), ("none", "failed", "no_paper")]
    (tmp_path / "run" / "split" / "run=2").mkdir()  # what a run that broke off left
    second = rows(staging.run(spark, root, papers, documents(qp + "\n(c) Mended.")))
    assert [r for r in second if r[0] == "broken"] == [("broken", "marks", 2, "skipped", "no_scheme"), ("broken", "report", 2, "failed", "no_facts"), ("broken", "split", 2, "ok", None)] and [r for r in second if r[0] == "good"] == [r for r in first if r[0] == "good"]
    assert sorted((r.paper_id, r.label) for r in staging.result(spark, root, "split").collect()) == [("broken", "1(a)"), ("broken", "1(b)"), ("broken", "1(c)"), ("good", "1(a)"), ("good", "1(b)")]


# ---------------------------------------------------------------- drawn symbols

TOKEN = "doc string, page int, x0 double, y0 double, x1 double, y1 double, text string, kind string"


@pytest.mark.parametrize("texts,want", [
    ([("C(s)", 100, 100, 130), ("O2(g)", 300, 100, 340)], (215.0, 100.0)),  # beside it
    ([("C(s)", 100, 112, 190), ("O2(g)", 230, 112, 260)], (210.0, 112.0)),  # on the line below
    ([("C(s)", 100, 100, 130), ("x(l)", 140, 100, 190), ("O2(g)", 300, 100, 340), ("y(g)", 350, 100, 380)], (245.0, 100.0)),  # the nearest ones
    ([("C(s)", 100, 100, 196), ("O2(g)", 203, 100, 240)], None), ([("carbon", 100, 100, 130), ("O2(g)", 300, 100, 340)], None), ([("C(s)", 100, 300, 130), ("O2(g)", 300, 300, 340)], None), ([], None),
])
def test_an_arrow_stands_in_the_gap(spark, texts, want):
    tokens = [("d", 1, 191.0, 98.0, 209.0, 106.0, "ΔH⦵", "symbol")] + [("d", 1, float(x0), float(y), float(x1), float(y) + 10, t, "text") for t, x0, y, x1 in texts]
    arrows, signs = symbols.reaction_arrows(spark.createDataFrame(tokens, TOKEN))
    found = arrows.collect()
    assert [((r.x0 + r.x1) / 2, r.y0) for r in found] == ([want] if want else [])
    assert signs.first().x0 == (want[0] - 9 if want else 191.0) and signs.first().y0 == (want[1] - 2 if want else 98.0)


def test_no_strokes(spark):
    strokes = spark.createDataFrame([], "doc string, page int, ord int, x0 double, y0 double, x1 double, y1 double")
    assert symbols.enthalpy_signs(strokes).isEmpty()
