import json

from quizloom.__main__ import main
from quizloom.operators import reports

REPORT = """
9701 Chemistry June 2021
Principal Examiner Report for Teachers

CHEMISTRY

Paper 9701/11
Multiple Choice

Question
Number
Key

1
C

14
A

General comments

Questions 7, 8 and 14 were found to be easy. Questions14, 20 and 31were found to be
particularly difficult.

Comments on specific questions

Question 14

The most commonly chosen incorrect answer wasC.
The solid does not react.

Question 20

Nothing was chosen more often.

Paper 9701/12
Multiple Choice

1
B

General comments

Questions 4, 9 were found to be easy.
"""


def test_report(spark):
    docs = spark.createDataFrame([("er", REPORT), ("none", "no session"), ("empty", "")], "doc string, text string")
    rows = {(r.paper, r.question): r for r in reports.questions(docs).collect()}
    assert {q for p, q in rows if p == "11"} == {"1", "7", "8", "14", "20", "31"} and {q for p, q in rows if p == "12"} == {"1", "4", "9"}
    r = rows["11", "14"]
    assert (r.year, r.session, r.examiner_band, r.difficulty, r.ms_key, r.common_incorrect) == (2021, "MJ", "particularly_difficult", 5, "A", "C")
    assert r.examiner_notes.startswith("The most commonly") and r.common_errors == ["Most commonly chosen incorrect answer was C."]
    assert rows["11", "7"].difficulty == 2 and rows["11", "7"].examiner_notes is None and rows["11", "1"].examiner_band is None
    assert "Paper" not in rows["11", "20"].examiner_notes
    stats = {r.paper: (r.with_comments, r.with_band_only, r.in_key) for r in reports.paper_stats(reports.questions(docs)).collect()}
    assert stats == {"11": (2, 3, 2), "12": (0, 2, 1)}


def test_outcomes(spark):
    text = ["5 Energetics", "5.1 Enthalpy", "1 define terms", "and use them", "2 explain (roughly)", "(a) bonds", "made and broken", "(b) cycles", "5.2 Hess", "1 (a) state it", "(b) use it"]
    lines = spark.createDataFrame([("s", i, t) for i, t in enumerate(text)], "doc string, n int, line string")
    got = {r.lo_id: r.text for r in reports.outcomes(lines).collect()}
    assert got == {"5.1-1": "define terms and use them", "5.1-2a": "explain (roughly) bonds made and broken", "5.1-2b": "explain (roughly) cycles", "5.2-1a": "state it", "5.2-1b": "use it"}


def test_command_line(spark, tmp_path, capsys):
    for i, (code, year) in enumerate([("5.1", 2020), ("5.1", 2019), ("9.9", 2020)]):
        p = tmp_path / f"bank/p{i}/tagged/q{i}.json"
        p.parent.mkdir(parents=True)
        p.write_text(json.dumps({"id": f"q{i}", "year": year, "paper": "11", "session": "MJ", "question": str(i), "marks": 1, "syllabus_codes": [code], "learning_outcomes": ["5.1-1"], "body": "stem"}))
    (tmp_path / "rules.yaml").write_text("title: Demo\nsyllabus_codes: ['5.1']\n")
    (tmp_path / "v.yaml").write_text("topics: [{code: 5, title: E, level: AS, subtopics: [{code: '5.1', title: H, learning_outcomes: [{id: 5.1-1, text: t}]}]}]\n")
    at = str(tmp_path)
    assert main(["select", f"{at}/bank", f"{at}/rules.yaml", f"{at}/pick"], spark) == 0
    assert main(["assemble", f"{at}/pick", f"{at}/note"], spark) == 0
    lines = [r.value for r in spark.read.text(f"{at}/note").collect()]
    assert lines[0] == "### 5.1-1" and lines.index("[[q1]]") < lines.index("[[q0]]")
    assert main(["audit", f"{at}/bank", f"{at}/v.yaml"], spark) == 1 and "unknown_code" in capsys.readouterr().out
    assert main(["los", f"{at}/v.yaml", "5"], spark) == 0 and "5.1-1" in capsys.readouterr().out


def test_tagging_and_staging_from_the_command_line(spark, tmp_path, capsys):
    (tmp_path / "v.yaml").write_text("topics: [{code: 5, title: E, level: AS, subtopics: [{code: '5.1', title: H, learning_outcomes: [{id: 5.1-5, text: t}]}]}]\n")
    for folder, files in {"drafts": {"q1.txt": "Use Hess's law.\n--- MARK SCHEME ---\nisotope", "q2a-i.txt": "nothing"}, "papers": {"good.qp.txt": "1 Explain what is meant by this.\n(a) State it.", "good.ms.txt": "1(a)\nM1", "bad.qp.txt": "x", "other.txt": "x"}}.items():
        (tmp_path / folder).mkdir()
        for name, text in files.items():
            (tmp_path / folder / name).write_text(text)
    at = f"file://{tmp_path}"
    assert main(["tag", f"{at}/drafts", f"{at}/v.yaml", "p11", f"{at}/out"], spark) == 0
    assert json.loads((tmp_path / "out/tagged/q1.json").read_text()) | {"rule": 0} == {"id": "p11-q1", "question": "1", "syllabus_codes": ["5.1"], "learning_outcomes": ["5.1-5"], "skills": ["calculate"], "rule": 0}
    assert [json.loads(x)["id"] for x in (tmp_path / "out/tagged/index-p11.jsonl").read_text().splitlines()] == ["p11-q1", "p11-q2a-i"]
    assert main(["stage", f"{at}/papers", f"{at}/run"], spark) == 1
    out = capsys.readouterr().out
    assert "no_questions" in out and "no_report" in out and "other" not in out
