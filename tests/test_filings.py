"""Readers, sinks and small rules: what the registered queries over files don't reach."""

import os

import pytest
from pyspark.sql import functions as F

from quizloom import filings
from quizloom.functions import keys, text
from quizloom.operators import relational, stats
from quizloom.sources import readers, store, writers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_drafts_in_the_order_of_their_numbers(spark, tmp_path):
    for name in ("q10", "q2", "q2a-i", "q007", "qx", "notes"):
        (tmp_path / f"{name}.txt").write_text(name)
    root = f"file://{tmp_path}"
    assert [r.question for r in readers.drafts(spark, root).collect()] == ["x", "2", "2a-i", "7", "10"]
    assert [r.text for r in readers.drafts(spark, root, only=["2a-i", 10]).collect()] == ["q2a-i", "q10"]
    assert [r.question for r in readers.drafts(spark, root, limit=2).collect()] == ["x", "2"]


def test_files_are_listed_and_read_by_tasks(spark, tmp_path, monkeypatch):
    """Spark's driver listed every file, and read each of them in tasks of 32, twice where they were sorted, all of them for a limit."""
    for name in ("q10.txt", "a/q2.txt", "a/b/q3.txt", "a/.q4.txt", "_a/q5.txt", ".b/q6.txt", "a/_q7.txt", "a/q8.md", "c/q9 x.txt", "c/qé%.txt", "c=1/q12.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / "a/q11.txt").write_bytes(b"")
    (tmp_path / "a/q13.txt").write_bytes(b"\xff\n")
    (tmp_path / "none").mkdir()
    root = f"file://{tmp_path}"
    monkeypatch.setattr(readers, "BATCH_FILES", 2)
    plan = lambda rows: rows._jdf.queryExecution().toString()
    rows = {"first": readers.drafts(spark, root, limit=2), "all": readers.drafts(spark, root), "sizes": readers.listing(spark, root, "q*.txt"), "none": readers.listing(spark, f"{root}/none")}
    assert "binaryFile" not in plan(rows["sizes"]) and "FileScan text" not in plan(rows["all"])
    assert plan(rows["first"]).index("MapInArrow") < plan(rows["first"]).index("GlobalLimit")  # texts are read after the limit
    assert [tuple(r) for r in rows["first"].select("question", "text").collect()] == [("é%", "c/qé%.txt"), ("2", "a/q2.txt")]
    every = [(r.question, bytes(r.text)) for r in rows["all"].select("question", F.col("text").cast("binary").alias("text")).collect()]
    assert every == [("é%", "c/qé%.txt".encode()), ("2", b"a/q2.txt"), ("3", b"a/b/q3.txt"), ("9 x", b"c/q9 x.txt"), ("10", b"q10.txt"), ("11", b""), ("12", b"c=1/q12.txt"), ("13", b"\xff\n")]
    assert sorted(r.size for r in rows["sizes"].collect()) == [0, 2, 7, 8, 10, 10, 10, 11] and rows["none"].count() == 0
    monkeypatch.setattr(readers, "listed_by_tasks", lambda *_: False)  # a store that only Spark knows; empty files are left out there
    assert [(r.question, bytes(r.text)) for r in readers.drafts(spark, root).select("question", F.col("text").cast("binary").alias("text")).collect()] == [r for r in every if r[1]]


def test_files_are_written_by_many_tasks(spark, tmp_path):
    """A table of small rows is one partition; one task wrote all of its files."""
    rows = spark.range(0, 400, 1, 1).select(F.concat(F.col("id") % 3, F.lit("/"), "id").alias("path"), F.lit("é").alias("value"), F.lit(False).alias("gone"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("files", "files")
    store.write_files(rows, f"file://{tmp_path}")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("files") for s in tracker.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) > 1
    assert sorted(int(p.name) for p in tmp_path.rglob("*") if p.is_file()) == list(range(400)) and (tmp_path / "1/4").read_text() == "é"


@pytest.mark.parametrize("form", [str, os.path.relpath, "file:{}".format, "file://{}".format])
def test_folders_of_any_local_path_are_listed_by_tasks(spark, tmp_path, form):
    """A path without a store, as spark.checkpoint.dir may be, was listed by Spark's driver: memory and time by the file."""
    top = tmp_path / "a b%20#"
    root, i = form(top), F.col("id").cast("string")
    store.write_files(spark.range(40).select(F.concat(F.col("id") % 3, F.lit("/q"), i, F.lit(".txt")).alias("path"), i.alias("value"), F.lit(False).alias("gone")), root)
    assert sorted(str(p.relative_to(top)) for p in top.rglob("*") if p.is_file()) == sorted(f"{n % 3}/q{n}.txt" for n in range(40))
    found = readers.listing(spark, root, "q*.txt")
    assert "binaryFile" not in found._jdf.queryExecution().toString()
    assert {r.path[-8:]: r.size for r in found.collect() if r.path.endswith(("/0/q0.txt", "/0/q39.txt"))} == {"0/q0.txt": 1, "/q39.txt": 2} and found.count() == 40


def test_first_drafts_by_a_path_without_a_store(spark, tmp_path, monkeypatch):
    """Spark's driver listed all drafts for the first of them, and all were read."""
    monkeypatch.setattr(store, "shared_folder", lambda _: str(tmp_path))
    rows = filings.first_drafts(spark, "/root/testdata/sf0.001")
    assert "FileScan text" not in rows._jdf.queryExecution().toString()
    want = spark.read.parquet("/root/testdata/sf0.001/customer.parquet").orderBy("c_custkey").limit(25).collect()
    assert [tuple(r) for r in rows.orderBy("place").collect()] == [(r.c_custkey, n) for n, r in enumerate(want, 1)]


def test_all_drafts_by_a_path_without_a_store(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "shared_folder", lambda _: str(tmp_path))
    rows = filings.draft_files(spark, "/root/testdata/sf0.001")
    assert "FileScan text" not in rows._jdf.queryExecution().toString()
    want = spark.read.parquet("/root/testdata/sf0.001/customer.parquet").orderBy("c_custkey").collect()
    assert [tuple(r) for r in rows.collect()] == [(f"{r.c_custkey}{'a-i' * (r.c_custkey % 4 == 0)}", f"Order of {r.c_name}") for r in want]


def test_records_by_a_path_without_a_store(spark, tmp_path, monkeypatch):
    """Spark's driver listed them all, and they lay in twenty folders at any number of records."""
    monkeypatch.setattr(store, "shared_folder", lambda _: str(tmp_path))
    rows, left = filings.tagged_records(spark, "/root/testdata/sf0.001"), filings.rejected_records(spark, "/root/testdata/sf0.001")
    assert not any("FileScan text" in r._jdf.queryExecution().toString() for r in (rows, left))
    ids = [r.doc_id for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id").collect()]
    assert sorted((r.id, r.codes) for r in rows.collect()) == sorted((f"q{i}", "" if i % 3 == 0 else f"{i % 12 + 1}.1,5") for i in ids if i % 17 > 3)
    assert sorted(r.stem for r in left.collect()) == sorted(f"q{i}" for i in ids if i % 17 < 3)
    places = [p.parent for p in tmp_path.rglob("q*.json")]
    assert len(places) == 2 * len(ids) and len(set(places)) > 40


@pytest.mark.parametrize("path,want", [("/a b%", "/a b%"), ("file:/a", "/a"), ("file:///a/b", "/a/b"), ("file://host/a", None), ("s3://a/b", None), ("a", None)])
def test_local_paths(path, want):
    assert store.local(path) == want


def test_the_file_that_is_meant(spark, monkeypatch):
    files = spark.createDataFrame([("a/5-1-energy.md", 1), ("b/5-1-energy.md", 2), ("b/5-1.md", 2), ("a/more-energy.md", 1), ("a/5-1.md.bak", 3)], "path string, place int")
    asked = spark.createDataFrame([("b/5-1-energy.md",), ("5-1-energy",), ("5-1",), ("energy",), ("none",), ("",)], "asked string")
    got = {r.asked: r.path for r in relational.resolved_names(asked, files).collect()}
    assert got == {"b/5-1-energy.md": "b/5-1-energy.md", "5-1-energy": "a/5-1-energy.md", "5-1": "b/5-1.md", "energy": "a/5-1-energy.md"}
    monkeypatch.setattr(relational, "MOST_NAMES", 1)
    with pytest.raises(ValueError, match="more than 1 names"):
        relational.resolved_names(asked, files)


@pytest.mark.parametrize("kind,paper,want", [("MCQ", "21", True), ("practical", "11", False), (None, "12", True), (None, "33", False), (None, None, True), ("other", "42", False)])
def test_questions_that_must_show_options(spark, kind, paper, want):
    assert one(spark, keys.has_options(F.lit(kind).cast("string"), F.lit(paper).cast("string"))) is want


def test_labels(spark):
    none = F.lit(None).cast("string")
    assert one(spark, keys.source_label(none, none, none)) == "? " and one(spark, keys.source_label(F.lit(2021), F.lit("MJ"), F.lit("11"))) == "2021 MJ P11"
    assert one(spark, keys.one_line(none, 3)) == "" and one(spark, keys.one_line(F.lit(" a \n b c"), 3)) == "a b…"
    assert [one(spark, keys.leading_int(F.lit(v).cast("string"))) for v in ("12(a)", " -3x", "x3", "", None)] == [12, -3, 0, 0, 0]
    rows = spark.createDataFrame([(2021, "11", "2"), (2021, "2", "10"), (None, "x", "1")], "year int, paper string, question string")
    assert [r.question for r in rows.orderBy(*keys.quiz_order(F.col("year"), F.col("paper"), F.col("question"))).collect()] == ["1", "10", "2"]
    assert one(spark, text.lowered(F.lit("x2=(ae)o"))) == "ₓ₂₌₍ₐₑ₎ₒ" and one(spark, text.raised(F.lit("2=(x)"))) == "²⁼⁽x⁾"


def test_a_round_without_answers(spark):
    states = spark.createDataFrame([("a", 2, True), ("b", 1, False), ("z", 1, True)], "question_id string, seen long, ok boolean")
    current = spark.createDataFrame([("a",), ("b",), ("c",)], "question_id string")
    assert tuple(stats.round_summary(states, current).first()) == (3, 2, 50)
    assert tuple(stats.round_summary(states.limit(0), current).first()) == (3, 0, 0)


def test_images_by_their_first_entry(spark):
    questions = spark.createDataFrame([("a", ["x/1-paper.png", "2-paper.png", "y/1-ms.png"]), ("b", None), ("c", ["1-ms.png"])], "id string, figures array<string>")
    rows, skipped = writers.illustrated(questions, spark.createDataFrame([("z/1-paper.png",), ("1-ms.png",)], "path string"), "out/")
    assert [(r.id, r.paper_img, r.ms_img) for r in rows.collect()] == [("a", "out/1-paper.png", "out/1-ms.png")]
    assert sorted(tuple(r) for r in skipped.collect()) == [("b", "missing figure entries"), ("c", "missing figure entries")]
