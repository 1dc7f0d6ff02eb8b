import datetime as dt

import pytest
from pyspark.sql import functions as F

from quizloom.operators import similarity, stats
from quizloom.streaming import answers as streaming

ANSWER = "id long, assignment_id long, student_id long, question_id string, correct boolean, answered_at timestamp"


def at(minute):
    return dt.datetime(2024, 1, 1, 12, minute)


ROWS = [(1, 1, 10, "a", True, at(1)), (2, 1, 10, "b", True, at(2)), (3, 1, 10, "c", True, at(3)), (4, 1, 11, "a", False, at(4)), (5, 1, 11, "a", True, at(5)), (6, 1, 11, "b", True, at(6)), (7, 1, 11, "c", False, at(7))]


@pytest.fixture(scope="module")
def answers(spark):
    return spark.createDataFrame(ROWS, ANSWER)


def test_two_students(spark, answers):
    latest = stats.latest_answers(answers)
    assert {r.student_id: (r.n, r.ok, r.acc) for r in stats.student_accuracy(latest).collect()} == {10: (3, 3, 100), 11: (3, 2, 67)}
    q = spark.createDataFrame([("a",), ("b",), ("c",), ("never",)], "question_id string")
    got = stats.question_accuracy(q, latest).orderBy("sort_acc", "question_id").collect()
    assert [(r.question_id, r.answered, r.acc) for r in got] == [("c", 2, 50), ("a", 2, 100), ("b", 2, 100), ("never", 0, None)]
    assert tuple(stats.overview(latest).first()) == (2, 6, 83) and stats.overview(latest.limit(0)).first().acc is None
    cells = stats.grid(answers.select("assignment_id", "student_id").distinct(), q.withColumn("assignment_id", F.lit(1)), answers)
    assert cells.count() == 8 and cells.filter("answered").count() == 6
    topics = spark.createDataFrame([("a", ["x", "y"]), ("c", ["y"])], "question_id string, topic_titles array<string>")
    assert [tuple(r) for r in stats.wrong_topics(answers, topics).collect()] == [("y", 2), ("x", 1)]


def plain_streak(rows):
    seen, ok, wrong = 0, False, 0
    for r in sorted(rows, key=lambda r: (r[5], r[0])):
        seen, ok, wrong = seen + 1, ok or r[4], 0 if r[4] else wrong + 1
    return seen, ok, wrong


def test_streaks(spark):
    rows = [(i, 1, i % 3, "q", bool(i * 7 % 5 > 2), at(i % 50)) for i in range(200)]
    got = {r.student_id: (r.seen, r.ok, r.mistakes) for r in stats.streaks(spark.createDataFrame(rows, ANSWER), ["student_id"], ["answered_at", "id"]).collect()}
    assert got == {k: plain_streak([r for r in rows if r[2] == k]) for k in range(3)}


def test_history_bounds(spark, answers):
    assert [r.id for r in stats.history(answers, 2).collect()] == [7, 6] and stats.history(answers, 0).count() == 1 and stats.history(answers, 9999).count() == 7


def write_batches(spark, rows, path):
    for i in range(0, len(rows), 3):
        spark.createDataFrame(rows[i : i + 3], ANSWER).coalesce(1).write.mode("append").parquet(path)


def test_stream_merges_as_the_batch_does(spark, tmp_path):
    rows = [ROWS[i] for i in (4, 2, 6, 0, 3, 5, 1)] + [ROWS[3]]
    write_batches(spark, rows, str(tmp_path / "in"))
    stream = spark.readStream.schema(ANSWER).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming.start_merge(stream, str(tmp_path / "out"), str(tmp_path / "ck"), ["student_id", "question_id"])
    q.awaitTermination(120)
    assert q.exception() is None
    got = {(r.student_id, r.question_id): r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.student_id, r.question_id): r.id for r in stats.latest_answers(spark.createDataFrame(ROWS, ANSWER), ["student_id", "question_id"]).collect()}
    assert got == want


def test_stream_progress_equals_the_fold(spark, tmp_path):
    rows = [(i, 1, i % 2, "q", bool(i * 7 % 5 > 2), at(i * 13 % 50)) for i in range(30)]
    write_batches(spark, rows, str(tmp_path / "in"))
    stream = spark.readStream.schema(ANSWER).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
    q = streaming.progress(stream).writeStream.format("memory").queryName("progress").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    last = {}
    for r in spark.table("progress").collect():
        if r.seen >= last.get(r.student_id, (0,))[0]:
            last[r.student_id] = (r.seen, r.ok, r.mistakes)
    assert last == {k: plain_streak([r for r in rows if r[2] == k]) for k in range(2)}


def test_related_and_index(spark):
    df = spark.createDataFrame([("p", "a", ["1", "2", "2"]), ("p", "b", ["1", "2"]), ("p", "c", ["2"]), ("r", "d", ["1"])], "paper string, id string, syllabus_codes array<string>")
    rows = similarity.related(similarity.postings(df, carry=["paper"]), ["paper"], 1).collect()
    assert {(r.id, r.other, r.shared) for r in rows} == {("a", "b", 2), ("b", "a", 2), ("c", "a", 1)}
    index = {r.code: (r.ids, r.n) for r in similarity.inverted_index(df).collect()}
    assert index == {"1": (["a", "b", "d"], 3), "2": (["a", "b", "c"], 3)}


def test_version_follows_content_only(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "id int, t string")
    v = lambda d: similarity.content_version(d, "id", ["id", "t"]).first().version
    assert v(df) == v(df.repartition(7)) and len(v(df)) == 12 and v(df) != v(df.withColumn("t", F.concat("t", F.lit("x"))))
