"""Response analytics over answer facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import latest_by


def percent(ratio: Column) -> Column:
    """Whole percent, halves up."""
    return F.floor(ratio * 100 + 0.5).cast("long")


def accuracy_columns(correct: Column) -> list[Column]:
    ok = F.count_if(correct)
    return [F.count("*").alias("n"), ok.alias("ok"), percent(ok / F.count("*")).alias("acc")]


def latest_answers(answers: DataFrame, keys: Sequence[str] = ("assignment_id", "student_id", "question_id")) -> DataFrame:
    return latest_by(answers, keys, ["answered_at", "id"])


def with_student(answers: DataFrame, students: DataFrame) -> DataFrame:
    """Answers with their student as one struct; unknown students stay as null."""
    who = students.select(F.col("id").alias("student_id"), F.struct("name", "student_no", "class_name").alias("student"))
    return answers.join(who, "student_id", "left")


def student_accuracy(answers: DataFrame, by: str = "student_id") -> DataFrame:
    return answers.groupBy(by).agg(*accuracy_columns(F.col("correct")))


def question_accuracy(questions: DataFrame, answers: DataFrame, key: str = "question_id") -> DataFrame:
    """Every question with its answers; those without any have no accuracy and sort last."""
    counts = answers.groupBy(key).agg(F.count("*").alias("answered"), F.count_if("correct").alias("ok"))
    out = questions.join(counts, key, "left").fillna(0, ["answered", "ok"])
    ratio = F.when(F.col("answered") > 0, F.col("ok") / F.col("answered"))
    return out.withColumn("acc", percent(ratio)).withColumn("sort_acc", F.coalesce(ratio, F.lit(1.0)))


def expand_assignments(assignments: DataFrame, bank: DataFrame) -> DataFrame:
    """The questions of each assignment that the bank has, with their places."""
    ids = assignments.select(F.col("id").alias("assignment_id"), F.posexplode("question_ids").alias("pos", "question_id"))
    return ids.join(bank, "question_id")


def grid(students: DataFrame, questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Whether each student of an assignment answered each of its questions. Both sides meet on the assignment, never all with all."""
    cells = students.select("assignment_id", "student_id").join(questions.select("assignment_id", "question_id"), "assignment_id")
    done = answers.select("assignment_id", "student_id", "question_id").distinct().withColumn("answered", F.lit(True))
    return cells.join(done, ["assignment_id", "student_id", "question_id"], "left").fillna(False, ["answered"])


def wrong_topics(answers: DataFrame, topics: DataFrame, k: int = 15, key: str = "question_id") -> DataFrame:
    """The topics of most wrong answers; ties by name."""
    wrong = answers.filter(~F.col("correct")).join(topics.select(key, F.explode("topic_titles").alias("topic")), key)
    return wrong.groupBy("topic").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "topic").limit(k)


def overview(answers: DataFrame, by: str = "student_id") -> DataFrame:
    ok, n = F.count_if("correct"), F.count("*")
    return answers.agg(F.count_distinct(by).alias("students"), n.alias("attempts"), percent(F.when(n > 0, ok / n)).alias("acc"))


def streaks(answers: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """State of each key after its last answer: seen, whether ever right, mistakes since the last right answer."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    islands = answers.withColumn("_since", F.sum(F.col("correct").cast("int")).over(w))
    per_island = islands.groupBy(*keys, "_since").agg(F.count_if(~F.col("correct")).alias("_wrong"), F.count("*").alias("_n"))
    return per_island.groupBy(*keys).agg(
        F.sum("_n").alias("seen"),
        (F.max("_since") > 0).alias("ok"),
        F.max_by("_wrong", "_since").alias("mistakes"),
    )


def history(log: DataFrame, n: int | None = None) -> DataFrame:
    """The newest entries: 200, or n between 1 and 500."""
    return log.orderBy(F.desc("answered_at"), F.desc("id")).limit(max(1, min(500, 200 if n is None else n)))


def coverage(index: DataFrame, selected: DataFrame) -> DataFrame:
    """(code, selected, total): how many of a code's questions are selected. index: (code, id) rows."""
    marked = index.join(selected.select("id").distinct().withColumn("_in", F.lit(True)), "id", "left")
    return marked.groupBy("code").agg(F.count("_in").alias("selected"), F.count("*").alias("total"))


def progress(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Of the questions' states (seen, ok, mistakes): how many were seen, how many have mistakes, and the accuracy of those seen, by learner or in all."""
    seen = F.count_if(F.col("seen") > 0)
    right = F.count_if((F.col("seen") > 0) & (F.col("mistakes") == 0))
    return states.groupBy(*by).agg(seen.alias("seen"), F.count_if(F.col("mistakes") > 0).alias("wrong"), percent(F.when(seen > 0, right / seen)).alias("acc"))


def round_summary(states: DataFrame, current: DataFrame, key: str = "question_id", by: Sequence[str] = ()) -> DataFrame:
    """Of the questions of a round (by, key): how many there are, how many of them were answered, and the share that was ever right."""
    met = current.join(states.select(*by, key, "seen", "ok"), [*by, key], "left")
    done = F.count_if(F.col("seen") > 0)
    right = F.count_if((F.col("seen") > 0) & F.col("ok"))
    return met.groupBy(*by).agg(F.count("*").alias("questions"), done.alias("done"), F.coalesce(percent(F.when(done > 0, right / done)), F.lit(0)).cast("long").alias("acc"))
