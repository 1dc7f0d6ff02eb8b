"""Hand-outs: grouping by primary outcome, continuous numbers, totals, captions, pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import outcome_key
from .relational import distinct_in_order, numbered

SEPARATOR = " · "
STRIDE = 4096  #: old numbers that are counted anew in one task


def primary_outcome(outcomes: Column) -> Column:
    """The smallest outcome id by its numbers; empty where there is none."""
    real = F.filter(F.coalesce(outcomes, F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    first = F.array_min(F.transform(real, lambda x, i: F.struct(outcome_key(x).alias("key"), i.alias("i"), x.alias("id"))))
    return F.coalesce(first["id"], F.lit(""))


def outcome_text(outcomes: Column, texts: Column, outcome: Column) -> Column:
    """The text at the place of the outcome; empty where it is missing."""
    return F.coalesce(F.trim(F.get(texts, (F.array_position(outcomes, outcome) - 1).cast("int"))), F.lit(""))


def grouped(questions: DataFrame, order: str = "ord") -> DataFrame:
    """Adds primary, group_text and seq: groups by outcome, the untagged last; in a group by year, paper and question as text.

    Numbers are made outcome by outcome and moved by the sizes of those before, so no task sees the whole hand-out."""
    q = questions.withColumn("primary", primary_outcome(F.col("learning_outcomes")))
    untagged = (F.col("primary") == "").cast("int")
    group = F.struct(untagged.alias("untagged"), outcome_key(F.col("primary")).alias("key"), F.col("primary").alias("id"))
    inside = [F.coalesce("year", F.lit(0)), F.coalesce(F.col("paper"), F.lit("")), F.coalesce(F.col("question"), F.lit("")), F.col(order)]
    q = numbered(q, inside, "seq", bucket=group)
    text = outcome_text(F.col("learning_outcomes"), F.col("learning_outcome_texts"), F.col("primary"))
    return q.withColumn("group_text", F.first(text).over(Window.partitionBy("primary").orderBy("seq")))


def totals(questions: DataFrame) -> DataFrame:
    """Number of questions and sum of marks."""
    return questions.agg(F.count("*").alias("questions"), F.coalesce(F.sum("marks"), F.lit(0)).cast("long").alias("marks"))


def listed(questions: DataFrame, column: str, order: str = "ord") -> DataFrame:
    """Distinct values of an array column in the order in which the questions bring them."""
    rows = questions.select(order, F.posexplode(column).alias("pos", "v"))
    return distinct_in_order(rows, F.col("v"), F.struct(F.col(order), F.col("pos")))


def session_label(session: Column) -> Column:
    return F.nullif(F.upper(F.trim(session)), F.lit(""))


def caption(first: Column) -> Column:
    """first, year and session, question and marks, those that there are."""
    year = F.col("year").cast("string")
    marks = F.concat(F.col("marks").cast("string"), F.lit(" 分"))
    label = F.when(F.trim("question") != "", F.concat(F.lit("Q"), F.col("question")))
    return F.concat_ws(SEPARATOR, first, F.when(F.col("year").isNotNull(), F.concat_ws(" ", year, session_label(F.col("session")))), label, marks)


def figure_of(figures: Column, mark: str) -> Column:
    """The first figure whose path holds the mark."""
    return F.get(F.filter(figures, lambda f: F.contains(f, F.lit(mark))), F.lit(0))


def paper_figure(figures: Column) -> Column:
    return F.coalesce(figure_of(figures, "-paper"), F.get(F.filter(figures, lambda f: f != ""), F.lit(0)))


def parse_keep(text: Column) -> Column:
    """The whole numbers from 1 of a list such as 1,3,x,0."""
    numbers = F.transform(F.split(text, ","), lambda s: F.trim(s).try_cast("int"))
    return F.array_distinct(F.filter(numbers, lambda n: n >= 1))


def prune(rows: DataFrame, keep: DataFrame, seq: str = "seq") -> DataFrame:
    """The rows whose number is kept, numbered anew."""
    left = rows.join(keep.select(F.col(seq)), seq, "left_semi")
    return numbered(left.withColumnRenamed(seq, "_old"), [F.col("_old")], seq, bucket=F.floor(F.col("_old") / STRIDE)).drop("_old").select(rows.columns)


def render(questions: DataFrame) -> DataFrame:
    """The hand-out as lines of Markdown with their places: a heading for each group, then caption and link of each question."""
    q = grouped(questions)
    w = Window.partitionBy("primary").orderBy("seq")
    head = F.when(F.col("primary") == "", "### （未标 LO）").otherwise(F.concat_ws(" — ", F.concat(F.lit("### "), F.col("primary")), F.nullif("group_text", F.lit(""))))
    lines = F.array_compact(F.array(
        F.when(F.row_number().over(w) == 1, head),
        F.lit("---"),
        F.concat(F.lit("**"), caption(F.concat(F.lit("第"), F.col("seq").cast("string"), F.lit("题"))), F.lit("**")),
        F.concat(F.lit("[["), F.col("id"), F.lit("]]")),
    ))
    return q.withColumn("lines", lines).select("seq", F.posexplode("lines").alias("line", "text"))


def matches(column: str, pattern: str, kind: str, order: int) -> Column:
    """(order, pos, id, kind) of every match's first group."""
    return F.transform(F.regexp_extract_all(column, F.lit(pattern), F.lit(1)), lambda x, i: F.struct(F.lit(order).alias("order"), i.alias("pos"), x.alias("id"), F.lit(kind).alias("kind")))


def linked_ids(notes: DataFrame, kinds: dict[str, str], key: str = "doc", text: str = "text") -> DataFrame:
    """(doc, id, kind, seq): the ids that patterns of several kinds find, once each, by line, then kind, then place in the line."""
    found = F.flatten(F.array(*[
        matches("line", p, k, o)
        for o, (k, p) in enumerate(kinds.items())
    ]))
    lines = notes.select(key, F.posexplode(F.split(text, "\n")).alias("n", "line"))
    rows = lines.select(key, "n", F.explode(found).alias("m"))
    first = rows.groupBy(key, F.col("m.id").alias("id")).agg(F.min(F.struct("n", "m.order", "m.pos", "m.kind")).alias("at"))
    seq = F.row_number().over(Window.partitionBy(key).orderBy("at"))
    return first.select(key, "id", F.col("at.kind").alias("kind"), seq.cast("long").alias("seq"))


def missing(wanted: DataFrame, built: DataFrame, key: str = "id") -> DataFrame:
    """The wanted ids that were not built."""
    return wanted.join(built.select(key), key, "left_anti")
