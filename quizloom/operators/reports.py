"""Examiners' reports: text to a row for each question that a report names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import MONTHS, literal_map
from ..functions.text import block, question_list
from .enrich import BAND_DIFFICULTY

#: Fixed patterns of the reports' phrases.
SESSION = r"(?i)\d{4}\s+\w+\s+(June|November|March)\s+(\d{4})"
PAPER = r"(?i)Paper\s+\d{4}/(\d+)\s*\n\s*([^\n]*)"
EASY = r"(?i)Questions?\s*([0-9,\s]+(?:and\s*\d+)?)\s*were\s+found\s+to\s+be\s+easy"
HARD = r"(?i)Questions?\s*([0-9,\s]+(?:and\s*\d+)?)\s*were\s+found\s+to\s+be\s+(?:particularly\s+)?difficult"
WRONG = r"(?i)most commonly chosen incorrect answer was\s*([A-D])"
NOISE = r"(?i)(?:Cambridge International Advanced Subsidiary and Advanced Level|\d{4} Chemistry (?:June|November|March) \d{4}|Principal Examiner Report for Teachers|©\s*\d{4})\s*"
BLEED = r"(?s)\n(?:CHEMISTRY\s*\n|Paper\s+\d{4}/\d+|----- PAGE \d+ -----).*$"
KEY_PAIR = r"(?:^|\s)(\d{1,2})\s*\n?\s*([A-D])(?=\s|$)"


def sections(reports: DataFrame, key: str = "doc", text: str = "text") -> DataFrame:
    """(doc, year, session, paper, title, section): a row for each paper of a report; reports without a session have none."""
    month = F.element_at(literal_map(MONTHS), F.lower(F.regexp_extract(text, SESSION, 1)))
    dated = reports.filter(F.col(text).rlike(SESSION)).select(key, text, F.regexp_extract(text, SESSION, 2).cast("int").alias("year"), month.alias("session"))  # once a report
    head = dated.select(key, "year", "session", F.posexplode(F.split(text, r"(?i)(?=Paper\s+\d{4}/\d+\s*\n)")).alias("ord", "section"))
    rows = head.filter(F.col("section").rlike(rf"(?i)^{PAPER[4:]}"))
    return rows.select(key, "year", "session", F.regexp_extract("section", PAPER, 1).alias("paper"), F.trim(F.regexp_extract("section", PAPER, 2)).alias("title"), "ord", "section")


def general(section: Column) -> Column:
    return block(F.regexp_replace(F.regexp_extract(section, r"(?is)General comments\s*(.*?)\s*(?:Comments on specific questions|\z)", 1), NOISE, " "))


def named(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), question_list)))


def comments(papers: DataFrame, keys: list[str]) -> DataFrame:
    """(…, question, notes): the last comment on a question."""
    body = F.regexp_extract("section", r"(?is)Comments on specific questions\s*(.*)\z", 1)
    rows = papers.select(*keys, F.posexplode(F.split(body, r"(?i)(?=Question\s+\d+\b)")).alias("pos", "c"))
    number = F.regexp_extract("c", r"(?i)^Question\s+(\d+)\b", 1)
    notes = F.trim(F.regexp_replace(block(F.regexp_replace(F.regexp_replace("c", r"(?i)^Question\s+\d+\s*", ""), NOISE, " ")), BLEED, ""))
    rows = rows.filter(number != "").select(*keys, number.alias("question"), "pos", notes.alias("notes")).filter("notes <> ''")
    return rows.groupBy(*keys, "question").agg(F.max_by("notes", "pos").alias("notes"))


def answer_keys(papers: DataFrame, keys: list[str]) -> DataFrame:
    """(…, question, ms_key): number and letter pairs before the comments, 1 to 40, the first of a number."""
    head = F.regexp_replace("section", r"(?is)General comments.*\z", "")
    pair = lambda i: F.regexp_extract_all(head, F.lit(KEY_PAIR), F.lit(i))
    rows = papers.select(*keys, F.posexplode(F.arrays_zip(pair(1).alias("q"), pair(2).alias("a"))).alias("pos", "p"))
    rows = rows.select(*keys, "pos", F.col("p.q").cast("int").cast("string").alias("question"), F.col("p.a").alias("a")).filter(F.col("question").cast("int").between(1, 40))
    return rows.groupBy(*keys, "question").agg(F.min_by("a", "pos").alias("ms_key"))


def questions(reports: DataFrame, key: str = "doc", text: str = "text") -> DataFrame:
    """A row for each question that is named as easy or hard, commented or in the key; hard beats easy."""
    keys = [key, "year", "session", "paper"]
    papers = sections(reports, key, text).withColumn("general", general(F.col("section")))
    band = lambda name, pattern: papers.select(*keys, F.explode(F.transform(named(F.col("general"), pattern), lambda n: n.cast("string"))).alias("question")).withColumn(name, F.lit(True))
    out = band("easy", EASY).distinct()
    for other in (band("hard", HARD).distinct(), comments(papers, keys), answer_keys(papers, keys)):
        out = out.join(other, [*keys, "question"], "full")
    level = F.when(F.col("hard"), "particularly_difficult").when(F.col("easy"), "easy")
    difficulty = F.try_element_at(literal_map(BAND_DIFFICULTY), F.coalesce("examiner_band", F.lit("")))
    wrong = F.nullif(F.upper(F.regexp_extract(F.coalesce("notes", F.lit("")), WRONG, 1)), F.lit(""))
    none = F.lit(None).cast("double")
    out = out.withColumn("examiner_band", level).withColumn("difficulty", difficulty).withColumn("common_incorrect", wrong)
    return out.select(
        *keys, "question", "ms_key", "examiner_band", "difficulty",
        F.when(F.col("difficulty").isNotNull(), "examiner_report_qualitative").alias("difficulty_source"),
        "common_incorrect",
        F.when(wrong.isNotNull(), F.array(F.concat(F.lit("Most commonly chosen incorrect answer was "), wrong, F.lit(".")))).otherwise(F.array().cast("array<string>")).alias("common_errors"),
        F.col("notes").alias("examiner_notes"),
        none.alias("facility"), none.alias("percent_correct"), none.alias("discrimination"),
    )


def paper_stats(rows: DataFrame) -> DataFrame:
    """By paper: questions with comments, with a band alone, and in the key."""
    noted = F.col("examiner_notes").isNotNull()
    return rows.groupBy("year", "session", "paper").agg(
        F.count_if(noted).alias("with_comments"),
        F.count_if(F.col("examiner_band").isNotNull() & ~noted).alias("with_band_only"),
        F.count_if(F.col("ms_key").isNotNull()).alias("in_key"),
    )


def outcomes(lines: DataFrame, key: str = "doc") -> DataFrame:
    """(code, lo_id, text) of a syllabus' lines (doc, n, line): headings such as 5.1, numbered outcomes, lettered parts, continuations.

    What a line belongs to is carried forward; an outcome with parts gives a row for each part, its own text before."""
    w = Window.partitionBy(key).orderBy("n")
    code = F.nullif(F.regexp_extract("line", r"^(\d{1,2}\.\d{1,2})\s+\S", 1), F.lit(""))
    number = F.when(code.isNull(), F.nullif(F.regexp_extract("line", r"^(\d{1,2})\s+\S", 1), F.lit("")))
    letter = F.nullif(F.regexp_extract("line", r"^(?:\d{1,2}\s+)?\(([a-z])\)\s*\S", 1), F.lit(""))
    text = F.trim(F.regexp_replace(F.regexp_replace("line", r"^\d{1,2}\s+", ""), r"^\([a-z]\)\s*", ""))
    rows = lines.withColumn("head", code).withColumn("code", F.last(code, ignorenulls=True).over(w)).withColumn("starts", number)
    rows = rows.withColumn("lo", F.count(F.coalesce("head", "starts")).over(w)).withColumn("own", text).withColumn("letter_here", letter)
    inside = Window.partitionBy(key, "lo").orderBy("n")
    rows = rows.withColumn("num", F.first("starts").over(inside)).withColumn("letter", F.last("letter_here", ignorenulls=True).over(inside))
    rows = rows.filter(F.col("num").isNotNull() & F.col("code").isNotNull() & (F.trim("line") != ""))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "own"))), lambda s: s["own"]), " ")
    parts = rows.groupBy(key, "code", "lo", "num", "letter").agg(joined.alias("text"))
    lo = Window.partitionBy(key, "lo")
    parts = parts.withColumn("n_parts", F.count("letter").over(lo)).withColumn("stem", F.max(F.when(F.col("letter").isNull(), F.col("text"))).over(lo))
    leaf = parts.filter((F.col("n_parts") == 0) | F.col("letter").isNotNull())
    lo_id = F.concat("code", F.lit("-"), "num", F.coalesce("letter", F.lit("")))
    return leaf.select("code", lo_id.alias("lo_id"), F.concat_ws(" ", F.when(F.col("letter").isNotNull(), F.col("stem")), "text").alias("text"))
