"""Enrichment: controlled vocabulary, report facts, overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import first_by

#: Fixed: report fields that stay as they are where the report has none, and those that then become null.
KEPT_IF_NULL = ("examiner_band", "examiner_notes", "difficulty_source", "common_incorrect")
NULLED = ("facility", "percent_correct", "discrimination")
#: Fixed: difficulty of the bands.
BAND_DIFFICULTY = {"easy": 2, "particularly_difficult": 5}
SKILLS = ["recall", "explain", "calculate", "data-analysis", "practical", "compare", "evaluate", "draw"]
QUESTION_TYPES = ["mcq", "structured", "extended", "practical", "data"]


def vocabulary(tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Codes and outcomes of nested topics: (code, title, level, major) and (lo_id, parent_code, text, level)."""
    topics = tree.select(F.col("code").cast("string").alias("major"), "title", "level", "subtopics")
    heads = topics.select(F.col("major").alias("code"), F.concat(F.col("title"), F.coalesce(F.concat(F.lit(" ["), F.col("level"), F.lit("]")), F.lit(""))).alias("title"), "level", "major")
    subs = topics.select("major", "level", F.explode("subtopics").alias("s"))
    codes = heads.unionByName(subs.select(F.col("s.code").cast("string").alias("code"), F.col("s.title").alias("title"), "level", "major"))
    los = subs.select("level", F.col("s.code").cast("string").alias("parent_code"), F.explode("s.learning_outcomes").alias("o"))
    return codes, los.select(F.col("o.id").alias("lo_id"), "parent_code", F.col("o.text").alias("text"), "level")


def of_level(codes: DataFrame, vocabulary_codes: DataFrame, level: str = "AS", column: str = "code") -> DataFrame:
    """Rows whose code's major topic has the level."""
    majors = vocabulary_codes.filter((F.col("code") == F.col("major")) & (F.col("level") == level)).select(F.col("major").alias("_major"))
    return codes.withColumn("_major", F.split_part(column, F.lit("."), F.lit(1))).join(majors, "_major", "left_semi").drop("_major")


def unknown_values(records: DataFrame, column: str, known: DataFrame, key: str, carry: str = "id") -> DataFrame:
    """(id, value) for the values of an array that the vocabulary lacks."""
    values = records.select(carry, F.explode(column).alias("value"))
    return values.join(known.select(F.col(key).alias("value")), "value", "left_anti")


def looked_up(records: DataFrame, column: str, known: DataFrame, key: str, text: str, name: str, carry: str = "id") -> DataFrame:
    """Records with the texts of an array's values, in the array's order; unknown values have none."""
    places = records.select(carry, F.posexplode(column).alias("pos", "value")).join(known.select(F.col(key).alias("value"), F.col(text).alias("text")), "value")
    texts = places.groupBy(carry).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]).alias(name))
    return records.join(texts, carry, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))


def covered_codes(codes: Column, outcomes: Column) -> Column:
    """Codes, once each, and the parents of outcomes that neither stand there nor whose topic does."""
    own = F.array_distinct(F.transform(codes, lambda c: F.trim(c)))
    parents = F.array_distinct(F.transform(outcomes, lambda o: F.regexp_extract(o, r"^([0-9.]+)", 1)))
    return F.array_union(own, F.filter(parents, lambda p: ~F.array_contains(own, p) & ~F.array_contains(own, F.split_part(p, F.lit("."), F.lit(1)))))


def checked_tags(records: DataFrame) -> DataFrame:
    """Normalised tags with what is wrong in problems: skills and types outside the lists give way, difficulty must be 1 to 5."""
    skills = F.array_distinct(F.filter(F.transform(F.coalesce("skills", F.array().cast("array<string>")), lambda s: F.trim(s)), lambda s: s.isin(SKILLS)))
    kind = F.trim(F.coalesce("question_type", F.lit("mcq")))
    codes = F.coalesce("syllabus_codes", F.array().cast("array<string>"))
    problems = F.array_compact(F.array(
        F.when(F.size(codes) == 0, F.lit("no_codes")),
        F.when(~F.coalesce("difficulty", F.lit(2)).between(1, 5), F.lit("difficulty_range")),
    ))
    return (
        records.withColumn("problems", problems)
        .withColumn("skills", skills)
        .withColumn("question_type", F.when(kind.isin(QUESTION_TYPES), kind).otherwise("mcq"))
        .withColumn("difficulty", F.coalesce("difficulty", F.lit(2)))
        .withColumn("syllabus_codes", covered_codes(codes, F.coalesce("learning_outcomes", F.array().cast("array<string>"))))
    )


def main_question(parent: Column, question: Column) -> Column:
    """The number by which reports know a question."""
    return F.split_part(F.coalesce(F.nullif(parent, F.lit("")), question), F.lit("("), F.lit(1))


SCOPE = ("year", "session", "paper")


def merge_reports(questions: DataFrame, reports: DataFrame, scope: dict | None, source: str, update_difficulty: bool = True) -> DataFrame:
    """Questions with the facts of their report.

    With a scope (year, session, paper) all questions are of the one paper that the reports are about. Without one, both sides
    have these columns, and a question meets the report of its own paper alone. The scope also fills
    questions that their paper's report doesn't name, where they have no scope of their own. Of several rows that a report has of
    a question the hardest counts."""
    keyed = scope is None
    reports = first_by(reports, [*(SCOPE if keyed else ()), "question"], [F.col("difficulty").desc_nulls_last(), F.to_json(F.struct(*reports.columns))])
    er = reports.select(*[F.col(c).alias(f"er__{c}") for c in reports.columns], F.lit(True).alias("er__hit"))
    q = questions.withColumn("_main", main_question(F.col("parent_question"), F.col("question")))
    same = q["_main"] == er["er__question"]
    if keyed:
        for c in SCOPE:
            same &= q[c] == er[f"er__{c}"]
        reported = reports.select(*SCOPE).distinct().withColumn("er__reported", F.lit(True))
        q = q.join(er, same, "left").join(reported, list(SCOPE), "left")
    else:
        q = q.join(er, same, "left").withColumn("er__reported", F.lit(True))
    hit = F.coalesce("er__hit", F.lit(False))
    at = lambda c: F.col(f"er__{c}")
    errors = F.coalesce(at("common_errors"), F.array().cast("array<string>"))
    tip = F.when(at("common_incorrect").isNotNull(), F.array(F.concat(F.lit("Common wrong option: "), at("common_incorrect")))).otherwise(F.array().cast("array<string>"))
    misc = F.coalesce("misconceptions", F.array().cast("array<string>"))
    new = {c: F.when(hit, F.coalesce(at(c), F.col(c))).otherwise(F.col(c)) for c in KEPT_IF_NULL}
    new |= {c: F.when(hit, at(c)).otherwise(F.col(c)) for c in NULLED}
    new["common_errors"] = F.when(hit, errors).otherwise(F.col("common_errors"))
    new["misconceptions"] = F.when(hit, F.array_union(misc, F.concat(F.filter(errors, lambda e: e != ""), tip))).otherwise(F.col("misconceptions"))
    for c in SCOPE:
        own = f"er_{c}"
        value = (F.when(F.col("er__reported"), F.col(c)) if keyed else F.lit(scope.get(c))).cast(dict(questions.dtypes)[own])
        new[own] = F.when(hit, value).otherwise(F.coalesce(own, value))
    new["examiner_report_source"] = F.when(hit, F.lit(source)).otherwise(F.coalesce("examiner_report_source", F.when(F.col("er__reported"), F.lit(source))))
    if update_difficulty:
        new["difficulty"] = F.when(hit, F.coalesce(at("difficulty"), F.col("difficulty"))).otherwise(F.col("difficulty"))
    return q.select(*[new[c].alias(c) if c in new else F.col(c) for c in questions.columns])


def overridden(records: DataFrame, overrides: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Curated values before those of the records."""
    o = overrides.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return records.join(o, key, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in records.columns])


def with_fallback(left: DataFrame, keyed: DataFrame, keys: list[str], value: str) -> DataFrame:
    """value of the first of several keys that keyed (key, value) knows."""
    out = left
    for i, k in enumerate(keys):
        out = out.join(keyed.select(F.col("key").alias(k), F.col("value").alias(f"_{i}")), k, "left")
    return out.withColumn(value, F.coalesce(*[f"_{i}" for i in range(len(keys))])).drop(*[f"_{i}" for i in range(len(keys))])


def default_outcomes(records: DataFrame, outcomes: DataFrame, carry: str = "id") -> DataFrame:
    """(id, outcomes): for each code of a record, in their order, the first outcome id of that code as text; codes without one have none."""
    first = outcomes.groupBy(F.col("parent_code").alias("code")).agg(F.min("lo_id").alias("lo"))
    rows = records.select(carry, F.posexplode("syllabus_codes").alias("pos", "code")).join(first, "code")
    return rows.groupBy(carry).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "lo"))), lambda s: s["lo"]).alias("outcomes"))


def normal_skills(skills: Column, synonyms: dict[str, str], fallback: str = "recall") -> Column:
    """Skills by their usual names, once each, in order; the fallback where none is known."""
    named = F.transform(skills, lambda s: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in synonyms.items() for x in p]), s), s))
    known = F.array_distinct(F.filter(named, lambda s: s.isin(SKILLS)))
    return F.when(F.size(known) > 0, known).otherwise(F.array(F.lit(fallback)))


# ---------------------------------------------------------------- rewriting the vocabulary


def expanded_outcomes(found: DataFrame) -> DataFrame:
    """(code, outcomes): the outcomes of each subtopic from what was read of it (code, ord, num, text, parts of letter and text), in order.

    Lettered parts are outcomes of their own, each after the shared text; one without parts needs a text."""
    clean = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    text, key = clean(F.col("text")), F.concat("code", F.lit("-"), F.col("num").cast("string"))
    part = lambda p: F.struct(F.concat(key, p["letter"]).alias("id"), F.when(text != "", F.concat(text, F.lit(" ("), p["letter"], F.lit(") "), clean(p["text"]))).otherwise(clean(p["text"])).alias("text"))
    whole = F.when(text != "", F.array(F.struct(key.alias("id"), text.alias("text")))).otherwise(F.array().cast("array<struct<id:string,text:string>>"))
    own = F.when(F.size("parts") > 0, F.transform("parts", part)).otherwise(whole)
    rows = found.select("code", "ord", own.alias("own"))
    return rows.groupBy("code").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "own"))), lambda s: s["own"])).alias("outcomes"))


def merged_vocabulary(topics: DataFrame, found: DataFrame) -> DataFrame:
    """topics with the learning outcomes of every subtopic as they were read; topics, subtopics and all their other fields stay as they
    are and where they are. A subtopic of which nothing was read has none."""
    none = F.array().cast("array<struct<id:string,text:string>>")
    subs = topics.select(F.col("code").alias("_topic"), F.posexplode("subtopics").alias("_at", "_sub"))
    met = subs.join(expanded_outcomes(found).select(F.col("code").alias("_code"), F.col("outcomes").alias("_outcomes")), F.col("_sub.code") == F.col("_code"), "left")
    filled = F.col("_sub").withField("learning_outcomes", F.coalesce("_outcomes", none))
    back = met.groupBy("_topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", filled.alias("_sub")))), lambda s: s["_sub"]).alias("_subs"))
    out = topics.join(back, F.col("code") == F.col("_topic"), "left")
    return out.select(*[F.coalesce("_subs", "subtopics").alias(c) if c == "subtopics" else F.col(c) for c in topics.columns])


def vocabulary_counts(topics: DataFrame) -> DataFrame:
    """One row: subtopics, their outcomes, and subtopics without any."""
    rows = topics.select(F.explode("subtopics").alias("s")).select(F.size("s.learning_outcomes").alias("n"))
    return rows.agg(F.count("*").alias("subtopics"), F.coalesce(F.sum("n"), F.lit(0)).alias("outcomes"), F.count_if(F.col("n") == 0).alias("empty"))
