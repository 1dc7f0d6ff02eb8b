"""Tags by rules that are rows: each text takes the first rule that it matches and that the vocabulary can carry out.

Rules are (place, scope, pattern, codes, outcomes, skills). Codes and outcomes that the vocabulary lacks leave a rule by a semi-join, and
a rule without any left is no rule. The rules that are left become one expression, the smallest place of a pattern that matches, so the
texts are read once and never joined with rules; what a rule gives is joined by its place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classify import stem_of
from ..functions.keyword_tables import BODY_KEYWORDS, FALLBACK_KEYWORDS, ORGANIC, ORGANIC_CODE, OTHER_CODE, OUTCOME_KEYWORDS, SKILL_NAMES, STEM_KEYWORDS
from .enrich import default_outcomes, normal_skills

RULES = "place int, scope string, pattern string, codes array<string>, outcomes array<string>, skills array<string>, needs_outcome boolean"
MOST_RULES = 1000  #: rules that one expression may hold


def rule_rows(spark: SparkSession, outcomes: Sequence[tuple] = tuple(OUTCOME_KEYWORDS), stems: Sequence[tuple] = tuple(STEM_KEYWORDS), bodies: Sequence[tuple] = tuple(BODY_KEYWORDS + FALLBACK_KEYWORDS)) -> DataFrame:
    """Rules with outcomes first, then those for stems, then those for whole texts."""
    rows = [("body", "(?i)", *r, True) for r in outcomes] + [("stem", "(?is)", p, c, "", s, False) for p, c, s in stems] + [("body", "(?is)", p, c, "", s, False) for p, c, s in bodies]
    return spark.createDataFrame([(i, scope, flags + p, c.split(), o.split(), s.split(), needs) for i, (scope, flags, p, c, o, s, needs) in enumerate(rows)], RULES)


def known_rules(rules: DataFrame, codes: DataFrame, outcomes: DataFrame) -> DataFrame:
    """rules with the codes (code) and outcomes (lo_id) that are known, in their order; those without a code, or without an outcome that
    they need, are left out."""

    def kept(column: str, known: DataFrame) -> DataFrame:
        values = rules.select("place", F.posexplode(column).alias("at", "value")).join(known.select(F.col(known.columns[0]).alias("value")).distinct(), "value", "left_semi")
        return values.groupBy("place").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda s: s["value"]).alias(column))

    own = rules.drop("codes", "outcomes").join(kept("codes", codes.select("code")), "place").join(kept("outcomes", outcomes.select("lo_id")), "place", "left")
    full = own.withColumn("outcomes", F.coalesce("outcomes", F.array().cast("array<string>")))
    return full.filter(~F.col("needs_outcome") | (F.size("outcomes") > 0)).select(rules.columns)


def first_place(rules: DataFrame, stem: Column, body: Column) -> Column:
    """The smallest place of a rule whose pattern its text matches; null where none does. Patterns are compiled once."""
    rows = rules.select("place", "scope", "pattern").orderBy("place").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    hits = [F.when((stem if r["scope"] == "stem" else body).rlike(r["pattern"]), F.lit(r["place"])) for r in rows]
    return F.coalesce(*hits, F.lit(None).cast("int"))


def tagged(records: DataFrame, rules: DataFrame, codes: DataFrame, outcomes: DataFrame, body: str = "body") -> DataFrame:
    """records (id, body) with syllabus_codes, learning_outcomes, skills and the place of their rule.

    A rule without outcomes gives the first outcome of each of its codes. Where no rule is left for a text, its topic is that of organic
    or of other questions, or the vocabulary's first."""
    usable = known_rules(rules, codes, outcomes)
    text = F.coalesce(F.col(body), F.lit(""))
    placed = records.withColumn("rule", first_place(usable, stem_of(text), text))
    given = usable.select(F.col("place").alias("rule"), F.col("codes").alias("_codes"), F.col("outcomes").alias("_outcomes"), F.col("skills").alias("_skills"))
    spare = codes.filter(F.col("code").isin(ORGANIC_CODE, OTHER_CODE)).agg(F.collect_set("code").alias("spare")).join(codes.agg(F.min("code").alias("least")))
    met = placed.join(F.broadcast(given), "rule", "left").crossJoin(F.broadcast(spare))  # at most MOST_RULES rows, and one
    wanted = F.when(text.rlike(ORGANIC), ORGANIC_CODE).otherwise(OTHER_CODE)
    fallback = F.array(F.when(F.array_contains("spare", wanted), wanted).otherwise(F.col("least")))
    met = met.withColumn("syllabus_codes", F.coalesce("_codes", fallback)).drop("_codes", "spare", "least")
    first = default_outcomes(met.filter(F.coalesce(F.size("_outcomes"), F.lit(0)) <= 0), outcomes).withColumnRenamed("outcomes", "_first")
    none = F.array().cast("array<string>")
    own = F.when(F.size("_outcomes") > 0, F.col("_outcomes")).otherwise(F.coalesce("_first", none))
    skills = normal_skills(F.coalesce("_skills", none), SKILL_NAMES)
    return met.join(first, "id", "left").withColumn("learning_outcomes", own).withColumn("skills", skills).select(*records.columns, "syllabus_codes", "learning_outcomes", "skills", "rule")


def sidecars(tags: DataFrame) -> DataFrame:
    """Rows (path, value, gone) of a file for each tagged draft (id, question, ...) and one index of all: ids, codes and rules in the order of ids."""
    own = tags.select(F.concat(F.lit("tagged/q"), "question", F.lit(".json")).alias("path"), F.to_json(F.struct(*[c for c in tags.columns if c != "body"])).alias("value"))
    line = F.to_json(F.struct("id", "syllabus_codes", "rule"))
    index = tags.groupBy(F.substring_index("id", "-q", 1).alias("paper")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))), lambda s: s["line"]), "\n").alias("value"))
    return own.unionByName(index.select(F.concat(F.lit("tagged/index-"), "paper", F.lit(".jsonl")).alias("path"), "value")).withColumn("gone", F.lit(False))
