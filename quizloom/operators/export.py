"""Notes of papers: records joined with their drafts and figures, gated, and written out as notes that link to each other.

All papers are exported by one plan. A paper with a record that lacks a figure it must have is left out whole, and its findings are
rows; the notes are rows of (path, kind, value), which sources/store.py versions and writes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import part_id, part_key, part_slug
from ..functions.text import garbage, strip, without_footers, without_key, without_repeated_options
from ..sources.writers import note, wikilink
from .similarity import related

MARKER = "--- MARK SCHEME ---"  #: fixed: what parts a draft's question from its marks
PAPER = "paper_id"


def draft_stem(question: Column) -> Column:
    """The name of the draft of a question: q and its part's slug, or its number."""
    return F.concat(F.lit("q"), F.coalesce(F.nullif(part_slug(part_id(question)), F.lit("")), question))


def with_drafts(records: DataFrame, drafts: DataFrame) -> DataFrame:
    """records (paper_id, question, ...) with body and drafted_marks of their draft (paper_id, stem, text): that of the part, else of the number.

    The body is what stands before the marker, without page feet."""
    by_stem = drafts.select(PAPER, F.col("stem").alias("_stem"), F.col("text").alias("_own"))
    by_number = drafts.select(PAPER, F.col("stem").alias("_plain"), F.col("text").alias("_shared"))
    keyed = records.withColumn("_stem", draft_stem(F.col("question"))).withColumn("_plain", F.concat(F.lit("q"), F.col("question")))
    raw = F.coalesce("_own", "_shared")
    marks = F.when(F.contains(raw, F.lit(MARKER)), strip(F.substring_index(raw, MARKER, -1)))
    met = keyed.join(by_stem, [PAPER, "_stem"], "left").join(by_number, [PAPER, "_plain"], "left")
    return met.withColumn("body", without_footers(F.substring_index(raw, MARKER, 1))).withColumn("drafted_marks", marks).drop("_stem", "_plain", "_own", "_shared")


def with_figures(records: DataFrame, figures: DataFrame) -> DataFrame:
    """records with the paths of their figures (paper_id, question, path, ord), by kind and in order."""
    name = F.substring_index("path", "/", -1)
    kind = F.when(F.contains(name, F.lit("-ms.")), "ms").when(F.contains(name, F.lit("-paper.")), "paper").otherwise("diagram")
    rows = figures.withColumn("kind", kind)
    lists = [F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("ord", "path")))), lambda s: s["path"]).alias(f"{k}_figures") for k in ("paper", "ms", "diagram")]
    return records.join(rows.groupBy(PAPER, "question").agg(*lists), [PAPER, "question"], "left")


def gathered(records: DataFrame, drafts: DataFrame, figures: DataFrame, needs_marks: Column | None = None) -> DataFrame:
    """records with body, mark_scheme, figures by kind, and problem: missing_draft, missing_paper_clip, missing_ms_clip or null.

    Options that the clip shows leave the body, and so does the shared key; marks that can't be read give way to their figure."""
    rows = with_figures(with_drafts(records, drafts), figures)
    has = lambda k: F.coalesce(F.size(f"{k}_figures") > 0, F.lit(False))
    problem = F.when(F.col("body").isNull(), "missing_draft").when(~has("paper"), "missing_paper_clip")
    if needs_marks is not None:
        problem = problem.when(needs_marks & ~has("ms"), "missing_ms_clip")
    marks = F.coalesce(F.nullif(F.col("mark_scheme"), F.lit("")) if "mark_scheme" in records.columns else F.lit(None).cast("string"), "drafted_marks")
    rows = rows.withColumn("problem", problem).withColumn("mark_scheme", F.when(has("ms") & garbage(marks), "").otherwise(marks))
    return rows.withColumn("body", without_repeated_options(without_key(F.col("body")), has("paper"))).drop("drafted_marks")


def whole_papers(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records of papers without any problem, and the findings (paper_id, id, problem) of the others."""
    found = rows.filter("problem is not null").select(PAPER, "id", "problem")
    return rows.join(found.select(PAPER).distinct(), PAPER, "left_anti").drop("problem"), found


def links(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda i: F.concat(F.lit("- [["), i, F.lit("]]"))), "\n")


def listed(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str] = ("id",)) -> DataFrame:
    """keys and ids: the ids of each key in order."""
    return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col("id").alias("_id")))), lambda s: s["_id"]).alias("ids"))


def heading(title: Column, *paragraphs: Column) -> Column:
    return F.concat_ws("\n\n", F.concat(F.lit("# "), title), *paragraphs)


def question_notes(rows: DataFrame, front: Sequence[Column | str], k: int = 8) -> DataFrame:
    """A note for each record, with its clips, text, marks and the records of its paper that share most codes."""
    near = related(rows.select(PAPER, "id", F.explode("syllabus_codes").alias("code")), [PAPER], k)
    lists = near.groupBy(PAPER, "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "other"))), lambda s: s["other"]).alias("_related"))
    embeds = lambda c: F.array_join(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda f: F.concat(F.lit("![["), f, F.lit("]]"))), "\n\n")
    text = lambda *parts: F.concat_ws("\n\n", *[F.nullif(p, F.lit("")) for p in parts])
    codes = F.array_join(F.transform("syllabus_codes", lambda c: F.concat(F.lit("- [[syllabus/"), c, F.lit("]]"))), "\n")
    sections = {
        "Question": text(F.coalesce("body", F.lit(""))), "Diagram": embeds(F.col("diagram_figures")), "Mark Scheme": text(embeds(F.col("ms_figures")), F.coalesce("mark_scheme", F.lit(""))),
        "Syllabus": codes, "Related": F.coalesce(links(F.col("_related")), F.lit("")),
    }
    value = note(front, sections, F.col("paper_figures"))
    return rows.join(lists, [PAPER, "id"], "left").select(F.concat(F.lit("questions/"), "id", F.lit(".md")).alias("path"), F.lit("question").alias("kind"), value.alias("value"))


def code_notes(rows: DataFrame, titles: DataFrame) -> DataFrame:
    """A hub for each code in use (code, title) and for the topic above it, with links to its records."""
    used = rows.select("id", F.explode(F.array_distinct("syllabus_codes")).alias("code"))
    above = used.filter(F.contains("code", F.lit("."))).select(F.substring_index("code", ".", 1).alias("code")).distinct()
    hubs = listed(used, ["code"]).unionByName(above.join(used.select("code").distinct(), "code", "left_anti").withColumn("ids", F.array().cast("array<string>")))
    named = hubs.join(titles.select("code", "title"), "code", "left")
    parent = F.when(F.contains("code", F.lit(".")), F.concat(F.lit("Above: [[syllabus/"), F.substring_index("code", ".", 1), F.lit("]]")))
    value = heading(F.concat_ws(" ", "code", "title"), parent, F.nullif(links(F.col("ids")), F.lit("")))
    return named.select(F.concat(F.lit("syllabus/"), "code", F.lit(".md")).alias("path"), F.lit("code").alias("kind"), value.alias("value"))


def outcome_notes(rows: DataFrame, outcomes: DataFrame) -> DataFrame:
    """A hub for each learning outcome in use, with its text (lo_id, parent_code, text) and its code."""
    used = listed(rows.select("id", F.explode(F.array_distinct(F.filter("learning_outcomes", lambda x: F.trim(x) != ""))).alias("lo_id")), ["lo_id"])
    named = used.join(outcomes.select("lo_id", "parent_code", "text"), "lo_id", "left")
    above = F.coalesce("parent_code", F.regexp_extract("lo_id", r"^(.*)-[^-]*$", 1))
    value = heading(F.col("lo_id"), F.col("text"), F.concat(F.lit("Above: "), wikilink(above, F.lit(None).cast("string"))), links(F.col("ids")))
    return named.select(F.concat(F.lit("syllabus/lo/"), "lo_id", F.lit(".md")).alias("path"), F.lit("outcome").alias("kind"), value.alias("value"))


def paper_notes(rows: DataFrame) -> DataFrame:
    """A hub for each paper, with its records in the order of their parts, and an index for each question that has parts."""
    order = [part_key(F.col("question")).alias("place")]
    hubs = listed(rows, [PAPER], order).select(F.concat(F.lit("papers/"), PAPER, F.lit(".md")).alias("path"), F.lit("paper").alias("kind"), heading(F.col(PAPER), links(F.col("ids"))).alias("value"))
    parents = listed(rows.filter(F.coalesce("parent_question", F.lit("")) != ""), [PAPER, "parent_question"], order)
    name = F.concat(F.col(PAPER), F.lit("-q"), "parent_question")
    value = heading(F.concat(F.lit("Question "), "parent_question"), F.concat(F.lit("[[papers/"), PAPER, F.lit("]]")), links(F.col("ids")))
    return hubs.unionByName(parents.select(F.concat(F.lit("questions/"), name, F.lit(".md")).alias("path"), F.lit("index").alias("kind"), value.alias("value")))


def notes(rows: DataFrame, titles: DataFrame, outcomes: DataFrame, front: Sequence[Column | str]) -> DataFrame:
    """All notes (path, kind, value) of the records of whole papers."""
    return question_notes(rows, front).unionByName(code_notes(rows, titles)).unionByName(outcome_notes(rows, outcomes)).unionByName(paper_notes(rows))
