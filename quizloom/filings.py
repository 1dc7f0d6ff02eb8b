"""Queries over files that are written from the driver's tables and read again, and over the small rules beside them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import papers
from .composed import said
from .functions import keys
from .functions.text import section
from .operators import relational, stats
from .plans.rules import SelectRules, select
from .queries import ANSWERS_SQL, BANK_SQL, FIRST, answers, bank, long, query, table
from .sources import readers, store, writers


def folder(spark: SparkSession) -> str:
    return f"{store.shared_folder(spark)}/quizloom/{uuid.uuid4().hex}/files"


def filed(rows: DataFrame, path: Column, value: Column) -> str:
    """The rows as files of a folder."""
    root = folder(rows.sparkSession)
    store.write_files(rows.select(path.alias("path"), value.alias("value"), F.lit(False).alias("gone")), root)
    return root


def dealt(i: Column) -> Column:
    """One of 256 folders: a folder of millions of files is more than some stores take, and one task lists it."""
    return said(F.crc32(i.cast("string").cast("binary")) % 256, "/")


# ---------------------------------------------------------------- records, drafts and notes


def tagged_files(spark: SparkSession, sf_dir: str) -> str:
    """A file a document: some are no JSON, no object, without an id or in another folder; years may be texts and marks no numbers."""
    i = F.col("doc_id")
    year = F.when(i % 5 == 0, said('"', 2000 + i % 24, '"')).otherwise(said(2000 + i % 24))
    body = said('{"id": "', F.when(i % 17 == 2, "").otherwise(said("q", i)), '", "year": ', year, ', "marks": ', F.when(i % 7 == 0, "true").otherwise(said(i % 9)), F.when(i % 3 == 0, "").otherwise(said(', "syllabus_codes": ["', i % 12 + 1, '.1", 5]')), ', "extra": {"n": 1}}')
    value = F.when(i % 17 == 0, said("{", i)).when(i % 17 == 1, said("[", i, "]")).otherwise(body)
    return filed(table(spark, sf_dir, "documents"), said("p", dealt(i), F.when(i % 17 == 3, "drafts/q").otherwise("tagged/q"), i, ".json"), value)


@query("""SELECT 'q' || doc_id AS id, CAST(2000 + doc_id % 24 AS INTEGER) AS year, CASE WHEN doc_id % 7 <> 0 THEN CAST(doc_id % 9 AS INTEGER) END AS marks, CASE WHEN doc_id % 3 = 0 THEN '' ELSE (doc_id % 12 + 1) || '.1,5' END AS codes FROM documents WHERE doc_id % 17 > 3""")
def tagged_records(spark, sf_dir):
    rows = readers.questions(spark, tagged_files(spark, sf_dir))
    marks = F.when(F.col("id").substr(2, 20).cast("long") % 7 != 0, F.col("marks"))  # true is read as 1 where it is cast
    return rows.select("id", "year", marks.alias("marks"), F.array_join("syllabus_codes", ",").alias("codes"))


@query("SELECT 'q' || doc_id AS stem, CASE doc_id % 17 WHEN 0 THEN 'not_json' WHEN 1 THEN 'not_object' ELSE 'no_id' END AS reason FROM documents WHERE doc_id % 17 < 3")
def rejected_records(spark, sf_dir):
    return readers.rejected_questions(spark, tagged_files(spark, sf_dir)).select(F.regexp_extract("_path", r"([^/]+)\.json$", 1).alias("stem"), "reason")


@query("SELECT CAST(c_custkey AS VARCHAR) || CASE WHEN c_custkey % 4 = 0 THEN 'a-i' ELSE '' END AS question, 'Order of ' || c_name AS text FROM customer")
def draft_files(spark, sf_dir):
    i = F.col("c_custkey")
    name = F.when(i % 4 == 0, said("q", i, "a-i.txt")).when(i % 4 == 1, said("q00", i, ".txt")).otherwise(said("q", i, ".txt"))
    return readers.drafts(spark, filed(table(spark, sf_dir, "customer"), said(dealt(i), name), said("Order of ", F.col("c_name")))).select("question", "text")


@query("SELECT c_custkey AS question, row_number() OVER (ORDER BY c_custkey) AS place FROM customer ORDER BY c_custkey LIMIT 25")
def first_drafts(spark, sf_dir):
    i = F.col("c_custkey")
    rows = readers.drafts(spark, filed(table(spark, sf_dir, "customer"), said(dealt(i), "q", i, ".txt"), F.col("c_name")), limit=25)
    return relational.numbered(rows.select(F.col("question").cast("long").alias("question")), [F.col("question")], "place")


def hub_files(spark: SparkSession, sf_dir: str) -> str:
    """A hub note a supplier: one in three has no title, one in five no code."""
    i = F.col("s_suppkey")
    code = F.when(i % 5 == 0, "").otherwise(said('"code": "', i, '.1"', F.when(i % 3 == 0, "").otherwise(", ")))
    title = F.when(i % 3 == 0, "").otherwise(said('"title": "', F.col("s_name"), '"'))
    return filed(table(spark, sf_dir, "supplier"), said("hubs/h", i, ".md"), said("---\n{", code, title, "}\n---\n# ", F.col("s_name"), "\n## Notes\nSee ", i, "\n"))


@query("SELECT s_suppkey || '.1' AS code, CASE WHEN s_suppkey % 3 = 0 THEN 'h' || s_suppkey ELSE s_name END AS title FROM supplier WHERE s_suppkey % 5 <> 0")
def hub_titles(spark, sf_dir):
    return readers.code_titles(spark, hub_files(spark, sf_dir))


@query("SELECT 'h' || s_suppkey AS stem, 'See ' || s_suppkey AS notes FROM supplier WHERE contains('h' || s_suppkey, 'h1') OR contains('h' || s_suppkey, '7')")
def notes_by_stem(spark, sf_dir):
    return readers.notes(spark, hub_files(spark, sf_dir), ["h1", "7"]).select("stem", section(F.col("body"), "Notes").alias("notes"))


@query("SELECT p_partkey AS id, CAST(strlen(p_name) AS BIGINT) AS size FROM part WHERE p_size % 2 = 0")
def listed_files(spark, sf_dir):
    rows = table(spark, sf_dir, "part")
    i = F.col("p_partkey")
    root = filed(rows, said(F.when(F.col("p_size") % 2 == 0, "a/").otherwise("b/"), dealt(i), i, ".txt"), F.col("p_name"))
    found = readers.listing(spark, root, "*.txt").filter(F.contains("path", F.lit("/a/")))
    return found.select(F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long").alias("id"), "size")


# ---------------------------------------------------------------- picks, partitions, bundles


@query(f"""WITH {BANK_SQL}, f AS ({FIRST.format(where='marks <= 9')}), p AS (SELECT *, row_number() OVER (ORDER BY marks, _path) AS place FROM f WHERE n = 1)
SELECT 'some-marks' AS slug, CAST(place - 1 AS INTEGER) AS place, id, marks, array_to_string(syllabus_codes, ',') AS codes FROM p ORDER BY place LIMIT 40""")
def pick_read_back(spark, sf_dir):
    """A pick is written as one file and read again."""
    rules = SelectRules.of({"title": "Some marks", "max_marks": 9, "sort": "marks", "count": 40})
    every = bank(spark, sf_dir)
    picked = relational.numbered(select(every, rules), rules.order(), "ord")
    path = folder(spark)
    writers.write_pick(writers.pick_payload(picked, rules, every), path)
    return readers.pick(spark, path).select("slug", F.col("ord").alias("place"), "id", "marks", F.array_join("syllabus_codes", ",").alias("codes"))


@query("SELECT doc_id, lang, CASE WHEN lang = 'de' THEN 'again' ELSE 'once' END AS said FROM documents WHERE lang <> 'de' OR doc_id % 2 = 0")
def partitions_replaced(spark, sf_dir):
    """All partitions are written, then one of them anew with half of its rows."""
    path = folder(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    writers.write_partitions(docs.withColumn("said", F.lit("once")), path, ["lang"])
    writers.write_partitions(docs.filter("lang = 'de' and doc_id % 2 = 0").withColumn("said", F.lit("again")), path, ["lang"])
    return spark.read.schema("doc_id long, said string, lang string").parquet(path)


FIGURES_SQL = "f AS (SELECT c_custkey AS id, c_custkey % 4 <> 1 AS has_paper, c_custkey % 6 <> 2 AS has_ms, c_custkey % 5 <> 3 AS on_disk FROM customer)"


def illustrated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    i = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer")
    figures = F.array_compact(F.array(said("x/", i, "-1.png"), F.when(i % 6 != 2, said("x/", i, "-ms.png")), F.when(i % 4 != 1, said("x/", i, "-paper.png")), said("x/", i, "-2-paper.png")))
    files = rows.filter(i % 5 != 3).select(F.explode(F.array(said("assets/", i, "-paper.png"), said("assets/", i, "-2-paper.png"))).alias("path")).unionByName(rows.select(said("assets/", i, "-ms.png").alias("path")))
    return writers.illustrated(rows.select(i.alias("id"), figures.alias("figures")), files)


@query(f"WITH {FIGURES_SQL} SELECT id, 'assets/structured/' || id || CASE WHEN has_paper THEN '' ELSE '-2' END || '-paper.png' AS paper_img, 'assets/structured/' || id || '-ms.png' AS ms_img FROM f WHERE has_ms AND on_disk")
def illustrated_questions(spark, sf_dir):
    return illustrated(spark, sf_dir)[0].select("id", "paper_img", "ms_img")


@query(f"WITH {FIGURES_SQL} SELECT id, CASE WHEN NOT has_ms THEN 'missing figure entries' ELSE 'missing image file' END AS reason FROM f WHERE NOT (has_ms AND on_disk)")
def skipped_questions(spark, sf_dir):
    return illustrated(spark, sf_dir)[1]


@query("SELECT p_partkey, p_name, p_size FROM part")
def bundle_lines(spark, sf_dir):
    """A JSON line a question, written as text and read again."""
    path = folder(spark)
    writers.bundle(table(spark, sf_dir, "part"), ["p_partkey", "p_name", "p_size"]).write.text(path)
    return spark.read.schema("p_partkey long, p_name string, p_size int").json(path)


# ---------------------------------------------------------------- driver files


@query("SELECT s_suppkey || '_qp' AS id, CAST(2000 + s_suppkey % 24 AS INTEGER) AS year, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'exported' END AS status FROM supplier")
def registry_read(spark, sf_dir):
    """The registry as one YAML file."""
    i = F.col("s_suppkey")
    entry = said("- {id: '", i, "_qp', year: ", 2000 + i % 24, F.when(i % 3 == 0, "").otherwise(", status: exported"), "}\n")
    whole = table(spark, sf_dir, "supplier").agg(F.concat(F.lit("papers:\n"), F.array_join(F.array_sort(F.collect_list(entry)), "")).alias("value"))
    return readers.registry(spark, filed(whole, F.lit("papers.yaml"), F.col("value")) + "/papers.yaml").select("id", "year", "status")


@query("SELECT CAST(n_regionkey + 1 AS VARCHAR) AS topic, (n_regionkey + 1) || '.' || (n_nationkey + 1) AS code, n_name AS title, CAST(1 AS BIGINT) AS outcomes FROM nation")
def vocabulary_read(spark, sf_dir):
    """The vocabulary as one YAML file, in JSON flow."""
    whole = papers.topics(spark, sf_dir).agg(F.to_json(F.struct(F.collect_list(F.struct("code", "title", "level", "subtopics")).alias("topics"))).alias("value"))
    tree = readers.vocabulary(spark, filed(whole, F.lit("v.yaml"), F.col("value")) + "/v.yaml")
    return tree.select(F.col("code").alias("topic"), F.explode("subtopics").alias("s")).select("topic", "s.code", "s.title", long(F.size("s.learning_outcomes")).alias("outcomes"))


# ---------------------------------------------------------------- small rules


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'a/h' || c_custkey || '.md' WHEN 1 THEN CASE WHEN c_custkey % 3 = 0 THEN 'b' ELSE 'a' END || '/h' || c_custkey || '.md' WHEN 2 THEN 'a/h' || c_custkey || '.md' END AS path FROM customer WHERE c_custkey % 4 < 2 OR c_custkey = 2""")
def handouts_found(spark, sf_dir):
    """Names asked for as paths, as stems (in either folder), as a part of one stem, or as nothing that is there."""
    i = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer")
    inside = F.when((i % 4 == 1) & (i % 3 == 0), "b/h").otherwise("a/h")
    files = rows.filter(i % 4 < 3).select(said(inside, i, ".md").alias("path"), F.when((i % 4 == 1) & (i % 3 == 0), 2).otherwise(1).alias("place"))
    only = files.withColumn("path", F.when(F.col("path") == "a/h2.md", "a/h2 rare.md").otherwise(F.col("path")))
    asked = rows.select("c_custkey", F.when(i % 4 == 0, said("a/h", i, ".md")).when(i % 4 == 1, said("h", i)).when(i == 2, "2 rar").otherwise("nowhere").alias("asked"))
    return asked.join(relational.resolved_names(asked, only), "asked").select("c_custkey", F.replace("path", F.lit(" rare"), F.lit("")).alias("path"))


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN false WHEN p_size % 4 = 1 THEN true ELSE p_size % 3 = 0 OR p_size % 8 = 7 END AS options, p_size % 3 <> 1 AS by_name,
    CASE WHEN p_size % 3 = 2 THEN 0 WHEN p_size % 3 = 1 THEN -p_size ELSE p_size END AS number, CASE WHEN p_size % 5 = 0 THEN '?' ELSE CAST(2000 + p_size AS VARCHAR) END || ' ' || CASE WHEN p_size % 2 = 0 THEN 'MJ ' ELSE '' END || CASE WHEN p_size % 7 = 0 THEN '' ELSE 'P' || p_size END AS label,
    CASE WHEN length(p_name) > 8 THEN left(p_name, 8) || '…' ELSE p_name END AS short FROM part""")
def question_labels(spark, sf_dir):
    s = F.col("p_size")
    kind = F.when(s % 4 == 0, "Practical").when(s % 4 == 1, "MCQ").otherwise(F.lit(None).cast("string"))
    paper = F.when(s % 8 == 7, F.lit(None).cast("string")).when(s % 3 == 0, "12").otherwise("21")
    name = F.when(s % 3 == 0, "9701_s21_QP_11.pdf").when(s % 3 == 1, "9701_s21_qp_21.pdf").otherwise("notes.pdf")
    number = F.when(s % 3 == 2, "x7").when(s % 3 == 1, said(" -", s, "a")).otherwise(said(s, "(a)"))
    session = F.when(s % 2 == 0, "MJ").otherwise("")
    return table(spark, sf_dir, "part").select(
        "p_partkey", keys.has_options(kind, paper).alias("options"), keys.name_needs_options(name).alias("by_name"), keys.leading_int(number).alias("number"),
        keys.source_label(F.when(s % 5 != 0, 2000 + s), session, F.when(s % 7 != 0, s)).alias("label"), keys.one_line(F.replace("p_name", F.lit(" "), F.lit(" \n ")), 8).alias("short"),
    )


@query(f"""WITH {ANSWERS_SQL}, s AS (SELECT student_id, question_id, bool_or(correct) AS ok FROM a GROUP BY ALL), q AS (SELECT DISTINCT question_id FROM a), w AS (SELECT DISTINCT student_id FROM a),
c AS (SELECT student_id, question_id FROM w, q WHERE (student_id + length(question_id)) % 2 = 0)
SELECT c.student_id, count(*) AS questions, count(s.ok) AS done, CAST(coalesce(floor(count(*) FILTER (WHERE s.ok) / nullif(count(s.ok), 0) * 100 + 0.5), 0) AS BIGINT) AS acc FROM c LEFT JOIN s ON c.student_id = s.student_id AND c.question_id = s.question_id GROUP BY c.student_id""")
def round_summaries(spark, sf_dir):
    """A learner's round: the questions whose name is of the right length."""
    a = answers(spark, sf_dir)
    states = stats.streaks(a, ["student_id", "question_id"], ["answered_at", "id"])
    kinds = a.groupBy().agg(F.collect_set("question_id").alias("kinds"))  # the few kinds of an event
    rounds = a.select("student_id").distinct().crossJoin(F.broadcast(kinds)).select("student_id", F.explode("kinds").alias("question_id"))
    current = rounds.filter((F.col("student_id") + F.length("question_id")) % 2 == 0)
    return stats.round_summary(states, current, by=["student_id"])
