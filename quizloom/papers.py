"""Queries over papers, mark schemes, reports, vocabularies and notes that are composed of the driver's tables.

What an operator takes apart was put together from known columns, so the SQL states those columns and doesn't parse anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .composed import joined, said
from .functions import keys, text
from .operators import assemble, audit, enrich, registry, relational, reports, similarity, split, stats
from .plans.rules import SelectRules, select
from .queries import ANSWERS_SQL, BANK_SQL, FIRST, answers, bank, long, query, table


# ---------------------------------------------------------------- papers and mark schemes

ASKED_SQL = "asked AS (SELECT o_custkey * 10000 + (r - 1) // 20 AS doc, o_orderkey, o_orderstatus, (r - 1) % 20 + 1 AS k FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders))"
STEM_SQL = "k || ' Explain how order number ' || o_orderkey || ' was priced.'"
PART_SQL = {"a": "'(a) State the status ' || o_orderstatus || ' of it.'", "b": "'(b) Give the order a name.'"}


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of a customer as the questions k of papers of up to 20."""
    r = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = table(spark, sf_dir, "orders").withColumn("r", r)
    return rows.select((F.col("o_custkey") * 10000 + F.floor((F.col("r") - 1) / 20)).alias("doc"), "o_orderkey", "o_orderstatus", ((F.col("r") - 1) % 20 + 1).alias("k"))


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    page = F.when(k % 5 == 1, said("----- PAGE ", F.floor((k - 1) / 5) + 1, " -----\n")).otherwise("")
    body = said(page, k, " Explain how order number ", F.col("o_orderkey"), " was priced.\n(a) State the status ", F.col("o_orderstatus"), " of it.\n(b) Give the order a name.\n© UCLES 2021")
    return asked(spark, sf_dir).groupBy("doc").agg(said("Answer all questions.\n", joined(F.struct("k", body.alias("text")))).alias("text"))


def schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks of both parts; every seventh question has none."""
    k = F.col("k")
    body = said(k, "(a)\nM1 for the status ", F.col("o_orderstatus"), "\n", k, "(b)\nA1 for a name")
    return asked(spark, sf_dir).filter(k % 7 != 0).groupBy("doc").agg(joined(F.struct("k", body.alias("text"))).alias("text"))


@query(f"WITH {ASKED_SQL} SELECT doc, CAST(k AS VARCHAR) AS question, k AS ord, 2 + (k - 1) // 5 + 1 + 4 * (k - 1) AS start_line, (k - 1) // 5 + 1 AS page, 'structured' AS style, {STEM_SQL} || chr(10) || {PART_SQL['a']} || chr(10) || {PART_SQL['b']} AS text FROM asked")
def split_questions(spark, sf_dir):
    found = split.questions(papers(spark, sf_dir))
    return found.select("doc", "question", long(F.col("ord")).alias("ord"), long(F.col("start_line")).alias("start_line"), long(F.col("page")).alias("page"), "style", "text")


PARTS_SQL = f"parts AS ({' UNION ALL '.join(f'''SELECT doc, k, CAST(k AS VARCHAR) AS question, k || '({p})' AS label, k || '{p}' AS slug, CAST({i} AS BIGINT) AS part_ord, {STEM_SQL} || chr(10) || {PART_SQL[p]} AS text FROM asked''' for i, p in enumerate('ab', 1))})"


@query(f"WITH {ASKED_SQL}, {PARTS_SQL} SELECT doc, question, label, slug, part_ord, text FROM parts")
def split_parts(spark, sf_dir):
    return split.parts(split.questions(papers(spark, sf_dir))).select("doc", "question", "label", "slug", long(F.col("part_ord")).alias("part_ord"), "text")


@query(f"WITH {ASKED_SQL}, {PARTS_SQL} SELECT doc, label, CASE WHEN part_ord = 1 THEN k || '(b)' ELSE '' END AS later FROM parts")
def later_siblings(spark, sf_dir):
    chunks = split.parts(split.questions(papers(spark, sf_dir)))
    return split.later_siblings(chunks).select("doc", "label", F.array_join("later", ",").alias("later"))


BLOCK_SQL = {"a": "k || '(a)' || chr(10) || 'M1 for the status ' || o_orderstatus", "b": "k || '(b)' || chr(10) || 'A1 for a name'"}


@query(f"WITH {ASKED_SQL} " + " UNION ALL ".join(f"SELECT doc, k || '({p})' AS label, {BLOCK_SQL[p]} AS block FROM asked WHERE k % 7 <> 0" for p in "ab"))
def mark_scheme_blocks(spark, sf_dir):
    return split.mark_blocks(schemes(spark, sf_dir)).select("doc", "label", "block")


@query(f"WITH {ASKED_SQL} SELECT doc, CAST(k AS VARCHAR) AS question, {BLOCK_SQL['a']} || chr(10) || chr(10) || {BLOCK_SQL['b']} AS block FROM asked WHERE k % 7 <> 0")
def marks_by_question(spark, sf_dir):
    return split.marks_by_parent(split.mark_blocks(schemes(spark, sf_dir))).select("doc", "question", "block")


@query(f"WITH {ASKED_SQL} " + " UNION ALL ".join(f"SELECT doc, k || '({p})' AS label, CASE WHEN k % 7 <> 0 THEN {BLOCK_SQL[p]} END AS mark_scheme FROM asked" for p in "ab"))
def marks_bound_to_parts(spark, sf_dir):
    marks = split.mark_blocks(schemes(spark, sf_dir))
    chunks = split.parts(split.questions(papers(spark, sf_dir)))
    return split.bind_marks(chunks, marks, split.marks_by_parent(marks)).select("doc", "label", "mark_scheme")


@query("SELECT o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS q, substr('ABCD', CAST(o_orderkey % 4 AS INTEGER) + 1, 1) AS a FROM orders")
def answer_keys(spark, sf_dir):
    q = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), q.alias("q"), said(q, " ", F.substr(F.lit("ABCD"), (F.col("o_orderkey") % 4 + 1).cast("int"), F.lit(1)), " 1").alias("text"))
    keyed = rows.groupBy("doc").agg(joined(F.struct("q", "text")).alias("text"))
    return keyed.select("doc", F.explode(text.answer_key(F.col("text"))).alias("p")).select("doc", F.col("p.q").cast("long").alias("q"), "p.a")


# ---------------------------------------------------------------- reports

REPORT_SQL = """named AS (
    SELECT n_nationkey AS doc, CAST(n_nationkey % 10 + 1 AS BIGINT) AS question, 'easy' AS band, NULL AS notes FROM nation
    UNION ALL SELECT n_nationkey, n_nationkey % 7 + 20, 'particularly_difficult', NULL FROM nation
    UNION ALL SELECT n_nationkey, 35, NULL, 'Most of ' || n_name || ' did this well.' FROM nation)"""


@query(f"WITH {REPORT_SQL} SELECT doc, 2021 AS year, 'MJ' AS session, '11' AS paper, CAST(question AS VARCHAR) AS question, band, CASE band WHEN 'easy' THEN 2 WHEN 'particularly_difficult' THEN 5 END AS difficulty, notes FROM named")
def report_questions(spark, sf_dir):
    n = F.col("n_nationkey")
    body = said(
        "9701 Chemistry June 2021\nPaper 9701/11\nMultiple Choice\nGeneral comments\nQuestion ", n % 10 + 1, " were found to be easy. Question ", n % 7 + 20,
        " were found to be particularly difficult.\nComments on specific questions\nQuestion 35\nMost of ", F.col("n_name"), " did this well.",
    )
    found = reports.questions(table(spark, sf_dir, "nation").select(n.alias("doc"), body.alias("text")))
    return found.select("doc", "year", "session", "paper", "question", F.col("examiner_band").alias("band"), "difficulty", F.col("examiner_notes").alias("notes"))


@query(f"WITH {REPORT_SQL}, r AS (SELECT *, doc % 3 AS p FROM named) SELECT 2021 AS year, 'MJ' AS session, '1' || p AS paper, count(*) FILTER (WHERE notes IS NOT NULL) AS with_comments, count(*) FILTER (WHERE band IS NOT NULL AND notes IS NULL) AS with_band_only, count(*) FILTER (WHERE false) AS in_key FROM r GROUP BY p")
def report_paper_stats(spark, sf_dir):
    rows = report_questions(spark, sf_dir).select(
        "year", "session", said("1", F.col("doc") % 3).alias("paper"), F.col("notes").alias("examiner_notes"), F.col("band").alias("examiner_band"), F.lit(None).cast("string").alias("ms_key"),
    )
    return reports.paper_stats(rows)


ER_PAPER = "(doc_id // 240) || '-' || (doc_id % 3)"


@query(f"""WITH q AS (SELECT doc_id, CAST(2020 + doc_id % 2 AS INTEGER) AS year, {ER_PAPER} AS paper, doc_id // 6 % 40 AS main, CAST(n_chars % 5 + 1 AS INTEGER) AS difficulty FROM documents),
r AS (SELECT CAST(2020 + doc_id % 2 AS INTEGER) AS year, {ER_PAPER} AS paper, doc_id // 6 % 40 AS main, quality FROM labels WHERE doc_id % 6 <> 5)
SELECT q.doc_id, CASE WHEN r.main IS NULL THEN q.difficulty WHEN r.quality = 1 THEN 2 ELSE 5 END AS difficulty, CASE WHEN r.main IS NULL THEN NULL WHEN r.quality = 1 THEN 'easy' ELSE 'particularly_difficult' END AS band,
    CASE WHEN s.paper IS NOT NULL THEN q.year END AS er_year, CASE WHEN s.paper IS NOT NULL THEN q.paper END AS er_paper, CASE WHEN s.paper IS NOT NULL THEN 'report' END AS source
FROM q LEFT JOIN r ON q.year = r.year AND q.paper = r.paper AND q.main = r.main LEFT JOIN (SELECT DISTINCT year, paper FROM r) s ON q.year = s.year AND q.paper = s.paper""")
def enrich_many_papers(spark, sf_dir):
    """Papers of forty questions whose numbers collide, each with its own report; every sixth paper has none."""
    i, none, strings = F.col("doc_id"), F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    scope = [(2020 + i % 2).cast("int").alias("year"), F.lit("MJ").alias("session"), said(F.floor(i / 240), "-", i % 3).alias("paper")]
    questions = table(spark, sf_dir, "documents").select(
        "doc_id", *scope, F.lit("").alias("parent_question"), said(F.floor(i / 6) % 40, "(a)").alias("question"), (F.col("n_chars") % 5 + 1).cast("int").alias("difficulty"), strings.alias("misconceptions"), strings.alias("common_errors"),
        *[none.alias(c) for c in (*enrich.KEPT_IF_NULL, "er_session", "er_paper", "examiner_report_source")], *[F.lit(0.5).alias(c) for c in enrich.NULLED], F.lit(None).cast("int").alias("er_year"),
    )
    easy = F.col("quality") == 1
    rows = table(spark, sf_dir, "labels").filter(i % 6 != 5).select(
        *scope, said(F.floor(i / 6) % 40).alias("question"), F.when(easy, "easy").otherwise("particularly_difficult").alias("examiner_band"), F.when(easy, 2).otherwise(5).alias("difficulty"),
        none.alias("common_incorrect"), strings.alias("common_errors"), none.alias("examiner_notes"), none.alias("difficulty_source"), *[F.lit(None).cast("double").alias(c) for c in enrich.NULLED],
    )
    return enrich.merge_reports(questions, rows, None, "report").select("doc_id", "difficulty", F.col("examiner_band").alias("band"), "er_year", "er_paper", F.col("examiner_report_source").alias("source"))


# ---------------------------------------------------------------- vocabulary and tags

LEVEL_SQL = "CASE WHEN r_regionkey % 2 = 0 THEN 'AS' ELSE 'A' END"


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as topics, nations as subtopics with an outcome each."""
    code = said(F.col("n_regionkey") + 1, ".", F.col("n_nationkey") + 1)
    sub = F.struct(code.alias("code"), F.col("n_name").alias("title"), F.array(F.struct(said(code, "-1").alias("id"), said("know ", F.col("n_name")).alias("text"))).alias("learning_outcomes"))
    subs = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list(sub).alias("subtopics"))
    r = table(spark, sf_dir, "region").join(subs, F.col("r_regionkey") == F.col("n_regionkey"))
    return r.select(said(F.col("r_regionkey") + 1).alias("code"), F.col("r_name").alias("title"), F.when(F.col("r_regionkey") % 2 == 0, "AS").otherwise("A").alias("level"), "subtopics")


@query(f"""SELECT CAST(r_regionkey + 1 AS VARCHAR) AS code, r_name || ' [' || {LEVEL_SQL} || ']' AS title, {LEVEL_SQL} AS level, CAST(r_regionkey + 1 AS VARCHAR) AS major FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)
UNION ALL SELECT (r_regionkey + 1) || '.' || (n_nationkey + 1), n_name, {LEVEL_SQL}, CAST(r_regionkey + 1 AS VARCHAR) FROM nation JOIN region ON n_regionkey = r_regionkey""")
def vocabulary_codes(spark, sf_dir):
    return enrich.vocabulary(topics(spark, sf_dir))[0]


@query(f"SELECT (r_regionkey + 1) || '.' || (n_nationkey + 1) || '-1' AS lo_id, (r_regionkey + 1) || '.' || (n_nationkey + 1) AS parent_code, 'know ' || n_name AS text, {LEVEL_SQL} AS level FROM nation JOIN region ON n_regionkey = r_regionkey")
def vocabulary_outcomes(spark, sf_dir):
    return enrich.vocabulary(topics(spark, sf_dir))[1]


@query("SELECT c_custkey, (n_regionkey + 1) || '.' || (n_nationkey + 1) AS code FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey % 2 = 0")
def codes_of_level(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return enrich.of_level(rows.select("c_custkey", said(F.col("n_regionkey") + 1, ".", F.col("n_nationkey") + 1).alias("code")), enrich.vocabulary(topics(spark, sf_dir))[0])


@query("SELECT s_suppkey AS id, 'know ' || n_name AS texts FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT s_suppkey, '' FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation)")
def outcome_texts(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    records = rows.select(F.col("s_suppkey").alias("id"), F.array(F.lit("9.9-9"), F.coalesce(said(F.col("n_regionkey") + 1, ".", F.col("n_nationkey") + 1, "-1"), F.lit(""))).alias("los"))
    out = enrich.looked_up(records, "los", enrich.vocabulary(topics(spark, sf_dir))[1], "lo_id", "text", "texts")
    return out.select("id", F.array_join("texts", "|").alias("texts"))


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'recall,explain' WHEN p_size % 3 = 1 THEN 'explain,recall' ELSE 'recall' END AS skills, CASE WHEN p_size % 4 = 0 THEN 'practical' ELSE 'mcq' END AS question_type,
    CASE WHEN p_size % 7 = 0 THEN 2 ELSE CAST(p_size % 7 AS INTEGER) END AS difficulty, '3.2,9.1' AS codes, concat_ws(',', CASE WHEN p_size % 5 = 0 THEN 'no_codes' END, CASE WHEN p_size % 7 = 6 THEN 'difficulty_range' END) AS problems FROM part""")
def checked_tags(spark, sf_dir):
    s = F.col("p_size")
    strings = lambda *v: F.array(*map(F.lit, v))
    records = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.when(s % 3 == 0, strings(" recall ", "juggle", "explain", "recall")).when(s % 3 == 1, strings("explain", "recall ")).otherwise(strings("recall", "other")).alias("skills"),
        F.when(s % 4 == 0, " practical").when(s % 4 == 1, "quiz").alias("question_type"), F.when(s % 7 != 0, s % 7).cast("int").alias("difficulty"),
        F.when(s % 5 != 0, strings(" 3.2", "3.2")).alias("syllabus_codes"), strings("3.2-1", "9.1-4b").alias("learning_outcomes"),
    )
    out = enrich.checked_tags(records)
    return out.select("id", F.array_join("skills", ",").alias("skills"), "question_type", "difficulty", F.array_join("syllabus_codes", ",").alias("codes"), F.array_join("problems", ",").alias("problems"))


@query("SELECT c_custkey AS id, (n_regionkey + 1) || '.' || (n_nationkey + 1) || '-1' AS outcomes FROM customer JOIN nation ON c_nationkey = n_nationkey")
def default_outcomes(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    records = rows.select(F.col("c_custkey").alias("id"), F.array(F.lit("0.0"), said(F.col("n_regionkey") + 1, ".", F.col("n_nationkey") + 1)).alias("syllabus_codes"))
    return enrich.default_outcomes(records, enrich.vocabulary(topics(spark, sf_dir))[1]).select("id", F.array_join("outcomes", ",").alias("outcomes"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'recall,draw' WHEN p_size % 3 = 1 THEN 'recall' ELSE 'explain' END AS skills FROM part")
def normal_skills(spark, sf_dir):
    s, strings = F.col("p_size"), lambda *v: F.array(*map(F.lit, v))
    skills = F.when(s % 3 == 0, strings("name", "draw", "recall")).when(s % 3 == 1, strings("juggle")).otherwise(strings("explain", "explain"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(enrich.normal_skills(skills, {"name": "recall", "define": "recall"}), ",").alias("skills"))


# ---------------------------------------------------------------- hand-outs and selection


@query(f"WITH {BANK_SQL}, f AS ({FIRST.format(where='marks <= 9')}) SELECT id, _path FROM f WHERE n = 1 ORDER BY md5(id || ':42') LIMIT 100")
def select_shuffled(spark, sf_dir):
    return select(bank(spark, sf_dir), SelectRules.of({"title": "Any", "max_marks": 9, "shuffle": True, "seed": 42, "count": 100})).select("id", "_path")


@query("""WITH q AS (SELECT doc_id, doc_id % 12 + 1 AS t, doc_id % 4 + 1 AS s, least(doc_id % 5, doc_id % 3) AS x, doc_id % 13 = 0 AS untagged, 2000 + doc_id % 24 AS year, lang, CAST(doc_id % 41 AS VARCHAR) AS question FROM documents)
SELECT doc_id, CASE WHEN untagged THEN '' ELSE t || '.' || s || '-' || x END AS outcome, row_number() OVER (ORDER BY untagged, CASE WHEN NOT untagged THEN t END, CASE WHEN NOT untagged THEN s END, CASE WHEN NOT untagged THEN x END, year, coalesce(lang, ''), question, doc_id) AS seq,
    CASE WHEN untagged THEN '' ELSE 'text ' || x END AS group_text FROM q""")
def grouped_handout(spark, sf_dir):
    i = F.col("doc_id")
    lo = lambda x: said(i % 12 + 1, ".", i % 4 + 1, "-", x)
    none = F.array().cast("array<string>")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (2000 + i % 24).cast("int").alias("year"), F.col("lang").alias("paper"), said(i % 41).alias("question"), i.alias("ord"),
        F.when(i % 13 == 0, none).otherwise(F.array(lo(i % 5), lo(i % 3))).alias("learning_outcomes"), F.when(i % 13 == 0, none).otherwise(F.array(said("text ", i % 5), said("text ", i % 3))).alias("learning_outcome_texts"),
    )
    return assemble.grouped(rows).select("doc_id", F.col("primary").alias("outcome"), "seq", "group_text")


@query("SELECT p_name, row_number() OVER (ORDER BY p_partkey) AS seq FROM part WHERE p_partkey IN (SELECT s_suppkey * 3 FROM supplier)")
def pruned_handout(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_name", long(F.col("p_partkey")).alias("seq"))
    return assemble.prune(rows, table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 3).alias("seq"))).select("p_name", "seq")


@query("SELECT s_suppkey AS doc, 'q' || s_suppkey || '-1' AS id, 'link' AS kind, CAST(1 AS BIGINT) AS seq FROM supplier UNION ALL SELECT s_suppkey, 's' || s_suppkey, 'image', 2 FROM supplier UNION ALL SELECT s_suppkey, 'q' || s_suppkey || '-2', 'link', 3 FROM supplier")
def linked_ids(spark, sf_dir):
    i = F.col("s_suppkey")
    body = said("![[assets/s", i, "-paper.png]] then [[tagged/q", i, "-1]]\n[[tagged/q", i, "-2]] again [[tagged/q", i, "-1]]")
    notes = table(spark, sf_dir, "supplier").select(i.alias("doc"), body.alias("text"))
    return assemble.linked_ids(notes, {"link": r"\[\[tagged/([^\]]+)\]\]", "image": r"!\[\[assets/([^\]]+?)-paper\.png\]\]"})


@query("SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 45)")
def missing_ids(spark, sf_dir):
    built = table(spark, sf_dir, "part").filter("p_size < 45").select(F.col("p_partkey").alias("id"))
    return assemble.missing(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id")).distinct(), built)


@query("SELECT doc_id FROM documents WHERE contains(lower(source || ' ' || lang || ' ' || text), 'license') ORDER BY doc_id LIMIT 200")
def search_bank(spark, sf_dir):
    return relational.search(table(spark, sf_dir, "documents"), [F.col(c) for c in ("source", "lang", "text")], " LICENSE ", [F.col("doc_id")]).select("doc_id")


@query("""WITH w AS (SELECT s_suppkey AS id, unnest(['a/' || s_suppkey, 'b/' || s_suppkey]) AS path, unnest([0, 1]) AS pos FROM supplier), f AS (SELECT CASE c_custkey % 3 WHEN 0 THEN 'a/' WHEN 1 THEN 'b/' ELSE '../c/' END || c_custkey AS path FROM customer)
SELECT id, arg_min(w.path, pos) AS path FROM w JOIN f ON w.path = f.path GROUP BY id""")
def resolved_assets(spark, sf_dir):
    i, c = F.col("s_suppkey"), F.col("c_custkey")
    files = table(spark, sf_dir, "customer").select(said(F.when(c % 3 == 0, "a/").when(c % 3 == 1, "b/").otherwise("../c/"), c).alias("path"))
    wanted = table(spark, sf_dir, "supplier").withColumn("id", i)
    return relational.first_existing(wanted, F.array(said("../c/", i), said("a/", i), said("b/", i)), files, "id")


@query("SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'tagged' WHEN 2 THEN 'extracted' ELSE 'exported' END AS status FROM supplier WHERE s_suppkey % 4 IN (0, 2) ORDER BY s_suppkey LIMIT 20")
def registry_batch(spark, sf_dir):
    i = F.col("s_suppkey")
    status = F.when(i % 4 == 0, "pending").when(i % 4 == 1, "tagged").when(i % 4 == 2, "extracted").otherwise("exported")
    return registry.batch(table(spark, sf_dir, "supplier").select(i.alias("id"), status.alias("status")), "pending, extracted", 20)


# ---------------------------------------------------------------- answers


@query(f"""WITH {ANSWERS_SQL}, i AS (SELECT *, sum(correct::INT) OVER (PARTITION BY student_id, question_id ORDER BY answered_at, id ROWS UNBOUNDED PRECEDING) AS since FROM a),
m AS (SELECT student_id, question_id, max(since) AS last FROM i GROUP BY ALL), s AS (SELECT i.student_id, i.question_id, count(*) FILTER (WHERE since = last AND NOT correct) AS mistakes FROM i JOIN m ON i.student_id = m.student_id AND i.question_id = m.question_id GROUP BY ALL)
SELECT student_id, count(*) AS seen, count(*) FILTER (WHERE mistakes > 0) AS wrong, CAST(floor(count(*) FILTER (WHERE mistakes = 0) / count(*) * 100 + 0.5) AS BIGINT) AS acc FROM s GROUP BY student_id""")
def learner_progress(spark, sf_dir):
    return stats.progress(stats.streaks(answers(spark, sf_dir), ["student_id", "question_id"], ["answered_at", "id"]), ["student_id"])


@query("""WITH i AS (SELECT DISTINCT l_suppkey AS code, l_orderkey AS id FROM lineitem) SELECT code, count(*) FILTER (WHERE o_orderstatus = 'O') AS selected, count(*) AS total FROM i JOIN orders ON id = o_orderkey GROUP BY code""")
def code_coverage(spark, sf_dir):
    index = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("code"), F.col("l_orderkey").alias("id")).distinct()
    known = index.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), "id", "left_semi")
    return stats.coverage(known, table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id")))


@query("""WITH r AS (SELECT sha256(CAST(to_json({'p_partkey': p_partkey, 'p_name': p_name, 'p_size': p_size}) AS VARCHAR)) AS d FROM part), f AS (SELECT left(d, 5) AS b, sha256(string_agg(d, '' ORDER BY d)) AS d FROM r GROUP BY left(d, 5)),
t AS (SELECT left(f.b, 2) AS c, sha256(string_agg(f.d, '' ORDER BY f.b)) AS d FROM f GROUP BY left(f.b, 2)) SELECT left(sha256(string_agg(d, '' ORDER BY c)), 12) AS version FROM t""")
def content_digest(spark, sf_dir):
    return similarity.content_version(table(spark, sf_dir, "part"), "p_partkey", ["p_name", "p_size"])


# ---------------------------------------------------------------- names, notes and lines

NAME_SQL = "'x/9701_' || substr('swm', CAST(s_suppkey % 3 AS INTEGER) + 1, 1) || lpad(CAST(s_suppkey * 7 % 100 AS VARCHAR), 2, '0') || CASE WHEN s_suppkey % 2 = 0 THEN '_qp_' ELSE '_p' END || (s_suppkey % 4 + 1) || (s_suppkey % 3 + 1) || '.pdf'"


@query("""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'MJ' WHEN 1 THEN 'ON' ELSE 'FM' END AS session, CAST(CASE WHEN s_suppkey * 7 % 100 < 80 THEN 2000 ELSE 1900 END + s_suppkey * 7 % 100 AS BIGINT) AS year, CAST((s_suppkey % 4 + 1) * 10 + s_suppkey % 3 + 1 AS BIGINT) AS paper,
    CASE WHEN s_suppkey % 4 < 2 THEN 'AS' ELSE 'A' END AS level, 'cie-9701-' || (CASE WHEN s_suppkey * 7 % 100 < 80 THEN 2000 ELSE 1900 END + s_suppkey * 7 % 100) || '-' || CASE s_suppkey % 3 WHEN 0 THEN 'mj' WHEN 1 THEN 'on' ELSE 'fm' END || '-p' || ((s_suppkey % 4 + 1) * 10 + s_suppkey % 3 + 1) || '-q3ai-x' AS id FROM supplier""")
def paper_names(spark, sf_dir):
    i = F.col("s_suppkey")
    name = said("x/9701_", F.substr(F.lit("swm"), (i % 3 + 1).cast("int"), F.lit(1)), F.lpad((i * 7 % 100).cast("string"), 2, "0"), F.when(i % 2 == 0, "_qp_").otherwise("_p"), i % 4 + 1, i % 3 + 1, ".pdf")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", keys.paper_meta(name).alias("m"))
    return rows.select("s_suppkey", "m.session", long(F.col("m.year")).alias("year"), long(F.col("m.paper")).alias("paper"), "m.level", keys.question_id(F.col("m"), F.lit("3(a)(i).x")).alias("id"))


@query("SELECT s_suppkey, CAST(s_suppkey + 1 AS VARCHAR) AS year, 'a=b' AS paper, CAST(2 AS BIGINT) AS n FROM supplier")
def name_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", keys.pairs(said("year=", F.col("s_suppkey"), ", paper = a=b,junk,, year=", F.col("s_suppkey") + 1)).alias("m"))
    return rows.select("s_suppkey", F.col("m")["year"].alias("year"), F.col("m")["paper"].alias("paper"), long(F.size("m")).alias("n"))


@query("SELECT p_partkey, 'id: ' || p_partkey AS front, 'About ' || p_name || '.' AS about, 'Marks ' || p_size AS marks, '' AS other FROM part")
def note_sections(spark, sf_dir):
    note = said("---\nid: ", F.col("p_partkey"), "\n---\n# ", F.col("p_name"), "\n## Question\n\nAbout ", F.col("p_name"), ".\n\n## Mark scheme \nMarks ", F.col("p_size"), "\n")
    rows = table(spark, sf_dir, "part").select("p_partkey", text.front_and_body(note).alias("n"))
    body = F.col("n.body")
    return rows.select("p_partkey", F.trim("n.front").alias("front"), text.section(body, "Question").alias("about"), text.section(body, "Mark scheme").alias("marks"), text.section(body, "Notes").alias("other"))


LINES = ["C OH =", "+ −", "a word stays", "A Br", "| H | O |", "C H", "− C O−", "NO WAY HERE"]
SALAD = [True, True, False, False, False, False, True, False]


@query(f"SELECT p_partkey, [{', '.join(str(v).lower() for v in SALAD)}][CAST(p_partkey % 8 AS INTEGER) + 1] AS salad FROM part")
def drawing_lines(spark, sf_dir):
    line = F.element_at(F.array(*map(F.lit, LINES)), (F.col("p_partkey") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", text.atom_salad(line).alias("salad"))


@query("SELECT p_partkey, 'Which is it?' || chr(10) || 'A ' || p_brand || chr(10) || 'B two' || chr(10) || 'C ' || p_size || ' g' || chr(10) || 'D none' || chr(10) || 'end' AS lines, CASE WHEN p_size % 2 = 0 THEN 'Which is it?' || chr(10) || 'end' ELSE 'Which is it?' || chr(10) || 'A ' || p_brand || chr(10) || 'B two' || chr(10) || 'D none' || chr(10) || 'end' END AS stem FROM part")
def option_rows(spark, sf_dir):
    packed = said("Which is it? A ", F.col("p_brand"), " B two C ", F.col("p_size"), " g D none\nend")
    listed = said("Which is it?\nA ", F.col("p_brand"), "\nB two\nD none\nend")
    return table(spark, sf_dir, "part").repartition("p_partkey").select("p_partkey", text.option_lines(packed).alias("lines"), text.without_repeated_options(listed, F.col("p_size") % 2 == 0).alias("stem"))


@query("SELECT p_partkey, 'a → b − c×' || p_size AS plain, CAST(p_size AS BIGINT) AS marks, CASE WHEN p_size % 2 = 0 THEN 'Explain,State' ELSE 'Explain,Draw' END AS commands FROM part")
def question_facts(spark, sf_dir):
    body = said("Draw", F.when(F.col("p_size") % 2 == 0, "n and state").otherwise(" it"), " [1], explain ", "[", F.col("p_size"), "] [x]")
    odd = said("a  b  c", F.col("p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", text.characters(odd).alias("plain"), long(text.last_marks(body)).alias("marks"), F.array_join(text.command_words(body), ",").alias("commands"))


WORDS_SQL = "w AS (SELECT doc_id, text, list_filter(regexp_extract_all(lower(text), '[a-z]{5,}'), lambda x: x <> 'there') AS a FROM documents)"


@query(f"WITH {WORDS_SQL}, k AS (SELECT doc_id, text, list_slice(list_filter(a, lambda x, i: list_position(a, x) = i), 1, 4) AS words FROM w) SELECT doc_id, array_to_string(words, ',') AS words, CAST(len(list_filter(words, lambda x: regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])' || x || '($|[^\\p{{L}}\\p{{N}}_])'))) AS BIGINT) AS hits FROM k")
def first_words(spark, sf_dir):
    words = text.distinctive_words(F.col("text"), ["there"], 4, 5)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(words, ",").alias("words"), long(text.word_hits(words, F.col("text"))).alias("hits"))


# ---------------------------------------------------------------- audit gates

NOTE_GATES = [
    ("empty_LO", "doc_id % 5 <> 0 AND doc_id % 4 = 0", "''"), ("empty_practical_topic", "doc_id % 15 = 0", "''"), ("unknown_practical_topic", "doc_id % 15 = 10", "'Juggling'"),
    ("empty_question_body", "doc_id % 9 = 0", "''"), ("invented_facility", "doc_id % 50 = 0", "''"),
]


@query(" UNION ALL ".join(f"SELECT doc_id AS id, '{code}' AS code, {detail} AS detail FROM documents WHERE {where}" for code, where, detail in NOTE_GATES))
def record_findings(spark, sf_dir):
    i = F.col("doc_id")
    notes = table(spark, sf_dir, "documents").select(
        i.alias("id"), F.when(i % 5 == 0, "Practical").otherwise("mcq").alias("question_type"), F.when(i % 15 == 5, " Titrations").when(i % 15 == 10, "Juggling").alias("practical_topic"),
        F.when(i % 4 != 0, F.array(F.lit("1.1-1"))).alias("learning_outcomes"), F.when(i % 9 == 0, "![[x.png]]\n ").otherwise("text").alias("body"), F.when(i % 50 == 0, 0.5).alias("facility"), F.lit(None).cast("double").alias("percent_correct"),
    )
    return audit.record_findings(notes)


@query("SELECT c_custkey AS id, 'unknown_code' AS code, 'N' || c_nationkey AS detail FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 3 <> 0) UNION ALL SELECT c_custkey, 'unknown_LO', 'L' || c_custkey FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def vocabulary_findings(spark, sf_dir):
    notes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.array(said("N", F.col("c_nationkey"))).alias("syllabus_codes"), F.array(said("L", F.col("c_custkey"))).alias("learning_outcomes"))
    known = table(spark, sf_dir, "nation").filter("n_nationkey % 3 <> 0").select(said("N", F.col("n_nationkey")).alias("code"))
    return audit.vocabulary_findings(notes, known, table(spark, sf_dir, "supplier").select(said("L", F.col("s_suppkey")).alias("lo_id")))


@query("""SELECT doc_id AS id, 'missing_paper_png' AS code, '' AS detail FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'missing_paper_embed', '' FROM documents WHERE doc_id % 2 = 1
UNION ALL SELECT doc_id, 'tiny_paper_png', CASE WHEN doc_id % 7 = 0 THEN '100 bytes' ELSE '5000 bytes' END FROM documents WHERE doc_id % 3 <> 0 AND (doc_id % 7 = 0 OR doc_id % 11 = 0)""")
def file_findings(spark, sf_dir):
    i = F.col("doc_id")
    path = said("assets/", i, "-paper.png")
    docs = table(spark, sf_dir, "documents")
    notes = docs.select(i.cast("string").alias("id"), F.when(i % 2 == 0, said("![[", path, "]]")).otherwise("text").alias("body"))
    files = docs.filter(i % 3 != 0).select(path.alias("path"), F.when(i % 7 == 0, 100).otherwise(5000).alias("size"), F.when(i % 11 == 0, 50).otherwise(200).alias("height"))
    return audit.file_findings(notes, files).withColumn("id", F.col("id").cast("long"))
