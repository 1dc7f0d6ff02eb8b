"""The engine's operators over the driver's tables, each with SQL that gives the same rows.

The tables stand in for a question bank: documents and parts for questions, line items for codes and for
an assignment's questions, events for answers (user = learner, event type = question, anything but an
error = right), customers for learners, regions and nations for a vocabulary tree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import keys, text
from .functions.classify import Rule, first_match
from .operators import assemble, audit, enrich, geometry, registry, relational, similarity, stats
from .plans.rules import SelectRules, select
from .sources import store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long(c: Column) -> Column:
    return c.cast("long")


# ---------------------------------------------------------------- the bank

BANK_SQL = """
bank AS (
    SELECT d.doc_id, 'q' || (d.doc_id % 997) AS id, lpad(CAST(d.doc_id AS VARCHAR), 12, '0') AS _path, CAST(2000 + d.doc_id % 24 AS INTEGER) AS year,
        d.lang AS paper, (d.doc_id % 41) || CASE WHEN d.doc_id % 3 = 0 THEN '(a)' WHEN d.doc_id % 3 = 1 THEN '(b)(i)' ELSE '' END AS question,
        CAST(d.n_chars % 11 AS INTEGER) AS marks, [(d.doc_id % 12 + 1) || '.' || (d.doc_id % 4 + 1), (d.doc_id % 7 + 1) || '.' || (d.doc_id % 3 + 1) || 'b'] AS syllabus_codes,
        [d.source, upper(d.lang)] AS topic_titles, CASE WHEN d.doc_id % 5 = 0 THEN 'Structured' ELSE 'mcq' END AS question_type, CAST(1 + l.quality + 2 * l.toxic AS INTEGER) AS difficulty, d.text AS body
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
"""


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    i = F.col("doc_id")
    part = F.when(i % 3 == 0, "(a)").when(i % 3 == 1, "(b)(i)").otherwise("")
    s = lambda c: c.cast("string")
    return d.select(
        "doc_id",
        F.concat(F.lit("q"), s(i % 997)).alias("id"),
        F.lpad(s(i), 12, "0").alias("_path"),
        (2000 + i % 24).cast("int").alias("year"),
        F.col("lang").alias("paper"),
        F.concat(s(i % 41), part).alias("question"),
        (F.col("n_chars") % 11).cast("int").alias("marks"),
        F.array(F.concat(s(i % 12 + 1), F.lit("."), s(i % 4 + 1)), F.concat(s(i % 7 + 1), F.lit("."), s(i % 3 + 1), F.lit("b"))).alias("syllabus_codes"),
        F.array("source", F.upper("lang")).alias("topic_titles"),
        F.when(i % 5 == 0, "Structured").otherwise("mcq").alias("question_type"),
        (1 + F.col("quality") + 2 * F.col("toxic")).cast("int").alias("difficulty"),
        F.col("text").alias("body"),
    )


CODE_OF = "split_part({c}, '.', 1)::BIGINT * 1000000 + regexp_extract(split_part({c}, '.', 2), '^[0-9]+')::BIGINT"
FIRST = "SELECT *, row_number() OVER (PARTITION BY id ORDER BY _path) AS n FROM bank WHERE {where}"
NATURAL = "CAST(regexp_extract(question, '^[0-9]+') AS BIGINT), regexp_replace(question, '^[0-9]+', '')"


def placed(df: DataFrame, columns: list[str], order: list[Column]) -> DataFrame:
    """Places over the whole order, numbered bucket by bucket of the first order column's years."""
    return relational.numbered(df, order, "place", bucket=F.col("year")).select(*columns, "place")


RULES = {"title": "Early topics", "syllabus_codes": ["3.3", "5.1", "2.2b", "6.2"], "exclude_after": "9.2", "year_min": 2003, "year_max": 2020, "max_marks": 9, "question_type": "MCQ"}


@query(f"""WITH {BANK_SQL}, f AS ({FIRST.format(where=f"list_has_any(syllabus_codes, ['3.3', '5.1', '2.2b', '6.2']) AND len(list_filter(syllabus_codes, lambda c: {CODE_OF.format(c='c')} >= 9000002)) = 0 AND year BETWEEN 2003 AND 2020 AND marks <= 9 AND lower(question_type) = 'mcq'")})
SELECT id, _path, year, question, marks, row_number() OVER (ORDER BY year, {NATURAL}, _path) AS place FROM f WHERE n = 1""")
def select_rules(spark, sf_dir):
    rules = SelectRules.of(RULES)
    return placed(select(bank(spark, sf_dir), rules), ["id", "_path", "year", "question", "marks"], rules.order())


@query(f"""WITH {BANK_SQL}, f AS ({FIRST.format(where="difficulty BETWEEN 2 AND 3 AND len(list_filter(topic_titles, lambda t: contains(lower(t), 'src1'))) > 0")})
SELECT id, _path, marks FROM f WHERE n = 1 ORDER BY marks, _path LIMIT 25""")
def select_topic_count(spark, sf_dir):
    rules = SelectRules.of({"title": "Some", "topic_title": "SRC1", "difficulty_min": 2, "difficulty_max": 3, "sort": "marks", "count": 25})
    return select(bank(spark, sf_dir), rules).select("id", "_path", "marks")


PART_CODE = "p_size || '.' || (p_partkey % 9) || CASE WHEN p_partkey % 4 = 0 THEN 'b' WHEN p_partkey % 11 = 0 THEN '.x' ELSE '' END"


@query(f"""WITH c AS (SELECT p_partkey, {PART_CODE} AS code FROM part)
SELECT p_partkey, code, split_part(code, '.', 1)::BIGINT AS topic, regexp_extract(split_part(code, '.', 2), '^[0-9]+')::BIGINT AS sub FROM c
WHERE NOT ({CODE_OF.format(c='code')} >= 23000004)""")
def select_exclude_after(spark, sf_dir):
    p, s = F.col("p_partkey"), lambda c: c.cast("string")
    tail = F.when(p % 4 == 0, "b").when(p % 11 == 0, ".x").otherwise("")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(s(F.col("p_size")), F.lit("."), s(p % 9), tail).alias("code"))
    key = keys.code_key(F.col("code"))
    return rows.filter(key < F.struct(F.lit(23).alias("topic"), F.lit(4).alias("sub"))).select("p_partkey", "code", long(key["topic"]).alias("topic"), long(key["sub"]).alias("sub"))


@query("SELECT p_partkey, p_type FROM part WHERE contains(lower(p_type), 'co') AND lower(p_brand) = 'brand#2'")
def select_topic_contains(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(F.contains(F.lower("p_type"), F.lit("co")) & (F.lower("p_brand") == "brand#2")).select("p_partkey", "p_type")


@query("SELECT sha256(text) AS digest, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY text")
def dedupe_first(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query(f"WITH {BANK_SQL}, f AS ({FIRST.format(where='true')}) SELECT id, _path, difficulty FROM f WHERE n = 1")
def dedupe_by_id_in_path_order(spark, sf_dir):
    return relational.first_by(bank(spark, sf_dir), ["id"], [F.col("_path")]).select("id", "_path", "difficulty")


@query("""WITH k AS (SELECT p_partkey, (p_partkey % 120) || p_brand AS label FROM part)
SELECT p_partkey, label, CAST(regexp_extract(label, '^[0-9]+') AS BIGINT) AS n, regexp_replace(label, '^[0-9]+', '') AS rest,
    row_number() OVER (PARTITION BY p_partkey % 50 ORDER BY CAST(regexp_extract(label, '^[0-9]+') AS BIGINT), regexp_replace(label, '^[0-9]+', ''), p_partkey) AS place FROM k""")
def natural_sort(spark, sf_dir):
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat((F.col("p_partkey") % 120).cast("string"), "p_brand").alias("label"))
    k = keys.question_key(F.col("label"))
    w = Window.partitionBy(F.col("p_partkey") % 50).orderBy(k, "p_partkey")
    return rows.select("p_partkey", "label", long(k["n"]).alias("n"), k["rest"].alias("rest"), long(F.row_number().over(w)).alias("place"))


@query("SELECT p_partkey, md5(p_partkey || ':42') AS key FROM part ORDER BY md5(p_partkey || ':42') LIMIT 100")
def seeded_shuffle(spark, sf_dir):
    key = F.md5(F.concat_ws(":", F.col("p_partkey").cast("string"), F.lit("42")))
    return table(spark, sf_dir, "part").select("p_partkey", key.alias("key")).orderBy("key").limit(100)


# ---------------------------------------------------------------- hand-outs


@query("""WITH p AS (SELECT l_orderkey, min(l_partkey) AS main FROM lineitem GROUP BY l_orderkey),
o AS (SELECT o_orderkey, o_custkey, o_orderdate, main, coalesce(main, 0) AS g FROM orders LEFT JOIN p ON o_orderkey = l_orderkey)
SELECT o_orderkey, main, row_number() OVER (ORDER BY main IS NULL, main, o_orderdate, o_orderkey) AS seq FROM o""")
def group_primary_global_seq(spark, sf_dir):
    main = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("main"))
    o = table(spark, sf_dir, "orders").join(main, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    order = [F.col("main").isNull(), F.col("main"), F.col("o_orderdate"), F.col("o_orderkey")]
    bucket = F.coalesce(F.floor(F.col("main") / 64), F.lit(1 << 60))
    return relational.numbered(o, order, "seq", bucket=bucket).select("o_orderkey", "main", "seq")


@query("SELECT count(*) AS questions, CAST(sum(p_size) AS BIGINT) AS marks FROM part")
def handout_totals(spark, sf_dir):
    return assemble.totals(table(spark, sf_dir, "part").select(F.col("p_size").alias("marks")))


@query(f"WITH {BANK_SQL}, v AS (SELECT doc_id, unnest(topic_titles) AS value, generate_subscripts(topic_titles, 1) AS pos FROM bank) SELECT value, min(doc_id) AS first_doc, count(*) AS n FROM v GROUP BY value")
def topics_in_order(spark, sf_dir):
    rows = bank(spark, sf_dir).select("doc_id", F.posexplode("topic_titles").alias("pos", "v"))
    first = relational.distinct_in_order(rows, F.col("v"), F.struct("doc_id", "pos"))
    n = rows.groupBy(F.col("v").alias("value")).agg(F.count("*").alias("n"))
    return first.join(n, "value").select("value", F.col("ord.doc_id").alias("first_doc"), "n")


@query("""WITH s AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq FROM orders)
SELECT o_custkey, o_orderkey, seq AS old_seq, row_number() OVER (PARTITION BY o_custkey ORDER BY seq) AS seq FROM s WHERE seq IN (1, 3, 4)""")
def prune_renumber(spark, sf_dir):
    from pyspark.sql import Window

    own = Window.partitionBy("o_custkey")
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(own.orderBy("o_orderdate", "o_orderkey")).alias("old_seq"))
    keep = assemble.parse_keep(F.lit("1,3,x,0,4"))
    kept = rows.filter(F.array_contains(keep, F.col("old_seq")))
    return kept.select("o_custkey", "o_orderkey", long(F.col("old_seq")).alias("old_seq"), long(F.row_number().over(own.orderBy("old_seq"))).alias("seq"))


@query(f"WITH {BANK_SQL} SELECT doc_id, 'No ' || doc_id || ' · ' || year || ' · Q' || question || ' · ' || marks || ' 分' AS caption FROM bank")
def captions(spark, sf_dir):
    rows = bank(spark, sf_dir).withColumn("session", F.lit(None).cast("string"))
    return rows.select("doc_id", assemble.caption(F.concat(F.lit("No "), F.col("doc_id").cast("string"))).alias("caption"))


# ---------------------------------------------------------------- answers

ANSWERS_SQL = "a AS (SELECT event_id AS id, user_id AS student_id, event_type AS question_id, event_type <> 'error' AND value > 20 AS correct, ts AS answered_at, user_id % 7 AS assignment_id FROM events)"


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("student_id"), F.col("event_type").alias("question_id"), ((F.col("event_type") != "error") & (F.col("value") > 20)).alias("correct"), F.col("ts").alias("answered_at"), (F.col("user_id") % 7).alias("assignment_id"))


@query(f"WITH {ANSWERS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY student_id, question_id ORDER BY answered_at DESC, id DESC) AS n FROM a) SELECT student_id, question_id, id, correct FROM n WHERE n = 1")
def upsert_latest(spark, sf_dir):
    return stats.latest_answers(answers(spark, sf_dir), ["student_id", "question_id"]).select("student_id", "question_id", "id", "correct")


@query("""WITH a AS (SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey % 3 <> 0),
b AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'new ' || c_name END AS c_name FROM customer WHERE c_custkey % 3 <> 1)
SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, coalesce(nullif(b.c_name, ''), a.c_name) AS c_name, a.c_mktsegment FROM a FULL OUTER JOIN b ON a.c_custkey = b.c_custkey""")
def registry_patch_upsert(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    new = c.filter("c_custkey % 3 <> 1").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.concat(F.lit("new "), "c_name")).alias("c_name"))
    return relational.patch(c.filter("c_custkey % 3 <> 0"), new, ["c_custkey"])


@query("SELECT DISTINCT user_id AS c_custkey FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def find_or_create(spark, sf_dir):
    known = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0")
    return relational.find_or_create(known, table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey")), ["c_custkey"])


@query(f"WITH {ANSWERS_SQL} SELECT a.id, a.correct, c_name AS name, c_mktsegment AS class_name FROM a LEFT JOIN customer ON student_id = c_custkey AND c_custkey % 5 <> 0")
def answers_with_student(spark, sf_dir):
    c = table(spark, sf_dir, "customer").filter("c_custkey % 5 <> 0")
    students = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("").alias("student_no"), F.col("c_mktsegment").alias("class_name"))
    return stats.with_student(answers(spark, sf_dir), students).select("id", "correct", "student.name", "student.class_name")


@query("""WITH t AS (SELECT o_custkey AS assignment_id, o_orderkey AS question_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS pos FROM orders)
SELECT assignment_id, question_id, pos, o_totalprice AS price FROM t JOIN orders ON o_orderkey = question_id WHERE o_orderstatus <> 'F'""")
def assignment_expand(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))), lambda s: s["o_orderkey"])
    assignments = o.groupBy(F.col("o_custkey").alias("id")).agg(ids.alias("question_ids"))
    known = o.filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("question_id"), F.col("o_totalprice").alias("price"))
    return stats.expand_assignments(assignments, known).select("assignment_id", "question_id", long(F.col("pos")).alias("pos"), "price")


@query(f"WITH {ANSWERS_SQL} SELECT student_id, count(*) AS n, count(*) FILTER (WHERE correct) AS ok, CAST(floor(count(*) FILTER (WHERE correct) / count(*) * 100 + 0.5) AS BIGINT) AS acc FROM a GROUP BY student_id")
def student_accuracy(spark, sf_dir):
    return stats.student_accuracy(answers(spark, sf_dir))


@query("""WITH l AS (SELECT l_partkey, count(*) AS answered, count(*) FILTER (WHERE l_returnflag = 'N') AS ok FROM lineitem WHERE l_quantity > 45 GROUP BY l_partkey)
SELECT p_partkey, coalesce(answered, 0) AS answered, coalesce(ok, 0) AS ok, CAST(floor(ok / answered * 100 + 0.5) AS BIGINT) AS acc, coalesce(ok / answered, 1.0) AS sort_acc FROM part LEFT JOIN l ON p_partkey = l_partkey""")
def question_accuracy_unanswered_last(spark, sf_dir):
    q = table(spark, sf_dir, "part").select("p_partkey")
    a = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"), (F.col("l_returnflag") == "N").alias("correct"))
    return stats.question_accuracy(q, a, "p_partkey").orderBy("sort_acc", "p_partkey")


@query(f"""WITH {ANSWERS_SQL}, s AS (SELECT DISTINCT assignment_id, student_id FROM a), q AS (SELECT DISTINCT assignment_id, question_id FROM a), d AS (SELECT DISTINCT student_id, question_id FROM a)
SELECT s.assignment_id, s.student_id, q.question_id, d.student_id IS NOT NULL AS answered FROM s JOIN q ON s.assignment_id = q.assignment_id LEFT JOIN d ON d.student_id = s.student_id AND d.question_id = q.question_id""")
def student_question_grid(spark, sf_dir):
    a = answers(spark, sf_dir)
    return stats.grid(a.select("assignment_id", "student_id").distinct(), a.select("assignment_id", "question_id").distinct(), a)


@query(f"""WITH {ANSWERS_SQL}, w AS (SELECT unnest([question_id, substr(question_id, 1, 1)]) AS topic FROM a WHERE NOT correct)
SELECT topic, count(*) AS n FROM w GROUP BY topic ORDER BY n DESC, topic LIMIT 15""")
def wrong_topic_topk(spark, sf_dir):
    a = answers(spark, sf_dir)
    topics = a.select("question_id").distinct().withColumn("topic_titles", F.array("question_id", F.left("question_id", F.lit(1))))
    return stats.wrong_topics(a, topics)


@query(f"WITH {ANSWERS_SQL} SELECT count(DISTINCT student_id) AS students, count(*) AS attempts, CAST(floor(count(*) FILTER (WHERE correct) / count(*) * 100 + 0.5) AS BIGINT) AS acc FROM a")
def overview(spark, sf_dir):
    return stats.overview(answers(spark, sf_dir))


@query(f"""WITH {ANSWERS_SQL}, i AS (SELECT *, sum(correct::INT) OVER (PARTITION BY student_id ORDER BY answered_at, id ROWS UNBOUNDED PRECEDING) AS since FROM a),
m AS (SELECT student_id, max(since) AS last FROM i GROUP BY student_id)
SELECT i.student_id, count(*) AS seen, max(since) > 0 AS ok, count(*) FILTER (WHERE since = last AND NOT correct) AS mistakes FROM i JOIN m ON i.student_id = m.student_id GROUP BY i.student_id""")
def streak_state(spark, sf_dir):
    return stats.streaks(answers(spark, sf_dir), ["student_id"], ["answered_at", "id"])


@query(f"WITH {ANSWERS_SQL} SELECT id, student_id, question_id, correct FROM a ORDER BY answered_at DESC, id DESC LIMIT 200")
def history_topn(spark, sf_dir):
    return stats.history(answers(spark, sf_dir)).select("id", "student_id", "question_id", "correct")


# ---------------------------------------------------------------- similarity and hubs


@query("""WITH r AS (SELECT DISTINCT o_custkey AS scope, l_orderkey AS id, l_suppkey AS code FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
s AS (SELECT a.scope, a.id, b.id AS other, count(*) AS shared FROM r a JOIN r b ON a.scope = b.scope AND a.code = b.code AND a.id <> b.id GROUP BY a.scope, a.id, b.id),
n AS (SELECT *, row_number() OVER (PARTITION BY scope, id ORDER BY shared DESC, other) AS rank FROM s) SELECT * FROM n WHERE rank <= 8""")
def related_top8(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    n = store.shares(spark, lines.count())
    rows = lines.repartition(n, "l_orderkey").join(table(spark, sf_dir, "orders").repartition(n, "o_orderkey").hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    pairs = rows.select(F.col("o_custkey").alias("scope"), F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("code"))
    return similarity.related(pairs, ["scope"]).withColumn("rank", long(F.col("rank")))


@query("SELECT l_partkey AS code, count(DISTINCT l_orderkey) AS n, min(l_orderkey) AS first_id, max(l_orderkey) AS last_id FROM lineitem GROUP BY l_partkey")
def inverted_index_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("codes")).withColumnRenamed("l_orderkey", "id")
    index = similarity.inverted_index(rows, "codes")
    return index.select("code", "n", F.element_at("ids", 1).alias("first_id"), F.element_at("ids", -1).alias("last_id"))


TREE_SQL = "t AS (SELECT r_name AS root, n_name AS leaf, c_custkey AS item FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("r_name").alias("root"), F.col("n_name").alias("leaf"), F.col("c_custkey").alias("item"))


@query(f"WITH {TREE_SQL} SELECT root, leaf, count(DISTINCT item) AS n FROM t GROUP BY GROUPING SETS ((root), (root, leaf))")
def tree_rollup_distinct(spark, sf_dir):
    return similarity.roll_up(tree(spark, sf_dir), ["root", "leaf"], "item")


@query(f"WITH {TREE_SQL}, l AS (SELECT root, leaf, count(*) AS n FROM t GROUP BY root, leaf) SELECT root, CAST(sum(n) AS BIGINT) AS n FROM l GROUP BY root")
def tree_rollup_leaf_sum(spark, sf_dir):
    leaves = tree(spark, sf_dir).groupBy("root", "leaf").agg(F.count("*").alias("n"))
    return similarity.leaf_sum(leaves, "root")


@query(f"WITH {BANK_SQL} SELECT id, year, paper, question FROM bank WHERE list_contains(syllabus_codes, '3.3')")
def dataview_contains(spark, sf_dir):
    bank(spark, sf_dir).createOrReplaceTempView("quizloom_bank")
    return spark.sql("SELECT id, year, paper, question FROM quizloom_bank WHERE array_contains(syllabus_codes, :code) ORDER BY year, paper, question", args={"code": "3.3"})


@query("""WITH r AS (SELECT p_partkey, sha256(p_partkey || '|' || p_name || '|' || p_brand || '|' || p_size) AS d FROM part), b AS (SELECT p_partkey // 100 AS b, sha256(string_agg(d, '' ORDER BY p_partkey)) AS d FROM r GROUP BY p_partkey // 100)
SELECT substr(sha256(string_agg(d, '' ORDER BY b)), 1, 12) AS version FROM b""")
def content_version(spark, sf_dir):
    digest = F.sha2(F.concat_ws("|", F.col("p_partkey").cast("string"), "p_name", "p_brand", F.col("p_size").cast("string")), 256)
    rows = table(spark, sf_dir, "part").select("p_partkey", digest.alias("d"), F.floor(F.col("p_partkey") / 100).alias("b"))
    joined = lambda *c: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*c))), lambda s: s["d"]), ""), 256)
    return rows.groupBy("b").agg(joined("p_partkey", "d").alias("d")).agg(F.left(joined("b", "d"), F.lit(12)).alias("version"))


# ---------------------------------------------------------------- enrichment


@query("SELECT l_orderkey AS id, l_partkey AS value, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40) GROUP BY l_orderkey, l_partkey")
def vocab_anti_unknown(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list("l_partkey").alias("codes"))
    unknown = enrich.unknown_values(rows, "codes", table(spark, sf_dir, "part").filter("p_size < 40"), "p_partkey")
    return unknown.groupBy("id", "value").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#1')")
def as_only_semi(spark, sf_dir):
    known = table(spark, sf_dir, "part").filter("p_brand = 'Brand#1'").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, sf_dir, "lineitem").join(known, "l_partkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN CAST(d.n_chars % 5 + 1 AS INTEGER) WHEN l.quality = 1 THEN 2 ELSE 5 END AS difficulty,
    CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.quality = 1 THEN 'easy' ELSE 'particularly_difficult' END AS band,
    CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.toxic = 1 THEN 'Common wrong option: C' END AS tip, 2021 AS er_year
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def enrich_left_merge(spark, sf_dir):
    none = F.lit(None).cast("string")
    strings = F.lit(None).cast("array<string>")
    i = F.col("doc_id").cast("string")
    questions = table(spark, sf_dir, "documents").select(
        "doc_id", F.lit("").alias("parent_question"), F.concat(i, F.lit("(a)(i)")).alias("question"), (F.col("n_chars") % 5 + 1).cast("int").alias("difficulty"), strings.alias("misconceptions"), strings.alias("common_errors"),
        *[none.alias(c) for c in (*enrich.KEPT_IF_NULL, "er_session", "er_paper", "examiner_report_source")], *[F.lit(0.5).alias(c) for c in enrich.NULLED], F.lit(None).cast("int").alias("er_year"),
    )
    easy = F.col("quality") == 1
    reports = table(spark, sf_dir, "labels").select(
        i.alias("question"), F.when(easy, "easy").otherwise("particularly_difficult").alias("examiner_band"), F.when(easy, 2).otherwise(5).alias("difficulty"),
        F.when(F.col("toxic") == 1, "C").alias("common_incorrect"), strings.alias("common_errors"), none.alias("examiner_notes"), none.alias("difficulty_source"), *[F.lit(None).cast("double").alias(c) for c in enrich.NULLED],
    )
    merged = enrich.merge_reports(questions, reports, {"year": 2021, "session": "MJ", "paper": "11"}, "report")
    return merged.select("doc_id", "difficulty", F.col("examiner_band").alias("band"), F.get("misconceptions", F.lit(0)).alias("tip"), "er_year")


WORD_RULES = (Rule(r"(?i)\blicense\b", ("9.1",)), Rule(r"(?i)\bthat\b.*\bwith\b", ("2.1", "2.2")), Rule(r"(?i)\bthe\b", ("1.1",)), Rule(r"[0-9]{3,}", ("4.2",), scope="body"), Rule("", ("0.0",), scope="body"))


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)\blicense\b') THEN '9.1' WHEN regexp_matches(text, '(?i)\bthat\b.*\bwith\b') THEN '2.1' WHEN regexp_matches(text, '(?i)\bthe\b') THEN '1.1' WHEN regexp_matches(text, '[0-9]{3,}') THEN '4.2' ELSE '0.0' END AS code FROM documents""")
def classify_first_match(spark, sf_dir):
    hit = first_match(F.col("text"), F.col("text"), WORD_RULES)
    return table(spark, sf_dir, "documents").select("doc_id", hit["codes"][0].alias("code"))


@query(r"""SELECT d.doc_id, coalesce(CASE WHEN l.toxic = 1 THEN 'curated' END, CASE WHEN regexp_matches(text, '(?i)\blicense\b') THEN 'legal' ELSE 'prose' END) AS label FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def keyword_overrides(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("text").rlike(r"(?i)\blicense\b"), "legal").otherwise("prose").alias("label"))
    curated = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id", F.lit("curated").alias("label"))
    return enrich.overridden(rows, curated, "doc_id", ["label"])


# ---------------------------------------------------------------- audit and text

GATES = {"license_line": r"(?i)\b(license|licensed)\b", "shouting": "!!", "table_row": r" \| ", "digits": "[0-9]{6,}"}
GATES_SQL = "f AS (" + " UNION ALL ".join(f"SELECT doc_id AS id, '{c}' AS code FROM documents WHERE regexp_matches(text, '{p}')" for c, p in GATES.items()) + " UNION ALL SELECT doc_id, 'short' FROM documents WHERE n_chars < 100)"


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"), "n_chars")
    return audit.text_findings(notes, GATES).unionByName(audit.finding(notes, "short", F.col("n_chars") < 100))


@query(f"WITH {GATES_SQL} SELECT id, code FROM f")
def audit_findings(spark, sf_dir):
    return findings(spark, sf_dir).select("id", "code")


@query(f"WITH {GATES_SQL} SELECT code, count(*) AS n FROM f GROUP BY code")
def audit_by_code(spark, sf_dir):
    return audit.by_code(findings(spark, sf_dir))


@query(f"WITH {GATES_SQL} SELECT (SELECT count(*) FROM documents) AS checked, count(DISTINCT id) AS failed, (SELECT count(*) FROM documents) - count(DISTINCT id) AS passed FROM f")
def audit_summary(spark, sf_dir):
    return audit.summary(table(spark, sf_dir, "documents"), findings(spark, sf_dir))


@query(r"""WITH g AS (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN ' ' WHEN doc_id % 50 = 1 THEN 'mark 1 1 1 1 1 1' ELSE text END AS s FROM documents)
SELECT doc_id, trim(s) = '' OR regexp_matches(s, '(?i)(^|\s)1(\s+1){4,}|(Marks\s+){2,}|PUBLISHED\s*Answer') OR (len(regexp_extract_all(s, '(?:^|\s)1\b')) >= 8 AND NOT contains(s, 'M1') AND length(s) < 800) AS garbage FROM g""")
def garbage_text(spark, sf_dir):
    i = F.col("doc_id")
    s = F.when(i % 50 == 0, " ").when(i % 50 == 1, "mark 1 1 1 1 1 1").otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", text.garbage(s).alias("garbage"))


@query(r"SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, CAST(len(regexp_extract_all(html, '(?i)<p[ >]')) AS BIGINT) AS paragraphs FROM pages")
def text_sections(spark, sf_dir):
    count = F.size(F.regexp_extract_all("html", F.lit("(?i)(<p[ >])"), F.lit(1)))
    return table(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), long(count).alias("paragraphs"))


@query(r"WITH d AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]{5,}'), lambda w: w NOT IN ('their', 'there', 'these'))) AS w FROM documents) SELECT doc_id, CAST(len(w) AS BIGINT) AS n FROM d")
def distinctive_words(spark, sf_dir):
    words = text.distinctive_words(F.col("text"), ["their", "there", "these"], 1 << 30, 5)
    return table(spark, sf_dir, "documents").select("doc_id", long(F.size(words)).alias("n"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(source || ' ' || lang || ' / Topic (A)')), '\\s+', '-', 'g'), '[^a-z0-9_\\-]', '_', 'g'), '_+', '-', 'g'), '-') AS slug FROM documents".replace("\\\\", "\\"))
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.slug(F.concat_ws(" ", "source", "lang", F.lit("/ Topic (A)"))).alias("slug"))


# ---------------------------------------------------------------- order and intervals


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS signup FROM events""")
def carry_forward_asof(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return geometry.carried(e, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "signup", F.col("event_id")), "signup").select("event_id", "signup")


@query("""WITH i AS (SELECT event_id AS item, user_id AS doc, CAST(event_id % 97 AS DOUBLE) AS y0, CAST(event_id % 97 + 5 + event_id % 7 AS DOUBLE) AS y1 FROM events),
b AS (SELECT DISTINCT user_id AS doc, k AS question, k * 12.0 AS b0, k * 12.0 + 15 AS b1 FROM events, (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7, 8]) AS k) t),
s AS (SELECT item, question, least(y1, b1) - greatest(y0, b0) + CASE WHEN (y0 + y1) / 2 BETWEEN b0 AND b1 THEN 2.0 ELSE 0.0 END AS score FROM i JOIN b ON i.doc = b.doc WHERE y1 >= b0 - 10 AND y0 <= b1 + 10),
n AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, question) AS n FROM s WHERE score > 0) SELECT item, CAST(question AS BIGINT) AS question, CAST(score AS DOUBLE) AS score FROM n WHERE n = 1""")
def interval_best_overlap(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    items = e.select(i.alias("item"), F.col("user_id").alias("doc"), (i % 97).cast("double").alias("y0"), (i % 97 + 5 + i % 7).cast("double").alias("y1"))
    k = F.explode(F.sequence(F.lit(0), F.lit(8))).alias("question")
    bands = e.select(F.col("user_id").alias("doc")).distinct().select("doc", k).withColumn("y0", F.col("question") * 12.0).withColumn("y1", F.col("question") * 12.0 + 15)
    return geometry.best_overlap(items, bands, ["doc"]).select("item", long(F.col("question")).alias("question"), "score")


STAGED_SQL = "'x' || s_suppkey || '_' || substr('swm', CAST(s_suppkey % 3 AS INTEGER) + 1, 1) || (10 + s_suppkey % 13) || CASE s_suppkey % 5 WHEN 1 THEN '_ms_' || (11 + s_suppkey % 50) WHEN 2 THEN '_er' WHEN 3 THEN '_gt' ELSE '_qp_' || (11 + s_suppkey % 50) END || '.pdf'"


@query(f"""WITH n AS (SELECT s_suppkey, {STAGED_SQL} AS name FROM supplier), f AS (SELECT * FROM n WHERE s_suppkey % 4 <> 1)
SELECT regexp_extract(name, '_([swm][0-9]{{2}})_', 1) AS season, count(*) FILTER (WHERE contains(name, '_qp_')) AS qp, count(*) FILTER (WHERE contains(name, '_ms_')) AS ms, count(*) FILTER (WHERE contains(name, '_er')) AS er FROM f GROUP BY ALL""")
def staged_by_season(spark, sf_dir):
    """File names of every supplier; those of every fourth are listed already."""
    i = F.col("s_suppkey")
    paper = (11 + i % 50).cast("string")
    kind = F.when(i % 5 == 1, F.concat(F.lit("_ms_"), paper)).when(i % 5 == 2, "_er").when(i % 5 == 3, "_gt").otherwise(F.concat(F.lit("_qp_"), paper))
    name = F.concat(F.lit("x"), i.cast("string"), F.lit("_"), F.substr(F.lit("swm"), (i % 3 + 1).cast("int"), F.lit(1)), (10 + i % 13).cast("string"), kind, F.lit(".pdf"))
    names = table(spark, sf_dir, "supplier").select("s_suppkey", name.alias("name"))
    return registry.staged_counts(registry.staged(names.select("name"), names.filter(i % 4 == 1).select("name")))


from . import filings, pages, papers  # noqa: E402, F401  register the queries over composed papers, pages and files
