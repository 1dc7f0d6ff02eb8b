"""What keeps the work of a query in proportion to its input."""

import pytest
from pyspark.sql import functions as F

from quizloom import pages
from quizloom.functions import text
from quizloom.operators import geometry, similarity, split, tagging
from quizloom.sources import store, writers


@pytest.mark.parametrize("made,part,most", [
    (lambda c: text.options_table(c), "bipyramidal", 6), (lambda c: text.option_lines(c), "aggregate(", 1), (lambda c: text.without_repeated_options(c, F.lit(True)), "aggregate(", 1),
    (lambda c: text.without_labels(c, F.lit(True)), r"\x0e-\x1f", 4),
])
def test_steps_of_a_text_are_taken_once(spark, made, part, most):
    plan = spark.range(1).select(made(F.col("id").cast("string")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count(part) <= most


def test_long_texts(spark):
    rows = "\n".join(["PCl5 [X]+", "A pyramidal one", "B square planar bent", "C two tetrahedral", "D non-linear linear", "end"] * 100)
    got = spark.range(1).select(text.options_table(F.concat(F.lit(rows), F.col("id").cast("string"))).alias("x")).first().x
    assert got.count("| --- | --- | --- |") == 100 and got.count("| D | non-linear | linear |") == 100


BOXES = "doc long, page int, ord int, x0 double, y0 double, x1 double, y1 double"


def test_pages_stream_through_a_task(spark):
    """Many small pages are no calls of their own, a page may be longer than a batch, and keys and numbers may be null."""
    i = F.col("id")
    small = spark.range(3000).select((2**60 + i).alias("doc"), F.lit(1).alias("page"), F.explode(F.array(*[F.struct(F.lit(n).alias("ord"), F.lit(0.0).alias("x0"), F.lit(y).alias("y0"), F.lit(9.0).alias("x1"), F.lit(y + 2).alias("y1")) for n, y in enumerate((0.0, 1.0, 50.0))])).alias("b")).select("doc", "page", "b.*")
    long = spark.range(25000).select(F.lit(7).cast("long").alias("doc"), F.lit(1).alias("page"), i.cast("int").alias("ord"), F.lit(0.0).alias("x0"), (i * 20.0).alias("y0"), F.lit(9.0).alias("x1"), (i * 20.0 + 5).alias("y1"))
    odd = spark.createDataFrame([(None, None, 1, 0.0, 1.0, 9.0, 2.0), (None, None, 2, 0.0, None, 9.0, 2.0)], BOXES)
    rows = geometry.bands(small.unionByName(long).unionByName(odd))
    assert "FlatMapGroupsInPandas" not in rows._jdf.queryExecution().toString()
    got = {r.doc: (r.n, r.most) for r in rows.groupBy("doc").agg(F.count("*").alias("n"), F.max("band").alias("most")).collect()}
    assert len(got) == 3002 and got[7] == (25000, 24999) and got[2**60 + 5] == (3, 1) and got[None] == (2, 0)
    kept = geometry.larger_of_overlapping(small).groupBy("doc").count().distinct().select("count").distinct().collect()
    assert [r[0] for r in kept] == [3]


def test_numbered_lines_are_looked_at_once(spark):
    docs = spark.createDataFrame([("d", "1 Explain what is meant by this.\n\n(a) State it.\n2 Describe the other thing.")], "doc string, text string")
    found = split.questions(docs)
    assert "specifiedwindowframe(RowFrame, 1, unboundedfollowing$())" not in found._jdf.queryExecution().analyzed().toString()  # such a frame is read anew for each row
    assert [(r.question, r.start_line) for r in found.orderBy("ord").collect()] == [("1", 1), ("2", 4)]


def test_what_rules_give_is_sent_to_the_texts(spark):
    """Most texts have the same few rules: joined by rule they would meet in one task."""
    codes, outcomes = spark.createDataFrame([("1",)], "code string"), spark.createDataFrame([("1-1", "1")], "lo_id string, parent_code string")
    rules = spark.createDataFrame([(0, "body", "a", ["1"], [], ["recall"], False)], tagging.RULES)
    rows = tagging.tagged(spark.range(3).select("id", F.lit("a").alias("body")), rules, codes, outcomes)
    assert "strategy=broadcast" in rows._jdf.queryExecution().optimizedPlan().toString()
    assert [r.rule for r in rows.collect()] == [0, 0, 0]


def test_clips_are_made_in_steps(spark):
    """As one plan the clips of choice papers read the orders over 90 times and sent 39 tables to the driver."""
    plan = pages.choice_question_clips(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and plan.count("FileScan") <= 6


def test_a_listing_is_not_sent_to_all_tasks(spark):
    """Its estimated size was small at any number of files; null names would meet in one task of a merge."""
    i = F.col("id").cast("string")
    rows = spark.range(4000).select("id", F.array(F.concat(i, F.lit("-paper.png"))).alias("figures"))
    files = spark.range(10).select(F.concat(F.col("id").cast("string"), F.lit("-paper.png")).alias("path"))
    for part, n in zip(writers.illustrated(rows, files), (0, 4000)):
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "hashpartitioning(_ms" not in plan and part.count() == n
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [len(p) for p in writers.illustrated(rows, files)[1].rdd.glom().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) < 2000


def test_related_rows_are_dealt_by_their_number(spark, monkeypatch):
    """What a task holds grew with the table: its partitions were as many as their bytes say, and the rows were made twice."""
    monkeypatch.setattr(store, "SHARE", 10)
    pairs = spark.range(600).select(F.lit("p").alias("paper"), (F.col("id") % 200).alias("id"), F.floor(F.col("id") / 4).alias("code"))
    odd = spark.createDataFrame([("p", 1000, None), ("p", None, 1), (None, 1001, 1)], "paper string, id long, code long")
    rows = similarity.related(pairs.unionByName(odd), ["paper"], 2)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Range" not in plan and plan.count(", 60), REPARTITION_BY_NUM") == 2
    got = {(r.id, r.other, r.shared, r["rank"]) for r in rows.filter("id in (0, 1001)").collect()}
    assert got == {(0, 1, 3, 1), (0, 2, 3, 2)}
