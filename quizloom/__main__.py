"""python -m quizloom VERB ...: the engine's paths from the command line, each one Spark job."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import assemble, audit, enrich, export, relational, reports, split, staging, tagging
from .plans.rules import select
from .sources import readers, store, writers


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quizloom")
    verbs = top.add_subparsers(dest="verb", required=True)
    for name, args in {
        "select": ("questions", "rules", "out"),
        "assemble": ("pick", "out"),
        "codes": ("vocabulary",),
        "los": ("vocabulary", "code"),
        "split": ("documents", "out"),
        "ms-key": ("documents", "out"),
        "er-extract": ("reports", "out"),
        "audit": ("questions", "vocabulary"),
        "papers": ("registry",),
        "tag": ("drafts", "vocabulary", "paper", "out"),
        "stage": ("documents", "out"),
    }.items():
        v = verbs.add_parser(name)
        for a in args:
            v.add_argument(a)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("quizloom").getOrCreate()
    if a.verb == "select":
        bank, rules = readers.questions(spark, a.questions), readers.rules(spark, a.rules)
        picked = relational.numbered(select(bank, rules), rules.order(), "ord")
        writers.write_pick(writers.pick_payload(picked, rules, bank), a.out)
    elif a.verb == "assemble":
        lines = assemble.render(readers.pick(spark, a.pick))
        lines.orderBy("seq", "line").select(F.col("text").alias("value")).coalesce(1).write.mode("overwrite").text(a.out)
    elif a.verb in ("codes", "los"):
        codes, los = enrich.vocabulary(readers.vocabulary(spark, a.vocabulary))
        rows = codes if a.verb == "codes" else los.filter((F.col("parent_code") == a.code) | (F.lit("." not in a.code) & (F.split_part("parent_code", F.lit("."), F.lit(1)) == a.code)))
        rows.show(1000, truncate=False)
    elif a.verb in ("split", "ms-key", "er-extract"):
        source = a.reports if a.verb == "er-extract" else a.documents
        docs = readers.whole_files(spark, source, "*.txt").select(F.regexp_extract("_path", r"([^/]+)\.txt$", 1).alias("doc"), F.col("value").alias("text"))
        if a.verb == "split":
            mains = split.questions(docs)
            writers.write_partitions(mains.unionByName(split.parts(mains).withColumnRenamed("label", "part"), allowMissingColumns=True), a.out, ["doc"])
        elif a.verb == "ms-key":
            writers.write_partitions(split.mark_blocks(docs), a.out, ["doc"])
        else:
            writers.write_partitions(reports.questions(docs).drop("doc"), a.out, ["year", "session", "paper"])
    elif a.verb == "audit":
        codes, los = enrich.vocabulary(readers.vocabulary(spark, a.vocabulary))
        notes = readers.questions(spark, a.questions).withColumn("body", F.coalesce("body", F.lit("")))
        found = audit.record_findings(notes).unionByName(audit.text_findings(notes)).unionByName(audit.vocabulary_findings(notes, codes.select("code"), los.select("lo_id")))
        audit.by_code(found).show(100, truncate=False)
        total = audit.summary(notes, found).first()
        return 2 if not total["checked"] else int(total["failed"] > 0)
    elif a.verb == "tag":
        codes, los = enrich.vocabulary(readers.vocabulary(spark, a.vocabulary))
        drafts = readers.drafts(spark, a.drafts).select(F.concat(F.lit(f"{a.paper}-q"), "question").alias("id"), "question", F.substring_index("text", export.MARKER, 1).alias("body"))
        store.write_files(tagging.sidecars(tagging.tagged(drafts, tagging.rule_rows(spark), codes, los)), a.out)
    elif a.verb == "stage":
        files = readers.whole_files(spark, a.documents, "*.txt").select(F.regexp_extract("_path", r"([^/]+)\.(?:qp|ms|er)\.txt$", 1).alias("paper_id"), F.regexp_extract("_path", r"\.(qp|ms|er)\.txt$", 1).alias("kind"), F.col("value").alias("text")).filter("kind <> ''")
        done = staging.run(spark, a.out, files.select("paper_id"), files)
        done.orderBy("paper_id", "stage").show(1000, truncate=False)
        return int(not done.filter("status = 'failed'").isEmpty())
    else:
        readers.registry(spark, a.registry).groupBy("status").count().orderBy("status").show()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
