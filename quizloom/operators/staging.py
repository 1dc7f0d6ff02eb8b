"""All papers through all stages at once: one plan a stage, one outcome a paper and stage.

A paper that fails a stage keeps its reason and goes no further; the others go on. A stage does a paper again only when what it reads of the paper has
changed, by digest, so a run that broke off is resumed by running again. Results are kept by run, and those of the run that an outcome names are valid.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import kept
from . import reports, split

OUTCOMES = "paper_id string, stage string, run int, digest string, status string, detail string, n long"
ORDER = ["split", "marks", "report"]


def inputs(papers: DataFrame, documents: DataFrame) -> DataFrame:
    """(paper_id, qp, ms, er): the texts of each paper, from documents (paper_id, kind, text); the last by text where there are several."""
    texts = documents.groupBy("paper_id").pivot("kind", ["qp", "ms", "er"]).agg(F.max("text"))
    return papers.select("paper_id").distinct().join(texts, "paper_id", "left")


def _digest(*columns: str) -> Column:
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def split_stage(due: DataFrame) -> DataFrame:
    """The parts of structured papers and the questions of the others."""
    mains = split.questions(due.filter("qp is not null").select(F.col("paper_id").alias("doc"), F.col("qp").alias("text")))
    parts = split.parts(mains.filter("style <> 'mcq'")).select("doc", "question", "label", "text")
    whole = mains.join(parts.select("doc", "question").distinct(), ["doc", "question"], "left_anti").select("doc", "question", F.lit(None).cast("string").alias("label"), "text")
    return parts.unionByName(whole).withColumnRenamed("doc", "paper_id")


def marks_stage(due: DataFrame) -> DataFrame:
    return split.mark_blocks(due.filter("ms is not null").select(F.col("paper_id").alias("doc"), F.col("ms").alias("text"))).withColumnRenamed("doc", "paper_id")


def report_stage(due: DataFrame) -> DataFrame:
    found = reports.questions(due.filter("er is not null").select(F.col("paper_id").alias("doc"), F.col("er").alias("text")))
    return found.select(F.col("doc").alias("paper_id"), "question", "examiner_band", "difficulty", "examiner_notes")


#: For each stage: what it reads, how it works, why a paper is skipped or failed before it, and what it is called when nothing comes out.
STAGES: dict[str, tuple[tuple[str, ...], Callable[[DataFrame], DataFrame], str, str, str]] = {
    "split": (("qp",), split_stage, "failed", "no_paper", "no_questions"),
    "marks": (("qp", "ms"), marks_stage, "skipped", "no_scheme", "no_marks"),
    "report": (("qp", "er"), report_stage, "skipped", "no_report", "no_facts"),
}


def outcomes(spark: SparkSession, root: str) -> DataFrame:
    """The last outcome of each paper and stage."""
    try:
        rows = spark.read.schema(OUTCOMES).parquet(f"{root}/outcomes")
    except Exception as e:  # nothing was run yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], OUTCOMES)
    last = rows.groupBy("paper_id", "stage").agg(F.max_by(F.struct("run", "digest", "status", "detail", "n"), "run").alias("o"))
    return last.select("paper_id", "stage", "o.*")


def run(spark: SparkSession, root: str, papers: DataFrame, documents: DataFrame) -> DataFrame:
    """Takes every paper as far as it goes and gives the outcomes of all; what is as it was is not done again."""
    texts = kept(inputs(papers, documents), "texts")
    number = 1 + (outcomes(spark, root).agg(F.max("run")).first()[0] or 0)
    for stage in ORDER:
        reads, work, without, lacking, nothing = STAGES[stage]
        before = outcomes(spark, root)
        now = texts.withColumn("digest", _digest(*reads))
        stale = now.join(before.filter(F.col("stage") == stage).select("paper_id", "digest"), ["paper_id", "digest"], "left_anti")
        if stage != "split":  # only papers that were split go on
            stale = stale.join(before.filter("stage = 'split' and status = 'ok'").select("paper_id"), "paper_id", "left_semi")
        due = kept(stale, f"due-{stage}")
        if due.isEmpty():
            continue
        work(due).write.mode("overwrite").parquet(f"{root}/{stage}/run={number}")  # over what a run that broke off may have left
        made = spark.read.parquet(f"{root}/{stage}/run={number}").groupBy("paper_id").agg(F.count("*").alias("n"))
        given = F.col(reads[-1]).isNotNull()
        status = F.when(~given, without).when(F.col("n").isNull(), "failed").otherwise("ok")
        detail = F.when(~given, lacking).when(F.col("n").isNull(), nothing)
        told = due.join(made, "paper_id", "left").select("paper_id", "digest", status.alias("status"), detail.alias("detail"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
        told.write.mode("overwrite").parquet(f"{root}/outcomes/run={number}/stage={stage}")
    return outcomes(spark, root)


def result(spark: SparkSession, root: str, stage: str) -> DataFrame:
    """What a stage made of the papers that it last did well."""
    valid = outcomes(spark, root).filter((F.col("stage") == stage) & (F.col("status") == "ok")).select("paper_id", "run")
    return spark.read.parquet(f"{root}/{stage}").join(valid, ["paper_id", "run"], "left_semi").drop("run")


def progress(papers: DataFrame, done: DataFrame) -> DataFrame:
    """papers with how far they came: pending, failed with its first reason, or extracted."""
    first = done.filter("stage = 'split'").select("paper_id", "status", "detail")
    state = F.when(F.col("status") == "ok", "extracted").when(F.col("status") == "failed", "failed").otherwise("pending")
    return papers.join(first, "paper_id", "left").select(*papers.columns, state.alias("state"), "detail")
