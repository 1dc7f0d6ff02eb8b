"""The training-data pipeline: each stage works on all that the stage before kept.

toxicity: rows that score 0.7 or more go. line dedup: lines above a site's boilerplate ratio leave the
texts. near duplicates: one row of each group stays, the one of the smallest doc_id. secret scans: spans
are replaced by a mark. packing: the texts become pieces of training sequences.

Null texts count as empty (line dedup writes them so). Rows with a null or repeated id are decided row by row and stay
apart from each other; rows without a set of words are never near copies. Repeated rows are copies: one stays. Texts of any length
are read whole. All columns of the input pass through every stage but the last, whatever their names; only text and n_chars
change. An empty table gives an empty result.

SQL cannot express the first, third and last stage, so ORACLE_SQL is None and the tests hold run()
against a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizloom.llm import jaccard, lines, packing, secrets, toxicity
from quizloom.llm.common import free, materialize, table


def recounted(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of like, with n_chars of the text as it is now."""
    if "n_chars" in docs.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select(like.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    (name,) = free(docs, "toxic_score")
    return toxicity.score(docs, model, keep=name).filter(F.col(name) < toxicity.PREDICT).select(docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return recounted(lines.dedup(docs), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    if docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty():
        found = materialize(jaccard.join(docs), "near-copies")
        gone = found.filter(F.col("doc_id") != F.col("component_id")).select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    # ids that are null or stand for several rows: rows get keys of their own, and the first by (doc_id, key) of each component stays
    (row,) = free(docs, "row")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = jaccard.join(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    stay = rows.select(F.col(row).alias("row"), "doc_id").join(found, "row").groupBy("component_id").agg(F.min(order).alias("first")).select(F.col("first.row").alias(row))
    return rows.join(stay, row, "left_semi").select(docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return recounted(secrets.redact(docs), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near duplicates", drop_near_copies),
    ("secret scans", mask_secrets),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
