"""The registry of papers: upsert, status from what exists, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import paper_kind
from .relational import patch

STATUSES = ["pending", "extracted", "tagged", "exported"]


def upsert(registry: DataFrame, rows: DataFrame) -> DataFrame:
    return patch(registry, rows, ["id"]).orderBy("year", "season", "paper")


def status(registry: DataFrame, drafts: DataFrame, tagged: DataFrame, exported: DataFrame) -> DataFrame:
    """The furthest stage of which there are files: tables with an id column each."""
    out = registry
    for name, t in (("_d", drafts), ("_t", tagged), ("_e", exported)):
        out = out.join(t.select("id").distinct().withColumn(name, F.lit(True)), "id", "left")
    ladder = F.when(F.col("_e"), "exported").when(F.col("_t"), "tagged").when(F.col("_d"), "extracted").otherwise("pending")
    return out.withColumn("status", ladder).drop("_d", "_t", "_e")


def vault(paper: Column) -> Column:
    kind = paper_kind(paper)
    return F.when(kind == "mcq", "vault").when(kind == "practical", "vault-practical").otherwise("vault-structured")


def staged(names: DataFrame, existing: DataFrame, column: str = "name") -> DataFrame:
    """Files by season and kind that aren't there yet."""
    pattern = r"(?i)_([swm]\d{2})_(qp|ms|er|in|ci|gt)(?:_(\d{1,2}))?\.pdf$"
    rows = names.filter(F.col(column).rlike(pattern)).select(column, *[F.lower(F.regexp_extract(column, pattern, i)).alias(c) for i, c in ((1, "season"), (2, "kind"), (3, "paper"))])
    return rows.join(existing.select(column), column, "left_anti")


def staged_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("season").pivot("kind", ["qp", "ms", "er"]).count().fillna(0)


def batch(papers: DataFrame, status: str = "", limit: int | None = None) -> DataFrame:
    """The papers of any of the states between commas, all where none is named; at most limit, by id."""
    want = [s.strip() for s in status.split(",") if s.strip()]
    kept = papers.filter(F.col("status").isin(want)) if want else papers
    return kept.orderBy("id").limit(limit) if limit else kept
