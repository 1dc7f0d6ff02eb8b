"""Inverted indexes, tree roll-ups and related questions by shared codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import kept, shares
from .relational import top_by


def postings(questions: DataFrame, column: str = "syllabus_codes", once: bool = True, carry: Sequence[str] = ()) -> DataFrame:
    """A row for each value of each question; once: a value that a question repeats counts once."""
    values = F.array_distinct(column) if once else F.col(column)
    return questions.select("id", *carry, F.explode(values).alias("code"))


def inverted_index(questions: DataFrame, column: str = "syllabus_codes", once: bool = True) -> DataFrame:
    rows = postings(questions, column, once)
    return rows.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.count("*").alias("n"))


def related(pairs: DataFrame, scope: Sequence[str] = (), k: int = 8) -> DataFrame:
    """For (scope, id, code) rows the k other ids of the scope that share most codes, ties by id.

    Pairs are counted before they are ranked, and ranks are cut on the map side; codes that all ids of a
    scope share are the caller's to leave out. Rows are made once and dealt by their number, so that what a task holds doesn't grow with the table."""
    rows = kept(pairs.select(*scope, "id", "code").dropna(), "codes")
    own = rows.repartition(shares(rows.sparkSession, rows.count()), *scope, "code").distinct()
    other = own.withColumnRenamed("id", "other")
    shared = own.join(other, [*scope, "code"]).filter("id <> other").groupBy(*scope, "id", "other").agg(F.count("*").alias("shared"))
    return top_by(shared, [*scope, "id"], [F.desc("shared"), F.asc("other")], k)


def roll_up(rows: DataFrame, levels: Sequence[str], item: str) -> DataFrame:
    """Distinct items at each level of a tree, in one pass; the levels below a root are null in its row."""
    everything = (1 << len(levels)) - 1
    sets = rows.rollup(*levels).agg(F.count_distinct(item).alias("n"), F.grouping_id().alias("_set"))
    return sets.filter(F.col("_set") != everything).select(*levels, "n")


def leaf_sum(leaves: DataFrame, root: str, n: str = "n") -> DataFrame:
    """Sum of the leaves' counts; an item on several leaves counts for each."""
    return leaves.groupBy(root).agg(F.sum(n).cast("long").alias(n))


def content_version(rows: DataFrame, key: str, columns: Sequence[str], length: int = 12) -> DataFrame:
    """A digest of all rows, in whatever order they lie. Each row is digested with its key where it lies; digests that begin alike are sorted and
    digested again, in two steps, so that the last one sees 256 digests."""
    line = F.sha2(F.to_json(F.struct(key, *columns), {"ignoreNullFields": "false"}), 256)
    rows = rows.select(line.alias("d"))
    joined = F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256).alias("d")
    fine = rows.groupBy(F.left("d", F.lit(5)).alias("bucket")).agg(joined)
    per_bucket = fine.groupBy(F.left("bucket", F.lit(2)).alias("bucket")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "d"))), lambda s: s["d"]), ""), 256).alias("d"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "d"))), lambda s: s["d"]), "")
    return per_bucket.agg(F.left(F.sha2(whole, 256), F.lit(length)).alias("version"))
