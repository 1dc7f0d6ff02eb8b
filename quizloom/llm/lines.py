"""Operator 3: line dedup by site-relative frequency.

For every host, the pages that hold a line are divided by the pages of the host; lines above the ratio
leave all of its pages. Lines compare without the white space at their ends; blank lines always stay. A
line counts once a page. A line that one page alone holds recurs nowhere, so it is no boilerplate, whatever its
share of a small host.

Counts are added up before they are shuffled, by a 96-bit digest of the line, so a host or a line that a
third of all pages hold is one row per task. A host has at most (mean lines of a page / ratio) lines above
the ratio; these go to its pages as one array. The planner broadcasts the table of them while it is
small, and joins it by host otherwise.

Null texts count as empty, null hosts as one host of their own. Pages that lose all lines stay, with
empty text. Repeated rows count as pages of their own. Texts of any length are split whole. Further columns stay as they
are, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, materialize

RATIO, LEAST_PAGES = 0.1, 2
BLANKS = " \t\r"


def digest(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"))


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def boilerplate(pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """pages (host, text): host, pages and the digests of its lines above the ratio, for hosts that have any."""
    lines = pages.select("host", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), trimmed))).alias("line")).filter("line <> ''")
    counts = lines.groupBy("host", digest(F.col("line")).alias("line")).agg(F.count("*").alias("with_line")).filter(F.col("with_line") >= least_pages)
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    found = counts.join(totals, "host").filter(F.col("with_line") > ratio * F.col("pages"))
    return found.groupBy("host").agg(F.first("pages").alias("pages"), F.collect_list("line").alias("lines"))


def cleaned(docs: DataFrame, host: str, ratio: float, least_pages: int) -> tuple[DataFrame, str, str]:
    """docs with clean texts and two more columns, and their names: the lines of a page and those of them that are left."""
    site, gone, lines, kept = free(docs, "site", "gone", "lines", "kept")
    hosted = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn(site, F.coalesce(F.col(host).cast("string"), F.lit("")))
    found = materialize(boilerplate(hosted.select(F.col(site).alias("host"), "text"), ratio, least_pages), "boilerplate")
    joined = hosted.join(found.select(F.col("host").alias(site), F.col("lines").alias(gone)), site, "left")
    own = F.split("text", "\n")
    stay = F.when(F.col(gone).isNotNull(), F.filter(own, lambda x: ~F.array_contains(F.col(gone), digest(trimmed(x)))))
    joined = joined.withColumn(lines, F.size(own).cast("long")).withColumn(kept, stay)
    out = joined.withColumn("text", F.coalesce(F.array_join(kept, "\n"), "text")).withColumn(kept, F.coalesce(F.size(kept).cast("long"), F.col(lines)).cast("long"))
    return out.drop(site, gone), lines, kept


def dedup(docs: DataFrame, host: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """docs, their texts without boilerplate lines."""
    return cleaned(docs, host, ratio, least_pages)[0].select(docs.columns)


def report(docs: DataFrame, host: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """Per row: doc_id, host, text without boilerplate lines, n_lines before and n_dropped of them."""
    own = docs.select("doc_id", "text", F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"))
    out, lines, kept = cleaned(own, "host", ratio, least_pages)
    return out.select("doc_id", "host", "text", F.col(lines).alias("n_lines"), (F.col(lines) - F.col(kept)).alias("n_dropped"))


DEDUP_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS body FROM documents),
l AS (SELECT host, unnest(list_distinct(list_transform(string_split(body, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))))) AS line FROM d),
t AS (SELECT host, count(*) AS pages FROM d GROUP BY host),
c AS (SELECT host, line, count(*) AS with_line FROM l WHERE line <> '' GROUP BY host, line),
b AS (SELECT c.host, list(c.line) AS lines FROM c JOIN t ON c.host = t.host WHERE with_line >= {LEAST_PAGES} AND with_line > {RATIO} * pages GROUP BY c.host),
k AS (SELECT d.doc_id, d.host, string_split(d.body, chr(10)) AS own, coalesce(b.lines, []) AS lines FROM d LEFT JOIN b ON d.host = b.host)
SELECT doc_id, host, array_to_string(list_filter(own, lambda x: NOT list_contains(lines, trim(x, ' ' || chr(9) || chr(13)))), chr(10)) AS text,
    CAST(len(own) AS BIGINT) AS n_lines,
    CAST(len(own) - len(list_filter(own, lambda x: NOT list_contains(lines, trim(x, ' ' || chr(9) || chr(13))))) AS BIGINT) AS n_dropped
FROM k
"""
