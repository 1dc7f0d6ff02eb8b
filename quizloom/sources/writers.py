"""Sinks: pick lists, notes, bundles, partitioned tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import slug
from ..plans.rules import SelectRules
from ..schemas import PICK_FIELDS


def pick_payload(picked: DataFrame, rules: SelectRules, corpus: DataFrame, category: str = "all") -> DataFrame:
    """One row with the header and the ordered entries; picked is what a rule's count leaves."""
    have = [c if c in picked.columns else F.lit(None).cast("string").alias(c) for c in PICK_FIELDS]
    entry = F.struct(*have, F.lit(category).alias("category"), F.lit("draft").alias("source"))
    rows = picked.select("ord", entry.alias("e")).agg(F.array_sort(F.collect_list(F.struct("ord", "e"))).alias("rows"))
    total = corpus.agg(F.count("*").alias("corpus_question_count"))
    head = rows.join(total).select(
        F.lit(1).alias("schema_version"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("generated_at"),
        "corpus_question_count",
        slug(F.lit(rules.title)).alias("slug"),
        F.lit(rules.title).alias("title"),
        F.size("rows").alias("question_count"),
        F.transform("rows", lambda r: r["e"]).alias("questions"),
    )
    return head.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def write_pick(payload: DataFrame, path: str) -> None:
    payload.write.mode("overwrite").text(path)


def note(front: Sequence[Column | str], sections: dict[str, Column], figures: Column) -> Column:
    """A note as Markdown: front matter in JSON flow (which YAML reads), embeds, then the sections that have text."""
    body = [F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(f"## {name}\n\n"), text)) for name, text in sections.items()]
    embeds = F.array_join(F.transform(F.coalesce(figures, F.array().cast("array<string>")), lambda f: F.concat(F.lit("![["), f, F.lit("]]"))), "\n")
    return F.concat_ws("\n\n", F.concat(F.lit("---\n"), F.to_json(F.struct(*front)), F.lit("\n---")), F.nullif(embeds, F.lit("")), *body)


def hub(index: DataFrame, titles: DataFrame) -> DataFrame:
    """A hub note for each code: its title and links to its questions."""
    links = F.array_join(F.transform("ids", lambda i: F.concat(F.lit("- [["), i, F.lit("]]"))), "\n")
    rows = index.join(titles.select("code", "title"), "code", "left")
    return rows.select("code", F.concat(F.lit("# "), "code", F.coalesce(F.concat(F.lit(" "), F.col("title")), F.lit("")), F.lit("\n\n"), links).alias("value"))


def wikilink(code: Column, text: Column, most: int = 120, cut: int = 100) -> Column:
    label = F.concat_ws(" ", code, text)
    short = F.when(F.length(label) > most, F.concat(F.left(label, F.lit(cut)), F.lit("…"))).otherwise(label)
    return F.concat(F.lit("[["), code, F.lit("|"), short, F.lit("]]"))


def write_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Replaces only the partitions that df has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def bundle(questions: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A JSON line for each question; what a browser loads in pieces needs no single row."""
    return questions.select(F.to_json(F.struct(*columns)).alias("value"))


def illustrated(questions: DataFrame, files: DataFrame, root: str = "assets/structured/") -> tuple[DataFrame, DataFrame]:
    """Questions (id, figures, ...) with paper_img and ms_img, the first figure of each kind, and (id, reason) of those that lack an entry or whose
    image the listing (path) lacks.

    The listing grows, and the sizes of its files don't tell by how much, so it is merged and never sent to all tasks. Names that are
    missing meet nothing, each at a place of its own, where null keys would meet in one task."""
    name = lambda f: F.substring_index(f, "/", -1)
    of = lambda end: F.get(F.filter(F.transform(F.coalesce("figures", F.array().cast("array<string>")), name), lambda n: F.endswith(n, F.lit(end))), F.lit(0))
    rows = questions.withColumn("_paper", of("-paper.png")).withColumn("_ms", of("-ms.png"))
    there = files.select(name(F.col("path")).alias("_name")).repartition("_name").distinct()  # dealt first: names are mostly distinct where they lie
    for kind in ("_paper", "_ms"):
        sought = F.coalesce(kind, F.concat(F.lit("/"), F.xxhash64("id").cast("string")))  # no name has a slash
        found = there.select(F.col("_name").alias("_sought"), F.lit(True).alias(f"_has{kind}"))
        rows = rows.withColumn("_sought", sought).join(found.hint("merge"), "_sought", "left").drop("_sought")
    reason = F.when(F.col("_paper").isNull() | F.col("_ms").isNull(), "missing figure entries").when(F.col("_has_paper").isNull() | F.col("_has_ms").isNull(), "missing image file")
    judged = rows.withColumn("reason", reason)
    images = [F.concat(F.lit(root), "_paper").alias("paper_img"), F.concat(F.lit(root), "_ms").alias("ms_img")]
    return judged.filter("reason is null").select(*questions.columns, *images), judged.filter("reason is not null").select("id", "reason")
