"""Documents to questions to parts, as rows of lines and windows over them.

A document is exploded into lines once; boundaries are predicates on a line and its next full line, and
blocks are what lies between boundaries. Only the choice among candidate numbers is a fold, over the few
of a document (starts.py).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import part_id, part_key, part_label, part_slug
from ..functions.text import FOOTER, garbage, paper_style, strip, without_footers
from . import starts

PAGE_LINE = r"^\s*-{3,} PAGE (\d+) -{3,}\s*$"
MAIN_LINE = r"^(\d{1,2})(?:\s*[.)])?(?:\s+(.*))?$"
PART_LINE = r"(?i)^\(([a-z])\)\s*\(([ivx]+)\)|^\((iv|ix|vi{0,3}|iii|ii|i|v|x)\)|^\(([a-z])\)"
HEAD_LINE = r"(?i)^\d{1,2}\([a-z]\)(?:\([ivx]+\))?\s*$"


def lines_of(docs: DataFrame, key: str = "doc", text: str = "text") -> DataFrame:
    """(doc, n, line, page, style): every line with the page it stands on, the last page mark before it."""
    styled = docs.select(key, text, paper_style(F.col(text)).alias("style"))  # a step before the lines, or it would be found anew for each
    rows = styled.select(key, "style", F.posexplode(F.split(text, "\n")).alias("n", "line"))
    mark = F.nullif(F.regexp_extract("line", PAGE_LINE, 1), F.lit("")).cast("int")
    w = Window.partitionBy(key).orderBy("n")
    return rows.withColumn("page", F.last(mark, ignorenulls=True).over(w))


def next_full(rows: DataFrame, column: Column, key: str, name: str) -> DataFrame:
    """rows with the next value that isn't null, after each row. A frame that ends with its partition would be read anew for each row."""
    after = F.expr(f"lead(_full) IGNORE NULLS OVER (PARTITION BY `{key}` ORDER BY n)")
    return rows.withColumn("_full", column).withColumn(name, after).drop("_full")


def questions(docs: DataFrame, key: str = "doc", text: str = "text") -> DataFrame:
    """(doc, question, ord, start_line, page, style, text): a row for each main question, in order."""
    rows = lines_of(docs, key, text)
    end = F.min(F.when(F.col("line").rlike(starts.NOTES_HEADING), F.col("n"))).over(Window.partitionBy(key))
    rows = rows.withColumn("end", end).filter(F.col("end").isNull() | (F.col("n") < F.col("end"))).drop("end")
    noise = F.col("line").rlike(FOOTER) | F.col("line").rlike(PAGE_LINE) | (F.trim("line") == "")
    full = next_full(rows, F.when(~noise, F.trim("line")), key, "after")
    number = F.nullif(F.regexp_extract("line", MAIN_LINE, 1), F.lit("")).cast("int")
    stem = F.trim(F.regexp_extract("line", MAIN_LINE, 2))
    most = F.when(F.col("style") == "mcq", 40).otherwise(20)
    full = full.withColumn("num", F.when(number.between(1, most) & starts.plausible(stem, F.col("after"), F.col("style")), number)).withColumn("class", starts.line_class(stem))
    picked = full.filter("num is not null").groupBy(key).agg(F.first("style").alias("style"), F.array_sort(F.collect_list(F.struct("n", "num", "class"))).alias("c"))
    taken = F.when(F.col("style") == "mcq", starts.best_picks(F.col("c"))).otherwise(starts.consecutive(F.col("c"), F.col("style")))
    # the lines stay where their document lies: they meet its openers, which are in order, and count those that stand before them
    numbers = F.transform("taken", lambda t: F.get(F.filter("c", lambda c: c["n"] == t), F.lit(0))["num"])
    picked = picked.select(key, "style", "c", taken.alias("taken")).select(key, "style", "taken", numbers.alias("nums"))
    rows = rows.select(key, "n", "line", "page").join(picked, key)
    rows = rows.withColumn("ord", F.size(F.filter("taken", lambda t: t <= F.col("n")))).filter("ord > 0")
    first = F.min(F.when(F.col("n") == F.get("taken", F.col("ord") - 1), F.struct("n", F.get("nums", F.col("ord") - 1).alias("num"), "page")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("line").rlike(PAGE_LINE), F.struct("n", "line")))), lambda s: s["line"]), "\n")
    out = rows.groupBy(key, "ord").agg(first.alias("f"), F.first("style").alias("style"), body.alias("text"))
    return out.select(key, F.col("f.num").cast("string").alias("question"), F.col("ord").cast("int"), (F.col("f.n") + 1).alias("start_line"), F.col("f.page").alias("page"), "style", without_footers(F.col("text")).alias("text"))


def parts(mains: DataFrame, key: str = "doc") -> DataFrame:
    """The smallest parts of structured questions: each with the shared stem and its letter's preamble before its own text."""
    glued = F.regexp_replace("text", r"(?i)^(\d{1,2})\s+(\([a-z]\)(?:\s*\([ivx]+\))?)", "$1\n$2")
    rows = mains.select(key, "question", "ord", F.posexplode(F.split(glued, "\n")).alias("n", "line"))
    group = lambda i: F.nullif(F.lower(F.regexp_extract("line", PART_LINE, i)), F.lit(""))
    w = Window.partitionBy(key, "ord").orderBy("n")
    letter = F.coalesce(group(1), F.when(group(3).isNull(), group(4)))
    rows = rows.withColumn("letter", F.last(letter, ignorenulls=True).over(w)).withColumn("roman_here", F.when(F.col("letter").isNotNull(), F.coalesce(group(2), group(3))))
    marks = letter.isNotNull() | F.col("roman_here").isNotNull()
    rows = rows.withColumn("node", F.sum(marks.cast("int")).over(w))
    rows = rows.withColumn("roman", F.first("roman_here").over(Window.partitionBy(key, "ord", "node").orderBy("n")))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda s: s["line"]), "\n")
    nodes = rows.groupBy(key, "question", "ord", "node", "letter", "roman").agg(strip(line).alias("text"))
    inside = Window.partitionBy(key, "ord")
    by_letter = Window.partitionBy(key, "ord", "letter")
    nodes = nodes.withColumn("stem", F.max(F.when(F.col("node") == 0, F.col("text"))).over(inside))
    nodes = nodes.withColumn("romans", F.count("roman").over(by_letter)).withColumn("preamble", F.max(F.when(F.col("roman").isNull(), F.col("text"))).over(by_letter))
    leaf = (F.col("node") > 0) & (F.col("roman").isNotNull() | (F.col("romans") == 0))
    own = strip(F.regexp_replace(F.col("text"), r"\n\s*\[Total:\s*\d+\s*\]\s*$", ""))
    body = F.concat_ws("\n", F.nullif("stem", F.lit("")), F.when(F.col("roman").isNotNull(), F.col("preamble")), own)
    part = F.struct(F.col("question").cast("int").alias("parent"), "letter", "roman")
    return nodes.filter(leaf).select(key, "question", part_label(part).alias("label"), part_slug(part).alias("slug"), "ord", F.col("node").alias("part_ord"), body.alias("text"))


def mark_blocks(docs: DataFrame, key: str = "doc", text: str = "text", most: int = 20) -> DataFrame:
    """(doc, label, block) of a mark scheme whose part labels stand on their own lines; the last block of a label stays."""
    rows = lines_of(docs, key, text).filter(~F.col("line").rlike(PAGE_LINE))
    part = part_id(F.trim("line"))
    head = F.when(F.col("line").rlike(HEAD_LINE) & part["parent"].between(1, most), part_label(part))
    w = Window.partitionBy(key).orderBy("n")
    rows = rows.withColumn("head", head).withColumn("b", F.count("head").over(w)).filter("b > 0")
    kept = F.when(~F.col("line").rlike(FOOTER), F.struct("n", "line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda s: s["line"]), "\n")
    blocks = rows.groupBy(key, "b").agg(F.first("head", ignorenulls=True).alias("label"), strip(F.regexp_replace(body, r"\n{3,}", "\n\n")).alias("block"))
    return blocks.groupBy(key, "label").agg(F.max_by("block", "b").alias("block"))


def marks_by_parent(blocks: DataFrame, key: str = "doc") -> DataFrame:
    """Part blocks under their main question, in part order, a blank line between them."""
    rows = blocks.select(key, part_id(F.col("label"))["parent"].cast("string").alias("question"), part_key(F.col("label")).alias("k"), "block")
    return rows.groupBy(key, "question").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "block"))), lambda s: s["block"]), "\n\n").alias("block"))


def bind_marks(chunks: DataFrame, part_marks: DataFrame, main_marks: DataFrame, key: str = "doc") -> DataFrame:
    """Mark text of each chunk: its part's, else, where it is no part, its question's; unusable text gives way to a pointer."""
    p = part_marks.select(key, "label", F.col("block").alias("_part"))
    m = main_marks.select(key, "question", F.col("block").alias("_main"))
    out = chunks.join(p, [key, "label"], "left").join(m, [key, "question"], "left")
    text = F.coalesce("_part", F.when(F.col("label").isNull(), F.col("_main")))
    return out.withColumn("mark_scheme", F.when(text.isNull(), F.lit(None)).when(garbage(text), F.lit("[see mark scheme image]")).otherwise(text)).drop("_part", "_main")


def later_siblings(chunks: DataFrame, key: str = "doc") -> DataFrame:
    """Adds later: the labels of the parts that follow in the same question, in order."""
    after = Window.partitionBy(key, "question").orderBy("part_ord").rowsBetween(1, Window.unboundedFollowing)
    return chunks.withColumn("later", F.collect_list("label").over(after))
