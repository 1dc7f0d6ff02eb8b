"""Page boxes: bands, next events, range joins and clusters. Boxes are rows; pages are the keys of every shuffle."""

from __future__ import annotations

import itertools
from collections import namedtuple
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.text import LOWERED, PLAIN, RAISED, SUBSCRIPTS, SUPERSCRIPTS

PAGE = ["doc", "page"]


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def question_bands(words: DataFrame, left: float = 40, right: float = 62, most: int = 40, bottom: float = 800.0) -> DataFrame:
    """(doc, page, question, y0, y1): numbers at the left edge, the topmost of each, down to the next."""
    number = F.col("text").try_cast("int")
    marks = words.filter(F.col("text").rlike(r"^\d{1,2}$") & number.between(1, most) & F.col("x0").between(left, right))
    tops = marks.groupBy(*PAGE, number.alias("question")).agg(F.min("y0").alias("y0"))
    w = Window.partitionBy(*PAGE).orderBy("y0", "question")
    return tops.withColumn("y1", F.coalesce(F.lead("y0").over(w), F.lit(bottom)))


def best_overlap(items: DataFrame, bands: DataFrame, keys: list[str], low: str = "y0", high: str = "y1", near: float = 10.0) -> DataFrame:
    """Each item with the band of its page that it overlaps most, 2 more for the band of its middle; the first band wins ties.

    Bands up to near away are compared; an item without a score above 0 has no band."""
    b = bands.select(*keys, F.col(low).alias("b0"), F.col(high).alias("b1"), F.col("question"))
    close = (F.col(high) >= F.col("b0") - near) & (F.col(low) <= F.col("b1") + near)
    bonus = F.when(((F.col(low) + F.col(high)) / 2).between(F.col("b0"), F.col("b1")), 2.0).otherwise(0.0)
    score = F.least(F.col(high), F.col("b1")) - F.greatest(F.col(low), F.col("b0")) + bonus
    scored = items.join(b, keys).filter(close).withColumn("score", score).filter("score > 0")
    w = Window.partitionBy(*keys, "item").orderBy(F.desc("score"), "question")
    return scored.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "b0", "b1")


def inside(words: DataFrame, boxes: DataFrame, margin: float = 0.0) -> DataFrame:
    """Words whose middle lies in a box of their page."""
    b = boxes.select(*PAGE, F.col("ord").alias("box"), *[F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")])
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    hit = x.between(F.col("b_x0") - margin, F.col("b_x1") + margin) & y.between(F.col("b_y0") - margin, F.col("b_y1") + margin)
    return words.join(b, PAGE).filter(hit).select(*words.columns, "box")


def carried(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """As-of: the last value that isn't null, up to each row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def x_groups(boxes: DataFrame, gap: float = 5.0, keys: list[str] | None = None) -> DataFrame:
    """Boxes of a band that a gap in x parts: gaps and islands over the running right edge."""
    keys = keys or [*PAGE, "band"]
    w = Window.partitionBy(*keys).orderBy("x0", "x1")
    edge = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return boxes.withColumn("_new", F.coalesce(F.col("x0") > edge + gap, F.lit(True)).cast("int")).withColumn("group", F.sum("_new").over(w)).drop("_new")


FOLDED = 10_000  #: rows that a batch of a fold's results holds


def folded(rows: DataFrame, order: list[Column], fold: Callable[[Iterator], Iterable[tuple]], schema: StructType | str) -> DataFrame:
    """fold(rows of a page, in order) for every page: its results are tuples of the schema.

    A task's pages stream by one after the other, sorted by Spark: millions of small pages are no calls of their own, and a large one is
    never held but by what its fold keeps. Missing numbers are NaN."""
    names = rows.columns
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, row = to_arrow_schema(schema), namedtuple("Row", names, rename=True)
        values = lambda c: c.to_numpy(zero_copy_only=False).tolist() if pa.types.is_floating(c.type) else c.to_pylist()
        stream = itertools.chain.from_iterable(map(row._make, zip(*map(values, b.columns))) for b in batches)
        doc, at = names.index(PAGE[0]), names.index(PAGE[1])
        results = itertools.chain.from_iterable(fold(page) for _, page in itertools.groupby(stream, key=lambda r: (r[doc], r[at])))
        while some := list(itertools.islice(results, FOLDED)):
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type, from_pandas=True) for c, f in zip(zip(*some), arrow)], schema=arrow)

    return rows.repartition(*PAGE).sortWithinPartitions(*PAGE, *order).mapInArrow(run, schema)


def last_null(*names: str) -> list[Column]:
    return [F.col(n).asc_nulls_last() for n in names]


def bands(boxes: DataFrame, tolerance: float = 8.0) -> DataFrame:
    """Boxes in order of y with the number of their band: a box joins while it is near the running mean. Order-dependent, a page at a time."""

    def fold(page: Iterator) -> Iterator[tuple]:
        mean, n, band = 0.0, 0, 0
        for r in page:
            y = (r.y0 + r.y1) / 2
            if n and abs(y - mean) > tolerance:
                band, n = band + 1, 0
            mean = (mean * n + y) / (n + 1)
            n += 1
            yield (*r, band)

    return folded(boxes, last_null("y0", "x0", "ord"), fold, StructType([*boxes.schema.fields, StructField("band", IntegerType())]))


def larger_of_overlapping(boxes: DataFrame, most: float = 0.55) -> DataFrame:
    """Greedy, larger first: a box stays while it shares at most this part of the smaller area with those that stay."""

    def fold(page: Iterator) -> Iterator[tuple]:
        kept: list = []
        for r in page:
            area = (r.x1 - r.x0) * (r.y1 - r.y0)
            for k, other in kept:
                shared = max(0.0, min(r.x1, k.x1) - max(r.x0, k.x0)) * max(0.0, min(r.y1, k.y1) - max(r.y0, k.y0))
                if shared > most * max(min(area, other), 1e-9):
                    break
            else:
                kept.append((r, area))
                yield r

    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return folded(boxes, [F.nullif(area, F.lit(float("nan"))).desc_nulls_last(), *last_null("ord")], fold, boxes.schema)


def body_sizes(spans: DataFrame) -> DataFrame:
    """(doc, page, body): the upper middle of the sizes, then of those of at least nine tenths of it."""
    middle = lambda a: F.get(a, F.floor(F.size(a) / 2).cast("int"))
    sizes = spans.filter("size > 0").groupBy(*PAGE).agg(F.array_sort(F.collect_list("size")).alias("s"))
    first = sizes.withColumn("m", middle(F.col("s")))
    return first.select(*PAGE, middle(F.filter("s", lambda x: x >= F.col("m") * 0.9)).alias("body"))


TOKENS = "doc string, page int, ord int, x0 double, y0 double, x1 double, y1 double, text string, kind string"
LOW, HIGH = str.maketrans(dict(zip(PLAIN, SUBSCRIPTS)) | LOWERED), str.maketrans(dict(zip(PLAIN, SUPERSCRIPTS)) | RAISED)


def tokens(spans: DataFrame, script: float = 0.78) -> DataFrame:
    """Spans as tokens: leading blanks move the left edge, and a small span close after a token joins it, raised or lowered by its
    middle. A page at a time, as each span depends on the token before."""
    sized = spans.join(body_sizes(spans), PAGE, "left").withColumn("body", F.coalesce("body", F.lit(11.0)))

    def fold(page: Iterator) -> Iterator[tuple]:
        last, n = None, 0
        for r in page:
            text = r.text.lstrip(" ")
            x0 = r.x0 + (len(r.text) - len(text)) * r.size * 0.33
            text = text.rstrip()
            if not text:
                continue
            middle = (r.y0 + r.y1) / 2
            if last and 0 < r.body and r.size / r.body < script:
                before = (last["y0"] + last["y1"]) / 2
                if abs(before - middle) < r.body * 1.2 and x0 - last["x1"] < r.body:
                    raised = middle < before - r.body * 0.05
                    last["text"] += text.strip().translate(HIGH if raised else LOW)
                    last.update(x1=max(last["x1"], r.x1), y0=min(last["y0"], r.y0), y1=max(last["y1"], r.y1))
                    continue
            if last:
                yield tuple(last.values())
            last, n = {"doc": r.doc, "page": r.page, "ord": n, "x0": x0, "y0": r.y0, "x1": r.x1, "y1": r.y1, "text": text, "kind": "text"}, n + 1
        if last:
            yield tuple(last.values())

    return folded(sized, last_null("ord"), fold, TOKENS)


def page_lines(tokens: DataFrame, tolerance: float = 5.5, gap: float = 2.8) -> DataFrame:
    """(doc, page, line, text): a token is on the line of the line's first token while their middles are close; a gap, a symbol beside
    a word or a comma before one gives a blank. The first token of a line decides, so a page is folded in order."""

    def read(line: list) -> str:
        text, last = "", None
        for t in sorted(line, key=lambda t: (t.x0, t.late)):
            if last is not None:
                word = t.text[:1].isalnum()
                apart = t.x0 - last.x1 > gap or (t.kind == "symbol" and last.text[-1:].isalnum()) or (word and (last.kind == "symbol" or last.text[-1:] in ",;:"))
                text += " " if apart and not text.endswith(" ") else ""
            text, last = text + t.text, t
        return " ".join(text.split(" ")).strip()

    def fold(page: Iterator) -> Iterator[tuple]:
        line, n = [], 0
        for t in page:
            if line and not abs(line[0].mid - t.mid) <= tolerance:
                yield t.doc, t.page, n, read(line)
                line, n = [], n + 1
            line.append(t)
        yield line[0].doc, line[0].page, n, read(line)

    mid = (F.col("y0") + F.col("y1")) / 2
    rows = tokens.select(*PAGE, "x0", "x1", "text", "kind", "ord", mid.alias("mid"), F.coalesce(F.col("kind") != "symbol", F.lit(True)).cast("int").alias("late"))
    row = F.bround(F.col("mid") / tolerance)  # halves go to the even number
    return folded(rows, [row.asc_nulls_last(), *last_null("x0", "late", "ord")], fold, "doc string, page int, line int, text string")


def option_rows(words: DataFrame, bands: DataFrame, most_height: float = 18, least_width: float = 180) -> DataFrame:
    """Bands whose letters A to D stand in one row from left to right: (doc, page, question, x0, y0, x1, y1) of the row."""
    b = bands.select(*PAGE, "question", F.col("y0").alias("b0"), F.col("y1").alias("b1"))
    letters = words.filter(F.trim("text").isin("A", "B", "C", "D") & (F.col("x1") - F.col("x0") <= 20)).join(b, PAGE)
    letters = letters.filter(F.col("y0").between(F.col("b0") - 5, F.col("b1") + 5))
    top = letters.groupBy(*PAGE, "question", F.trim("text").alias("letter")).agg(F.min(F.struct("y0", "x0", "x1", "y1")).alias("w"))
    rows = top.groupBy(*PAGE, "question").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("letter", "w"))), lambda s: s["w"]["x0"]).alias("xs"),
        F.min("w.x0").alias("x0"), F.min("w.y0").alias("y0"), F.max("w.x1").alias("x1"), F.max("w.y1").alias("y1"), F.max("w.y0").alias("low"),
    )
    ok = (F.size("xs") == 4) & (F.array_sort("xs") == F.col("xs")) & (F.col("low") - F.col("y0") <= most_height) & (F.col("x1") - F.col("x0") >= least_width)
    return rows.filter(ok).select(*PAGE, "question", "x0", "y0", "x1", "y1")


def content_bottoms(bands: DataFrame, words: DataFrame, drawings: DataFrame, page_bottom: float = 842.0, trailer: str = r"(?i)^(©|Permission|Copyright)", footer: str = r"(?i)UCLES|^\[Turn") -> DataFrame:
    """Each band (doc, page, question, x0, y0, x1, y1) with the lowest content in it, 10 more, above a copyright trailer if one begins there.

    Bands with a column bottom know the lower end of their own page; their other columns stay."""
    keys = [*PAGE, "question"]
    own = F.col("bottom") if "bottom" in bands.columns else F.lit(page_bottom)
    b = bands.select(*keys, F.struct(*[c for c in bands.columns if c not in keys]).alias("b"), own.alias("page_end"))
    items = words.select(*PAGE, "x0", "y0", "x1", "y1", F.coalesce("text", F.lit("")).alias("text")).unionByName(drawings.select(*PAGE, "x0", "y0", "x1", "y1", F.lit(None).cast("string").alias("text")))
    met = b.join(items.hint("merge"), PAGE, "left")
    touches = (F.col("x1") >= F.col("b.x0")) & (F.col("x0") <= F.col("b.x1")) & (F.col("y1") >= F.col("b.y0") - 2)
    word = F.col("text").isNotNull() & (F.col("y0") <= F.col("b.y1") + 2)
    cut = F.min(F.when(touches & word & F.col("text").rlike(trailer), F.col("y0"))).over(Window.partitionBy(*keys))
    met = met.withColumn("cap", F.coalesce(cut - 4, F.col("b.y1")))
    ink = F.col("text").isNull() & ((F.col("y1") - F.col("y0") >= 1.5) | (F.col("x1") - F.col("x0") <= 200))
    content = touches & ((word & ~F.col("text").rlike(footer)) | ink) & (F.col("y0") <= F.col("cap")) & (F.col("y0") <= F.col("page_end") - 50)
    out = met.groupBy(*keys).agg(F.first("b").alias("b"), F.first("cap").alias("cap"), F.max(F.when(content, F.col("y1"))).alias("low"))
    y1 = F.least("cap", F.greatest(F.col("b.y0") + 36, "low") + 10)
    return out.select(*[F.col(c) if c in keys else y1.alias("y1") if c == "y1" else F.col(f"b.{c}") for c in bands.columns])
