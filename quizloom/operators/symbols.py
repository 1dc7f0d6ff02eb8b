"""Symbols that are drawn, not set: enthalpy signs out of strokes, and the arrows of reactions that stand below or beside them.

Strokes (doc, page, ord, x0, y0, x1, y1) of a page are clustered as boxes are; the shape of a cluster is a few aggregates of it. Arrows
are gaps: the nearest formulae to the left and to the right of a sign, by page, of which only signs and formulae meet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lowered
from .geometry import PAGE, bands, x_groups

ENTHALPY, STANDARD, ARROW = "ΔH", "⦵", "→"
BOX = ["x0", "y0", "x1", "y1"]


def clusters(strokes: DataFrame, gap: float = 5.0) -> DataFrame:
    """Strokes of the size of letters with the band and the group that they are drawn in."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    drawn = strokes.filter((w > 0) & (h > 0) & (w <= 80) & (h <= 30) & ((w >= 0.4) | (h >= 0.4)))
    return x_groups(bands(drawn), gap)


def enthalpy_signs(strokes: DataFrame, glyphs: DataFrame | None = None) -> DataFrame:
    """(doc, page, x0, y0, x1, y1, text, kind): clusters that are an enthalpy sign: at least four strokes, two of the size of capitals, and a bar.

    What the lowest upright stroke at the right says (glyphs: doc, page, ord, char) is its subscript."""
    keys = [*PAGE, "band", "group"]
    c, w, h = F.col, F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    stroke = F.struct(*BOX, "ord")
    shape = clusters(strokes).groupBy(*keys).agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n"),
        F.bool_or((h <= 1.2) & (w >= 2.0)).alias("bar"), F.count_if((w >= 4.5) & (h >= 5.5)).alias("capitals"), F.collect_list(stroke).alias("strokes"),
    )
    fits = (c("n") >= 4) & (c("x1") - c("x0")).between(14, 36) & (c("y1") - c("y0")).between(6, 18) & c("bar") & (c("capitals") >= 2)
    middle, across = (c("y0") + c("y1")) / 2, (c("x0") + c("x1")) / 2
    tall = F.filter("strokes", lambda s: (s["x0"] >= across - 2) & (s["y1"] - s["y0"] >= 3.2) & (s["y1"] - s["y0"] >= (s["x1"] - s["x0"]) * 0.85) & ((s["y0"] + s["y1"]) / 2 >= middle - 1))
    lowest = F.array_max(F.transform(tall, lambda s: F.struct((s["y0"] + s["y1"]).alias("mid"), (-s["ord"]).alias("first"))))
    found = shape.filter(fits).withColumn("ord", (-lowest["first"]).cast(dict(strokes.dtypes)["ord"]))
    read = found.join(glyphs.select(*PAGE, "ord", "char"), [*PAGE, "ord"], "left") if glyphs is not None else found.withColumn("char", F.lit(None).cast("string"))
    text = F.concat(F.lit(ENTHALPY), F.coalesce(lowered(F.nullif(c("char"), F.lit("?"))), F.lit("")), F.lit(STANDARD))
    return read.select(*PAGE, *BOX, text.alias("text"), F.lit("symbol").alias("kind"))


def nearest(side: str, fits: Callable[[Column], Column]) -> Column:
    """The box of the last formula on the left, or of the first on the right, of those that fit."""
    own = F.filter("formulae", fits)
    ends = F.transform(own, lambda f: F.struct(f["x1" if side == "left" else "x0"].alias("end"), f.alias("box")))
    return (F.array_max(ends) if side == "left" else F.array_min(ends))["box"]


def arrows_and_symbols(tokens: DataFrame, least_gap: float = 8.0) -> DataFrame:
    """The symbols of tokens (doc, page, x0, y0, x1, y1, text, kind) and, of kind text, the arrows that were found for them; symbols with an arrow stand above it.

    Formulae (texts with a bracket) beside a symbol are its reaction, else those beside the place on the line below it. An arrow stands
    in the middle of the gap between them. A symbol meets the texts of its page once, and both come out of that one pass."""
    c = F.col
    signs = tokens.filter("kind = 'symbol'").select(*PAGE, *BOX, "text", F.monotonically_increasing_id().alias("sign"))
    texts = tokens.filter("kind <> 'symbol'").select(*PAGE, *[F.col(b).alias(f"f_{b}") for b in BOX], F.contains("text", F.lit("(")).alias("formula"), ((F.col("y0") + F.col("y1")) / 2).alias("f_mid"))
    mid, across = (c("x0") + c("x1")) / 2, (c("y0") + c("y1")) / 2
    met = signs.join(texts, PAGE, "left").withColumn("away", c("f_mid") - across)
    formula = F.struct(c("f_mid").alias("mid"), *[c(f"f_{b}").alias(b) for b in BOX])
    first = met.groupBy("sign", *PAGE, *BOX, "text").agg(
        F.collect_list(F.when(c("formula"), formula)).alias("formulae"), F.min_by("f_mid", F.when(c("away").between(0, 22), F.abs(c("away") - 12))).alias("line"),
    )
    beside = lambda f: F.abs(f["mid"] - across) <= 18
    on_line = lambda f: F.abs(f["mid"] - c("line")) <= 6
    both = first.withColumn("left", nearest("left", lambda f: beside(f) & (f["x1"] <= mid + 2))).withColumn("right", nearest("right", lambda f: beside(f) & (f["x0"] >= mid - 2)))
    whole = c("left").isNotNull() & c("right").isNotNull()
    both = both.withColumn("left2", nearest("left", lambda f: on_line(f) & (f["x1"] < c("x0")))).withColumn("right2", nearest("right", lambda f: on_line(f) & (f["x0"] > c("x1"))))
    both = both.withColumn("a", F.when(whole, c("left")).otherwise(c("left2"))).withColumn("b", F.when(whole, c("right")).otherwise(c("right2")))
    hit = F.coalesce(c("b.x0") - c("a.x1") >= least_gap, F.lit(False))
    at, top, low = (c("a.x1") + c("b.x0")) / 2, F.least("a.y0", "b.y0"), F.greatest("a.y1", "b.y1")
    x0 = at - (c("x1") - c("x0")) / 2
    place = {"x0": x0, "y0": top - 2, "x1": x0 + 18, "y1": low}
    moved = F.struct(*[F.when(hit, place[b]).otherwise(c(b)).alias(b) for b in BOX], c("text").alias("text"), F.lit("symbol").alias("kind"))
    arrow = F.struct((at - 4).alias("x0"), top.alias("y0"), (at + 4).alias("x1"), low.alias("y1"), F.lit(ARROW).alias("text"), F.lit("text").alias("kind"))
    return both.select(*PAGE, F.explode(F.array_compact(F.array(moved, F.when(hit, arrow)))).alias("t")).select(*PAGE, "t.*")


def reaction_arrows(tokens: DataFrame, least_gap: float = 8.0) -> tuple[DataFrame, DataFrame]:
    """Arrows, and the symbols with those moved that an arrow was found for, as two tables; who needs both reads arrows_and_symbols once."""
    every = arrows_and_symbols(tokens, least_gap)
    return every.filter("kind = 'text'"), every.filter("kind = 'symbol'")


def with_symbols(tokens: DataFrame, strokes: DataFrame, glyphs: DataFrame | None = None) -> DataFrame:
    """The texts of pages with the enthalpy signs and arrows that are drawn on them, as tokens for geometry.page_lines."""
    texts = tokens.select(*PAGE, *BOX, "text", "kind")
    return texts.unionByName(arrows_and_symbols(texts.unionByName(enthalpy_signs(strokes, glyphs))))
