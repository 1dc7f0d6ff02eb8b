"""Clips: the stretches of pages that show a question, a part of one or a row of a mark scheme.

Everything is rows with a place (page, y) in a document. What opens something is an event; a clip reaches from its event to the
next, and becomes one band for each page between, cut to the page's margins. Words meet bands by page, so documents of any
length are spread by page; windows run over the events of a document, of which there are few.

Tables: words (doc, page, x0, y0, x1, y1, text), pages (doc, page, right, bottom and perhaps practical), drawings (doc, page, x0, y0, x1, y1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import distinctive_words, word_hits
from ..sources.store import kept
from .geometry import PAGE, content_bottoms, question_bands

LEFT, RIGHT_INSET, TOP, FOOT = 40.0, 32.0, 48.0, 36.0  #: margins of a page
LAST_LINE = 40.0  #: below this much above the lower end stands no content
LOOK_BACK = 2  #: pages before a question on which its key may stand
JOINED = 12.0  #: bands of a page that are no further apart are one
#: Fixed: first words of trailers, words of page feet, and lines that aren't a question's own.
TRAILER, FEET, FOREIGN = r"(?i)^(?:Permission|BLANK)$", r"(?i)UCLES|Turn\s*over|9701/\d+|Permission|copyright|Acknowledgements|BLANK|www\.cambridge", r"(?i)^(?:Permission|BLANK|To avoid|Cambridge Assessment)\b"
#: Fixed: how the key of statement questions reads, and how their stems ask.
KEY = [r"responses\s*A\s*to\s*D", r"1[, ]\s*2\s+and\s*3", r"2\s+and\s*3", r"1\s+and\s*2\s+only", r"1\s+and\s*3", r"1\s+only", r"2\s+only", r"only\s+are\s+correct", "No other combination of statements"]
ASKS = ["Which statements", "which of the following statements", "In which (?:ions|molecules|compounds)", r"Which (?:oxides|reactions|changes|pairs|mixtures|alcohols)\b", r"Which statements?\s+are\s+correct\b"]
#: Fixed: words of the sentence below a key.
KEY_SENTENCE = ["correct", "response", "combination", "statements", "used", "as", "a", "other", "no", "of", "is"]
HAS_KEY, HAS_ASK = f"(?i)(?:{'|'.join(KEY)})", f"(?i)(?:{'|'.join(ASKS)})"


def merged_with(rows: DataFrame) -> DataFrame:
    """The other side of a join by page or document. Both sides grow with the papers, so they are merged: some thirty joins of a plan that send
    what seems small to the driver, all at once, are too much for it."""
    return rows.hint("merge")


# ---------------------------------------------------------------- texts of bands


def band_texts(bands: DataFrame, words: DataFrame, keys: list[str], line_gap: float = 4.0) -> DataFrame:
    """bands with lines and text: the words whose middle lies in a band, as lines from top to bottom; bands that have no words have no lines."""
    b = bands.select(*keys, F.struct(*[c for c in bands.columns if c not in keys]).alias("b"), F.struct("x0", "y0", "x1", "y1").alias("box"))
    middles = words.select(*[F.col(c).alias(f"w_{c}") for c in PAGE], F.col("x0").alias("left"), ((F.col("x0") + F.col("x1")) / 2).alias("mx"), ((F.col("y0") + F.col("y1")) / 2).alias("my"), F.col("text").alias("word"))
    inside = (F.col("doc") == F.col("w_doc")) & (F.col("page") == F.col("w_page")) & F.col("mx").between(F.col("box.x0"), F.col("box.x1")) & F.col("my").between(F.col("box.y0"), F.col("box.y1"))
    met = b.join(merged_with(middles), inside, "left")
    w = Window.partitionBy(*keys).orderBy("my", "left")
    fresh = F.coalesce(F.col("my") - F.lag("my").over(w) > line_gap, F.lit(True)).cast("int")
    lined = met.withColumn("fresh", fresh).withColumn("line", F.sum("fresh").over(w))
    in_line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("left", "word"))), lambda s: s["word"]), " ")
    by_line = lined.groupBy(*keys, "line").agg(F.first("b").alias("b"), in_line.alias("words"))
    lines = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("line", "words"))), lambda s: s["words"]), lambda x: x != "")
    out = by_line.groupBy(*keys).agg(F.first("b").alias("b"), lines.alias("lines"))
    return out.select(*[F.col(c) if c in keys else F.col(f"b.{c}") for c in bands.columns], "lines", F.array_join("lines", "\n").alias("text"))


def shows_question(question: Column, lines: Column) -> Column:
    """Whether the lines of a clip begin with this question and are more than a lone statement that carries its number."""
    number = question.cast("string")
    own = lambda x: F.regexp_like(x, F.concat(F.lit("^"), number, F.lit(r"(?:\s|[A-Z]|\b)")))
    stem = lambda x: ~x.rlike(FOREIGN) & (own(x) | x.rlike("[A-Za-z]{3,}"))
    at = F.coalesce(F.array_position(F.transform(lines, stem), True), F.lit(0)).cast("int")
    first = F.get(lines, at - 1)
    rest = F.slice(lines, F.greatest(at, F.lit(1)), F.size(lines))
    short = F.regexp_like(first, F.concat(F.lit("^"), number, F.lit(r"\s+.{10,120}$"))) & (F.size(rest) <= 2)
    statement = short & (question.cast("int") <= 30) & ~F.exists(rest, lambda x: x.rlike(r"\b[A-D]\b"))
    return F.coalesce((at > 0) & own(first) & ~statement, F.lit(False))


def opens_next(question: Column, text: Column) -> Column:
    """Whether a text goes on into the next question: a line of the next number and a capitalised word that names no figure.

    Statements are numbered too; where there is a key, only what stands behind it counts."""
    key = F.regexp_instr(text, F.lit(HAS_KEY))
    behind = F.when(key > 0, F.substr(text, key + F.length(F.regexp_extract(text, HAS_KEY, 0)), F.length(text))).otherwise(text)

    def found(t: Column) -> Column:
        line = r"(?:^|\n)\s*(\d{1,2})[\s\x00-\x1f\uFEFF]+([A-Z][A-Za-z]{2,})\b"
        opener = F.arrays_zip(F.regexp_extract_all(t, F.lit(line), F.lit(1)).alias("n"), F.regexp_extract_all(t, F.lit(line), F.lit(2)).alias("word"))
        first = F.get(F.filter(opener, lambda o: o["n"].cast("int") == question.cast("int") + 1), F.lit(0))
        return F.coalesce(~F.lower(first["word"]).isin("fig", "figure"), F.lit(False))

    return (question.cast("int") < 40) & found(text) & found(behind)


def agreement(clips: DataFrame, questions: DataFrame, stop: list[str], k: int = 6, least: int = 2, keys: tuple[str, ...] = ("doc",)) -> DataFrame:
    """clips (keys, question, text) against the texts of their questions: hits among the first k telling words of the question, hits
    among those of the next question that this one lacks, and problem: empty, foreign, next or null."""
    order = Window.partitionBy(*keys).orderBy(F.col("question").cast("int"))
    words = questions.select(*keys, "question", distinctive_words(F.col("text"), stop, k).alias("own"))
    words = words.withColumn("later", F.array_except(F.lead("own").over(order), "own"))
    met = clips.join(words, [*keys, "question"], "left")
    need = lambda c: F.least(F.lit(least), F.size(c))
    met = met.withColumn("hits", word_hits(F.col("own"), F.col("text"))).withColumn("next_hits", F.coalesce(word_hits(F.col("later"), F.col("text")), F.lit(0)))
    problem = F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "empty").when(F.col("own").isNull() | (F.col("hits") < need(F.col("own"))), "foreign")
    return met.withColumn("problem", problem.when((F.size("later") >= least) & (F.col("next_hits") >= least), "next")).drop("own", "later")


# ---------------------------------------------------------------- questions


def openers(words: DataFrame) -> DataFrame:
    """(doc, page, question, y): the topmost place of each number in the number column of a page."""
    return question_bands(words).select(*PAGE, "question", F.col("y0").alias("y"))


def first_bands(marks: DataFrame, words: DataFrame, pages: DataFrame, drawings: DataFrame) -> DataFrame:
    """The band of every opener on its own page, cut below its lowest content, with next: whether another question opens below it."""
    w = Window.partitionBy(*PAGE).orderBy("y", "question")
    inset = F.when(F.col("practical"), 0.0).otherwise(RIGHT_INSET) if "practical" in pages.columns else F.lit(RIGHT_INSET)
    rows = marks.withColumn("below", F.lead("y").over(w)).join(merged_with(pages), PAGE)
    top = F.greatest(F.lit(0.0), F.col("y") - 2)
    raw = rows.select(
        *PAGE, "question", "bottom", F.col("below").isNotNull().alias("next"), F.lit(LEFT).alias("x0"), top.alias("y0"),
        (F.col("right") - inset).alias("x1"), (F.coalesce(F.col("below") - 2, F.col("bottom") - LAST_LINE - 2) - 4).alias("y1"),
    )
    cut = content_bottoms(raw, words, drawings, trailer=TRAILER, footer=FEET)
    return cut.withColumn("y1", F.greatest(F.col("y0") + 36, F.col("y1"))).withColumn("y0", F.greatest(F.lit(0.0), F.col("y0") - 2))


def valid_openings(bands: DataFrame, words: DataFrame, accept: Column | None = None) -> DataFrame:
    """Of each question of a document the first band that shows it and doesn't go on into the next, with its text."""
    told = band_texts(bands, words, [*PAGE, "question"])
    good = told.filter(shows_question(F.col("question"), F.col("lines")) & ~opens_next(F.col("question"), F.col("text")))
    w = Window.partitionBy("doc", "question").orderBy("page")
    return (good if accept is None else good.filter(accept)).withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")


def page_stops(words: DataFrame) -> DataFrame:
    """(doc, page, y): what ends a question besides the next one: a heading of the qualitative part, and a blank page at its top."""
    analysis = words.filter(F.col("text").rlike("(?i)^analysis$")).select(*PAGE, F.col("y0").alias("ay"), F.col("x0").alias("ax"))
    heads = words.filter(F.col("text").rlike("(?i)^Qualitative$") & (F.col("x0") < 80) & (F.col("y0") < 200)).join(merged_with(analysis), PAGE)
    heads = heads.filter((F.abs(F.col("ay") - F.col("y0")) < 4) & (F.col("ax") > F.col("x0")) & (F.col("ax") < F.col("x0") + 140)).groupBy(*PAGE).agg(F.min("y0").alias("y"))
    after = F.lead("text").over(Window.partitionBy(*PAGE).orderBy("y0", "x0"))
    blank, part = F.bool_or(F.col("text").rlike("(?i)^BLANK$") & F.col("after").rlike("(?i)^PAGE$")), F.bool_or(F.col("text").rlike(r"(?i)^\([a-z]\)"))
    empty = words.withColumn("after", after).groupBy(*PAGE).agg(blank.alias("blank"), part.alias("part")).filter("blank and not part")
    return heads.unionByName(empty.select(*PAGE, F.lit(0.0).alias("y")))


def continued(opened: DataFrame, marks: DataFrame, words: DataFrame, pages: DataFrame, drawings: DataFrame) -> DataFrame:
    """The first bands and those of further pages, where a question is the last to open on its page: down to the next stop, cut below their
    lowest content.

    A stop is an opener of a later number, or a page that has the same number again or is no question's. A question has one interval, from
    its page to that of its stop; the pages between are whole. A document has few numbers, so they meet its stops by document."""
    none = F.lit(None).cast("int")
    stops = marks.select("doc", F.col("page").alias("p"), "y", F.col("question").alias("number")).unionByName(page_stops(words).select("doc", F.col("page").alias("p"), "y", none.alias("number")))
    ends = stops.groupBy("doc").agg(F.collect_list(F.struct("p", "y", "number")).alias("stops")).join(merged_with(pages.groupBy("doc").agg(F.max("page").alias("end"))), "doc", "right")
    box = [*PAGE, "question", "x0", "y0", "x1", "y1"]
    own = opened.select(*box, "next").join(merged_with(ends), "doc")
    later = F.filter("stops", lambda s: (s["p"] > F.col("page")) & (s["number"].isNull() | (s["number"] >= F.col("question"))))
    at = F.transform(later, lambda s: F.struct(s["p"].alias("p"), F.when(s["number"] == F.col("question"), 0.0).otherwise(s["y"]).alias("y"), s["number"].alias("number")))
    own = own.withColumn("stop", F.array_min(at)).withColumn("first", F.col("page"))
    end = F.when(F.col("next"), F.col("page")).otherwise(F.coalesce(F.col("stop.p"), F.col("end")))
    each = own.withColumn("page", F.explode(F.sequence("page", end))).join(merged_with(pages.select(*PAGE, "bottom")), PAGE)
    here, at_stop, heading = F.col("page") == F.col("first"), F.col("page") == F.col("stop.p"), F.col("stop.number").isNull()
    y0 = F.when(here, F.col("y0")).otherwise(TOP)
    y1 = F.when(here, F.col("y1")).when(at_stop, F.col("stop.y") - F.when(heading, 2.0).otherwise(4.0)).otherwise(F.col("bottom") - LAST_LINE)
    each = each.withColumn("y0", y0).withColumn("y1", y1).withColumn("here", here).withColumn("raw", F.col("y1"))
    enough = F.when(at_stop & ~here, F.col("y1") > F.col("y0") + F.when(heading, 30.0).otherwise(LAST_LINE))
    raw = each.filter(F.coalesce(enough, F.lit(True))).select(*box, "bottom", "here", "raw")
    cut = content_bottoms(raw, words, drawings, trailer=TRAILER, footer=FEET)
    low = F.when(F.col("here"), F.col("raw")).otherwise(F.least("raw", F.greatest(F.col("y0") + 36, F.col("y1"))))
    return cut.withColumn("y1", low).filter(F.col("here") | (F.col("y1") > F.col("y0") + 30)).select(box)


BAND = [*PAGE, "question", "band", "x0", "y0", "x1", "y1"]


def numbered_bands(bands: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("page", "y0")
    return bands.withColumn("band", F.row_number().over(w))


def structured_clips(words: DataFrame, pages: DataFrame, drawings: DataFrame) -> DataFrame:
    """(doc, page, question, band, x0, y0, x1, y1): the bands of every question of papers without options, over page ends."""
    marks = kept(openers(words), "marks")
    opened = valid_openings(first_bands(marks, words, pages, drawings), words)
    opened = kept(opened, "opened")
    return numbered_bands(continued(opened, marks, words, pages, drawings), ["doc", "question"]).select(BAND)


# ---------------------------------------------------------------- multiple choice: options and shared keys


def statements(question: Column, text: Column) -> Column:
    """Whether a question asks which of its numbered statements are right."""
    options = text.rlike(r"(?m)(?s)^\s*A\s+\S.*?^\s*B\s+\S.*?^\s*C\s+\S.*?^\s*D\s+\S") & ~text.rlike(HAS_KEY)
    prose = text.rlike(r"(?m)(?s)^\s*1\s+[A-Za-z].*?^\s*2\s+[A-Za-z].*?^\s*3\s+[A-Za-z]")
    bare = text.rlike(r"(?m)(?s)^\s*1\s*$.*?^\s*2\s*$.*?^\s*3\s*$")
    asks = text.rlike(HAS_ASK)
    return ~options & F.when(question.cast("int").between(31, 40), prose | bare | asks).otherwise(asks & prose)


def key_regions(words: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc, page, x0, y0, x1, y1): blocks that tell what A to D stand for: a line of "responses", the row "1, 2 and 3" below it, and the
    sentence below that. A page may have several."""
    heads = words.filter(F.col("text").rlike("(?i)^responses?$")).select(*PAGE, F.col("y0").alias("head")).distinct()
    ones = words.filter(F.col("text").isin("1,", "1")).select(*PAGE, F.col("x0").alias("ox"), F.col("y0").alias("row"))
    near = words.filter(F.lower("text").isin("2", "and")).select(*PAGE, "x0", "y0", F.lower("text").alias("word")).join(merged_with(ones), PAGE)
    near = near.filter((F.abs(F.col("y0") - F.col("row")) < 8) & (F.col("x0") - F.col("ox")).between(0, 79.999))
    rows = near.groupBy(*PAGE, "row").agg(F.collect_set("word").alias("both")).filter(F.size("both") == 2).select(*PAGE, "row")
    tops = heads.join(merged_with(rows), PAGE).filter((F.col("row") > F.col("head")) & (F.col("row") <= F.col("head") + 70)).groupBy(*PAGE, "head").agg(F.min("row").alias("row"))
    # heads of the same row belong to one block: the lowest stands right above it
    tops = tops.groupBy(*PAGE, "row").agg(F.min("head").alias("head")).withColumn("top", F.col("head") - 2)
    tops = tops.withColumn("next_top", F.lead("top").over(Window.partitionBy(*PAGE).orderBy("top")))
    said = words.filter(F.rtrim(F.lower("text"), F.lit(".")).isin(KEY_SENTENCE)).select(*PAGE, "y0", "y1").join(merged_with(tops), PAGE)
    said = said.filter(F.col("y0").between(F.col("top") - 2, F.col("top") + 140) & (F.col("next_top").isNull() | (F.col("y0") < F.col("next_top"))))
    lows = said.groupBy(*PAGE, "top").agg(F.max("y1").alias("low"))
    found = tops.join(merged_with(lows), [*PAGE, "top"], "left").join(merged_with(pages.select(*PAGE, "right")), PAGE)
    boxes = found.select(*PAGE, F.lit(LEFT).alias("x0"), F.greatest(F.lit(0.0), F.col("top")).alias("y0"), (F.col("right") - RIGHT_INSET).alias("x1"), (F.greatest(F.col("top") + 50, "low") + 8).alias("y1"))
    told = band_texts(boxes.withColumn("top", F.col("y0")), words, [*PAGE, "top"])
    letters = lambda c: F.col("text").rlike(rf"(?:^|\s){c}(?:\s|$)")
    return told.filter(F.col("text").rlike(HAS_KEY) & letters("A") & letters("D") & (F.col("y1") - F.col("y0") >= 40)).select(*PAGE, "x0", "y0", "x1", "y1")


def keys_for(asking: DataFrame, keys: DataFrame, marks: DataFrame) -> DataFrame:
    """The key of each statement question (doc, page, question, y0, y1, next), with own for the question's page: below it on its page, else
    above it, else on top of the next page where it is the last of its own, else the last one of the pages before, at most LOOK_BACK back.

    A question asks at a handful of pages, so keys are met by page; the best place wins."""
    places = asking.select("doc", "question", F.col("page").alias("own"), F.col("y0").alias("q0"), F.col("y1").alias("q1"), "next", F.explode(F.sequence(F.col("page") - LOOK_BACK, F.col("page") + 1)).alias("page"))
    tops = marks.groupBy(*PAGE).agg(F.min("y").alias("first_mark"))
    met = places.join(merged_with(keys), PAGE).join(merged_with(tops), PAGE, "left")
    away = F.col("page") - F.col("own")
    below = (away == 0) & (F.col("y0") >= F.col("q1") - 20)
    above = (away == 0) & (F.col("y0") < F.col("q0") - 2)
    reprint = (away == 1) & ~F.col("next") & (F.col("first_mark").isNull() | (F.col("y0") < F.col("first_mark") - 4))
    rank = lambda n, y: F.struct(n.cast("int").alias("rank"), y.alias("then"))
    best = F.when(below, rank(F.lit(1), F.col("y0"))).when(above, rank(F.lit(2), -F.col("y0"))).when(reprint, rank(F.lit(3), F.col("y0"))).when(away < 0, rank(3 - away, -F.col("y0")))
    w = Window.partitionBy("doc", "question", "own").orderBy("best")
    return met.withColumn("best", best).filter(F.col("best").isNotNull()).withColumn("nth", F.row_number().over(w)).filter("nth = 1").select("own", *PAGE, "question", "x0", "y0", "x1", "y1")


def letters_shown(text: Column) -> Column:
    """Whether A, B, C and D all stand for options in a clip's text."""
    starts = F.regexp_extract_all(text, F.lit(r"(?m)^\s*([A-D])(?=\s|$|[.)]|→)"), F.lit(1))
    in_row = F.regexp_extract_all(text, F.lit(r"(?m)(?:^|\s)([A-D])(?=\s+[A-Za-z0-9\[(]|\s*$)"), F.lit(1))
    every = text.rlike(r"(?m)(?:^|\s)A\s+B\s+C\s+D(?:\s|$)") | text.rlike(r"(?i)responses\s+A\s+to\s+D")
    ends = lambda c: text.rlike(rf"(?m)(?:^|\s){c}(?:\s|$|[→\-=])")
    return ends("A") & ends("D") & (every | (F.size(F.array_distinct(F.concat(starts, in_row))) == 4))


def choice_clips(words: DataFrame, pages: DataFrame, drawings: DataFrame) -> DataFrame:
    """(doc, page, question, band, x0, y0, x1, y1) of multiple-choice papers: a question's band and, for statement questions without a key of
    their own, the shared key as a second band. What doesn't show A to D in the end is no clip; the first that does wins."""
    # what several steps read is written once; as one plan it would be found anew for each, and outgrow the driver
    marks = kept(openers(words), "marks")
    bands = first_bands(marks, words, pages, drawings)
    keys = [*PAGE, "question"]
    told = band_texts(bands, words, keys)
    good = told.filter(shows_question(F.col("question"), F.col("lines")) & ~opens_next(F.col("question"), F.col("text")))
    good = kept(good.withColumn("asks", statements(F.col("question"), F.col("text")) & ~F.col("text").rlike(HAS_KEY)), "good")
    shared = kept(keys_for(good.filter("asks"), key_regions(words, pages), marks), "shared")
    found = good.join(shared.select("doc", "question", F.col("own").alias("page"), F.lit(True).alias("shared")).hint("merge"), keys, "left")
    whole = F.when(F.col("asks"), F.coalesce("shared", F.lit(False))).otherwise(letters_shown(F.col("text")))
    w = Window.partitionBy("doc", "question").orderBy("page")
    first = found.filter(whole).withColumn("nth", F.row_number().over(w)).filter("nth = 1")
    box = [*PAGE, "question", "x0", "y0", "x1", "y1"]
    taken = shared.join(first.filter("asks").select("doc", "question", F.col("page").alias("own")).hint("merge"), ["doc", "question", "own"], "left_semi")
    return first.select(*box, F.lit(1).alias("band")).unionByName(taken.select(*box, F.lit(2).alias("band"))).select(BAND)


# ---------------------------------------------------------------- parts and rows of mark schemes

ROMAN = r"(?i)^\((?:iv|ix|vi{0,3}|iii|ii|i|v|x)\)$"


def part_events(words: DataFrame, marks: DataFrame, most_left: float = 120.0) -> DataFrame:
    """(doc, page, y, question, letter, roman, kind): everything that bounds a part, in order: openers of questions (at the top of their clips),
    letters, romans, and what else ends a question (stop).

    A mark belongs to the question that opened last before it, a roman to the letter before it in its question."""
    first = marks.withColumn("nth", F.row_number().over(Window.partitionBy("doc", "question").orderBy("page", "y"))).filter("nth = 1")
    none, number = F.lit(None).cast("string"), F.lit(None).cast("int")
    opens = first.select(*PAGE, F.greatest(F.lit(0.0), F.col("y") - 4).alias("y"), F.lit(0).alias("at"), "question", none.alias("token"))
    stops = page_stops(words).select(*PAGE, "y", F.lit(1).alias("at"), number.alias("question"), none.alias("token"))
    token = words.filter(F.col("text").rlike(r"(?i)^\((?:[a-z]|[ivx]+)\)$") & (F.col("x0") <= most_left))
    seen = token.select(*PAGE, F.col("y0").alias("y"), F.when(F.col("text").rlike(ROMAN), 3).otherwise(2).alias("at"), number.alias("question"), F.lower("text").alias("token")).distinct()
    order = ["page", "y", "at", "token"]
    rows = opens.unionByName(stops).unionByName(seen)
    rows = rows.withColumn("own", F.last("question", ignorenulls=True).over(Window.partitionBy("doc").orderBy(*order))).filter("own is not null")
    inner = F.btrim("token", F.lit("()"))
    letter = F.when(F.col("at") == 2, F.when(F.length(inner) == 1, inner))
    rows = rows.withColumn("here", letter).withColumn("letter", F.last("here", ignorenulls=True).over(Window.partitionBy("doc", "own").orderBy(*order)))
    kind = F.when(F.col("at") == 0, "question").when(F.col("at") == 1, "stop").when(F.col("here").isNotNull(), "letter").when((F.col("at") == 3) & F.col("letter").isNotNull(), "roman")
    marked = F.col("kind").isin("letter", "roman")
    return rows.withColumn("kind", kind).filter("kind is not null").select(*PAGE, "y", "at", F.col("own").alias("question"), F.when(marked, F.col("letter")).alias("letter"), F.when(F.col("kind") == "roman", inner).alias("roman"), "kind")


def spread(spans: DataFrame, pages: DataFrame, keys: list[str], least: float = 6.0) -> DataFrame:
    """Spans (keys, p0, y0, p1, y1) as bands, one a page: from the start down to the margin, whole pages, and from the top down to the end.

    A last page on which less than 10 would be left, and a span without height, give none."""
    some = spans.filter((F.col("p1") > F.col("p0")) | ((F.col("p1") == F.col("p0")) & (F.col("y1") > F.col("y0") + least)))
    each = some.withColumn("page", F.explode(F.sequence("p0", "p1"))).join(merged_with(pages.select(*PAGE, "right", "bottom")), PAGE)
    first, last = F.col("page") == F.col("p0"), F.col("page") == F.col("p1")
    top = F.when(first, F.greatest(F.lit(0.0), F.col("y0"))).otherwise(TOP)
    end = F.when(last, F.least(F.col("bottom") - 20, F.col("y1"))).otherwise(F.col("bottom") - FOOT)
    bands = each.filter(first | ~last | (F.col("y1") > TOP + 10))
    return bands.select(*keys, "page", F.lit(LEFT).alias("x0"), top.alias("top"), (F.col("right") - RIGHT_INSET).alias("x1"), end.alias("y1")).withColumnRenamed("top", "y0")


def merged(bands: DataFrame, keys: list[str], gap: float = JOINED) -> DataFrame:
    """Bands of a page that touch or are at most gap apart as one: islands under the running lower end."""
    w = Window.partitionBy(*keys, "page").orderBy("y0", "y1")
    low = F.max("y1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = bands.withColumn("island", F.coalesce(F.col("y0") > low + gap, F.lit(True)).cast("int")).withColumn("island", F.sum("island").over(w))
    return rows.groupBy(*keys, "page", "island").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).drop("island")


def part_clips(words: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc, label, page, band, x0, y0, x1, y1): the bands of every smallest part of structured papers: the question's stem, the preamble of its
    letter and its own text up to the next event of any kind."""
    c = F.col
    w = Window.partitionBy("doc").orderBy("page", "y", "at", c("letter").asc_nulls_first(), c("roman").asc_nulls_first())
    ends = pages.groupBy("doc").agg(F.max(F.struct("page", (c("bottom") - LAST_LINE + 2).alias("y"))).alias("end"))  # 2 are taken off again below
    events = kept(part_events(words, openers(words)), "events").join(merged_with(ends), "doc").withColumn("stop", F.coalesce(F.lead(F.struct("page", "y")).over(w), c("end")))
    inside, by_letter, place = Window.partitionBy("doc", "question"), Window.partitionBy("doc", "question", "letter"), F.struct("page", "y")
    events = (
        events.withColumn("opened", F.min(F.when(c("kind") == "question", place)).over(inside))
        .withColumn("first", F.min(F.when(c("letter").isNotNull(), place)).over(inside))
        .withColumn("lettered", F.min(F.when(c("kind") == "letter", place)).over(by_letter))
        .withColumn("first_roman", F.min(F.when(c("kind") == "roman", place)).over(by_letter))
    )
    leaves = events.filter((c("kind") == "roman") | ((c("kind") == "letter") & c("first_roman").isNull()))
    label = F.concat(c("question").cast("string"), F.lit("("), "letter", F.lit(")"), F.coalesce(F.concat(F.lit("("), "roman", F.lit(")")), F.lit("")))
    # a label that occurs again is the same part: its last place counts
    leaves = leaves.withColumn("label", label).withColumn("nth", F.row_number().over(Window.partitionBy("doc", "label").orderBy(F.desc("page"), F.desc("y")))).filter("nth = 1")

    def span(start: Column, above: float, end: Column) -> Column:
        return F.struct(start["page"].alias("p0"), F.greatest(F.lit(0.0), start["y"] - above).alias("y0"), end["page"].alias("p1"), (end["y"] - 2).alias("y1"))

    late = (c("first_roman.page") > c("lettered.page")) | (c("first_roman.y") > c("lettered.y") + 8)
    stem, own = span(c("opened"), 0.0, c("first")), span(place, 2.0, c("stop"))
    preamble = F.when((c("kind") == "roman") & late, span(c("lettered"), 2.0, c("first_roman")))
    keys = ["doc", "label"]
    spans = leaves.select(*keys, F.explode(F.array_compact(F.array(stem, preamble, own))).alias("s")).select(*keys, "s.*")
    return numbered_bands(merged(spread(kept(spans, "spans"), pages, keys), keys), keys).select("doc", "label", "page", "band", "x0", "y0", "x1", "y1")


def upright(words: DataFrame, pages: DataFrame) -> DataFrame:
    """Words of turned pages in the page as it is seen: pages carry the matrix (a, b, c, d, e, f) of their rotation, null for none."""
    m = pages.select(*PAGE, "matrix")
    at = lambda x, y: (F.col("matrix.a") * F.col(x) + F.col("matrix.c") * F.col(y) + F.col("matrix.e"), F.col("matrix.b") * F.col(x) + F.col("matrix.d") * F.col(y) + F.col("matrix.f"))
    (ax, ay), (bx, by) = at("x0", "y0"), at("x1", "y1")
    turned = {"x0": F.least(ax, bx), "y0": F.least(ay, by), "x1": F.greatest(ax, bx), "y1": F.greatest(ay, by)}
    rest = [c for c in words.columns if c not in turned]
    return words.join(m, PAGE, "left").select(*rest, *[F.when(F.col("matrix").isNotNull(), v).otherwise(F.col(k)).alias(k) for k, v in turned.items()]).select(words.columns)


def scheme_rows(words: DataFrame, pages: DataFrame, header: float = 52.0) -> DataFrame:
    """(doc, label, page, x0, y0, x1, y1): the row of each part label of a mark scheme's table, down to the next label; the first of a page has
    the table's head with it. The last page that has a label counts."""
    found = words.filter(F.trim("text").rlike(r"(?i)^\d{1,2}\([a-z]\)(?:\([ivx]+\))?$"))
    tops = found.groupBy(*PAGE, F.lower(F.trim("text")).alias("label")).agg(F.min("y0").alias("y"))
    w = Window.partitionBy(*PAGE).orderBy("y", "label")
    rows = tops.join(merged_with(pages.select(*PAGE, "right", "bottom")), PAGE).withColumn("top", F.when(F.row_number().over(w) == 1, header).otherwise(F.col("y"))).withColumn("end", F.coalesce(F.lead("y").over(w), F.col("bottom") - 28))
    low = F.when(F.col("end") <= F.col("top") + 12, F.least(F.col("bottom") - 20, F.col("top") + 36)).otherwise(F.col("end"))
    last = Window.partitionBy("doc", "label").orderBy(F.desc("page"))
    out = rows.select("doc", "label", "page", F.lit(36.0).alias("x0"), F.greatest(F.lit(0.0), F.col("top")).alias("y0"), (F.col("right") - RIGHT_INSET).alias("x1"), F.least("bottom", low).alias("y1"))
    return out.withColumn("nth", F.row_number().over(last)).filter("nth = 1").drop("nth")


def scheme_clips(rows: DataFrame) -> DataFrame:
    """The rows of a question's parts as the bands of the question: (doc, question, page, band, x0, y0, x1, y1)."""
    own = rows.withColumn("question", F.regexp_extract("label", r"^(\d+)", 1).cast("int"))
    return own.withColumn("band", F.row_number().over(Window.partitionBy("doc", "question").orderBy("page", "y0", "x0"))).select("doc", "question", "page", "band", "x0", "y0", "x1", "y1")
