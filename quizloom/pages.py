"""Queries over pages that are composed of the driver's tables: numbered lines, words with boxes, clips.

As in papers.py the SQL states what was composed, so it computes places and never parses.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import papers
from .composed import joined, said
from .functions import text
from .operators import clips, enrich, export, geometry, split, staging, symbols, tagging
from .queries import long, query, table
from .sources import store

# ---------------------------------------------------------------- multiple-choice papers with false numbers

#: A line that counts as the start of a later question: k + 2 in a sentence, k + 1 in two long words; the others are no starts.
FALSE_STARTS = {
    0: (1, "Zinc oxide forms"), 1: (2, "Solids melt when they are heated"), 2: (1, "Orderspricedwithoutanydiscountatallthisyear now"),
    3: (1, "9 Brominewateroxidisesthemallinthecoldatonce"), 4: (1, "hours"),
}
FORTY_SQL = "SELECT o_custkey * 10000 + (r - 1) // 40 AS doc, (r - 1) % 40 + 1 AS k, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders)"


def forty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as the questions k of papers of up to 40."""
    r = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = table(spark, sf_dir, "orders").withColumn("r", r)
    return rows.select((F.col("o_custkey") * 10000 + F.floor((F.col("r") - 1) / 40)).alias("doc"), ((F.col("r") - 1) % 40 + 1).alias("k"), "o_orderkey")


@query(f"""WITH RECURSIVE o AS ({FORTY_SQL}),
slots AS (SELECT doc, k, 0 AS slot, NULL AS num, NULL AS class, 1 AS lines FROM o WHERE k % 8 = 1
    UNION ALL SELECT doc, k, 1, k, CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END, 1 FROM o WHERE k % 11 <> 9
    UNION ALL SELECT doc, k, 2, NULL, NULL, 1 FROM o WHERE k % 5 = 0 AND k % 11 <> 9
    UNION ALL SELECT doc, k, 3, NULL, NULL, 2 FROM o
    UNION ALL SELECT doc, k, 4, CASE o_orderkey % 6 WHEN 1 THEN k + 2 WHEN 2 THEN k + 1 END, CASE o_orderkey % 6 WHEN 1 THEN 0 WHEN 2 THEN 1 END, 1 FROM o WHERE o_orderkey % 6 < 5),
lines AS (SELECT *, 2 + sum(lines) OVER (PARTITION BY doc ORDER BY k, slot) - lines AS line FROM slots),
pick(doc, num, last, taken) AS (SELECT DISTINCT doc, 0, 0::HUGEINT, false FROM o
    UNION ALL SELECT p.doc, p.num + 1, coalesce(min(l.class * 1000000 + l.line) % 1000000, any_value(p.last)), count(l.line) > 0 FROM pick p LEFT JOIN lines l ON l.doc = p.doc AND l.num = p.num + 1 AND l.line > p.last WHERE p.num < 40 GROUP BY p.doc, p.num)
SELECT p.doc, CAST(p.num AS VARCHAR) AS question, row_number() OVER (PARTITION BY p.doc ORDER BY p.num) AS ord, CAST(p.last AS BIGINT) AS start_line, CAST((l.k - 1) // 8 + 1 AS BIGINT) AS page, l.k = p.num AS true_start
FROM pick p JOIN lines l ON l.doc = p.doc AND l.line = p.last AND l.num IS NOT NULL WHERE taken""")
def best_scored_questions(spark, sf_dir):
    k, i = F.col("k"), F.col("o_orderkey")
    page = F.when(k % 8 == 1, said("----- PAGE ", F.floor((k - 1) / 8) + 1, " -----\n")).otherwise("")
    own = F.when(k % 11 == 9, "").when(k % 5 == 0, said(k, "\nExplain the price of order ", i, ".\n")).otherwise(said(k, " Which order has the number ", i, " here?\n"))
    false = F.coalesce(*[F.when(i % 6 == n, said("\n", k + by, " ", words)) for n, (by, words) in FALSE_STARTS.items()], F.lit(""))
    body = said(page, own, "A one\nB two", false)
    docs = forty(spark, sf_dir).groupBy("doc").agg(said("Paper 1 Multiple Choice\n", joined(F.struct("k", body.alias("text")))).alias("text"))
    found = split.questions(docs)
    true_start = F.col("text").rlike(r"^\d+( Which order|\s+Explain the)")
    return found.select("doc", "question", long(F.col("ord")).alias("ord"), long(F.col("start_line")).alias("start_line"), long(F.col("page")).alias("page"), true_start.alias("true_start"))


# ---------------------------------------------------------------- structured papers as words in boxes

RIGHT, BOTTOM = 595.0, 842.0


def spread_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts, dealt over the tasks: a file of one row group is read by one task, and each row stands for a page or a text here."""
    return table(spark, sf_dir, "part").repartition("p_partkey")


#: A question k of a paper opens at 80 or, where k is even, at 400 of the page on which the one before ends; it goes on for up to two pages.
LAID_SQL = f"""o AS ({FORTY_SQL}), laid AS (SELECT *, o_orderkey % 3 AS extra, CASE WHEN k % 2 = 1 THEN 80 ELSE 400 END AS y, o_orderkey % 10 <> 0 AS has_a, o_orderkey % 13 = 5 AS false_next,
    CAST(1 + (k - 1) // 2 + coalesce(sum(o_orderkey % 3) OVER (PARTITION BY doc ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS page,
    CASE WHEN max(k) OVER (PARTITION BY doc) = k THEN 'end' WHEN k % 2 = 1 THEN 'same' ELSE 'page' END AS after FROM o)"""


def laid(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, extra = F.col("k"), F.col("o_orderkey") % 3
    before = F.sum(extra).over(Window.partitionBy("doc").orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
    page = (1 + F.floor((k - 1) / 2) + F.coalesce(before, F.lit(0))).cast("int")
    return forty(spark, sf_dir).select("*", extra.cast("int").alias("extra"), F.when(k % 2 == 1, 80).otherwise(400).alias("y"), page.alias("page"))


def boxes(*words) -> "list":
    """Structs (page, x0, y0, x1, y1, text) of (page, x, y, text, condition) words, null where the condition fails."""
    out = []
    for page, x, y, word, *when in words:
        value = F.struct(
            (F.lit(page) if isinstance(page, int) else page).cast("int").alias("page"), F.lit(float(x)).alias("x0"), (F.lit(y) if isinstance(y, int) else y).cast("double").alias("y0"), F.lit(x + 8.0).alias("x1"),
            ((F.lit(y) if isinstance(y, int) else y) + 10).cast("double").alias("y1"), (F.lit(word) if isinstance(word, str) else word.cast("string")).alias("text"),
        )
        out.append(F.when(when[0], value) if when else value)
    return out


def as_words(rows: DataFrame, words: list) -> DataFrame:
    return rows.select("doc", F.explode(F.array_compact(F.array(*words))).alias("w")).select("doc", "w.*")


def composed(words: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words, pages and no drawings, composed once: the operators read them many times."""
    words, pages = store.kept(words, "words"), store.kept(pages, "pages")
    return words, pages, words.select("doc", "page", "x0", "y0", "x1", "y1").limit(0)


def structured_words(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words, pages and no drawings of papers with far-left digits, feet, a trailer and a blank last page."""
    rows = laid(spark, sf_dir)
    page, y, i, k = F.col("page"), F.col("y"), F.col("o_orderkey"), F.col("k")
    has_a, one, two = i % 10 != 0, F.col("extra") >= 1, F.col("extra") == 2
    own = as_words(rows, boxes(
        (page, 50, y, k), (page, 70, y, "Explain"), (page, 130, y, "order"), (page, 200, y, i),
        (page, 70, y + 20, "(a)", has_a), (page, 100, y + 20, "State", has_a), (page, 100, y + 40 + i % 50, "content", has_a),
        (page, 71, y + 95, k + 1, i % 13 == 5), (page, 100, y + 95, "Calcium", i % 13 == 5),
        (page + 1, 70, 120, "(b)", one), (page + 1, 90, 150, "(i)", one), (page + 1, 110, 150, "Give", one), (page + 1, 90, 240, "(ii)", one), (page + 1, 100, 260 + i % 40, "more", one),
        (page + 2, 70, 120, "(c)", two), (page + 2, 100, 200 + i % 40, "more", two),
    ))
    ends = rows.groupBy("doc").agg(F.max(page + F.col("extra")).alias("page"))
    every = ends.select("doc", F.explode(F.sequence(F.lit(1), F.col("page") + 1)).alias("page"))
    feet = as_words(every, boxes((page, 20, 300, "5"), (page, 300, 780, "UCLES")))
    last = as_words(ends, boxes((page, 60, 600, "Permission"), (page, 120, 600, "reproduce"), (page + 1, 250, 400, "BLANK"), (page + 1, 300, 400, "PAGE")))
    words = own.unionByName(feet).unionByName(last)
    pages = every.select("doc", "page", F.lit(RIGHT).alias("right"), F.lit(BOTTOM).alias("bottom"))
    return composed(words, pages)


def placed(clips: DataFrame, *keys: str) -> DataFrame:
    return clips.select("doc", *keys, long(F.col("page")).alias("page"), long(F.col("band")).alias("band"), "x0", "y0", "x1", "y1")


@query(f"""WITH {LAID_SQL}, good AS (SELECT * FROM laid WHERE NOT (NOT has_a AND NOT false_next AND k <= 30) AND NOT (false_next AND k < 40)),
bands AS (SELECT doc, k, page, y - 4 AS y0, greatest(y + 34, CASE WHEN false_next THEN y + 105 WHEN has_a THEN y + 50 + o_orderkey % 50 ELSE y + 10 END) + 10 AS y1 FROM good
    UNION ALL SELECT doc, k, page + 1, 48, 280 + o_orderkey % 40 FROM good WHERE extra >= 1
    UNION ALL SELECT doc, k, page + 2, 48, 220 + o_orderkey % 40 FROM good WHERE extra = 2)
SELECT doc, CAST(k AS INTEGER) AS question, CAST(page AS BIGINT) AS page, row_number() OVER (PARTITION BY doc, k ORDER BY page) AS band, CAST(40 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(563 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1 FROM bands""")
def question_clips(spark, sf_dir):
    return placed(clips.structured_clips(*structured_words(spark, sf_dir)), "question")


#: Stems, and tails of the last part of a question: to the next opener on its page, or over the page's end to the one on the next.
STEM_BANDS = "SELECT doc, k, '{label}' AS part, page, y - 4 AS y0, CASE WHEN has_a THEN y + 18 ELSE 806 END AS y1 FROM laid WHERE {when}"
TAIL_BANDS = "SELECT doc, k, '{label}', page + {p}, {top}, CASE WHEN after = 'same' THEN 394 ELSE 806 END FROM laid WHERE {when} UNION ALL SELECT doc, k, '{label}', page + {p} + 1, 48, 74 FROM laid WHERE {when} AND after = 'page'"
PART_BANDS = " UNION ALL ".join([
    TAIL_BANDS.format(label="(a)", p=0, top="y - 4", when="has_a AND extra = 0"),
    "SELECT doc, k, '(a)', page, y - 4, 806 FROM laid WHERE has_a AND extra > 0", "SELECT doc, k, '(a)', page + 1, 48, 118 FROM laid WHERE has_a AND extra > 0",
    STEM_BANDS.format(label="(b)(i)", when="extra > 0"), "SELECT doc, k, '(b)(i)', page + 1, CASE WHEN has_a THEN 118 ELSE 48 END, 238 FROM laid WHERE extra > 0",
    STEM_BANDS.format(label="(b)(ii)", when="extra > 0"), "SELECT doc, k, '(b)(ii)', page + 1, CASE WHEN has_a THEN 118 ELSE 48 END, 148 FROM laid WHERE extra > 0",
    TAIL_BANDS.format(label="(b)(ii)", p=1, top=238, when="extra = 1"),
    "SELECT doc, k, '(b)(ii)', page + 1, 238, 806 FROM laid WHERE extra = 2", "SELECT doc, k, '(b)(ii)', page + 2, 48, 118 FROM laid WHERE extra = 2",
    STEM_BANDS.format(label="(c)", when="extra = 2"), "SELECT doc, k, '(c)', page + 1, 48, 118 FROM laid WHERE extra = 2 AND NOT has_a", TAIL_BANDS.format(label="(c)", p=2, top=118, when="extra = 2"),
])


@query(f"""WITH {LAID_SQL}, bands(doc, k, part, page, y0, y1) AS ({PART_BANDS})
SELECT doc, k || part AS label, CAST(page AS BIGINT) AS page, row_number() OVER (PARTITION BY doc, k, part ORDER BY page, y0) AS band, CAST(40 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(563 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1 FROM bands""")
def question_part_clips(spark, sf_dir):
    words, pages, _ = structured_words(spark, sf_dir)
    return placed(clips.part_clips(words, pages), "label")


# ---------------------------------------------------------------- multiple-choice papers with shared keys

#: Questions 27 to 40, four a page; from 31 on they ask for statements. Keys stand on top of page 2 (variant 0), or twice on page 3 (variant 1).
CHOICES_SQL = """o AS (SELECT o_custkey * 10000 + (r - 1) // 14 AS doc, (r - 1) % 14 + 1 AS k, o_custkey % 3 AS variant, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders)),
q AS (SELECT *, k + 26 AS question, (k - 1) // 4 + 1 AS page, 200 + 120 * ((k - 1) % 4) AS y, max(k) OVER (PARTITION BY doc) AS most, max(k) OVER (PARTITION BY doc, (k - 1) // 4) = k AS last FROM o)"""
KEY_TOPS = {0: [(2, 20, 5)], 1: [(3, 20, 9), (3, 700, 9)]}  #: (page, y, questions that the paper must have)


def choice_words(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    r = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = table(spark, sf_dir, "orders").withColumn("r", r)
    rows = rows.select((F.col("o_custkey") * 10000 + F.floor((F.col("r") - 1) / 14)).alias("doc"), ((F.col("r") - 1) % 14 + 1).alias("k"), (F.col("o_custkey") % 3).alias("variant"), "o_orderkey")
    k, i = F.col("k"), F.col("o_orderkey")
    page, y = (F.floor((k - 1) / 4) + 1).cast("int"), 200 + 120 * ((k - 1) % 4)
    ordinary, asks, whole = k <= 4, k > 4, (k <= 4) & (i % 9 != 0)
    options = [(page, x, y + 20, t, whole if t in ("D", "four") else ordinary) for x, t in zip(range(70, 310, 30), ("A", "one", "B", "two", "C", "three", "D", "four"))]
    said_there = [(page, x, y + 20 * n, t, asks) for n, (number, word) in enumerate((("1", "Apples"), ("2", "Bears"), ("3", "Cats")), 1) for x, t in ((71, number), (90, word))]
    own = as_words(rows, boxes(
        (page, 50, y, k + 26), (page, 70, y, "What", ordinary), (page, 110, y, "is", ordinary), (page, 130, y, "order", ordinary), (page, 180, y, i, ordinary),
        (page, 70, y, "Which", asks), (page, 110, y, "statements", asks), (page, 180, y, "are", asks), (page, 210, y, "correct?", asks), *options, *said_there,
    ))
    papers = rows.groupBy("doc").agg(F.max("k").alias("most"), F.first("variant").alias("variant"))
    block = [("responses", 60, 0), ("A", 120, 0), ("to", 140, 0), ("D", 160, 0), *[(t, 60 + 100 * n, 15) for n, t in enumerate("ABCD")], ("1,", 60, 30), ("2", 80, 30), ("and", 100, 30), ("3", 130, 30),
             *[(t, 60 + 40 * n, 50) for n, t in enumerate("No other combination of statements is used as a correct response.".split())]]
    keyed = [(at, x, top + dy, t, (F.col("variant") == v) & (F.col("most") >= need)) for v, tops in KEY_TOPS.items() for at, top, need in tops for t, x, dy in block]
    words = own.unionByName(as_words(papers, boxes(*keyed)))
    pages = papers.select("doc", F.explode(F.sequence(F.lit(1), ((F.col("most") - 1) / 4 + 1).cast("int"))).alias("page"), F.lit(RIGHT).alias("right"), F.lit(BOTTOM).alias("bottom"))
    return composed(words, pages)


@query(f"""WITH {CHOICES_SQL},
keys AS (SELECT *, CASE WHEN k <= 4 THEN NULL WHEN variant = 0 AND page <= 4 THEN 2 WHEN variant = 1 AND most >= 9 AND (k = 8 OR page IN (3, 4) AND NOT (page = 3 AND last)) THEN 3 END AS key_page,
    CASE WHEN variant = 0 OR k = 8 THEN 18 ELSE 698 END AS key_top, variant = 1 AND page = 3 AND last AS own_key FROM q),
bands AS (SELECT doc, question, 1 AS band, page, y - 4 AS y0, CASE WHEN k <= 4 THEN y + 44 WHEN own_key THEN 770 ELSE y + 80 END AS y1 FROM keys WHERE CASE WHEN k <= 4 THEN o_orderkey % 9 <> 0 ELSE own_key OR key_page IS NOT NULL END
    UNION ALL SELECT doc, question, 2, key_page, key_top, key_top + 70 FROM keys WHERE key_page IS NOT NULL AND NOT own_key)
SELECT doc, CAST(question AS INTEGER) AS question, CAST(page AS BIGINT) AS page, CAST(band AS BIGINT) AS band, CAST(40 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(563 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1 FROM bands""")
def choice_question_clips(spark, sf_dir):
    return placed(clips.choice_clips(*choice_words(spark, sf_dir)), "question")


# ---------------------------------------------------------------- gates of clips

CLIP_TEXTS = {  # by p_size % 9, with the number q and the next one n
    0: ("q", " Explain the part here\nmore about it\nA or B"), 1: ("Permission to reproduce\nq", " Explain it\nline two\nline three"), 2: ("n", " Calcium burns\nin air\nand so on"),
    3: ("q", " Calcium reacts with water fast"), 4: ("", ""), 5: ("q", " Explain it now\nmore text here\nand more\nn Calcium burns"), 6: ("q", " Which statements are correct?\n1 Apples\nn Calcium is\nresponses A to D"),
    7: ("q", " Which statements are correct?\n1 Apples\nn Calcium is\nresponses A to D\nn Carbon is"), 8: ("q", " Explain it now\nmore text here\nand more\nn Figure shows"),
}


@query("SELECT p_partkey, p_size % 9 IN (0, 1, 5, 6, 7, 8) AS shows, p_size % 9 IN (2, 5, 7) AS bleeds FROM part")
def clip_gates(spark, sf_dir):
    q = F.col("p_partkey") % 30 + 1
    numbered = lambda t: F.replace(F.replace(F.lit(t), F.lit("q "), F.concat(q.cast("string"), F.lit(" "))), F.lit("n C"), F.concat((q + 1).cast("string"), F.lit(" C")))
    text = F.coalesce(*[F.when(F.col("p_size") % 9 == i, F.replace(numbered(a + b), F.lit("n Figure"), F.concat((q + 1).cast("string"), F.lit(" Figure")))) for i, (a, b) in CLIP_TEXTS.items()])
    rows = table(spark, sf_dir, "part").select("p_partkey", q.alias("question"), text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    return rows.select("p_partkey", clips.shows_question(F.col("question"), lines).alias("shows"), clips.opens_next(F.col("question"), F.col("text")).alias("bleeds"))


AGREE_SQL = """w AS (SELECT doc_id, doc_id // 10 AS doc, doc_id % 10 + 1 AS question, text, list_filter(regexp_extract_all(lower(text), '[a-z]{4,}'), lambda x: x <> 'with') AS a FROM documents),
k AS (SELECT *, list_slice(list_filter(a, lambda x, i: list_position(a, x) = i), 1, 6) AS own FROM w),
l AS (SELECT *, lead(own) OVER s AS next_own, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN ' ' WHEN 2 THEN coalesce(lead(text) OVER s, '') ELSE text || ' ' || coalesce(lead(text) OVER s, '') END AS clip FROM k WINDOW s AS (PARTITION BY doc ORDER BY question)),
h AS (SELECT *, list_filter(next_own, lambda x: NOT list_contains(own, x)) AS later FROM l),
m AS (SELECT doc_id, clip, len(own) AS n_own, coalesce(len(later), 0) AS n_later, len(list_filter(own, lambda x: regexp_matches(lower(clip), '(^|[^\\p{L}\\p{N}_])' || x || '($|[^\\p{L}\\p{N}_])'))) AS hits,
    coalesce(len(list_filter(later, lambda x: regexp_matches(lower(clip), '(^|[^\\p{L}\\p{N}_])' || x || '($|[^\\p{L}\\p{N}_])'))), 0) AS next_hits FROM h)"""


@query(f"""WITH {AGREE_SQL} SELECT doc_id, CAST(hits AS BIGINT) AS hits, CAST(next_hits AS BIGINT) AS next_hits,
    CASE WHEN trim(clip) = '' THEN 'empty' WHEN hits < least(2, n_own) THEN 'foreign' WHEN n_later >= 2 AND next_hits >= 2 THEN 'next' END AS problem FROM m""")
def clip_agreement(spark, sf_dir):
    """Ten documents a paper; clips show the question, nothing, the next question, or both."""
    i = F.col("doc_id")
    questions = table(spark, sf_dir, "documents").select("doc_id", F.floor(i / 10).alias("doc"), (i % 10 + 1).alias("question"), "text")
    following = F.coalesce(F.lead("text").over(Window.partitionBy("doc").orderBy("question")), F.lit(""))
    shown = F.when(i % 4 == 0, F.col("text")).when(i % 4 == 1, " ").when(i % 4 == 2, following).otherwise(F.concat("text", F.lit(" "), following))
    out = clips.agreement(questions.select("doc_id", "doc", "question", shown.alias("text")), questions, ["with"])
    return out.select("doc_id", long(F.col("hits")).alias("hits"), long(F.col("next_hits")).alias("next_hits"), "problem")


# ---------------------------------------------------------------- rows of mark schemes


SCHEME_SQL = """o AS (SELECT o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, o_orderkey FROM orders),
p AS (SELECT doc, CAST((r - 1) // 3 + 1 AS INTEGER) AS page, (r - 1) % 3 AS place, (r - 1) // 2 + 1 AS question, CASE WHEN r % 2 = 1 THEN 'a' ELSE 'b' END AS letter, 100 + 150 * ((r - 1) % 3) + o_orderkey % 40 AS y FROM o),
s AS (SELECT *, lead(y) OVER (PARTITION BY doc, page ORDER BY y) AS below FROM p)"""


def scheme_words(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Three part labels a page of 842 by 595, in turned pages: x and y are those of the sheet before it was turned."""
    r = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), "o_orderkey", r.alias("r"))
    page, y = (F.floor((F.col("r") - 1) / 3) + 1).cast("int"), (100 + 150 * ((F.col("r") - 1) % 3) + F.col("o_orderkey") % 40).cast("double")
    label = F.concat((F.floor((F.col("r") - 1) / 2) + 1).cast("string"), F.when(F.col("r") % 2 == 1, "(a)").otherwise("(b)"))
    # seen at (50, y) to (90, y + 10) once the sheet (x, y) is shown at (842 - y, x)
    seen = rows.select("doc", page.alias("page"), y.alias("x0"), F.lit(752.0).alias("y0"), (y + 10).alias("x1"), F.lit(792.0).alias("y1"), label.alias("text"))
    more = rows.select("doc", page.alias("page"), (y + 12).alias("x0"), F.lit(400.0).alias("y0"), (y + 22).alias("x1"), F.lit(500.0).alias("y1"), F.lit("M1").alias("text"))
    matrix = F.struct(*[F.lit(float(v)).alias(n) for n, v in zip("abcdef", (0, 1, -1, 0, 842, 0))])
    return seen.unionByName(more), rows.select("doc", page.alias("page")).distinct().select("doc", "page", F.lit(842.0).alias("right"), F.lit(595.0).alias("bottom"), matrix.alias("matrix"))


@query(f"""WITH {SCHEME_SQL} SELECT doc, question || '(' || letter || ')' AS label, CAST(page AS BIGINT) AS page, CAST(36 AS DOUBLE) AS x0, CAST(CASE WHEN place = 0 THEN 52 ELSE y END AS DOUBLE) AS y0, CAST(810 AS DOUBLE) AS x1, CAST(coalesce(below, 567) AS DOUBLE) AS y1 FROM s""")
def mark_scheme_rows(spark, sf_dir):
    words, pages = scheme_words(spark, sf_dir)
    return clips.scheme_rows(clips.upright(words, pages), pages).select("doc", "label", long(F.col("page")).alias("page"), "x0", "y0", "x1", "y1")


@query(f"""WITH {SCHEME_SQL} SELECT doc, CAST(question AS INTEGER) AS question, CAST(page AS BIGINT) AS page, row_number() OVER (PARTITION BY doc, question ORDER BY page, y) AS band, CAST(36 AS DOUBLE) AS x0, CAST(CASE WHEN place = 0 THEN 52 ELSE y END AS DOUBLE) AS y0,
    CAST(810 AS DOUBLE) AS x1, CAST(coalesce(below, 567) AS DOUBLE) AS y1 FROM s""")
def mark_scheme_clips(spark, sf_dir):
    words, pages = scheme_words(spark, sf_dir)
    return placed(clips.scheme_clips(clips.scheme_rows(clips.upright(words, pages), pages)), "question")


# ---------------------------------------------------------------- notes of papers, in two versions

#: Twenty documents a paper; every second paper has parts. The papers of one in seven lack a clip once. Run 1 lacks the ids with 2 at the end, run 2 those
#: with 0, and in run 2 those with 1 say something else.
NOTES_SQL = """d AS (SELECT doc_id, doc_id // 20 AS p, doc_id % 20 AS n, doc_id % 10 AS e, (doc_id // 20) % 2 = 1 AS parted, run FROM documents, (SELECT unnest([1, 2]) AS run) r WHERE NOT (run = 1 AND doc_id % 10 = 2) AND NOT (run = 2 AND doc_id % 10 = 0)),
bad AS (SELECT DISTINCT run, p FROM d WHERE p % 7 = 3 AND n = 5), ok AS (SELECT d.* FROM d LEFT JOIN bad ON d.run = bad.run AND d.p = bad.p WHERE bad.p IS NULL),
n AS (SELECT run, 'questions/q' || doc_id || '.md' AS path, 'question' AS kind, CASE WHEN e = 1 THEN run END || '' AS said FROM ok
    UNION ALL SELECT run, 'syllabus/' || (e + 1) || '.1.md', 'code', string_agg('q' || doc_id, ',' ORDER BY 'q' || doc_id) FROM ok GROUP BY run, e
    UNION ALL SELECT DISTINCT run, 'syllabus/' || (e + 1) || '.md', 'code', '' FROM ok
    UNION ALL SELECT run, 'syllabus/lo/' || (e + 1) || '.1-1.md', 'outcome', string_agg('q' || doc_id, ',' ORDER BY 'q' || doc_id) FROM ok GROUP BY run, e
    UNION ALL SELECT run, 'papers/p' || p || '.md', 'paper', string_agg('q' || doc_id, ',' ORDER BY doc_id) FROM ok GROUP BY run, p
    UNION ALL SELECT run, 'questions/p' || p || '-q' || (n // 2 + 1) || '.md', 'index', string_agg('q' || doc_id, ',' ORDER BY doc_id) FROM ok WHERE parted GROUP BY run, p, n // 2)"""


def exported(spark: SparkSession, sf_dir: str, run: int) -> tuple[DataFrame, DataFrame]:
    """The notes of a run and its findings."""
    i, p, n = F.col("doc_id"), F.floor(F.col("doc_id") / 20), F.col("doc_id") % 20
    docs = table(spark, sf_dir, "documents").filter(i % 10 != (2 if run == 1 else 0))
    question = F.when(p % 2 == 1, said(F.floor(n / 2) + 1, F.when(n % 2 == 0, "(a)").otherwise("(b)"))).otherwise(said(n + 1))
    paper, code = said("p", p).alias("paper_id"), said(i % 10 + 1, ".1")
    records = docs.select(
        paper, said("q", i).alias("id"), question.alias("question"), F.when(p % 2 == 1, said(F.floor(n / 2) + 1)).alias("parent_question"),
        F.array(code).alias("syllabus_codes"), F.array(said(code, "-1"), F.lit(" ")).alias("learning_outcomes"),
    )
    text = said("Say ", F.col("lang"), F.when((i % 10 == 1) & F.lit(run == 2), " again").otherwise(""), ".\nSection B\n\n7\nThe rest of it.\nA x B y C z D w\n--- MARK SCHEME ---\nM1 for it")
    drafts = docs.select(paper, export.draft_stem(question).alias("stem"), text.alias("text"))
    clips_of = docs.filter(~((p % 7 == 3) & (n == 5))).select(paper, question.alias("question"), said("assets/q", i, "-paper.png").alias("path"), F.lit(1).alias("ord"))
    more = docs.filter(i % 3 == 0).select(paper, question.alias("question"), said("assets/q", i, "-ms.png").alias("path"), F.lit(2).alias("ord"))
    rows, found = export.whole_papers(store.kept(export.gathered(records, drafts, clips_of.unionByName(more)), "records"))
    rows = store.kept(rows, "whole")
    none = spark.createDataFrame([], "code string, title string, lo_id string, parent_code string, text string")
    return export.notes(rows, none.select("code", "title"), none.select("lo_id", "parent_code", "text"), ["id", "question", "syllabus_codes"]), found


@query(f"""WITH {NOTES_SQL}, a AS (SELECT * FROM n WHERE run = 1), b AS (SELECT * FROM n WHERE run = 2)
SELECT coalesce(b.path, a.path) AS path, coalesce(b.kind, a.kind) AS kind, CASE WHEN b.path IS NULL THEN 'gone' WHEN a.path IS NULL THEN 'new' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.said IS DISTINCT FROM b.said""")
def exported_changes(spark, sf_dir):
    """What the second of two exports writes."""
    root = f"{store.shared_folder(spark)}/quizloom/{uuid.uuid4().hex}/notes"
    store.publish(exported(spark, sf_dir, 1)[0], root)
    return store.publish(exported(spark, sf_dir, 2)[0], root).select("path", "kind", "change")


@query("SELECT 'p' || doc_id // 20 AS paper_id, 'q' || doc_id AS id, 'missing_paper_clip' AS problem FROM documents WHERE (doc_id // 20) % 7 = 3 AND doc_id % 20 = 5")
def export_findings(spark, sf_dir):
    return exported(spark, sf_dir, 1)[1]


# ---------------------------------------------------------------- rules as rows, and the vocabulary rewritten

RULE_ROWS = [  # place, pattern, codes, outcomes, skills, whether it needs an outcome; the vocabulary has no 9.1, 7.7 and 1.1-9
    (0, r"(?i)\blicense\b", "9.1", "9.1-1", "recall", True), (1, r"(?i)\bthat\b.*\bwith\b", "7.7 2.2", "2.2-1 7.7-1", "define draw", True), (2, r"(?i)\bthe\b", "1.1", "1.1-9", "recall", True),
    (3, r"(?i)\bder\b", "3.9 3.3", "", "juggle", False), (4, "[0-9]{3,}", "3.3 1.1", "", "explain", False), (5, r"(?i)\bla\b", "9.9", "", "recall", False), (6, "en", "3.3", "3.3-1", "predict explain", True),
]


@query(f"""WITH r(place, pattern, codes, outcomes, needs) AS (VALUES {", ".join(f"({i}, '{p}', '{c}', '{o}', {n})" for i, p, c, o, _, n in RULE_ROWS)}),
v AS (SELECT list((n_regionkey + 1) || '.' || (n_nationkey + 1)) AS vc, list((n_regionkey + 1) || '.' || (n_nationkey + 1) || '-1') AS vo FROM nation),
k AS (SELECT r.*, list_filter(string_split(codes, ' '), lambda c: list_contains(vc, c)) AS own, list_filter(string_split(outcomes, ' '), lambda o: list_contains(vo, o)) AS los FROM r, v),
g AS (SELECT * FROM k WHERE len(own) > 0 AND (NOT needs OR len(los) > 0)),
m AS (SELECT doc_id, min(place) AS place FROM documents JOIN g ON regexp_matches(text, pattern) GROUP BY doc_id),
d AS (SELECT documents.doc_id, g.place, coalesce(own, ['1']) AS own, coalesce(los, []) AS los FROM documents LEFT JOIN m ON documents.doc_id = m.doc_id LEFT JOIN g ON m.place = g.place)
SELECT doc_id, CAST(place AS INTEGER) AS rule, array_to_string(own, ',') AS codes, CASE WHEN len(los) > 0 THEN array_to_string(los, ',') WHEN place IS NULL THEN NULL ELSE array_to_string(list_transform(own, lambda c: c || '-1'), ',') END AS outcomes,
    CASE place WHEN 1 THEN 'recall,draw' WHEN 4 THEN 'explain' WHEN 6 THEN 'explain' ELSE 'recall' END AS skills FROM d""")
def ruled_tags(spark, sf_dir):
    codes, outcomes = enrich.vocabulary(papers.topics(spark, sf_dir))
    rows = [(i, "body", p, c.split(), o.split(), s.split(), n) for i, p, c, o, s, n in RULE_ROWS]
    records = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("id"), F.col("text").alias("body"))
    out = tagging.tagged(records, spark.createDataFrame(rows, tagging.RULES), codes, outcomes)
    return out.select("doc_id", "rule", F.array_join("syllabus_codes", ",").alias("codes"), F.nullif(F.array_join("learning_outcomes", ","), F.lit("")).alias("outcomes"), F.array_join("skills", ",").alias("skills"))


READ_SQL = """s AS (SELECT (n_regionkey + 1) || '.' || (n_nationkey + 1) AS code, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS num, s_suppkey, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey % 4 <> 3),
o AS (SELECT code, num, 0 AS part, code || '-' || num AS id, 'know ' || s_name AS text FROM s WHERE s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0
    UNION ALL SELECT code, num, p, code || '-' || num || substr('ab', p, 1), CASE WHEN s_suppkey % 5 <> 0 THEN 'know ' || s_name || ' (' || substr('ab', p, 1) || ') ' ELSE '' END || 'part ' || p FROM s, (SELECT unnest([1, 2]) AS p) t WHERE s_suppkey % 3 = 0)"""


def rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as the outcomes that were read of their nation's subtopic: every third has parts, every fifth no text; every fourth nation has none."""
    i = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).filter("n_nationkey % 4 <> 3")
    num = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    parts = F.array(*[F.struct(F.lit(c).alias("letter"), F.lit(f" part  {n}").alias("text")) for n, c in enumerate("ab", 1)])
    found = rows.select(
        said(F.col("n_regionkey") + 1, ".", F.col("n_nationkey") + 1).alias("code"), num.alias("ord"), num.alias("num"), F.when(i % 5 != 0, said("know  ", F.col("s_name"), "\n")).alias("text"),
        F.when(i % 3 == 0, parts).otherwise(F.slice(parts, 1, 0)).alias("parts"),
    )
    return enrich.merged_vocabulary(papers.topics(spark, sf_dir).withColumn("colour", F.concat(F.lit("of "), "title")), found)


@query(f"""WITH {READ_SQL} SELECT 'of ' || r_name AS colour, n_name AS title, o.id, o.text, row_number() OVER (PARTITION BY o.code ORDER BY num, part) AS place
FROM o JOIN nation ON o.code = (n_regionkey + 1) || '.' || (n_nationkey + 1) JOIN region ON n_regionkey = r_regionkey""")
def merged_vocabulary(spark, sf_dir):
    subs = rewritten(spark, sf_dir).select("colour", F.explode("subtopics").alias("s"))
    return subs.select("colour", "s.title", F.posexplode("s.learning_outcomes").alias("at", "o")).select("colour", "title", "o.id", "o.text", long(F.col("at") + 1).alias("place"))


@query(f"WITH {READ_SQL}, n AS (SELECT n_nationkey, (n_regionkey + 1) || '.' || (n_nationkey + 1) AS code FROM nation) SELECT (SELECT count(*) FROM n) AS subtopics, (SELECT count(*) FROM o) AS outcomes, (SELECT count(*) FROM n WHERE code NOT IN (SELECT code FROM o)) AS empty")
def vocabulary_counts(spark, sf_dir):
    return enrich.vocabulary_counts(rewritten(spark, sf_dir))


# ---------------------------------------------------------------- papers through stages

STAGED_PAPERS_SQL = """p AS (SELECT s_suppkey AS i, s_suppkey % 7 NOT IN (3, 5) AS good, s_suppkey % 10 = 1 AS more FROM supplier),
o AS (SELECT i, 'split' AS stage, CASE WHEN good AND more THEN 2 ELSE 1 END AS run, CASE WHEN good THEN 'ok' ELSE 'failed' END AS status, CASE i % 7 WHEN 3 THEN 'no_paper' WHEN 5 THEN 'no_questions' END AS detail, CASE WHEN good AND more THEN 4 WHEN good THEN 3 ELSE 0 END AS n FROM p
    UNION ALL SELECT i, 'marks', CASE WHEN more THEN 2 ELSE 1 END, CASE i % 3 WHEN 0 THEN 'skipped' WHEN 1 THEN 'ok' ELSE 'failed' END, CASE i % 3 WHEN 0 THEN 'no_scheme' WHEN 2 THEN 'no_marks' END, CASE i % 3 WHEN 1 THEN 2 ELSE 0 END FROM p WHERE good
    UNION ALL SELECT i, 'report', CASE WHEN more THEN 2 ELSE 1 END, CASE WHEN i % 2 = 0 THEN 'skipped' WHEN i % 4 = 1 THEN 'ok' ELSE 'failed' END, CASE WHEN i % 2 = 0 THEN 'no_report' WHEN i % 4 = 3 THEN 'no_facts' END, CASE WHEN i % 4 = 1 THEN 1 ELSE 0 END FROM p WHERE good)"""


def staged_papers(spark: SparkSession, sf_dir: str, run: int) -> tuple[DataFrame, DataFrame]:
    i = F.col("s_suppkey")
    paper = "Answer all.\n1 Explain what is meant by this.\n(a) State it.\n(b) Name it.\n2 Describe the other thing here.\n(a) Draw it."
    more = F.when((i % 10 == 1) & F.lit(run == 2), "\n3 Explain the third thing of it.\n(a) Say it.").otherwise("")
    report = "9701 Chemistry June 2021\nPaper 9701/11\nMultiple Choice\nGeneral comments\nQuestion 3 were found to be easy."
    texts = {"qp": F.when(i % 7 == 5, "No questions here.").when(i % 7 != 3, F.concat(F.lit(paper), more)), "ms": F.when(i % 3 == 1, "1(a)\nM1\n2(a)\nA1").when(i % 3 == 2, "nothing"), "er": F.when(i % 4 == 1, report).when(i % 4 == 3, "nothing")}
    rows = table(spark, sf_dir, "supplier").select(said("p", i).alias("paper_id"), *[t.alias(k) for k, t in texts.items()])
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("text")) for k in texts])).alias("d")
    return rows.select("paper_id"), rows.select("paper_id", kinds).select("paper_id", "d.kind", "d.text").filter("text is not null")


@query(f"WITH {STAGED_PAPERS_SQL} SELECT 'p' || i AS paper_id, stage, run, status, detail, CAST(n AS BIGINT) AS n FROM o")
def staged_outcomes(spark, sf_dir):
    """Two runs; the second does only what changed."""
    root = f"{store.shared_folder(spark)}/quizloom/{uuid.uuid4().hex}/papers"
    staging.run(spark, root, *staged_papers(spark, sf_dir, 1))
    return staging.run(spark, root, *staged_papers(spark, sf_dir, 2)).select("paper_id", "stage", "run", "status", "detail", "n")


# ---------------------------------------------------------------- drawn symbols

SIGNS_SQL = """p AS (SELECT p_partkey AS doc, p_size % 5 AS v, p_partkey % 3 AS a, 200 + p_size AS x FROM part),
s AS (SELECT *, x + CASE WHEN v = 4 THEN 22 ELSE 18 END AS x1, 'ΔH' || CASE WHEN v = 4 THEN substr('₁₂₃', CAST(doc % 3 AS INTEGER) + 1, 1) ELSE '' END || '⦵' AS text FROM p WHERE v IN (0, 4))"""


def drawn(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Strokes, glyphs and texts of one page a part: signs (variants 0 and 4) and what is none: no bar, too few strokes, two groups."""
    v, x, rows = F.col("p_size") % 5, (200 + F.col("p_size")).cast("double"), spread_parts(spark, sf_dir)
    shift = F.when(v == 3, 10.0).otherwise(0.0)
    stroke = lambda n, x0, y0, x1, y1, when=None: F.when(F.lit(True) if when is None else when, F.struct(F.lit(n).alias("ord"), (x + x0).alias("x0"), F.lit(100.0 + y0).alias("y0"), (x + x1).alias("x1"), (F.lit(100.0) + y1).alias("y1")))
    strokes = F.array_compact(F.array(
        stroke(1, 0.0, 0.0, 6.0, F.lit(8.0)), stroke(2, 7.0 + shift, 0.0, 13.0 + shift, F.lit(8.0)), stroke(3, 14.0 + shift, 4.0, 18.0 + shift, F.when(v == 1, 6.0).otherwise(4.6)), stroke(4, 14.5 + shift, 1.0, 17.0 + shift, F.lit(3.5), v != 2),
        stroke(5, 19.0, 3.0, 22.0, F.lit(8.0), v == 4), stroke(6, -150.0, 20.0, 50.0, F.lit(20.5)), stroke(7, 40.0, 4.0, 40.3, F.lit(4.3)),
    ))
    page = [F.col("p_partkey").alias("doc"), F.lit(1).alias("page")]
    drawn_rows = rows.select(*page, F.explode(strokes).alias("s")).select("doc", "page", "s.*")
    glyphs = rows.filter(v == 4).select(*page, F.lit(5).alias("ord"), (F.col("p_partkey") % 3 + 1).cast("string").alias("char"))
    a = F.col("p_partkey") % 3
    token = lambda x0, x1, text: F.struct(x0.cast("double").alias("x0"), F.lit(114.0).alias("y0"), x1.cast("double").alias("x1"), F.lit(124.0).alias("y1"), text.alias("text"))
    left_end = F.when(a == 1, x + 9).otherwise(F.lit(130.0))
    texts = F.array(token(F.lit(100.0), left_end, F.when(a == 0, "carbon").otherwise("C(s)")), token(F.when(a == 1, x + 14).otherwise(F.lit(300.0)), F.lit(340.0), F.lit("CO2(g)")))
    return drawn_rows, glyphs, rows.select(*page, F.explode(texts).alias("t")).select("doc", "page", "t.*", F.lit("text").alias("kind"))


@query(f"WITH {SIGNS_SQL} SELECT doc, CAST(x AS DOUBLE) AS x0, CAST(100 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(108 AS DOUBLE) AS y1, text FROM s")
def enthalpy_signs(spark, sf_dir):
    strokes, glyphs, _ = drawn(spark, sf_dir)
    return symbols.enthalpy_signs(strokes, glyphs).select("doc", "x0", "y0", "x1", "y1", "text")


@query(f"""WITH {SIGNS_SQL} SELECT doc, 'sign' AS what, CAST(CASE WHEN a = 2 THEN 215 - (x1 - x) / 2 ELSE x END AS DOUBLE) AS x0, CAST(CASE WHEN a = 2 THEN 112 ELSE 100 END AS DOUBLE) AS y0, CAST(CASE WHEN a = 2 THEN 233 - (x1 - x) / 2 ELSE x1 END AS DOUBLE) AS x1, CAST(CASE WHEN a = 2 THEN 124 ELSE 108 END AS DOUBLE) AS y1 FROM s
UNION ALL SELECT doc, 'arrow', 211, 114, 219, 124 FROM s WHERE a = 2""")
def reaction_arrows(spark, sf_dir):
    strokes, glyphs, texts = drawn(spark, sf_dir)
    both = symbols.arrows_and_symbols(texts.unionByName(symbols.enthalpy_signs(strokes, glyphs)))
    return both.select("doc", "x0", "y0", "x1", "y1", F.when(F.col("kind") == "symbol", "sign").otherwise("arrow").alias("what"))


@query(f"""WITH {SIGNS_SQL}, t AS (SELECT p.doc, p.a, s.text AS sign FROM p LEFT JOIN s ON p.doc = s.doc)
SELECT doc, CASE WHEN a = 0 THEN 'carbon' ELSE 'C(s)' END || CASE WHEN a = 2 AND sign IS NOT NULL THEN ' ' || sign || '→' ELSE '' END || ' CO2(g)' AS line FROM t""")
def lines_with_symbols(spark, sf_dir):
    """The line of a reaction as it reads with its sign and arrow."""
    strokes, glyphs, texts = drawn(spark, sf_dir)
    tokens = symbols.with_symbols(texts, strokes, glyphs).withColumn("doc", F.col("doc").cast("string")).withColumn("ord", F.monotonically_increasing_id())
    lines = geometry.page_lines(tokens).filter(F.contains("text", F.lit("CO2(g)")))
    return lines.select(long(F.col("doc")).alias("doc"), F.col("text").alias("line"))


# ---------------------------------------------------------------- spans, boxes and lettering

LETTERING_SQL = "['" + "','".join(text.SYMBOLS) + "']"


@query(f"""WITH t AS (SELECT p_partkey, p_size, ({LETTERING_SQL})[CAST(p_partkey % 14 AS INTEGER) + 1] AS a, ({LETTERING_SQL})[p_size % 14 + 1] AS b FROM part)
SELECT p_partkey, a || ' ' || b || CASE WHEN p_size % 8 = 4 THEN '−' ELSE '' END || CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN ' =' WHEN 2 THEN ' water' ELSE ' OH' END AS line, CASE p_size % 4 WHEN 2 THEN false WHEN 0 THEN p_size % 8 = 4 AND length(b) = 2 AND a <> 'C' ELSE true END AS salad FROM t""")
def lettered_lines(spark, sf_dir):
    """Two symbols, the second perhaps charged, with nothing, a bond, a word or another one behind them."""
    s = F.col("p_size")
    symbol = lambda n: F.get(F.array(*map(F.lit, text.SYMBOLS)), n.cast("int"))
    line = said(symbol(F.col("p_partkey") % 14), " ", symbol(s % 14), F.when(s % 8 == 4, "−").otherwise(""), F.when(s % 4 == 0, "").when(s % 4 == 1, " =").when(s % 4 == 2, " water").otherwise(" OH"))
    return table(spark, sf_dir, "part").select("p_partkey", line.alias("line")).withColumn("salad", text.atom_salad(F.col("line")))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS doc, 'CO' || CASE WHEN p_size % 2 = 0 THEN '²' ELSE '₂' END AS text, 50.0::DOUBLE AS x0, CASE WHEN p_size % 2 = 0 THEN 98 ELSE 100 END::DOUBLE AS y0, 64.0::DOUBLE AS x1, CASE WHEN p_size % 2 = 0 THEN 111 ELSE 112 END::DOUBLE AS y1 FROM part
UNION ALL SELECT CAST(p_partkey AS VARCHAR), p_brand, 70 + 2 * 11 * 0.33::DOUBLE, 100, 120, 111 FROM part""")
def span_tokens(spark, sf_dir):
    """A formula with a small span behind it, raised or lowered, and a text with blanks in front."""
    raised = F.col("p_size") % 2 == 0
    span = lambda n, x0, y0, x1, y1, t, size: F.struct(F.lit(n).alias("ord"), F.lit(x0).alias("x0"), y0.cast("double").alias("y0"), F.lit(x1).alias("x1"), y1.cast("double").alias("y1"), t.alias("text"), F.lit(size).alias("size"))
    own = F.array(
        span(0, 50.0, F.lit(100), 60.0, F.lit(111), F.lit("CO"), 11.0), span(1, 60.0, F.when(raised, 98).otherwise(106), 64.0, F.when(raised, 104).otherwise(112), F.lit("2"), 7.0),
        span(2, 70.0, F.lit(100), 120.0, F.lit(111), said("  ", F.col("p_brand"), " "), 11.0), span(3, 130.0, F.lit(100), 140.0, F.lit(111), F.lit("  "), 11.0),
    )
    spans = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("doc"), F.lit(1).alias("page"), F.explode(own).alias("s")).select("doc", "page", "s.*")
    return geometry.tokens(spans).select("doc", "text", "x0", "y0", "x1", "y1")


@query("SELECT p_partkey AS doc, unnest(CASE WHEN (100 - 2 * p_size) / 50 <= 0.55 THEN [1, 2, 3] ELSE [1, 3] END) AS box FROM part")
def larger_boxes(spark, sf_dir):
    """A small box slides out of a large one; a third stands apart."""
    x = (2 * F.col("p_size")).cast("double")
    box = lambda n, x0, y0, x1, y1: F.struct(F.lit(n).alias("ord"), x0.alias("x0"), F.lit(y0).alias("y0"), x1.alias("x1"), F.lit(y1).alias("y1"))
    own = F.array(box(1, F.lit(0.0), 0.0, F.lit(100.0), 100.0), box(2, x, 0.0, x + 50, 50.0), box(3, F.lit(300.0), 0.0, F.lit(310.0), 10.0))
    boxes_of = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc"), F.lit(1).alias("page"), F.explode(own).alias("b")).select("doc", "page", "b.*")
    return geometry.larger_of_overlapping(boxes_of).select("doc", F.col("ord").alias("box"))


@query("SELECT p_partkey AS doc, 5 AS question, 100.0::DOUBLE AS x0, 200.0::DOUBLE AS y0, (108 + 3 * (40 + p_size))::DOUBLE AS x1, CASE WHEN p_size % 5 = 1 THEN 215 ELSE 210 END::DOUBLE AS y1 FROM part WHERE p_size % 5 < 2 AND 8 + 3 * (40 + p_size) >= 180")
def option_row_boxes(spark, sf_dir):
    """Letters A to D from left to right, 40 and more apart; in some D stands a little or far too low, or B and C are swapped, or D is missing."""
    v, step = F.col("p_size") % 5, (40 + F.col("p_size")).cast("double")
    place = [F.lit(0), F.when(v == 3, 2).otherwise(1), F.when(v == 3, 1).otherwise(2), F.lit(3)]
    low = F.when(v == 1, 5.0).when(v == 2, 30.0).otherwise(0.0)
    letter = lambda n, c: F.struct((100 + place[n] * step).alias("x0"), (F.lit(200.0) + (low if n == 3 else 0.0)).alias("y0"), (108 + place[n] * step).alias("x1"), (F.lit(210.0) + (low if n == 3 else 0.0)).alias("y1"), F.lit(c).alias("text"))
    own = F.array_compact(F.array(*[F.when((v != 4) if n == 3 else F.lit(True), letter(n, c)) for n, c in enumerate("ABCD")]))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc"), F.lit(1).alias("page"), F.explode(own).alias("w")).select("doc", "page", "w.*")
    bands = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc"), F.lit(1).alias("page"), F.lit(5).alias("question"), F.lit(150.0).alias("y0"), F.lit(260.0).alias("y1"))
    return geometry.option_rows(rows, bands).drop("page")


SHAPES_SQL = "'Which is it?' || chr(10) || {head} || chr(10) || {a} || chr(10) || {b} || chr(10) || {c} || chr(10) || {d} || chr(10) || 'end'"


@query(f"""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN {SHAPES_SQL.format(head="'| | PCl' || p_size || ' | [X]+ |' || chr(10) || '| --- | --- | --- |'", a="'| A | pyramidal | ' || p_brand || ' |'", b="'| B | square planar | bent |'", c="'| C | ' || p_brand || ' | tetrahedral |'", d="'| D | non-linear | linear |'")}
    ELSE {SHAPES_SQL.format(head="CASE WHEN p_size % 3 = 1 THEN 'PCl' ELSE 'the ' END || p_size || ' [X]+'", a="'A pyramidal ' || p_brand", b="'B square planar bent'", c="'C ' || p_brand || ' tetrahedral'", d="CASE WHEN p_size % 3 = 1 THEN 'D bent' ELSE 'D non-linear linear' END")} END AS body FROM part""")
def option_tables(spark, sf_dir):
    """Tables of shapes: whole, with a row of one shape, and under a head that is no formula."""
    v, s, brand = F.col("p_size") % 3, F.col("p_size"), F.col("p_brand")
    body = said("Which is it?\n", F.when(v == 2, "the ").otherwise("PCl"), s, " [X]+\nA pyramidal ", brand, "\nB square planar bent\nC ", brand, " tetrahedral\nD ", F.when(v == 1, "bent").otherwise("non-linear linear"), "\nend")
    return spread_parts(spark, sf_dir).select("p_partkey", text.options_table(body).alias("body"))


@query("SELECT p_partkey, 'What does ' || p_name || ' show?' || CASE WHEN p_size % 4 = 3 THEN chr(10) || 'enthalpy' || chr(10) || 'A' || chr(10) || 'B' || chr(10) || 'C' || chr(10) || 'D' WHEN p_size % 4 = 1 THEN chr(10) || 'A some text' ELSE '' END || chr(10) || p_size || ' mol of it' AS body FROM part")
def diagram_labels(spark, sf_dir):
    """Axes and atoms by a figure; letters that stand alone go where the options are drawings, and all stays without a figure."""
    v = F.col("p_size") % 4
    options = F.when(v == 1, "A some text").otherwise("A\nB\nC\nD")
    atoms = F.when(v == 3, "").when(v == 2, "C H O\n").otherwise("0 x\n")
    body = said("What does ", F.col("p_name"), " show?\n", F.when(v == 3, "enthalpy\n").otherwise(said("enthalpy\n", atoms)), options, "\n", F.col("p_size"), " mol of it")
    return spread_parts(spark, sf_dir).select("p_partkey", text.without_labels(body, v != 3).alias("body"))
