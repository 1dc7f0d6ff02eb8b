"""Which numbered lines open a question, and which of them are taken.

A line is judged by its own words and, where the number stands alone, by the next full line. Multiple-choice papers number their
statements too, so of the lines that carry a number the best after the question before is taken; structured papers must count on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: what covers, instructions and the matter behind the last question begin with.
FRONT_MATTER = [
    "candidate", "centre", "syllabus", "paper", "session", "cambridge", "university", r"section\s+[a-d]", "instructions", "information", "blank page",
    "permission to reproduce", r"©\s*ucles", r"hour\b", r"minute[s]?\b", r"soft\b", "data booklet", "total mark", "correct answer",
    r"\d+[a-z]+(?:helium|lithium|beryllium|oxygen|fluorine|neon|sodium)",
]
#: Fixed: headings of the notes on qualitative analysis.
NOTES = [r"Reactions of (?:aqueous )?cations", "Reactions of anions", "Tests for gases", r"Qualitative\s+Analysis(?:\s+Notes)?"]
#: Fixed: words that questions of the papers begin with.
STEMS = [
    "Which", "What", "How", "Why", "When", "Where", "Who", "The ", "In ", "For ", "An ", "A ", "Use ", "Calculate", "Explain", "Define", "Describe",
    "Deduce", "Suggest", "Identify", "State", "Give", "Draw", "Write", "Compare", "Outline", "Discuss", "Predict", "Determine", "Show", "Sketch", "Consider",
    "Phosphorus", "Sodium", "Chlorine", "Carbon", "Nitrogen", "Oxygen", "Hydrogen", "Ethene", "Ethane", "Butane", "Propane", "Methane", "Ethanol", "Benzene",
    "Graphite", "Diamond", "Ammonia", "Sulfur", "Sulphur", "Period", "Group", "Element", "Compound", "Molecule", "Ion ", "Ions ",
]
NOTES_HEADING = r"(?i)^\s*Qualitative\s+analysis\s+notes\s*$"
STEM_LIKE, PLAIN, PAGE_NUMBER, BLANK_PAGE = range(4)  #: the classes of a numbered line, best first; the last two are never taken


def begins(text: Column, words: list[str], end: str = "") -> Column:
    return text.rlike(f"(?i)^(?:{'|'.join(words)}){end}")


def n_words(text: Column) -> Column:
    return F.size(F.split(text, r"\s+"))


def plausible(body: Column, after: Column, style: Column) -> Column:
    """Whether a line with a number and this rest may open a question; after is the next full line."""
    short = n_words(body) <= 3
    boilerplate = begins(body, FRONT_MATTER) & (n_words(body) <= 4) & (F.length(body) < 60)
    fragment = short & ~begins(body, STEMS) & (F.length(body) < 40)
    worded = body.rlike("[A-Za-z]{3,}") & ~boilerplate & ~begins(body, NOTES, r"\b") & ~fragment
    # a number alone: a page number stands before another number, an option or nothing at all
    stem_follows = after.rlike("[A-Za-z]{3,}") & ~begins(after, FRONT_MATTER) & ~after.rlike(r"^\d{1,2}\s*[.)]?\s*$|^[A-D]$")
    part_follows = after.rlike(r"(?i)^\(a\)(?:\s|$|\()")
    alone = F.when(style == "mcq", stem_follows).otherwise(part_follows)
    return F.coalesce(F.when(body == "", alone).otherwise(worded), F.lit(False))


def line_class(body: Column) -> Column:
    number_before_stem = body.rlike(r"^\d{1,2}\s+[A-Za-z]") & (n_words(body) <= 3)
    stem = begins(body, STEMS) | (n_words(body) >= 4)
    return F.when(number_before_stem, PAGE_NUMBER).when(body.rlike(r"(?i)^BLANK\s+PAGE\b"), BLANK_PAGE).when(stem, STEM_LIKE).otherwise(PLAIN)


def consecutive(candidates: Column, style: Column) -> Column:
    """Of (n, num) in order those that count on: 1, 2, 3, ...; structured papers start anew at 1 after three or more."""
    start = F.struct(F.lit(0).alias("last"), F.array().cast("array<int>").alias("kept"))

    def step(acc: Column, c: Column) -> Column:
        goes_on = (c["num"] == acc["last"] + 1) | ((style == "structured") & (c["num"] == 1) & (acc["last"] >= 3))
        return F.when(goes_on, F.struct(c["num"].alias("last"), F.concat(acc["kept"], F.array(c["n"])).alias("kept"))).otherwise(acc)

    return F.aggregate(candidates, start, step, lambda acc: acc["kept"])


def best_picks(candidates: Column, most: int = 40) -> Column:
    """For 1, 2, ... the line (n) of the best class, the first of equals, after the line taken before; a number without one is left out.

    Candidates are (n, num, class). A false early number costs nothing: what it would hide stands behind it and is compared with it."""
    start = F.struct(F.lit(-1).alias("last"), F.array().cast("array<int>").alias("kept"))

    def step(acc: Column, number: Column) -> Column:
        ahead = F.filter(candidates, lambda c: (c["num"] == number) & (c["n"] > acc["last"]) & (c["class"] < PAGE_NUMBER))
        best = F.array_min(F.transform(ahead, lambda c: F.struct(c["class"], c["n"])))["n"]
        return F.when(best.isNotNull(), F.struct(best.alias("last"), F.concat(acc["kept"], F.array(best)).alias("kept"))).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step, lambda acc: acc["kept"])
