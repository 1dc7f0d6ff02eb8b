"""Natural-order keys and naming rules as Column expressions. Comparing the structs gives the order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FAR = 1_000_000_000

#: Session codes, their letters in season tokens, roman numerals of parts.
SESSIONS = {"s": "MJ", "w": "ON", "m": "FM"}
MONTHS = {"june": "MJ", "november": "ON", "march": "FM"}
ROMANS = ["i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x"]


def to_int(text: Column) -> Column:
    return text.try_cast("int")


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def code_key(code: Column) -> Column:
    """(topic, subtopic) of a code such as 5.1 or 5.1b; a part that is no number ranks last."""
    text = F.trim(code.cast("string"))
    topic = F.coalesce(to_int(F.split_part(text, F.lit("."), F.lit(1))), F.lit(FAR))
    sub = F.coalesce(to_int(F.regexp_extract(F.split_part(text, F.lit("."), F.lit(2)), r"^\d+", 0)), F.lit(FAR))
    return F.struct(topic.alias("topic"), F.when(F.instr(text, ".") == 0, F.lit(0)).otherwise(sub).alias("sub"))


def code_key_of(code: str) -> tuple[int, int]:
    """The same key of a value that the driver knows."""
    head, dot, tail = str(code).strip().partition(".")
    digits = ""
    for c in tail:
        if not c.isdigit():
            break
        digits += c
    topic = int(head) if head.strip().lstrip("+-").isdigit() else FAR
    return topic, (int(digits) if digits else FAR) if dot else 0


def vocabulary_key(code: Column) -> Column:
    """Numbers between the dots as an array; arrays compare from the left, prefixes first."""
    numbers = F.transform(F.split(code, r"\."), to_int)
    return F.when(F.exists(numbers, F.isnull), F.array(F.lit(999))).otherwise(numbers)


def outcome_key(outcome: Column) -> Column:
    """All numbers of an outcome id, then its letters; ids without a number rank last."""
    low = F.lower(F.trim(outcome.cast("string")))
    numbers = F.transform(F.regexp_extract_all(low, F.lit(r"(\d+)"), F.lit(1)), to_int)
    letters = F.btrim(F.regexp_replace(low, r"\d+", ""), F.lit("-."))
    return F.struct(F.when(F.size(numbers) == 0, F.array(F.lit(FAR))).otherwise(numbers).alias("n"), letters.alias("rest"))


def question_key(label: Column) -> Column:
    """The leading number of a label, then the rest as text."""
    text = F.coalesce(label.cast("string"), F.lit(""))
    return F.struct(F.coalesce(to_int(F.regexp_extract(text, r"^\d+", 0)), F.lit(FAR)).alias("n"), F.regexp_replace(text, r"^\d+", "").alias("rest"))


def part_id(label: Column) -> Column:
    """(parent, letter, roman) of 2(a)(i), 2a-i or q2a-i; null where it is none of them."""
    text = F.regexp_replace(F.trim(label.cast("string")), r"^q(?=\d)", "")
    pattern = r"(?i)^(\d{1,2})(?:\(([a-z])\)(?:\(([ivx]+)\))?|([a-z])(?:-([ivx]+))?)$"
    group = lambda n: F.regexp_extract(text, pattern, n)
    letter = F.lower(F.concat(group(2), group(4)))
    roman = F.lower(F.concat(group(3), group(5)))
    part = F.struct(to_int(group(1)).alias("parent"), letter.alias("letter"), F.when(roman != "", roman).alias("roman"))
    return F.when(text.rlike(pattern), part)


def part_key(label: Column) -> Column:
    """Order of parts: parent, letter, value of the roman numeral; plain numbers first, anything else last by its text."""
    part = part_id(label)
    rank = F.coalesce(F.element_at(literal_map({r: i for i, r in enumerate(ROMANS, 1)}), F.coalesce(part["roman"], F.lit(""))), F.lit(0))
    number = to_int(F.regexp_extract(label, r"^q?(\d+)$", 1))
    return F.when(part.isNotNull(), F.struct(part["parent"].alias("parent"), part["letter"].alias("letter"), rank.alias("roman"))).when(
        number.isNotNull(), F.struct(number.alias("parent"), F.lit("").alias("letter"), F.lit(0).alias("roman"))
    ).otherwise(F.struct(F.lit(999).alias("parent"), label.alias("letter"), F.lit(0).alias("roman")))


def part_label(part: Column) -> Column:
    return F.concat(part["parent"].cast("string"), F.lit("("), part["letter"], F.lit(")"), F.coalesce(F.concat(F.lit("("), part["roman"], F.lit(")")), F.lit("")))


def part_slug(part: Column) -> Column:
    return F.concat_ws("-", F.concat(part["parent"].cast("string"), part["letter"]), part["roman"])


def id_prefix(question_id: Column) -> Column:
    """What stands before the last -q of an id."""
    found = F.regexp_extract(question_id, r"^(.+)-q.+$", 1)
    return F.when(found != "", found).otherwise(question_id)


def full_year(two_digits: Column) -> Column:
    """80 and later are of the last century."""
    return F.when(two_digits < 80, 2000 + two_digits).otherwise(1900 + two_digits)


def season(token: Column) -> Column:
    """(session, year) of a token such as s21."""
    text = F.lower(F.trim(token))
    year = full_year(to_int(F.regexp_extract(text, r"^[swm](\d{2})$", 1)))
    session = F.try_element_at(literal_map(SESSIONS), F.left(text, F.lit(1)))
    return F.when(text.rlike(r"^[swm]\d{2}$"), F.struct(session.alias("session"), year.alias("year")))


def season_token(session: Column, year: Column) -> Column:
    letters = {v: k for k, v in SESSIONS.items()}
    return F.concat(F.coalesce(F.try_element_at(literal_map(letters), F.upper(session)), F.lit("x")), F.lpad((year % 100).cast("string"), 2, "0"))


def paper_kind(paper: Column) -> Column:
    """By the tens digit of the paper number: 1 mcq, 3 practical, others structured."""
    number = to_int(F.regexp_extract(paper.cast("string"), r"^\s*(\d+)", 1))
    tens = F.when(number < 10, number).otherwise(F.floor(number / 10))
    return F.when(tens == 1, "mcq").when(tens == 3, "practical").otherwise("structured")


def paper_reference(text: Column) -> Column:
    """(season, paper) of 9701_s21_qp_12, s21:12 or s21 12."""
    pattern = r"(?i)^(?:\d{4}[_-])?([swm]\d{2})[\s:_/-]*(?:qp|ms)?[\s:_/-]*(\d{1,2})(?:\.\w+)?$"
    clean = F.trim(text)
    return F.when(clean.rlike(pattern), F.struct(F.lower(F.regexp_extract(clean, pattern, 1)).alias("season"), F.regexp_extract(clean, pattern, 2).alias("paper")))


def paper_meta(name: Column) -> Column:
    """(syllabus, session, year, paper, level) of a name such as 9701_s21_qp_12 or 9701_s21_p12, anywhere in the text."""
    pattern = r"(?i)(\d{4})_([smw])(\d{2})_(?:(?:qp|ms)_|p)(\d{1,2})"
    group = lambda n: F.regexp_extract(name, pattern, n)
    paper = to_int(group(4))
    level = F.when(F.left(paper.cast("string"), F.lit(1)).isin("1", "2"), "AS").otherwise("A")
    session = F.try_element_at(literal_map(SESSIONS), F.lower(group(2)))
    return F.when(name.rlike(pattern), F.struct(group(1).alias("syllabus"), session.alias("session"), full_year(to_int(group(3))).alias("year"), paper.alias("paper"), level.alias("level")))


def question_id(meta: Column, question: Column, board: str = "cie") -> Column:
    """board-syllabus-year-session-pN-qLABEL; brackets leave the label, dots become dashes."""
    label = F.translate(F.translate(question, "()", ""), ".", "-")
    return F.concat(F.lit(board + "-"), meta["syllabus"], F.lit("-"), meta["year"].cast("string"), F.lit("-"), F.lower(meta["session"]), F.lit("-p"), meta["paper"].cast("string"), F.lit("-q"), label)


def pairs(text: Column) -> Column:
    """key=value pairs between commas as a map; parts without = are left out, the last of a key counts."""
    parts = F.filter(F.split(text, ","), lambda p: F.instr(p, "=") > 0)
    entries = F.transform(parts, lambda p: F.struct(F.trim(F.split_part(p, F.lit("="), F.lit(1))).alias("key"), F.trim(F.substr(p, F.instr(p, "=") + 1)).alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def has_options(question_type: Column, paper: Column) -> Column:
    """Whether a question must show options: by its type, else by its paper's kind; where neither is known it must."""
    kind = F.lower(F.coalesce(question_type, F.lit("")))
    return F.when(kind.isin("structured", "extended", "practical", "data"), False).when((kind == "mcq") | paper.isNull(), True).otherwise(paper_kind(paper) == "mcq")


def name_needs_options(name: Column) -> Column:
    """The same by a file's name: only those of other papers than the first need none."""
    number = F.regexp_extract(name, r"(?i)qp_(\d+)", 1)
    return F.when(number != "", paper_kind(number) == "mcq").otherwise(True)


def leading_int(value: Column) -> Column:
    """The whole number that a text begins with, 0 where it begins with none."""
    return F.coalesce(F.regexp_extract(value.cast("string"), r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(0))


def quiz_order(year: Column, paper: Column, question: Column) -> list[Column]:
    """By year, then by the numbers that paper and question begin with."""
    return [leading_int(year), leading_int(paper), leading_int(question)]


def source_label(year: Column, session: Column, paper: Column) -> Column:
    """2021 MJ P11, without what isn't known."""
    return F.concat(F.coalesce(F.nullif(year.cast("string"), F.lit("")), F.lit("?")), F.lit(" "), F.coalesce(F.concat(F.nullif(session, F.lit("")), F.lit(" ")), F.lit("")), F.coalesce(F.concat(F.lit("P"), F.nullif(paper.cast("string"), F.lit(""))), F.lit("")))


def one_line(text: Column, most: int) -> Column:
    """White space as single blanks, cut with a mark where it is longer."""
    flat = F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.left(flat, F.lit(most)), F.lit("…"))).otherwise(flat)
