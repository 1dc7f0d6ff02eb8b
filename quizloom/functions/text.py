"""Text operators as Column expressions, and the two rewrites by callback as Arrow functions."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SUBSCRIPTS, SUPERSCRIPTS, PLAIN = "₀₁₂₃₄₅₆₇₈₉₊₋", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻", "0123456789+-"
#: Fixed: what can be lowered and raised besides.
LOWERED, RAISED = {"=": "₌", "(": "₍", ")": "₎", "a": "ₐ", "e": "ₑ", "o": "ₒ", "x": "ₓ"}, {"=": "⁼", "(": "⁽", ")": "⁾"}
ARROWS = ["\uf0ae", "\uf0d7", "\u2261", "\uff1d"]

#: Fixed patterns: noise of page feet, mark grids read as text, page marks, sections of notes.
FOOTER = r"(?i)^\s*(©\s*UCLES.*|Page \d+ of \d+|\d{4}/\d+.*|\[Turn over\]?)\s*$"
GRID = r"(?i)(^|\s)1(\s+1){4,}|(Marks\s+){2,}|Cambridge International AS & A Level\s*–\s*Mark Scheme|PUBLISHED\s*Answer"
PAGE = r"\n?----- PAGE \d+ -----\n?"
FRONT = r"(?s)^---\s*\n(.*?)\n---\s*\n"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is found once however often use names it; a column that is named again is found again."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space at either end, line ends too."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def slug(title: Column) -> Column:
    """Lower case; white space to dashes, other signs to underscores, these to dashes."""
    dashed = F.regexp_replace(F.lower(strip(title)), r"\s+", "-")
    marked = F.regexp_replace(dashed, r"[^a-z0-9_\-]", "_")
    return F.btrim(F.regexp_replace(marked, "_+", "-"), F.lit("-"))


def from_scripts(text: Column) -> Column:
    """Raised and lowered digits and signs as plain ones."""
    return F.translate(F.translate(text, SUBSCRIPTS, PLAIN), SUPERSCRIPTS, PLAIN)


def to_subscripts(text: Column) -> Column:
    return F.translate(text, PLAIN, SUBSCRIPTS)


def to_superscripts(text: Column) -> Column:
    return F.translate(text, PLAIN, SUPERSCRIPTS)


def lowered(text: Column) -> Column:
    """Everything that can stand below a line, as it does there."""
    return F.translate(text, PLAIN + "".join(LOWERED), SUBSCRIPTS + "".join(LOWERED.values()))


def raised(text: Column) -> Column:
    return F.translate(text, PLAIN + "".join(RAISED), SUPERSCRIPTS + "".join(RAISED.values()))


def arrows(text: Column) -> Column:
    """Signs that stand for a reaction arrow, and = between formulae, as an arrow; doubled arrows as one."""
    one = F.translate(text, "".join(ARROWS), "→" * len(ARROWS))
    between = F.regexp_replace(one, r"(?<=[A-Za-z0-9₀-₉⁺⁻+\])}])\s*=\s*(?=[A-Z][A-Za-z0-9₀-₉⁺⁻]*)", " → ")
    return F.regexp_replace(between, r"(?:→\s*){2,}", "→ ")


def unglued(text: Column) -> Column:
    """Spaces at seams of letters and digits, and before an option letter."""
    a = F.regexp_replace(text, "([0-9])([A-Za-z])", "$1 $2")
    b = F.regexp_replace(a, "([A-Za-z])([0-9])", "$1 $2")
    return F.regexp_replace(b, r"([a-z])([A-D])\b", "$1 $2")


def block(text: Column) -> Column:
    """Unglued, blanks at line ends and runs of blanks and of blank lines cut."""
    a = F.regexp_replace(unglued(text), r"[ \t]+\n", "\n")
    b = F.regexp_replace(a, r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(b, r"[ \t]{2,}", " "))


def without_footers(text: Column) -> Column:
    """Without footer lines, what follows a copyright trailer, and blank lines and lone page numbers at the end."""
    cut = F.regexp_replace(text, r"(?is)(^|\n)[ \t]*(Permission to reproduce\b|BLANK PAGE[ \t]*(\n|$)).*$", "")
    kept = F.array_join(F.filter(F.split(cut, "\n"), lambda x: ~x.rlike(FOOTER)), "\n")
    tail = F.regexp_replace(F.concat(F.lit("\n"), kept), r"(\n[ \t]*\d{0,2}[ \t]*)+$", "")
    return strip(F.regexp_replace(tail, r"\n{3,}", "\n\n"))


def garbage(text: Column) -> Column:
    """Nothing, a mark grid read as text, or many lone ones in a short text without M1."""
    s = strip(F.coalesce(text, F.lit("")))
    ones = F.size(F.regexp_extract_all(s, F.lit(r"(?:^|\s)(1)(?=\s|$)"), F.lit(1)))
    return (s == "") | s.rlike(GRID) | ((ones >= 8) & ~F.contains(s, F.lit("M1")) & (F.length(s) < 800))


def paper_style(text: Column) -> Column:
    """mcq by the cover's phrases or by 40 lines of options, else structured."""
    lone = F.size(F.regexp_extract_all(text, F.lit(r"(?m)^\s*([A-D])\s*$"), F.lit(1)))
    inline = F.size(F.regexp_extract_all(text, F.lit(r"(?m)^([A-D])\s+\S"), F.lit(1)))
    cover = text.rlike(r"(?i)Paper\s*1\s*Multiple Choice|forty questions|multiple choice")
    return F.when(cover | (F.greatest(lone, inline) >= 40), "mcq").otherwise("structured")


def front_and_body(text: Column) -> Column:
    """Front matter and the rest of a note."""
    front = F.regexp_extract(text, FRONT, 1)
    return F.struct(front.alias("front"), F.regexp_replace(text, FRONT, "").alias("body"))


def section(text: Column, heading: str) -> Column:
    """What stands under a heading of the second level."""
    return strip(F.regexp_extract(text, rf"(?s)(?:^|\n)## {heading}[ \t]*\n(.*?)(?=\n## |\z)", 1))


def answer_key(text: Column) -> Column:
    """(q, a) of the rows of a key table: number, letter and marks on a line."""
    q = F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*(\d{1,2})[ \t]+([A-D])[ \t]+(\d+)[ \t]*$"), F.lit(1))
    a = F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*(\d{1,2})[ \t]+([A-D])[ \t]+(\d+)[ \t]*$"), F.lit(2))
    return F.arrays_zip(q.alias("q"), a.alias("a"))


def question_list(text: Column) -> Column:
    """All numbers of one or two digits of a phrase."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(\d{1,2})"), F.lit(1)), lambda s: s.cast("int"))


def escaped(text: Column) -> Column:
    """For HTML."""
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def leading_id(text: Column) -> Column:
    """An id from a link's id parameter, or the digits themselves."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"[?&]id=(\d+)", 1), F.lit("")), F.nullif(F.regexp_extract(F.trim(text), r"^(\d+)$", 1), F.lit("")))


def distinctive_words(text: Column, stop: list[str], k: int, least: int = 4) -> Column:
    """The first k distinct words of a length that aren't stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(rf"([a-z]{{{least},}})"), F.lit(1))
    return F.slice(F.array_distinct(F.filter(words, lambda w: ~w.isin(stop))), 1, k)


def word_hits(words: Column, text: Column) -> Column:
    """How many of the words the text holds as whole words."""
    low = F.lower(text)
    return F.size(F.filter(words, lambda w: F.regexp_like(low, F.concat(F.lit(r"\b"), w, F.lit(r"\b")))))


def option_letters(text: Column) -> Column:
    """The letters A to D that stand for options: at a line's start, in a row, or all where the text names them together."""
    every = text.rlike(r"(?m)(?:^|\s)A\s+B\s+C\s+D(?:\s|$)") | text.rlike(r"(?i)responses\s+A\s+to\s+D")
    starts = F.regexp_extract_all(text, F.lit(r"(?m)^\s*([A-D])(?=\s|$|[.)]|→)"), F.lit(1))
    row = F.regexp_extract_all(text, F.lit(r"(?m)(?:^|\s)([A-D])(?=\s+[A-Za-z0-9\[(]|\s*$)"), F.lit(1))
    return F.when(every, F.array(*map(F.lit, "ABCD"))).otherwise(F.array_sort(F.array_distinct(F.concat(starts, row))))


#: Symbols and groups that a drawing is lettered with, the signs of its bonds and charges, and the dots of its electrons.
SYMBOLS = ["C", "H", "O", "N", "S", "P", "F", "Cl", "Br", "I", "OH", "HO", "NH", "CN"]
BONDS, CHARGES, DOTS = "=|/\\−–—-", "⁺⁻+−–—-", ".•·*"


def atom_salad(line: Column) -> Column:
    """Whether a line holds nothing but the lettering of a drawing: atoms and bonds, or signs alone.

    Two short tokens may be a value and its unit, and a letter A to D before one symbol is an option; both stay."""
    made_of = lambda t, signs: F.translate(t, signs, "") == ""

    def lettering(clean: Column, tokens: Column) -> Column:
        signs = F.forall(tokens, lambda t: made_of(t, CHARGES + DOTS))
        atoms = F.forall(tokens, lambda t: F.rtrim(t, F.lit(CHARGES)).isin(SYMBOLS) | made_of(t, BONDS))
        two = F.size(tokens) == 2
        option = two & F.get(tokens, F.lit(0)).isin(list("ABCD")) & F.rtrim(F.get(tokens, F.lit(1)), F.lit(CHARGES)).rlike("^[A-Z][A-Za-z]?$")
        prose = F.exists(tokens, lambda t: t.rlike("[a-z]{3,}")) | F.startswith(clean, F.lit("|"))
        short = two & F.forall(tokens, lambda t: F.length(t) <= 2)
        return ~prose & (signs | (atoms & ~F.coalesce(option, F.lit(False)) & ~short))

    clean = strip(F.regexp_replace(line, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""))
    salad = once(clean, lambda x: once(tokens_of(x), lambda tokens: lettering(x, tokens)))
    return F.coalesce((line != "") & salad, F.lit(False))


#: Fixed: how the sign of an enthalpy change is set, with or without what stands below it and the sign of the standard state.
ENTHALPY = re.compile(r"ΔH(_\{?(?:\d+|[cCfF])\}?|[₀-₉]+|\d+|[cC])?(?:\^\{?⦵\}?|[⦵°⊖])?")
#: Fixed: capitals that are words or letters of options, and what may follow a formula.
SKIPPED = {"A", "B", "C", "D", "I", "In", "At", "As", "No", "He", "The", "It", "Is", "On"}
FOLLOWS, CHARGE_SIGNS = "(–—+-=×·,;:?", "⁺⁻+-"
WORD = re.compile(r"(?<![A-Za-z\\$])\[?[A-Z][A-Za-z0-9₀-₉]*\]?[0-9₀-₉]*[⁺⁻+\-]*")
ELEMENTS = re.compile(r"([A-Z][a-z]?)([0-9₀-₉]*)")


def _plain(text: str) -> str:
    return text.translate(str.maketrans(SUBSCRIPTS + SUPERSCRIPTS, PLAIN + PLAIN))


def _enthalpy(m: re.Match) -> str:
    low = _plain((m.group(1) or "").strip("_{}")).lower()
    below = "" if not low else f"_{{{low}}}" if low.isdigit() else rf"_{{\mathrm{{{low}}}}}"
    return rf"$\Delta H{below}^{{\ominus}}$"


def _formula(m: re.Match) -> str:
    """A word as math if it is a formula: elements with counts, perhaps in brackets, then as much of a charge as may stand before what follows."""
    word = m.group(0)
    body = word.rstrip(CHARGE_SIGNS)
    follows = lambda end: (m.string[m.start() + end :][:1] or " ")
    end = next((n for n in range(len(word), len(body) - 1, -1) if follows(n).isspace() or follows(n) in FOLLOWS), None)
    inside, bracket, outside = body.removeprefix("[").partition("]")
    parts = ELEMENTS.findall(inside)
    if end is None or "".join(e + n for e, n in parts) != inside or bool(bracket) != body.startswith("[") or "".join(e for e, _ in parts) in SKIPPED:
        return word
    if len(parts) < 2 and not any(n for _, n in parts) and not outside:
        return word
    count = lambda n: f"_{{{_plain(n)}}}" if n else ""
    charge = f"^{{{_plain(word[len(body):end])}}}" if end > len(body) else ""
    formula = "".join(e + count(n) for e, n in parts)
    return rf"$\mathrm{{{'[' + formula + ']' if bracket else formula}{count(outside)}{charge}}}$" + word[end:]


@F.pandas_udf(StringType())
def latex(texts: pd.Series) -> pd.Series:
    """Enthalpy signs and formulae as math; what a word becomes depends on how it divides into elements, which SQL can't say."""
    return texts.map(lambda t: WORD.sub(_formula, ENTHALPY.sub(_enthalpy, t)) if isinstance(t, str) else None)


OPTIONS = ["A", "B", "C", "D"]


def tokens_of(line: Column) -> Column:
    return F.filter(F.split(line, r"\s+"), lambda t: t != "")


def options_of(line: Column) -> Column:
    """(lead, texts) of a line on which A, B, C and D stand in this order with words behind each; null for other lines.

    One scan over the words: the first A, alone or behind a sign, opens the options; the next letter in turn opens the next one as soon as the
    one before has a word; everything else belongs to what is open."""
    start = F.struct(F.lit(0).alias("n"), F.lit("").alias("lead"), F.array().cast("array<string>").alias("texts"))
    more = lambda text, word: F.ltrim(F.concat(text, F.lit(" "), word))

    def step(acc: Column, word: Column) -> Column:
        n, lead, texts = acc["n"], acc["lead"], acc["texts"]
        open_text = F.coalesce(F.try_element_at(texts, F.lit(-1)), F.lit(""))
        first = (n == 0) & word.rlike("(?:^|[^A-Za-z])A$")
        following = (n > 0) & (n < 4) & (open_text != "") & (word == F.get(F.array(*map(F.lit, OPTIONS)), n))
        fresh = F.concat(texts, F.array(F.lit("")))
        longer = F.concat(F.slice(texts, 1, F.greatest(F.size(texts) - 1, F.lit(0))), F.array(more(open_text, word)))
        return F.when(first, F.struct(F.lit(1).alias("n"), more(lead, F.left(word, F.length(word) - 1)).alias("lead"), fresh.alias("texts"))).when(
            following, F.struct((n + 1).alias("n"), lead.alias("lead"), fresh.alias("texts"))
        ).when(n == 0, F.struct(n.alias("n"), more(lead, word).alias("lead"), texts.alias("texts"))).otherwise(F.struct(n.alias("n"), lead.alias("lead"), longer.alias("texts")))

    whole = lambda found: (found["n"] == 4) & (F.try_element_at(found["texts"], F.lit(-1)) != "")
    options = once(F.aggregate(tokens_of(line), start, step), lambda found: F.when(whole(found), F.struct(F.rtrim(found["lead"]).alias("lead"), found["texts"].alias("texts"))))
    return F.when(line.rlike(r"A\s.*\sB\s.*\sC\s.*\sD\s+\S"), options)


def option_lines(text: Column) -> Column:
    """Options that run together on one line as a line each, after what stands before them; letters alone too."""
    lettered = lambda t, i: F.concat(F.get(F.array(*map(F.lit, OPTIONS)), i), F.lit(" "), t)

    def lines(x: Column, found: Column) -> Column:
        apart = F.array_join(F.concat(F.filter(F.array(found["lead"]), lambda v: v != ""), F.transform(found["texts"], lettered)), "\n")
        return F.when(tokens_of(x) == F.array(*map(F.lit, OPTIONS)), "\n".join(OPTIONS)).when(found.isNotNull(), apart).otherwise(x)

    return F.array_join(F.transform(F.split(text, "\n"), lambda x: once(options_of(x), lambda found: lines(x, found))), "\n")


def line_kinds(lines: Column) -> Column:
    """For each line the letter of the option that it is, "row" where all four stand on it, or nothing."""

    def kind(words: Column, found: Column) -> Column:
        row = (found["lead"] == "") & F.forall(F.slice(found["texts"], 1, 3), lambda t: F.length(t) > 1)
        letter = F.get(words, F.lit(0))
        return F.when(F.coalesce(row, F.lit(False)), "row").when((F.size(words) > 1) & letter.isin(OPTIONS), letter).otherwise("")

    return F.transform(lines, lambda x: once(tokens_of(x), lambda words: once(options_of(x), lambda found: kind(words, found))))


def without_repeated_options(body: Column, clip: Column) -> Column:
    """The body without its option lines where a clip shows them: where a line holds all four, or three lines or more are options, A and D among them."""
    lines = F.split(body, "\n")

    def without(kinds: Column) -> Column:
        options = F.filter(kinds, lambda k: k != "")
        listed = (F.size(options) >= 3) & F.array_contains(options, "A") & F.array_contains(options, "D")
        kept = F.array_join(F.filter(lines, lambda x, i: F.get(kinds, i) == ""), "\n")
        return F.when(F.array_contains(options, "row") | listed, strip(F.regexp_replace(kept, r"\n{3,}", "\n\n"))).otherwise(body)

    return F.when(clip, once(line_kinds(lines), without)).otherwise(body)


#: Fixed: what begins the shared key of a paper's last section, and the lines that it is made of.
KEY_STARTS = [r"Section B\b", r"For each of the questions in this section\b", r"The responses\s*A\s*to\s*D\b", r"Decide whether each of the statements\b"]
KEY_LINES = [
    r"A\s+B\s+C\s+D", r"1,\s*2\s+and\s*3.*", r"1\s+and\s*2.*", r"2\s+and\s*3.*", r"1\s+only.*", r"are\s+only\s+are\s+only\s+are\s+is", r"correct\s+correct\s+correct\s+correct",
    r"No other combination of statements\b.*", r"Use of the Data Booklet\b.*", r"one or more of the three numbered statements\b.*", r"be correct\.?", r"the statements that you consider to be correct\)?\.?",
]


def without_key(body: Column) -> Column:
    """The body without the lines of the shared key. What begins a key goes, and so do blank lines and numbers up to the next line of text;
    the lines that keys are made of go wherever they stand."""
    opens, part = f"(?i)^\\s*(?:{'|'.join(KEY_STARTS)})", f"(?i)^\\s*(?:{'|'.join(KEY_LINES)})\\s*$"
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, line: Column) -> Column:
        begins, key = line.rlike(opens), line.rlike(part)
        filler = acc["inside"] & ((F.trim(line) == "") | F.trim(line).rlike(r"^\d{1,2}$"))
        gone = begins | key | filler
        return F.struct((begins | (acc["inside"] & gone)).alias("inside"), F.when(gone, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(line))).alias("kept"))

    kept = F.aggregate(F.split(body, "\n"), start, step, lambda acc: acc["kept"])
    return strip(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"))


#: Fixed: shapes of molecules, longest names first, and what a column of such a table is headed with.
SHAPES = ["trigonal bipyramidal", "square planar", "trigonal planar", "tetrahedral", "octahedral", "pyramidal", "non-linear", "linear", "bent"]
HEAD = r"(?:\[[^\]]+\][⁺+\-]*|[A-Z][A-Za-z0-9₀-₉⁺⁻+\-]*)(?:\([^)]*\))?"


def two_cells(text: Column) -> Column:
    """(left, right) of a row of two shapes: a shape and the rest, else the rest and a shape; null where neither is."""
    shape = "|".join(SHAPES)

    def cells(flat: Column) -> Column:
        found = lambda pattern: F.when(flat.rlike(pattern), F.struct(F.regexp_extract(flat, pattern, 1).alias("left"), F.regexp_extract(flat, pattern, 2).alias("right")))
        return F.coalesce(found(rf"(?i)^({shape})\s*(\S.*)$"), found(rf"(?i)^(\S.*)\s({shape})$"))

    return once(F.btrim(F.regexp_replace(text, r"\s+", " ")), cells)


def options_table(text: Column) -> Column:
    """Two formulae on a line with four options of two shapes below them, as a table; other lines stay.

    The lines, their cells and the heads among them are found once for a text, so the work grows with its lines."""
    option = r"^\s*([A-D])\s+(\S.*?)\s*$"
    head = rf"^\s*({HEAD})\s+({HEAD})\s*$"
    cells_of = lambda lines: F.transform(lines, lambda x: F.when(x.rlike(option), two_cells(F.regexp_extract(x, option, 2))))
    heads_of = lambda lines, rows: F.transform(lines, lambda x, i: x.rlike(head) & ~x.rlike(option) & F.forall(F.sequence(i + 1, i + 4), lambda k: F.get(rows, k).isNotNull()))

    def rebuilt(x: Column, i: Column, rows: Column, heads: Column) -> Column:
        row = F.get(rows, i)
        below = F.exists(F.sequence(i - 4, i - 1), lambda k: F.coalesce(F.get(heads, k), F.lit(False)))
        titles = F.concat(F.lit("| | "), F.regexp_extract(x, head, 1), F.lit(" | "), F.regexp_extract(x, head, 2), F.lit(" |\n| --- | --- | --- |"))
        cells = F.concat(F.lit("| "), F.regexp_extract(x, option, 1), F.lit(" | "), row["left"], F.lit(" | "), row["right"], F.lit(" |"))
        return F.when(F.get(heads, i), titles).when(below, cells).otherwise(x)

    table = lambda lines, rows, heads: F.array_join(F.transform(lines, lambda x, i: rebuilt(x, i, rows, heads)), "\n")
    return once(F.split(text, "\n"), lambda lines: once(cells_of(lines), lambda rows: once(heads_of(lines, rows), lambda heads: table(lines, rows, heads))))


#: Fixed: the words on the axes and arrows of diagrams, the marks of a table of ticks, and what is left of a mechanism.
AXES = [
    r"[TtxXyY][₀-₉0-9]?", "0", r"0\s*x", r"x\s*0", "%", r"transmittance(?:\s*/\s*%)?", r"wavenumber(?:\s*/\s*cm[–\u2212-]¹?)?", "enthalpy", "products?", "reactants?", "progress of reaction",
    "heat exchanger|catalytic|converter|condenser", r"[0yxYX]\s+[0yxYX]", r"100|50|\d{3,4}(?:\s+\d{3,4})+",
]
TICKS, DEBRIS = "✓✗×xX✔✖", r"H[₃3]C\s+C\s+Br|N\s+C–|HO–••"
MECHANISM = r"^[A-D]\s+C(?:\s+(?:C⁺|C\+|H⁺|H\+|Br⁺|Br\+|C|H|Br|Cl|I|F|N|O|[^A-Za-z0-9\s])){2,}\s*$"
CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"


def without_labels(body: Column, figure: Column) -> Column:
    """The body without what is read off a diagram where a figure shows it: words of axes, scales, lettering of atoms, crumbs of charges.

    Where the options are drawings - their letters stand alone, or with ticks, or with chains of atoms - their letters go too, and so does every
    line without a word. The shared key, control signs and page feet go in any case."""
    bare, ticked = rf"^[A-D]$|^[A-D](?:\s+[{TICKS}])+$", lambda x: F.regexp_replace(x, CONTROLS, "")

    def drawings(raw: Column) -> Column:
        alone = F.array_distinct(F.filter(raw, lambda x: x.isin(OPTIONS)))
        texts = F.exists(raw, lambda x: x.rlike(r"^[A-D]\s+\S"))
        in_row = F.exists(raw, lambda x: tokens_of(x) == F.array(*map(F.lit, OPTIONS)))
        drawn = in_row | F.exists(raw, lambda x: x.rlike(MECHANISM) | x.rlike(DEBRIS)) | ((F.size(alone) == 4) & ~texts)
        return drawn | (F.size(F.filter(raw, lambda x: F.btrim(ticked(x)).rlike(bare))) >= 3)

    def label(clean: Column, drawn: Column) -> Column:
        axis = clean.rlike(f"(?i)^(?:{'|'.join(AXES)})$")
        crumbs = clean.rlike(r"^[⁺⁻+\u2212–—\s.•·*-]+$")
        of_drawing = clean.rlike("^[A-D]$") | (tokens_of(clean) == F.array(*map(F.lit, OPTIONS))) | (~clean.rlike(r"^\d+\b") & ~clean.rlike("[a-z]{3,}"))
        return (clean != "") & (axis | crumbs | (drawn & of_drawing) | atom_salad(clean))

    trimmed = lambda x: F.btrim(x, F.lit(" \t\r"))
    drawn = once(F.transform(F.split(body, "\n"), trimmed), drawings)
    lines = F.split(F.regexp_replace(without_key(body), CONTROLS, ""), "\n")
    unlabelled = once(drawn, lambda drawn: F.filter(lines, lambda x: ~once(trimmed(x), lambda clean: label(clean, drawn))))
    kept = F.when(figure, unlabelled).otherwise(lines)
    return without_footers(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"))


#: Fixed: symbol-font code points and control signs that papers are set with, and what they stand for.
CHARACTERS = {
    "\uf0b4": "×", "\uf0b7": "·", "\uf0ae": "→", "\uf0d7": "→", "\uf02d": "−", "\uf02b": "+", "\uf0b0": "°", "\uf044": "Δ",
    "\uf070": "π", "\uf073": "σ", "\u00a0": " ", "\u2261": "→", "\x01": " ", "\x03": " ",
}
#: Fixed: the words that tell what a question asks for, in the order in which they are listed.
COMMANDS = [
    "Explain", "State", "Calculate", "Construct", "Identify", "Suggest", "Describe", "Define", "Draw", "Name", "Complete", "Predict", "Compare",
    "Deduce", "Give", "Write", "Label", "Sketch",
]


def characters(text: Column) -> Column:
    """Symbol-font and control signs as what they stand for."""
    return F.translate(text, "".join(CHARACTERS), "".join(CHARACTERS.values()))


def last_marks(body: Column) -> Column:
    """The number of the last [n]."""
    return F.try_element_at(F.regexp_extract_all(body, F.lit(r"\[(\d+)\]"), F.lit(1)), F.lit(-1)).try_cast("int")


def command_words(body: Column) -> Column:
    return F.filter(F.array(*map(F.lit, COMMANDS)), lambda w: F.regexp_like(body, F.concat(F.lit(r"(?i)\b"), w, F.lit(r"\b"))))
