"""Ordered rules: the first pattern that a text matches decides. One CASE chain in one projection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip


@dataclass(frozen=True)
class Rule:
    pattern: str
    codes: tuple[str, ...]
    skills: tuple[str, ...] = ("recall",)
    scope: str = "stem"  #: stem or body


#: The topics of stem words, in order of precedence. Extend or replace them by argument.
STEM_RULES = (
    Rule(r"(?i)\b(hess('?s)?\s+law|energy cycle|enthalpy change of formation|enthalpy of formation|reaction pathway diagram|reaction profile|bond energ(y|ies))\b", ("5.1", "5.2"), ("calculate",)),
    Rule(r"(?i)\b(enthalpy|hess|ΔH|∆H|delta H)\b", ("5.1", "5.2"), ("calculate",)),
    Rule(r"(?i)\b(boltzmann|molecular energy|number of molecules)\b", ("8.2",), ("explain", "recall")),
    Rule(r"(?i)\b(heat exchanger|haber process)\b", ("8.1", "12.1"), ("explain",)),
    Rule(r"(?i)\b(catalysts?)\b", ("8.3", "8.1"), ("explain", "recall")),
)
FALLBACKS = (
    Rule(r"(?i)\b(C\d+H\d+|organic|structure)\b", ("13.1",), ("recall",), "body"),
    Rule(r"(?i)\b(mol\b|mass|dm3|gaseous product)\b", ("2.2",), ("calculate",), "body"),
    Rule(r"", ("2.2",), ("recall",), "body"),
)


def stem_of(body: Column) -> Column:
    """What stands before the options: before a line with A alone, or else before the last run of lines A to D."""
    text = strip(body)
    alone = F.regexp_extract(text, r"(?s)^(.*?)(?:^|\n)[ \t]*A[ \t]*(?:\n.*)?$", 1)
    run = F.regexp_extract(text, r"(?s)^(.*)(?:^|\n)[ \t]*A[ \t]+\S[^\n]*\n\s*B[ \t]+\S[^\n]*\n\s*C[ \t]+\S[^\n]*\n\s*D[ \t]+\S", 1)
    has_alone = text.rlike(r"(?m)^[ \t]*A[ \t]*$")
    has_run = text.rlike(r"(?m)^[ \t]*A[ \t]+\S[^\n]*\n\s*B[ \t]+\S[^\n]*\n\s*C[ \t]+\S[^\n]*\n\s*D[ \t]+\S")
    return strip(F.when(has_alone, alone).when(has_run, run).otherwise(text))


def first_match(stem: Column, body: Column, rules: Sequence[Rule] = STEM_RULES + FALLBACKS) -> Column:
    """(codes, skills, rule) of the first rule that matches; rule is its place, from 0."""
    out = None
    for i, r in enumerate(rules):
        hit = (stem if r.scope == "stem" else body).rlike(r.pattern) if r.pattern else F.lit(True)
        value = F.struct(F.array(*map(F.lit, r.codes)).alias("codes"), F.array(*map(F.lit, r.skills)).alias("skills"), F.lit(i).alias("rule"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out
