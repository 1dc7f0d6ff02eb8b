"""Selection rules: a small declarative query that the driver checks and turns into one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import code_key, code_key_of, question_key
from ..operators.relational import first_by

INTEGERS = ("year_min", "year_max", "max_marks", "difficulty_min", "difficulty_max", "count", "seed")


class RuleError(ValueError):
    """A rule that can't be used."""


@dataclass(frozen=True)
class SelectRules:
    title: str
    syllabus_codes: tuple[str, ...] | None = None
    topic_title: str | None = None
    question_type: str | None = None
    year_min: int | None = None
    year_max: int | None = None
    difficulty_min: int | None = None
    difficulty_max: int | None = None
    max_marks: int | None = None
    exclude_after: str | None = None
    sort: tuple[str, ...] = ("year", "question")
    shuffle: bool = False
    seed: int | None = None
    count: int | None = None
    no_sort: bool = False
    extra: dict[str, Any] = field(default_factory=dict, compare=False)

    @classmethod
    def of(cls, raw: Any) -> SelectRules:
        """Checked rules of a mapping, as a YAML file has it."""
        if not isinstance(raw, dict):
            raise RuleError("rules must be a mapping")
        known = {k: v for k, v in raw.items() if k in cls.__dataclass_fields__ and k != "extra" and v is not None}
        title = str(known.get("title") or "").strip()
        if not title:
            raise RuleError("title is required")
        out: dict[str, Any] = known | {"title": title}
        if "syllabus_codes" in known:
            codes = known["syllabus_codes"]
            if not isinstance(codes, list) or not codes:
                raise RuleError("syllabus_codes must be a list that isn't empty")
            out["syllabus_codes"] = tuple(c for c in (str(x).strip() for x in codes) if c)
        for k in INTEGERS:
            if k in known and (isinstance(known[k], bool) or not isinstance(known[k], int)):
                raise RuleError(f"{k} must be an integer")
        if known.get("count", 0) < 0:
            raise RuleError("count must not be negative")
        if "exclude_after" in known:
            if not isinstance(known["exclude_after"], str) or not known["exclude_after"].strip():
                raise RuleError("exclude_after must be a text that isn't empty")
            out["exclude_after"] = known["exclude_after"].strip()
        if "sort" in known:
            sort = known["sort"]
            if not isinstance(sort, (str, list)) or not sort:
                raise RuleError("sort must be a text or a list that isn't empty")
            fields = sort.split(",") if isinstance(sort, str) else map(str, sort)
            out["sort"] = tuple(s.strip() for s in fields if s.strip())
        for k in ("shuffle", "no_sort"):
            if k in known and not isinstance(known[k], bool):
                raise RuleError(f"{k} must be true or false")
        return cls(**out, extra={k: v for k, v in raw.items() if k not in cls.__dataclass_fields__})

    def predicates(self) -> list[Column]:
        """One Column for each rule that is set; Catalyst orders and pushes them."""
        out = []
        codes = F.coalesce(F.col("syllabus_codes").cast("array<string>"), F.array().cast("array<string>"))
        if self.syllabus_codes:
            out.append(F.arrays_overlap(codes, F.array(*map(F.lit, self.syllabus_codes))))
        if self.exclude_after:
            topic, sub = code_key_of(self.exclude_after)
            cut = F.struct(F.lit(topic).alias("topic"), F.lit(sub).alias("sub"))
            out.append(~F.exists(codes, lambda c: code_key(c) >= cut))
        if self.topic_title:
            out.append(F.exists("topic_titles", lambda t: F.contains(F.lower(t), F.lit(self.topic_title.lower()))))
        if self.question_type:
            out.append(F.lower(F.coalesce("question_type", F.lit(""))) == self.question_type.lower())
        for bound, column, up in (("year_min", "year", False), ("year_max", "year", True), ("difficulty_min", "difficulty", False), ("difficulty_max", "difficulty", True), ("max_marks", "marks", True)):
            limit = getattr(self, bound)
            if limit is not None:
                out.append(F.col(column) <= limit if up else F.col(column) >= limit)
        return out

    def order(self) -> list[Column]:
        """Sort columns; what isn't a number sorts as text, and ties by where the record came from."""
        if self.shuffle:
            return [F.md5(F.concat_ws(":", "id", F.lit(str(self.seed))))]
        if self.no_sort:
            return [F.col("_path")]
        kinds = {"question": question_key(F.col("question")), "year": F.coalesce("year", F.lit(-1)), "marks": F.coalesce("marks", F.lit(-1))}
        return [*(kinds.get(s, F.coalesce(F.nullif(F.col(s).cast("string"), F.lit("0")), F.lit(""))) for s in self.sort if s), F.col("_path")]


def select(records: DataFrame, rules: SelectRules) -> DataFrame:
    """Filter, keep the first record of each id by path, sort, limit. The order is the last column, ord."""
    kept = records
    for p in rules.predicates():
        kept = kept.filter(p)
    unique = first_by(kept, ["id"], [F.col("_path")])
    ranked = unique.orderBy(*rules.order())
    return ranked.limit(rules.count) if rules.count else ranked
