"""Texts composed of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def said(*parts) -> Column:
    """Parts as one text; columns as they are, anything else as a literal."""
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def joined(lines: Column, by: str = "\n") -> Column:
    """(place, text) structs as one text."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(lines)), lambda s: s["text"]), by)
