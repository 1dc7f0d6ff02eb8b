"""Data-quality audit: each gate is a plan of findings (id, code, detail); their union is rolled up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed: topics of practical papers, least size and height of a clip.
PRACTICAL_TOPICS = ["Titrations", "Thermometric experiments", "Gravimetric experiments", "Gas volume experiments", "Rate experiments", "Qualitative analysis"]
LEAST_BYTES, LEAST_HEIGHT = 3000, 80
TEXT_GATES = {
    "footer_leak": r"(?im)©\s*UCLES|Page \d+ of \d+|\[Turn over",
    "bad_arrow": "[\uf0ae\uf0d7\u2261]",
    "pua_chars": "[\ue000-\uf8ff]",
    "control_chars": r"[\x00-\x08\x0b\x0c\x0e-\x1f]",
    "glued_words": r"(?i)\bthestatements\b|\bresponsesA\s*toD\b|\band3\b",
    "broken_ion_charge": r"\][ \t]*\n[ \t]*[+-]",
}


def finding(rows: DataFrame, code: str, when: Column, detail: Column | None = None) -> DataFrame:
    return rows.filter(when).select("id", F.lit(code).alias("code"), (F.lit("") if detail is None else F.coalesce(detail, F.lit(""))).alias("detail"))


def text_findings(notes: DataFrame, gates: dict[str, str] | None = None, column: str = "body") -> DataFrame:
    """All text gates in one pass: an array of the codes that hit, exploded."""
    gates = TEXT_GATES if gates is None else gates
    hits = F.array_compact(F.array(*[F.when(F.col(column).rlike(p), F.struct(F.lit(c).alias("code"), F.left(F.regexp_extract(column, f"({p})", 1), F.lit(40)).alias("detail"))) for c, p in gates.items()]))
    return notes.select("id", F.explode(hits).alias("f")).select("id", "f.code", "f.detail")


def record_findings(notes: DataFrame) -> DataFrame:
    practical = F.coalesce(F.lower("question_type") == "practical", F.lit(False))
    topic = F.trim(F.coalesce("practical_topic", F.lit("")))
    lines = F.filter(F.split("body", "\n"), lambda x: (F.trim(x) != "") & ~F.startswith(F.trim(x), F.lit("![[")))
    return reduce(DataFrame.unionByName, [
        finding(notes, "empty_LO", ~practical & (F.size(F.coalesce("learning_outcomes", F.array().cast("array<string>"))) == 0)),
        finding(notes, "empty_practical_topic", practical & (topic == "")),
        finding(notes, "unknown_practical_topic", practical & (topic != "") & ~topic.isin(PRACTICAL_TOPICS), topic),
        finding(notes, "empty_question_body", F.size(lines) == 0),
        finding(notes, "invented_facility", F.col("facility").isNotNull() | F.col("percent_correct").isNotNull()),
    ])


def vocabulary_findings(notes: DataFrame, codes: DataFrame, outcomes: DataFrame) -> DataFrame:
    out = []
    for column, known, code in (("syllabus_codes", codes, "unknown_code"), ("learning_outcomes", outcomes, "unknown_LO")):
        values = notes.select("id", F.explode(column).alias("detail"))
        out.append(values.join(known.select(F.col(known.columns[0]).alias("detail")), "detail", "left_anti").select("id", F.lit(code).alias("code"), "detail"))
    return out[0].unionByName(out[1])


def file_findings(notes: DataFrame, files: DataFrame, kind: str = "paper") -> DataFrame:
    """Missing and tiny clips, by a listing of files."""
    want = notes.select("id", F.concat(F.lit("assets/"), F.col("id"), F.lit(f"-{kind}.png")).alias("path"), "body")
    have = want.join(files, "path", "left")
    embed = F.contains("body", F.concat(F.lit("![["), F.col("path"), F.lit("]]")))
    small = (F.col("size") < LEAST_BYTES) | F.coalesce(F.col("height") < LEAST_HEIGHT, F.lit(False))
    parts = [finding(have, f"missing_{kind}_png", F.col("size").isNull()), finding(have, f"missing_{kind}_embed", ~F.coalesce(embed, F.lit(False)))]
    if kind == "paper":
        parts.append(finding(have, "tiny_paper_png", small, F.concat(F.col("size").cast("string"), F.lit(" bytes"))))
    return reduce(DataFrame.unionByName, parts)


def by_code(findings: DataFrame) -> DataFrame:
    return findings.groupBy("code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "code")


def summary(notes: DataFrame, findings: DataFrame) -> DataFrame:
    """Checked, failed (with any finding) and passed."""
    failed = findings.agg(F.count_distinct("id").alias("failed"))
    return notes.agg(F.count("*").alias("checked")).join(failed).select("checked", "failed", (F.col("checked") - F.col("failed")).alias("passed"))
