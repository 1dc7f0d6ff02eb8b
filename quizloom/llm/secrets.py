"""Operator 1: secret scans with Spark's own functions only.

Three fixed patterns give the base spans. What they cover is blanked, kind after kind, and every run of
token characters that is left is a candidate: a window slides over it, the counts of its character class
(hex of either case, or base64) change by the character that enters and the one that leaves, and with them
the sum of c * log2(c), so each step costs one update and no recount. A candidate whose best window
reaches the class's entropy is a span, unless the allow-list knows its shape (identifiers, paths, plain
words or numbers). Placeholder words inside a candidate are cut out first: no window covers any of them.

Positions are code points, ends exclusive. They are running sums over the pieces between the matches, made in
two levels, so time grows with the length of a text and the number of its matches, however long or many
they are. Texts without an occurrence are only searched.

Nulls and empty texts have no spans. Rows are independent: repeated rows and ties change nothing; an
empty table gives an empty result. report() ignores further columns; redact() keeps all columns as they are, and
scan() adds two under names that no column of the input has.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free

#: The patterns of the three kinds, the group and the length that a match needs.
KINDS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}
#: What a text must hold for a kind's pattern to be tried.
HINTS = {"assign": r"(?i)password|passwd|secret|token|api_?key", "access": "AKIA", "hex": r"[0-9a-f]{32}"}

WINDOW = 20
#: Character class: kind of span, alphabet, bits of entropy that a window must reach.
CLASSES = {
    "hex": ("entropy_hex", "0123456789abcdef", 3.0),
    "base64": ("entropy_base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 3.7),
}
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
#: Shapes of whole candidates that are no secrets. Possessive, so that a long path needs no stack.
ALLOW = [
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^[0-9_/+-]+$",
    r"^[A-Za-z_/+-]+$",
    r"^(?:[A-Za-z]++[0-9]{0,4}+[/_-])++[A-Za-z]*+[0-9]{0,4}+$",
]
PLACEHOLDER = r"(?i:example|placeholder|xxxxxx|changeme|dummy|abcdefghij)|0123456789"
ORDER = [*KINDS, *(c[0] for c in CLASSES.values())]
SPAN = "struct<start:int,rank:int,end:int,hit:string>"
STRIDE = 256  #: elements of a running value that are folded one after another


def running(values: Column, op) -> Column:
    """For each element what op makes of 0 and all elements before it: folded stride by stride, then over the strides."""
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, v: Column) -> Column:
        return F.struct(op(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    strides = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / STRIDE).cast("int")), lambda k: F.slice(values, k * STRIDE + 1, F.lit(STRIDE)))
    inner = F.transform(strides, lambda part: F.aggregate(part, none, step))
    # bound to a variable, so that it is made once
    both = F.transform(F.array(inner), lambda i: F.flatten(F.zip_with(i, F.aggregate(i, none, lambda acc, one: step(acc, one["at"]))["out"], lambda one, before: F.transform(one["out"], lambda v: op(before, v)))))
    return F.when(F.size(values) > 0, F.get(both, F.lit(0))).otherwise(F.array().cast("array<int>"))


def matched(text: Column, pattern: str, group: int, hint: str) -> Column:
    """The pieces of a text: what is before each match, the match and its group; the last one has no match. Null where the hint doesn't occur."""
    return F.when(text.rlike(hint), F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("own"),
    ))


def located(parts: Column, rank: int, least: int) -> Column:
    """Spans of the matches whose group has the least length."""
    sizes = F.transform(parts, lambda p: F.length(p["gap"]) + F.coalesce(F.length(p["hit"]), F.lit(0)))
    span = lambda p, at: F.struct((at + F.length(p["gap"])).alias("start"), F.lit(rank).alias("rank"), (at + F.length(p["gap"]) + F.length(p["hit"])).alias("end"), F.when(F.length(p["own"]) >= least, p["hit"]).alias("hit"))
    found = F.filter(F.zip_with(parts, running(sizes, lambda a, b: a + b), span), lambda s: s["hit"].isNotNull())
    return F.coalesce(found, F.array()).cast(f"array<{SPAN}>")


def blanked(parts: Column, text: Column, least: int) -> Column:
    """The text with blanks for those matches."""
    piece = lambda p: F.concat(p["gap"], F.when(F.length(p["own"]) >= least, F.repeat(F.lit(" "), F.length(p["hit"]))).otherwise(F.coalesce(p["hit"], F.lit(""))))
    return F.coalesce(F.array_join(F.transform(parts, piece), ""), text)


def best_window(text: Column, alphabet: str, window: int = WINDOW) -> Column:
    """The highest entropy of a window over the text; characters outside the alphabet count as one more symbol."""
    size = len(alphabet) + 1
    term = lambda c: F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(0.0)
    start = F.struct(F.array_repeat(F.lit(0), size).alias("counts"), F.lit(0).alias("n"), F.lit(0.0).cast("double").alias("sum"), F.lit(-1.0).cast("double").alias("best"))

    def step(acc: Column, at: Column) -> Column:
        enters, leaves, n = at["enters"], at["leaves"], acc["n"] + 1
        c_in, c_out = F.get(acc["counts"], enters), F.get(acc["counts"], leaves)
        more = F.when(leaves == enters, 0.0).otherwise(term(c_in + 1) - term(c_in))
        less = F.when((leaves < 0) | (leaves == enters), 0.0).otherwise(term(c_out - 1) - term(c_out))
        total = acc["sum"] + more + less
        counts = F.when(leaves == enters, acc["counts"]).otherwise(F.transform(acc["counts"], lambda v, k: v + (k == enters).cast("int") - (k == leaves).cast("int")))
        entropy = F.when(n >= window, F.lit(math.log2(window)) - total / window).otherwise(-1.0)
        return F.struct(counts.alias("counts"), n.alias("n"), total.alias("sum"), F.greatest(acc["best"], entropy).alias("best"))

    symbols = F.transform(F.split(text, ""), lambda c: F.call_function("instr", F.lit(alphabet), c))
    slid = F.transform(F.array(symbols), lambda s: F.aggregate(
        F.zip_with(s, F.slice(F.concat(F.array_repeat(F.lit(-1), window), s), F.lit(1), F.size(s)), lambda a, b: F.struct(a.alias("enters"), b.alias("leaves"))), start, step, lambda acc: acc["best"]))
    return F.get(slid, F.lit(0))


def hot(candidate: Column) -> Column:
    """The rank of the class that a candidate is secret in; null if in none."""
    of_hex = candidate.rlike("^[0-9a-fA-F]+$")

    def of_class(name: str, kind: str, alphabet: str, bits: float) -> Column:
        pieces = F.filter(F.split(F.lower(candidate) if name == "hex" else candidate, PLACEHOLDER), lambda p: F.length(p) >= WINDOW)
        return F.when((of_hex if name == "hex" else ~of_hex) & F.exists(pieces, lambda p: best_window(p, alphabet) >= bits), F.lit(ORDER.index(kind)))

    return F.coalesce(*[of_class(name, *spec) for name, spec in CLASSES.items()])


def entropy_spans(text: Column) -> Column:
    found = located(matched(text, CANDIDATE, 0, CANDIDATE), 0, WINDOW)
    allowed = lambda s: F.exists(F.array(*map(F.lit, ALLOW)), lambda p: F.regexp_like(s, p))
    ranked = F.transform(F.filter(found, lambda s: ~allowed(s["hit"])), lambda s: s.withField("rank", hot(s["hit"])))
    return F.filter(ranked, lambda s: s["rank"].isNotNull())


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, ORDER))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with two more columns, and their names: the base spans and all spans, arrays of (start, rank in ORDER, end, hit), sorted."""
    base, spans, body, *kinds = free(docs, "base", "spans", "body", *KINDS)
    out = docs.withColumn(body, F.coalesce("text", F.lit("")))
    out = out.withColumns({c: matched(F.col(body), pattern, group, HINTS[kind]) for c, (kind, (pattern, group, _)) in zip(kinds, KINDS.items())})
    out = out.withColumn(base, F.array_sort(F.concat(*[located(F.col(c), rank, KINDS[kind][2]) for rank, (c, kind) in enumerate(zip(kinds, KINDS))])))
    for rank, (kind, (pattern, group, least)) in enumerate(KINDS.items()):
        parts = F.col(kinds[0]) if not rank else matched(F.col(body), pattern, group, HINTS[kind])
        out = out.withColumn(body, blanked(parts, F.col(body), least))
    out = out.withColumn(spans, F.array_sort(F.concat(base, entropy_spans(F.col(body)))))
    return out.drop(body, *kinds), base, spans


def report(docs: DataFrame) -> DataFrame:
    """Per row the counts of each kind, a digest of the base spans and the list of all spans."""
    found, base, spans = scan(docs.select(F.col("doc_id").cast("long"), "text"))
    count = lambda k: F.size(F.filter(base, lambda s: s["rank"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(listed(F.col(base)), 256).alias("base_sha256"),
        listed(F.col(spans)).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every span of the text replaced by the mark; spans that overlap or touch become one."""
    found, base, spans = scan(docs)
    signs, before = free(found, "signs", "before")
    some = F.size(spans) > 0
    found = found.withColumn(signs, F.when(some, F.split("text", ""))).withColumn(before, F.when(some, running(F.transform(spans, lambda s: s["end"]), F.greatest)))
    apart = lambda s, at: F.when((s["start"] > at) | (at == 0), F.concat(F.array_join(F.slice(F.col(signs), at + 1, F.greatest(s["start"] - at, F.lit(0))), ""), F.lit(mark))).otherwise("")
    last = F.array_max(F.transform(spans, lambda s: s["end"]))
    rest = F.array_join(F.slice(F.col(signs), last + 1, F.greatest(F.size(signs) - last, F.lit(0))), "")
    masked = F.concat(F.array_join(F.zip_with(spans, before, apart), ""), rest)
    return found.withColumn("text", F.when(some, masked).otherwise(F.col("text"))).drop(base, spans, signs, before)
