"""Keyed operators that the engine's plans are built of: first and last of a key, patches, ordered distinct values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


MOST_NAMES = 1000  #: names that may be looked for inside others


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key. row_number with a limit of 1 is cut on the map side before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def latest_by(df: DataFrame, keys: Sequence[str], stamps: Sequence[str]) -> DataFrame:
    """Last write wins: the row of each key with the greatest stamps."""
    return first_by(df, keys, [F.col(s).desc_nulls_last() for s in stamps])


def top_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each key with their rank."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def patch(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Upsert that keeps what the new row leaves empty: full outer join, non-empty new values first."""
    a, b = old.alias("a"), new.alias("b")
    joined = a.join(b, list(keys), "full")
    kinds = dict(old.dtypes)

    def value(c: str) -> Column:
        if c not in new.columns:
            return F.col(f"a.{c}").alias(c)
        fresh = F.nullif(F.col(f"b.{c}"), F.lit("")) if kinds[c] == "string" else F.col(f"b.{c}")
        return F.coalesce(fresh, F.col(f"a.{c}")).alias(c)

    return joined.select(*keys, *[value(c) for c in old.columns if c not in keys])


def find_or_create(known: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of seen that known lacks."""
    return seen.select(*keys).distinct().join(known.select(*keys), list(keys), "left_anti")


def distinct_in_order(df: DataFrame, value: Column, order: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct values with the first place of each, by key if there are any."""
    return df.select(*keys, value.alias("value"), order.alias("ord")).groupBy(*keys, "value").agg(F.min("ord").alias("ord"))


def numbered(df: DataFrame, order: Sequence[Column], name: str = "seq", bucket: Column | None = None) -> DataFrame:
    """Continuous numbers over the whole order without a window in one task: each bucket (a leading part of the order) is
    numbered alone and moved by the sizes of the buckets before it."""
    if bucket is None:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))
    df = df.withColumn("_bucket", bucket)
    within = df.withColumn("_n", F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)).cast("long"))
    sizes = df.groupBy("_bucket").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    moved = sizes.select("_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    return within.join(moved, within._bucket.eqNullSafe(moved._bucket)).drop(moved._bucket).withColumn(name, F.col("_before") + F.col("_n")).drop("_n", "_before", "_bucket")


def search(df: DataFrame, columns: Sequence[Column], text: str, order: Sequence[Column], limit: int = 200) -> DataFrame:
    """The first rows any of whose columns holds the text, whatever its case; columns are joined by blanks."""
    hay = F.lower(F.concat_ws(" ", *columns))
    return df.filter(F.contains(hay, F.lit(text.strip().lower()))).orderBy(*order).limit(limit)


def first_existing(wanted: DataFrame, candidates: Column, files: DataFrame, key: str, path: str = "path") -> DataFrame:
    """(key, path): of each row's candidate paths, in their order, the first that the listing has. Paths that climb out of their root are none."""
    rows = wanted.select(key, F.posexplode(candidates).alias("pos", path)).filter(~F.col(path).rlike(r"(^|/)\.\.(/|$)"))
    return rows.join(files.select(path).distinct(), path).groupBy(key).agg(F.min_by(path, "pos").alias(path))


def resolved_names(asked: DataFrame, files: DataFrame) -> DataFrame:
    """(asked, path): for each name asked for the file that is meant, of files (path, place of its folder): the path itself, else the first whose
    stem it is, else the first whose stem holds it, folder by folder and by name; names that nothing fits are left out.

    Exact names are met by key. Only the names that are left, a question's few, are looked for inside all stems."""
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    known = files.select("path", "place", stem.alias("stem"))
    wanted = asked.select("asked").distinct()
    exact = wanted.join(known, F.col("asked") == F.col("path")).select("asked", "path", F.lit(1).alias("rank"), "place")
    same = wanted.join(known, F.col("asked") == F.col("stem")).select("asked", "path", F.lit(2).alias("rank"), "place")
    met = exact.unionByName(same)
    rest = wanted.join(met.select("asked").distinct(), "asked", "left_anti").filter("asked <> ''")
    if rest.limit(MOST_NAMES + 1).count() > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} names are neither a path nor a stem")
    inside = known.join(F.broadcast(rest), F.contains("stem", "asked")).select("asked", "path", F.lit(3).alias("rank"), "place")
    return first_by(met.unionByName(inside), ["asked"], [F.col("rank"), F.col("place"), F.col("path")]).select("asked", "path")
