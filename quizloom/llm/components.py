"""Connected components by joins: labels fall to the smallest neighbour, then jump to their label's label.

A node that very many links meet at, and a root that very many nodes have, are heavy. There are at most HEAVY
of either, so the list of them is broadcast; what a heavy one is joined with is dealt over SALTS tasks, and
its own row stands in each of them. What is learnt is added up before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

HEAVY, SALTS, LIGHT = 1000, 64, 500  #: most heavy keys; tasks for each; rows that any key may have in one task


def heavy(rows: DataFrame, key: str, total: int) -> DataFrame:
    """The keys of more than one in HEAVY of the rows, hence at most HEAVY."""
    counts = rows.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > max(LIGHT, total // HEAVY))
    return F.broadcast(counts.select(key, F.lit(True).alias("_heavy")))


def dealt(rows: DataFrame, hot: DataFrame, key: str, by: str) -> DataFrame:
    salt = F.when(F.col("_heavy"), F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).otherwise(0)
    return rows.join(hot, key, "left").withColumn("_salt", salt).drop("_heavy")


def copied(rows: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    salts = F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return rows.join(hot, key, "left").withColumn("_salt", F.explode(salts)).drop("_heavy")


def lowest(rows: DataFrame, key: str, value: Column) -> DataFrame:
    return rows.groupBy(key).agg(F.min(value).alias("low"))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links (a, b): the smallest node that each linked node reaches, as (node, root). Each round halves the longest way to a root.

    A round writes its labels to the shared folder; only counts come to the driver."""
    edges = materialize(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).filter("a <> b").distinct(), "edges")
    n = edges.count()
    if not n:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    labels = materialize(lowest(edges, "a", F.col("b")).select(F.col("a").alias("node"), F.least("a", "low").alias("root")), "labels")
    hubs = materialize(heavy(edges, "b", n), "hubs")  # the links don't change
    spread = dealt(edges, F.broadcast(hubs), "b", "a")
    for _ in range(rounds):
        known = copied(labels.select(F.col("node").alias("b"), F.col("root").alias("near")), F.broadcast(hubs), "b")
        heard = lowest(spread.join(known, ["b", "_salt"]), "a", F.col("near")).select(F.col("a").alias("node"), F.col("low").alias("near"))
        # the root of a node hears what the node has heard, so that whole trees hook onto smaller ones
        lower = labels.join(heard, "node").select("node", "root", F.least("root", "near").alias("next"))
        hooks = lowest(lower.filter("next < root"), "root", F.col("next")).select(F.col("root").alias("node"), F.col("low").alias("hook"))
        hooked = materialize(lower.join(hooks, "node", "left").select("node", "root", F.least("next", F.coalesce("hook", "next")).alias("next")), "hooked")
        roots = heavy(hooked, "next", n)
        jump = copied(hooked.select(F.col("node").alias("next"), F.col("next").alias("far")), roots, "next")
        moved = dealt(hooked, roots, "next", "node").join(jump, ["next", "_salt"]).select("node", F.least("next", "far").alias("root"), (F.least("next", "far") < F.col("root")).alias("moved"))
        fresh = materialize(moved, "labels")
        discard(labels)
        discard(hooked)
        labels = fresh
        if labels.filter("moved").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    discard(edges)
    discard(hubs)
    return labels.select("node", "root")
