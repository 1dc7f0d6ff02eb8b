"""Operator 8: near-duplicate embeddings by NN-descent.

Equal vectors are one node. The neighbour graph begins in the leaves of random-projection trees, as many
as find a pair at the threshold with probability START; leaves that are too full are split by as many
further planes as their size asks for, in as many more trees as these need. A cell that no plane splits is
dealt by hash, otherwise in every tree, and its parts are then bridged: all pairs of the cell that are not
yet in one component are compared. Rounds then join the lists with each other:
neighbours of neighbours that are not yet in one component are compared and enter the lists. A list that is
saturated, its last entry being above the threshold, is twice as long in the next round; others keep their length. A leaf gives
a spanning forest of all its links and for each node the nearest one outside its own component, so that a
dense group does not fill its lists with itself. Rounds end when none adds a link between components.

The recall is audited on a sample of AUDIT nodes against all others. While the audit misses a pair, more trees are grown, FORESTS
times; then all pairs that still lie between components are compared, block by block, so that no graph with a known gap is returned.

Only links above the threshold are kept. Lists serve to find what hangs together; the links of a vector
are then counted exactly inside its component, block against block, so saturated or cut lists lose none
and no pairs of a dense group are emitted.

Vectors that are null, empty or zero, hold null or non-finite parts or another dimension than most of a
sample link with nothing and are their own components. Rows without an id are left as they are, each its
own component. Repeated rows are vectors of their own. An empty table gives an empty result; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .components import components
from .neighbours import digests, element, usable, vectors_of

THRESHOLD = 0.9
START = 0.999  #: chance that the trees bring a pair at the threshold into one leaf
LEAF, FULL = 256, 1024  #: nodes wanted in a leaf, and most of them
LIST, EXPLORE = 8, 0.6  #: length of a list; the least cosine of its entries
AUDIT, FORESTS = 200, 3
BLOCK = 512
EXTRA = 12  #: more planes for leaves that are too full


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def forest(n: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Planes a tree and trees for n nodes."""
    planes = max(0, round(math.log2(max(n, 1) / LEAF)))
    return planes, trees_for(planes, threshold)


def trees_for(planes: int, threshold: float) -> int:
    together = (1 - math.acos(threshold) / math.pi) ** planes
    return 1 if together > START else math.ceil(math.log(1 - START) / math.log(1 - together))


CELL = ["tree", "leaf", "more"]


def grow(nodes: DataFrame, dim: int, planes: int, trees: int, seed: int, start: int = 0) -> DataFrame:
    """A row for each node and tree: the leaf by the first planes, and the signs of as many further ones (extra) as a leaf that is too full needs."""

    def run(batches):
        normal = np.random.default_rng(seed).standard_normal((dim, trees * (planes + EXTRA)))
        weight = 1 << np.arange(max(planes, EXTRA))
        for batch in batches:
            x = vectors_of(batch.column("embedding"), dim, np.float64)
            sign = (x @ normal > 0).reshape(len(x), trees, planes + EXTRA)
            leaf = (sign[:, :, :planes] * weight[:planes]).sum(axis=2)
            more = (sign[:, :, planes:] * weight[:EXTRA]).sum(axis=2)
            which = pa.array(np.repeat(np.arange(len(x)), trees))
            yield pa.RecordBatch.from_arrays(
                [batch.column("name").take(which), pa.array(np.tile(np.arange(start, start + trees), len(x))), pa.array(leaf.ravel().astype(np.int64)), pa.array(more.ravel().astype(np.int64))],
                names=["name", "tree", "leaf", "more"],
            )

    keys = materialize(nodes.select("name", "embedding").mapInArrow(run, "name binary, tree long, leaf long, more long"), "leaves")
    full = keys.groupBy("tree", "leaf").count().filter(F.col("count") > FULL)
    full = full.select("tree", "leaf", F.greatest(F.lit(1), F.least(F.lit(EXTRA), F.ceil(F.log2(F.col("count") / LEAF)))).cast("int").alias("extra"))
    keys = keys.join(full, ["tree", "leaf"], "left")
    return keys.withColumn("more", F.when(F.col("extra").isNotNull(), F.expr("more & (shiftleft(1L, extra) - 1)")).otherwise(F.lit(-1)))


def leaf_keys(nodes: DataFrame, dim: int, planes: int, trees: int, seed: int, threshold: float) -> DataFrame:
    """The cells of every node, and the parts of cells that stay too full. Leaves that are too full stand in more trees, as their planes are more."""
    keys = grow(nodes, dim, planes, trees, seed)
    deepest = keys.agg(F.max("extra")).first()[0]
    more = math.ceil(trees * trees_for(planes + deepest, threshold) / trees_for(planes, threshold)) - trees if deepest else 0
    if more > 0:
        keys = keys.union(grow(nodes, dim, planes, more, seed + 1000, trees).filter("extra is not null"))
    dense = keys.filter("more >= 0").groupBy(CELL).count().filter(F.col("count") > FULL)
    keys = keys.drop("extra").join(dense.select(*CELL, F.ceil(F.col("count") / FULL).alias("parts")), CELL, "left")
    part = F.pmod(F.xxhash64("name", "tree", F.lit(seed)), F.col("parts"))
    return materialize(keys.withColumn("part", F.when(F.col("parts").isNotNull(), part).otherwise(F.lit(0))).select("name", *CELL, "parts", "part"), "cells")


def spanning(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A spanning forest of a symmetric matrix of links: each node's way to its parent, and the component of every node."""
    group = np.arange(len(linked))
    seen = ~linked.any(axis=1)
    child, parent = [], []
    for start in range(len(linked)):
        if seen[start]:
            continue
        seen[start] = True
        front = np.array([start])
        while len(front):
            reach = linked[front] & ~seen
            fresh = np.flatnonzero(reach.any(axis=0))
            child.append(fresh)
            parent.append(front[reach[:, fresh].argmax(axis=0)])
            seen[fresh], group[fresh] = True, start
            front = fresh
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *child]), np.concatenate([none, *parent]), group


def compare(rows: pa.Table, dim: int, threshold: float) -> pa.Table:
    """The lists of the nodes of some leaves: the nearest of each, the nearest outside its component of the leaf, and a spanning forest of what is above the threshold."""
    rows = rows.sort_by([(c, "ascending") for c in ("tree", "leaf", "more", "part")])
    key = np.stack([rows.column(c).to_numpy() for c in ("tree", "leaf", "more", "part")])
    x = unit(vectors_of(rows.column("embedding"), dim, np.float64))
    begins = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)])
    one, two, cosine = [], [], []
    for first, last in zip(begins, np.r_[begins[1:], len(x)]):
        own = x[first:last]
        c = own @ own.T
        np.fill_diagonal(c, -1)
        if not (c >= EXPLORE).any():
            continue
        k = min(LIST, len(own) - 1)
        near = np.argpartition(-c, k - 1, axis=1)[:, :k]
        i = np.repeat(np.arange(len(own)), k)
        j = near.ravel()
        child, parent, group = spanning(c >= threshold)
        far = np.where(group[:, None] == group[None], -1, c).argmax(axis=1)  # a list that its own component fills still reaches beyond it
        i, j = np.r_[i, child, np.arange(len(own))], np.r_[j, parent, far]
        i, j = i[i != j], j[i != j]
        keep = c[i, j] >= EXPLORE
        i, j = i[keep], j[keep]
        a, b = np.minimum(i, j), np.maximum(i, j)
        pair = np.unique(a * len(own) + b)
        a, b = pair // len(own), pair % len(own)
        one.append(a + first)
        two.append(b + first)
        cosine.append(c[a, b])
    one, two, cosine = (np.concatenate(v) if v else np.zeros(0) for v in (one, two, cosine))
    names = rows.column("name")
    return pa.table([names.take(pa.array(one.astype(np.int64))), names.take(pa.array(two.astype(np.int64))), pa.array(cosine.astype(np.float64))], names=["a", "b", "cosine"])


EDGES = "a binary, b binary, cosine double"


def ordered(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cosine").groupBy("a", "b").agg(F.max("cosine").alias("cosine"))


def cosines(pairs: DataFrame, nodes: DataFrame, dim: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            x, y = (unit(vectors_of(batch.column(c), dim, np.float64)) for c in ("x", "y"))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array((x * y).sum(axis=1))], names=["a", "b", "cosine"])

    left, right = (nodes.select(F.col("name").alias(k), F.col("embedding").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, EDGES)


def labels_of(edges: DataFrame, threshold: float) -> DataFrame:
    return components(edges.filter(F.col("cosine") >= threshold))


def descend(edges: DataFrame, nodes: DataFrame, dim: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Rounds of joins of the lists with themselves; the edges and the components of the links."""
    length = LIST
    while True:  # each round that goes on has joined components
        labels = labels_of(edges, threshold)
        both = edges.select("a", "b", "cosine").union(edges.select(F.col("b"), F.col("a"), "cosine"))
        rooted = both.join(labels.select(F.col("node").alias("b"), "root"), "b", "left").withColumn("root", F.coalesce("root", "b"))
        # a node all of whose list is one component has no news for its neighbours
        mixed = rooted.groupBy("a").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("a")
        # from each component in a list the nearest entries, more of them where the list is saturated
        nearest = rooted.join(mixed, "a").groupBy("a", "root").agg(F.sort_array(F.collect_list(F.struct("cosine", "b")), False).alias("l"))
        saturated = F.coalesce(F.get("l", F.lit(LIST - 1))["cosine"] >= threshold, F.lit(False))
        nearest = nearest.withColumn("l", F.slice("l", F.lit(1), F.when(saturated, length).otherwise(LIST)))
        lists = materialize(nearest.select("a", "root", F.explode("l").alias("e")).select(F.col("a").alias("via"), "root", F.col("e.b").alias("node")), "lists")
        other = lists.select("via", F.col("root").alias("other_root"), F.col("node").alias("other"))
        met = lists.join(other, "via").filter((F.col("root") != F.col("other_root")) & (F.col("node") < F.col("other")))
        pairs = met.select(F.col("node").alias("a"), F.col("other").alias("b")).distinct().join(edges.select("a", "b"), ["a", "b"], "left_anti")
        found = materialize(cosines(pairs, nodes, dim).filter(F.col("cosine") >= EXPLORE), "found")
        settled = found.filter(F.col("cosine") >= threshold).isEmpty()
        edges = materialize(ordered(edges.union(found)), "edges")
        for done in (lists, found):
            discard(done)
        if settled:
            return edges, labels
        length *= 2


def bridge(cells: DataFrame, labels: DataFrame, nodes: DataFrame, dim: int, threshold: float) -> DataFrame:
    """Links between components that share a cell: all its pairs that are not yet in one component are compared, block by block.

    A component that fills blocks has its own, which never meet each other; the others of the cell share blocks."""
    rooted = cells.join(labels, cells.name == labels.node, "left").select("name", *CELL, F.coalesce("root", "name").alias("root"))
    roots = rooted.groupBy(*CELL, "root").agg(F.count("*").alias("size"), (F.count("*") > FULL).alias("large"))
    split = roots.groupBy(CELL).agg(F.count("*").alias("roots"), F.sum(F.when(~F.col("large"), F.col("size"))).alias("few")).filter("roots > 1")
    facts = roots.join(split, CELL).select(*CELL, "root", F.when(F.col("large"), F.col("root")).otherwise(F.lit(b"")).alias("owner"), F.ceil(F.when(F.col("large"), F.col("size")).otherwise(F.col("few")) / FULL).alias("blocks"))
    dealt = materialize(rooted.join(facts, [*CELL, "root"]).withColumn("unit", F.struct("owner", F.pmod(F.xxhash64("name"), F.col("blocks")).alias("block"))).select("name", "root", *CELL, "unit"), "dealt")
    units = dealt.select(*CELL, "unit").distinct()
    both = units.withColumnRenamed("unit", "x").join(units.withColumnRenamed("unit", "y"), CELL)
    both = both.filter((F.col("x") <= F.col("y")) & ((F.col("x.owner") != F.col("y.owner")) | (F.col("x.owner") == F.lit(b""))))
    left = dealt.join(both, CELL).filter((F.col("unit") == F.col("x")) | (F.col("unit") == F.col("y")))
    placed = left.join(nodes.select("name", "embedding"), "name")

    def run(rows):
        v = unit(vectors_of(rows.column("embedding"), dim, np.float64))
        root = np.unique(np.array(rows.column("root").to_pylist(), object), return_inverse=True)[1]
        c = v @ v.T
        i, j, _ = spanning((c >= threshold) & (root[:, None] != root[None]))
        names = rows.column("name")
        return pa.table([names.take(pa.array(i)), names.take(pa.array(j)), pa.array(c[i, j])], names=["a", "b", "cosine"])

    return placed.select("name", "root", "embedding", *CELL, "x", "y").groupBy(*CELL, "x", "y").applyInArrow(run, EDGES)


def audit(nodes: DataFrame, labels: DataFrame, dim: int, threshold: float, seed: int = 0) -> tuple[int, int]:
    """Of a bounded sample, the pairs above the threshold, and those of them in different components."""
    rooted = nodes.join(labels, nodes.name == labels.node, "left").select("name", "embedding", F.coalesce("root", "name").alias("root"))
    sample = rooted.orderBy(F.xxhash64("name", F.lit(seed)), "name").limit(AUDIT).toArrow()
    probe = (unit(vectors_of(sample.column("embedding"), dim, np.float64)), np.array(sample.column("root").to_pylist(), object), np.array(sample.column("name").to_pylist(), object))
    shared = nodes.sparkSession.sparkContext.broadcast(probe)  # at most AUDIT vectors

    def run(batches):
        x, roots, own = shared.value
        for batch in batches:
            y = unit(vectors_of(batch.column("embedding"), dim, np.float64))
            hit = (y @ x.T >= threshold) & (np.array(batch.column("name").to_pylist(), object)[:, None] != own[None])
            apart = hit & (np.array(batch.column("root").to_pylist(), object)[:, None] != roots[None])
            yield pa.RecordBatch.from_arrays([pa.array([int(hit.sum())]), pa.array([int(apart.sum())])], names=["hits", "missed"])

    got = rooted.mapInArrow(run, "hits long, missed long").agg(F.coalesce(F.sum("hits"), F.lit(0)), F.coalesce(F.sum("missed"), F.lit(0))).first()
    return int(got[0]), int(got[1])


def count_links(rows: pa.Table, dim: int, threshold: float) -> pa.Table:
    """For each node of some components, or of two blocks of a large one, how many vectors of the other side it links with."""
    rows = rows.sort_by([(c, "ascending") for c in ("root", "x", "y", "side")])
    key = np.array(rows.column("root").to_pylist(), object)
    place = np.stack([rows.column(c).to_numpy() for c in ("x", "y")])
    side = rows.column("side").to_numpy()
    weight = rows.column("size").to_numpy().astype(np.float64)
    v = unit(vectors_of(rows.column("embedding"), dim, np.float64))
    begins = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (place[:, 1:] != place[:, :-1]).any(axis=0)]) if len(v) else np.zeros(0, int)
    links = np.zeros(len(v))
    for first, last in zip(begins, np.r_[begins[1:], len(v)]):
        if place[0, first] == place[1, first]:
            own = v[first:last] @ v[first:last].T >= threshold
            np.fill_diagonal(own, False)
            links[first:last] = own @ weight[first:last]
        else:
            middle = first + int(np.count_nonzero(side[first:last] == 0))
            own = v[first:middle] @ v[middle:last].T >= threshold
            links[first:middle] = own @ weight[middle:last]
            links[middle:last] = weight[first:middle] @ own
    return pa.table([rows.column("name"), pa.array(links.astype(np.int64))], names=["name", "links"])


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding")
    valid = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    alone = lambda r: r.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    sizes = [r["n"] for r in valid.select(F.size("embedding").alias("n"), F.xxhash64("vec_id").alias("h")).orderBy("h").limit(1000).collect()]
    if not sizes:
        return alone(rows)
    dim = int(np.bincount(sizes).argmax())
    ok = F.col("vec_id").isNotNull() & usable(F.col("embedding")) & (F.size("embedding") == dim)
    rest = alone(rows.filter(~F.coalesce(ok, F.lit(False))))

    def name(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), digests(batch.column("embedding"), dim), batch.column("embedding")], names=["vec_id", "name", "embedding"])

    named = rows.filter(ok).mapInArrow(name, f"vec_id long, name binary, embedding array<{element(rows)}>")
    named = materialize(named, "named")
    nodes = materialize(named.groupBy("name").agg(F.count("*").alias("size"), F.min("vec_id").alias("low"), F.first("embedding").alias("embedding")), "nodes")
    n = nodes.count()
    planes, trees = forest(n, threshold)

    def bridged(edges: DataFrame, labels: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
        across = materialize(bridge(cells, labels, nodes, dim, threshold), "across")
        if across.isEmpty():
            return edges, labels
        edges = materialize(ordered(edges.union(across)), "edges")
        return edges, labels_of(edges, threshold)

    edges = None
    for grown in range(FORESTS):
        keys = leaf_keys(nodes, dim, planes, trees << grown, 11 + grown, threshold)
        placed = keys.drop("parts").join(nodes.select("name", "embedding"), "name")
        tasks = max(1, n * (trees << grown) // 20_000)
        task = F.pmod(F.xxhash64("tree", "leaf", "more", "part"), F.lit(tasks)).alias("task")
        fresh = placed.groupBy(task).applyInArrow(lambda r: compare(r, dim, threshold), EDGES)
        edges = materialize(ordered(fresh if edges is None else edges.union(fresh)), "edges")
        edges, labels = descend(edges, nodes, dim, threshold)
        dense = keys.filter("parts is not null").select("name", *CELL)
        if not dense.isEmpty():
            edges, labels = bridged(edges, labels, dense)
        _, missed = audit(nodes, labels, dim, threshold, grown)
        if not missed:
            break
    else:
        edges, labels = bridged(edges, labels, nodes.select("name", *[F.lit(0).cast("long").alias(c) for c in CELL]))

    # exact counts inside the components
    rooted = labels.join(nodes, labels.node == nodes.name).select("root", "name", "size", "embedding")
    blocks = labels.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = rooted.join(blocks, "root").withColumn("own", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("root", "name", "size", "embedding", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    task = F.pmod(F.xxhash64("root", "x", "y"), F.lit(max(8, n // 5000))).alias("task")
    links = dealt.groupBy(task).applyInArrow(lambda r: count_links(r, dim, threshold), "name binary, links long").groupBy("name").agg(F.sum("links").alias("links"))

    lowest = labels.join(nodes.select("name", "low"), labels.node == nodes.name).groupBy("root").agg(F.min("low").alias("component_id"))
    known = labels.join(lowest, "root").select(F.col("node").alias("name"), "component_id")
    facts = nodes.select("name", "size", "low").join(known, "name", "left").join(links, "name", "left")
    facts = facts.select("name", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "low").alias("component_id"))
    out = named.select("vec_id", "name").join(facts, "name").select("vec_id", F.col("n_links").cast("long"), "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return out.unionByName(rest)
