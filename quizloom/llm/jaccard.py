"""Operator 10: exact n-gram Jaccard join by a blocked sparse product of the document by n-gram incidence.

Rows with the same set of n-grams are one class. Over the classes, the product of the incidence matrix
with its transpose is formed block by block: the entries of a block of classes meet those of another column by column,
a column being an n-gram, and what they share is added up slice by slice of the columns. A pair is kept if
its sum reaches the threshold.

Bounds from the sizes keep most pairs out of the product. The smaller set has at least t times the larger.
With columns ordered from rare to frequent (a corpus count), two sets that are alike share one of each one's
first n - ceil(t * n) + 1 columns, so only pairs that meet in those are multiplied, and of these only pairs of which what
can still overlap from that column on reaches t / (1 + t) of both sizes.

Only which classes hang together is asked for, so no column emits its pairs. First each column links its
entries to its most typical class, and the components of the links that hold are found. Then the columns whose
entries lie in several components are multiplied in blocks of entries, for the pairs across components
alone. No link is lost: every pair of a column is in one component or is counted.

N-grams are 64 bits of hash, which two sets compare only with each other; classes are named by 128 bits.
Nulls and texts without words have no set and link with nothing. Fewer words than an n-gram form one.
Repeated rows, also of one doc_id, are in one class; so are texts of any length, which are read whole. Row
order and ties don't matter. An empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, mix64, ranges, text_parts
from .components import components
from .lm import read_tokens
from .tallies import BLOBS, TOTALS, add_up, answered, bits_for, blobs, from_planes, planes

WORDS, PERCENT = 5, 80
BUCKET_BYTES = 4 << 20
BLOCK = 1024  #: entries of a long column that meet in one task
SLICE = 1 << 20  #: products of entries that are added up at a time


def shingles(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct 64-bit n-gram hashes of every text."""
    flat, n, hashes = read_tokens(texts)
    own = hashes[:, 0][flat]
    grams = own.copy()
    with np.errstate(over="ignore"):
        for k in range(1, words):
            if len(own) > k:
                grams[:-k] = mix64(grams[:-k] * np.uint64(0x9E3779B97F4A7C15) + own[k:])
    out = []
    for first, k in zip(np.cumsum(n) - n, n - 1):  # without the end
        if k >= words:
            out.append(np.unique(grams[first : first + k - words + 1]))
        elif k:
            out.append(np.array([xxhash.xxh3_64_intdigest(own[first : first + k].tobytes())], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def names(sets: list[np.ndarray]) -> list[bytes | None]:
    return [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]


def distinct_sets(texts: list[str]) -> tuple[list[np.ndarray], list[bytes | None], list[int]]:
    """Sets and their names, and the first row of each name in the batch."""
    sets = shingles(texts)
    own, seen = names(sets), {}
    for i, k in enumerate(own):
        if k is not None:
            seen.setdefault(k, i)
    return sets, own, list(seen.values())


def short(keys: np.ndarray, bits: int) -> np.ndarray:
    return keys >> np.uint64(64 - bits)


def count_columns(rows: pa.Table, shards: int, bits: int) -> pa.Table:
    sets, _, first = distinct_sets(rows.column("text").to_pylist())
    keys = np.concatenate([short(sets[i], bits) for i in first] or [np.zeros(0, np.uint64)])
    return blobs(rows.column("bucket")[0].as_py(), [(*np.unique(keys, return_counts=True), None, bits)], shards)


def entries(rows: pa.Table, answers: pa.Table, percent: int, bits: int) -> pa.Table:
    """Per row its set's size and name; once per name, the entries of its first columns and, if any, the set itself."""
    sets, own, first = distinct_sets(rows.column("text").to_pylist())
    _, column = np.unique(np.concatenate([short(sets[i], bits) for i in first] or [np.zeros(0, np.uint64)]), return_inverse=True)
    (total,) = answered(answers, 1)
    often = total[column]
    held: dict[int, tuple] = {}
    end = 0
    for i in first:
        s = sets[i]
        n, start = len(s), end
        end += n
        df = often[start:end]
        reach = n - -(-percent * n // 100) + 1
        if np.count_nonzero(df == 1) >= reach:  # its rarest columns are its own
            continue
        take = np.lexsort((s, df))[:reach]
        shared = np.flatnonzero(df[take] > 1)
        held[i] = (planes(s[take[shared]]), planes(shared), float(df[take[shared]].sum()) / n, planes(np.diff(s, prepend=np.uint64(0))))
    cols = list(zip(*[held.get(i, (None, None, None, None)) for i in range(len(sets))])) or [[], [], [], []]
    return pa.table(
        [rows.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(own, pa.binary()), pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.binary())],
        names=["doc_id", "n_shingles", "name", "columns", "places", "typical", "members"],
    )


ENTRIES = "doc_id long, n_shingles long, name binary, columns binary, places binary, typical double, members binary"
POSTINGS = "gram long, name binary, n long, place long, typical double"


def postings(batches):
    for batch in batches:
        grams, places = ([from_planes(x.as_buffer()).view(np.int64) for x in batch.column(c)] for c in ("columns", "places"))
        take = pa.array(np.repeat(np.arange(len(grams)), [len(g) for g in grams]), pa.int64())
        flat = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (grams, places)]
        name, n, typical = (batch.column(c).take(take) for c in ("name", "n", "typical"))
        yield pa.RecordBatch.from_arrays([flat[0], name, n, flat[1], typical], names=["gram", "name", "n", "place", "typical"])


def overlaps(left: list[np.ndarray], right: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """What the sets of two blocks share, for the wanted pairs (sorted, place in right * len(left) + place in left).

    The entries of left are ordered by column; each entry of right multiplies those of its column, and the products are added up by pair, some columns at a time."""
    out = np.zeros(len(pairs), np.int64)
    column = np.concatenate(left)
    order = np.argsort(column, kind="stable")
    column, row = column[order], np.repeat(np.arange(len(left)), [len(s) for s in left])[order]
    other, own = np.concatenate(right), np.repeat(np.arange(len(right)), [len(s) for s in right])
    lo, hi = np.searchsorted(column, other), np.searchsorted(column, other, "right")
    met = np.flatnonzero(hi > lo)
    met = met[np.argsort(other[met], kind="stable")]
    lo, n = lo[met], (hi - lo)[met]
    cut = np.r_[np.searchsorted(np.cumsum(n), np.arange(0, int(n.sum()), SLICE)), len(n)]
    for a, b in zip(cut[:-1], cut[1:]):
        code = np.repeat(own[met[a:b]] * len(left), n[a:b]) + row[ranges(lo[a:b], n[a:b])]
        slot = np.minimum(np.searchsorted(pairs, code), len(pairs) - 1)
        out += np.bincount(slot[pairs[slot] == code], minlength=len(pairs))
    return out


def multiply(sets: pa.Table, pairs: pa.Table, percent: int) -> pa.Table:
    """The pairs of a block whose added up overlap reaches the threshold."""
    place = {name: i for i, name in enumerate(sets.column("name").to_pylist())}
    held = [np.cumsum(from_planes(x.as_buffer()), dtype=np.uint64) for x in sets.column("members")]
    a, b = (np.array([place[x] for x in pairs.column(c).to_pylist()], np.int64) for c in ("a", "b"))
    if not len(a):
        return pairs.select(["a", "b"])
    (rows, x), (columns, y) = np.unique(a, return_inverse=True), np.unique(b, return_inverse=True)
    code, first = np.unique(y * len(rows) + x, return_index=True)
    both = overlaps([held[i] for i in rows], [held[i] for i in columns], code)
    size = np.array([len(s) for s in held])
    keep = 100 * both >= percent * (size[a[first]] + size[b[first]] - both)
    return pairs.select(["a", "b"]).take(pa.array(first[keep]))


def across(rows: pa.Table, percent: int) -> pa.Table:
    """Of some columns, or blocks of long ones, the pairs of different components that pass the bounds of sizes and places, once each."""
    rows = rows.sort_by([("gram", "ascending"), ("x", "ascending"), ("y", "ascending"), ("side", "ascending")])
    part = np.stack([rows.column(c).to_numpy() for c in ("gram", "x", "y")])
    n, place, side = (rows.column(c).to_numpy() for c in ("n", "place", "side"))
    names, name = np.unique(np.array(rows.column("name").to_pylist(), object), return_inverse=True)
    root = np.unique(np.array(rows.column("root").to_pylist(), object), return_inverse=True)[1]
    begins = np.flatnonzero(np.r_[True, (part[:, 1:] != part[:, :-1]).any(axis=0)])
    found, waiting = [np.zeros(0, np.int64)], 0
    for first, last in zip(begins, np.r_[begins[1:], len(n)]):
        if side[first] == side[last - 1]:  # one block with itself; half of a pair of blocks alone has none
            if part[1, first] != part[2, first]:
                continue
            left = right = slice(first, last)
        else:
            middle = first + int(np.count_nonzero(side[first:last] == 0))
            left, right = slice(first, middle), slice(middle, last)
        n1, n2 = n[left][:, None], n[right][None]
        need = -(-percent * (n1 + n2) // (100 + percent))
        ok = (root[left][:, None] != root[right][None]) & (100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2))
        ok &= np.minimum(n1 - place[left][:, None], n2 - place[right][None]) >= need
        i, j = np.nonzero(np.triu(ok, 1) if left == right else ok)
        if len(i):
            i, j = name[left][i], name[right][j]
            found.append(np.minimum(i, j) * len(names) + np.maximum(i, j))
            waiting += len(i)
            if waiting > SLICE:
                found, waiting = [np.unique(np.concatenate(found))], 0
    pairs = np.unique(np.concatenate(found))
    names = pa.array(names.tolist(), pa.binary())
    return pa.table([names.take(pa.array(pairs // max(len(names), 1))), names.take(pa.array(pairs % max(len(names), 1)))], names=["a", "b"])


def join(docs: DataFrame, percent: int = PERCENT, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Per row: doc_id, n_shingles and component_id, the smallest doc_id reachable by links of at least percent."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    buckets = text_parts(docs, bucket_bytes)
    bits = bits_for(buckets * bucket_bytes // 4)
    dealt = docs.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)))
    counted = dealt.groupBy("bucket").applyInArrow(lambda rows: count_columns(rows, buckets, bits), BLOBS)
    totals = counted.groupBy("shard").applyInArrow(add_up, TOTALS)  # in one job with what follows: the texts are dealt once
    answers = totals.filter("bucket >= 0").select("bucket", "shard", "level", "counts")
    rows = dealt.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(lambda r, found: entries(r, found, percent, bits), ENTRIES)
    rows = materialize(rows, "entries")

    # one row for each class that has shared columns
    held = rows.filter(F.col("columns").isNotNull()).select("name", F.col("n_shingles").alias("n"), "columns", "places", "typical", "members")
    classes = held.dropDuplicates(["name"])
    posted = materialize(classes.select("name", "n", "columns", "places", "typical").mapInArrow(postings, POSTINGS), "postings")
    members = materialize(classes.select("name", "members"), "members")

    def linked(pairs: DataFrame, salts: int) -> DataFrame:
        """A block has the pairs of some classes b (a part of them, by a); a set stands once in each block that asks for it."""
        block = F.pmod(F.xxhash64("b", F.pmod(F.xxhash64("a"), F.lit(salts))), F.lit(4 * buckets)).alias("block")
        placed = pairs.select("a", "b", block)
        asked = placed.select("block", F.col("a").alias("name")).union(placed.select("block", "b")).distinct()
        sets = asked.join(members, "name").select(F.col("block").alias("into"), "name", "members")
        return sets.groupBy("into").cogroup(placed.groupBy("block")).applyInArrow(lambda own, of: multiply(own, of, percent), "a binary, b binary")

    centre = posted.groupBy("gram").agg(F.max(F.struct("typical", "n", "name")).alias("c"), F.count("*").alias("k")).filter("k > 1")
    star = posted.join(centre.select("gram", "c"), "gram").filter(F.col("name") != F.col("c.name"))
    star = star.filter(100 * F.least("n", "c.n") >= percent * F.greatest("n", "c.n")).select(F.col("c.name").alias("a"), F.col("name").alias("b"))
    links = materialize(linked(star.distinct(), 1), "links")
    found = components(links)

    labelled = posted.join(found, posted.name == found.node, "left").select("gram", "name", "n", "place", F.coalesce("root", "name").alias("root"))
    labelled = materialize(labelled, "labelled")
    split = labelled.groupBy("gram").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("k")).filter("low <> high")
    blocks = F.ceil(F.col("k") / BLOCK).cast("int")
    mixed = labelled.join(split.select("gram", blocks.alias("blocks")), "gram").withColumn("own", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int"))
    pair = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    met = mixed.select("gram", "name", "n", "place", "root", "own", pair)
    met = met.select("gram", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).cast("int").alias("side"), "name", "n", "place", "root")
    # many short columns to a task; the blocks of a long one to several
    task = F.pmod(F.xxhash64("gram", "x", "y"), F.lit(4 * buckets)).alias("task")
    pairs = met.groupBy(task).applyInArrow(lambda r: across(r, percent), "a binary, b binary")
    more = materialize(linked(pairs.distinct(), 16), "links")
    if not more.isEmpty():
        found = components(links.union(more))

    # back to rows: a class's members and the components' smallest ids
    named = rows.groupBy("name").agg(F.min("doc_id").alias("low")).filter(F.col("name").isNotNull())
    named = named.join(found, named.name == found.node, "left").select("name", "low", F.coalesce("root", "name").alias("root"))
    named = materialize(named, "classes")
    for done in (posted, members, links, labelled, more):
        discard(done)
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    back = named.join(lowest, "root").select("name", "component_id", F.hex("root").alias("component"))
    out = rows.select("doc_id", "n_shingles", "name").join(back, "name", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "component")
