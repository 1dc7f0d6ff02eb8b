"""Operator 11: importance resampling towards a target distribution over hashed n-grams.

The words of a block of texts become ids in one array. A suffix array orders all positions by the words that
follow, by prefix doubling as far as the longest n-gram needs; a common-prefix array beside it shows runs of
suffixes that begin with the same n words. Each run is one distinct n-gram of the block: it is hashed
once, and the bucket id is scattered back to the run's positions. Blocks are cut by words, so that a
worker's memory does not grow with its partition; only a text larger than a block is a block of its own.

A task adds up its bucket counts before anything is shuffled: what moves is at most one row per task and
bucket, and what reaches the driver is one number per bucket. The bucket ids of every document are written
once, in order, as differences; scores are then sums of gains over them. Ranks come from a range partitioning by
(score, doc_id) of distinct rows with their counts, so that no sort is global in one task and repeated rows are one.

A draw by largest score is a draw without replacement by weights, since Gumbel noise of a digest of seed and id is added: the same
on every run and layout. Null and empty texts have no features: weight 0. A null id counts as empty text in
the digest and comes last among ties. Repeated rows are documents of their own. Texts are read whole, long
ones too. Further columns are ignored by score() and stay in resample(), whatever their names. An empty
table gives an empty result; an empty target gives gains of an unseen target.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import Numbering
from .common import discard, free, materialize, sliced
from .tallies import from_planes, planes

ORDER, BUCKETS, SEED, LEAST_WORDS, SHARE = 1, 10_000, 2024, 20, 10
BLOCK_WORDS = 1 << 20
COPIES = 1 << 16  #: equal rows that come apart at a time
#: Upper-case letters to lower case, every other byte that no word holds to a space; bytes of 128 and more belong to words.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
FEATURES = "doc_id long, row long, n_words long, n_features long, buckets binary, totals binary"


def suffix_array(ids: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of the (at least) depth words from there on; left: words from a position to its text's end, which comes before any word."""
    rank, reach = ids.astype(np.int64) + 1, 1
    while reach < depth:
        further = np.where(left > reach, np.r_[rank[reach:], np.zeros(min(reach, len(rank)), np.int64)], 0)
        rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + further, return_inverse=True)[1] + 1
        reach *= 2
    return np.argsort(rank, kind="stable")


def common_prefixes(ids: np.ndarray, left: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Words, up to depth, that each suffix shares with the one before it in order."""
    out = np.zeros(len(order), np.int64)
    at = np.arange(1, len(order))
    for n in range(depth):
        a, b = order[at - 1], order[at]
        both = (left[a] > n) & (left[b] > n)
        a, b, at = a[both], b[both], at[both]
        at = at[ids[a + n] == ids[b + n]]
        out[at] = n + 1
    return out


def hashed(words: list[bytes], ids: np.ndarray, lengths: np.ndarray, order: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 1 to order: the positions that begin an n-gram of their text and the buckets of these, each distinct n-gram hashed once."""
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(ids))
    suffixes = suffix_array(ids, left, order)
    shared = common_prefixes(ids, left, suffixes, order)
    for n in range(1, order + 1):
        whole = left[suffixes] >= n  # a shorter suffix stands before a run, never inside
        at = suffixes[whole]
        starts = shared[whole] < n
        firsts = at[starts]
        grams = map(words.__getitem__, ids[firsts].tolist()) if n == 1 else (b" ".join([words[i] for i in ids[p : p + n].tolist()]) for p in firsts.tolist())
        of_run = np.fromiter((zlib.crc32(g) % buckets for g in grams), np.int64, len(firsts))
        yield at, of_run[np.cumsum(starts) - 1]


class Block:
    """Texts whose words lie in one array of ids."""

    def __init__(self):
        self.index, self.ids, self.keys, self.size = Numbering(), [], [], 0

    def add(self, key: tuple, text: bytes) -> None:
        words = text.translate(WORD_BYTES).split()
        self.ids.append(np.fromiter(map(self.index.__getitem__, words), np.int64, len(words)))
        self.keys.append(key)
        self.size += len(words)

    def features(self, order: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of each text, features of each text, and the buckets of all features, text by text and sorted inside each."""
        lengths = np.array([len(i) for i in self.ids], np.int64)
        text = np.repeat(np.arange(len(lengths)), lengths)
        keys = [text[at] * buckets + found for at, found in hashed(list(self.index), np.concatenate(self.ids), lengths, order, buckets)]
        keys = np.sort(np.concatenate(keys))
        return lengths, np.bincount(keys // buckets, minlength=len(lengths)), keys % buckets


def features(docs: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """Per row (doc_id, row, text): words, features and their buckets; one more row per task with its bucket totals."""
    width = (max(buckets - 1, 1).bit_length() + 7) // 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, block = np.zeros(buckets, np.int64), Block()
        types = [pa.int64()] * 4 + [pa.binary()] * 2
        names = [c.split(" ")[0] for c in FEATURES.split(", ")]

        def flush():
            nonlocal block, totals
            n_words, n, flat = block.features(order, buckets)
            totals += np.bincount(flat, minlength=buckets)
            ends = np.cumsum(n)
            blobs = [planes(np.diff(flat[e - k : e], prepend=0), width) for e, k in zip(ends, n)]
            ids, rows = zip(*block.keys)
            block = Block()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip([ids, rows, n_words, n, blobs, [None] * len(ids)], types)], names)

        for batch in sliced(batches):
            for doc, row, text in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), batch.column("text")):
                block.add((doc, row), text.as_py())
                if block.size >= BLOCK_WORDS or len(block.keys) >= 1 << 14:
                    yield flush()
        if block.keys:
            yield flush()
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([None, None, None, None, None, totals.astype("<i8").tobytes()], types)], names)

    text = F.coalesce("text", F.lit("")).cast("binary").alias("text")
    row = F.col("row").cast("long") if "row" in docs.columns else F.lit(None).cast("long").alias("row")
    return docs.select(F.col("doc_id").cast("long"), row, text).mapInArrow(run, FEATURES)


def bucket_totals(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of each bucket in the whole corpus: one number a bucket."""

    def run(batches):
        for batch in batches:
            own = np.zeros(buckets, np.int64)
            for raw in batch.column("totals"):
                own += np.frombuffer(raw.as_buffer(), "<i8")
            hit = np.flatnonzero(own)
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(hit, pa.int64()), "n": pa.array(own[hit], pa.int64())})

    sums = found.filter("totals is not null").select("totals").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in sums.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each bucket."""
    s, t, size = source.astype(np.float64), target.astype(np.float64), float(len(source))
    return np.floor(1000 * np.log(((t + 1) * (s.sum() + size)) / ((s + 1) * (t.sum() + size)))).astype(np.int64)


def noise(doc_id: Column, seed: int) -> Column:
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def score(docs: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text and perhaps row): doc_id, row, n_words, n_features, weight, score, written to the shared folder."""
    found = materialize(features(docs, order, buckets), "features")
    wanted = features(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), order, buckets)
    gain = gains(bucket_totals(found, buckets), bucket_totals(wanted, buckets))
    width = (max(buckets - 1, 1).bit_length() + 7) // 8

    def run(batches):
        for batch in batches:
            weights = []
            for n, raw in zip(batch.column("n_features").to_pylist(), batch.column("buckets")):
                weights.append(int(gain[np.cumsum(from_planes(raw.as_buffer(), width).astype(np.int64))].sum()) // n if n else 0)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "row", "n_words", "n_features")], pa.array(weights, pa.int64())], ["doc_id", "row", "n_words", "n_features", "weight"])

    own = found.filter("totals is null").select("doc_id", "row", "n_words", "n_features", "buckets")
    weighed = own.mapInArrow(run, "doc_id long, row long, n_words long, n_features long, weight long")
    out = materialize(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "weighed")
    discard(found)
    return out


def draw(scored: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """scored with the rank of the share (in percent) of rows of the highest scores, of those with enough words; null for the others."""
    fits = F.col("n_words") >= least_words
    most = scored.filter(fits).count() * share // 100
    own = ["score", "doc_id", "row", "n_words", "n_features", "weight"]
    groups = scored.filter(fits).groupBy(*own).agg(F.count("*").alias("copies"))
    last = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc_nulls_last(), "n_features", "weight", "n_words"]
    schema = ", ".join(f"{c} long" for c in [*own, "copies", "part", "ahead"])
    placed = materialize(groups.select(*own, "copies").repartitionByRange(*last).sortWithinPartitions(*last).mapInArrow(numbered, schema), "placed")
    sizes = placed.groupBy("part").agg(F.max(F.col("ahead") + F.col("copies")).alias("n")).collect()  # one row a partition
    before, total = [], 0
    for r in sorted(sizes, key=lambda r: r["part"]):
        before.append((r["part"], total))
        total += r["n"]
    moved = placed.join(F.broadcast(scored.sparkSession.createDataFrame(before, "part long, before long")), "part")
    rank = F.col("before") + F.col("ahead") + F.col("nth")
    # equal rows come apart again in two steps, so that no array is long
    block = moved.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / COPIES))))
    each = block.withColumn("nth", F.explode(F.sequence(F.col("block") * COPIES + 1, F.least("copies", (F.col("block") + 1) * COPIES))))
    return each.select(*own, F.when(rank <= most, rank).alias("rank")).unionByName(scored.filter(~fits | fits.isNull()).select(*own, F.lit(None).cast("long").alias("rank")))


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order with their partition and the rows, copies counted, that are ahead of them in it."""
    from pyspark import TaskContext

    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        copies = batch.column("copies").to_numpy()
        ends = at + np.cumsum(copies)
        at = int(ends[-1]) if len(ends) else at
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(copies), part, np.int64)), pa.array(ends - copies)], [*batch.schema.names, "part", "ahead"])


def resample(docs: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS, seed: int = SEED, share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """The drawn rows of docs, whole, with weight, score and rank (under names that no column has)."""
    names = free(docs, "row_key", "weight", "score", "rank")
    rows = materialize(docs.withColumn(names[0], F.monotonically_increasing_id()), "keyed")
    found = draw(score(rows.select("doc_id", "text", F.col(names[0]).alias("row")), target, order, buckets, seed), share, least_words)
    drawn = found.filter("rank is not null").select(*[F.col(a).alias(b) for a, b in zip(["row", "weight", "score", "rank"], names)])
    return rows.join(drawn, names[0]).select(docs.columns + names[1:])


def report(docs: DataFrame, target: DataFrame) -> DataFrame:
    return draw(score(docs.select("doc_id", "text"), target)).select("doc_id", "n_features", "weight", "score", "rank")


RESAMPLE_SQL = f"""
WITH RECURSIVE crc_table AS (SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i::BIGINT] || [0::BIGINT for x in range(8)], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
texts AS (SELECT 0 AS side, row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents
    UNION ALL SELECT 1, row_number() OVER (), NULL, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
counted AS (SELECT side, r, word, count(*) AS n FROM (SELECT side, r, unnest(regexp_extract_all(body, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM texts) GROUP BY ALL),
vocabulary AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM counted)),
bucketed AS (SELECT word, xor(4294967295, list_reduce([4294967295::BIGINT] || [('0x' || substr(h, 2 * x + 1, 2))::BIGINT for x in range(len(h) // 2)],
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % {BUCKETS} AS bucket FROM vocabulary, crc_table),
features AS (SELECT side, r, bucket, n FROM counted JOIN bucketed USING (word)),
sums AS (SELECT b AS bucket, coalesce(s, 0) AS s, coalesce(t, 0) AS t, sum(coalesce(s, 0)) OVER () AS all_s, sum(coalesce(t, 0)) OVER () AS all_t
    FROM range({BUCKETS}) r(b) LEFT JOIN (SELECT bucket, sum(n) FILTER (side = 0) AS s, sum(n) FILTER (side = 1) AS t FROM features GROUP BY bucket) ON bucket = b),
gains AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (all_s + {BUCKETS})::DOUBLE) / ((s + 1)::DOUBLE * (all_t + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM sums),
weights AS (SELECT r, sum(n)::BIGINT AS n, sum(n * gain)::DOUBLE AS total FROM features JOIN gains USING (bucket) WHERE side = 0 GROUP BY r),
scored AS (SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(floor(total / n), 0)::BIGINT AS weight,
    ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM texts LEFT JOIN weights USING (r) WHERE side = 0),
final AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM scored),
fit AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (n_features >= {LEAST_WORDS}) OVER () AS fits FROM final)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {LEAST_WORDS} AND place <= {SHARE} * fits // 100 THEN place END::BIGINT AS rank FROM fit
"""
