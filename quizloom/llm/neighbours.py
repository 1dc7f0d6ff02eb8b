"""Operator 7: approximate nearest neighbours by additive quantisation, reranked exactly.

A vector is coded as a sum of one full-dimensional codeword from each of CODEBOOKS books, chosen by beam
search over the residuals; its own norm and that of the sum are stored. A query's products with all
codewords form a lookup table, so a candidate's score is a sum of table rows by its codes, scaled by the
ratio of the stored norms. The SHORTLIST best of each query are scored again on the original vectors, in
double precision.

A list is too short where many vectors are as near as the code can tell apart, such as near copies. A
coding error is spread over all directions, so a score is off by about the error over the root of the
dimension, times the query's norm. Where the last guess of a list is within SURE of these of its last
answer, the query goes over the codes again, and every candidate whose guess is that near is reranked,
however many there are. Nothing else is scored: neither pass leaves the codes out. SURE is a typical error, not a
bound: answers are approximate, with a recall that is measured, and the last bits of the books, hence single codes,
may differ between machines.

The books are fitted on at most SAMPLE vectors (those with the smallest hash of their id), by residual
k-means and rounds of encoding and least squares; every vector is coded. Queries and candidates meet
block by block, so n vectors are moved n / (QUERY_EVERY * QUERY_BLOCK) times as codes, and the work is that of
the stated queries against all codes, n * n / QUERY_EVERY.

Equal vectors are coded, listed and asked for once; each row then gets its own answer. Every row is a
candidate but the query's own row: rows that repeat a query's id are candidates like any other. Ties go to the
smaller id. Vectors that are null, empty or zero, hold null or non-finite parts or another dimension than
most of the sample take no part, nor do rows without an id. With fewer candidates than asked for all are
returned. An empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

CODEBOOKS, WORDS, BEAM = 16, 256, 4
SAMPLE, ROUNDS = 12_000, 2
SHORTLIST, TOP = 400, 20
SURE = 1.0  #: how many typical errors of a score an answer must be away from what the list leaves out
QUERY_BLOCK, CANDIDATE_BLOCK = 4096, 65_536
QUERY_EVERY = 20


def usable(vector: Column) -> Column:
    """Vectors that take part."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def vectors_of(column: pa.ChunkedArray | pa.Array, dim: int, kind=np.float32) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), dtype=kind).reshape(-1, dim)


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = np.argmax(x @ centres.T - 0.5 * (centres * centres).sum(axis=1), axis=1)
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def beam_encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes of every vector: the beam keeps the partial sums with the shortest residuals."""
    n, dim = x.shape
    words = books.shape[1]
    rest = x[:, None, :]
    codes = np.zeros((n, 1, 0), np.uint8)
    for book in books:
        flat = rest.reshape(-1, dim)
        cost = (0.5 * (flat * flat).sum(axis=1)[:, None] - flat @ book.T + 0.5 * (book * book).sum(axis=1)).reshape(n, -1)
        keep = min(beam, cost.shape[1])
        best = np.argpartition(cost, keep - 1, axis=1)[:, :keep]
        old, word = best // words, best % words
        codes = np.concatenate([np.take_along_axis(codes, old[:, :, None], axis=1), word[:, :, None].astype(np.uint8)], axis=2)
        rest = np.take_along_axis(rest, old[:, :, None], axis=1) - book[word]
    return codes[np.arange(n), (rest * rest).sum(axis=2).argmin(axis=1)]


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(book[codes[:, m]] for m, book in enumerate(books))


def fit_books(x: np.ndarray, seed: int = 7) -> np.ndarray:
    """Books for the sample: residual k-means, then encoding and least squares in turn."""
    rng = np.random.default_rng(seed)
    rest, books = x, []
    for _ in range(CODEBOOKS):
        book = k_means(rest, WORDS, rng)
        rest = rest - book[np.argmax(rest @ book.T - 0.5 * (book * book).sum(axis=1), axis=1)]
        books.append(book)
    books = np.stack(books)
    size = CODEBOOKS * WORDS
    for _ in range(ROUNDS):
        codes = np.concatenate([beam_encode(x[i : i + 2000], books) for i in range(0, len(x), 2000)]).astype(np.int64)
        gram = np.zeros((CODEBOOKS, WORDS, CODEBOOKS, WORDS), np.float32)
        right = np.zeros((size, x.shape[1]), np.float32)
        for a in range(CODEBOOKS):
            np.add.at(right, codes[:, a] + a * WORDS, x)
            for b in range(CODEBOOKS):
                gram[a, :, b] = np.bincount(codes[:, a] * WORDS + codes[:, b], minlength=WORDS**2).reshape(WORDS, WORDS)
        gram = gram.reshape(size, size)
        gram[np.diag_indices(size)] += 1.0
        books = np.linalg.solve(gram, right).reshape(books.shape).astype(np.float32)
    return books


def element(vectors: DataFrame) -> str:
    """The type of a vector's parts."""
    return "double" if vectors.schema["embedding"].dataType.elementType.typeName() == "double" else "float"


def digests(column: pa.Array, dim: int) -> pa.Array:
    x = vectors_of(column, dim, np.float64) + 0.0  # one zero
    return pa.array([xxhash.xxh3_128_digest(v.tobytes()) for v in x], pa.binary())


def named(rows: DataFrame, dim: int) -> DataFrame:
    """The rows with a digest of their vector and a number of their own."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, digests(batch.column("embedding"), dim)], names=[*batch.schema.names, "name"])

    kept = rows.select("vec_id", "embedding", "is_query", F.monotonically_increasing_id().alias("row"))
    return kept.mapInArrow(run, f"vec_id long, embedding array<{element(rows)}>, is_query boolean, row long, name binary")


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """One node for each vector, called by the number of its first row; held are its first rows by id, cut on the map side first."""
    order = Window.partitionBy("name").orderBy("vec_id", "row")
    first = rows.select("name", "vec_id", "row").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= keep)
    held = first.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("vec_id", "row"))).alias("held"))
    whole = rows.groupBy("name").agg(F.first("embedding").alias("embedding"), F.max("is_query").alias("asks"))
    return whole.join(held, "name").select("name", F.element_at("held", 1)["row"].alias("node"), F.element_at("held", 1)["vec_id"].alias("low"), "held", "asks", "embedding")


class Block:
    """The codes of a block of candidates, and the guesses of queries for them."""

    def __init__(self, table: pa.Table, books: np.ndarray):
        self.books = books
        self.codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.uint8).reshape(-1, len(books))
        self.scale = table.column("scale").to_numpy().astype(np.float32)

    def guesses(self, q: np.ndarray) -> np.ndarray:
        tables = np.ascontiguousarray(self.books @ q.T)  # book, word, query
        out = np.empty((len(self.codes), len(q)), np.float32)
        for b in range(0, len(out), 8192):
            own = self.codes[b : b + 8192]
            total = tables[0][own[:, 0]]
            for m in range(1, len(self.books)):
                total += tables[m][own[:, m]]
            out[b : b + 8192] = total * self.scale[b : b + 8192, None]
        return np.ascontiguousarray(out.T)


def shortlist(queries: pa.Table, index: pa.Table, books: np.ndarray, keep: int) -> pa.Table:
    """For each query of a block the best candidates of a block by lookup tables."""
    names, block = index.column("node").to_numpy(), Block(index, books)
    q = vectors_of(queries.column("embedding"), books.shape[2])
    nodes, guesses = [], []
    n = min(keep, len(names))
    for a in range(0, len(q), 256):
        for row in block.guesses(q[a : a + 256]):
            best = np.argpartition(-row, n - 1)[:n] if n < len(row) else np.arange(n)
            nodes.append(names[best])
            guesses.append(row[best].astype(np.float64))
    lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1, dtype=np.int32) * n), pa.array(np.concatenate(v) if v else np.zeros(0))) for v in (nodes, guesses)]
    return pa.table([queries.column("query"), *lists], names=["query", "nodes", "guesses"])


def near_enough(queries: pa.Table, index: pa.Table, books: np.ndarray, keep: int) -> pa.Table:
    """For each query of a block the best of those candidates of a block whose guess reaches the query's own least one, by exact scores."""
    names, low, block = index.column("node").to_numpy(), index.column("low").to_numpy(), Block(index, books)
    x, q = (vectors_of(t.column("embedding"), books.shape[2], np.float64) for t in (index, queries))
    asked, least = (queries.column(c).to_numpy() for c in ("query", "least"))
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for a in range(0, len(q), 256):
        for k, row in enumerate(block.guesses(q[a : a + 256].astype(np.float32)), a):
            near = np.flatnonzero(row >= least[k])
            score = (x[near] * q[k]).sum(axis=1)
            best = np.lexsort((low[near], -score))[:keep]
            out.append((np.full(len(best), asked[k]), names[near[best]], score[best]))
    return pa.table([pa.array(np.concatenate(p)) for p in zip(*out)], names=["query", "node", "score"])


def search(vectors: DataFrame, is_query: Column | None = None, top: int = TOP, keep: int = SHORTLIST) -> DataFrame:
    """The nearest rows of every query row: query_id, rank, vec_id, score."""
    is_query = F.col("vec_id") % QUERY_EVERY == 0 if is_query is None else is_query
    spark, keep, most = vectors.sparkSession, max(keep, top + 1), top + 1
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding", F.coalesce(is_query, F.lit(False)).alias("is_query")).filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    sample = rows.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = np.array([len(v) for v in sample.column("embedding")])
    dim = int(np.bincount(lengths).argmax())
    sample = sample.filter(pa.array(lengths == dim))
    books = spark.sparkContext.broadcast(fit_books(vectors_of(sample.column("embedding"), dim)))  # CODEBOOKS * WORDS vectors
    kind = f"array<{element(vectors)}>"

    def encode(batches):
        for batch in batches:
            x = vectors_of(batch.column("embedding"), dim)
            for a in range(0, len(x), 2000):
                codes = beam_encode(x[a : a + 2000], books.value)
                near = decode(codes, books.value)
                scale = np.linalg.norm(x[a : a + 2000].astype(np.float64), axis=1) / np.maximum(np.linalg.norm(near, axis=1), 1e-12)
                error = np.linalg.norm(x[a : a + 2000] - near * scale[:, None], axis=1)
                own = batch.slice(a, len(codes))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale), pa.array(error)], names=[*own.schema.names, "codes", "scale", "error"])

    rows = materialize(named(rows.filter(F.size("embedding") == dim), dim), "named")
    nodes = materialize(distinct_vectors(rows, most), "nodes")
    index = materialize(nodes.select("node", "low", "embedding").mapInArrow(encode, f"node long, low long, embedding {kind}, codes binary, scale double, error double"), "index")
    asked = nodes.filter("asks").select(F.col("node").alias("query"), "embedding")
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    n_all = index.count()

    def met(queries: DataFrame, candidates: list[str], do, schema: str) -> DataFrame:
        """Every block of queries with every block of candidates."""
        across, down = max(1, -(-queries.count() // QUERY_BLOCK)), max(1, -(-n_all // CANDIDATE_BLOCK))
        left = queries.select("*", deal("query", across).alias("x"), every(down).alias("y"))
        right = index.select("node", *candidates, deal("node", down).alias("y"), every(across).alias("x"))
        return left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInArrow(do, schema)

    def exact(batches):
        for batch in batches:
            a, b = vectors_of(batch.column("own"), dim, np.float64), vectors_of(batch.column("embedding"), dim, np.float64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("query", "node", "guess")), pa.array((a * b).sum(axis=1))], names=["query", "node", "guess", "score"])

    def best(scored: DataFrame) -> DataFrame:
        """The first rows of each query's best nodes as one array, and the score of the last of them."""
        order = Window.partitionBy("query").orderBy(F.desc("score"), "low")
        kept = scored.join(nodes.select("node", "low", "held"), "node").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
        opened = kept.select("query", F.explode("held").alias("h"), (-F.col("score")).alias("far")).select("query", F.struct("far", "h.vec_id", "h.row").alias("e"))
        return opened.groupBy("query").agg(F.slice(F.sort_array(F.collect_list("e")), 1, most).alias("found")).withColumn("last", -F.element_at("found", -1)["far"])

    near = met(asked, ["codes", "scale"], lambda q, c: shortlist(q, c, books.value, keep), "query long, nodes array<long>, guesses array<double>")
    near = near.select("query", F.explode(F.arrays_zip("nodes", "guesses")).alias("c")).select("query", F.col("c.nodes").alias("node"), F.col("c.guesses").alias("guess"))
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("guess"), "node"))).filter(F.col("place") <= keep)
    pairs = near.join(nodes.select("node", "embedding"), "node").join(asked.withColumnRenamed("embedding", "own"), "query")
    scored = materialize(pairs.select("query", "node", "guess", "own", "embedding").mapInArrow(exact, "query long, node long, guess double, score double"), "scored")
    answers = materialize(best(scored.select("query", "node", "score")), "answers")

    if n_all > keep:
        error = index.agg(F.percentile_approx("error", 0.99)).first()[0] / float(np.sqrt(dim))
        norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
        ends = answers.join(scored.groupBy("query").agg(F.min("guess").alias("guess")), "query").join(asked, "query")
        short = materialize(ends.withColumn("least", F.col("last") - norm * F.lit(SURE * error)).filter("guess >= least").select("query", "embedding", "least"), "short")
        if not short.isEmpty():
            again = met(short, ["low", "embedding", "codes", "scale"], lambda q, c: near_enough(q, c, books.value, most), "query long, node long, score double")
            answers = answers.join(short, "query", "left_anti").unionByName(best(again))

    # each row takes the answer of its vector, less itself
    given = answers.join(nodes.select(F.col("node").alias("query"), "name"), "query").select("name", "found")
    own = rows.filter("is_query").select(F.col("vec_id").alias("query_id"), "row", "name").join(given, "name")
    listed = own.select("query_id", F.posexplode(F.slice(F.filter("found", lambda e: e["row"] != F.col("row")), 1, top)).alias("at", "e"))
    return listed.select("query_id", (F.col("at") + 1).alias("rank"), F.col("e.vec_id").alias("vec_id"), (-F.col("e.far")).alias("score"))
