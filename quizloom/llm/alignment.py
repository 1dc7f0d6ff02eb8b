"""Operator 12: alignment of two tokenizers' ids over a corpus.

Both tokenizers cut the same bytes. Where they cut at one place, a group ends; every stretch between neighbouring
cuts of either belongs to one token of each, so the stretches are the links, and all offsets of a block of texts are
merged in one sorted array.

Counts. A task numbers the distinct (B id, A id) pairs of its own texts as it meets them, and sends each once,
with its own count, to the stripe of its B id: a stripe is a block of STRIPE B ids by all A ids, a
dense matrix, to which rows are added by np.add.at as they stream past, one stripe in memory at a time. Row maxima
are the best partners. A stripe that many tasks send to is added up in shares of SHARE_ROWS tasks first, so no worker reads an unbounded group.
The stripes' cells are then dealt over the same shares as the rows that asked, and each answer (count, best) goes
back to the task's bucket, where the links of its documents are: links are never shuffled pair by pair,
and scoring is a gather over arrays in the order of the bucket's numbers.

Tokens of a text: A encodes a space and the text, special tokens as plain text; B encodes the text and adds the
space itself. B's pieces never hold a space behind another character (checked when the model is loaded), so its
stretches from space to space are encoded once and kept in a bounded store; a model without that property
gets whole texts. Null and empty texts, and texts whose joined tokens don't give the bytes of space and text back, have no tokens:
zeros, and '' for the digest. Texts of any length are coded whole; ties of a best count are all best. Rows are documents of
their own: repeated rows count as often as they occur, rows of a null id stay rows. Further columns are ignored, whatever their names. An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ByteBPE, Numbering, chunks
from .common import discard, materialize, ranges, sliced
from .tallies import from_planes, planes

STRIPE = 32  #: B ids of a dense block
SHARE_ROWS = 4096  #: tasks whose pairs are added up, or answered, in one go
STORE_WORDS, STORE_CHARS, LONG = 300_000, 6_000_000, 200  #: what a worker keeps of B's words; longer stretches are not kept
ROWS = "bucket long, stripe int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, counts binary"
CELLS = "stripe int, keys binary, counts binary, best binary"
ANSWERS = "bucket long, stripe int, places binary, counts binary, best binary"
NUMBER = pa.int64()


#: Fixed: the pre-token pattern of A for texts of ASCII alone.
ASCII_PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)


class LeftTokenizer(ByteBPE):
    """A: byte-level merges with a store of words; special tokens are plain text. Long unbroken words go to the library, whose heap is faster on them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(path)
        self.split_special = None
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        long = [len(w) > LONG for w in words]
        if not any(long):
            return super().merge(words)
        ids, n = super().merge([w for w, x in zip(words, long) if not x])
        short = iter(np.split(ids, np.cumsum(n)[:-1]) if len(n) else [])
        own = [np.array(self.library.encode(w.decode(), add_special_tokens=False).ids, np.int64) if x else next(short) for w, x in zip(words, long)]
        return np.concatenate(own), np.array([len(x) for x in own], np.int64)

    def pretokens(self, text: str) -> list[str]:
        return ASCII_PRETOKEN.findall(text) if text.isascii() else super().pretokens(text)

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if sum(map(len, self.index.fresh)) + len(self.ids) > STORE_CHARS:
            self.clear()
        return super().encode_batch(texts)


class RightTokenizer:
    """B: a sentencepiece model; each stretch of spaces and what follows up to the next space is encoded once."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.vocab_size()
        names = [self.model.id_to_piece(i) for i in range(size)]
        self.bytes = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.length = np.array([len(b) for b in self.bytes], np.int64)
        self.apart = all("▁" not in n.lstrip("▁") for n in names)
        self.stretch = regex.compile(r" +[^ ]*")
        self.space = [self.model.piece_to_id("▁")]
        self.forget()

    def forget(self) -> None:
        self.index, self.chars = Numbering(), 0
        self.ids, self.at, self.len, self.good = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def learn(self, stretches: list[str]) -> None:
        """Stretches without their first space, which the model adds by itself, but to nothing."""
        ids = [own if own else self.space for own in self.model.encode(stretches, num_threads=1)]
        n = np.array([len(i) for i in ids], np.int64)
        good = [b"".join([self.bytes[i] for i in own]) == b" " + s.encode() for own, s in zip(ids, stretches)]
        self.at = np.r_[self.at, len(self.ids) + np.cumsum(n) - n]
        self.len, self.good = np.r_[self.len, n], np.r_[self.good, np.array(good, bool)]
        self.ids = np.r_[self.ids, np.array([i for own in ids for i in own], np.int64)]

    def cut(self, text: str) -> list[str]:
        """Stretches of a space and the text, without their first space."""
        if "  " in text or text[0] == " ":
            return [s[1:] for s in self.stretch.findall(" " + text)]
        return text.split(" ")

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, the number of each text's, and whether they give the text back."""
        if not self.apart:
            ids = self.model.encode(texts, num_threads=1)
            good = [b"".join([self.bytes[i] for i in own]) == b" " + t.encode() for own, t in zip(ids, texts)]
            return np.array([i for own in ids for i in own], np.int64), np.array([len(i) for i in ids], np.int64), np.array(good, bool)
        if len(self.index) > STORE_WORDS or self.chars > STORE_CHARS:
            self.forget()
        number, slots = self.index.__getitem__, []
        for text in texts:
            words = self.cut(text) if text else []
            slots.append(np.fromiter(map(number, words), np.int64, len(words)))
        if self.index.fresh:
            self.chars += sum(map(len, self.index.fresh))
            self.learn(self.index.fresh)
            self.index.fresh = []
        n = np.array([int(self.len[s].sum()) for s in slots], np.int64)
        good = np.array([bool(self.good[s].all()) for s in slots], bool)
        slot = np.concatenate(slots)
        return self.ids[ranges(self.at[slot], self.len[slot])], n, good


@lru_cache(maxsize=2)
def left(path: str) -> LeftTokenizer:
    return LeftTokenizer(path)


@lru_cache(maxsize=2)
def right(path: str) -> RightTokenizer:
    return RightTokenizer(path)


def tokens(texts: list[str], a: LeftTokenizer, b: RightTokenizer) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of A and of B and their numbers a text; none for texts that either does not give back."""
    ids_a, n_a = a.encode_batch([" " + t for t in texts])
    ids_b, n_b, good = b.encode_batch(texts)
    size = np.array([1 + len(t.encode()) for t in texts], np.int64)
    good &= np.array([bool(t) for t in texts], bool)
    text_a, text_b = np.repeat(np.arange(len(texts)), n_a), np.repeat(np.arange(len(texts)), n_b)
    good &= np.bincount(text_a, weights=a.piece_len[ids_a], minlength=len(texts)).astype(np.int64) == size
    # A's alphabet has a token for every byte and its merges join neighbours, so equal length is equal bytes; B's stretches were compared
    return ids_a[good[text_a]], np.where(good, n_a, 0), ids_b[good[text_b]], np.where(good, n_b, 0)


class Stretches:
    """The cuts of a block of texts, by A and by B, as offsets in all of its bytes."""

    def __init__(self, length_a: np.ndarray, length_b: np.ndarray):
        size = int(length_a.sum())
        cut_a, cut_b = np.zeros(size + 1, bool), np.zeros(size + 1, bool)
        cut_a[np.cumsum(length_a)], cut_b[np.cumsum(length_b)] = True, True
        self.ends = np.flatnonzero(cut_a | cut_b)
        own_a, own_b = cut_a[self.ends], cut_b[self.ends]
        self.a, self.b = np.cumsum(own_a) - own_a, np.cumsum(own_b) - own_b  # the token of each side that a stretch belongs to
        common = own_a & own_b
        self.last_a, self.last_b = self.a[common], self.b[common]  # last tokens of each group


@lru_cache(maxsize=2)
def decimals(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The digits of 0 to size - 1 one after another, where each number begins and how many digits it has."""
    names = [str(i).encode() for i in range(size)]
    n = np.array([len(x) for x in names], np.int64)
    return np.frombuffer(b"".join(names), np.uint8), np.cumsum(n) - n, n


def spelled(ids_a: np.ndarray, ids_b: np.ndarray, cuts: Stretches, size: int) -> tuple[bytes, np.ndarray]:
    """'a1,a2|b1;a3|b2;' of all groups, and where each group ends; ids are below size."""
    digits, at, n = decimals(size)
    in_group_a, in_group_b = np.diff(cuts.last_a, prepend=-1), np.diff(cuts.last_b, prepend=-1)
    place_a = np.arange(len(ids_a)) + np.repeat(cuts.last_b + 1 - in_group_b, in_group_a)  # behind the tokens of B in the groups before
    place_b = np.arange(len(ids_b)) + np.repeat(cuts.last_a + 1, in_group_b)
    word, mark = np.empty(len(ids_a) + len(ids_b), np.int64), np.full(len(ids_a) + len(ids_b), ord(","), np.uint8)
    word[place_a], word[place_b] = ids_a, ids_b
    mark[place_a[cuts.last_a]], mark[place_b[cuts.last_b]] = ord("|"), ord(";")
    length = n[word]
    ends = np.cumsum(length + 1)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    out[ranges(ends - length - 1, length)] = digits[ranges(at[word], length)]
    out[ends - 1] = mark
    return out.tobytes(), ends[place_b[cuts.last_b]]


class Pairs:
    """The distinct pairs of a task, numbered as they are met, and how often each was."""

    def __init__(self):
        self.keys, self.number, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Numbers of sorted distinct keys."""
        slot = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = self.keys[slot] == keys if len(self.keys) else np.zeros(len(keys), bool)
        out = np.empty(len(keys), np.int64)
        out[known] = self.number[slot[known]]
        fresh = keys[~known]
        out[~known] = len(self.counts) + np.arange(len(fresh))
        spot = np.searchsorted(self.keys, fresh)
        self.keys, self.number = np.insert(self.keys, spot, fresh), np.insert(self.number, spot, out[~known])
        self.counts = np.r_[self.counts, np.zeros(len(fresh), np.int64)]
        self.counts[out] += counts
        return out


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row per document with its own figures and its pairs as numbers of its bucket; and per bucket and stripe one row with the pairs of the bucket."""
    names = [c.split(" ")[0] for c in ROWS.split(", ")]
    types = [NUMBER, pa.int32(), *[NUMBER] * 5, pa.string(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        a, b, bucket, pairs = left(path_a), right(path_b), TaskContext.get().partitionId(), Pairs()
        for batch in sliced(batches):
            texts, docs_of = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for start, end in chunks(texts):
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(figures(bucket, docs_of[start:end], texts[start:end], a, b, pairs), types)], names)
        yield from tally(bucket, pairs, len(a.piece_len), names, types)

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, ROWS)


def figures(bucket: int, docs: list, texts: list[str], a: LeftTokenizer, b: RightTokenizer, pairs: Pairs) -> list:
    """The columns of ROWS for some documents."""
    ids_a, n_a, ids_b, n_b = tokens(texts, a, b)
    some, none = len(texts), [None] * len(texts)
    cuts = Stretches(a.piece_len[ids_a], b.length[ids_b])
    text_a = np.repeat(np.arange(some), n_a)
    text_of = text_a[cuts.a]
    spelling, group_ends = spelled(ids_a, ids_b, cuts, max(len(a.piece_len), len(b.length)))
    groups = np.bincount(text_a[cuts.last_a], minlength=some)
    ends = np.r_[0, group_ends][np.cumsum(groups)]  # each text's part of the spelling
    digests = ["" if not g else hashlib.sha256(spelling[x : y - 1]).hexdigest() for g, x, y in zip(groups, np.r_[0, ends[:-1]], ends)]
    key = ids_b[cuts.b] * len(a.piece_len) + ids_a[cuts.a]
    distinct, which = np.unique(key, return_inverse=True)
    number = pairs.add(distinct, np.bincount(which, minlength=len(distinct)))[which]
    most = len(pairs.counts) or 1
    own, times = np.unique(text_of * most + number, return_counts=True)
    bounds = np.searchsorted(own, np.arange(some + 1) * most)
    blobs = [packed(np.diff(own[x:y] % most, prepend=0)) for x, y in zip(bounds[:-1], bounds[1:])]
    tallies = [packed(times[x:y]) for x, y in zip(bounds[:-1], bounds[1:])]
    return [[bucket] * some, none, docs, n_a, n_b, groups, np.bincount(text_of, minlength=some), digests, blobs, tallies]


def packed(values: np.ndarray) -> bytes:
    """As many byte planes as the largest value needs, after a byte that says how many."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + planes(values, width)


def unpacked(raw: pa.Buffer | bytes) -> np.ndarray:
    view = memoryview(raw)
    return from_planes(view[1:], view[0]).astype(np.int64)


def tally(bucket: int, pairs: Pairs, size_a: int, names: list[str], types: list) -> Iterator[pa.RecordBatch]:
    """The bucket's pairs, stripe by stripe, in the order of their keys: keys, counts and numbers."""
    stripe = pairs.keys // size_a // STRIPE
    cuts = np.r_[0, np.flatnonzero(np.diff(stripe)) + 1, len(stripe)]
    spans = [(x, y) for x, y in zip(cuts[:-1], cuts[1:]) if y > x]
    for some in range(0, len(spans), 256):
        rows = spans[some : some + 256]
        blobs = [packed(np.diff(pairs.keys[x:y], prepend=int(stripe[x]) * STRIPE * size_a)) for x, y in rows]
        # numbers stand where a document has its pairs' counts behind them: first the numbers, then the counts
        counts = [packed(np.r_[pairs.number[x:y], pairs.counts[pairs.number[x:y]]]) for x, y in rows]
        empty = [None] * len(rows)
        columns = [[bucket] * len(rows), [int(stripe[x]) for x, _ in rows], *[empty] * 6, blobs, counts]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, types)], names)


def cells_of(stripe: int, keys: pa.Scalar, size_a: int) -> np.ndarray:
    """Cells of the stripe's matrix, as places in it."""
    return np.cumsum(unpacked(keys.as_buffer()))


def added(rows: DataFrame, size_a: int, final: bool) -> DataFrame:
    """rows (stripe, share, keys, counts), each stripe and share in one run: the dense block's cells that are not zero; in the end with the best of each B id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at = np.zeros(STRIPE * size_a, np.int64), None

        def emit():
            hit = np.flatnonzero(block)
            found = block[hit]
            top = block.reshape(STRIPE, size_a).max(axis=1)
            best = np.packbits(found == top[hit // size_a]).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), *[pa.array([v], pa.binary()) for v in (packed(np.diff(hit, prepend=0)), packed(found), best)]], ["stripe", "keys", "counts", "best"]), hit

        for batch in batches:
            for stripe, share, keys, counts in zip(batch.column("stripe").to_pylist(), batch.column("share").to_pylist(), batch.column("keys"), batch.column("counts")):
                if at != (stripe, share):
                    if at is not None:
                        out, hit = emit()
                        yield out
                        block[hit] = 0
                    at = (stripe, share)
                cells = cells_of(stripe, keys, size_a)
                np.add.at(block, cells, unpacked(counts.as_buffer())[-len(cells) :])
        if at is not None:
            yield emit()[0]

    share = F.lit(0) if final else F.col("share")
    return rows.withColumn("share", share.cast("long")).select("stripe", "share", "keys", "counts").repartition("stripe", "share").sortWithinPartitions("stripe", "share").mapInArrow(run, CELLS)


def answered(asked: DataFrame, cells: DataFrame, shares: int, size_a: int) -> DataFrame:
    """Each bucket's pairs of a stripe, by their numbers in the bucket: counts in the corpus and whether they are best. Cells come before the rows that ask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best, hit = np.zeros(STRIPE * size_a, np.int64), np.zeros(STRIPE * size_a, bool), np.zeros(0, np.int64)
        for batch in sliced(batches, 256):
            out = {"bucket": [], "stripe": [], "places": [], "counts": [], "best": []}
            for bucket, stripe, keys, counts, top in zip(batch.column("bucket").to_pylist(), batch.column("stripe").to_pylist(), batch.column("keys"), batch.column("counts"), batch.column("best")):
                if bucket is None:
                    block[hit], best[hit] = 0, False
                    hit = cells_of(stripe, keys, size_a)
                    block[hit] = unpacked(counts.as_buffer())
                    best[hit] = np.unpackbits(np.frombuffer(top.as_buffer(), np.uint8), count=len(hit)).astype(bool)
                    continue
                own = cells_of(stripe, keys, size_a)
                out["bucket"].append(bucket)
                out["stripe"].append(stripe)
                out["places"].append(packed(unpacked(counts.as_buffer())[: len(own)]))
                out["counts"].append(packed(block[own]))
                out["best"].append(np.packbits(best[own]).tobytes())
            if out["bucket"]:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), [NUMBER, pa.int32(), pa.binary(), pa.binary(), pa.binary()])], list(out))

    every = cells.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).select(F.lit(None).cast("long").alias("bucket"), "stripe", "share", "keys", "counts", "best")
    rows = every.union(asked.select("bucket", "stripe", "share", "keys", "counts", F.lit(None).cast("binary").alias("best")))
    ordered = rows.repartition("stripe", "share").sortWithinPartitions("stripe", "share", F.col("bucket").asc_nulls_first())
    return ordered.select("bucket", "stripe", "keys", "counts", "best").mapInArrow(run, ANSWERS)


def scored(docs: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers and documents meet by bucket: the answers first, then document by document."""
    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, best, of = np.zeros(0, np.int64), np.zeros(0, bool), None
        for batch in batches:
            answer = batch.column("places").is_valid().to_pylist()
            keep, n_best, sums = [], [], []
            for i, (bucket, is_answer) in enumerate(zip(batch.column("bucket").to_pylist(), answer)):
                if bucket != of:
                    count, best, of = np.zeros(0, np.int64), np.zeros(0, bool), bucket
                values = unpacked(batch.column("counts")[i].as_buffer())
                if is_answer:
                    places = unpacked(batch.column("places")[i].as_buffer())
                    need = int(places.max(initial=-1)) + 1
                    if need > len(count):
                        more = max(need, 2 * len(count)) - len(count)
                        count, best = np.r_[count, np.zeros(more, np.int64)], np.r_[best, np.zeros(more, bool)]
                    count[places] = values
                    best[places] = np.unpackbits(np.frombuffer(batch.column("best")[i].as_buffer(), np.uint8), count=len(places)).astype(bool)
                else:
                    own = np.cumsum(unpacked(batch.column("pairs")[i].as_buffer()))
                    keep.append(i)
                    n_best.append(int(values[best[own]].sum()))
                    sums.append(int((values * count[own]).sum()))
            if keep:
                rows = batch.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")], pa.array(n_best, NUMBER), pa.array(sums, NUMBER), rows.column("groups_sha256")], [c.split(" ")[0] for c in out.split(", ")])

    every = answers.unionByName(docs, allowMissingColumns=True)
    ordered = every.repartition("bucket").sortWithinPartitions("bucket", F.col("places").isNull())
    return ordered.mapInArrow(run, out)


def align(docs: DataFrame, path_a: str, path_b: str, parts: bool = False):
    """Per document its tokens, groups, links and their scores; with parts also the table of pair counts (a_id, b_id, n, is_best)."""
    size_a = len(left(path_a).piece_len)
    rows = materialize(aligned(docs, path_a, path_b), "aligned")
    documents = rows.filter("stripe is null").drop("stripe")
    last = rows.agg(F.max("bucket").alias("n")).first()["n"]
    shares = 1 + (last or 0) // SHARE_ROWS
    asked = rows.filter("stripe is not null").select("bucket", "stripe", F.pmod("bucket", F.lit(shares)).alias("share"), F.col("pairs").alias("keys"), "counts")
    cells = added(asked, size_a, final=False)
    if shares > 1:
        cells = added(cells, size_a, final=True)
    cells = materialize(cells, "cells")
    answers = materialize(answered(asked, cells, shares, size_a), "answers")
    out = scored(documents, answers)
    return (out, pair_counts(cells, size_a)) if parts else out


def pair_counts(cells: DataFrame, size_a: int) -> DataFrame:
    """The corpus-wide table of linked ids: b_id, a_id, n, is_best."""

    def run(batches):
        for batch in batches:
            for stripe, keys, counts, top in zip(batch.column("stripe").to_pylist(), batch.column("keys"), batch.column("counts"), batch.column("best")):
                at = cells_of(stripe, keys, size_a)
                best = np.unpackbits(np.frombuffer(top.as_buffer(), np.uint8), count=len(at)).astype(bool)
                yield pa.RecordBatch.from_pydict({"b_id": stripe * STRIPE + at // size_a, "a_id": at % size_a, "n": unpacked(counts.as_buffer()), "is_best": best})

    return cells.mapInArrow(run, "b_id long, a_id long, n long, is_best boolean")
