"""Operator 6: harmonic packing of tokenised documents into fixed-length training sequences.

A document is cut into whole sequences first. The rest of length r belongs to the reciprocal class
k = capacity // r, the largest number of such pieces that share one bin. Where k pieces of that length
would leave more than a small part of a bin empty, the piece is cut to the next reciprocal capacity
exactly and what remains is classed again. Short pieces have classes like all others: up to a 64th of a bin every length is
one of its own, which wastes less than one piece a bin. Each class fills bins of exactly k pieces; a worker fills its
own bins without knowing of the others. Only what does not fill a bin in a worker (fewer than k pieces a
class) meets the leftovers of neighbouring workers; what is left then shares bins by first fit.

Null and empty texts give the end token alone; texts of any length are cut, and are the only thing of which a
worker holds one whole. Repeated rows are packed as they come; pieces of rows
with equal doc_id differ in their place. Further columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Numbering, chunks
from .common import materialize, ranges, sliced

CAPACITY, END_ID = 4096, 2
CLASSES = 64  #: lengths up to capacity // CLASSES are never cut
WASTE = 0.02  #: the part of a bin that a class may leave empty before a piece is cut
NEIGHBOURS = 64  #: workers whose leftovers meet
STORE_WORDS, STORE_CHARS = 300_000, 6_000_000  #: most words and letters that a worker keeps the ids of
OFTEN = 3  #: how often a word must have been met to be kept beyond that, or beyond a partition
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, worker long, sequence_id long, offset long"

#: Latin text whose normal form is itself and whose letters change case one by one; other texts are left to the library whole.
PLAIN = regex.compile(r"[\x00-\x7f\xa0-\xff\u2010-\u2027\u20ac]*+")
#: White space to Python's split() but not to the pattern.
SEPARATORS = regex.compile(r"[\x1c-\x1f]")
#: Fixed: the pre-token pattern of the lower-case word vocabulary.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")



class WordTokenizer:
    """The library's ids, with each distinct pre-token encoded once and each distinct word put together once.

    Pre-tokens never span white space, so a word's ids don't depend on its neighbours."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        vocab = self.library.get_vocab()
        self.ends_word = np.zeros(1 + max(vocab.values()), bool)
        self.ends_word[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.words, self.pieces = Store(), Store()

    def thin(self) -> None:
        """Most words of a corpus are met once; those that recur stay known."""
        self.words.thin()
        self.pieces.thin()

    def ids_of_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Many pre-tokens at a time, apart by spaces; the last token of each is marked as a word's end."""
        lines = [" ".join(pieces[i : i + 1000]) for i in range(0, len(pieces), 1000)]
        ids = np.array([i for e in self.library.encode_batch_fast(lines, add_special_tokens=False) for i in e.ids], np.int64)
        ends = np.flatnonzero(self.ends_word[ids])
        if len(ends) != len(pieces):
            each = [self.library.encode(x, add_special_tokens=False).ids for x in pieces]
            return np.array([i for x in each for i in x], np.int64), np.array([len(x) for x in each], np.int64)
        return ids, np.diff(np.r_[-1, ends])

    def learn(self, words: list[str]) -> None:
        split = [pretokens(w) for w in words]
        slots = np.fromiter((self.pieces.index[p] for w in split for p in w), np.int64)
        self.pieces.met(slots)
        if fresh := self.pieces.fresh():
            self.pieces.add(*self.ids_of_pieces(fresh))
        n = self.pieces.len[slots]
        word = np.repeat(np.arange(len(words)), [len(w) for w in split])
        self.words.add(self.pieces.take(slots), np.bincount(word, weights=n, minlength=len(words)).astype(np.int64))

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        if self.words.full() or self.pieces.full():
            self.thin()
            if self.words.full() or self.pieces.full():
                self.forget()
        number, own = self.words.index.__getitem__, []
        for text in texts:
            if (text.isascii() or PLAIN.fullmatch(text)) and not SEPARATORS.search(text) and not any(s in text for s in self.special):
                words = text.lower().split()
                own.append(np.fromiter(map(number, words), np.int64, len(words)))
            else:
                own.append(None)
        fresh = self.words.fresh()
        for slots in own:
            if slots is not None:
                self.words.met(slots)
        if fresh:
            self.learn(fresh)
        return [self.words.take(s) if s is not None else np.array(self.library.encode(t, add_special_tokens=False).ids, np.int64) for s, t in zip(own, texts)]


class Store:
    """Ids of numbered strings in one flat array, and how often each was met."""

    def __init__(self):
        self.index, self.chars = Numbering(), 0
        self.ids, self.at, self.len, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)

    def full(self) -> bool:
        return len(self.index) > STORE_WORDS or self.chars > STORE_CHARS

    def fresh(self) -> list[str]:
        out, self.index.fresh = self.index.fresh, []
        self.chars += sum(map(len, out))
        return out

    def met(self, slots: np.ndarray) -> None:
        if len(slots):
            if (more := len(self.index) - len(self.count)) > 0:
                self.count = np.r_[self.count, np.zeros(more, np.int64)]
            np.add.at(self.count, slots, 1)

    def add(self, ids: np.ndarray, n: np.ndarray) -> None:
        self.at = np.r_[self.at, len(self.ids) + np.cumsum(n) - n]
        self.len = np.r_[self.len, n.astype(np.int32)]
        self.ids = np.r_[self.ids, ids.astype(np.int32)]

    def take(self, slots: np.ndarray) -> np.ndarray:
        return self.ids[ranges(self.at[slots], self.len[slots])]

    def thin(self) -> None:
        keep = np.flatnonzero(self.count >= OFTEN)
        own, names = Store(), list(self.index)
        for i in keep:
            own.index[names[i]]
        own.fresh()
        own.add(self.take(keep), self.len[keep])
        own.count = self.count[keep] // 2  # what is no longer met goes in time
        self.__dict__ = own.__dict__


def pretokens(word: str) -> list[str]:
    if word.isalpha():
        return [word]
    if word[:-1].isalpha() and word[-1] in ".,":
        return [word[:-1], word[-1]]
    return PRETOKEN.findall(word)


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def cut(n: int, capacity: int = CAPACITY, classes: int = CLASSES, waste: float = WASTE) -> list[int]:
    """Lengths of the pieces of a document of n tokens."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        if k >= classes or (capacity - k * rest) <= waste * capacity:
            out.append(rest)
            break
        out.append(capacity // (k + 1))
        rest -= capacity // (k + 1)
    return out


def class_of(length: int, capacity: int = CAPACITY) -> int:
    """How many pieces of this length fill a bin: the reciprocal class."""
    return capacity // length


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece, placed where its worker filled the bin; sequence_id is null for leftovers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens, worker = word_tokenizer(path), TaskContext.get().partitionId()
        open_bins: dict[int, list[tuple]] = {}
        made = 0

        def record(rows, placed):
            cols = list(zip(*rows))
            names = PIECES.replace(" long", "").split(", ")
            values = [*cols[:5], [worker] * len(rows), *(cols[5:] if placed else ([None] * len(rows), [None] * len(rows)))]
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in values], names)

        for batch in sliced(batches):
            texts, ids_of = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for a, b in chunks(texts):
                rows = []
                for doc, ids in zip(ids_of[a:b], tokens.encode_batch(texts[a:b])):
                    whole = np.append(ids, END_ID).astype("<u4")
                    at = 0
                    for n in cut(len(whole), capacity):
                        piece = (doc, at, n, zlib.crc32(whole[at : at + n].tobytes()), len(whole))
                        at += n
                        k = class_of(n, capacity)
                        shelf = open_bins.setdefault(k, [])
                        shelf.append(piece)
                        if len(shelf) == k:
                            offset, name = 0, (worker << 32) + made
                            for p in shelf:
                                rows.append((*p, name, offset))
                                offset += p[2]
                            made += 1
                            open_bins[k] = []
                if rows:
                    yield record(rows, True)
        tokens.thin()  # the worker lives on
        left = [p for k in sorted(open_bins) for p in open_bins[k]]
        if left:
            yield record(left, False)

    source = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return source.mapInArrow(run, PIECES)


def settle(key, left: pa.Table, capacity: int) -> pa.Table:
    """Bins for the leftovers of a few neighbouring workers: whole bins of a class first, the rest by first fit, longest first."""
    left = left.sort_by([("length", "descending"), ("worker", "ascending"), ("doc_id", "ascending"), ("start", "ascending")])
    rooms: list[int] = []
    seq, offset = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
    lengths = left["length"].to_numpy(zero_copy_only=False)
    kinds = np.array([class_of(int(n), capacity) for n in lengths], np.int64)
    rest = []
    for k in np.unique(kinds):
        own = np.flatnonzero(kinds == k)
        whole = len(own) // k * k
        for i in range(0, whole, k):
            group = own[i : i + k]
            seq[group] = len(rooms)
            offset[group] = np.cumsum(lengths[group]) - lengths[group]
            rooms.append(capacity)
        rest.extend(own[whole:])
    shared = len(rooms)
    for i in sorted(rest):
        for b in range(shared, len(rooms)):
            if rooms[b] + lengths[i] <= capacity:
                break
        else:
            b = len(rooms)
            rooms.append(0)
        seq[i], offset[i] = b, rooms[b]
        rooms[b] += lengths[i]
    names = left.column_names
    left = left.set_column(names.index("sequence_id"), "sequence_id", pa.array((1 << 62) + (key[0].as_py() << 32) + seq))
    return left.set_column(names.index("offset"), "offset", pa.array(offset))


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece with its sequence and place there."""
    made = materialize(pieces(docs, path, capacity), "pieces")
    placed = made.filter(F.col("sequence_id").isNotNull())
    group = F.floor(F.col("worker") / NEIGHBOURS).alias("group")
    left = made.filter(F.col("sequence_id").isNull()).groupBy(group).applyInArrow(lambda key, rows: settle(key, rows, capacity), PIECES)
    return placed.unionByName(left).drop("worker")
