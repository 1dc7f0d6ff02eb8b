"""Operator 9: byte-level BPE encoding and decoding by batched numpy merge rounds.

All distinct pre-tokens of a batch lie in one flat symbol array. A round finds the rank of every
adjacent pair by binary search over sorted pair keys, takes the lowest rank of each word and merges
its occurrences, in every word at once; words without a mergeable pair leave the array. Encoded words
stay in a bounded store in the worker, so a frequent word is merged once.

Nulls and empty texts give no ids; the digests are then those of empty input. Texts of any length are coded whole, a few
at a time. Rows are independent: repeated rows change nothing, further columns are ignored, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from .common import ranges, sliced

#: Fixed: the pre-token pattern of the byte-level vocabulary.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Outside Latin, Greek, Cyrillic, general punctuation, kana, common Han, Hangul and emoji, new letters are still being assigned.
UNSETTLED = regex.compile(r"[^\x00-\u052f\u1e00-\u206f\u3000-\u30ff\u4e00-\u9fef\uac00-\ud7a3\U0001f300-\U0001f64f]")
STORE_WORDS = 400_000
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in the vocabulary file: itself if printable, else 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Numbering(dict):
    """Numbers words in the order they are met; fresh holds the new ones."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        return number


class ByteBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        back = {c: b for b, c in byte_alphabet().items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        pieces = [b""] * size
        for token, i in vocab.items():
            pieces[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for token, i in self.special.items():
            pieces[i] = token.encode()
        self.byte_ids = np.array([vocab[c] for _, c in sorted(byte_alphabet().items())], np.int64)
        self.size = size
        pairs = [m if isinstance(m, (list, tuple)) else m.split(" ") for m in merges]
        keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.piece_len = np.array([len(p) for p in pieces], np.int64)
        self.piece_at = np.cumsum(self.piece_len) - self.piece_len
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.splitter = ByteLevel(add_prefix_space=False, use_regex=True)
        self.pretoken = regex.compile(PRETOKEN)
        self.clear()

    def clear(self) -> None:
        self.index = Numbering()
        self.ids, self.at, self.len = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and the number of ids of each word."""
        lengths = np.array([len(w) for w in words], np.int64)
        sym = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        none = len(self.merged)
        done_sym, done_owner = [], []
        while len(sym):
            same = owner[1:] == owner[:-1]
            key = sym[:-1] * self.size + sym[1:]
            slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.full(len(sym), none, np.int64)
            rank[:-1] = np.where(same & (self.keys[slot] == key), self.ranks[slot], none)
            first = np.flatnonzero(np.r_[True, ~same])
            sizes = np.diff(np.r_[first, len(sym)])
            least = np.repeat(np.minimum.reduceat(rank, first), sizes)
            idle = least == none
            if idle.any():
                done_sym.append(sym[idle])
                done_owner.append(owner[idle])
                live = ~idle
                sym, owner, rank, least = sym[live], owner[live], rank[live], least[live]
                if not len(sym):
                    break
            hit = rank == least
            # in a run of overlapping hits, such as "aaa", every second one merges, from the left
            pos = np.flatnonzero(hit)
            run = np.r_[True, (np.diff(pos) != 1) | (owner[pos[1:]] != owner[pos[:-1]])]
            begins = np.flatnonzero(run)
            nth = np.arange(len(pos)) - np.repeat(begins, np.diff(np.r_[begins, len(pos)]))
            pos = pos[nth % 2 == 0]
            sym[pos] = self.merged[rank[pos]]
            keep = np.ones(len(sym), bool)
            keep[pos + 1] = False
            sym, owner = sym[keep], owner[keep]
        sym = np.concatenate(done_sym) if done_sym else np.zeros(0, np.int64)
        owner = np.concatenate(done_owner) if done_owner else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        return sym[order], np.bincount(owner, minlength=len(words)).astype(np.int64)

    def pretokens(self, text: str) -> list[str]:
        """By the pattern; where a text holds characters whose class differs between Unicode versions, by the library's own splitter."""
        if UNSETTLED.search(text):
            return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]
        return self.pretoken.findall(text)

    def learn(self, words: list[str]) -> None:
        """Add words to the store."""
        ids, lengths = self.merge([w.encode() for w in words])
        self.at = np.r_[self.at, len(self.ids) + np.cumsum(lengths) - lengths]
        self.len = np.r_[self.len, lengths]
        self.ids = np.r_[self.ids, ids]

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the number of ids of each text."""
        if len(self.index) > STORE_WORDS:
            self.clear()
        number, slots, counts = self.index.__getitem__, [], []
        for text in texts:
            parts = self.split_special.split(text) if self.split_special and any(s in text for s in self.special) else [text]
            n = 0
            for i, part in enumerate(parts):
                if i % 2:
                    own = np.array([-1 - self.special[part]], np.int64)
                else:
                    words = self.pretokens(part)
                    own = np.fromiter(map(number, words), np.int64, len(words))
                slots.append(own)
                n += len(own)
            counts.append(n)
        if self.index.fresh:
            self.learn(self.index.fresh)
            self.index.fresh = []
        slot = np.concatenate(slots) if slots else np.zeros(0, np.int64)
        plain = slot >= 0
        safe = np.where(plain, slot, 0)
        length = np.where(plain, self.len[safe], 1) if len(self.len) else np.ones(len(slot), np.int64)
        out = np.empty(int(length.sum()), np.int64)
        ends = np.cumsum(length)
        which = np.repeat(plain, length)
        out[which] = self.ids[ranges(self.at[slot[plain]], length[plain])] if plain.any() else 0
        out[~which] = -1 - slot[~plain]
        bounds = np.r_[0, np.cumsum(np.array(counts, np.int64))]
        total = np.r_[0, ends]
        return out, np.diff(total[bounds])

    def decode(self, ids: np.ndarray) -> str:
        raw = self.piece_bytes[ranges(self.piece_at[ids], self.piece_len[ids])].tobytes()
        return raw.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def bpe(path: str) -> ByteBPE:
    return ByteBPE(path)


def chunks(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Slices of about most characters, at least one text each."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, path: str, ids: bool = False) -> DataFrame:
    """Token counts and digests of every text; with ids also the ids and the decoded text themselves."""

    def run(batches):
        model = bpe(path)
        for batch in sliced(batches):
            texts = batch.column("text").to_pylist()
            for a, b in chunks(texts):
                flat, n = model.encode_batch(texts[a:b])
                ends = np.cumsum(n)
                own = [flat[e - k : e] for e, k in zip(ends, n)]
                back = [model.decode(x) for x in own]
                cols = {
                    "doc_id": batch.column("doc_id").slice(a, b - a),
                    "n_tokens": pa.array(n, pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in own], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string()),
                }
                if ids:
                    cols |= {"ids": pa.array([x.tolist() for x in own], pa.list_(pa.int32())), "decoded": pa.array(back, pa.string())}
                yield pa.RecordBatch.from_pydict(cols)

    source = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return source.mapInArrow(run, SCHEMA + (", ids array<int>, decoded string" if ids else ""))
