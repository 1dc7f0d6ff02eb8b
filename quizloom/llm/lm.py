"""Operator 4: language-model scores from a weighted backoff automaton.

The n-grams of the training rows, smoothed, become states with failure arcs. A state is a context: the root
for none, one for each n-gram of up to ORDER - 1 tokens that was seen, and those of a text's start. For
each token seen after a context its state has an arc, weighted log10((c + STRENGTH * p) / (C + STRENGTH)), with
c and C the counts of n-gram and context and p the token's probability in the next shorter context; the arc leads to the
longest context that the token then ends. A failure arc, weighted log10(STRENGTH / (C + STRENGTH)), leads to the next
shorter context. The root has an arc for every token, with the add-0.1 weights of single tokens. A text is read once from
left to right: its state is carried from token to token, and what its arcs weigh is added up. Many texts are read
side by side; long ones are read in stretches, each of which first takes in the few tokens before it, as no state is
longer than that.

The model is never in one place. Rows are dealt to buckets by a hash of id and text; a bucket sends its
distinct n-grams with their training counts to shards by key range, a shard adds up and answers each bucket for
exactly the n-grams that it holds, and the bucket builds the part of the automaton that its texts can
reach. Counts of single tokens are exact (80 bits of hash); longer n-grams carry as many bits as the
corpus needs for a false match in 65,536. What moves grows with the input. A frequent n-gram is one entry per bucket.

Nulls and empty texts have the end token only. Repeated rows count and are scored each. Rows with a null
id count as those with an empty one. Without training rows every token has probability one. An empty
table gives an empty result; further columns are ignored, whatever their names. Long texts are only split to be read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Numbering
from .common import id_crc, materialize, mix64, text_parts
from .tallies import BLOBS, KEY_BITS, TOTALS, add_up, answered, bits_for, blobs

HELD_OUT_EVERY = 10
STRENGTH = 2.0  #: how many tokens of a context the next shorter context weighs as much as
ORDER = 3
ADD = 0.1
BUCKET_BYTES = 6 << 20
STRETCH = 128
#: Numbers of the end token and of the start, before any word.
END, START = 0, 1

SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def read_tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token numbers of all texts, one after another, tokens per text, and 128 bits of hash of each number, as two columns."""
    words = Numbering()
    words[b"\n"], words[b"\r"] = END, START  # no word holds white space
    own, n = [], []
    for text in texts:
        w = text.encode().lower().split()
        own.append(np.fromiter(map(words.__getitem__, w), np.int64, len(w)))
        own.append(np.array([END], np.int64))
        n.append(len(w) + 1)
    hashes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), ">u8").astype(np.uint64).reshape(-1, 2)
    return np.concatenate(own) if own else np.zeros(0, np.int64), np.array(n, np.int64), hashes


class Grams:
    """The distinct n-grams of a bucket, level by level, and which of them ends at each token."""

    def __init__(self, texts: list[str], order: int, bits: int = KEY_BITS):
        self.tokens, self.n, hashes = read_tokens(texts)
        self.first = np.cumsum(self.n) - self.n
        self.place = np.arange(len(self.tokens)) - np.repeat(self.first, self.n)
        self.words = len(hashes)
        present = np.flatnonzero(np.bincount(self.tokens, minlength=self.words))
        check = hashes[present, 1] & np.uint64(0xFFFFFF)
        key = hashes[present, 0] >> np.uint64(64 - KEY_BITS)
        sort = np.lexsort((check, key))
        self.slot = np.zeros(self.words, np.int64)  # of a token's number among the sorted keys
        self.slot[present[sort]] = np.arange(len(present))
        #: per level: sorted keys, the key that ends at each token, the first token at which each key ends, bits
        self.levels = [(key[sort], self.slot[self.tokens], None, KEY_BITS)]
        self.checks = check[sort]
        own = hashes[:, 0][self.tokens]
        full = own
        with np.errstate(over="ignore"):
            for back in range(1, order):
                left = np.empty_like(own)
                left[:back], left[back:] = hashes[START, 0], own[: max(len(own) - back, 0)]
                left[self.place < back] = hashes[START, 0]
                full = mix64(full * np.uint64(0x9E3779B97F4A7C15) + left + np.uint64(back))
                distinct, first, which = np.unique(full >> np.uint64(64 - bits), return_index=True, return_inverse=True)
                self.levels.append((distinct, which, first, bits))

    def counted(self, train: np.ndarray, shards: int, bucket: int) -> pa.Table:
        """Every level's keys with their counts where train holds, by shard."""
        rows = np.repeat(train, self.n)
        levels = []
        for level, (keys, which, _, bits) in enumerate(self.levels):
            counts = np.bincount(which[rows], minlength=len(keys)).astype(np.uint64)
            levels.append((keys, counts, self.checks if not level else None, bits))
        return blobs(bucket, levels, shards)


class Automaton:
    """The states and arcs that some texts can reach. State 0 is the root; then come the contexts of one token, of two and so on, each level's start of text first."""

    def __init__(self, grams: Grams, tables: list[np.ndarray], tokens: int, types: int, strength: float = STRENGTH):
        order, self.words = len(tables), grams.words
        sizes = [len(t) for t in tables[: order - 1]]
        self.begin = np.cumsum([1] + [1 + s for s in sizes]).astype(np.int64)  # of each level's states
        total = int(self.begin[-1])
        self.fail, self.fail_weight = np.zeros(total, np.int64), np.zeros(total)
        # the root's arcs, by token number
        count = np.zeros(self.words)
        present = np.flatnonzero(np.bincount(grams.tokens, minlength=self.words))
        count[present] = tables[0][grams.slot[present]]
        self.base = np.log10((count + ADD) / (tokens + ADD * (types + 1)))
        self.known = count > 0
        self.root_next = np.where((count > 0) & (order > 1), self.begin[0] + 1 + grams.slot, 0)
        self.starts = [int(b) for b in self.begin[: order - 1]]
        probability = [(tables[0] + ADD) / (tokens + ADD * (types + 1))]
        texts = count[END]  # a text's start was met once for each end
        keys, weights, nexts = [], [], []
        for level in range(1, order):  # arcs of contexts of this many tokens
            _, which, first, _ = grams.levels[level]
            seen = tables[level] > 0
            at = first[seen]  # a token at which each seen n-gram ends
            before = grams.levels[level - 1][1]
            inside = grams.place[at] > 0
            state = np.where(inside, self.begin[level - 1] + 1 + before[at - 1], self.begin[level - 1])
            context = np.where(inside, tables[level - 1][before[at - 1]], texts)
            lower = probability[level - 1][grams.levels[level - 1][1][at]]
            p = (tables[level][seen] + strength * lower) / (context + strength)
            own = np.zeros(len(tables[level]))
            own[seen] = p
            probability.append(own)
            here = which[at] if level < order - 1 else before[at]
            nexts.append(self.begin[min(level, order - 2)] + 1 + here)
            keys.append(state * self.words + grams.tokens[at])
            weights.append(np.log10(p))
            # failure arcs of the contexts of this many tokens
            held = tables[level - 1]
            own_states = slice(self.begin[level - 1] + 1, self.begin[level - 1] + 1 + len(held))
            self.fail_weight[own_states] = np.log10(strength / (held + strength))
            self.fail_weight[self.begin[level - 1]] = np.log10(strength / (texts + strength))
            if level > 1:
                _, _, ends, _ = grams.levels[level - 1]
                self.fail[own_states] = self.begin[level - 2] + 1 + grams.levels[level - 2][1][ends]
                self.fail[self.begin[level - 1]] = self.begin[level - 2]
        keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        sort = np.argsort(keys)
        self.keys = np.r_[keys[sort], np.iinfo(np.int64).max]
        self.weights = np.concatenate(weights)[sort] if weights else np.zeros(0)
        self.nexts = np.concatenate(nexts)[sort] if nexts else np.zeros(0, np.int64)

    def read(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One token for each state: the states after it, and what the arcs to them weigh."""
        state, weight = state.copy(), np.zeros(len(state))
        left = np.arange(len(state))
        while len(left):
            at_root = state[left] == 0
            if at_root.any():
                root = left[at_root]
                weight[root] += self.base[token[root]]
                state[root] = self.root_next[token[root]]
                left = left[~at_root]
            key = state[left] * self.words + token[left]
            slot = np.searchsorted(self.keys, key)
            hit = self.keys[slot] == key
            done = left[hit]
            weight[done] += self.weights[slot[hit]]
            state[done] = self.nexts[slot[hit]]
            left = left[~hit]
            weight[left] += self.fail_weight[state[left]]
            state[left] = self.fail[state[left]]
        return state, weight

    def traverse(self, grams: Grams, stretch: int = STRETCH) -> np.ndarray:
        """The weight of each token of the texts, all stretches side by side."""
        out = np.zeros(len(grams.tokens))
        memory = len(self.starts)
        stretch = max(stretch, memory)
        begins = np.flatnonzero(grams.place % stretch == 0)
        ends = np.minimum(begins + stretch, np.repeat(grams.first + grams.n, -(-grams.n // stretch)))
        opening = grams.place[begins] == 0
        state = np.where(opening, self.starts[-1] if memory else 0, 0)
        for back in range(memory, 0, -1):
            inner = np.flatnonzero(~opening)
            state[inner], _ = self.read(state[inner], grams.tokens[begins[inner] - back])
        order = np.argsort(begins - ends, kind="stable")  # longest first
        begins, ends, state = begins[order], ends[order], state[order]
        longest = int((ends - begins)[0]) if len(begins) else 0
        for step in range(longest):
            live = np.searchsorted(begins - ends, -step)  # stretches longer than step
            at = begins[:live] + step
            state[:live], out[at] = self.read(state[:live], grams.tokens[at])
        return out


def scored(texts: list[str], tables: list[np.ndarray], tokens: int, types: int, bits: int, strength: float) -> tuple[np.ndarray, ...]:
    """Per text: tokens, known tokens, base score, score."""
    grams = Grams(texts, len(tables), bits)
    if [len(t) for t in tables] != [len(level[0]) for level in grams.levels]:
        raise RuntimeError("a bucket's rows are not those that were counted: the input changed between two reads")
    machine = Automaton(grams, tables, tokens, types, strength)
    weight = machine.traverse(grams)
    return grams.n, np.add.reduceat(machine.known[grams.tokens].astype(np.int64), grams.first), np.add.reduceat(machine.base[grams.tokens], grams.first), np.add.reduceat(weight, grams.first)


def score(docs: DataFrame, order: int = ORDER, strength: float = STRENGTH, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Scores of all texts under the model of the training rows."""
    docs = docs.select(
        F.col("doc_id").cast("long"),
        F.coalesce("text", F.lit("")).alias("text"),
        (id_crc(F.col("doc_id")) % HELD_OUT_EVERY == 0).alias("held_out"),
    )
    buckets = text_parts(docs, bucket_bytes)
    bits = bits_for(buckets * bucket_bytes // 4)
    dealt = docs.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)))

    def count_bucket(rows: pa.Table) -> pa.Table:
        train = ~rows.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        return Grams(rows.column("text").to_pylist(), order, bits).counted(train, buckets, rows.column("bucket")[0].as_py())

    totals = materialize(dealt.groupBy("bucket").applyInArrow(count_bucket, BLOBS).groupBy("shard").applyInArrow(add_up, TOTALS), "ngrams")
    corpus = totals.filter("bucket = -1").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("types"), F.lit(0)).alias("v")).first()
    n, v = int(corpus["n"]), int(corpus["v"])

    def score_bucket(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(rows):
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.bool_(), *[pa.int64()] * 3, pa.float64(), pa.float64())], names=[c.split()[0] for c in SCHEMA.split(", ")])
        tokens, known, base, own = scored(rows.column("text").to_pylist(), answered(answers, order), n, v, bits, strength)
        cols = [rows.column("doc_id"), rows.column("held_out"), pa.array(tokens), pa.array(known), pa.array(np.full(len(tokens), n, np.int64)), pa.array(base), pa.array(own)]
        return pa.table(cols, names=[c.split()[0] for c in SCHEMA.split(", ")])

    answers = totals.filter("bucket >= 0").select("bucket", "shard", "level", "counts")
    return dealt.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(score_bucket, SCHEMA)
