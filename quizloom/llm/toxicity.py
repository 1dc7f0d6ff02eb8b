"""Operator 2: toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel of order p sums, over the subsequences of p characters that two strings share, the decay to
the power of the characters that the subsequence spans in either, so a gap or an inserted character
lowers a match and doesn't lose it. A sentence meets each landmark with its best token; the values against the
landmarks times the inverse root of the landmarks' own kernel matrix are the Nystroem features of a linear
support vector machine over sentences. A label is of a whole document, so the machine is fitted in turns: the sentences of
clean documents are clean; of a toxic one those count as toxic that the machine finds so, and at least its
worst one. What the sentences of a document come to (the highest margin, the sum of margins and of the values with each
landmark, and these sums by its length) is then calibrated on labelled documents.

Tokens are folded first: lower case, common digit and sign substitutes back to letters, marks and
separators out, runs of single letters joined; then their beginning and end are marked. Landmarks are beginnings
of tokens, or whole ones, that far more toxic than clean training rows hold. A token that has all but
MISSING of a landmark's letters in their order, whatever stands between them, is put to the kernel in windows
twice as long as the landmark; other tokens have the value 0 with it.

Fitting reads at most FIT_TOXIC and FIT_CLEAN labelled rows (those with the smallest hash of their id) and
never lang, source or the id. Their tokens are counted and their sentences measured where they lie; counts of candidate
landmarks and sentence values go to the driver, no texts. Scoring reads every text whole. A worker meets each
distinct token once.

Nulls and empty texts score as a text without any landmark. Rows that are repeated score alike; several
labels of one id count as toxic if one is, and one row of a repeated id is fitted on. Without labelled rows of
both kinds, or where nothing tells them apart, all scores are 0. An empty table gives an empty result. Further
columns are ignored, or kept as they are if asked for.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc, materialize, one_row_each, sliced

ORDER, DECAY = 4, 0.7
FIT_TOXIC, FIT_CLEAN = 3000, 6000
LANDMARKS = 64
CANDIDATES = 5000  #: most beginnings of tokens that are looked at as landmarks
LETTERS = (5, 11)  #: of a landmark, with the marks of beginning and end
RATIO, EVIDENCE = 5, 25  #: how many times more frequent in toxic rows, and by which likelihood ratio
PREDICT = 0.7
MISSING = 1
BEGIN, END = "^", "$"
STORE_TOKENS = 200_000
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
#: What digits and signs stand for inside a word.
SUBSTITUTES = str.maketrans("0134578@$!|", "oieastbasil")
WIDEST = 40  #: kernels see long tokens through overlapping windows of this width

MARKED = regex.compile(r"[^\p{L}]")
EDGES = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$")
SINGLES = re.compile(r"(?<!\S)(?:\S ){3,}\S(?!\S)")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def fold(token: str) -> str:
    """A raw token as the kernel sees it; digits are substitutes only beside letters."""
    low = token.lower().strip(".,;:!?")
    if low.isalpha():
        return low
    letters = sum(c.isalpha() for c in low)
    if 2 * letters > len(low):
        low = EDGES.sub("", low).translate(SUBSTITUTES)
    return MARKED.sub("", low)


def raw_tokens(text: str) -> set[str]:
    """The distinct raw tokens of a text, spelled-out words joined as well."""
    out = set(text.split())
    if joined := SINGLES.findall(text):
        for word in (j.replace(" ", "") for j in joined):
            out |= {word, word[1:], word[:-1]}  # the letter before or after may be a word of its own
    return out


def words_long(text: str) -> int:
    """How long a text is, in words of six letters; spelled-out words count as others do."""
    return sum(map(len, text.split())) // 6


def codes(strings: list[str], width: int) -> np.ndarray:
    flat = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32)
    n = np.fromiter(map(len, strings), np.int64, len(strings))
    out = np.zeros((len(strings), width), np.uint32)
    out[np.arange(width) < n[:, None]] = flat
    return out


def kernel(s: np.ndarray, landmark: str, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """The subsequence kernel of each string (rows of character codes, 0 after the end) with the landmark, by its dynamic programme over all strings at once."""
    count, width = s.shape
    m = len(landmark)
    t = np.frombuffer(landmark.encode("utf-32-le"), np.uint32)
    inner = np.ones((m + 1, count, width + 1), np.float32)
    total = np.zeros(count, np.float32)
    for level in range(1, order + 1):
        fresh = np.zeros_like(inner)
        if level == order:
            for j in range(1, m + 1):
                total += decay**2 * ((s == t[j - 1]) * inner[j - 1, :, :-1]).sum(axis=1)
            break
        for j in range(level, m + 1):
            hit = decay**2 * (s == t[j - 1]) * inner[j - 1, :, :-1]
            run = np.zeros(count, np.float32)
            for i in range(width):
                run = decay * run + hit[:, i]
                fresh[j, :, i + 1] = decay * fresh[j - 1, :, i + 1] + run
        inner = fresh
    return total


def windows(token: str) -> list[str]:
    if len(token) <= WIDEST:
        return [token]
    return [token[i : i + WIDEST] for i in range(0, len(token) - WIDEST // 2, WIDEST // 2)]


def best_windows(c: np.ndarray, landmark: str) -> np.ndarray:
    """The highest kernel of a window of each string that is twice as long as the landmark: room for a letter between any two."""
    width = 2 * len(landmark)
    if c.shape[1] <= width:
        return kernel(c, landmark)
    views = np.lib.stride_tricks.sliding_window_view(c, width, axis=1)
    use = np.arange(views.shape[1]) <= np.maximum((c > 0).sum(axis=1) - width, 0)[:, None]
    value = np.zeros(use.shape, np.float32)
    value[use] = kernel(views[use], landmark)
    return value.max(axis=1)


def common_letters(letters: np.ndarray, masks: np.ndarray, size: int) -> np.ndarray:
    """The longest common subsequence of each string (rows of letter numbers) with a landmark of this size, by the bits of its rows.

    masks: for each letter number the places that it has in the landmark, as bits."""
    row = np.full(len(letters), (1 << size) - 1, np.uint32)
    for i in range(letters.shape[1]):
        hit = row & masks[letters[:, i]]
        row = (row + hit) | (row - hit)
    row &= np.uint32((1 << size) - 1)
    return size - np.bitwise_count(row).astype(np.int64)


class Model:
    """Landmarks, their scale, the map to Nystroem features, weights and calibration."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        self.own = np.array([kernel(codes([x], len(x)), x)[0] for x in landmarks])
        self.alphabet = np.array(sorted(set("".join(landmarks))))
        every = codes(landmarks, max(map(len, landmarks)))
        gram = np.stack([np.minimum(kernel(every, x) / np.sqrt(self.own * o), 1.0) for x, o in zip(landmarks, self.own)], axis=1).astype(np.float64)
        value, vector = np.linalg.eigh((gram + gram.T) / 2)
        self.root = vector / np.sqrt(np.maximum(value, 1e-2)) @ vector.T
        self.masks = np.zeros((len(landmarks), len(self.alphabet) + 1), np.uint32)
        for k, mark in enumerate(landmarks):
            for i, letter in enumerate(mark):
                self.masks[k, 1 + np.searchsorted(self.alphabet, letter)] |= 1 << i
        self.forget()

    def forget(self) -> None:
        self.known: set[str] = set()
        self.hot: dict[str, np.ndarray] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": set(), "hot": {}}

    def meet(self, tokens: list[str]) -> None:
        """Values of new raw tokens."""
        self.known.update(tokens)
        folded: dict[str, list[str]] = {}
        for raw in tokens:
            if len(w := fold(raw)) >= ORDER:
                folded.setdefault(BEGIN + w + END, []).append(raw)
        parts = [(p, w) for w in folded for p in windows(w)]
        for low, width in ((0, 10), (10, 14), (14, 20), (20, WIDEST)):
            alike = [x for x in parts if low < len(x[0]) <= width]
            for a in range(0, len(alike), 20_000):
                self.match(alike[a : a + 20_000], folded, width)

    def match(self, parts: list[tuple[str, str]], folded: dict[str, list[str]], width: int) -> None:
        c = codes([p for p, _ in parts], width)
        alphabet = np.array([ord(x) for x in self.alphabet], np.uint32)
        slot = np.minimum(np.searchsorted(alphabet, c), len(alphabet) - 1)
        letters = np.where(alphabet[slot] == c, slot + 1, 0)
        for k, mark in enumerate(self.landmarks):
            near = np.flatnonzero(common_letters(letters, self.masks[k], len(mark)) >= len(mark) - MISSING)
            for b in range(0, len(near), 4096):
                group = near[b : b + 4096]
                value = np.minimum(best_windows(c[group], mark) / self.own[k], 1.0)
                for i in np.flatnonzero(value > 0):
                    for raw in folded[parts[group[i]][1]]:
                        if raw not in self.hot:
                            self.hot[raw] = np.zeros(len(self.landmarks))
                        self.hot[raw][k] = max(self.hot[raw][k], value[i])

    def sentences(self, texts: list[str]) -> list[np.ndarray]:
        """For each text the values of those of its sentences that meet a landmark: the best of the sentence's tokens with each."""
        if len(self.known) > STORE_TOKENS:
            self.forget()
        sets = [raw_tokens(t) for t in texts]
        self.meet(list(set().union(*sets).difference(self.known)) if sets else [])
        out = []
        for text, own in zip(texts, sets):
            rows = []
            if own & self.hot.keys():
                for sentence in SENTENCE.split(text):
                    hits = [self.hot[t] for t in raw_tokens(sentence) if t in self.hot]
                    if hits:
                        rows.append(np.max(hits, axis=0))
            out.append(np.array(rows) if rows else np.zeros((0, len(self.landmarks))))
        return out

    def margins(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x @ self.root, np.ones((len(x), 1))]) @ self.weights

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 1000, ridge: float = 1e-5) -> None:
        """Squared-hinge support vector machine by Nesterov's gradient steps."""
        z = np.hstack([x @ self.root, np.ones((len(x), 1))])
        sign = np.where(y > 0, 1.0, -1.0)
        weight = weight / weight.sum()
        step = 1 / (2 * np.linalg.eigvalsh((z * weight[:, None]).T @ z)[-1] + ridge)
        w = ahead = np.zeros(z.shape[1])
        for k in range(rounds):
            slack = np.maximum(1 - sign * (z @ ahead), 0)
            new = ahead - step * (ridge * ahead - 2 * z.T @ (weight * slack * sign))
            ahead, w = new + k / (k + 3) * (new - w), new
        self.weights = w

    def learn(self, rows: list[np.ndarray], sizes: np.ndarray, toxic: np.ndarray, turns: int = 3) -> None:
        """rows: the sentence values of each labelled document; sizes: its length.

        Landmarks with a letter inserted stand beside the toxic sentences, so that the machine knows what gaps look like."""
        bad = [r for r, y in zip(rows, toxic) if y > 0 and len(r)]
        clean = np.vstack([np.zeros((1, len(self.landmarks))), *(r for r, y in zip(rows, toxic) if y <= 0)])
        weigh = np.ones(len(clean))
        weigh[0] = np.sum(toxic <= 0)  # the sentences of clean documents that meet no landmark
        gapped = [m[:i] + "x" + m[i:] for m in (x.strip(BEGIN + END) for x in self.landmarks) for i in range(2, len(m) - 1)]
        self.meet(gapped)
        gaps = np.array([self.hot.get(g, np.zeros(len(self.landmarks))) for g in gapped]).reshape(-1, len(self.landmarks))
        chosen = bad
        for _ in range(turns):
            found = np.vstack([*chosen, gaps])
            share = np.r_[np.ones(len(found) - len(gaps)), np.full(len(gaps), 0.2 * max(1, len(found) - len(gaps)) / max(1, len(gaps)))]
            self.fit(np.vstack([found, clean]), np.r_[np.ones(len(found)), np.zeros(len(clean))], np.r_[share, weigh])
            margins = [self.margins(r) for r in bad]
            chosen = [r[(m > 0) | (m == m.max())] for r, m in zip(bad, margins)]
        self.calibration = sigmoid_fit(np.array([self.evidence(r, n) for r, n in zip(rows, sizes)]), toxic)
        self.forget()

    def evidence(self, rows: np.ndarray, words: int) -> np.ndarray:
        """Of a document: its sentences' highest margin, the sum of what reaches beyond the clean side, that sum by its length; and the same two of the values with each landmark."""
        margin = np.r_[self.margins(np.zeros((1, len(self.landmarks)))), self.margins(rows)]
        total = np.clip((1 + margin[1:]) / 2, 0, 1).sum()
        near = (rows**2).sum(axis=0)
        share = lambda v: np.minimum(100 * v / (words + 50), 10)
        return np.r_[np.clip(margin.max(), -2, 2), np.log1p(total), share(total), np.log1p(near), share(near)]

    def score(self, texts: list[str]) -> np.ndarray:
        x = np.array([self.evidence(r, words_long(t)) for r, t in zip(self.sentences(texts), texts)]).reshape(len(texts), -1)
        return 1 / (1 + np.exp(-np.clip(log_odds(x, self.calibration), -30, 30)))


def sigmoid_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A sigmoid of some figures, by Newton's steps: their means, scales and weights."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    target = np.where(y > 0, 1 - 1 / (np.sum(y > 0) + 2), 1 / (np.sum(y <= 0) + 2))
    flat = np.r_[np.full(z.shape[1] - 1, ridge), 1e-6]
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = p * (1 - p) + 1e-9
        step = np.linalg.solve((z * h[:, None]).T @ z + np.diag(flat), z.T @ (p - target) + flat * w)
        w -= step * min(1.0, 2 / max(np.abs(step).max(), 1e-12))
    return mean, scale, w


def log_odds(x: np.ndarray, fitted: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    mean, scale, w = fitted
    return (x - mean) / scale @ w[:-1] + w[-1]


def beginnings(text: str) -> set[str]:
    """The beginnings of a text's folded and marked tokens that may be landmarks."""
    low, high = LETTERS
    out = set()
    for w in {fold(t) for t in raw_tokens(text)}:
        if len(w) >= ORDER:
            w = BEGIN + w + END
            out.update(w[:n] for n in range(low, min(high, len(w)) + 1))
    return out


def likelihood_ratio(k: np.ndarray, n: int, c: np.ndarray, m: int) -> np.ndarray:
    """Of k in n against c in m, twice its logarithm."""
    part = lambda a, b, p: a * np.log(np.maximum(p, 1e-12)) + (b - a) * np.log(np.maximum(1 - p, 1e-12))
    both = (k + c) / (n + m)
    return 2 * (part(k, n, k / n) + part(c, m, c / m) - part(k, n, both) - part(c, m, both))


def choose(names: list[str], toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int, holders: list[set[int]], most: int = LANDMARKS) -> list[str]:
    """Landmarks: greedily those that tell most toxic rows apart, until each row has three or none is left; of those that hold for the same rows the longest."""
    least = max(3, n_toxic // 200)
    ratio = (toxic / n_toxic) / ((clean + 0.5) / n_clean)
    good = [i for i in range(len(names)) if toxic[i] >= least and ratio[i] >= RATIO]
    cover = np.zeros(n_toxic, int)
    out: list[str] = []
    while good and len(out) < most:
        gain = {i: sum(cover[r] < 3 for r in holders[i]) for i in good}
        best = max(good, key=lambda i: (gain[i] * np.log(ratio[i]), len(names[i]), names[i]))
        if gain[best] < least:
            break
        rows = holders[best]
        best = max((i for i in good if names[i].startswith(names[best]) and len(holders[i]) >= 0.95 * len(rows)), key=lambda i: len(names[i]))
        out.append(names[best])
        cover[list(rows)] += 1
        good = [i for i in good if not (names[i].startswith(names[best]) or names[best].startswith(names[i])) or len(holders[i] - rows) >= least]
        good = [i for i in good if i != best]
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """At most FIT_TOXIC and FIT_CLEAN rows (row, toxic, text) whose crc32 of the id is not 1 modulo 3, written once."""
    marked = labels.filter(F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    marked = marked.filter(id_crc(F.col("doc_id")) % 3 != 1)
    place = F.xxhash64("doc_id")
    picked = [marked.filter(of).orderBy(place, "doc_id").limit(n) for of, n in ((F.col("toxic") == 1, FIT_TOXIC), (F.col("toxic") != 1, FIT_CLEAN))]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    held = one_row_each(rows.join(picked[0].union(picked[1]), "doc_id"))
    return materialize(held.select(F.xxhash64("doc_id").alias("row"), "toxic", "text").repartition(24, "row"), "sample")


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model of the labelled rows whose crc32 of the id is not 1 modulo 3."""
    sample = labelled_sample(docs, labels)
    sizes = {bool(r["t"]): r["n"] for r in sample.groupBy((F.col("toxic") == 1).alias("t")).agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    if not n_toxic or not n_clean:
        return None

    def count(batches):
        toxic, clean = Counter(), Counter()
        for batch in sliced(batches, 64):
            for t, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
                (toxic if t == 1 else clean).update(beginnings(text))
        names = list(toxic.keys() | clean.keys())
        for a in range(0, len(names), 50_000):
            own = names[a : a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([toxic[g] for g in own], pa.int64()), pa.array([clean[g] for g in own], pa.int64())], names=["name", "toxic", "clean"])

    counts = sample.mapInArrow(count, "name string, toxic long, clean long").groupBy("name").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    more = F.col("toxic") / n_toxic >= RATIO * (F.col("clean") + 0.5) / n_clean
    found = counts.filter((F.col("toxic") >= max(3, n_toxic // 200)) & more).orderBy(F.desc("toxic"), "clean", "name").limit(CANDIDATES).toArrow()
    k, c = (found.column(x).to_numpy().astype(float) for x in ("toxic", "clean"))
    sure = likelihood_ratio(k, n_toxic, c, n_clean) >= EVIDENCE
    names = found.filter(pa.array(sure)).column("name").to_pylist()
    if not names:
        return None
    place = {g: i for i, g in enumerate(names)}

    def hold(batches):
        for batch in sliced(batches, 64):
            own = [sorted(place[g] for g in beginnings(t) & place.keys()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(own, pa.list_(pa.int32()))], names=["row", "held"])

    held = sample.filter("toxic = 1").select("row", "text").mapInArrow(hold, "row long, held array<int>").toArrow().sort_by("row").column("held").to_pylist()
    holders: list[set[int]] = [set() for _ in names]
    for i, own in enumerate(held):
        for g in own:
            holders[g].add(i)
    marks = choose(names, k[sure], c[sure], n_toxic, n_clean, holders)
    if not marks:
        return None
    model = Model(marks)

    def measure(batches):
        for batch in sliced(batches, 64):
            texts = batch.column("text").to_pylist()
            rows = model.sentences(texts)
            flat = [r.astype(np.float32).ravel() for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("toxic"), pa.array([words_long(t) for t in texts], pa.int64()), pa.array(flat, pa.list_(pa.float32()))], names=["row", "toxic", "size", "values"])
        model.forget()  # the worker lives on

    got = sample.mapInArrow(measure, "row long, toxic int, size long, values array<float>").toArrow().sort_by("row")
    rows = [np.array(v.as_py(), float).reshape(-1, len(marks)) for v in got.column("values")]
    model.learn(rows, got.column("size").to_numpy(), (got.column("toxic").to_numpy() == 1).astype(int))
    return model


def score(docs: DataFrame, model: Model | None, keep: str | None = None) -> DataFrame:
    """Scores of all texts; with keep a row per row of docs with all of its columns and the score under that name, which none of them may have."""
    if keep and keep.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the input has a column {keep}")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most LANDMARKS landmarks

    def run(batches):
        own = shared.value
        for batch in sliced(batches, 256):
            texts = [t or "" for t in batch.column(batch.schema.names.index("text")).to_pylist()]
            value = own.score(texts) if own else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value, pa.float64())], names=[*batch.schema.names, keep or "score"])
        if own:
            own.forget()  # the worker lives on

    if keep:
        from pyspark.sql.types import DoubleType, StructType

        return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(keep, DoubleType()))
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    scored = rows.mapInArrow(run, "doc_id long, text string, score double")
    held = (id_crc(F.col("doc_id")) % 3 == 1).alias("held_out")
    return scored.select("doc_id", held, "score", (F.col("score") >= PREDICT).cast("int").alias("predicted"))
