"""Operator 5: a quality classifier by co-training of two views.

The content view of a document is the distribution of its bytes and how its words, lines and word pairs
repeat; the metadata view is its language, source, length and layout. Each view has a logistic
classifier. Over the rounds each one labels the pool rows that it is surest of, as many of either class
as the labelled rows' share says, and hands them to the other view as training rows of half weight. Then
each view is calibrated on labelled rows that it was not fitted on, and the calibrated log-odds of the
views add up, less the prior that both hold.

Fitting reads at most FIT labelled ids and POOL others (those with the smallest hash) whose
crc32 is not 1 modulo 3, and one row of each; scoring reads every text whole.

Nulls count as empty text, language, source or length. Rows that are repeated score alike; several labels
of one id count as good only if all are. Without labelled rows of both kinds all scores are 0.5 and all
rows are kept. An empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc, one_row_each, sliced

FIT, POOL = 8000, 8000
TURNS, HANDED = 5, 200
SURE = 0.97
KEEP = 0.5
SCHEMA = "doc_id long, held_out boolean, content_score double, metadata_score double, score double, kept boolean"
LANGS, SOURCES = 16, 64


def content(texts: list[str]) -> np.ndarray:
    """Roots of the byte shares, and figures of repetition and form."""
    out = np.zeros((len(texts), 256 + 9))
    for i, text in enumerate(texts):
        raw = text.encode()
        if not raw:
            continue
        out[i, :256] = np.sqrt(np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / len(raw))
        words = text.split()
        n = max(len(words), 1)
        distinct = len(set(words))
        runs = sum(a == b for a, b in zip(words, words[1:]))
        twos = len(set(zip(words, words[1:])))
        lines = text.split("\n")
        out[i, 256:] = [
            distinct / n,
            runs / n,
            twos / n,
            len(set(lines)) / len(lines),
            np.log1p(len(raw) / n),
            np.log1p(n) / 10,
            sum(w.isupper() for w in words) / n,
            sum(w.isalpha() for w in words) / n,
            max(map(len, words), default=0) / (20 + max(map(len, words), default=0)),
        ]
    return out


def hashed(value: str | None, size: int) -> int:
    return zlib.crc32((value or "").encode()) % size


def metadata(langs: list, sources: list, lengths: list, texts: list[str]) -> np.ndarray:
    """Language, source, length class and layout."""
    out = np.zeros((len(texts), LANGS + SOURCES + 24 + 3))
    for i, (lang, source, length, text) in enumerate(zip(langs, sources, lengths, texts)):
        out[i, hashed(lang, LANGS)] = 1
        out[i, LANGS + hashed(source, SOURCES)] = 1
        out[i, LANGS + SOURCES + min(int(np.log2(max(length or 0, 0) + 1)), 23)] = 1
        lines = text.count("\n") + 1
        out[i, -3:] = [np.log1p(length or 0) / 10, np.log1p(lines) / 5, np.log1p(len(text) / lines) / 8]
    return out


class Logistic:
    """Weighted logistic regression on standardised columns, by Newton's steps."""

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> Logistic:
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
        z = np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])
        w = np.zeros(z.shape[1])
        flat = np.r_[np.full(z.shape[1] - 1, ridge), 1e-6]
        for _ in range(12):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            h = weight * p * (1 - p) + 1e-9
            step = np.linalg.solve((z * h[:, None]).T @ z + np.diag(flat), z.T @ (weight * (p - y)) + flat * w)
            w -= step
            if np.abs(step).max() < 1e-4:
                break
        self.weights = w
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -20, 20) @ self.weights[:-1] + self.weights[-1]


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    one = Logistic().fit(margin[:, None], y, np.ones(len(y)), ridge=1e-3)
    a = max(one.weights[0] / one.scale[0], 0.0)
    return a, float(one.weights[1] - a * one.mean[0])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class CoTrained:
    def __init__(self, views: list[np.ndarray], y: np.ndarray, pool: list[np.ndarray], turns: int = TURNS, handed: int = HANDED):
        """views, pool: the rows of each view, labelled and not. Every third labelled row is left for calibration."""
        self.prior = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        spare = np.arange(len(y)) % 3 == 2
        if len(set(y[~spare])) < 2 or len(set(y[spare])) < 2:
            spare = np.zeros(len(y), bool)
        rows = [[v[~spare]] for v in views]
        marks = [[y[~spare]] for _ in views]
        weight = [[np.ones((~spare).sum())] for _ in views]
        left = [np.ones(len(pool[0]), bool) for _ in views]  # pool rows that a view hasn't been given
        fit = lambda k: Logistic().fit(np.vstack(rows[k]), np.concatenate(marks[k]), np.concatenate(weight[k]))
        self.models = [fit(k) for k in range(2)]
        self.handed = [0, 0]
        for _ in range(turns):
            news = []
            for k in range(2):
                p = sigmoid(self.models[k].margin(pool[k])) if len(pool[k]) else np.zeros(0)
                free = left[1 - k]
                good = np.flatnonzero(free & (p >= SURE))
                bad = np.flatnonzero(free & (p <= 1 - SURE))
                good = good[np.argsort(-p[good], kind="stable")][: max(1, round(handed * self.prior))]
                bad = bad[np.argsort(p[bad], kind="stable")][: max(1, round(handed * (1 - self.prior)))]
                news.append((1 - k, np.r_[good, bad], np.r_[np.ones(len(good)), np.zeros(len(bad))]))
            for k, which, mark in news:
                left[k][which] = False
                self.handed[k] += len(which)
                rows[k].append(pool[k][which])
                marks[k].append(mark)
                weight[k].append(np.full(len(which), 0.5))
            self.models = [fit(k) for k in range(2)]
        held = spare if spare.any() else np.ones(len(y), bool)
        self.calibration = [platt(m.margin(v[held]), y[held]) for m, v in zip(self.models, views)]

    def score(self, views: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        odds = [a * m.margin(v) + b for m, v, (a, b) in zip(self.models, views, self.calibration)]
        return sigmoid(odds[0]), sigmoid(odds[1]), sigmoid(odds[0] + odds[1] - np.log(self.prior / (1 - self.prior)))


def views_of(batch) -> list[np.ndarray]:
    texts = [t or "" for t in batch.column("text").to_pylist()]
    return [content(texts), metadata(*[batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")], texts)]


def fit(docs: DataFrame, labels: DataFrame) -> CoTrained | None:
    """The views of a bounded sample go to the driver, no texts."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", "lang", "source", F.col("n_chars").cast("long")).filter(id_crc(F.col("doc_id")) % 3 != 1)
    marks = labels.filter(F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    place = F.xxhash64("doc_id")
    marked = marks.filter(id_crc(F.col("doc_id")) % 3 != 1).orderBy(place, "doc_id").limit(FIT)
    others = rows.select("doc_id").distinct().join(marks, "doc_id", "left_anti").orderBy(place, "doc_id").limit(POOL).select("doc_id", F.lit(None).cast("int").alias("quality"))

    def run(batches):
        for batch in sliced(batches, 256):
            a, b = views_of(batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(a.tolist(), pa.list_(pa.float64())), pa.array(b.tolist(), pa.list_(pa.float64()))], names=["doc_id", "quality", "content", "metadata"])

    got = one_row_each(rows.join(marked.union(others), "doc_id")).mapInArrow(run, "doc_id long, quality int, content array<double>, metadata array<double>").toArrow().sort_by("doc_id")
    known = np.array(got.column("quality").is_valid())
    if not known.any():
        return None
    views = [np.array(got.column(c).combine_chunks().flatten()).reshape(len(got), -1) for c in ("content", "metadata")]
    y = np.array(got.column("quality").to_pylist(), float)[known]
    if len(set(y)) < 2:
        return None
    return CoTrained([v[known] for v in views], (y > 0).astype(float), [v[~known] for v in views])


def score(docs: DataFrame, model: CoTrained | None) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two weight vectors

    def run(batches):
        own = shared.value
        for batch in sliced(batches, 256):
            got = own.score(views_of(batch)) if own else [np.full(len(batch), 0.5)] * 3
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *map(pa.array, got), pa.array(got[2] >= KEEP)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long"), "text", "lang", "source", F.col("n_chars").cast("long"), (id_crc(F.col("doc_id")) % 3 == 1).alias("held_out"))
    return rows.mapInArrow(run, SCHEMA)
