import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from quizloom.llm import resample


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_buckets(text, order, buckets):
    w = plain_words(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, order + 1) for i in range(len(w) - n + 1)]


def plain(docs, target, order=1, buckets=10_000, seed=2024, share=10, least=20):
    s, t = np.zeros(buckets), np.zeros(buckets)
    own = [plain_buckets(x, order, buckets) for _, x in docs]
    for b in own:
        np.add.at(s, b, 1)
    for x in target:
        np.add.at(t, plain_buckets(x, order, buckets), 1)
    gain = [math.floor(1000 * math.log(((a + 1) * (s.sum() + buckets)) / ((c + 1) * (t.sum() + buckets)))) for a, c in zip(t, s)]
    rows = []
    for (doc, x), b in zip(docs, own):
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[i] for i in b) // len(b) if b else 0
        rows.append((doc, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(plain_words(x))))
    fit = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = [(*r[:4], i + 1) for i, r in enumerate(fit) if i < share * len(fit) // 100]
    return drawn + [(*r[:4], None) for r in fit[len(drawn) :]] + [(*r[:4], None) for r in rows if r[4] < least]


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: [(v is None, v or 0) for v in r])


def corpus(n=300, seed=1):
    rng = np.random.default_rng(seed)
    stems = ["alpha", "Beta", "gamma2", "dé", "日本", "x", "omega", "3", "zeta", "ETA"]
    docs = [(int(i), rng.choice([" ", "\n", ", ", "-"]).join(rng.choice(stems, rng.integers(0, 60)))) for i in range(n)]
    return docs + [(7, docs[7][1])] * 40 + [(None, docs[9][1])] * 30 + [(n + 1, None), (n + 2, ""), (None, None), (n + 3, "one " * 30_000), (n + 4, "z" * 50_000), (n + 5, " ,;\x00 ")]


def frame(spark, docs, parts=5):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)


TARGET = ["alpha beta gamma2 alpha", "omega dé 日本 omega", None, "", "unseen words here"]


@pytest.mark.parametrize("order,block", [(1, 1 << 20), (1, 50), (3, 400)])
def test_scores_and_ranks_as_plain_code(spark, order, block, monkeypatch):
    monkeypatch.setattr(resample, "BLOCK_WORDS", block)
    docs = corpus()
    scored = resample.score(frame(spark, docs), frame(spark, [(i, t) for i, t in enumerate(TARGET)], 2), order=order, buckets=500)
    got = resample.draw(scored, share=25).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert ordered(got) == ordered(plain(docs, TARGET, order=order, buckets=500, share=25))


def test_suffixes_and_prefixes_as_plain_code():
    rng = np.random.default_rng(3)
    for lengths, kinds, depth in [([5, 0, 7, 1, 30], 2, 3), ([12], 1, 4), ([0], 1, 2), ([40, 40], 3, 5), ([3, 3, 3], 9, 1)]:
        ids = rng.integers(0, kinds, sum(lengths))
        left = np.concatenate([np.arange(n, 0, -1) for n in lengths]) if sum(lengths) else np.zeros(0, np.int64)
        order = resample.suffix_array(ids, left, depth)
        heads = [tuple(ids[p : p + min(depth, left[p])]) for p in order]
        assert heads == sorted(heads) and sorted(order) == list(range(len(ids)))
        shared = resample.common_prefixes(ids, left, order, depth)
        want = [0] + [next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(heads, heads[1:])]
        assert shared.tolist() == want[: len(ids)]


def test_each_distinct_gram_is_hashed_once(monkeypatch):
    import types

    seen = []
    monkeypatch.setattr(resample, "zlib", types.SimpleNamespace(crc32=lambda b: seen.append(b) or zlib.crc32(b)))
    block = resample.Block()
    for i in range(20):
        block.add((i, None), b"one two one two three " * 5)
    block.features(2, 100)
    assert sorted(seen) == sorted({b"one", b"two", b"three", b"one two", b"two one", b"two three", b"three one"})


def test_rows_of_a_draw_stay_whole(spark, odd):
    docs = odd.unionByName(odd.sparkSession.createDataFrame([(100 + i, f"alpha beta word{i} " * 12, "en", "s", 1, "b", "s") for i in range(40)], odd.schema))
    drawn = resample.resample(docs, frame(spark, [(0, "alpha beta")], 1), share=50)
    assert drawn.columns == docs.columns + ["weight", "score_", "rank"]
    n = sum(len(plain_words(r.text)) >= 20 for r in docs.collect())
    assert sorted(r["rank"] for r in drawn.collect()) == list(range(1, n * 50 // 100 + 1))
    assert all(len(plain_words(r.text)) >= 20 for r in drawn.collect())


def test_odd_and_empty_tables(spark, odd, none):
    got = resample.report(odd, odd).collect()
    want = plain([(r.doc_id, r.text) for r in odd.collect()], [r.text for r in odd.collect()])
    assert ordered(got) == ordered(want)
    assert resample.report(none, odd).count() == 0
    rows = resample.report(odd, none).collect()
    assert ordered(rows) == ordered(plain([(r.doc_id, r.text) for r in odd.collect()], []))


@pytest.mark.parametrize("copies", [1 << 16, 64])
def test_a_hot_row_is_one_row_of_the_ranking(spark, monkeypatch, copies):
    """Ten thousand equal rows: ranked as so many rows, shuffled as one."""
    monkeypatch.setattr(resample, "COPIES", copies)
    docs = spark.range(10_000).selectExpr("cast(null as long) doc_id", "repeat('same words ', 12) text").unionByName(frame(spark, [(i, f"alpha w{i} " * 15) for i in range(100)], 2))
    scored = resample.score(docs, frame(spark, [(0, "alpha")], 1))
    got = resample.draw(scored)
    assert sorted(r["rank"] for r in got.filter("rank is not null").collect()) == list(range(1, 1011))
