import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from plainly import plain_components, sets_of, words_of
from pyspark.sql import functions as F

from quizloom.llm import jaccard, lm
from quizloom.llm.components import components


def plain_lm(texts, held, order, strength):
    counts = [Counter() for _ in range(order + 1)]
    for t, h in zip(texts, held):
        if not h:
            tokens = ["<s>"] * (order - 1) + [*words_of(t), "</s>"]
            for i in range(order - 1, len(tokens)):
                for k in range(1, order + 1):
                    counts[k][tuple(tokens[i - k + 1 : i + 1])] += 1
    n, v = sum(counts[1].values()), len(counts[1])
    context = lambda c: counts[1][("</s>",)] if set(c) == {"<s>"} else counts[len(c)][c]
    for t in texts:
        tokens = ["<s>"] * (order - 1) + [*words_of(t), "</s>"]
        base = score = known = 0
        for i in range(order - 1, len(tokens)):
            p = (counts[1][(tokens[i],)] + 0.1) / (n + 0.1 * (v + 1))
            base += math.log10(p)
            known += counts[1][(tokens[i],)] > 0
            for k in range(2, order + 1):
                c = context(tuple(tokens[i - k + 1 : i]))
                p = (counts[k][tuple(tokens[i - k + 1 : i + 1])] + strength * p) / (c + strength)
            score += math.log10(p)
        yield len(tokens) - order + 1, known, n, base, score


def machine_for(training, order, text, strength=2.0, bits=56):
    """The automaton that one text can reach, and the text's n-grams."""
    all_keys, own = lm.Grams(training, order, bits).levels, lm.Grams([text], order, bits)
    tables = []
    for (keys, which, *_), (mine, *_) in zip(all_keys, own.levels):
        count = dict(zip(keys.tolist(), np.bincount(which, minlength=len(keys))))
        tables.append(np.array([count.get(k, 0) for k in mine.tolist()], float))
    n, v = len(lm.Grams(training, 1).tokens), len(all_keys[0][0])
    return lm.Automaton(own, tables, n, v, strength), own


def last_weight(training, order, tokens):
    """The log weight of the last token after the others; None is the end."""
    machine, own = machine_for(training, order, " ".join(t for t in tokens if t))
    return machine.traverse(own)[len(tokens) - 1]


@pytest.mark.parametrize("order,bucket", [(1, 400), (2, 400), (2, 1 << 20), (3, 700)])
def test_scores_as_plain_code(spark, order, bucket):
    rng = random.Random(order)
    vocabulary = ["the", "The", "a", "of", "ü", "x.", "rare%d"]
    texts = [" ".join(rng.choice(vocabulary).replace("%d", str(rng.randint(0, 40))) for _ in range(rng.randint(0, 25))) for _ in range(90)] + ["", "\t\n", "The\x0bthe \x1c"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    got = {r.doc_id: r for r in lm.score(docs, order=order, bucket_bytes=bucket).collect()}
    for i, (n, known, total, base, score) in enumerate(plain_lm(texts, held, order, lm.STRENGTH)):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, held[i])
        assert r.base_score == pytest.approx(base, abs=1e-8) and r.score == pytest.approx(score, abs=1e-8)


def test_arcs_of_a_state_sum_to_one():
    """The weights of all tokens after a context, and that of one unknown token, are a distribution."""
    training = ["a b a c", "a b", "c", ""]

    def total(context, order):
        return sum(10 ** last_weight(training, order, [*context.split(), last]) for last in ("a", "b", "c", "new", None))

    assert total("a", 2) == pytest.approx(1) and total("c", 2) == pytest.approx(1) and total("new", 2) == pytest.approx(1) and total("a b", 3) == pytest.approx(1)


def test_states_and_failure_arcs():
    """By hand: the states that are carried, and a failure arc to the root and on from there."""
    machine, own = machine_for(["a b c", "a b d"], 3, "a b c x a")
    state, weights = np.array([machine.starts[-1]]), []
    seen = []
    for t in own.tokens:
        state, w = machine.read(state, np.array([t]))
        seen.append(int(np.searchsorted(machine.begin, state[0], "right")))  # 0 root, else how long the context is
        weights.append(10 ** w[0])
    assert seen[:5] == [2, 2, 2, 0, 1] and machine.fail[machine.starts[-1]] == machine.starts[0] and machine.fail[machine.starts[0]] == 0
    root = lambda c: (c + 0.1) / (8 + 0.1 * 6)
    b = (2 + 2 * (2 + 2 * root(2)) / 4) / 4
    c = (1 + 2 * (1 + 2 * root(1)) / 4) / 4
    x = 2 / 3 * 2 / 3 * root(0)
    assert weights[1:4] == pytest.approx([b, c, x])


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_long_texts_are_read_in_stretches(order):
    rng = random.Random(order)
    texts = [" ".join(rng.choice("abcdef") for _ in range(n)) for n in (0, 1, 7, 8, 9, 200)]
    machine, own = machine_for(texts[::2], order, texts[-1])
    assert np.allclose(machine.traverse(own, 4), machine.traverse(own, 10_000))


def test_a_changed_input_is_noticed():
    with pytest.raises(RuntimeError):
        lm.scored(["a b"], [np.zeros(7), np.zeros(1)], 1, 1, 56, 2.0)


def test_odd_rows(spark, odd, none):
    got = lm.score(odd).collect()
    assert len(got) == odd.count() and all(math.isfinite(r.score) and r.n_tokens >= 1 for r in got)
    assert lm.score(none).count() == 0
    one = spark.createDataFrame([(i, "x y") for i in range(40) if zlib.crc32(str(i).encode()) % 10 == 0], "doc_id long, text string")
    assert {(r.train_tokens, r.base_score, r.score) for r in lm.score(one).collect()} == {(0, 0.0, 0.0)}


def chain_texts(seed):
    """Chains of edits, a dense group about a text that isn't there, copies, a passage that many share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(20)]
    out = []
    for _ in range(12):
        text = [word() for _ in range(rng.randint(30, 70))]
        for _ in range(rng.randint(1, 6)):
            out.append(" ".join(text))
            text = list(text)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = word()
    centre = [word() for _ in range(120)]
    for _ in range(40):
        text = list(centre)
        for _ in range(rng.randint(1, 5)):
            text[rng.randrange(120)] = word()
        out.append(" ".join(text))
    out += [" ".join(passage + [word() for _ in range(rng.randint(2, 40))]) for _ in range(40)]
    out += [out[3]] * 5 + [out[0].upper(), "  ".join(out[1].split()), "a b", "A  b", "a b c", "", None, " "]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed,bucket", [(1, 2000), (2, 1 << 20), (3, 5000)])
def test_components_as_plain_code(spark, seed, bucket, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    texts = chain_texts(seed)
    ids = [7 * i + 3 for i in range(len(texts))]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in jaccard.join(docs, bucket_bytes=bucket).collect()}
    sets = sets_of(texts)
    want = plain_components(ids, sets)
    assert [got[i].component_id for i in ids] == want and [got[i].n_shingles for i in ids] == [len(s) for s in sets]
    assert len(set(want)) < len(want)


def test_block_product():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(30)]
    left, right = sets[:12], sets[12:]
    pairs = np.unique(rng.integers(0, 12 * 18, 90))
    keep = jaccard.SLICE
    for jaccard.SLICE in (7, keep):
        got = jaccard.overlaps(left, right, pairs)
        assert got.tolist() == [len(np.intersect1d(left[p % 12], right[p // 12])) for p in pairs]


def test_odd_sets(odd, none):
    got = jaccard.join(odd).collect()
    assert len(got) == odd.count() and {r.component_id for r in got if r.doc_id in (4, 5)} == {4} and {r.component_id for r in got if r.doc_id in (0, 2)} == {0, 2}
    assert jaccard.join(none).count() == 0


def test_heavy_nodes(spark, monkeypatch):
    from quizloom.llm import components as module

    monkeypatch.setattr(module, "LIGHT", 5)
    links = [(0, i) for i in range(1, 3000)] + [(i, i + 1) for i in range(5000, 5020)] + [(2999, 4000), (4000, 4001)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in [*range(3000), 4000, 4001]} | {i: 5000 for i in range(5000, 5021)}


@pytest.mark.parametrize("links", [[], [("b", "a"), ("c", "b"), ("x", "y"), ("x", "x")], [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)], [("hub", f"n{i}") for i in range(50)]])
def test_components(spark, links):
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a string, b string")).collect()}
    root = {n: n for pair in links for n in pair}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {n: r for n, r in root.items() if any(n in p and p[0] != p[1] for p in links)}


def test_threshold_is_exact(spark):
    base = [f"w{i}" for i in range(14)]  # 10 shingles
    nine = base[:13]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(nine)), (3, " ".join(base[:12])), (4, " ".join(base[:11]))], "doc_id long, text string")
    # 10, 9, 8 and 7 shingles, each within the one before: 8 of 10 link, 7 of 8 link, 7 of 10 don't
    got = {r.doc_id: r.component_id for r in jaccard.join(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1}
    far = jaccard.join(docs.filter(F.col("doc_id").isin(1, 4)))
    assert {r.doc_id: r.component_id for r in far.collect()} == {1: 1, 4: 4}
