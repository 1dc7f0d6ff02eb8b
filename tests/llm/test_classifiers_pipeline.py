import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pyspark.sql import functions as F

import corpus_pipeline
from quizloom.llm import lines, quality, secrets, toxicity

from plainly import plain_components, sets_of


def corpus(n=600, seed=1):
    """Prose of syllables; a quarter with insults of three languages, stems with endings; a fifth junk."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["the", "an", "er", "on", "th", "in", "re", "st", "ou", "ha"]) for _ in range(rng.randint(1, 4)))
    insults = [lambda: rng.choice(["stupid", "moron", "worthless"]), lambda: "lowei" + rng.choice(["schaft", "ent", "ig", "ung"]), lambda: "veju" + rng.choice(["ais", "ment", "on"])]
    rows = []
    for i in range(n):
        sentences = [[word() for _ in range(rng.randint(6, 14))] for _ in range(rng.randint(2, 8))]
        bad, junk = rng.random() < 0.25, rng.random() < 0.2
        if bad:
            for s in rng.sample(sentences, max(1, len(sentences) // 3)):
                s.insert(rng.randrange(len(s)), insults[i % 3]())
        text = ". ".join(" ".join(s) for s in sentences) + "."
        if junk:
            text = text.upper().replace(" ", "!! ") if i % 2 else " ".join([word()] * 80)
        rows.append((i, text, "en", f"s{i % 5}", len(text), int(not junk), int(bad and not (junk and i % 2 == 0))))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame([(r[0], r[5], r[6]) for r in rows], "doc_id long, quality int, toxic int"), rows


def plain_kernel(s, t, p, decay):
    """By the definition: all index tuples."""
    from itertools import combinations

    total = 0.0
    for a in combinations(range(len(s)), p):
        for b in combinations(range(len(t)), p):
            if [s[i] for i in a] == [t[i] for i in b]:
                total += decay ** (a[-1] - a[0] + b[-1] - b[0] + 2)
    return total


@pytest.mark.parametrize("s,t", [("stupid", "stupid"), ("stxupid", "stupid"), ("aabab", "abab"), ("xyz", "stupid"), ("pidstu", "stupid")])
def test_kernel(s, t):
    got = toxicity.kernel(toxicity.codes([s, "q", s], 12), t, 4, 0.7)
    assert got[0] == pytest.approx(plain_kernel(s, t, 4, 0.7), rel=1e-5) and got[1] == 0 and got[2] == got[0]


def test_toxicity_held_out(spark, tables):
    docs, labels, rows = tables
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert len(got) == len(rows) and all(got[r[0]].held_out == (zlib.crc32(str(r[0]).encode()) % 3 == 1) for r in rows)
    assert np.mean([got[r[0]].predicted for r in held if r[6]]) > 0.9 and np.mean([got[r[0]].predicted for r in held if not r[6]]) < 0.02
    whole, gapped, clean = model.score(["you are a moron here", "you are a m o r o n here", "the other one"])
    assert whole == pytest.approx(gapped) and whole > 0.7 > clean and model.score(["a mo.ron and stup1d"])[0] > 0.7 and model.score(["stxupid worxthless"])[0] > model.score(["the other"])[0]


def test_toxicity_odd(spark, tables, odd, none, labels):
    model = toxicity.fit(tables[0], tables[1])
    assert toxicity.score(odd, model).count() == odd.count() and toxicity.score(none, model).count() == 0
    assert {r.score for r in toxicity.score(odd, toxicity.fit(odd, labels.limit(0))).collect()} == {0.0}
    kept = toxicity.score(odd, model, keep="_s")
    assert kept.columns == [*odd.columns, "_s"] and kept.count() == odd.count()
    toxicity.fit(none, labels)
    with pytest.raises(ValueError):
        toxicity.score(odd, model, keep="Score")


def test_repeated_ids_do_not_outgrow_the_samples(spark, monkeypatch):
    docs = spark.createDataFrame([(7 if i < 300 else i, f"row {i} is an idiot" if i % 2 else f"row {i} is fine", "en", "s", 9) for i in range(340)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in (7, *range(300, 320))], "doc_id long, quality int, toxic int")
    sample = toxicity.labelled_sample(docs, labels)
    assert sample.count() == sample.select("row").distinct().count() <= 21
    sizes = []
    monkeypatch.setattr(quality.CoTrained, "__init__", lambda self, views, y, pool: sizes.append((len(views[0]), len(pool[0]))))
    quality.fit(docs, labels)
    assert sizes[0][0] <= 21 and sizes[0][1] <= 21


def test_gapped_and_whole_tokens_reach_the_kernel():
    model = toxicity.Model(["^stupid$", "^moro"])
    tokens = ["stupid", "s-t-u-p-i-d", "sxtxuxpxixd", "stupixxxd", "stvpid", "moron", "diputs", "thing"]
    model.meet(tokens)
    value = {t: model.hot[t][0] if t in model.hot else 0 for t in tokens}
    assert value["stupid"] == value["s-t-u-p-i-d"] == 1 > value["stupixxxd"] > value["sxtxuxpxixd"] > 0 < value["stvpid"] < 1
    assert value["diputs"] == value["thing"] == 0 and model.hot["moron"][1] > 0.5


def test_common_letters():
    rng = random.Random(2)
    model = toxicity.Model(["^abcab$", "^ccd"])

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = next_row(row, x, b)
        return row[-1]

    def next_row(row, x, b):
        out = [0]
        for j, y in enumerate(b):
            out.append(row[j] + 1 if x == y else max(row[j + 1], out[j]))
        return out

    words = ["^" + "".join(rng.choice("abcd") for _ in range(rng.randint(0, 9))) + "$" for _ in range(60)]
    c = toxicity.codes(words, 12)
    letters = np.array([[1 + model.alphabet.tolist().index(chr(x)) if x and chr(x) in model.alphabet else 0 for x in r] for r in c])
    for k, mark in enumerate(model.landmarks):
        assert toxicity.common_letters(letters, model.masks[k], len(mark)).tolist() == [longest(w, mark) for w in words]


def test_quality_held_out(spark, tables, odd, none, labels):
    docs, marks, rows = tables
    model = quality.fit(docs, marks)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    held = [r for r in rows if got[r[0]].held_out]
    assert np.mean([got[r[0]].kept for r in held if r[5]]) > 0.97 and np.mean([got[r[0]].kept for r in held if not r[5]]) < 0.1
    assert quality.score(odd, model).count() == odd.count() and quality.score(none, model).count() == 0
    assert {(r.score, r.kept) for r in quality.score(odd, quality.fit(none, labels)).collect()} == {(0.5, True)}


def test_views_exchange_labels():
    rng = np.random.default_rng(0)
    y = (rng.random(60) < 0.5).astype(float)
    a, b = y[:, None] * 4 + rng.standard_normal((60, 2)), y[:, None] * 4 + rng.standard_normal((60, 3))
    py = (rng.random(400) < 0.5).astype(float)
    pool = [py[:, None] * 4 + rng.standard_normal((400, 2)), py[:, None] * 4 + rng.standard_normal((400, 3))]
    model = quality.CoTrained([a, b], y, pool)
    assert all(n > 20 for n in model.handed) and ((model.score(pool)[2] > 0.5) == py).mean() > 0.97


def test_pipeline_as_plain_code(spark, tmp_path):
    """Stage by stage against plain code; the toxicity decision is the operator's own, tested above."""
    rows = corpus(240, 3)
    extra = [(1000 + i, rows[i][1] + (" tail" if i % 2 else ""), "en", "s1", 5, 1, 0) for i in range(0, 40)]
    extra += [(2000 + i, f"menu of the site\nunique body {i} " + rows[i][1] + "\ntoken = abcdefgh12345", "en", "s4", 5, 1, 0) for i in range(60)]
    rows = rows + extra
    docs = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(r[0], r[5], r[6]) for r in rows], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    sf = str(tmp_path)
    got = corpus_pipeline.run(spark, sf).collect()

    model = toxicity.fit(spark.read.parquet(sf + "/documents.parquet"), labels)
    kept = [r for r in rows if model.score([r[1]])[0] < toxicity.PREDICT]
    assert 0 < len(kept) < len(rows)
    pages, with_line = defaultdict(int), defaultdict(set)
    for r in kept:
        pages[r[3]] += 1
        for x in r[1].split("\n"):
            if x.strip():
                with_line[r[3], x.strip()].add(r[0])
    gone = {k for k, v in with_line.items() if len(v) >= lines.LEAST_PAGES and len(v) > lines.RATIO * pages[k[0]]}
    assert ("s4", "menu of the site") in gone
    texts = {r[0]: "\n".join(x for x in r[1].split("\n") if (r[3], x.strip()) not in gone) for r in kept}
    ids = sorted(texts)
    first = plain_components(ids, sets_of([texts[i] for i in ids]))
    stay = [i for i, c in zip(ids, first) if i == c]
    assert len(stay) < len(ids)
    import re

    pattern = re.compile(secrets.KINDS["assign"][0].replace("(?i:", "(?:"), re.I | re.A)
    final = {i: pattern.sub(lambda m: "[secret]" if len(m.group(2)) >= 8 else m.group(), texts[i]) for i in stay}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert {r.doc_id for r in got} == set(final)
    for i, t in final.items():
        n = len(library.encode(t, add_special_tokens=False).ids) + 1
        own = sorted((r.start, r.length) for r in got if r.doc_id == i)
        assert sum(k for _, k in own) == n and {r.doc_tokens for r in got if r.doc_id == i} == {n}


def test_stages_keep_the_columns(spark, odd, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    names = ["toxic_score", "score", "row", "n_lines", "n_dropped", "gone", "kept", "Lines", "base", "spans", "component_id", "bucket", "name", "place"]
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(c).alias(c) for c in names])
    for frame in (docs, docs.limit(0)):
        at = frame
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, at, str(tmp_path))
            assert out.columns == docs.columns, name
            assert not out.filter(" or ".join(f"{c} <> '{c}' or {c} is null" for c in names)).count(), name
            out.write.mode("overwrite").parquet(str(tmp_path / "s" / name.replace(" ", "")))
            at = spark.read.parquet(str(tmp_path / "s" / name.replace(" ", "")))
        corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path)).count()


def test_near_copies_of_rows_with_repeated_ids(spark):
    rng = random.Random(4)
    a, b, c = (" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(300)) for _ in range(3))
    rows = [(1, a), (1, b), (2, a + " more"), (None, b + " more"), (None, c), (7, c + " more"), (5, ""), (5, ""), (1, a + " other")]
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(1), "")
    assert got.columns == ["doc_id", "text"]
    near = sorted((r.doc_id, r.text[:100]) for r in got.collect())
    assert near == sorted([(1, a[:100]), (1, b[:100]), (7, c[:100]), (5, ""), (5, "")])
