import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quizloom.llm import bpe, packing

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def models():
    return bpe.ByteBPE(BYTE), Tokenizer.from_file(BYTE), packing.WordTokenizer(WORD)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_text_as_the_library(texts):
    own, library, word = bpe.bpe(BYTE), Tokenizer.from_file(BYTE), packing.word_tokenizer(WORD)
    flat, n = own.encode_batch(texts)
    for t, e, k in zip(texts, np.cumsum(n), n):
        want = library.encode(t, add_special_tokens=False).ids
        assert flat[e - k : e].tolist() == want and own.decode(flat[e - k : e]) == library.decode(want, skip_special_tokens=False)
    for t, ids in zip(texts, word.encode_batch(texts)):
        assert ids.tolist() == word.library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["<|endoftext|>a<|endoftext|><|endoftext|>", "aaaaaaaaa aaa", "a" * 3000, "It's I'LL don't", "\x1c\x1dx\x85y　z \t\n\n x", "".join(random.Random(3).choice("abcd ") for _ in range(5000)), "".join(map(chr, range(1, 700)))])
def test_corner_texts(models, text):
    own, library, word = models
    flat, n = own.encode_batch([text, "", text])
    want = library.encode(text, add_special_tokens=False).ids
    assert n.tolist() == [len(want), 0, len(want)] and flat[: n[0]].tolist() == want
    assert word.encode_batch([text])[0].tolist() == word.library.encode(text, add_special_tokens=False).ids


def test_coding_query(spark, odd, none, models):
    library = models[1]
    rows = bpe.encode(odd, BYTE, ids=True).collect()
    assert len(rows) == odd.count()
    texts = defaultdict(list)
    for r in odd.collect():
        texts[r.doc_id].append(r.text or "")
    for r in rows:
        assert r.decoded in texts[r.doc_id] and r.ids == library.encode(r.decoded, add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest() and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert bpe.encode(none, BYTE).count() == 0


def test_cut_wastes_little():
    for n in range(1, 20000, 37):
        cuts = packing.cut(n)
        assert sum(cuts) == n and all(0 < c <= packing.CAPACITY for c in cuts)
        for c in cuts:
            k = packing.class_of(c)
            assert k * c <= packing.CAPACITY and (k >= packing.CLASSES or packing.CAPACITY - k * c <= packing.WASTE * packing.CAPACITY)


@pytest.mark.parametrize("parts", [1, 5])
def test_packing_query(spark, odd, none, models, parts):
    word = models[2]
    many = odd.filter("doc_id is not null").dropDuplicates(["doc_id"])
    more = spark.createDataFrame([(100 + i, "lorem ipsum dolor " * random.Random(i).randint(0, 900)) for i in range(120)], "doc_id long, text string")
    docs = many.select("doc_id", "text").union(more)
    rows = packing.pack(docs.repartition(parts), WORD).collect()
    ids = {r.doc_id: [*word.library.encode(r.text or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    assert pieces.keys() == ids.keys()
    for d, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[d]) and r.ids_crc32 == zlib.crc32(np.array(ids[d][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[d])
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.CAPACITY
    total = sum(map(len, ids.values()))
    assert len(bins) <= total / packing.CAPACITY / 0.95 + 2
    assert packing.pack(none, WORD).count() == 0
    assert packing.pack(odd, WORD).groupBy("doc_id").sum("length").count() == len({r.doc_id for r in odd.select("doc_id").collect()})


def test_short_texts_fill_sequences(spark):
    docs = spark.createDataFrame([(i, "so it is" if i % 3 else "") for i in range(9000)], "doc_id long, text string").repartition(3)
    rows = packing.pack(docs, WORD).collect()
    total = sum(r.length for r in rows)
    assert len({(r.doc_id, r.start) for r in rows}) == 9000 and len({r.sequence_id for r in rows}) <= 2 * total / packing.CAPACITY + 3


@pytest.mark.parametrize("length", [33, 40, 50, 64, 66])
def test_texts_of_one_short_length_leave_little_padding(spark, length):
    docs = spark.range(6000).selectExpr("id doc_id", f"repeat('the ', {length - 1}) text").repartition(4)
    rows = packing.pack(docs, WORD).collect()
    assert {r.length for r in rows} == {length} and 6000 * length / packing.CAPACITY / len({r.sequence_id for r in rows}) >= 0.97


def test_recurring_words_stay_known(monkeypatch):
    monkeypatch.setattr(packing, "STORE_WORDS", 50)
    word = packing.WordTokenizer(WORD)
    for turn in range(6):
        texts = [f"the same words return, again word{turn}x{i} {i}" for i in range(40)]
        for t, ids in zip(texts, word.encode_batch(texts)):
            assert ids.tolist() == word.library.encode(t, add_special_tokens=False).ids
        word.thin()
    assert "return," in word.words.index and not any("x" in w for w in word.words.index)
