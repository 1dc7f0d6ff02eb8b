import collections
import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quizloom.llm import alignment
from quizloom.llm.bpe import byte_alphabet

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain_links(texts):
    """Per text: ids of A, ids of B, links in order, spelled groups; None without tokens."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    back = {c: x for x, c in byte_alphabet().items()}
    out = []
    for t in texts:
        ids_a, ids_b = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        raw_a = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not t or not b"".join(raw_a) == b"".join(raw_b) == (" " + t).encode():
            out.append(None)
            continue
        owner_a = [i for i, r in enumerate(raw_a) for _ in r]  # the token of every byte
        owner_b = [i for i, r in enumerate(raw_b) for _ in r]
        pairs = sorted(set(zip(owner_a, owner_b)))
        cuts_a, cuts_b = np.cumsum([len(r) for r in raw_a]), np.cumsum([len(r) for r in raw_b])
        groups, start = [], 0
        for end in sorted(set(cuts_a.tolist()) & set(cuts_b.tolist())):
            mine = [",".join(str(ids[i]) for i in sorted(set(owner[start:end]))) for ids, owner in ((ids_a, owner_a), (ids_b, owner_b))]
            groups.append("|".join(mine))
            start = end
        out.append((ids_a, ids_b, [(ids_a[i], ids_b[j]) for i, j in pairs], groups))
    return out


def plain(docs):
    found = plain_links([t for _, t in docs])
    count = collections.Counter(x for f in found if f for x in f[2])
    top = collections.Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    rows = []
    for (doc, _), f in zip(docs, found):
        if f is None:
            rows.append((doc, 0, 0, 0, 0, 0, 0, ""))
        else:
            a, b, links, groups = f
            rows.append((doc, len(a), len(b), len(groups), len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return rows, count, top


TEXTS = [
    "Plain words, twice: plain words.", "  two  spaces   and\n\nlines\tand tabs ", "Ünïcode 😀 日本語 text's end", "<|endoftext|> </s> <s> <unk> <0x41>",
    "a▁piece mark", "", None, "x" * 3000, "word " * 4000, "12345 67890 3.14", " leading", "trailing ", "\x00\x01\x7f control", "tie tie tie", "tie tie tie", "한국어 문장", "é̂ combining",
]


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: [(v is None, v) for v in r])


@pytest.mark.parametrize("share_rows,parts", [(4096, 3), (1, 5)])
def test_links_and_counts_as_plain_code(spark, monkeypatch, share_rows, parts):
    monkeypatch.setattr(alignment, "SHARE_ROWS", share_rows)  # 1: pairs of every task are added up apart first
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[0]), (None, TEXTS[2]), (None, None)]
    out, counts = alignment.align(spark.createDataFrame(docs, "doc_id long, text string").repartition(parts), A, B, parts=True)
    rows, count, top = plain(docs)
    assert ordered(out.collect()) == ordered(rows)
    assert sorted(map(tuple, counts.collect())) == sorted((b, a, n, n == top[b]) for (a, b), n in count.items())


def test_odd_and_empty_tables(spark, odd, none):
    got = alignment.align(odd, A, B).collect()
    assert ordered(got) == ordered(plain([(r.doc_id, r.text) for r in odd.collect()])[0])
    assert alignment.align(none, A, B).count() == 0


def test_texts_without_tokens_alone(spark):
    rows = alignment.align(spark.createDataFrame([(1, None), (2, ""), (3, "▁")], "doc_id long, text string"), A, B).collect()
    assert sorted(map(tuple, rows)) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3)]


def test_stores_that_overflow_change_nothing(monkeypatch):
    rng = np.random.default_rng(2)
    texts = [" ".join("".join(rng.choice(list("abcdeé日 "), 6)) for _ in range(50)) for _ in range(40)]
    whole = [x.tolist() for x in alignment.tokens(texts, alignment.LeftTokenizer(A), alignment.RightTokenizer(B))]
    monkeypatch.setattr(alignment, "STORE_WORDS", 10)
    monkeypatch.setattr(alignment, "STORE_CHARS", 100)
    a, b = alignment.LeftTokenizer(A), alignment.RightTokenizer(B)
    parts = [alignment.tokens([t], a, b) for t in texts]
    assert [np.concatenate([p[k] for p in parts]).tolist() for k in range(4)] == whole
    b.apart = False
    parts = [alignment.tokens([t], a, b) for t in texts]
    assert [np.concatenate([p[k] for p in parts]).tolist() for k in range(4)] == whole


def test_a_long_unbroken_word_takes_little_time():
    import time

    a, b = alignment.LeftTokenizer(A), alignment.RightTokenizer(B)
    rng = np.random.default_rng(4)
    text = "".join(rng.choice(list("abcdefgh"), 80_000))
    began = time.perf_counter()
    alignment.tokens([text], a, b)
    assert time.perf_counter() - began < 5


def test_any_text(spark):
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    a, b = alignment.LeftTokenizer(A), alignment.RightTokenizer(B)

    @settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), min_size=1, max_size=5))
    def check(texts):
        found = plain_links(texts)
        ids_a, n_a, ids_b, n_b = alignment.tokens(texts, a, b)
        assert ids_a.tolist() == [i for f in found if f for i in f[0]] and ids_b.tolist() == [i for f in found if f for i in f[1]]
        assert n_a.tolist() == [len(f[0]) if f else 0 for f in found] and n_b.tolist() == [len(f[1]) if f else 0 for f in found]

    check()
