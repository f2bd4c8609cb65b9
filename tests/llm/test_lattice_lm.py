import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from tidemark.llm import lattice_lm as lm

PATH = P.path("piece_bpe_32k.model")


def all_segmentations(names, scores, word):
    """Sum over segmentations, one by one."""
    if not word:
        return 1.0
    return sum(math.exp(scores[names[word[:k]]]) * all_segmentations(names, scores, word[k:]) for k in range(1, len(word) + 1) if word[:k] in names)


@pytest.fixture(scope="module")
def vocabulary():
    return lm.pieces(PATH)


@pytest.fixture(scope="module")
def names(vocabulary):
    out, stack = {}, [(0, b"")]
    while stack:
        node, name = stack.pop()
        if vocabulary.piece[node] >= 0:
            out[name] = int(vocabulary.piece[node])
        stack += [(to, name + bytes([b])) for b, to in vocabulary.next[node].items()]
    return out


def test_marginals_sum_over_all_segmentations(vocabulary, names):
    scores = vocabulary.prior()
    words = [b"the", b"edition", "été".encode(), b"zq", b"\xff\x00"]
    got, _ = lm.word_scores(vocabulary, scores, words)
    for w, x in zip(words, got, strict=True):
        assert math.isclose(x, math.log(all_segmentations(names, scores, lm.MARK + w)), rel_tol=1e-9)


def test_long_words_follow_the_same_recursion(vocabulary, monkeypatch):
    words = [b"abcde" * 6, b"tionering", b"a" * 40]
    counts = np.array([2.0, 1.0, 3.0])
    a, ea = lm.word_scores(vocabulary, vocabulary.prior(), words, counts)
    monkeypatch.setattr(lm, "LONG_WORD", 4)
    b, eb = lm.word_scores(vocabulary, vocabulary.prior(), words, counts)
    assert np.allclose(a, b) and np.allclose(ea, eb)
    assert lm.word_scores(vocabulary, vocabulary.prior(), [b"x" * 50_000])[0][0] < -1000


def base(docs):
    low = [(i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(lm.BYTE_LOWER)) + [None]) for i, t in docs]
    train = Counter(w for i, ws in low if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(train.values()), len(train)
    return {i: (len(ws), sum(train[w] > 0 for w in ws), n, sum(math.log10((train[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in low}


@pytest.mark.parametrize("size", [lm.BATCH_BYTES, 40_000])
def test_scores(spark, monkeypatch, size):
    monkeypatch.setattr(lm, "BATCH_BYTES", size)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumnRenamed("lang", "batch")
    more = spark.createDataFrame([(5000, None, "a", "b", 1), (5001, "", "a", "b", 1), (5002, "THE " * 3000, "a", "b", 1), (5003, "q" * 3000, "a", "b", 1)], docs.schema)
    docs = docs.union(more)
    want = base([(r.doc_id, r.text) for r in docs.collect()])
    got = lm.score_documents(docs, PATH).collect()
    assert len(got) == len(want)
    for r in got:
        n, known, total, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert math.isclose(r.base_score, score, rel_tol=1e-9)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert r.score < 0


def test_no_rows(spark):
    assert lm.score_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_score_against_every_segmentation(spark, vocabulary, names):
    """The whole model by brute force: prior from the vocabulary's scores, one round of expectation, marginals."""
    rows = [(k, t) for k, t in enumerate(["the cat sat", "The the dog", None, "", "zq cat", "a b", "dog dogs", "the"])] + [(None, "cat"), (3, "the cat")]
    low = [(i, (t or "").lower().encode().split()) for i, t in rows]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    prior = vocabulary.prior()
    rank = {n: k for n, k in names.items()}
    assert prior[rank[b"in"]] > prior[rank["梦".encode()]] >= prior[rank[b"\x00"]]

    def cuts(word):
        if not word:
            yield []
        for k in range(1, len(word) + 1):
            if word[:k] in names:
                for rest in cuts(word[k:]):
                    yield [names[word[:k]], *rest]

    weights = np.exp(prior) * vocabulary.size
    ends = 0
    for i, words in low:
        if not held(i):
            ends += 1
            for w in words:
                ways = [(c, math.exp(sum(prior[p] for p in c))) for c in cuts(lm.MARK + w)]
                total = sum(p for _, p in ways)
                for c, p in ways:
                    for piece in c:
                        weights[piece] += p / total
    whole = weights.sum() + ends + 1
    scores = np.log(weights / whole)
    want = sorted((i is None, i or 0, round(sum(math.log10(all_segmentations(names, scores, lm.MARK + w)) for w in words) + math.log10((ends + 1) / whole), 9)) for i, words in low)
    got = lm.score_documents(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int"), PATH).collect()
    assert np.allclose([x[2] for x in sorted((r.doc_id is None, r.doc_id or 0, round(r.score, 9)) for r in got)], [x[2] for x in want], atol=1e-6)


def test_statistics_add_up_over_levels(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).cache()
    scores = lambda: {r.doc_id: r.score for r in lm.score_documents(docs, PATH).collect()}
    whole = scores()
    monkeypatch.setattr(lm, "BATCH_BYTES", 4_000)
    monkeypatch.setattr(lm, "TOGETHER_PARTS", 3)
    again = scores()
    assert all(math.isclose(again[i], s, rel_tol=1e-9) for i, s in whole.items())
