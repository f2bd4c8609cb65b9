import hashlib
import random
import re

import numpy as np

from tidemark.llm import substring_dedup as sd
from tidemark.llm.words import window_hashes, word_bounds, word_hashes


def brute(docs, window=13):
    words = [(i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t in docs]
    first = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def made(rng):
    vocabulary = [f"w{k}é"[: rng.randint(2, 5)] for k in range(400)]
    passages = [" ".join(rng.choices(vocabulary, k=rng.randint(10, 60))) for _ in range(12)]
    docs = [(0, None), (1, ""), (2, "short text"), (3, "a " * 40), (4, "a\t" * 30 + "b"), (5, "x" * 200_000 + " y")]
    for i in range(6, 260):
        text = " ".join(rng.choices(vocabulary, k=rng.randint(1, 80)))
        for p in rng.sample(passages, rng.choice([0, 0, 1, 2])):
            text += rng.choice(["\n", " ", " \x0b "]) + p + " " + rng.choice(vocabulary)
        docs.append((i * 3 - 5000, text))
    docs += [(9000 + k, passages[0]) for k in range(20)]
    rng.shuffle(docs)
    return docs


def test_cover_has_every_difference():
    assert {(a - b) % sd.PERIOD for a in sd.COVER for b in sd.COVER} == set(range(sd.PERIOD))


def test_word_hashes_depend_on_the_word_alone():
    a, b = b"one two  three\tone", b"  two one " + b"q" * 70_000 + b" three"
    hashes = {}
    for t in (a, b):
        s, e = word_bounds(t)
        for w, h in zip([t[x:y] for x, y in zip(s, e, strict=True)], word_hashes(t, s, e), strict=True):
            assert hashes.setdefault(w, h) == h
    assert len(set(hashes.values())) == len(hashes) == 4
    assert len(window_hashes(np.arange(5, dtype=np.uint64), 6, 1)) == 0


def test_same_as_brute_force(spark, monkeypatch):
    docs = made(random.Random(7))
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in docs], "doc_id long, text string, batch int, keys string")
    want = brute(docs)
    for size in (sd.BATCH_BYTES, 3000):
        monkeypatch.setattr(sd, "BATCH_BYTES", size)
        got = sd.remove_repeats(df, with_text=True).collect()
        assert len(got) == len(docs)
        for r in got:
            assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id], r.doc_id
            assert hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256


def test_tables_and_edge_cases(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in sd.remove_repeats(docs).collect()} == want
    assert sd.remove_repeats(docs.limit(0)).count() == 0
    text = " ".join(map(str, range(20)))
    rows = spark.createDataFrame([(None, text), (None, text), (4, text), (4, text)], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.n_removed) for r in sd.remove_repeats(rows).collect()) == [(False, 0), (False, 0), (True, 20), (True, 20)]
