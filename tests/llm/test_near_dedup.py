"""The pipeline's near-copy stage against all pairs' Jaccard similarity."""

import random

import pytest

import corpus_pipeline
from tidemark.llm import near_dedup
from tidemark.llm.common import BYTE_LOWER, BYTE_WORD

SF = "/root/testdata/sf0.01"


def shingle_set(text):
    words = BYTE_WORD.findall((text or "").encode().translate(BYTE_LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """Rows (id, text) that stay: of each group the smallest id."""
    sets = [shingle_set(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
                continue
            both = len(a & b)
            if 5 * both >= 4 * (len(a) + len(b) - both):
                label[find(i)] = find(j)
    best = {}
    for k, (i, _) in enumerate(rows):
        best[find(k)] = min(i, best.get(find(k), i))
    return sorted(best.values())


def kept(spark, rows, schema="doc_id long, text string"):
    return sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, schema), SF).collect())


def test_documents_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect())
    assert got == brute(rows)


def test_chains_thresholds_and_shared_passages(spark):
    rng = random.Random(3)
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for base in range(6):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([30, 90, 200]))]
        for step in range(12):  # each differs from the last in a few words; the ends are far apart
            rows.append((len(rows), " ".join(words)))
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = f"W{rng.randrange(10**6)}"
    for k in range(40):
        rows.append((len(rows), " ".join(passage + [f"q{k}x{j}" for j in range(k % 20)])))
    rows += [(500, "a b"), (501, "A  B"), (502, "a b c"), (503, ""), (504, None)]
    rng.shuffle(rows)
    assert kept(spark, rows) == brute(rows)
    assert kept(spark, []) == []


def test_a_repeated_id_takes_no_other_text_with_it(spark):
    same = " ".join(f"w{k}" for k in range(60))
    rows = [(1, "lone text of its own here"), (1, same + " x"), (0, same), (None, same)]
    out = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert sorted((r.text for r in out)) == sorted(["lone text of its own here", same, same])


@pytest.mark.parametrize(("most", "block"), [(4, 3), (4, 4096), (256, 5)])
def test_crowded_buckets_lose_no_pair(spark, monkeypatch, most, block):
    """Texts that share much of a passage, of many lengths, with buckets, blocks and copies of sets far smaller than usual."""
    for name, value in {"MOST_IN_BUCKET": most, "BLOCK": block, "PAIRS_A_COPY": 3, "BROADCAST_SHINGLES": 0, "ORDER_SHINGLES": 0}.items():
        monkeypatch.setattr(near_dedup, name, value)
    rng = random.Random(7)
    rows = []
    for p in range(3):
        passage = [f"p{p}x{k}" for k in range(50)]
        for k in range(60):
            words = list(passage[: rng.randint(30, 50)])
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = f"r{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words + [f"q{p}x{k}x{j}" for j in range(rng.randint(0, 16))])))
    rows += [(500, "a b"), (501, "a b c"), (502, "a b c d e"), (503, "a b c d e f"), (504, "b c d e f")]
    rng.shuffle(rows)
    assert kept(spark, rows) == brute(rows)


def test_small_batches_hold_for_what_runs_inside(spark):
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with near_dedup._small_batches(spark):
        got = [r.n for r in spark.range(0, 1000, 1, 1).mapInArrow(sizes, "n long").collect()]
    assert max(got) == near_dedup.TOGETHER
    assert sum(got) == 1000
    assert spark.conf.get(name) == before


def test_verification_of_large_tables_moves_no_text(spark, monkeypatch):
    """Part by part, without broadcasts: the same pairs, and what is shuffled is far below the texts."""
    from pyspark.sql import functions as F

    long_ = " ".join(f"w{i}" for i in range(4000))
    rows = [(i, f"{'x' * 40_000} {i} {i * 7} and words of their own" if i % 10 else f"{long_} v{i}") for i in range(200)]
    texts = spark.createDataFrame(rows, "id long, text string").withColumn("digest", F.xxhash64("text")).repartition(4)
    kinds = {i: near_dedup._hash(near_dedup.shingles(t).tobytes()) for i, t in rows}
    signed = {i: s - (1 << 64) if s >= 1 << 63 else s for i, s in kinds.items()}
    nodes = texts.join(spark.createDataFrame(list(signed.items()), "id long, s long"), "id").select("s", "digest")
    asked = [(signed[0], signed[10]), (signed[20], signed[30]), (signed[0], signed[1]), (signed[1], signed[2])]
    pairs = spark.createDataFrame(asked, "a long, b long")
    monkeypatch.setattr(near_dedup, "BROADCAST_SHINGLES", 0)
    moved = []
    monkeypatch.setattr(near_dedup, "cut", lambda df, cut=near_dedup.cut: moved.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    got = {tuple(r) for r in near_dedup._verified(pairs, nodes, texts).collect()}
    assert got == set(asked[:2])
    assert not any("Join" in p.split("MapInArrow", 1)[-1] for p in moved if "MapInArrow" in p and "text#" in p.split("MapInArrow", 1)[-1])
