import random

import numpy as np

from tidemark.llm import simhash
from tidemark.llm.components import connected


def brute(fps, most=3):
    label = list(range(len(fps)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def clouds(rng, n):
    out = set()
    while len(out) < n:
        c = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 1, 30])):
            x = c
            for _ in range(rng.randint(0, 3)):
                x ^= 1 << rng.randrange(64)
            out.add(x)
    return sorted(out)


def test_index_finds_what_brute_force_finds():
    rng = random.Random(2)
    fps = clouds(rng, 700)
    index = simhash.GrayIndex(np.array(fps, np.uint64))
    for q in fps[:60]:
        want = {x for x in fps if (x ^ q).bit_count() <= 3}
        assert {int(index.fps[k]) for k in index.near(np.array([q], np.uint64), 3)} == want


def test_links_span_the_groups(spark, monkeypatch):
    fps = clouds(random.Random(4), 900)
    for most_in_bucket in (20_000, 4):
        monkeypatch.setattr(simhash, "MOST_IN_BUCKET", most_in_bucket)
        df = spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long")
        labels = {r.node: r.label for r in connected(simhash.fingerprint_links(df)).collect()}
        want = brute(fps)
        groups = {}
        for x, root in zip(fps, want, strict=True):
            groups.setdefault(root, set()).add(labels.get(simhash.signed(x), simhash.signed(x)))
        assert all(len(g) == 1 for g in groups.values())
        assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)]
    random.Random(1).shuffle(links)
    got = {r.node: r.label for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30))
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_groups(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    extra = [(1000, None), (1001, ""), (1002, " \t "), (1003, "One two"), (1004, "ONE  two"), (None, "one two")]
    more = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in extra], docs.schema)
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_groups(docs.union(more).withColumnRenamed("lang", "fp")).collect()}
    ids = [*texts, *(i for i, _ in extra if i is not None)]
    fps = [simhash.fingerprint(t or "") for t in [*texts.values(), *(t for i, t in extra if i is not None)]]
    order = sorted(range(len(ids)), key=ids.__getitem__)
    want = brute([fps[k] for k in order])
    for k, root in zip(order, want, strict=True):
        assert got[ids[k], f"{fps[k]:016x}"] == ids[order[root]]
    assert got[None, f"{simhash.fingerprint('one two'):016x}"] == 1003
    assert simhash.fingerprint(" ") == 0
    assert simhash.near_groups(docs.limit(0)).count() == 0


def test_fingerprint_follows_its_definition():
    import xxhash

    text = "Éa B c d  a b\tc"
    words = "Éa b c d a b c".split()
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(5)]
    assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > 5)
