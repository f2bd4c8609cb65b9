import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hard_negatives as hn


def brute(rows, positives=5, negatives=10, low=30, high=90, is_anchor=lambda i: i % 100 == 0):
    dot = lambda a, b: sum(int(x) * int(y) for x, y in zip(a, b, strict=True))
    out = []
    for i, label, v in rows:
        if is_anchor(i):
            score = sorted((-dot(v, w), j, m) for j, m, w in rows if j != i)
            for s, j, _ in [x for x in score if x[2] == label][:positives]:
                far = [(t, k) for t, k, m in score if m != label and low * -s <= 100 * -t <= high * -s][:negatives]
                out += [(i, j, r + 1, k, -s, -t) for r, (t, k) in enumerate(far)]
    return sorted(out)


def made(spark, rows):
    return spark.createDataFrame([(i, m, list(map(float, v))) for i, m, v in rows], "vec_id long, label int, embedding array<double>")


def got(df, **more):
    return sorted(map(tuple, hn.mine(df, F.col("vec_id") % 100 == 0, **more).collect()))


def table(n, dims, labels, seed, copies=0):
    rng = np.random.default_rng(seed)
    x = np.floor(40 * rng.normal(size=(n, dims)) + 30 * rng.normal(size=(labels, dims))[rng.integers(0, labels, n)])
    x[:copies] = x[0]
    return [(int(i), int(rng.integers(0, labels)), x[i]) for i in range(n)]


@pytest.mark.parametrize(("n", "dims", "labels", "copies"), [(900, 64, 10, 0), (500, 13, 3, 250), (300, 1, 2, 0), (400, 20, 1, 0)])
def test_all_pairs(spark, n, dims, labels, copies):
    rows = table(n, dims, labels, n, copies)
    assert got(made(spark, rows)) == brute(rows)


def test_pieces_blocks_and_strips_do_not_change_the_result(spark, monkeypatch):
    rows = table(700, 24, 4, 5, 300)
    df, want = made(spark, rows), brute(rows)
    for name, value in {"PIECE": 60, "PIECES": 2, "MOST_ANCHORS": 3, "PACK": 17, "STRIP": 2, "CHUNK": 13, "MERGE": 2}.items():
        monkeypatch.setattr(hn, name, value)
    assert got(df) == want


@pytest.mark.parametrize("scale", [2.0**11, 2.0**20, 2.0**31])
def test_large_components_are_exact(spark, scale):
    rng = np.random.default_rng(3)
    rows = [(i, i % 3, np.floor(rng.uniform(-0.4, 1, 3) * scale)) for i in range(300)]
    assert got(made(spark, rows)) == brute(rows)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    dims = 40
    # vectors that are nearly constant inside their segments: what summaries can tell apart
    x = np.repeat(rng.normal(size=(400, 5)), 8, axis=1) * 100 + rng.normal(size=(400, dims))
    ids = np.arange(400)
    rows = hn._ordered(ids, np.array(["a"] * 400), np.floor(x), *hn.summaries(np.floor(x)), dims)
    anchors = rows.take(slice(0, 20))
    exact = hn.scores(anchors.x, rows.x)
    least = np.sort(exact, axis=1)[:, -6]
    left, open_ = hn.within(anchors, rows, least, np.full(20, np.inf))
    mask = np.zeros(exact.shape, bool)
    mask[:, left] = open_
    assert (mask | (exact < least[:, None])).all()  # no pair that is asked for is lost
    assert mask.sum() < 0.1 * mask.size
    for m, d in rows.levels:  # every level bounds every product
        middle, reach = m @ m.T, d @ d.T
        both = hn.scores(rows.x, rows.x)
        assert (np.abs(both - middle) <= reach + 1e-5 * np.abs(both).max() + 1).all()


def test_rows_that_take_no_part(spark):
    nan = float("nan")
    rows = [(0, 1, [3.0, 4.0]), (0, 1, [3.0, 4.0]), (1, 1, [5.0, 5.0]), (2, 2, [2.0, 2.0]), (3, None, [1.0, 1.0]), (4, 2, None), (5, 2, [nan, 1.0]), (6, 2, [None, 1.0]), (7, 2, [1.0]), (None, 2, [2.0, 2.0]), (8, 2, [4.0, 4.0]), (9, 2, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("c", F.lit(1)).withColumn("q", F.lit(1)).withColumn("id", F.lit(9))
    assert got(df) == [(0, 1, 1, 8, 35, 28), (0, 1, 2, 2, 35, 14)]
    assert got(df.limit(0)) == [] and got(df.filter("vec_id = 0")) == [] and got(df.filter("label = 1")) == []
