import zlib

import numpy as np

from tidemark.llm import language_id as li


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(0)
    net = li.fresh(["a", "b", "c"], 3, hidden=3)
    for d in (net.forward, net.backward):
        d.by_byte, d.by_state = d.by_byte.astype(np.float64), d.by_state.astype(np.float64)
    net.out, net.bias = net.out.astype(np.float64), net.bias.astype(np.float64)
    letters, valid = li.padded([b"hello", b"abc", b"\xc3\xa9tes", b"x"])
    label = np.array([0, 1, 2, 1])
    _, grads = li.gradients(net, letters, valid, label)
    for p, g in zip(net.parameters(), grads, strict=True):
        places = [tuple(rng.integers(0, s) for s in p.shape) for _ in range(6)] + ([(ord("l"), 1), (ord("b"), 5)] if p.shape[0] == 256 else [])
        for at in places:
            old, eps = p[at], 1e-2
            p[at] = old + eps
            up = li.gradients(net, letters, valid, label)[0]
            p[at] = old - eps
            down = li.gradients(net, letters, valid, label)[0]
            p[at] = old
            assert abs((up - down) / (2 * eps) - g[at]) < 2e-4


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    more = spark.createDataFrame([(-1, None, None, "s", 0), (-2, "123 $%&", "en", "s", 0), (-3, "", None, "s", 0), (-4, "é" * 5000, None, "s", 0)], docs.schema)
    want = {r.doc_id: r for r in docs.union(more).collect()}
    got = li.identify(docs.union(more)).collect()
    assert len(got) == len(want)
    right = total = 0
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        if r.doc_id < 0:
            assert (r.lang_pred == "und") == (r.doc_id != -4)
        elif r.held_out:
            total += 1
            right += r.lang_pred == want[r.doc_id].lang
    print("held-out accuracy", right / total)
    assert right / total > 0.97


def test_few_or_no_labels(spark):
    rows = spark.createDataFrame([(1, "some text", None), (2, "more", None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in li.identify(rows).collect()} == {"und"}
    assert li.identify(rows.limit(0)).count() == 0


def test_every_byte_counts_once():
    net = li.fresh(["a", "b"])
    texts = [b"", b"x", b"y" * 64, b"z" * 1000]
    p = li.document_scores(net, texts)
    assert np.allclose(p.sum(axis=1), [0, 1, 1, 1])
    one = li.document_scores(net, [texts[3]])
    assert np.allclose(one[0], p[3])


def test_what_is_rejected_depends_on_the_network(spark):
    rows = [(1, "aaaa aaa aa", 5), (2, "bbb bbbb b", 5), (3, None, 5), (4, "12 $$", 5), (5, "", 5), (6, "ab" * 400_000, 5), (1, "aaaa aaa aa", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    net = li.train([(b"aaa aa aaaa", "x"), (b"bbb bb b bbb", "y")])
    assert sorted(r.doc_id for r in li.identified(df.filter("doc_id < 6"), net).collect()) == [1, 1, 2]
    even = li.fresh(["x", "y"])
    even.out[:] = 0
    assert li.identified(df, even).count() == 0
    for lone in (["x"], ["und"]):
        assert sorted(r.doc_id for r in li.identified(df, li.fresh(lone)).collect()) == [1, 1, 2, 6]
    assert li.identified(df.limit(0), net).count() == 0
