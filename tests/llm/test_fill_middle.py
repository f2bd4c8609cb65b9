import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import fill_middle as fm

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
TEXTS = st.text(alphabet=st.sampled_from("abzAZ 0-\n\t\x00éß漢🙂🏽́ \x85<PSM>"), max_size=60)


def plainly(doc_id, text, seed="1", unit="token"):
    """The contract by strings."""
    units = UNIT.findall(text) if unit == "token" else list(text)
    n = len(units)
    x = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(0, 500), st.sampled_from(["token", "char"]))
def test_rearranged_is_the_contract(text, doc_id, unit):
    n, form, prefix, middle, output = fm.rearranged(text.encode(), fm.draws("1", doc_id), unit)
    assert (n, form, prefix, middle, output.decode()) == plainly(doc_id, text, unit=unit)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_places_turn_into_each_other(text):
    index = fm.ExceptionIndex.of(np.frombuffer(text.encode(), np.uint8))
    first = np.array([len(text[:k].encode()) for k in range(len(text) + 1)])
    assert index.chars(first).tolist() == list(range(len(text) + 1))
    assert index.bytes(np.arange(len(text) + 1)).tolist() == first.tolist()
    assert len(index.starts) == sum(ord(c) > 127 for c in text)


def test_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    made = fm.fill_middle(docs).withColumn("back", fm.restored(F.col("output"), F.col("form")))
    texts = {r.doc_id: r.text for r in docs.collect()}
    forms = set()
    for r in made.collect():
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plainly(r.doc_id, texts[r.doc_id] or "")
        assert r.back == (texts[r.doc_id] or "")
        forms.add(r.form)
    assert forms == {"plain", "psm", "spm"}


def test_other_units_and_seeds(spark):
    rows = [(k, f"a{'é' * (k % 5)} b 漢 <{k}") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for unit, seed in (("char", "1"), ("token", "other")):
        got = {r.doc_id: tuple(r)[1:] for r in fm.fill_middle(docs, unit=unit, seed=seed).collect()}
        assert got == {k: plainly(k, t, seed, unit) for k, t in rows}


@pytest.mark.parametrize("out_bytes", [1, 40])
def test_rows_leave_in_small_batches(spark, monkeypatch, out_bytes):
    monkeypatch.setattr(fm, "OUT_BYTES", out_bytes)
    docs = spark.createDataFrame([(k, "word " * k) for k in range(30)], "doc_id long, text string")
    assert {r.doc_id: r.output for r in fm.fill_middle(docs).collect()} == {k: plainly(k, "word " * k)[4] for k in range(30)}
