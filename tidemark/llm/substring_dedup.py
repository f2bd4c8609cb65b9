"""Removal of passages that an earlier document has, by difference-cover anchors.

Documents are dealt into batches by a hash of id and text. A batch settles by itself which windows a smaller
document of the same batch has. For the rest it hashes anchors (runs of ANCHOR words) only where the place
modulo PERIOD lies in a difference cover: of any two places some common shift is in the cover for both, so
equal windows of ANCHOR + PERIOD - 1 words share an anchor. Anchors that two batches have come back, and
only windows around those are extended to their 13 words and compared over all batches, by hashes of two
families, with each batch's smallest document. Rows of every exchange are sorted arrays for a (batch, part of the hashes): a passage that very
many documents share is sent once for each batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import in_batches, shuffle_partitions, text_bytes
from tidemark.llm.words import mix, window_hashes, word_bounds, word_hashes

WINDOW = 13
#: A difference cover: every residue is a difference of two members. Fixed values.
PERIOD, COVER = 7, (1, 2, 4)
ANCHOR = WINDOW - PERIOD + 1
BATCH_BYTES = 8 << 20


class Batch:
    """Word hashes of a batch's documents, in order of their ids, and their windows."""

    def __init__(self, ids: list, texts: list[bytes]):
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k]))
        self.ids = [ids[k] for k in order]
        self.texts = [texts[k] for k in order]
        self.bounds = [word_bounds(t) for t in self.texts]
        self.words = [word_hashes(t, *b) for t, b in zip(self.texts, self.bounds, strict=True)]
        # rows that repeat an id count as one document, rows without an id come after all others
        self.number = np.unique([(1 << 63) - 1 if i is None else i for i in self.ids], return_inverse=True)[1] if ids else np.zeros(0, int)
        self.smallest = np.array([(1 << 63) - 1 if i is None else i for i in self.ids], np.int64)
        self.counts = np.array([max(0, len(w) - WINDOW + 1) for w in self.words], np.int64)
        self.first = np.r_[0, np.cumsum(self.counts)]
        doc = np.repeat(np.arange(len(self.words)), self.counts)
        self.doc = doc
        self.place = np.arange(len(doc)) - self.first[doc]
        self.window = np.concatenate([window_hashes(w, WINDOW, 1)[:c] for w, c in zip(self.words, self.counts, strict=True)] or [np.zeros(0, np.uint64)])
        self._settle()

    def _settle(self) -> None:
        """covered: a smaller document of this batch has the window, word for word; the others of a hash are its first document's."""
        _, at, group = np.unique(self.window, return_index=True, return_inverse=True)
        if not len(at):
            self.covered = np.zeros(0, bool)
            return
        self.covered = self.number[self.doc] > self.number[self.doc[at]][group]
        # the words of each covered window against those of the first window with its hash
        words, begin = np.concatenate(self.words), np.r_[0, np.cumsum([len(w) for w in self.words])]
        where = begin[self.doc] + self.place
        late = np.flatnonzero(self.covered)
        first = where[at[group[late]]]
        other = np.zeros(len(late), bool)
        for k in range(WINDOW):
            other |= words[where[late] + k] != words[first + k]
        for w in late[other]:  # unequal windows of one hash
            same = np.flatnonzero(self.window == self.window[w])
            own = self.digest(w)
            self.covered[w] = any(self.number[self.doc[x]] < self.number[self.doc[w]] and self.digest(x) == own for x in same)

    def checks(self, windows: np.ndarray) -> np.ndarray:
        """32 bits of windows by the second family of word hashes."""
        docs, own = np.unique(self.doc[windows], return_inverse=True)
        words = [word_hashes(self.texts[d], *self.bounds[d], 1) for d in docs]
        if not words:
            return np.zeros(0, "<u4")
        at = np.r_[0, np.cumsum(list(map(len, words)))][own] + self.place[windows]
        words = np.concatenate(words)
        out = np.zeros(len(at), np.uint64)
        for k in range(WINDOW):
            out = out * np.uint64(0xA0761D6478BD642F) + words[at + k]
            out ^= out >> np.uint64(29)
        return (mix(out) >> np.uint64(32)).astype("<u4")

    def digest(self, window: int) -> bytes:
        """128 bits of the bytes of a window's words."""
        doc, at = self.doc[window], self.place[window]
        starts, ends = self.bounds[doc]
        lo, hi = int(starts[at]), int(ends[at + WINDOW - 1])
        return hashlib.blake2b(b" ".join(self.texts[doc][lo:hi].split()), digest_size=16).digest()

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the anchors in unsettled windows, and the first window that holds each."""
        runs = np.concatenate([window_hashes(w, ANCHOR, 3)[: c + PERIOD - 1] for w, c in zip(self.words, self.counts, strict=True) if c] or [np.zeros(0, np.uint64)])
        many = np.where(self.counts > 0, self.counts + PERIOD - 1, 0)
        begin = np.r_[0, np.cumsum(many)]
        doc = np.repeat(np.arange(len(many)), many)
        place = np.arange(len(doc)) - begin[doc]
        # window w holds the anchors at places w .. w + PERIOD - 1
        open_ = np.r_[0, np.cumsum(~self.covered)]
        lo = self.first[doc] + np.maximum(0, place - PERIOD + 1)
        hi = self.first[doc] + np.minimum(self.counts[doc], place + 1)
        wanted = np.isin(place % PERIOD, COVER) & (open_[hi] > open_[lo])
        self.lo, self.hi = lo[wanted], hi[wanted]
        return runs[wanted]


def _parts(hashes: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, places of its hashes) for a dealing of hashes into n parts."""
    part = (hashes % np.uint64(n)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    own, first = np.unique(part[order], return_index=True)
    for k, at in zip(own.tolist(), np.split(order, first[1:]), strict=bool(len(own))):
        yield k, at


def _keys(hashes: np.ndarray, n: int) -> np.ndarray:
    """32 bits of an anchor's hash beyond its part."""
    return (mix(hashes // np.uint64(n)) >> np.uint64(32)).astype("<u4")


def _of(table: pa.Table) -> Batch:
    return Batch(table.column("id").to_pylist(), [(t or "").encode() for t in table.column("text").to_pylist()])


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


_SENT = pa.schema([("part", pa.int32()), ("batch", pa.int32()), ("keys", pa.binary())])
_BACK = pa.schema([("batch", pa.int32()), ("part", pa.int32()), ("keys", pa.binary())])
_FOUND = pa.schema([("batch", pa.int32()), ("keys", pa.binary()), ("checks", pa.binary())])
_WINDOWS = pa.schema([("part", pa.int32()), ("batch", pa.int32()), ("keys", pa.binary()), ("checks", pa.binary()), ("first", pa.binary())])
_DONE = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])


def _spark_schema(schema: pa.Schema) -> str:
    kinds = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def send_anchors(n: int):
    def run(table: pa.Table) -> pa.Table:
        batch = _of(table)
        hashes = batch.anchors()
        number = table.column("batch")[0].as_py()
        return _table(_SENT, [(k, number, np.unique(_keys(hashes[at], n)).tobytes()) for k, at in _parts(hashes, n)])

    return run


def shared_keys(table: pa.Table) -> pa.Table:
    """Keys of one part that at least two batches have, for each of those batches."""
    own = [(b, p, np.frombuffer(k, "<u4")) for p, b, k in zip(*(table.column(c).to_pylist() for c in ("part", "batch", "keys")), strict=True)]
    if len(own) < 2:
        return _table(_BACK, [])
    keys, counts = np.unique(np.concatenate([k for *_, k in own]), return_counts=True)
    keys = keys[counts > 1]
    return _table(_BACK, [(b, p, found.tobytes()) for b, p, k in own if len(found := np.intersect1d(k, keys, assume_unique=True))])


def send_windows(n: int):
    def run(docs: pa.Table, shared: pa.Table) -> pa.Table:
        if not docs.num_rows or not shared.num_rows:
            return _table(_WINDOWS, [])
        batch = _of(docs)
        hashes = batch.anchors()
        known = {p: np.frombuffer(k, "<u4") for p, k in zip(shared.column("part").to_pylist(), shared.column("keys").to_pylist(), strict=True)}
        hit = np.zeros(len(hashes), bool)
        for k, at in _parts(hashes, n):
            if k in known:
                hit[at] = np.isin(_keys(hashes[at], n), known[k])
        # windows that hold such an anchor, and are not settled
        step = np.zeros(len(batch.window) + 1, np.int64)
        np.add.at(step, batch.lo[hit], 1)
        np.add.at(step, batch.hi[hit], -1)
        open_ = np.flatnonzero((np.cumsum(step[:-1]) > 0) & ~batch.covered)
        # documents lie in order of their ids, so the first of a hash is its smallest
        keys, at = np.unique(batch.window[open_], return_index=True)
        at = open_[at]
        first = batch.smallest[batch.doc[at]]
        number = docs.column("batch")[0].as_py()
        checks = batch.checks(at)
        return _table(_WINDOWS, [(k, number, keys[own].tobytes(), checks[own].tobytes(), first[own].tobytes()) for k, own in _parts(keys, n)])

    return run


def covered_elsewhere(table: pa.Table) -> pa.Table:
    """Of one part, each batch's windows that a smaller document of another batch has."""
    rows = list(zip(*(table.column(c).to_pylist() for c in ("part", "batch", "keys", "checks", "first")), strict=True))
    if len(rows) < 2:
        return _table(_FOUND, [])
    own = [(b, np.frombuffer(k, np.uint64), np.frombuffer(c, "<u4"), np.frombuffer(f, np.int64)) for _, b, k, c, f in rows]
    keys, checks, first = (np.concatenate([x[i] for x in own]) for i in (1, 2, 3))
    order = np.lexsort((first, checks, keys))
    new = np.r_[True, (np.diff(keys[order]) != 0) | (np.diff(checks[order]) != 0)]
    least = np.empty(len(keys), np.int64)
    least[order] = first[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    edges = np.cumsum([0, *(len(x[1]) for x in own)])
    late = least < first
    return _table(_FOUND, [(x[0], keys[lo:hi][late[lo:hi]].tobytes(), checks[lo:hi][late[lo:hi]].tobytes()) for x, lo, hi in zip(own, edges, edges[1:], strict=False) if late[lo:hi].any()])


def rewrite(with_text: bool):
    def run(docs: pa.Table, elsewhere: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _table(_DONE, [])
        batch = _of(docs)
        covered = batch.covered
        if elsewhere.num_rows:
            found, checks = (np.frombuffer(b"".join(elsewhere.column(c).to_pylist()), kind) for c, kind in (("keys", np.uint64), ("checks", "<u4")))
            order = np.argsort(found, kind="stable")
            found, checks = found[order], checks[order]
            at = np.flatnonzero(np.isin(batch.window, found) & ~covered)
            lo, hi = (np.searchsorted(found, batch.window[at], side) for side in ("left", "right"))
            own = batch.checks(at)
            hit = np.zeros(len(at), bool)
            for k in range(int((hi - lo).max(initial=0))):  # more than one where unequal windows have one hash
                hit |= (lo + k < hi) & (checks[np.minimum(lo + k, len(checks) - 1)] == own)
            covered = covered.copy()
            covered[at] = hit
        rows = []
        for d, (i, text, (starts, ends)) in enumerate(zip(batch.ids, batch.texts, batch.bounds, strict=True)):
            gone = np.zeros(len(starts) + 1, np.int64)
            at = np.flatnonzero(covered[batch.first[d] : batch.first[d + 1]])
            gone[at] += 1
            np.subtract.at(gone, at + WINDOW, 1)
            stay = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
            kept = b" ".join(text.split()) if len(stay) == len(starts) else b" ".join([text[s:e] for s, e in zip(starts[stay].tolist(), ends[stay].tolist(), strict=True)])
            rows.append((i, len(starts), len(starts) - len(stay), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
        return _table(_DONE, rows)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row for each row of docs: id, n_words, n_removed, kept_sha256 and, if asked for, kept.

    A word goes if a window of 13 words over it also starts in a document with a smaller id. A null text
    has no words; texts of fewer than 13 words stay. Rows with one id count as one document, rows without
    an id as later than all others. In a batch windows are compared by 64 bits of each of their words, and
    those that share an anchor with another batch by 64 bits of one family of hashes and 32 of another. An empty table gives no rows; other columns
    are ignored.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = text_bytes(own)
    dealt = in_batches(own, ["id", "text"], size, BATCH_BYTES).select("batch", "id", "text")
    n = max(shuffle_partitions(docs.sparkSession), size // BATCH_BYTES)
    sent = dealt.groupBy("batch").applyInArrow(send_anchors(n), _spark_schema(_SENT))
    shared = sent.groupBy("part").applyInArrow(shared_keys, _spark_schema(_BACK))
    windows = dealt.groupBy("batch").cogroup(shared.groupBy("batch")).applyInArrow(send_windows(n), _spark_schema(_WINDOWS))
    elsewhere = windows.groupBy("part").applyInArrow(covered_elsewhere, _spark_schema(_FOUND))
    done = dealt.groupBy("batch").cogroup(elsewhere.groupBy("batch")).applyInArrow(rewrite(with_text), _spark_schema(_DONE))
    return done.withColumnRenamed("id", id_col) if with_text else done.drop("kept").withColumnRenamed("id", id_col)
