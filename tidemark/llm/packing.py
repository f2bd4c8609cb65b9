"""Packing of token sequences: first-fit decreasing over a tournament tree of free space.

Documents are dealt at random (by a hash of id and text) into groups, which are packed independently. In a group
full-length pieces are cut off long documents; the rests go, largest first, into the first sequence with
room, which a tournament tree of free space finds in logarithmic time. Then the emptiest sequences are
taken apart again: their pieces, cut where needed, fill the gaps of the others.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batch_count, in_batches, text_bytes

LENGTH = 2048
END_ID = 1
#: About so much text is packed together.
GROUP_BYTES = 16 << 20
#: Gaps of fewer tokens are left as they are.
LEAST_GAP = 8


class FirstFitTree:
    """A tournament tree over bins, whose nodes hold the largest free space below; first(n) is the leftmost bin with n free."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.free = [capacity] * (2 * self.leaves)

    def first(self, need: int) -> int:
        node = 1
        while node < self.leaves:
            node *= 2
            node += self.free[node] < need
        return node - self.leaves

    def take(self, which: int, amount: int) -> None:
        node = which + self.leaves
        self.free[node] -= amount
        while node := node // 2:
            self.free[node] = max(self.free[2 * node], self.free[2 * node + 1])


def _shortest_bins(bins: list[list], free: list[int]) -> None:
    """Move pieces of the emptiest bins into the gaps of the fullest; bins change in place, empty ones may stay."""
    order = sorted(range(len(bins)), key=free.__getitem__)
    lo, hi = 0, len(order) - 1
    while lo < hi:
        to, source = order[lo], order[hi]
        if free[to] < LEAST_GAP:
            lo += 1
        elif not bins[source]:
            hi -= 1
        else:
            doc, start, length = bins[source].pop()
            moved = min(length, free[to])
            if length > moved:
                bins[source].append((doc, start, length - moved))
            bins[to].append((doc, start + length - moved, moved))
            free[to] -= moved
            free[source] += moved


def pack_group(lengths: list[int], capacity: int = LENGTH) -> list[list[tuple[int, int, int]]]:
    """Sequences of (number of the document, start, length)."""
    full, rests = [], []
    for doc, n in enumerate(lengths):
        cut = n - n % capacity
        full += [[(doc, s, capacity)] for s in range(0, cut, capacity)]
        if n > cut:
            rests.append((n - cut, doc, cut))
    rests.sort(key=lambda x: (-x[0], x[1]))
    tree = FirstFitTree(len(rests), capacity)
    bins: list[list] = [[] for _ in rests]
    free = [capacity] * len(rests)
    for n, doc, start in rests:
        k = tree.first(n)
        tree.take(k, n)
        bins[k].append((doc, start, n))
        free[k] -= n
    used = [k for k, b in enumerate(bins) if b]
    bins, free = [bins[k] for k in used], [free[k] for k in used]
    _shortest_bins(bins, free)
    return full + [b for b in bins if b]


def _letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: bytes that print stand for themselves, the others for 256 and on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> tuple[tiktoken.Encoding, dict[str, int]]:
    """The vocabulary of a tokenizers file whose ids are in order of merging, and its special tokens."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    special = {x["content"]: x["id"] for x in made["added_tokens"]}
    letters = _letters()
    ranks = {bytes(map(letters.__getitem__, t)): i for t, i in made["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special), special


def text_ids(path: str, pattern: str):
    """text -> its ids as little-endian unsigned 32-bit bytes, as the tokenizers library gives them."""
    coding, _ = tokenizer(path, pattern)
    return lambda text: coding.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()


PIECES = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Pieces: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of its whole text (null: empty) and end_id, so each document has a piece.
    sequence_id is unique over all groups. Rows that repeat an id are packed each on its own; an empty
    table gives no rows; other columns are ignored.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size = text_bytes(own)
    grouped = in_batches(own, ["id", "text"], size, GROUP_BYTES)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = text_ids(path, pattern)
        ids, tokens, group = [], [], None

        def packed() -> pa.RecordBatch:
            rows = []
            for k, sequence in enumerate(pack_group([len(t) // 4 for t in tokens], capacity)):
                at = 0
                for doc, start, n in sequence:
                    t = tokens[doc]
                    rows.append((ids[doc], start, n, zlib.crc32(memoryview(t)[4 * start : 4 * (start + n)]), len(t) // 4, (group << 32) + k, at))
                    at += n
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in PIECES.split(", ")])

        for b in batches:
            for g, i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if g != group and ids:
                    yield packed()
                    ids, tokens = [], []
                group = g
                ids.append(i)
                tokens.append(ids_of(t or "") + end)
        if ids:
            yield packed()

    # a partition for each batch, as hashing the batches' numbers would put several into one
    batches = batch_count(docs.sparkSession, size, GROUP_BYTES)
    dealt = grouped.select("batch", "id", "text").repartitionById(batches, "batch").sortWithinPartitions("batch", "id")
    return dealt.mapInArrow(run, PIECES).withColumnRenamed("id", id_col)
