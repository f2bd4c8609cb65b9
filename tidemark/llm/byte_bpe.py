"""Byte-level BPE by longest matches and backtracking.

An Aho-Corasick automaton over the vocabulary, with bytes written as Latin-1 characters, lists the tokens
that start at each position. Encoding takes the longest, and a shorter one where it may not follow the token
before it. Two tokens may be neighbours if merging their joined bytes gives those two again; the answer is
remembered for each pair. A position from which nothing fits is never tried twice, so time is linear.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.chunks import ChunkMemo

#: Neighbour pairs remembered in a task.
MOST_PAIRS = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.length = {i: len(b) for b, i in ranks.items()}
        self.most_bytes = max(self.length.values(), default=0)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.automaton.add_word(b.decode("latin-1"), i)
        self.automaton.make_automaton()
        #: The longest token that a token starts with, itself apart; -1 for none.
        self.shorter = {i: next((ranks[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in ranks), -1) for b, i in ranks.items()}

    def merge(self, piece: bytes) -> list[int]:
        """The definition: join the adjacent parts of the lowest rank, leftmost first, while any join is known."""
        rank, none = self.ranks.get, 1 << 60
        parts = [piece[i : i + 1] for i in range(len(piece))]
        joins = [rank(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while joins and (best := min(joins)) < none:
            at = joins.index(best)
            parts[at] += parts.pop(at + 1)
            del joins[at]
            if at:
                joins[at - 1] = rank(parts[at - 1] + parts[at], none)
            if at < len(joins):
                joins[at] = rank(parts[at] + parts[at + 1], none)
        return [self.ranks[p] for p in parts]

    def may_follow(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            known = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            self.pairs[a, b] = known
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern: the longest match at each position, or a shorter one where it may not follow."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        latin = piece.decode("latin-1")
        # the longest matches one after the other, which mostly may follow each other
        ids = [token for _, token in self.automaton.iter_long(latin)]
        known = self.pairs.get
        for pair in zip(ids, ids[1:], strict=False):
            fits = known(pair)
            if not (self.may_follow(*pair) if fits is None else fits):
                return self.backtrack(latin)
        return ids

    def longest_at(self, latin: str, at: int) -> int:
        return next(self.automaton.iter_long(latin[at : at + self.most_bytes]))[1]

    def backtrack(self, latin: str) -> list[int]:
        length, size = self.length, len(latin)
        dead = bytearray(size + 1)
        ids: list[int] = []
        at, token = 0, self.longest_at(latin, 0)
        while at < size:
            before = ids[-1] if ids else None
            while token >= 0 and (dead[at + length[token]] or before is not None and not self.may_follow(before, token)):
                token = self.shorter[token]
            if token >= 0:
                ids.append(token)
                at += length[token]
                token = self.longest_at(latin, at) if at < size else -1
            else:
                dead[at] = 1
                token = ids.pop()
                at -= length[token]
                token = self.shorter[token]
        return ids

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.pattern.findall(text) for i in self.encode_piece(piece.encode())]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> ByteBPE:
    """One for each Python worker."""
    return ByteBPE(read_ranks(path), pattern)


@lru_cache(maxsize=2)
def round_trip_memo(path: str, pattern: str) -> ChunkMemo:
    """Chunk -> number of its ids, the ids as decimals, the ids decoded; kept from task to task of a Python worker."""
    bpe = coder(path, pattern)

    def both(chunk: str) -> tuple[int, bytes, bytes]:
        ids = bpe.encode(chunk)
        return len(ids), ",".join(map(str, ids)).encode(), bpe.decode(ids)

    return ChunkMemo(both)


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids (array of int) of each whole text; a null text is the empty one, which has no ids. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        memo = ChunkMemo(bpe.encode)
        for b in batches:
            ids = [[i for chunk in memo.values(t or "") for i in chunk] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, f"id {dict(own.dtypes)['id']}, ids array<int>").withColumnRenamed("id", id_col)


def decode_ids(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """encoded with a column decoded (binary); null ids give null."""
    at = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for b in batches:
            out = [None if x is None else bpe.decode(x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=[*b.schema.names, "decoded"])

    fields = ", ".join(f"`{n}` {t}" for n, t in encoded.dtypes)
    return encoded.mapInArrow(run, f"{fields}, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256, of whole texts, without keeping the ids.

    What a repeated chunk gives is remembered in each Python worker, for a bounded number of chunks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = round_trip_memo(path, pattern)
        for b in batches:
            counts, digests, decoded = [], [], []
            for text in b.column(1).to_pylist():
                n, decimals, back = zip(*memo.values(text), strict=True) if text else ((), (), ())
                counts.append(sum(n))
                digests.append(hashlib.sha256(b",".join(decimals)).hexdigest())
                decoded.append(hashlib.sha256(b"".join(back)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, f"id {dict(own.dtypes)['id']}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
