"""Language-model scores: marginal likelihood over all segmentations of the words into vocabulary pieces.

The vocabulary is a public one, and its scores, which are merge ranks, give prior piece probabilities by
Zipf's law; one round of expectation over the training documents' word counts, on the lattices of the distinct words, gives the probabilities
that score. No piece reaches over a word, so a text's forward recursion is the sum of its words' ones, and
each distinct word of the corpus is computed once. Word counts travel as packed arrays for each batch of
documents and part of the words, and come back in the same order.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BYTE_LOWER, BYTE_WORD, cut, in_batches, shuffle_partitions, text_bytes

BATCH_BYTES = 8 << 20
#: What sentencepiece vocabularies write before a word.
MARK = "▁".encode()
#: Words of more bytes are computed one by one.
LONG_WORD = 48
#: Words of one length that are computed together.
TOGETHER = 20_000
LN10 = np.log(10)


class Pieces:
    """A byte trie of the vocabulary. Node k has the piece piece[k], or -1, and edges at key = node * 256 + byte."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names: dict[bytes, int] = {}
        ranks: list[float] = []
        for i in range(model.get_piece_size()):
            if model.is_control(i) or model.is_unknown(i):
                continue
            name = model.id_to_piece(i)
            if names.setdefault(bytes([int(name[3:-1], 16)]) if model.is_byte(i) else name.encode(), len(names)) == len(ranks):
                # bytes, which stand in for what has no piece, come after all merges
                ranks.append(model.get_piece_size() if model.is_byte(i) else -model.get_score(i))
        self.size, self.ranks = len(names), np.array(ranks)
        self.next: list[dict[int, int]] = [{}]
        piece = [-1]
        for name, number in names.items():
            at = 0
            for b in name:
                at = self.next[at].setdefault(b, len(self.next))
                if at == len(self.next):
                    self.next.append({})
                    piece.append(-1)
            piece[at] = number
        self.piece = np.array(piece)
        edges = sorted((k * 256 + b, to) for k, out in enumerate(self.next) for b, to in out.items())
        self.keys, self.to = np.array(edges, np.int64).T.copy()

    def prior(self) -> np.ndarray:
        """Zipf's law over the vocabulary's scores, which are merge ranks below zero."""
        p = 1 / (1 + self.ranks)
        return np.log(p / p.sum())


@lru_cache(maxsize=1)
def pieces(path: str) -> Pieces:
    """One for each Python worker."""
    return Pieces(path)


def _forward(vocabulary: Pieces, scores: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """Log-space forward sums of words of one length (rows of letters), and the lattice's edges."""
    n, length = letters.shape
    node_score = np.where(vocabulary.piece >= 0, scores[vocabulary.piece], -np.inf)
    alpha = np.full((n, length + 1), -np.inf)
    alpha[:, 0] = 0
    edges = []
    for i in range(length):
        rows, state = np.arange(n), np.zeros(n, np.int64)
        for j in range(i, length):
            key = state * 256 + letters[rows, j]
            at = np.minimum(np.searchsorted(vocabulary.keys, key), len(vocabulary.keys) - 1)
            there = vocabulary.keys[at] == key
            rows, state = rows[there], vocabulary.to[at[there]]
            if not len(rows):
                break
            ends = vocabulary.piece[state] >= 0
            own, node = rows[ends], state[ends]
            if len(own):
                alpha[own, j + 1] = np.logaddexp(alpha[own, j + 1], alpha[own, i] + node_score[node])
                edges.append((i, j + 1, own, node))
    return alpha, edges


def _expected(vocabulary: Pieces, scores: np.ndarray, alpha: np.ndarray, edges: list[tuple], counts: np.ndarray) -> np.ndarray:
    beta = np.full(alpha.shape, -np.inf)
    beta[:, -1] = 0
    total = np.zeros(vocabulary.size)
    for i, j, rows, node in sorted(edges, key=lambda e: -e[0]):
        piece = vocabulary.piece[node]
        through = scores[piece] + beta[rows, j]
        beta[rows, i] = np.logaddexp(beta[rows, i], through)
        total += np.bincount(piece, np.exp(alpha[rows, i] + through - alpha[rows, -1]) * counts[rows], vocabulary.size)
    return total


def _long_edges(vocabulary: Pieces, word: bytes) -> list[tuple[int, int, int]]:
    out = []
    for i in range(len(word)):
        node, j = 0, i
        while j < len(word) and (node := vocabulary.next[node].get(word[j], 0)):
            j += 1
            if vocabulary.piece[node] >= 0:
                out.append((i, j, int(vocabulary.piece[node])))
    return out


def _add(a: float, b: float) -> float:
    return b if a == -np.inf else a if b == -np.inf else float(np.logaddexp(a, b))


def word_scores(vocabulary: Pieces, scores: np.ndarray, words: list[bytes], counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """ln probability of each word over all its segmentations; expected piece counts where counts are given."""
    out, expected = np.zeros(len(words)), np.zeros(vocabulary.size)
    marked = [MARK + w for w in words]
    sizes = np.array([len(w) for w in marked], np.int64)
    for size in np.unique(sizes):
        which = np.flatnonzero(sizes == size)
        if size > LONG_WORD:
            for k in which:
                edges = _long_edges(vocabulary, marked[k])
                alpha, beta = [0.0] + [-np.inf] * size, [-np.inf] * size + [0.0]
                for i, j, piece in edges:
                    alpha[j] = _add(alpha[j], alpha[i] + scores[piece])
                out[k] = alpha[-1]
                if counts is not None and counts[k]:
                    for i, j, piece in reversed(edges):
                        beta[i] = _add(beta[i], scores[piece] + beta[j])
                    for i, j, piece in edges:
                        expected[piece] += np.exp(alpha[i] + scores[piece] + beta[j] - alpha[-1]) * counts[k]
            continue
        for at in range(0, len(which), TOGETHER):
            own = which[at : at + TOGETHER]
            letters = np.frombuffer(b"".join(marked[k] for k in own), np.uint8).reshape(-1, size).astype(np.int64)
            alpha, edges = _forward(vocabulary, scores, letters)
            out[own] = alpha[:, -1]
            if counts is not None:
                expected += _expected(vocabulary, scores, alpha, edges, counts[own])
    return out, expected


_SENT = pa.schema([("part", pa.int32()), ("batch", pa.int32()), ("words", pa.binary()), ("counts", pa.binary())])
_STATS = pa.schema([("slot", pa.int32()), ("tokens", pa.int64()), ("distinct", pa.int64()), ("weights", pa.binary())])
_BACK = pa.schema([("batch", pa.int32()), ("part", pa.int32()), ("counts", pa.binary()), ("scores", pa.binary())])
_DONE = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
#: So many parts' statistics (an array over the vocabulary each) are added up at a time, level by level.
TOGETHER_PARTS = 32


def _spark_schema(schema: pa.Schema) -> str:
    kinds = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.float64(): "double", pa.bool_(): "boolean"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def _words(text: str | None) -> list[bytes]:
    return BYTE_WORD.findall((text or "").encode().translate(BYTE_LOWER))


def _dealt(words: dict[bytes, int], n: int) -> dict[int, list[bytes]]:
    """Words by their part of the dealing, each part in order."""
    out: dict[int, list[bytes]] = {}
    for w in sorted(words):
        out.setdefault(xxhash.xxh64_intdigest(w) % n, []).append(w)
    return out


def send_words(n: int):
    """A batch's words with their counts in training documents (0: only in others)."""

    def run(table: pa.Table) -> pa.Table:
        counts: dict[bytes, int] = {}
        for text, held_out in zip(table.column("text").to_pylist(), table.column("held_out").to_pylist(), strict=True):
            if held_out:
                for w in _words(text):
                    counts.setdefault(w, 0)
            else:
                for w in _words(text):
                    counts[w] = counts.get(w, 0) + 1
        number = table.column("batch")[0].as_py()
        return _table(_SENT, [(k, number, b"\n".join(own), np.array([counts[w] for w in own], "<u4").tobytes()) for k, own in _dealt(counts, n).items()])

    return run


def _summed(table: pa.Table) -> tuple[dict[bytes, int], list[list[bytes]]]:
    total: dict[bytes, int] = {}
    sent = []
    for words, counts in zip(table.column("words").to_pylist(), table.column("counts").to_pylist(), strict=True):
        sent.append(words.split(b"\n"))
        for w, c in zip(sent[-1], np.frombuffer(counts, "<u4").tolist(), strict=True):
            total[w] = total.get(w, 0) + c
    return total, sent


def gather(path: str):
    """Expected piece counts and token totals of one part of the training words."""

    def run(table: pa.Table) -> pa.Table:
        total, _ = _summed(table)
        known = [w for w, c in total.items() if c]
        counts = np.array([total[w] for w in known], np.float64)
        vocabulary = pieces(path)
        _, expected = word_scores(vocabulary, vocabulary.prior(), known, counts)
        slot = table.column("part")[0].as_py() // TOGETHER_PARTS
        return _table(_STATS, [(slot, int(counts.sum()), len(known), expected.tobytes())])

    return run


def add_up(table: pa.Table) -> pa.Table:
    """One slot's statistics in one row, for the slot of the next level."""
    weights = sum(np.frombuffer(w) for w in table.column("weights").to_pylist())
    return _table(_STATS, [(table.column("slot")[0].as_py() // TOGETHER_PARTS, sum(table.column("tokens").to_pylist()), sum(table.column("distinct").to_pylist()), weights.tobytes())])


def answer(path: str, scores: np.ndarray):
    """To each batch, its words' counts over all training texts and their ln probabilities."""

    def run(table: pa.Table) -> pa.Table:
        total, sent = _summed(table)
        words = list(total)
        found, _ = word_scores(pieces(path), scores, words)
        place = {w: k for k, w in enumerate(words)}
        counts = np.array(list(total.values()), np.int64)
        rows = []
        for part, batch, own in zip(table.column("part").to_pylist(), table.column("batch").to_pylist(), sent, strict=True):
            at = np.fromiter(map(place.__getitem__, own), np.int64, len(own))
            rows.append((batch, part, counts[at].tobytes(), found[at].tobytes()))
        return _table(_BACK, rows)

    return run


def score_texts(n: int, tokens: int, distinct: int, ends: int, end_score: float):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _table(_DONE, [])
        texts = [_words(t) for t in docs.column("text").to_pylist()]
        dealt = _dealt(dict.fromkeys(w for t in texts for w in t), n)
        place: dict[bytes, int] = {}
        counts, scores = [np.zeros(0, np.int64)], [np.zeros(0)]
        for part, c, s in zip(*(answers.column(x).to_pylist() for x in ("part", "counts", "scores")), strict=True):
            for w in dealt[part]:
                place[w] = len(place)
            counts.append(np.frombuffer(c, np.int64))
            scores.append(np.frombuffer(s))
        count, score = np.concatenate(counts), np.concatenate(scores)
        under = np.log10(tokens + distinct + 1)
        base = np.log10(count + 1) - under
        rows = []
        for i, held_out, words in zip(docs.column("id").to_pylist(), docs.column("held_out").to_pylist(), texts, strict=True):
            at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
            rows.append((
                i, held_out, len(words) + 1, int((count[at] > 0).sum()) + (ends > 0), tokens,
                float(base[at].sum() + np.log10(ends + 1) - under), float((score[at].sum() + end_score) / LN10),
            ))
        return _table(_DONE, rows)

    return run


def score_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_out_fold: int = 2) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs, whole texts.

    A null text is the empty one, which has its end alone. Rows that repeat an id count each, and so do rows
    without one, in the fold of the empty text. Without any training text the base score is 0 for each token
    and the pieces keep their prior. An empty table gives no rows; other columns are ignored.
    """
    fold = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), (fold == held_out_fold).alias("held_out"))
    size = text_bytes(own)
    dealt = in_batches(own, ["id", "text"], size, BATCH_BYTES).select("batch", "id", "text", "held_out")
    n = max(shuffle_partitions(docs.sparkSession), size // BATCH_BYTES)
    sent = cut(dealt.groupBy("batch").applyInArrow(send_words(n), _spark_schema(_SENT)))
    ends = own.filter("not held_out").count()
    stats, slots = sent.groupBy("part").applyInArrow(gather(path), _spark_schema(_STATS)), -(-n // TOGETHER_PARTS)
    while True:
        stats = stats.groupBy("slot").applyInArrow(add_up, _spark_schema(_STATS))
        if slots <= TOGETHER_PARTS:
            break
        slots = -(-slots // TOGETHER_PARTS)
    found = stats.collect()  # a row for each of the last level's slots
    tokens, distinct = sum(r.tokens for r in found) + ends, sum(r.distinct for r in found) + (ends > 0)
    vocabulary = pieces(path)
    # the prior counts as one use of each piece
    weights = np.exp(vocabulary.prior()) * vocabulary.size + sum((np.frombuffer(r.weights) for r in found), np.zeros(vocabulary.size))
    whole = weights.sum() + ends + 1
    answers = sent.groupBy("part").applyInArrow(answer(path, np.log(weights / whole)), _spark_schema(_BACK))
    done = dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(score_texts(n, tokens, distinct, ends, float(np.log((ends + 1) / whole))), _spark_schema(_DONE))
    return done.withColumnRenamed("id", id_col)
