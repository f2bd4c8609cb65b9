"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

The network reads windows of WINDOW bytes in both directions, gives every byte a distribution over the
languages, and a document the mean of its bytes' distributions. Training is backpropagation through time
on a bounded sample of labelled documents; the trained weights, a few kilobytes, go to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, small

HIDDEN = 8
WINDOW = 64
#: The sample: about so many documents of each language, and so many windows of each.
SAMPLE_DOCUMENTS, SAMPLE_WINDOWS = 300, 3
STEPS, BATCH, RATE = 220, 256, 0.03
#: Windows that are read together, so that a step's arrays stay in the cache.
TOGETHER = 2048
UNKNOWN = "und"
#: A text is of no language if its best one is so little above an even share, or less.
LEAST_LEAD = 0.05
LETTER = regex.compile(r"\p{L}")


@dataclass
class Direction:
    """z, r and candidate side by side in both tables. Sigmoids are taken as tanh of half the sum."""

    by_byte: np.ndarray  # 256 x 3H
    by_state: np.ndarray  # H x 3H


@dataclass
class Network:
    languages: list[str]
    forward: Direction
    backward: Direction
    out: np.ndarray  # 2H x K
    bias: np.ndarray  # K

    def parameters(self) -> list[np.ndarray]:
        return [self.forward.by_byte, self.forward.by_state, self.backward.by_byte, self.backward.by_state, self.out, self.bias]


def fresh(languages: list[str], seed: int = 1, hidden: int = HIDDEN) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    k = len(languages)
    return Network(languages, Direction(draw(256, 3 * hidden), draw(hidden, 3 * hidden)), Direction(draw(256, 3 * hidden), draw(hidden, 3 * hidden)), draw(2 * hidden, k), np.zeros(k, np.float32))


def read(d: Direction, letters: np.ndarray, valid: np.ndarray | None, keep: list | None = None) -> np.ndarray:
    """States after each byte: letters is time x windows; valid (0/1, alike) holds the state over padding."""
    steps, n = letters.shape
    size = d.by_state.shape[0]
    h = np.zeros((n, size), np.float32)
    states = np.empty((steps, n, size), np.float32)
    gates, last = d.by_state[:, : 2 * size], d.by_state[:, 2 * size :]
    for t in range(steps):
        x = d.by_byte[letters[t]]
        zr = x[:, : 2 * size] + h @ gates
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        z, r = zr[:, :size], zr[:, size:]
        rh = r * h
        c = x[:, 2 * size :] + rh @ last
        np.tanh(c, out=c)
        new = h + z * (c - h)
        if valid is not None:
            new *= valid[t][:, None]
        if keep is not None:
            keep.append((h, z, r, rh, c))
        h = states[t] = new
    return states


def unread(d: Direction, letters: np.ndarray, valid: np.ndarray, kept: list, grads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of a direction's tables from those of its states."""
    size = d.by_state.shape[0]
    by_byte, by_state = np.zeros_like(d.by_byte), np.zeros_like(d.by_state)
    gates, last = d.by_state[:, : 2 * size], d.by_state[:, 2 * size :]
    after = np.zeros_like(grads[0])
    for t in range(len(letters) - 1, -1, -1):
        h, z, r, rh, c = kept[t]
        g = (grads[t] + after) * valid[t][:, None]
        dc = g * z * (1 - c * c)
        dz = g * (c - h) * z * (1 - z)
        drh = dc @ last.T
        dr = drh * h * r * (1 - r)
        dzr = np.concatenate([dz, dr], axis=1)
        by_state[:, : 2 * size] += h.T @ dzr
        by_state[:, 2 * size :] += rh.T @ dc
        np.add.at(by_byte, letters[t], np.concatenate([dzr, dc], axis=1))
        after = g * (1 - z) + drh * r + dzr @ gates.T
    return by_byte, by_state


def position_scores(net: Network, letters: np.ndarray, valid: np.ndarray | None) -> np.ndarray:
    """time x windows x languages: each byte's distribution."""
    size = net.forward.by_state.shape[0]
    ahead = read(net.forward, letters, valid)
    back = read(net.backward, letters[::-1], None if valid is None else valid[::-1])[::-1]
    logits = ahead @ net.out[:size] + back @ net.out[size:] + net.bias
    logits -= logits.max(axis=2, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=2, keepdims=True)
    return logits


def gradients(net: Network, letters: np.ndarray, valid: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over the valid bytes, and its gradients in the order of parameters()."""
    size = net.forward.by_state.shape[0]
    kept_f: list = []
    kept_b: list = []
    ahead = read(net.forward, letters, valid, kept_f)
    back = read(net.backward, letters[::-1], valid[::-1], kept_b)[::-1]
    both = np.concatenate([ahead, back], axis=2)
    logits = both @ net.out + net.bias
    logits -= logits.max(axis=2, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=2, keepdims=True)
    many = valid.sum()
    at = np.arange(letters.shape[1])
    loss = float(-(np.log(p[:, at, label] + 1e-30) * valid).sum() / many)
    p[:, at, label] -= 1
    p *= (valid / many)[:, :, None]
    d_both = p @ net.out.T
    d_out = np.tensordot(both, p, axes=([0, 1], [0, 1]))
    f = unread(net.forward, letters, valid, kept_f, d_both[:, :, :size])
    b = unread(net.backward, letters[::-1], valid[::-1], kept_b, d_both[::-1, :, size:])
    return loss, [*f, *b, d_out, p.sum(axis=(0, 1))]


def padded(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """time x windows letters, and which of them are no padding."""
    size = max(1, max(map(len, windows)))
    letters = np.frombuffer(b"".join(w.ljust(size, b"\0") for w in windows), np.uint8).reshape(-1, size).T
    valid = np.arange(size)[:, None] < np.array(list(map(len, windows)))[None, :]
    return np.ascontiguousarray(letters), valid.astype(np.float32)


def train(samples: list[tuple[bytes, str]], seed: int = 1, steps: int = STEPS) -> Network:
    """Adam over batches of windows that hold each language alike."""
    languages = sorted({lang for _, lang in samples})
    net = fresh(languages or [UNKNOWN], seed)
    if len(languages) < 2:
        return net
    rng = np.random.default_rng(seed)
    by_language = [[w for w, lang in samples if lang == x] for x in languages]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    for step in range(1, steps + 1):
        label = rng.integers(0, len(languages), BATCH)
        letters, valid = padded([by_language[k][rng.integers(len(by_language[k]))] for k in label])
        _, grads = gradients(net, letters, valid, label)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = RATE * min(1, 2 * (1 - step / (steps + 1)))
        for p, g, (m, v) in zip(net.parameters(), grads, moments, strict=True):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def document_scores(net: Network, texts: list[bytes]) -> np.ndarray:
    """texts x languages: the mean distribution over all bytes of each text; zeros for an empty one."""
    total = np.zeros((len(texts), len(net.languages)))
    cuts = [len(t) - len(t) % WINDOW for t in texts]
    letters = np.frombuffer(b"".join(t[:c] for t, c in zip(texts, cuts, strict=True)), np.uint8).reshape(-1, WINDOW)
    owner = np.repeat(np.arange(len(texts)), np.array(cuts, int) // WINDOW)
    for i in range(0, len(letters), TOGETHER):
        p = position_scores(net, np.ascontiguousarray(letters[i : i + TOGETHER].T), None)
        np.add.at(total, owner[i : i + TOGETHER], p.sum(axis=0))
    rest = sorted(((k, t[c:]) for k, (t, c) in enumerate(zip(texts, cuts, strict=True)) if len(t) > c), key=lambda x: len(x[1]))
    for i in range(0, len(rest), TOGETHER):
        part = rest[i : i + TOGETHER]
        letters, valid = padded([w for _, w in part])
        p = position_scores(net, letters, valid) * valid[:, :, None]
        np.add.at(total, [k for k, _ in part], p.sum(axis=0))
    return total / np.maximum(1, np.array([len(t) for t in texts]))[:, None]


def sample(docs: DataFrame, id_col: str, text_col: str, label_col: str, folds: int, held_out_fold: int) -> list[tuple[bytes, str]]:
    """Windows of about SAMPLE_DOCUMENTS training documents of each language, spread over their whole texts.

    A language's documents are drawn by a hash of id and text against its count, so the sample is
    SAMPLE_DOCUMENTS x SAMPLE_WINDOWS x WINDOW bytes a language at any input size.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("label"))
    usable = own.filter((fold_of(F.col("id"), folds) != held_out_fold) & F.col("label").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = cut(usable.groupBy("label").agg(F.count(F.lit(1)).alias("n")))  # a row for each language
    drawn = F.pmod(F.xxhash64("id", "text", F.lit(9)), F.lit(1 << 30)).cast("double") * F.col("n") < float(SAMPLE_DOCUMENTS << 30)
    chosen = usable.join(small(counts), "label").filter(drawn).select("id", "text", "label")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, label in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                t = text.encode()
                starts = np.linspace(0, max(0, len(t) - WINDOW), SAMPLE_WINDOWS).astype(int)
                rows += [(t[s : s + WINDOW], label) for s in dict.fromkeys(starts.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], names=["window", "label"])

    found = chosen.mapInArrow(windows, "window binary, label string").collect()
    return sorted((bytes(r.window), r.label) for r in found)


def fold_of(id_column, folds: int):
    return F.pmod(F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def labelled(net: Network, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """The language and its pooled probability of each text; UNKNOWN and 0 where it is null or has no letter."""
    known = [t if t is not None and LETTER.search(t) else "" for t in texts]
    p = document_scores(net, [t.encode() for t in known])
    best = p.argmax(axis=1)
    lang = [net.languages[k] if t else UNKNOWN for k, t in zip(best, known, strict=True)]
    return lang, [min(1.0, float(row[k])) if t else 0.0 for row, k, t in zip(p, best, known, strict=True)]


def predict(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score for each row of docs, whatever repeats. No shuffle.

    A null text and one without a letter is UNKNOWN with score 0. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(i, 400) for i in range(0, b.num_rows, 400)):
                lang, score = labelled(net, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["id", "lang_pred", "score"])

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, f"id {dict(own.dtypes)['id']}, lang_pred string, score double").withColumnRenamed("id", id_col)


def accepted(net: Network, texts: list[str | None]) -> list[bool]:
    """Which texts are of some language: they have a letter, and the network prefers one language by LEAST_LEAD."""
    _, score = labelled(net, texts)
    least = 1 / len(net.languages) + LEAST_LEAD if len(net.languages) > 1 else 0.0
    return [bool(t and LETTER.search(t)) and s >= least for t, s in zip(texts, score, strict=True)]


def identified(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """docs, all columns as they are, without the rows that the network gives no language. No shuffle.

    Rejected are null texts, texts without a letter, and texts whose pooled score is not LEAST_LEAD above an
    even share of all languages. A network of one language, or of none, rejects no text that has a letter.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(i, 400) for i in range(0, b.num_rows, 400)):
                yield part.filter(pa.array(accepted(net, part.column(at).to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", folds: int = 5, held_out_fold: int = 0) -> DataFrame:
    """id, held_out, lang_pred, score of whole texts, by a network trained on the labelled rows of docs.

    The held-out fold of ids teaches nothing. Without labelled rows every prediction is UNKNOWN, with one
    language it is that. Rows that repeat an id are predicted each.
    """
    net = train(sample(docs, id_col, text_col, label_col, folds, held_out_fold))
    found = predict(docs, net, id_col, text_col)
    return found.select(id_col, (fold_of(F.col(id_col), folds) == held_out_fold).alias("held_out"), "lang_pred", "score")
