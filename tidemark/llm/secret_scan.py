"""Secret scanning over a trigram inverted index.

Each rule is a regular expression with a Boolean trigram query derived from its parse tree. A batch of
documents gets an inverted index of the trigrams that any query names, from case-folded UTF-8; a rule
verifies only documents in its intersected postings. Rules whose query is empty scan every document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from re import _parser as sre

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BYTE_LOWER

#: Alternatives of exact strings are followed up to so many; beyond it a part counts as unknown.
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    flags: int = 0
    #: Group whose length counts, and its least length.
    group: int = 0
    least: int = 0
    compiled: re.Pattern = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "compiled", re.compile(self.pattern, self.flags | re.ASCII))

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in self.compiled.finditer(text) if m.end(self.group) - m.start(self.group) >= self.least]


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE, 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 0, 16),
)
#: Well-known public token formats.
MORE_RULES = (
    Rule("repo_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("pay_key", r"[sr]k_(?:live|test)_[0-9A-Za-z]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES

#: A query is True (no demand), a trigram, ("and", queries) or ("or", queries).
Query = bool | bytes | tuple


def _and(parts: list) -> Query:
    parts = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _or(parts: list) -> Query:
    parts = list(dict.fromkeys(parts))
    return True if True in parts or not parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_string(s: str) -> Query:
    b = s.encode().translate(BYTE_LOWER)
    return _and([b[i : i + 3] for i in range(len(b) - 2)])


def _walk(items) -> tuple[set[str] | None, Query]:
    """The exact strings that a sequence matches, if few, and the demand of what is not among them."""
    strings, demand = {""}, []
    for op, arg in items:
        name = str(op)
        own, more = None, True
        if name == "LITERAL":
            own = {chr(arg)}
        elif name == "IN" and all(str(o) in ("LITERAL", "RANGE") for o, _ in arg):
            listed = [c for o, a in arg for c in ([a] if str(o) == "LITERAL" else range(a[0], a[1] + 1))]
            own = {chr(c) for c in listed} if len(listed) <= 8 else None
        elif name == "SUBPATTERN":
            own, more = _walk(arg[-1])
        elif name == "BRANCH":
            each = [_walk(x) for x in arg[1]]
            if all(s is not None for s, _ in each):
                own = set().union(*(s for s, _ in each))
            else:
                more = _or([q if s is None else _or([_of_string(x) for x in sorted(s)]) for s, q in each])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, body = arg
            inner, q = _walk(body)
            if inner is not None and (low, high) == (0, 1):
                own = inner | {""}
            elif low >= 1:
                more = q if inner is None else _or([_of_string(x) for x in sorted(inner)])
        elif name == "AT":
            continue
        if own is not None and len(own) * len(strings) <= MOST_STRINGS:
            strings = {a + b for a in strings for b in own}
        else:
            demand += [_or([_of_string(s) for s in sorted(strings)]), more if own is None else _or([_of_string(x) for x in sorted(own)])]
            strings = {""}
    if not demand:
        return strings, True
    return None, _and([*demand, _or([_of_string(s) for s in sorted(strings)])])


def trigram_query(pattern: str, flags: int = 0) -> Query:
    """What any matching text holds, as trigrams of its case-folded UTF-8."""
    strings, demand = _walk(sre.parse(pattern, flags | re.ASCII))
    return demand if strings is None else _or([_of_string(s) for s in sorted(strings)])


def trigrams_of(query: Query) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(trigrams_of, query[1]))


class TrigramIndex:
    """Postings of the wanted trigrams in one batch of documents."""

    def __init__(self, texts: list[bytes], wanted: list[bytes]):
        self.n = len(texts)
        number = {t: i for i, t in enumerate(wanted)}
        code = np.zeros(1 << 24, np.uint16 if len(wanted) < 1 << 16 else np.int32)
        for t, i in number.items():
            code[int.from_bytes(t, "big")] = i + 1
        self.postings = {t: np.zeros(0, np.int64) for t in wanted}
        # a zero byte, which no trigram holds, parts the documents
        ends = np.cumsum([len(t) + 1 for t in texts])
        for lo, hi in self._chunks(ends):
            self._add(b"\0".join(t.translate(BYTE_LOWER) for t in texts[lo:hi]), lo, ends[lo:hi] - (ends[lo - 1] if lo else 0), code, number)

    @staticmethod
    def _chunks(ends: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
        lo = 0
        while lo < len(ends):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, "right")))
            yield lo, hi
            lo = hi

    def _add(self, joined: bytes, first: int, ends: np.ndarray, code: np.ndarray, number: dict[bytes, int]) -> None:
        b = np.frombuffer(joined, np.uint8)
        if len(b) < 3:
            return
        grams = (b[:-2].astype(np.uint32) << 16) | (b[1:-1].astype(np.uint32) << 8) | b[2:]
        found = code[grams]
        at = np.flatnonzero(found)
        which, doc = found[at], np.searchsorted(ends, at, "right") + first
        for t, i in number.items():
            if len(own := np.unique(doc[which == i + 1])):
                self.postings[t] = np.concatenate([self.postings[t], own])

    def candidates(self, query: Query) -> np.ndarray:
        if query is True:
            return np.arange(self.n)
        if isinstance(query, bytes):
            return self.postings[query]
        each = [self.candidates(q) for q in query[1]]
        if query[0] == "or":
            return np.unique(np.concatenate(each))
        each.sort(key=len)
        out = each[0]
        for more in each[1:]:
            out = np.intersect1d(out, more, assume_unique=True)
        return out


def find_spans(texts: list[str], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, int]]]:
    """For each text its (start, end, number of the rule), by start, then rule."""
    queries = [trigram_query(r.pattern, r.flags) for r in rules]
    index = TrigramIndex([t.encode() for t in texts], sorted(set().union(*map(trigrams_of, queries))))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        for i in index.candidates(query):
            out[i] += [(s, e, k) for s, e in rule.spans(texts[i])]
    for spans in out:
        spans.sort(key=lambda x: (x[0], x[2], x[1]))
    return out


def _texts(column: pa.ChunkedArray | pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


SPAN_SCHEMA = "spans array<struct<kind:string,start:int,end:int>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """id, spans: kind, start and end (code points, end exclusive) of each secret of a whole text.

    One row for each row of docs, in any order; a null or empty text has no spans. No shuffle.
    """
    kinds = [r.kind for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            for part in (b.slice(i, 500) for i in range(0, b.num_rows, 500)):
                found = [[{"kind": kinds[k], "start": s, "end": e} for s, e, k in x] for x in find_spans(_texts(part.column(1)), rules)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, kind)], names=["id", "spans"])

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, f"id {dict(own.dtypes)['id']}, {SPAN_SCHEMA}").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with each secret (overlapping ones as one) replaced by mark; other columns and rows stay."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(i, 500) for i in range(0, b.num_rows, 500)):
                texts = part.column(at).to_pylist()
                for i, spans in enumerate(find_spans([t or "" for t in texts], rules)):
                    if spans:
                        out, done = [], 0
                        for s, e, _ in spans:
                            if s >= done:
                                out += [texts[i][done:s], mark]
                            done = max(done, e)
                        texts[i] = "".join([*out, texts[i][done:]])
                columns = [*part.columns]
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return docs.mapInArrow(run, docs.schema)


def secret_report(docs: DataFrame) -> DataFrame:
    """The contract's columns, from scan()."""
    kinds = [r.kind for r in BASE_RULES]
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")
    base = F.filter("spans", lambda x: x.kind.isin(kinds))
    count_of = lambda k: F.size(F.filter("spans", lambda x: x.kind == k)).cast("long").alias(f"n_{k}")
    return scan(docs).select(
        "doc_id",
        *(count_of(k) for k in kinds),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )

