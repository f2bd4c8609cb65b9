"""Fill-in-the-middle: a text is cut at two token edges, and its parts change places around marks.

Texts stay UTF-8 bytes. A text's exception index records its multibyte characters only: where each starts and
how many bytes it has beyond one. Code points and bytes are turned into each other by a binary search in that
index and an addition; a text of ASCII has an empty index, and places are the same in both. Tokens are runs
of letters A-Z and any other single code point.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of 100 documents so many keep their plain form, and of 100 others so many have the suffix first.
PLAIN_FROM, SUFFIX_FIRST = 90, 20
#: Bytes of output that leave a task together, at least one text.
OUT_BYTES = 8 << 20

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


@dataclass(frozen=True)
class ExceptionIndex:
    """Multibyte characters of a UTF-8 text: first byte of each, and bytes beyond one of it and all before it."""

    starts: np.ndarray
    excess: np.ndarray

    @classmethod
    def of(cls, b: np.ndarray) -> ExceptionIndex:
        """The index of the bytes of a text. A byte that continues no character counts to the one before it."""
        if not len(b) or b.max() < 0x80:
            return cls(np.zeros(0, np.int64), np.zeros(0, np.int64))
        more = np.flatnonzero((b & 0xC0) == 0x80)
        lead = np.flatnonzero(np.diff(more, prepend=-2) > 1)  # where a run of continuing bytes starts
        starts = np.maximum(more[lead] - 1, 0)
        return cls(starts, np.append(lead[1:], len(more)))

    def _before(self, n: np.ndarray) -> np.ndarray:
        """Excess bytes of the first n exceptions."""
        return np.append(0, self.excess)[n]

    def chars(self, at: np.ndarray) -> np.ndarray:
        """Code points before the byte places at, each the first byte of a character or the end."""
        at = np.asarray(at)
        return at - self._before(np.searchsorted(self.starts, at))

    def bytes(self, at: np.ndarray) -> np.ndarray:
        """First bytes of the code points at."""
        at = np.asarray(at)
        return at + self._before(np.searchsorted(self.chars(self.starts), at))


def token_starts(b: np.ndarray) -> np.ndarray:
    """First bytes of the tokens."""
    letter = _LETTER[b]
    first = ~letter & ((b & 0xC0) != 0x80)
    first[1:] |= letter[1:] & ~letter[:-1]
    first[:1] = True
    return np.flatnonzero(first)


def draws(seed: str, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of a document; a null id counts as an empty one."""
    made = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(made[4 * k : 4 * k + 4]) for k in range(4))


def rearranged(text: bytes, h: tuple[int, int, int, int], unit: str = "token") -> tuple[int, str, int | None, int | None, bytes]:
    """Units of the text, form, code points of prefix and middle (null for plain), output."""
    b = np.frombuffer(text, np.uint8)
    index = ExceptionIndex.of(b)
    starts = token_starts(b) if unit == "token" else None
    n = int(index.chars(len(b))) if starts is None else len(starts)
    if not text or h[2] % 100 >= PLAIN_FROM or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    units = np.sort([h[0] % (n + 1), h[1] % (n + 1)])
    if starts is None:
        chars, (one, two) = units, index.bytes(units)
    else:
        one, two = (int(starts[u]) if u < n else len(b) for u in units)
        chars = index.chars(np.array([one, two]))
    prefix, middle, suffix = text[:one], text[one:two], text[two:]
    if h[3] % 100 < SUFFIX_FIRST:
        form, output = "spm", SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    else:
        form, output = "psm", PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle
    return n, form, int(chars[0]), int(chars[1] - chars[0]), output


ROWS = "id long, n long, form string, prefix_chars long, middle_chars long, output string"
_SCHEMA = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    *plain, outputs = zip(*rows, strict=True)
    columns = [pa.array(c, t) for c, t in zip(plain, _SCHEMA.types, strict=False)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(outputs, pa.binary()).view(pa.string())], schema=_SCHEMA)


def fill_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", unit: str = "token") -> DataFrame:
    """id, n (units), form (plain, psm, spm), prefix_chars, middle_chars, output: a row for each row of docs.

    Texts are cut at edges of units: tokens, or code points for unit "char".

    Cuts and form follow from seed and id alone, so that rows which repeat an id are cut by the same numbers,
    each in its own text. A null text is empty, and an empty one or one that holds a mark stays plain. An
    empty table gives no rows; other columns are ignored. No shuffle: rows leave the task that reads them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                i = doc_id.as_py()
                buffer = text.as_buffer() if text.is_valid else None
                held.append((i, *rearranged(buffer.to_pybytes() if buffer else b"", draws(seed, i), unit)))
                size += len(held[-1][-1])
                if size >= OUT_BYTES:
                    yield _batch(held)
                    held, size = [], 0
            if held:
                yield _batch(held)

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, ROWS).withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that fill_middle made output of."""
    part = F.split(output, "<[PSM]>", 4)
    get = lambda k: F.get(part, F.lit(k))
    return F.when(form == "psm", F.concat(get(1), get(3), get(2))).when(form == "spm", F.concat(get(2), get(3), get(1))).otherwise(output)
