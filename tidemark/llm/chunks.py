"""Texts cut where no token of a byte-level BPE vocabulary can cross, and memos of what the cuts encode to.

The published splitting pattern never lets a match run on from a non-space character to white space, so a
text may be cut before every run of white space that follows a word. The cut parts repeat often.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

#: Characters with the Unicode property White_Space. Fixed values.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
IRREGULAR = re.compile(f"[{WHITE}][{WHITE}]|^[{WHITE}]|[{WHITE}]$")
CHUNK = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")


class ChunkMemo:
    """encode(chunk) remembered for the latest chunks, in two generations of at most `most` each."""

    def __init__(self, encode: Callable[[str], object], most: int = 150_000):
        self.encode, self.most = encode, most
        self.spaced, self.bare = _Memo(self, " "), _Memo(self, "")

    def values(self, text: str) -> Iterable[object]:
        """What the chunks of text encode to, in order."""
        if not text:
            return []
        if IRREGULAR.search(text):
            return map(self.bare.__getitem__, CHUNK.findall(text))
        # no two white characters meet: a part without its own line feed followed a space
        first, *rest = text.replace("\n", " \n").split(" ")
        return [self.bare[first], *map(self.spaced.__getitem__, rest)]


class _Memo(dict):
    def __init__(self, owner: ChunkMemo, prefix: str):
        super().__init__()
        self.owner, self.prefix, self.old = owner, prefix, {}

    def __missing__(self, part: str) -> object:
        found = self.old.get(part)
        if found is None:
            found = self.owner.encode(part if part[0] == "\n" else self.prefix + part)
        if len(part) < 64:
            if len(self) >= self.owner.most:
                self.old = dict(self)
                self.clear()
            self[part] = found
        return found
