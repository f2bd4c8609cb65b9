"""Recorded page chains as a data source: `spark.read.format("recorded_pages").load(root)`.

A provider's answer of several pages is a folder `request=<name>` with one JSON file a page. The first is
`first.json`; a page names the next one by next_page_token, whose file is the token's SHA-256. A chain is read by one
partition, page after page, and whole or not at all: a page that is missing, unreadable or named twice fails the
read. The option `requests` (names parted by commas; a name may end in *) keeps other chains from being read at
all. Filters aren't pushed down: this Spark keeps what one plan has pushed into a Python source for all plans
over the same DataFrame, which loses rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "request string, page int, token string, payload string"
FIRST = "first.json"
#: Pages that a chain may have; a longer one is taken to go round in circles. Fixed value.
MOST_PAGES = 400


class BrokenChainError(ValueError):
    """A chain of pages that can't be read whole."""


def page_file(token: str | None) -> str:
    return FIRST if token is None else f"{hashlib.sha256(token.encode()).hexdigest()}.json"


def walk(fs: pafs.FileSystem, folder: str, request: str, most_pages: int = MOST_PAGES) -> list[tuple[str, int, str | None, str]]:
    """All pages of a chain in order, or an error."""
    pages: list[tuple[str, int, str | None, str]] = []
    token, seen = None, set()
    while True:
        if len(pages) == most_pages:
            raise BrokenChainError(f"{request}: more than {most_pages} pages")
        try:
            with fs.open_input_stream(f"{folder}/{page_file(token)}") as f:
                payload = f.read().decode()
            following = json.loads(payload).get("next_page_token")
        except FileNotFoundError as missing:
            raise BrokenChainError(f"{request}: page {len(pages)} is missing") from missing
        except (ValueError, AttributeError) as bad:
            raise BrokenChainError(f"{request}: page {len(pages)} is no page: {bad}") from bad
        pages.append((request, len(pages), token, payload))
        if not following:
            return pages
        if following in seen:
            raise BrokenChainError(f"{request}: page {len(pages) - 1} names an earlier one")
        seen.add(following)
        token = following


@dataclass
class Chain(InputPartition):
    folder: str
    request: str


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("most_pages", MOST_PAGES))
        self.wanted = [n.strip() for n in options.get("requests", "*").split(",")]

    def _asked(self, request: str) -> bool:
        return any(request.startswith(n[:-1]) if n.endswith("*") else request == n for n in self.wanted)

    def partitions(self) -> list[Chain]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        folders = [i for i in fs.get_file_info(pafs.FileSelector(root)) if i.type == pafs.FileType.Directory and i.base_name.startswith("request=")]
        chains = [Chain(i.path, i.base_name.removeprefix("request=")) for i in folders]
        return sorted((c for c in chains if self._asked(c.request)), key=lambda c: c.request)

    def read(self, chain: Chain | None) -> Iterator[pa.RecordBatch]:
        if chain is None:  # no chain is asked for
            return
        fs, _ = pafs.FileSystem.from_uri(self.path)
        columns = zip(*walk(fs, chain.folder, chain.request, self.most), strict=True)
        kinds = (pa.string(), pa.int32(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])


class RecordedPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recorded_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordedPages)


def record(root: str, request: str, pages: list[tuple[str | None, str]]) -> None:
    """Write a chain (token, payload) as it was answered; the first page's token is null."""
    fs, base = pafs.FileSystem.from_uri(root)
    folder = f"{base}/request={request}"
    fs.create_dir(folder, recursive=True)
    for token, payload in pages:
        with fs.open_output_stream(f"{folder}/{page_file(token)}") as f:
            f.write(payload.encode())
