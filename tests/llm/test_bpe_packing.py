"""Encoding against the public libraries; packing against its contract."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from tidemark.llm import byte_bpe, packing
from tidemark.llm.chunks import ChunkMemo

RANKS = byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
ODD = ["", " ", "  a", "a  b\n\n c", "it's\n'll", "\n", "x\ny", "\t tab nbsp　wide", "a" * 5000, "ab" * 3000, " " * 300, "日本語テキスト", "é" * 99, "9" * 50, "\x1c\x1d a", "é​", "🙂🙂 🙂", "a\n b", " lead", "trail ", "-- ---- $$ %%", "don't  DON'T"]


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(texts)], "doc_id long, text string, ids string, batch int")


@pytest.fixture(scope="module")
def corpus(spark):
    return [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]


def test_encode_matches_tiktoken(corpus):
    bpe = byte_bpe.ByteBPE(RANKS, P.PATTERN)
    real = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    memo = ChunkMemo(bpe.encode, most=50)
    for text in ODD + corpus:
        want = real.encode_ordinary(text)
        assert bpe.encode(text) == want
        assert [i for c in memo.values(text) for i in c] == want
        assert bpe.decode(want) == text.encode()


def test_every_white_character_splits_as_in_the_library():
    real = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    memo = ChunkMemo(byte_bpe.ByteBPE(RANKS, P.PATTERN).encode)
    for c in [*range(1, 0x300), *range(0x1680, 0x1690), *range(0x2000, 0x2070), 0x3000, 0xFEFF]:
        for text in (f"ab{chr(c)}cd", f"ab {chr(c)} cd{chr(c)}", f"{chr(c)}{chr(c)}x"):
            assert [i for k in memo.values(text) for i in k] == real.encode_ordinary(text), hex(c)


def test_backtracking_equals_merging():
    bpe = byte_bpe.ByteBPE(RANKS, P.PATTERN)
    rng = random.Random(3)
    for _ in range(3000):
        piece = bytes(rng.choice(b"aeinorst th") for _ in range(rng.randint(1, 24)))
        assert bpe.encode_piece(piece) == (bpe.merge(piece) if piece not in RANKS else [RANKS[piece]])


def test_round_trip(spark):
    real = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    path = P.path("byte_bpe_multi_50k.tiktoken")
    got = {r.doc_id: r for r in byte_bpe.round_trip(rows(spark, [*ODD, None]), path, P.PATTERN).collect()}
    for i, text in enumerate([*ODD, ""]):
        ids = real.encode_ordinary(text)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    encoded = byte_bpe.encode_texts(rows(spark, ODD), path, P.PATTERN)
    assert [bytes(r.decoded).decode() for r in byte_bpe.decode_ids(encoded, path, P.PATTERN).orderBy("doc_id").collect()] == ODD
    assert byte_bpe.round_trip(rows(spark, []), path, P.PATTERN).count() == 0


def check_packing(pieces, texts):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == set(range(len(texts)))
    for i, text in enumerate(texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids)) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    wasted = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
        wasted += 0 if at & (at - 1) == 0 else 2048 - at
    return wasted, sum(p.length for p in pieces)


def test_packing(spark, corpus):
    texts = [*ODD, None, "<|endoftext|> a<|endoftext|>", *corpus]
    pieces = packing.pack_documents(rows(spark, texts), P.path("byte_bpe_50k.json"), P.PATTERN).collect()
    check_packing(pieces, texts)
    assert packing.pack_documents(rows(spark, []), P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0


def test_group_packing_wastes_little():
    rng = random.Random(5)
    lengths = [int(rng.lognormvariate(6.5, 1)) + 1 for _ in range(3000)]
    bins = packing.pack_group(lengths)
    assert sum(n for b in bins for *_, n in b) == sum(lengths)
    assert len(bins) * 2048 - sum(lengths) < 3 * 2048
    tree = packing.FirstFitTree(3, 10)
    tree.take(0, 8)
    assert (tree.first(2), tree.first(3)) == (0, 1)
