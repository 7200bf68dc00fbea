import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tablewarden.llm import packing
from tablewarden.llm.common import file_bytes

JSON = file_bytes(public_tokenizers.path("byte_bpe_50k.json")).decode()
LIBRARY = Tokenizer.from_str(JSON)
TEXTS = ["", None, "a", "it's  we'll \n x", "<|endoftext|> b<|endoftext|>", "é漢😀\0", "ab" * 3000, " " * 5000, "the cat " * 4000, "   x"]


def test_ids_like_the_tokenizer():
    encoder = packing.Encoder(JSON)
    for text in TEXTS:
        assert encoder.encode(text or "").tolist() == LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_cutting():
    assert packing.cut(1, 4) == [(0, 1)] and packing.cut(4, 4) == [(0, 4)] and packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


@pytest.mark.parametrize("select", ["norm", "dot"])
@pytest.mark.parametrize("limits", [{}, {"max_documents": 3}, {"max_cost": 150_000}])
def test_plan_keeps_every_capacity(select, limits):
    draw = np.random.default_rng(4)
    counts = defaultdict(int)
    for n in draw.integers(1, 380, 3000):
        counts[int(n)] += 1
    placed = packing.plan(counts, 1024, select=select, **limits)
    bins, seen = defaultdict(list), defaultdict(list)
    ends = {}
    for i, a in enumerate(placed):
        later = [b.number for b in placed if b.length == a.length and b.number > a.number]
        ends[i] = min(later, default=counts[a.length])
    for i, a in enumerate(placed):
        for n in range(a.number, ends[i]):
            seen[a.length].append(n)
            inside = n - a.number
            bins[a.first + inside // a.each].append((a.offset + inside % a.each * a.length, a.length))
    assert all(sorted(seen[k]) == list(range(c)) for k, c in counts.items())
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024 and len(pieces) <= limits.get("max_documents", 1024)
        assert sum(length**2 for _, length in pieces) <= limits.get("max_cost", 1024**2)
    if not limits and select == "norm":
        assert len(bins) <= sum(k * c for k, c in counts.items()) / 1024 * 1.01 + 1


def test_in_spark(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_BUCKET", 3)
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "a", "y"), (2, "a", "z"), (2, "a", "z")] + [(50 + i, "same words", "q") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = packing.pack(packing.tokenised_pieces(docs, JSON)).collect()
    want = []
    for key, text, _ in rows:
        ids = np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want += [(key, n, s, size, zlib.crc32(ids[s : s + size].tobytes())) for n, (s, size) in enumerate(packing.cut(len(ids), 1024))]
    assert sorted([tuple(r)[:5] for r in got], key=str) == sorted(want, key=str)
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for pieces in by_sequence.values():
        edges = [0, *np.cumsum([n for _, n in sorted(pieces)]).tolist()]
        assert [o for o, _ in sorted(pieces)] == edges[:-1] and edges[-1] <= 1024
    assert len(by_sequence) == -(-sum(r.length for r in got) // 1024)
    assert packing.pack(packing.tokenised_pieces(docs.limit(0), JSON)).count() == 0
