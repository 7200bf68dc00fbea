"""The registered queries that SQL cannot express, over their whole tables against libraries and plain counts."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def fold(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


def test_every_operator_has_its_query():
    names = entry.queries()
    assert all(any(name.startswith(f"op{n}_") for name in names) for n in range(1, 14)) and "pipeline" in names


def test_sentence_pieces(spark, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in entry.queries()["op6_sentence_pieces"](spark, SF).collect()}
    for key, text in texts.items():
        ids = library.encode(text or "")
        digests = [hashlib.sha256(t.encode()).hexdigest() for t in (",".join(map(str, ids)), library.decode(ids))]
        assert got.pop(key) == (len(ids), *digests)
    assert not got


def test_lm_scoring_base(spark, texts):
    tokens = {k: [*(t or "").encode().lower().split(), None] for k, t in texts.items()}
    counts = Counter(w for k, own in tokens.items() if fold(k, 7) != 2 for w in own)
    n, v = counts.total(), len(counts)
    got = {r.doc_id: r for r in entry.queries()["op8_lm_scoring"](spark, SF).collect()}
    assert got.keys() == texts.keys()
    for key, own in tokens.items():
        r = got[key]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(key, 7) == 2, len(own), sum(counts[w] > 0 for w in own), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0
    held = [k for k in texts if fold(k, 7) == 2]
    assert sum(got[k].score for k in held) > sum(got[k].base_score for k in held)


def test_best_fit_packing(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for key, text in texts.items():
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        first = len(ids) % 1024 or min(len(ids), 1024)
        for piece, start in enumerate([0, *range(first, len(ids), 1024)]):
            own = ids[start : first if piece == 0 else start + 1024]
            want[key, piece] = (start, len(own), zlib.crc32(own.tobytes()))
    rows = entry.queries()["op9_best_fit_packing"](spark, SF).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        ends = np.cumsum([0] + [n for _, n in sorted(own)])
        assert [at for at, _ in sorted(own)] == ends[:-1].tolist() and ends[-1] <= 1024
    assert len(sequences) <= 1.05 * -(-sum(n for _, n, _ in want.values()) // 1024) + 1
