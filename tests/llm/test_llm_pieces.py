import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece.sentencepiece_model_pb2 import ModelProto

from tablewarden.llm import sentence_pieces as sp
from tablewarden.llm.common import file_bytes

MODEL = file_bytes(public_tokenizers.path("piece_bpe_32k.model"))
_DRAW = random.Random(3)
_PARTS = ["a", "b", " ", "  ", "▁", "é", "漢", "\n", "\t", "😀", "\0", "ﬁ", "①", "\u00a0", "\u200b", " the", "ing", "\u0301", "Ａ", "<s>"]
TEXTS = ["", " ", "  a", " ▁", "▁▁a ", "a", "ab " * 50_000] + ["".join(_DRAW.choices(_PARTS, k=_DRAW.randint(0, 14))) for _ in range(600)]


def test_like_the_library():
    mine, library = sp.OffsetEncoder(MODEL), sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    for text in TEXTS:
        got, want = mine.encode(text), library.encode(text)
        assert got.ids.tolist() == want
        assert mine.decode(want) == library.decode(want)
        # Spans part the source without gaps; together they are the source.
        source = text.encode()
        assert b"".join(source[b:e] for b, e in zip(got.begin, got.end)) == source
        assert (got.begin[1:] == got.end[:-1]).all()


def test_decoding_any_ids_like_the_library():
    mine, library = sp.OffsetEncoder(MODEL), sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    for _ in range(300):
        ids = [_DRAW.randrange(32_000) if _DRAW.random() < 0.5 else _DRAW.randrange(3, 259) for _ in range(_DRAW.randint(0, 6))]
        if 0 not in ids:
            assert mine.decode(ids) == library.decode(ids), ids


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nfkc_cf", "identity"])
@pytest.mark.parametrize("squeeze", [True, False])
def test_compiled_maps_like_the_library(rule, squeeze):
    library = sentencepiece.SentencePieceNormalizer(
        rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=squeeze
    )
    spec = ModelProto.FromString(library.serialized_model_proto()).normalizer_spec
    mine = sp.Normaliser(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces, False)
    for text in TEXTS[:6] + TEXTS[7:]:
        got = mine(text)
        assert got.text.decode() == library.normalize(text), text
        assert len(got.origin) == len(got.text) + 1 and (np.diff(got.origin) >= 0).all()


def test_origin_points_at_the_source():
    library = sentencepiece.SentencePieceNormalizer(rule_name="nfkc", add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=False)
    mine = sp.Normaliser(ModelProto.FromString(library.serialized_model_proto()).normalizer_spec.precompiled_charsmap, False, False, False, False)
    got = mine("xﬁ①b")
    assert got.text == b"xfi1b" and got.origin.tolist() == [0, 1, 1, 4, 7, 8]


def test_in_spark_with_nulls_repeats_and_clashes(spark):
    library = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    rows = [(1, "a b", 1), (1, "a b", 1), (None, "x", 2), (2, None, 3), (3, "", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pieces int")
    for row in sp.with_digests(docs, MODEL).collect():
        ids = library.encode(row.text or "")
        want = (len(ids), ",".join(map(str, ids)), library.decode(ids))
        assert (row.pieces_.n_tokens, row.pieces_.ids_sha256) == (want[0], hashlib.sha256(want[1].encode()).hexdigest())
        assert row.pieces_.decoded_sha256 == hashlib.sha256(want[2].encode()).hexdigest()
    encoded = docs.select("text", sp.encoded(F.col("text"), MODEL).alias("e")).select("text", "e.*", sp.decoded(F.col("e.ids"), MODEL).alias("back"))
    assert all(r.back == (r.text or "") and len(r.ids) == len(r.begin) == len(r.end) for r in encoded.collect())
    assert sp.with_digests(docs.limit(0), MODEL).count() == 0
