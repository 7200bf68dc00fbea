"""SentencePiece encoding that keeps the place of every piece in the source, and decoding.

The normaliser walks the text by the longest prefix that the model's compiled character map knows and
notes for every byte it writes which source byte it comes from. The library merges the normalised text
into pieces (its own normaliser is set to change nothing), and every piece is projected to source bytes
through the notes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.common import free_name

# Fixed values of the file format: the mark that stands for a space, and the kinds of pieces.
MARK = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


class CharacterMap:
    """A compiled character map: a double-array trie over UTF-8 prefixes, each with its replacement."""

    def __init__(self, compiled: bytes):
        self.units: list[int] = []
        self.replacements = b""
        if compiled:
            size = int.from_bytes(compiled[:4], "little")
            self.units = np.frombuffer(compiled[4 : 4 + size], "<u4").tolist()
            self.replacements = compiled[4 + size :]

    @staticmethod
    def _children(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """How many bytes from `at` on the longest known prefix has, and what replaces it."""
        if not self.units:
            return None
        found = None
        node = self._children(self.units[0])
        for place in range(at, len(data)):
            node ^= data[place]
            unit = self.units[node]
            if unit & 0x800000FF != data[place]:
                break
            node ^= self._children(unit)
            if unit & 0x100:
                found = (place + 1 - at, self.units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        size, start = found
        return size, self.replacements[start : self.replacements.index(b"\0", start)]


@dataclass
class Normalised:
    text: bytes
    origin: np.ndarray  # for each byte of text, and for its end, the source byte it stands for


class Normaliser:
    def __init__(self, compiled: bytes, dummy_prefix: bool, squeeze: bool, escape: bool, suffix: bool):
        self.map = CharacterMap(compiled)
        self.dummy_prefix, self.squeeze, self.escape, self.suffix = dummy_prefix, squeeze, escape, suffix
        self.mark = MARK.encode() if escape else b" "

    def __call__(self, source: str) -> Normalised:
        data = source.encode("utf-8")
        if not data:
            return Normalised(b"", np.zeros(1, np.int64))
        return self._walk(data) if self.map.units or self.squeeze else self._plain(data)

    def _plain(self, data: bytes) -> Normalised:
        """Without a map only spaces change: the notes are one repetition of the byte numbers."""
        wide = np.where(np.frombuffer(data, np.uint8) == 32, len(self.mark), 1)
        origin = np.repeat(np.arange(len(data), dtype=np.int64), wide)
        text = data.replace(b" ", self.mark)
        if self.dummy_prefix and not self.suffix:
            text, origin = self.mark + text, np.concatenate((np.zeros(len(self.mark), np.int64), origin))
        elif self.dummy_prefix:
            text, origin = text + self.mark, np.concatenate((origin, np.full(len(self.mark), len(data))))
        return Normalised(text, np.append(origin, len(data)))

    def _steps(self, data: bytes) -> Iterator[tuple[int, int, bytes]]:
        """(start, end, replacement) of the source from left to right; what the map does not know stays."""
        at = 0
        while at < len(data):
            known = self.map.longest(data, at)
            if known is None:
                first = data[at]
                size = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                known = size, data[at : at + size]
            yield at, at + known[0], known[1]
            at += known[0]

    def _walk(self, data: bytes) -> Normalised:
        units = list(self._steps(data))
        end = len(data)
        if self.squeeze:
            blank = [not piece.strip(b" ") for _, _, piece in units]
            lead = next((i for i, b in enumerate(blank) if not b), len(units))
            units = units[lead:]
            if not units:
                return Normalised(b"", np.full(1, end, np.int64))
        out, origin = [], []

        def write(piece: bytes, place: int) -> None:
            out.append(piece)
            origin.extend([place] * len(piece))

        if self.dummy_prefix and not self.suffix:
            write(self.mark, units[0][0])
        after_space = self.squeeze
        for start, _, piece in units:
            if self.squeeze and after_space:
                piece = piece.lstrip(b" ")
            if piece:
                write(piece.replace(b" ", self.mark), start)
                after_space = piece.endswith(b" ")
        text = b"".join(out)
        if self.squeeze:
            while text.endswith(self.mark) and self.mark:
                text = text[: -len(self.mark)]
                end = origin[len(text)]
                del origin[len(text) :]
        if self.dummy_prefix and self.suffix:
            text += self.mark
            origin.extend([end] * len(self.mark))
        return Normalised(text, np.array([*origin, end], np.int64))


@dataclass
class Encoded:
    ids: np.ndarray
    begin: np.ndarray  # source bytes
    end: np.ndarray


class OffsetEncoder:
    """Encoder and decoder of one model, given as the bytes of its file."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece.sentencepiece_model_pb2 import ModelProto

        proto = ModelProto.FromString(model)
        if any(p.type == _USER for p in proto.pieces):
            raise ValueError("models with user-defined symbols are not supported")
        spec, trainer = proto.normalizer_spec, proto.trainer_spec
        self.normaliser = Normaliser(
            spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces,
            trainer.treat_whitespace_as_suffix,
        )
        self.strip_first = spec.add_dummy_prefix or spec.remove_extra_whitespaces
        self.strip_all = spec.remove_extra_whitespaces
        self.suffix = trainer.treat_whitespace_as_suffix
        pieces = [p.piece for p in proto.pieces]
        self.sizes = [1 if p.type == _BYTE else len(p.piece.encode()) for p in proto.pieces]
        self.unknown = next((i for i, p in enumerate(proto.pieces) if p.type == _UNKNOWN), -1)
        self.is_byte = [p.type == _BYTE for p in proto.pieces]
        self.texts = [
            b"" if p.type == _CONTROL
            else trainer.unk_surface.encode() if p.type == _UNKNOWN
            else bytes([int(p.piece[3:5], 16)]) if p.type == _BYTE
            else p.piece.replace(MARK, " ").encode()
            for p in proto.pieces
        ]
        self.leading = [len(p) - len(p.lstrip(MARK)) if k == _NORMAL else 0 for p, k in zip(pieces, (x.type for x in proto.pieces))]
        spec.name, spec.precompiled_charsmap = "identity", b""
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        self.merger = SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.size_table = np.array(self.sizes, np.int32)

    def encode(self, text: str) -> Encoded:
        normalised = self.normaliser(text)
        found = self.merger.encode(normalised.text.decode("utf-8"), out_type=int)
        ids = np.asarray(found, np.int32)
        if self.unknown in found:  # an unknown piece has the size of what it stands for
            proto = self.merger.encode(normalised.text.decode("utf-8"), out_type="immutable_proto")
            sizes = np.array([len(p.surface.encode()) for p in proto.pieces], np.int64)
        else:
            sizes = self.size_table[ids]
        edges = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)))
        return Encoded(ids, normalised.origin[edges[:-1]], normalised.origin[edges[1:]])

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD each."""
        texts = self.texts
        data = b"".join([texts[i] for i in ids])
        if self.strip_first and not self.suffix:
            # The first piece that shows loses the space of the dummy prefix, or all spaces where the model squeezes them.
            first = next((i for i in ids if texts[i]), None)
            leading = 0 if first is None else self.leading[first]
            data = data[leading if self.strip_all else min(leading, 1) :]
        return _text(data)


def _text(data: bytes) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        pass
    # One replacement character for each byte that belongs to no character.
    return "".join("�" if "\udc80" <= c <= "\udcff" else c for c in data.decode("utf-8", "surrogateescape"))


def encoded(text: Column, model: bytes) -> Column:
    """struct(ids, begin, end): piece ids and the UTF-8 bytes of the text each stands for; empty for null."""

    @F.pandas_udf("ids array<int>, begin array<bigint>, end array<bigint>")
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = OffsetEncoder(model)
        for batch in texts:
            got = [encoder.encode(t or "") for t in batch]
            yield pd.DataFrame({"ids": [g.ids for g in got], "begin": [g.begin for g in got], "end": [g.end for g in got]})

    return encode.asNondeterministic()(text)


def decoded(ids: Column, model: bytes) -> Column:
    """The text of an array of ids; null for null."""

    @F.pandas_udf("string")
    def decode(arrays: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = OffsetEncoder(model)
        for batch in arrays:
            yield batch.map(lambda i: None if i is None else encoder.decode(i))

    return decode.asNondeterministic()(ids)


def with_digests(docs: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """`docs` with a struct column `pieces` (n_tokens, ids_sha256, decoded_sha256, source_bytes).

    The same encoder as `encoded` and `decoded`, without sending ids and spans of whole texts through
    Spark. The name gets underscores where it is taken. Null texts count as empty: no ids. Rows stand
    alone: ids may be null or repeated, other columns pass unread, an empty table stays empty.
    """

    def row(encoder: OffsetEncoder, text: str) -> tuple[int, str, str, int]:
        got = encoder.encode(text)
        ids = got.ids.tolist()
        return (
            len(ids),
            hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(encoder.decode(ids).encode()).hexdigest(),
            int((got.end - got.begin).sum()),
        )

    @F.pandas_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string, source_bytes bigint")
    def digest(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = OffsetEncoder(model)
        for batch in texts:
            rows = [row(encoder, t or "") for t in batch]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "source_bytes"])

    return docs.withColumn(free_name(docs, "pieces"), digest.asNondeterministic()(F.col(text)))
