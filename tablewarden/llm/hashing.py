"""Words of whole texts and hashes of runs of them, in numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import xxhash

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: Words whose hash a task remembers.
CACHED_WORDS = 400_000


class WordHashes(dict):
    """64-bit hashes by word; forgets all when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def split_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Runs of characters that are no ASCII white space, as bytes split; `lower` turns A-Z, and only these, to a-z."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return (data.lower() if lower else data).split()


_SPACES = np.isin(np.arange(256), list(b"\t\n\x0b\x0c\r "))
#: Masks of a word's last bytes, by their number up to eight.
_LAST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Bytes of the longest word that is hashed by eights together with others.
LONG_WORD = 64


def hash_texts(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (those of `split_words`) of some texts, and how many words each text has.

    Words are cut and hashed in their texts' bytes, eight at a time, so nothing is looked up or remembered; a word's
    length counts too. Other hashes than those of `WordHashes`.
    """
    encoded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = b"\n".join([b"", *encoded, bytes(8)])
    raw = np.frombuffer(data, np.uint8)[:-8]  # a break before and after every text
    space = _SPACES[raw]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray(len(raw), "<u8", data, strides=(1,))  # the eight bytes from every place
    codes = sizes.astype(np.uint64) * _FACTOR
    left, at = np.flatnonzero(sizes <= LONG_WORD), 0
    while len(left):
        rest = sizes[left] - at
        part = eight[starts[left] + at] & _LAST[np.minimum(rest, 8)]
        codes[left] = mixed((codes[left] ^ part) * _FACTOR)
        left, at = left[rest > 8], at + 8
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        word = data[starts[i] : starts[i] + sizes[i]]
        codes[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    ends = np.cumsum([len(e) + 1 for e in encoded])
    return codes, np.diff(np.searchsorted(starts, ends), prepend=0)


#: The multipliers of XXH64, and the bytes from which on a word takes its other way.
_P1, _P2, _P3, _P4, _P5 = np.array(
    [0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], np.uint64
)
_XXH64_LONG = 32


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def xxh64(data: bytes, ends: np.ndarray) -> np.ndarray:
    """XXH64, with seed 0, of the words that `ends` (with the first one's start) cuts out of `data`."""
    starts, sizes = ends[:-1].astype(np.int64), np.diff(ends).astype(np.int64)
    data += bytes(8)
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))  # the eight bytes from every place
    codes = sizes.astype(np.uint64) + _P5
    short = sizes < _XXH64_LONG
    for at in range(0, _XXH64_LONG - 8, 8):
        some = np.flatnonzero(short & (sizes >= at + 8))
        part = _turned(eight[starts[some] + at] * _P2, 31) * _P1
        codes[some] = _turned(codes[some] ^ part, 27) * _P1 + _P4
    some = np.flatnonzero(short & (sizes & 4 > 0))
    part = eight[starts[some] + (sizes[some] & ~7)] & _LAST[4]
    codes[some] = _turned(codes[some] ^ (part * _P1), 23) * _P2 + _P3
    for left in (3, 2, 1):
        some = np.flatnonzero(short & (sizes & 3 >= left))
        part = eight[starts[some] + sizes[some] - left] & _LAST[1]
        codes[some] = _turned(codes[some] ^ (part * _P5), 11) * _P1
    for by, factor in ((33, _P2), (29, _P3)):
        codes ^= codes >> np.uint64(by)
        codes *= factor
    codes ^= codes >> np.uint64(32)
    for i in np.flatnonzero(~short).tolist():
        codes[i] = xxhash.xxh64_intdigest(data[starts[i] : starts[i] + sizes[i]])
    return codes


def run_sums(words: np.ndarray, size: int) -> np.ndarray:
    """The polynomial of each run of `size` words; runs are put together from runs of powers of two."""
    if len(words) < size:
        return np.empty(0, np.uint64)
    part, length, done, done_length = words, 1, None, 0
    while True:
        if size & 1:
            if done is None:
                done = part
            else:
                later = done[length:]
                done = part[: len(later)] * np.uint64(pow(int(_FACTOR), done_length, 1 << 64)) + later
            done_length += length
        size >>= 1
        if not size:
            return done
        part = part[:-length] * np.uint64(pow(int(_FACTOR), length, 1 << 64)) + part[length:]
        length *= 2


def mixed(sums: np.ndarray) -> np.ndarray:
    """Hashes of runs by their polynomials."""
    code = (sums ^ (sums >> np.uint64(32))) * _MIX
    return code ^ (code >> np.uint64(29))


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of `size` consecutive words, by its first word's place."""
    return mixed(run_sums(words, size))
