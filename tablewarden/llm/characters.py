"""Hashed character n-grams of whole texts, in numpy."""

from __future__ import annotations

import functools

import numpy as np


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), dtype=bool, count=0x110000)


def letter_stream(text: str | None) -> np.ndarray:
    """Lower-cased letters as code points, each run of anything else as one space; empty without letters."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = _letters()[points]
    if not is_letter.any():
        return np.empty(0, np.uint32)
    stream = np.where(is_letter, points, np.uint32(32))
    before = np.concatenate(([False], is_letter[:-1]))
    stream = stream[is_letter | before]
    return np.concatenate((np.array([32], np.uint32), stream))


def hashed_grams(stream: np.ndarray, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """The buckets of all n-grams of the given orders, in order of place, one order after the other."""
    wide = stream.astype(np.uint64)
    found = []
    for order in orders:
        count = len(wide) - order + 1
        if count <= 0:
            continue
        code = np.full(count, order, np.uint64)
        for k in range(order):
            code = code * np.uint64(0x9E3779B97F4A7C15) + wide[k : k + count]
        code ^= code >> np.uint64(29)
        code *= np.uint64(0xBF58476D1CE4E5B9)
        found.append((code >> np.uint64(64 - bits)).astype(np.int32))
    return np.concatenate(found) if found else np.empty(0, np.int32)


def distinct(buckets: np.ndarray, scratch: np.ndarray) -> np.ndarray:
    """Each bucket once. `scratch` has a place for every bucket; what it holds does not matter."""
    order = np.arange(len(buckets), dtype=np.int32)
    scratch[buckets] = order
    return buckets[scratch[buckets] == order]
