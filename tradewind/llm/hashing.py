"""Hashes of words and word shingles, many texts at once."""

from __future__ import annotations

import numpy as np

from tradewind.llm.common import WORD_BYTES

_BASE = 0x9E3779B97F4A7C15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
KEPT_POWERS = 1 << 19
_tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(values: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all output bits."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64; those of ordinary slices are kept by the worker process."""
    tables = _tables
    if len(tables[0]) < size:
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            tables.append(np.multiply.accumulate(factors))
        if size <= KEPT_POWERS:
            _tables[:] = tables
    return tables[0][:size], tables[1][:size]


def word_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """A 64-bit hash of every word of each text; words as `common.words_of` has them."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = _LOWER[np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)]
    power, inverse = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
    edge = np.flatnonzero(np.diff(WORD_BYTES[data], prepend=False))
    starts, ends = edge[::2], edge[1::2]
    hashes = mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    after = np.cumsum([len(r) + 1 for r in raw])
    return np.split(hashes, np.searchsorted(starts, after[:-1])) if len(raw) else []


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of `size` words; of the whole text if it has fewer, but not none."""
    if not len(words):
        return words
    size = min(size, len(words))
    total = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        total = total * np.uint64(0xD6E8FEB86659FD93) + words[i:len(words) - size + 1 + i]
    return np.unique(mixed(total))
