"""Words, hashes and shingles of many texts at once, with numpy over Arrow buffers.

Everything works on the UTF-8 bytes of a batch of texts. A batch is cut into blocks of whole
texts of about BLOCK bytes, so memory stays bounded by the largest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
U = np.uint64
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = U(0x9E3779B97F4A7C15)
_BASE_INV = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_ORDER = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: What parts words: space and \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: What parts expressions: white space, ASCII punctuation and digits.
LOOSE = SPACE.copy()
LOOSE[[b for b in range(128) if not chr(b).isalpha()]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of x."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, n at least."""
    if len(_powers[0]) < n + 1:
        for k, base in enumerate((_BASE, _BASE_INV)):
            steps = np.full(n + 1, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


@dataclass
class Block:
    """Whole texts: their bytes (A-Z lowered), and words as spans of those bytes."""

    first: int  # number of the first text in its batch
    offsets: np.ndarray  # of texts, in bytes
    data: np.ndarray
    starts: np.ndarray  # of words, in bytes
    ends: np.ndarray
    words: np.ndarray  # of texts, in words: like offsets
    sums: np.ndarray

    def hashes(self, most: int | None = None) -> np.ndarray:
        """A hash for each word, or for its first so many bytes."""
        return self.span_hashes(self.starts, self.ends if most is None else np.minimum(self.ends, self.starts + most))

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash for each span of bytes."""
        _, inverse = powers(len(self.data))
        size = (ends - starts).astype(np.uint64)
        h = (self.sums[ends] - self.sums[starts]) * inverse[starts]
        return mix(h ^ (size * _ORDER[0]))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets and bytes of an Arrow string array; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def spans(offsets: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Runs of texts that hold at most so many bytes, or one text."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def blocks(texts: pa.Array, parts: np.ndarray = SPACE, lower: bool = True) -> Iterator[Block]:
    offsets, data = buffers(texts)
    for lo, hi in spans(offsets):
        own = offsets[lo : hi + 1] - offsets[lo]
        raw = data[offsets[lo] : offsets[hi]]
        if lower:
            raw = LOWER[raw]
        inside = ~parts[raw]
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        before[own[:-1][own[:-1] < len(raw)]] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        last = own[1:] - 1
        after[last[last >= 0]] = False
        ends = np.flatnonzero(inside & ~after) + 1
        steps, _ = powers(max(len(raw), BLOCK))
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * steps[: len(raw)], out=sums[1:])
        yield Block(lo, own, raw, starts, ends, np.searchsorted(starts, own), sums)


def runs(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of k words, with their bounds; a text of fewer words is one run."""
    sizes = np.diff(bounds)
    n = np.where(sizes >= k, sizes - k + 1, (sizes > 0).astype(sizes.dtype))
    out_bounds = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(out_bounds[-1], np.uint64)
    if len(hashes) >= k:
        whole = hashes[: len(hashes) - k + 1] * _ORDER[1]
        for i in range(1, k):
            whole = whole + hashes[i : len(hashes) - k + 1 + i] * _ORDER[1 + i]
        whole = mix(whole)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        keep = owner[: len(owner) - k + 1] == owner[k - 1 :]
        long_run = np.repeat(sizes >= k, n)
        out[long_run] = whole[keep]
    for t in np.flatnonzero((sizes > 0) & (sizes < k)):
        own = hashes[bounds[t] : bounds[t + 1]]
        total = (own * _ORDER[8 : 8 + len(own)]).sum(keepdims=True) + U(int(sizes[t]))
        out[out_bounds[t]] = mix(total * _ORDER[40])[0]
    return out, out_bounds


def signed(x: np.ndarray) -> np.ndarray:
    """As Spark's long."""
    return x.view(np.int64)
