"""Word and shingle hashes of whole texts, many rows at a time in numpy.

A word is a maximal run of ASCII letters, digits and non-ASCII characters of the lower-cased text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from glosswork.llm.common import GOLDEN, U64, mix, text_buffers

_BASE = 0x5851F42D4C957F2D
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
BLOCK = 1 << 16


def _ladder(base: int, n: int) -> np.ndarray:
    """The first n powers of base modulo 2**64."""
    steps = np.full(n, base, U64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


_UP, _DOWN = _ladder(_BASE, BLOCK), _ladder(pow(_BASE, -1, 1 << 64), BLOCK)
_UP_BLOCK, _DOWN_BLOCK = (pow(b, BLOCK, 1 << 64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))


def prefix_sums(body: np.ndarray) -> np.ndarray:
    """n + 1 sums of (byte + 1) * base**place modulo 2**64, block by block, so that no table grows with the text."""
    sums = np.zeros(len(body) + 1, U64)
    carry, lift = U64(0), 1
    for i in range(0, len(body), BLOCK):
        part = body[i : i + BLOCK].astype(U64)
        part += U64(1)
        part *= _UP[: len(part)]
        part *= U64(lift)
        own = sums[i + 1 : i + 1 + len(part)]
        np.cumsum(part, out=own)
        own += carry
        carry, lift = own[-1], lift * _UP_BLOCK & 0xFFFFFFFFFFFFFFFF
    return sums


def inverse_powers(places: np.ndarray, n: int) -> np.ndarray:
    """base**-place modulo 2**64 of places below n."""
    blocks = _ladder(_DOWN_BLOCK, n // BLOCK + 1)
    return _DOWN[places % BLOCK] * blocks[places // BLOCK]


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return text_buffers(pc.utf8_lower(column))


def word_hashes(body: np.ndarray, offsets: np.ndarray, prefix: int = 0) -> tuple[np.ndarray, ...]:
    """Hashes of all words of rows in lower-cased UTF-8, and the n + 1 offsets of the rows' words.

    With `prefix`, also hashes of the words' first so many bytes.
    """
    n = len(body)
    offsets = offsets - offsets[0]
    inside = _WORD[body]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:n]
    starts = np.flatnonzero(start)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:n]
    ends = np.flatnonzero(last) + 1
    sums, down = prefix_sums(body), inverse_powers(starts, n)
    hashes = mix((sums[ends] - sums[starts]) * down + (ends - starts).astype(U64) * GOLDEN)
    bounds = np.searchsorted(starts, offsets)
    if prefix:
        cut = np.minimum(starts + prefix, ends)
        return hashes, bounds, mix((sums[cut] - sums[starts]) * down - (cut - starts).astype(U64) * GOLDEN)
    return hashes, bounds


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's k-word shingles and the rows' offsets; a row of 1 to k - 1 words has one, of all its words."""
    sizes = np.diff(bounds)
    n = len(hashes)
    padded = np.concatenate([hashes, np.zeros(k, U64)])
    counts = np.where(sizes >= k, sizes - k + 1, np.minimum(sizes, 1))
    out_bounds = np.concatenate([[0], np.cumsum(counts)])
    rows = np.repeat(np.arange(len(sizes)), counts)
    at = np.arange(out_bounds[-1]) - out_bounds[rows] + bounds[rows]
    total = np.zeros(n, U64)
    short = sizes < k
    for j in range(k):
        total = (total + padded[j : n + j]) * U64(_BASE)
    out = total[at] if n else np.empty(0, U64)
    for r in np.flatnonzero(short & (sizes > 0)):  # as many words as there are, and no words of the next row
        own = U64(0)
        with np.errstate(over="ignore"):
            for h in hashes[bounds[r] : bounds[r + 1]]:
                own = (own + h) * U64(_BASE)
        out[out_bounds[r]] = own + U64(sizes[r])
    return mix(out), out_bounds
