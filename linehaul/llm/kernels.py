"""Array kernels that run inside tasks on Arrow batches: words of a text column, their hashes and window hashes.

A word is ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 text, unchanged. Hashes are polynomials modulo 2**64 over bytes
(words) or word hashes (windows), finished by a bit mixer; all of a batch is hashed with prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_BYTE_R, _WORD_R, _WORD_Q = 0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95 | 1, 0xAF251AF3B0F025B5 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(r: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """r**i and r**-i modulo 2**64 for i <= n."""
    have = _powers.get(r)
    if have is None or len(have[0]) <= n:
        size = 1 << max(16, int(n + 1).bit_length())
        out = []
        for base in (r, pow(r, -1, 1 << 64)):
            p = np.ones(size, U)
            done = 1
            while done < size:  # doubling: p[done:2*done] = p[:done] * base**done
                p[done : 2 * done] = p[:done] * U(pow(base, done, 1 << 64))
                done *= 2
            out.append(p)
        have = _powers[r] = (out[0], out[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@dataclass
class Words:
    """Words of consecutive texts. doc: offsets of texts into words, one more than texts."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray


def text_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its texts; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if col.null_count:
        col = col.fill_null("")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


#: Bytes between words for classifiers: all of ASCII but letters and digits.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, hashes: bool = True, gap: np.ndarray = _SPACE) -> Words:
    if lower:
        data = _LOWER[data]
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(data, z, z, np.zeros(len(offsets), np.int64), np.zeros(0, U))
    solid = np.ones(n + 2, bool)
    solid[1:-1] = ~gap[data]
    solid[0] = solid[-1] = False
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True  # a text ends here, whatever the bytes are
    start = np.flatnonzero(solid[1:-1] & (~solid[:-2] | cut[:-1]))
    end = np.flatnonzero(solid[1:-1] & (~solid[2:] | cut[1:])) + 1
    doc = np.searchsorted(start, offsets)
    h = np.zeros(0, U)
    if hashes:
        p, inv = powers(_BYTE_R, n)
        total = np.zeros(n + 1, U)
        np.cumsum((data.astype(U) + U(1)) * p[:n], out=total[1:])
        h = mix((total[end] - total[start]) * inv[start] + (end - start).astype(U))
    return Words(data, start, end, doc, h)


def window_hash(h: np.ndarray, length: int, r: int = _WORD_R) -> np.ndarray:
    """Hash of h[i:i+length] for each i; windows may cross texts, the caller masks those."""
    n = len(h)
    if n < length:
        return np.zeros(0, U)
    p, inv = powers(r, n)
    total = np.zeros(n + 1, U)
    np.cumsum(h * p[:n], out=total[1:])
    return mix((total[length:] - total[:-length]) * inv[: n - length + 1])


def span_hash(h: np.ndarray, lo: np.ndarray, hi: np.ndarray, r: int = _WORD_R) -> np.ndarray:
    """Hash of h[lo:hi] for each pair, its length included."""
    p, inv = powers(r, len(h) + 1)
    total = np.zeros(len(h) + 1, U)
    np.cumsum(h * p[: len(h)], out=total[1:])
    return mix((total[hi] - total[lo]) * inv[lo] + (hi - lo).astype(U))


def pieces(offsets: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes together; a longer text stands alone and stays whole."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def each(col: pa.Array, lower: bool = False, hashes: bool = True, most: int = 1 << 19, gap: np.ndarray = _SPACE) -> Iterator[tuple[int, int, Words]]:
    """(first text, past the last, their words) over a column, piece by piece."""
    data, offsets = text_bytes(col)
    for i, j in pieces(offsets, most):
        yield i, j, words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower, hashes, gap)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[i], lo[i]+1, ... n[i] of them, one after another."""
    total = int(n.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    first = np.cumsum(n) - n
    return np.arange(total, dtype=np.int64) - np.repeat(first - lo, n)
