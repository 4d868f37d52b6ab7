"""Vectorised text kernels over Arrow string columns (numpy, no per-character Python).

A column is handled in blocks of whole documents of about ``BLOCK`` bytes, so the
working memory of a Python worker does not depend on the Arrow batch or partition
size, only on the longest single document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once.
BLOCK = 1 << 19

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
#: One random 64-bit value for each byte value, fixed by the seed.
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Byte classes of a word: anything but ASCII white space.
WORD_NOT_SPACE = ~_SPACE
#: Byte classes of a word: lower-case letters, digits and every non-ASCII byte.
WORD_ALNUM = np.zeros(256, bool)
WORD_ALNUM[0x30:0x3A] = WORD_ALNUM[0x61:0x7B] = WORD_ALNUM[0x80:] = True
#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: A second base and second byte values, for hashes that fail independently of the first.
_BASE2 = 0xD1342543DE82EF95
_INVERSE2 = pow(_BASE2, -1, 1 << 64)
_BYTE2 = np.random.default_rng(71).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)

_powers: dict[int, dict[int, tuple[np.ndarray, np.ndarray]]] = {0: {}, 1: {}}


def _power_tables(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers[which]:
        _powers[which].clear()
        out = []
        for base in ((_BASE, _INVERSE), (_BASE2, _INVERSE2))[which]:
            table = np.full(size, base, np.uint64)
            table[0] = 1
            out.append(np.multiply.accumulate(table))
        _powers[which][size] = tuple(out)
    return _powers[which][size]


def prefix_sums(values: np.ndarray, which: int = 0) -> np.ndarray:
    """Polynomial sums of symbol values, from which ``run_hashes`` takes the hash of any run."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power_tables(len(values) + 1, which)[0][: len(values)], out=total[1:])
    return total


def run_hashes(total: np.ndarray, begin: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hashes of the symbols from ``begin`` to ``end``."""
    return mix((total[end] - total[begin]) * _power_tables(len(total), which)[1][begin])


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits of 64-bit values (murmur-style)."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def blocks(data: np.ndarray, offs: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Whole documents of about ``size`` bytes: (first row, end row, bytes, offsets)."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of the lower-cased bytes: 64-bit hashes, first byte of each, and per-document offsets into them."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    low = LOWER[data]
    mask = is_word[low]
    begin = mask.copy()
    begin[1:] &= ~mask[:-1]
    end = mask.copy()
    end[:-1] &= ~mask[1:]
    cut = offs[(offs > 0) & (offs < n)]  # a word never crosses documents
    begin[cut] = mask[cut]
    end[cut - 1] = mask[cut - 1]
    first, last = np.flatnonzero(begin), np.flatnonzero(end) + 1
    power, inverse = _power_tables(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[low] * power[:n], out=total[1:])
    return mix((total[last] - total[first]) * inverse[first]), first, np.searchsorted(first, offs)


def _term(word: np.ndarray, j: int) -> np.ndarray:
    """What the j-th word adds to the hash of its run."""
    return mix(word + _U((j + 1) * 0xD6E8FEB86659FD93 % (1 << 64))) * _U((2 * j + 1) * _BASE % (1 << 64) | 1)


def shingles(word: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, and per-document offsets. A shorter, non-empty text has its whole sequence as one."""
    n, count = len(word), np.diff(at)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    run = np.zeros(n, np.uint64)
    for j in range(min(k, n)):
        run[: n - j] += _term(word[j:], j)
    left = np.repeat(at[1:], count) - np.arange(n)  # words from here to the end of the document
    keep = left >= k
    for d in np.flatnonzero((count > 0) & (count < k)):
        run[at[d]] = sum(int(_term(word[at[d] + j : at[d] + j + 1], j)[0]) for j in range(count[d])) % (1 << 64)
        keep[at[d]] = True
    sizes = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    return mix(run[keep]), np.concatenate([[0], np.cumsum(sizes)])
