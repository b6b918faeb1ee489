"""Vectorised hashing of words and word shingles for the operators that run numpy inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
CHUNK_BYTES = 1 << 18
_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]  # A-Z hash as a-z
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)

#: Bytes of words: everything but space and the controls 9 to 13.
BY_SPACE = np.ones(256, dtype=bool)
BY_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: Bytes of words: ASCII letters and digits, and every byte of a code point beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(CHUNK_BYTES * 2, 1 << (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        up, down = np.full(size, _BASE, dtype=np.uint64), np.full(size, _BASE_INV, dtype=np.uint64)
        up[0] = down[0] = 1
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


def released(batches: Iterator) -> Iterator:
    """The batches; after each, memory that the last one has freed goes back to the system, as workers live on between tasks."""
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()
        if _TRIM is not None:
            _TRIM(0)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def chunks(texts: list[bytes | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` bytes together; a longer text is a range of its own."""
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t or b"") + 1
        if size and size + n > limit:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def word_spans(texts: list[bytes | None], word_bytes: np.ndarray = BY_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of all texts in order: 64-bit hashes, first and last-but-one places in the joined bytes, the bytes, and for each
    text the index of its first word (one more at the end)."""
    buf = np.frombuffer(b" ".join(t or b"" for t in texts), dtype=np.uint8)
    lengths = np.fromiter((len(t or b"") + 1 for t in texts), dtype=np.int64, count=len(texts))
    text_starts = np.concatenate(([0], np.cumsum(lengths)))
    if not buf.size:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, buf, np.zeros(len(texts) + 1, np.int64)
    edge = np.diff(np.concatenate(([0], word_bytes[buf].view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _power_tables(buf.size)
    total = np.zeros(buf.size + 1, dtype=np.uint64)
    np.cumsum(_BYTE[buf] * up[: buf.size], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))
    return hashes, starts, ends, buf, np.searchsorted(starts, text_starts)


def word_hashes(texts: list[bytes | None], word_bytes: np.ndarray = BY_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and for each text the index of its first word (one more at the end)."""
    hashes, _, _, _, first = word_spans(texts, word_bytes)
    return hashes, first


def shingle_sets(texts: list[bytes | None], width: int, word_bytes: np.ndarray = BY_SPACE) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of `width` words; with fewer words, of the whole sequence as one."""
    hashes, first = word_hashes(texts, word_bytes)
    joined = hashes.copy()
    for j in range(1, width):
        n = max(0, hashes.size - j)
        joined[:n] = mix(joined[:n] * _U(0x9FB21C651E98DF25) + hashes[j:])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(joined[a : b - width + 1]))
        elif b > a:  # too short for one shingle
            x = np.array([b - a], dtype=np.uint64)
            for h in hashes[a:b]:
                x = mix(x * _U(0xC2B2AE3D27D4EB4F) + h)
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
