"""Hashed word shingles of many texts at once, and b-bit MinHash signatures of the sets."""

from __future__ import annotations

import hashlib

import numpy as np

SHINGLE = 5
_U = np.uint64
_SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64: a bijection of 64-bit integers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += ord("a") - ord("A")
_WHITE = np.zeros(256, bool)
_WHITE[list(_SPACES)] = True
_PLACE = mix(np.arange(101, 101 + SHINGLE, dtype=_U)) | _U(1)
#: Words of more bytes are hashed one by one.
LONG = 64


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int) -> np.ndarray:
    """Keyed hashes of words, eight bytes at a step, all words at once; of long words by a cryptographic hash."""
    data = np.concatenate([_LOWER[data], np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) - 7,), "<u8", data.data, 0, (1,))  # the eight bytes from each place on
    size = ends - starts
    first, second = mix(np.array([key, key ^ 0x5851F42D4C957F2D], _U))
    out = mix(first + size.astype(_U))
    todo = np.flatnonzero(size <= LONG)
    for at in range(0, LONG, 8):
        todo = todo[size[todo] > at]
        if not len(todo):
            break
        left = np.minimum(8, size[todo] - at)
        step = eight[starts[todo] + at] & (~_U(0) >> (64 - 8 * left).astype(_U))
        out[todo] = mix((out[todo] ^ step) * (second | _U(1)))
    for i in np.flatnonzero(size > LONG).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].data, digest_size=8, key=key.to_bytes(8, "little")).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def shingle_sets(texts, key: int = 0) -> list[np.ndarray]:
    """For an Arrow string array: each text's distinct shingles as ascending 64-bit hashes. Words are maximal runs of other
    bytes than space and U+0009..U+000D, A-Z as a-z. A text of fewer than SHINGLE words is one shingle, one without words
    (or null) has none. Two different shingles share a hash with a probability of about 2**-64, whatever the texts, as long
    as whoever wrote them didn't know the key (of 64 bits)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    arr = pc.fill_null(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, "").cast(pa.large_string())
    bounds = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    if arr.buffers()[2] is None or bounds[-1] == bounds[0]:
        return [np.empty(0, _U)] * len(arr)
    data = np.frombuffer(arr.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    gap = np.ones(len(data) + 1, bool)
    gap[1:] = _WHITE[data]  # gap[i]: what stands before byte i ends a word
    gap[bounds[:-1]] = True
    black = ~_WHITE[data]
    starts = np.flatnonzero(black & gap[:-1])
    after = np.ones(len(data), bool)
    after[:-1] = ~black[1:]
    after[bounds[1:][bounds[1:] > 0] - 1] = True
    ends = np.flatnonzero(black & after) + 1
    words = _word_hashes(data, starts, ends, key)
    first = np.searchsorted(starts, bounds)
    n = len(words)
    whole = np.zeros(max(0, n - SHINGLE + 1), _U)
    for k in range(SHINGLE if len(whole) else 0):
        whole += words[k : k + len(whole)] * _PLACE[k]
    whole = mix(whole)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= SHINGLE:
            out.append(np.unique(whole[lo : hi - SHINGLE + 1]))
        elif hi > lo:
            out.append(mix((words[lo:hi] * _PLACE[: hi - lo]).sum(keepdims=True, dtype=_U) + _U(hi - lo)))
        else:
            out.append(np.empty(0, _U))
    return out


def set_hash(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each set, whatever its order."""
    return mix(np.array([mix(s ^ _U(0xA0761D6478BD642F)).sum(dtype=_U) + _U(len(s)) for s in sets], _U))


def signatures(sets: list[np.ndarray], size: int, chunk: int = 1 << 15) -> np.ndarray:
    """b-bit MinHash with b = 8: a row of ``size`` bytes for each set, all of them non-empty."""
    seeds = mix(np.arange(1, 2 * size + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
    a, b = (seeds[:size] >> _U(32)).astype(np.uint32) | np.uint32(1), (seeds[size:] >> _U(32)).astype(np.uint32)
    out, lo, sizes = np.empty((len(sets), size), np.uint8), 0, np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    while lo < len(sets):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + chunk, "right")))
        x = (np.concatenate(sets[lo:hi]) >> _U(32)).astype(np.uint32)
        at = np.concatenate([[0], np.cumsum(sizes[lo:hi])[:-1]])
        low = np.empty((size, hi - lo), np.uint32)
        tmp = np.empty_like(x)
        for k in range(size):
            np.multiply(x, a[k], out=tmp)
            tmp += b[k]
            tmp ^= tmp >> np.uint32(15)
            tmp *= np.uint32(0x2C1B3C6D)
            low[k] = np.minimum.reduceat(tmp, at)
        out[lo:hi] = (mix(low.astype(_U)) >> _U(56)).astype(np.uint8).T
        lo = hi
    return out
