"""Vectorised word splitting and hashing over Arrow string batches.

Words are found on UTF-8 bytes, so only ASCII decides where a word ends, as the operators' word patterns ask. A word's
hash is the mixed sum of its mixed 8-byte parts, each with its place, and its length; two different words collide with a
probability of about 2**-64.
"""

from __future__ import annotations

import ctypes
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixing step (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(seed))


def _bytes(word: np.ndarray, lower: bool) -> np.ndarray:
    """What each byte counts as: itself or a lower-case letter in a word, a blank elsewhere."""
    table = np.arange(256)
    if lower:
        table[65:91] = table[97:123]
    return np.where(word, table, 32).astype(np.uint8)


_SPACE = np.ones(256, bool)
_SPACE[[32, *range(9, 14)]] = False
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True

#: "space": words between ASCII white space, A-Z lowered; "exact": the same, case kept;
#: "alnum": runs of digits, letters (A-Z lowered) and non-ASCII characters.
KINDS = {"space": _bytes(_SPACE, True), "exact": _bytes(_SPACE, False), "alnum": _bytes(_ALNUM, True)}
#: Words of more bytes are hashed one by one.
_LONG = 64
_PLACE = np.arange(1 + _LONG // 8, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)
#: The first n bytes of 8, n = 0 to 8.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


@dataclass
class Words:
    """hash of each word; ``first[i]:first[i + 1]`` are those of text i. ``prefixes``: hashes of the words' first bytes."""

    hash: np.ndarray
    first: np.ndarray
    prefixes: list[np.ndarray]

    def of(self, i: int) -> np.ndarray:
        return self.hash[self.first[i] : self.first[i + 1]]


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and each text's offsets there; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    buffers = texts.buffers()
    at = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.empty(0, np.uint8)
    return data[at[0] : at[-1]] if len(at) else data, at - at[0] if len(at) else np.zeros(1, np.int64)


def words(texts: pa.Array, kind: str, prefixes: tuple[int, ...] = ()) -> Words:
    """``prefixes``: numbers of bytes, 8 at most; the words' hashes are also made of just so many first bytes."""
    data, at = flat(texts)
    n = len(data)
    data = np.concatenate((KINDS[kind][data], np.zeros(8, np.uint8)))
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = data[:n] != 32
    cut = np.zeros(n + 2, bool)  # between two texts a word ends
    cut[at + 1] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[1:-1]))
    size = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[2:])) + 1 - start
    eight = np.ndarray((n + 1,), "<u8", data.data, strides=(1,))
    total = size.astype(np.uint64)
    live = np.flatnonzero(size <= _LONG)
    for j in range(_LONG // 8):
        rest = size[live] - 8 * j
        live, rest = live[rest > 0], rest[rest > 0]
        if not len(live):
            break
        total[live] += mix((eight[start[live] + 8 * j] & _FIRST[np.minimum(rest, 8)]) + _PLACE[j + 1])
    for i in np.flatnonzero(size > _LONG).tolist():
        own = np.zeros(-(-int(size[i]) // 8) * 8, np.uint8)
        own[: size[i]] = data[start[i] : start[i] + size[i]]
        total[i] += mix(own.view("<u8") + np.arange(1, len(own) // 8 + 1, dtype=np.uint64) * _PLACE[1]).sum(dtype=np.uint64)
    short = [mix(eight[start] & _FIRST[np.minimum(size, p)]) + _U(p << 40) for p in prefixes]
    return Words(mix(total), np.searchsorted(start, at), [mix(x) for x in short])


_STEP = stream(51, 4096) | _U(1)


def shingles(w: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; of the whole sequence if it has fewer words; nothing without words."""
    if len(w) == 0:
        return w
    size = min(k, len(w))
    total = np.zeros(len(w) - size + 1, np.uint64)
    for j in range(size):
        total += w[j : len(w) - size + 1 + j] * _STEP[j]
    return mix(total + _U(size))


def shingle_sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The different shingles of each text in order, one text after the other, and where each text's begin."""
    first, n = w.first, np.diff(w.first)
    every = shingles(w.hash, k) if len(w.hash) >= k else np.empty(0, np.uint64)
    out = [np.empty(0, np.uint64)]
    for a, m in zip(first[:-1].tolist(), n.tolist(), strict=True):
        out.append(np.sort(every[a : a + m - k + 1]) if m >= k else shingles(w.hash[a : a + m], k))
    at = np.cumsum([len(x) for x in out])
    flat = np.concatenate(out)
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    new[at[:-1][at[:-1] < len(flat)]] = True
    return flat[new], np.concatenate(([0], np.cumsum(new)))[at]


def long(x: np.ndarray) -> np.ndarray:
    """The same bits as Spark's long."""
    return np.ascontiguousarray(x).view(np.int64)


def lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    at = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(arrays) if arrays else np.empty(0), kind))


def slices(batches, rows: int = 256):
    """Smaller batches, so that a worker's memory follows a few hundred texts. Workers live on after a task; at its end
    they give back what they no longer use."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
    release()


def release() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
