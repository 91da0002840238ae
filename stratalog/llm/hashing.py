"""64-bit hashes of words, and sets of their shingles, for whole Arrow batches at a time.

A word is a maximal run of bytes other than the six white-space characters of the word rule, with A-Z in lower case.
Its hash is a polynomial over random codes of its bytes, so the hashes of all words of a batch come from one running sum:
no word becomes a Python object.  Words that have equal hashes count as equal, likewise shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SHINGLE = 5
#: Bytes of text that are hashed at once, but for longer texts; and bytes of one running sum, but for longer words.
SLICE, BLOCK = 1 << 19, 1 << 17

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit integers well mixed (the finaliser of MurmurHash3)."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


#: Random numbers for bytes as they stand, and with A-Z in lower case.
EXACT = mixed(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
CODES = EXACT.copy()
CODES[65:91] = CODES[97:123]
BASE = 0xD1342543DE82EF95
#: Odd multipliers, one for each word of a gram.
FACTORS = mixed(np.arange(1, 65, dtype=U)) | U(1)

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``BASE`` and of its inverse modulo 2^64, for n places at least."""
    size = max(BLOCK, 1 << (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        both = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            x = np.full(size, base, U)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        _POWERS[size] = (both[0], both[1])
    return _POWERS[size]


def slices(texts: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, after the last, bytes, bounds of the texts in them) of parts of a text column; a longer text is a part of its own."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not len(texts):
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, bounds, data = texts.buffers()
    bounds = np.frombuffer(bounds, np.int64 if wide else np.int32, len(texts) + 1, texts.offset * (8 if wide else 4)).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + limit, "right")) - 1)
        yield i, j, data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
        i = j


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of texts begins and ends."""
    plain = ~SPACE[data]
    first, last = plain.copy(), plain.copy()
    first[1:] &= ~plain[:-1]
    last[:-1] &= ~plain[1:]
    inner = bounds[:-1][np.diff(bounds) > 0]
    first[inner] = plain[inner]
    last[inner[1:] - 1] = plain[inner[1:] - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Hashes of bytes from ``begins`` to ``ends``, both ascending; ``codes`` has a number for each byte."""
    out = np.empty(len(begins), U)
    i = 0
    while i < len(begins):
        j = max(i + 1, int(np.searchsorted(ends, begins[i] + BLOCK, "right")))
        a, b = begins[i], ends[j - 1]
        up, down = _powers(int(b - a))
        sums = np.empty(b - a + 1, U)
        sums[0] = 0
        np.cumsum(codes[data[a:b]] * up[: b - a], out=sums[1:])
        at = begins[i:j] - a
        out[i:j] = (sums[ends[i:j] - a] - sums[at]) * down[at]
        i = j
    return mixed(out)


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of texts, where each begins, and at which word each text begins (and the last ends)."""
    begins, ends = word_spans(data, bounds)
    return span_hashes(data, begins, ends, CODES), begins, np.searchsorted(begins, bounds)


def gram_keys(w: np.ndarray, n: int) -> np.ndarray:
    """A key for every n neighbouring words."""
    many = max(len(w) - n + 1, 0)
    x = np.full(many, U(n), U)
    for j in range(n):
        x += w[j : j + many] * FACTORS[j]
    return mixed(x)


def distinct(x: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each of n owners, ascending, one owner after the other; and where each begins."""
    if n < 1 << 24:
        key = (owner.astype(U) << U(40)) | (x >> U(24))
        order = np.argsort(key)
        key, y = key[order], x[order]
        if ((key[1:] == key[:-1]) & (y[1:] < y[:-1])).any():  # the key's 40 bits don't settle the order
            order = np.lexsort((x, owner))
    else:
        order = np.lexsort((x, owner))
    x, owner = x[order], owner[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (owner[1:] != owner[:-1])
    x, owner = x[new], owner[new]
    return x, np.searchsorted(owner, np.arange(n + 1))


def shingle_sets(w: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingle set of each unit, a run of ``sizes`` words from ``begins``; where each set begins among them.

    Units with fewer words than a shingle are one shingle as a whole; those without words have an empty set.
    """
    full = np.maximum(sizes - SHINGLE + 1, 0)
    owner = np.repeat(np.arange(len(sizes)), full)
    at = np.arange(len(owner)) + np.repeat(begins - (np.cumsum(full) - full), full)
    keys = gram_keys(w, SHINGLE)
    x = keys if len(at) == len(keys) and (np.diff(at) == 1).all() else keys[at]
    short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
    if len(short):
        y = sizes[short].astype(U)
        for j in range(SHINGLE - 1):
            more = sizes[short] > j
            y[more] += w[begins[short][more] + j] * FACTORS[j]
        x, owner = np.concatenate([x, mixed(y)]), np.concatenate([owner, short])
    return distinct(x, owner, len(sizes))


def text_sets(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingle set of each text."""
    w, _, at = word_hashes(data, bounds)
    return shingle_sets(w, at[:-1], np.diff(at))


def set_keys(x: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for each of several sets, whatever the order of its values; 0 for an empty one."""
    out = []
    for factor in FACTORS[-2:]:
        sums = np.concatenate([np.zeros(1, U), np.cumsum(mixed(x * factor))])
        out.append((sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64))
    return out[0], out[1]


def binaries(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Slices of an array as binary values."""
    raw = np.ascontiguousarray(data)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * raw.itemsize).astype(np.int32)), pa.py_buffer(raw)])


def lists(bounds: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values)
