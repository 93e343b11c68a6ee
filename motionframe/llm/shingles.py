"""Words and word shingles of many texts at once, in numpy.

Words are runs of bytes other than space and 09-0D; A-Z are lower-cased.  A word's hash is a polynomial over its bytes
(through a table of random 64-bit values), read off prefix sums; a shingle's hash mixes those of its words in order.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
WIDTH = 5


@cache
def byte_values() -> np.ndarray:
    values = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
    values[65:91] = values[97:123]
    values.setflags(write=False)
    return values


@cache
def spaces() -> np.ndarray:
    found = np.zeros(256, bool)
    found[[32, *range(9, 14)]] = True
    return found


KEPT = (1 << 21) + (1 << 18)
INVERSE = pow(BASE, -1, 1 << 64)


_kept: dict[int, np.ndarray] = {}


def _powers(n: int, base: int) -> np.ndarray:
    out = np.ones(max(1, n), U)
    have = 1
    while have < n:
        step = min(have, n - have)
        out[have : have + step] = out[:step] * U(pow(base, have, 1 << 64))
        have += step
    return out


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; a worker keeps as many of a base as its texts needed, KEPT at most."""
    if n > KEPT:
        return _powers(n, base)
    if base not in _kept or len(_kept[base]) < n:
        _kept[base] = _powers(min(KEPT, 1 << n.bit_length()), base)
    return _kept[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A full 64-bit mixer, in place."""
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and the n+1 places where each begins and ends."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    ends = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the n+1 places in them where each text begins and ends."""
    n = len(data)
    solid = np.zeros(n + 2, np.int8)
    solid[1:-1] = ~spaces()[data]
    edge = np.diff(solid)
    begin, end = edge == 1, edge == -1  # at byte i: a word begins there, ended before it
    inner = ends[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    cut = inner[(solid[inner] == 1) & (solid[inner + 1] == 1)]  # texts that touch without white space
    begin[cut] = end[cut] = True
    s, e = np.flatnonzero(begin), np.flatnonzero(end)
    sums = np.zeros(n + 1, U)
    np.cumsum(byte_values()[data] * powers(n, BASE)[:n], out=sums[1:])
    h = (sums[e] - sums[s]) * powers(n + 1, INVERSE)[s]
    return mix(h), np.searchsorted(s, ends)


def shingle_hashes(words: np.ndarray, places: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's shingles in order, repeats too, and the places where each text begins and ends.

    A text of fewer words has its whole sequence as its one shingle; a text without words has none.
    """
    n = np.diff(places)
    base = U(0xA0761D6478BD642F)
    if len(words) >= width:
        full = words[: len(words) - width + 1].copy()
        for k in range(1, width):
            full *= base
            full += words[k : len(words) - width + 1 + k]
        mix(full)
    else:
        full = np.empty(0, U)
    counts = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    out_places = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(out_places[-1]) - np.repeat(out_places[:-1], counts) + np.repeat(places[:-1], counts)
    out = full[np.minimum(at, max(0, len(full) - 1))] if len(full) else np.zeros(len(at), U)
    for i in np.flatnonzero((n > 0) & (n < width)):
        h = U(0)
        with np.errstate(over="ignore"):
            for w in words[places[i] : places[i + 1]]:
                h = h * base + w
            out[out_places[i]] = mix(np.array([h ^ U(int(n[i]))]))[0]
    return out, out_places


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    data, ends = raw(texts)
    if not len(data):
        return [np.empty(0, U)] * len(texts)
    hashes, places = shingle_hashes(*word_hashes(data, ends), width)
    out = []
    for a, b in zip(places[:-1], places[1:], strict=True):
        s = np.sort(hashes[a:b])
        out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s)
    return out
