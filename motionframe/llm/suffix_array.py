"""Suffix sorting by difference cover, in numpy.

The suffixes at places that are 1 or 2 modulo 3 are the sample.  Their triples are sorted and named, the names are
sorted in turn where they aren't unique yet, and the remaining suffixes are merged in by their first symbol and the
rank of the sample suffix behind it.  Names of level k stand for 3**k symbols; only prefixes of ``prefix`` symbols
matter here, so the recursion ends once names stand for as many, and equal names then are equal prefixes.
"""

from __future__ import annotations

import numpy as np


def suffix_array(s: np.ndarray, prefix: int, covered: int = 1) -> np.ndarray:
    """Places in the order of their suffixes, as far as the first ``prefix`` symbols of the outermost level tell.

    s: symbols from 1 on, fewer than 2**20 of them, each below 2**21.
    """
    s = s.astype(np.int64)
    n = len(s)
    if n < 3 or covered >= prefix:
        return np.lexsort((np.arange(n), s)) if covered >= prefix else _plainly(s)
    t = np.concatenate([s, np.zeros(4, np.int64)])
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # one place beyond the end closes the sample
    sample = np.concatenate([one, two])
    triples = t[sample] << 42 | t[sample + 1] << 21 | t[sample + 2]
    found, names = np.unique(triples, return_inverse=True)
    names = names.astype(np.int64) + 1
    if len(found) < len(sample) and covered * 3 < prefix:
        order = suffix_array(names, prefix, covered * 3)
        # suffixes with equal prefixes keep different ranks; any order among them is right
        ranks = np.empty(len(sample), np.int64)
        ranks[order] = np.arange(1, len(sample) + 1)
    else:
        order = np.argsort(names, kind="stable")
        ranks = names
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = ranks
    zero = np.arange(0, n, 3)
    key = t[zero] << 21 | rank[zero + 1]
    zero = zero[np.argsort(key, kind="stable")]
    sorted_sample = sample[order]
    sorted_sample = sorted_sample[sorted_sample < n]
    first, second = sorted_sample[sorted_sample % 3 == 1], sorted_sample[sorted_sample % 3 == 2]
    by_one = lambda p: t[p] << 21 | rank[p + 1]
    by_two = lambda p: t[p] << 42 | t[p + 1] << 21 | rank[p + 2]
    # Among suffixes with equal prefixes the keys may disagree; sorting and the running maximum keep such ones together.
    before_zero = np.searchsorted(np.sort(by_one(first)), by_one(zero)) + np.searchsorted(np.sort(by_two(second)), by_two(zero))
    before_zero = np.maximum.accumulate(before_zero) if len(zero) else before_zero
    out = np.empty(n, np.int64)
    taken = np.zeros(n, bool)
    at = np.arange(len(zero)) + before_zero
    out[at], taken[at] = zero, True
    out[~taken] = sorted_sample
    return out


def _plainly(s: np.ndarray) -> np.ndarray:
    return np.array(sorted(range(len(s)), key=lambda i: s[i:].tolist()), np.int64)


def repeated(data: np.ndarray, valid: np.ndarray, length: int) -> np.ndarray:
    """Whether the string of ``length`` symbols at each valid place also starts at another valid place."""
    order = suffix_array(data, length)
    order = order[valid[order]]
    out = np.zeros(len(data), bool)
    if len(order) < 2:
        return out
    views = np.lib.stride_tricks.sliding_window_view(data, length)
    for k in range(0, len(order) - 1, 1 << 16):
        a, b = order[k : k + (1 << 16)], order[k + 1 : k + 1 + (1 << 16)]
        a = a[: len(b)]
        same = (data[a] == data[b]) & (data[a + length - 1] == data[b + length - 1])
        some = np.flatnonzero(same)
        same[some] = (views[a[some]] == views[b[some]]).all(axis=1)
        out[a[same]] = out[b[same]] = True
    return out
