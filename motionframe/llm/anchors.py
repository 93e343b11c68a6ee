"""Content-defined anchors of byte strings: the least of the hashed GRAM-byte strings in each WINDOW-byte window."""

from __future__ import annotations

from functools import cache

import numpy as np

from motionframe.llm.shingles import BASE, INVERSE, U, byte_values, mix, powers

WINDOW = 200
GRAM = 40


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of value * BASE**place over the bytes before each place: hashes of all substrings come from them."""
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(raw_values()[data] * powers(len(data), BASE), out=sums[1:])
    return sums


def string_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes from start to end - 1, for each pair."""
    return mix((sums[end] - sums[start]) * powers(len(sums), INVERSE)[start])


def gram_hashes(sums: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of the gram bytes from each byte on."""
    n = len(sums) - 1
    return mix((sums[gram:] - sums[: n - gram + 1]) * powers(n + 1, INVERSE)[: n - gram + 1])


@cache
def raw_values() -> np.ndarray:
    """A value for each byte; unlike the words' table it tells upper from lower case."""
    values = byte_values().copy()
    values[65:91] = mix(values[65:91].copy()) | U(1)
    values.setflags(write=False)
    return values


def least_values(h: np.ndarray, span: int) -> np.ndarray:
    """The least of each run of span values, by doubling."""
    least, have = h, 1
    while have < span:
        step = min(have, span - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    return least


def least_runs(h: np.ndarray, span: int, most_ties: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, from, to): the windows of span values from ``from`` to ``to`` have their leftmost least value at place."""
    least = least_values(h, span)
    begin = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    stop = np.concatenate([begin[1:], [len(least)]]) - 1
    places, begins, stops = [], [], []
    reach = np.arange(span)
    for _ in range(most_ties):
        place = begin + (h[np.minimum(begin[:, None] + reach, len(h) - 1)] == least[begin][:, None]).argmax(axis=1)
        places.append(place)
        begins.append(begin)
        stops.append(np.minimum(stop, place))
        left = place < stop  # windows beyond this place have an equal value further on
        begin, stop = place[left] + 1, stop[left]
        if not len(begin):
            place, begin, stop = (np.concatenate(x) for x in (places, begins, stops))
            order = np.argsort(begin, kind="stable")
            return place[order], begin[order], stop[order]
    place, have = np.arange(len(h), dtype=np.int64), 1  # a text of one short period: by doubling of places
    while have < span:
        step = min(have, span - have)
        a, b = place[: len(place) - step], place[step:]
        place = np.where(h[b] < h[a], b, a)
        have += step
    new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return place[new], new, np.concatenate([new[1:], [len(place)]]) - 1


def anchors(data: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(place, hash, low, high, context): each anchor, the range of its offset in the windows that it anchors, and a hash of
    that range and all bytes of these windows.

    Windows of equal bytes have equal anchors at equal offsets, so windows can only be equal where the anchors' hashes are.
    """
    if len(data) < window:
        none = np.empty(0, np.int64)
        return none, none.astype(U), none, none, none.astype(U)
    sums = prefix_sums(data)
    h = gram_hashes(sums, gram)
    at, new, last = least_runs(h, window - gram + 1)
    low, high = at - last, at - new
    context = mix(string_hashes(sums, new, last + window) + (low << 8 | high).astype(U))
    return at, h[at], low, high, context
