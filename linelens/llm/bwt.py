"""Repeated strings of a small text by breadth-first backward extension on its Burrows-Wheeler transform.

The suffixes of the text are sorted (by prefix doubling, which need only reach the wanted length), which gives
the transform and its last-to-first mapping. Common prefixes of neighbouring suffixes are then found by
increasing value: an interval of suffixes that start with a string w is extended backwards by every character
before it to the intervals of cw; the place behind such an interval that has no value yet gets the length of
w, and only then is the interval taken on to the next level. Levels end at the wanted length: places without
a value have common prefixes of at least that length. The first levels are read off the packed first letters.
"""

from __future__ import annotations

import numpy as np

_BITS = 21


def suffix_order(codes: np.ndarray, bits: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(suffixes in order, their ranks, packed first letters in order, how many letters are packed).

    Codes are small integers, 0 the separator. Suffixes are sorted by at least ``depth`` letters.
    """
    n = len(codes)
    packed = 2 * _BITS // bits
    key = np.zeros(n, dtype=np.uint64)
    for k in range(packed):
        key <<= np.uint64(bits)
        key[: max(0, n - k)] |= codes[k:].astype(np.uint64)
    place = np.arange(n, dtype=np.uint64)
    small = n < 1 << _BITS
    reach, letters = packed, key
    while True:
        if small:
            both = np.sort(key << np.uint64(_BITS) | place)
            order = (both & np.uint64((1 << _BITS) - 1)).astype(np.int64)
            ordered = both >> np.uint64(_BITS)
        else:
            order = np.argsort(key, kind="stable")
            ordered = key[order]
        new = np.empty(n, dtype=bool)
        new[0] = True
        np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
        rank = np.empty(n, dtype=np.uint64)
        rank[order] = np.cumsum(new) - 1
        if reach >= depth or new.all():
            break
        step = min(reach, depth - reach)
        later = np.zeros(n, dtype=np.uint64)
        later[: max(0, n - step)] = rank[step:]
        key = rank << np.uint64(_BITS if small else 32) | later
        reach += step
    isa = np.empty(n, dtype=np.int64)
    isa[order] = np.arange(n)
    return order, isa, letters[order], packed


def repeated_starts(text: np.ndarray, length: int) -> np.ndarray:
    """Whether each place of a text starts a string of ``length`` letters that also starts elsewhere in it.

    ``text`` holds letters from 1 to 256; every part of it is ended by a 0, which no string crosses.
    """
    n = len(text)
    letters = np.unique(text)
    letters = letters[letters > 0]
    code = np.zeros(257, dtype=np.uint16)
    code[letters] = np.arange(1, len(letters) + 1)
    codes = code[text]
    bits = max(1, int(len(letters)).bit_length())
    order, isa, packed, known = suffix_order(codes, bits, length + 1)
    first = codes[order]
    before = np.where(order > 0, codes[order - 1], 0)
    front = isa[order - 1]  # place of the suffix one letter longer

    # common prefixes below ``known`` from the packed letters
    lcp = np.full(n + 1, -1, dtype=np.int32)
    lcp[0] = lcp[n] = 0
    differ = packed[1:] ^ packed[:-1]
    apart = np.flatnonzero(differ)
    top = np.floor(np.log2(differ[apart].astype(np.float64))).astype(np.int64)  # at most 42 bits: exact
    lcp[apart + 1] = known - 1 - top // bits
    clean = np.ones(n, dtype=bool)  # suffixes whose packed letters hold no end
    for k in range(known):
        clean &= (packed >> np.uint64(bits * k)) & np.uint64((1 << bits) - 1) > 0

    # strings of ``known`` letters whose place behind got its value last
    start = np.concatenate([[0], apart + 1])
    end = np.concatenate([apart, [n - 1]])
    take = clean[start] & ((lcp[end + 1] == known - 1) | (end == n - 1))
    low, high = start[take], end[take]
    level = known
    while level < length and len(low):
        size = high - low + 1
        parent = np.repeat(np.arange(len(low)), size)
        at = np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(len(parent))
        there = before[at] > 0
        both = np.sort(parent[there].astype(np.uint64) << np.uint64(32) | front[at[there]].astype(np.uint64))
        if not len(both):
            break
        place = (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
        edge = np.flatnonzero((both[1:] >> np.uint64(32) != both[:-1] >> np.uint64(32)) | (first[place[1:]] != first[place[:-1]]))
        low, high = place[np.concatenate([[0], edge + 1])], place[np.concatenate([edge, [len(place) - 1]])]
        fresh = (lcp[high + 1] < 0) | (high == n - 1)
        low, high = low[fresh], high[fresh]
        lcp[high[high < n - 1] + 1] = level
        level += 1

    # a place without a value has a common prefix of ``length`` or more, if neither suffix ends before
    ends = np.flatnonzero(text == 0)
    room = ends[np.searchsorted(ends, order)] - order >= length
    same = np.zeros(n + 1, dtype=bool)
    same[1:n] = ((lcp[1:n] < 0) | (lcp[1:n] >= length)) & room[1:] & room[:-1]
    out = np.zeros(n, dtype=bool)
    out[order] = same[:-1] | same[1:]
    return out
