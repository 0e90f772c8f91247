"""An enhanced suffix array with its common-prefix interval tree, on numpy arrays.

``maximal_repeats`` sorts the suffixes of many short texts by prefix doubling, takes the common
prefix of neighbours from the ranks of the doubling rounds, and scans these lengths with a stack. Each
interval of the tree whose suffixes are preceded by different bytes is a maximal repeat: it can be
extended neither to the left nor to the right, and the interval holds all its occurrences.
"""

from __future__ import annotations

import numpy as np

_UNKNOWN, _DIVERSE = 256, -1


def _rank(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), dtype=np.int64)
    new[1:] = ordered[1:] != ordered[:-1]
    out = np.empty(len(keys), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


def suffix_array(texts: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(suffix starts in order, common prefix with the one before, text of each position, offsets of the texts).

    Suffixes end with their own text; those shorter than ``least`` are left out.
    """
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    offsets = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"".join(texts) + bytes(8), dtype=np.uint8)
    n = int(lengths.sum())
    owner = np.repeat(np.arange(len(texts)), lengths)
    left = np.repeat(offsets + lengths, lengths) - np.arange(n)
    packed = np.zeros(n, dtype=np.uint64)
    for i in range(8):
        packed = (packed << np.uint64(8)) | np.where(left > i, data[i : i + n], 0).astype(np.uint64)
    ranks, width = [(8, _rank(packed))], 8
    longest = int(lengths.max()) if n else 0
    at = np.arange(n)
    while width < longest:
        rank = ranks[-1][1]
        after = np.where(left > width, rank[np.minimum(at + width, n - 1)], 0)
        ranks.append((2 * width, _rank(rank * (n + 1) + after)))
        width *= 2
    starts = np.nonzero(left >= least)[0]
    order = starts[np.argsort(ranks[-1][1][starts])]
    common = np.zeros(len(order), dtype=np.int64)
    if len(order) > 1:
        a, b = order[:-1], order[1:]
        most = np.minimum(left[a], left[b])
        done = np.zeros(len(a), dtype=np.int64)
        for width, rank in reversed(ranks):
            for _ in range(2 if width == ranks[-1][0] else 1):
                fits = done + width <= most
                i, j = np.where(fits, a + done, a), np.where(fits, b + done, b)
                done += np.where(fits & (rank[i] == rank[j]), width, 0)
        for _ in range(7):
            fits = done < most
            i, j = np.where(fits, a + done, a), np.where(fits, b + done, b)
            step = fits & (data[i] == data[j])
            if not step.any():
                break
            done += step
        common[1:] = done
    return order, common, owner, offsets


def maximal_repeats(texts: list[bytes], least: int) -> tuple[np.ndarray, list[tuple[int, int, int]], np.ndarray, np.ndarray]:
    """(suffixes in order, groups (length, first, last) as places of that order, text of each position, offsets).

    A group lists a maximal repeat of at least ``least`` bytes with all its occurrences. What comes before
    the start of a text is unknown and counts as different.
    """
    order, common, owner, offsets = suffix_array(texts, least)
    groups: list[tuple[int, int, int]] = []
    if not len(order):
        return order, groups, owner, offsets
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    before = np.where(np.isin(order, offsets), _UNKNOWN, data[np.maximum(order - 1, 0)].astype(np.int64))
    long = common >= least
    begins = np.nonzero(long & ~np.concatenate(([False], long[:-1])))[0]
    ends = np.nonzero(long & ~np.concatenate((long[1:], [False])))[0]
    for first, last in zip((begins - 1).tolist(), ends.tolist(), strict=True):
        # one run of suffixes that share ``least`` bytes or more
        lcp, codes = common[first + 1 : last + 1].tolist(), before[first : last + 1].tolist()
        stack: list[list[int]] = []  # [length, first suffix, preceding byte]
        for i, value in enumerate([*lcp, 0]):
            code, start = codes[i], i
            code = _DIVERSE if code == _UNKNOWN else code
            while stack and stack[-1][0] > value:
                length, start, known = stack.pop()
                code = code if code == known else _DIVERSE
                if code == _DIVERSE:
                    groups.append((length, first + start, first + i))
            if stack and stack[-1][0] == value:
                stack[-1][2] = code if code == stack[-1][2] else _DIVERSE
            elif value:
                stack.append([value, start, code])
    return order, groups, owner, offsets
