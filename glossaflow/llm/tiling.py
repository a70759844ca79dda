"""Greedy string tiling: two sequences of words covered by their longest common runs, each word once.

Runs of 1, 2, 4, ... words are numbered by pairing the numbers of their halves, so that a run of any length is known by two
numbers and compared in constant time, without collisions. The longest length that still has a free common run is found by
bisection (a common run of n words holds one of n - 1), then all runs of that length are taken from left to right. Lengths fall
strictly, and the sum of the taken runs is at most the shorter text, so there are at most about the square root of its length
of them; texts of any size are tiled by the same rule.
"""

from __future__ import annotations

from collections.abc import Sequence


def greedy_tiles(a: Sequence[str], b: Sequence[str], least: int = 2) -> list[tuple[int, int, int]]:
    """(start in a, start in b, length) of the tiles of ``least`` words and more, longest first, then leftmost in a and b."""
    if len(a) < least or len(b) < least:
        return []
    names = [_named(a, b, {}, 1, None)]
    free_a, free_b = _Free(len(a)), _Free(len(b))
    tiles: list[tuple[int, int, int]] = []
    most = min(len(a), len(b))

    def runs(side: int, size: int) -> list:
        """Name of the run of ``size`` words at every start of a side."""
        power = size.bit_length() - 1
        while len(names) <= power:
            half = 1 << (len(names) - 1)
            names.append(_named(None, None, {}, half, names[-1]))
        own, rest = names[power][side], size - (1 << power)
        return own if not rest else list(zip(own, own[rest:]))

    def common(size: int) -> bool:
        in_b = {run for j, run in enumerate(runs(1, size)) if free_b.whole(j, size)}
        return any(run in in_b and free_a.whole(i, size) for i, run in enumerate(runs(0, size)))

    while most >= least:
        low, high = least - 1, most
        while low < high:
            middle = (low + high + 1) // 2
            if common(middle):
                low = middle
            else:
                high = middle - 1
        if low < least:
            break
        size = low
        places: dict = {}
        for j, run in enumerate(runs(1, size)):
            if free_b.whole(j, size):
                places.setdefault(run, []).append(j)
        at = {run: iter(js) for run, js in places.items()}
        i, own = 0, runs(0, size)
        while i < len(own):
            if own[i] in at and free_a.whole(i, size):
                j = next((j for j in at[own[i]] if free_b.whole(j, size)), None)
                if j is not None:
                    free_a.take(i, size)
                    free_b.take(j, size)
                    tiles.append((i, j, size))
                    i += size
                    continue
            i += 1
        most = size - 1
    return sorted(tiles)


class _Free:
    """Which words are free, and at each of them how many free words follow; kept up to date by each run taken."""

    def __init__(self, n: int) -> None:
        self.ahead = list(range(n, 0, -1))

    def whole(self, start: int, size: int) -> bool:
        return self.ahead[start] >= size

    def take(self, start: int, size: int) -> None:
        ahead = self.ahead
        ahead[start : start + size] = [0] * size
        before = start - 1
        while before >= 0 and ahead[before]:
            ahead[before] = start - before
            before -= 1


def _named(a, b, known: dict, half: int, halves) -> tuple[list[int], list[int]]:
    """Numbers of the runs of 2 x ``half`` words of both sides out of those of ``half`` (of single words without them)."""
    out = []
    for side, words in enumerate((a, b)):
        keys = words if halves is None else zip(halves[side], halves[side][half:])
        out.append([known.setdefault(k, len(known)) for k in keys])
    return out[0], out[1]
