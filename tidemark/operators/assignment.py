"""One-to-one pairs of sorted times (optimal, in order, closest first), and how many pairs each time offset allows: helpers of one island's two arrays.

Best pairs keep the order of both sides, so a programme over rows (one side) and columns (a prefix of the other) finds
them. Only the columns that a row can be paired with change, so a row costs its band; rows are kept at every root of
their number and the rows between are made again on the way back, so memory is a band times twice that root.
Costs are whole numbers, so that counts and costs compare exactly.
"""

from __future__ import annotations

from heapq import heappop, heappush
from math import isqrt, log2

import numpy as np

#: Larger than any cost.
NEVER = 1 << 62


def _row(state: tuple[int, np.ndarray], x: int, g: np.ndarray, low: int, high: int, bonus: int, skip: bool) -> tuple[np.ndarray, np.ndarray]:
    """Values of the row before at columns low to high, and of the row of x: at a column its first so many of g are free to be taken."""
    start, known = state
    before = known[low - start : high - start + 1]
    if len(before) < high - low + 1:  # beyond its band a row's values stay
        before = np.concatenate([before, np.full(high - low + 1 - len(before), known[-1])])
    now = np.empty(high - low + 1, np.int64)
    now[0] = before[0] if skip else NEVER
    now[1:] = before[:-1] + np.abs(x - g[low:high]) - bonus
    if skip:
        np.minimum(now[1:], before[1:], out=now[1:])
    return before, np.minimum.accumulate(now)


def _partners(d: np.ndarray, g: np.ndarray, low: np.ndarray, high: np.ndarray, bonus: int, skip: bool) -> list[tuple[int, int]]:
    """Pairs of least cost, each pair worth the bonus; row i may take columns low[i] to high[i] - 1, or (skip) none.

    Of equal costs a column is left out before a row, and a row before a pair is made, from the last on.
    """
    n = len(d)
    step = isqrt(n) + 1
    first = (0, np.zeros(1 if skip else high[0], np.int64))
    kept, state = [], first
    for i in range(n):
        if i % step == 0:
            kept.append(state)
        if high[i] > low[i]:
            state = int(low[i]), _row(state, d[i], g, low[i], high[i], bonus, skip)[1]
    pairs, column = [], len(g)
    for block in range(len(kept) - 1, -1, -1):
        state, rows = kept[block], range(block * step, min(n, (block + 1) * step))
        choices = []
        for i in rows:
            if high[i] == low[i]:
                choices.append(None)
                continue
            before, now = _row(state, d[i], g, low[i], high[i], bonus, skip)
            left, stay = now[1:] == now[:-1], (now[1:] == before[1:]) & skip
            choices.append(np.where(left, 1, np.where(stay, 2, 3)).astype(np.int8))
            state = int(low[i]), now
        for i in reversed(rows):
            if choices[i - rows[0]] is None:
                continue
            column = min(column, int(high[i]))
            at, own = column - int(low[i]) - 1, choices[i - rows[0]]
            while at >= 0 and own[at] == 1:
                at -= 1
            if at < 0:
                column = min(column, int(low[i]))
            else:
                column = int(low[i]) + at + 1
                if own[at] == 3:
                    column -= 1
                    pairs.append((i, column))
    return pairs[::-1]


def _whole(times: np.ndarray, start: float, reach: float, n: int) -> np.ndarray:
    """Times from the start on, in units so small that n costs of at most `reach`, each n times a bonus, stay below 2^61."""
    bits = max(0, min(30, int(60 - log2((reach + 1) * (n + 1) ** 2))))
    return np.rint((times - start) * (1 << bits)).astype(np.int64)


def bands(d: np.ndarray, g: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """For each of d the first of g within the tolerance and the first beyond, by the difference itself."""
    low, high = np.searchsorted(g, d - tolerance), np.searchsorted(g, d + tolerance, "right")
    for _ in range(2):  # sums may round otherwise than differences do
        wider = (low > 0) & (np.abs(d - g[low - 1]) <= tolerance)
        low = np.where(wider, low - 1, low)
        wider = (high < len(g)) & (np.abs(d - g[np.minimum(high, len(g) - 1)]) <= tolerance)
        high = np.where(wider, high + 1, high)
        low = np.where((low < high) & (np.abs(d - g[np.minimum(low, len(g) - 1)]) > tolerance), low + 1, low)
        high = np.where((high > low) & (np.abs(d - g[high - 1]) > tolerance), high - 1, high)
    return low, np.maximum(low, high)


def assign(d: np.ndarray, g: np.ndarray, tolerance: float, most: bool) -> list[tuple[int, int]]:
    """Pairs by place in two sorted arrays. most: the most pairs within the tolerance, then the least total distance; else
    the least total distance with all of the smaller side paired, however far."""
    n, m = len(d), len(g)
    if not n or not m:
        return []
    if not most and n > m:
        return [(i, j) for j, i in assign(g, d, tolerance, most)]
    start, end = min(d[0], g[0]), max(d[-1], g[-1])
    reach = tolerance if most else float(end - start)
    x, y = (_whole(t, start, reach, min(n, m)) for t in (d, g))
    if most:
        low, high = bands(d, g, tolerance)
        far = int(np.abs(x - y[np.clip(low, 0, m - 1)]).max(initial=0, where=high > low))
        far = max(far, int(np.abs(x - y[np.clip(high - 1, 0, m - 1)]).max(initial=0, where=high > low)))
        return _partners(x, y, low, high, far * min(n, m) + 1, True)
    low = np.arange(n)
    return _partners(x, y, low, low + m - n + 1, 0, False)


def pair_counts(d: np.ndarray, g: np.ndarray, offsets: np.ndarray, tolerance: float) -> np.ndarray:
    """The most pairs within the tolerance when each of the (ascending) offsets is taken off d.

    The count can change only where an offset passes a difference of the two sides, more or less the tolerance; offsets
    between two such break points are counted once. All offsets left walk through the sorted sides together, first come, first paired.
    """
    made = np.zeros(len(offsets), np.int64)
    if not len(d) or not len(g) or not len(offsets):
        return made
    if len(d) * len(g) <= 4 * len(offsets):
        apart = (d[:, None] - g[None, :]).ravel()
        breaks = np.unique(np.concatenate([[0], np.searchsorted(offsets, apart - tolerance), np.searchsorted(offsets, apart + tolerance, "right")]))
        breaks = breaks[breaks < len(offsets)]
        if np.asarray(offsets).dtype.kind == "f":  # where sums round otherwise than differences do
            breaks = np.unique(np.clip(np.concatenate([breaks - 1, breaks, breaks + 1]), 0, len(offsets) - 1))
    else:
        breaks = np.arange(len(offsets))
    shift, counts = offsets[breaks], np.zeros(len(breaks), np.int64)
    i, j, live = np.zeros(len(breaks), np.int64), np.zeros(len(breaks), np.int64), np.arange(len(breaks))
    while len(live):
        apart = d[i] - shift - g[j]
        pair = np.abs(apart) <= tolerance
        counts[live] += pair
        late = apart > 0
        i, j = i + (pair | ~late), j + (pair | late)
        inside = (i < len(d)) & (j < len(g))
        if not inside.all():
            i, j, shift, live = i[inside], j[inside], shift[inside], live[inside]
    return counts[np.searchsorted(breaks, np.arange(len(offsets)), "right") - 1]


class Free:
    """Places that are not taken yet; finding the next one on a side costs next to nothing, as what was passed over is not looked at again."""

    def __init__(self, n: int):
        self.after, self.before = list(range(n + 1)), list(range(n + 1))  # before: by place + 1, so that 0 is none

    @staticmethod
    def _found(links: list[int], at: int) -> int:
        end = at
        while links[end] != end:
            end = links[end]
        while links[at] != end:
            links[at], at = end, links[at]
        return end

    def next(self, at: int) -> int:
        """The first free place from there on; n if there is none."""
        return self._found(self.after, at)

    def last(self, at: int) -> int:
        """The last free place up to there; -1 if there is none."""
        return self._found(self.before, at + 1) - 1

    def take(self, at: int) -> None:
        self.after[at] = at + 1
        self.before[at + 1] = at


def greedy(d: np.ndarray, g: np.ndarray, tolerance: float, first: bool = False) -> list[tuple[int, int]]:
    """Pairs by place: each of d, in order, takes the nearest of g not yet taken within the tolerance (first: the earliest); of two as near the earlier."""
    if not len(d) or not len(g):
        return []
    low, _ = bands(d, g, tolerance)
    middle = np.searchsorted(g, d).tolist()
    free, made, m, g = Free(len(g)), [], len(g), g.tolist()
    for i, (x, start, at) in enumerate(zip(d.tolist(), low.tolist(), middle, strict=True)):
        if first:
            j = free.next(start)
        else:
            j, left = free.next(at), free.last(at - 1)
            if left >= 0 and (j == m or x - g[left] <= g[j] - x):
                j = left
        if j < m and abs(x - g[j]) <= tolerance:
            free.take(j)
            made.append((i, j))
    return made


def closest(d: np.ndarray, g: np.ndarray, tolerance: float) -> list[tuple[int, int]]:
    """Pairs by place: the closest of all first, of equals that of the first of d, then of g; each place once.

    The closest pair of those left has nothing left between its two, so only neighbours in the order of both sides
    are looked at: a queue of neighbours, to which what closes up is added.
    """
    n = len(d)
    times = np.concatenate([d, g])
    order = np.lexsort((np.arange(len(times)), times)).tolist()  # of equal times d before g
    times = times.tolist()
    left, right = list(range(-1, len(order) - 1)), list(range(1, len(order) + 1))

    def near(a: int, b: int) -> None:
        if a < 0 or b >= len(order) or (order[a] < n) == (order[b] < n):
            return
        i, j = min(order[a], order[b]), max(order[a], order[b])
        if (gap := abs(times[i] - times[j])) <= tolerance:
            heappush(queue, (gap, i, j, a, b))

    queue: list[tuple] = []
    for at in range(len(order) - 1):
        near(at, at + 1)
    gone, made = bytearray(len(order)), []
    while queue:
        _, i, j, a, b = heappop(queue)
        if gone[a] or gone[b]:
            continue
        gone[a] = gone[b] = 1
        made.append((i, j - n))
        before, after = left[a], right[b]
        if before >= 0:
            right[before] = after
        if after < len(order):
            left[after] = before
        near(before, after)
    return made
