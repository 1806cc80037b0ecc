"""Bin completion for items of whole-number sizes, many of each size.

The problem is a histogram: how many items there are of each size.  A bin is filled by
taking the largest item left and completing it with a filling that no other filling
dominates; the same filling is used as often as its items last.  Best-fit decreasing gives
the first incumbent and, at every node, a solution of what is left.  A node is cut off
when the waste it has already made leaves no way to beat the incumbent.

Fillings have as many items as fit and come by waste, least first, read off the reachable
sums; wastes are told apart as finely as ``GRAINS`` says, in one search after the other.  A filling may also be used fewer times (halved, down to once), so every solution can
be reached.  Nodes are taken by how often they depart from the first choice (limited
discrepancy), deepest first.  The search stops at the lower bound, when nothing is left to
try (the solution is then optimal), or when ``budget`` steps are spent, with the best
solution found.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import islice

#: A filling, largest size first, and how many bins have it.
Pattern = tuple[tuple[int, ...], int]
#: Steps of a search: sizes looked at, at every node and for every filling.
BUDGET = 6_000_000
#: Orders in which fillings come, one search for each: wastes that differ by less count as
#: the same, and of those the filling with the larger items comes first.
GRAINS = (1, 8, 32, 64, 128, 256)


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing; bins that are filled alike are handled together."""
    open_: dict[int, list[list]] = {}  # room left -> [[sizes, bins], ...]
    rooms: list[int] = []  # the keys of open_, ascending
    full: list[Pattern] = []

    def put(sizes: tuple[int, ...], bins: int, room: int) -> None:
        if room == 0:
            full.append((sizes, bins))
        else:
            if room not in open_:
                insort(rooms, room)
                open_[room] = []
            open_[room].append([sizes, bins])

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                per_bin = capacity // size
                whole, rest = divmod(left, per_bin)
                if whole:
                    put((size,) * per_bin, whole, capacity - size * per_bin)
                if rest:
                    put((size,) * rest, 1, capacity - size * rest)
                break
            room = rooms[at]
            group = open_[room][-1]
            # as many of this size as the room takes, bin by bin
            per_bin = room // size
            whole = min(group[1], left // per_bin)
            if not whole:
                per_bin, whole = left, 1
            group[1] -= whole
            if not group[1]:
                open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            left -= per_bin * whole
            put(group[0] + (size,) * per_bin, whole, room - size * per_bin)
    return full + [(g[0], g[1]) for groups in open_.values() for g in groups]


def bins_of(patterns: list[Pattern]) -> int:
    return sum(n for _, n in patterns)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """By volume, and by items over half a bin together with those that fit beside none of them."""
    total = sum(s * n for s, n in counts.items())
    best = -(-total // capacity)
    for k in sorted({s for s in counts if 2 * s <= capacity} | {1}):
        alone = sum(n for s, n in counts.items() if s > capacity - k)
        half = [(s, n) for s, n in counts.items() if capacity - k >= s > capacity / 2]
        small = sum(s * n for s, n in counts.items() if k <= s <= capacity / 2)
        beside = sum(n for _, n in half) * capacity - sum(s * n for s, n in half)
        bound = alone + sum(n for _, n in half) + max(0, -(-(small - beside) // capacity))
        best = max(best, bound)
    return best


class Work:
    """What is left of a search's budget."""

    def __init__(self, steps: int) -> None:
        self.left = steps


def reachable(sizes: list[int], counts: dict[int, int], room: int) -> list[int]:
    """For every place in ``sizes``: the sums up to ``room`` of items from there on, as bits."""
    mask = (1 << room + 1) - 1
    sums = [1]
    for s in reversed(sizes):
        bits, left, step = sums[-1], min(counts[s], room // s), 1
        while left:
            take = min(step, left)
            bits |= bits << take * s & mask
            left -= take
            step *= 2
        sums.append(bits)
    return sums[::-1]


def dominated(chosen: tuple[int, ...], waste: int, spare: int) -> bool:
    """Whether an item of the sizes in ``spare`` (bits) fits into the waste or could take the place of some items.

    It is larger than they are together and still fits, or as large as several of them.
    """
    one = several = 0
    for s in chosen:
        several |= (several | one) << s
        one |= 1 << s
    if several & spare:
        return True
    above, width = (1 | one | several) << 1, 1  # sums plus 1 to ``width``
    while width < waste:
        step = min(width, waste - width)
        above |= above << step
        width += step
    return waste > 0 and bool(above & spare)


def fillings(
    counts: dict[int, int], room: int, most_waste: int, work: Work, grain: int = 1
) -> Iterator[tuple[tuple[int, ...], int]]:
    """Undominated fillings of ``room`` with their waste, least waste first, as long as there is work left."""
    sizes = sorted((s for s, n in counts.items() if n and s <= room), reverse=True)
    ascending = [-s for s in sizes]
    sums = reachable(sizes, counts, room)
    here = sum(1 << s for s in sizes)
    work.left -= len(sizes)

    def within(bits: int, low: int, high: int) -> int:
        """The bits of sums between ``low`` and ``high``."""
        return bits >> max(low, 0) & (1 << high - max(low, 0) + 1) - 1

    def between(at: int, low: int, high: int) -> Iterator[tuple[int, ...]]:
        """Items from place ``at`` on with a sum from ``low`` to ``high``, larger ones first; no step leads nowhere."""
        for i in range(bisect_left(ascending, -high, at), len(sizes)):
            work.left -= 1
            if work.left < 0:
                return
            if not within(sums[i], low, high):
                break
            s = sizes[i]
            for n in range(min(counts[s], high // s), 0, -1):
                work.left -= 1
                if work.left < 0:
                    return
                if within(sums[i + 1], low - n * s, high - n * s):
                    for rest in between(i + 1, low - n * s, high - n * s):
                        yield (s,) * n + rest
        if low <= 0:
            yield ()

    for least in range(0, min(room, most_waste) + 1, grain):
        low = room - min(least + grain - 1, room, most_waste)
        if not within(sums[0], low, room - least):
            continue
        for chosen in between(0, low, room - least):
            waste = room - sum(chosen)
            work.left -= len(chosen)
            used_up = sum(1 << s for s, n in Counter(chosen).items() if n == counts[s])
            if not dominated(chosen, waste, here ^ used_up):
                yield chosen, waste
        if work.left < 0:
            return


def steps(left: dict[int, int], capacity: int, most_waste: int, work: Work, grain: int) -> Iterator[tuple[tuple[int, ...], int, int]]:
    """Ways to go on with the largest item left: a filling with it, its number of bins, the waste made."""
    top = max(left)
    for chosen, waste in fillings({**left, top: left[top] - 1}, capacity - top, most_waste, work, grain):
        items = (top, *chosen)
        times = min(left[s] // n for s, n in Counter(items).items())
        while times:
            if times * waste <= most_waste:
                yield items, times, times * waste
            times //= 2


def search(counts: dict[int, int], capacity: int, best: list[Pattern], goal: int, work: Work, grain: int) -> list[Pattern]:
    """``best`` or a better solution; the best there is if work is left."""
    total = sum(s * n for s, n in counts.items())
    # each entry: departures from the first choice, -depth, order, patterns so far (linked),
    # their bins and waste, and the next way to go on.  What is left is counted anew from
    # the patterns, so that an entry is small.
    heap = [(0, 0, 0, None, 0, 0, 0)]
    order = 0
    while heap and work.left >= 0 and bins_of(best) > goal:
        departures, depth, _, path, bins, waste, nth = heappop(heap)
        # with more waste it needs as many bins as the incumbent
        most_waste = (bins_of(best) - 1) * capacity - total - waste
        if most_waste < 0:
            continue
        made, left, link = [], dict(counts), path
        while link:
            (items, times), link = link
            made.append((items, times))
            for s, n in Counter(items).items():
                left[s] -= n * times
        left = {s: n for s, n in left.items() if n}
        work.left -= len(counts)
        if not nth:
            rest = best_fit(left, capacity)
            if bins + bins_of(rest) < bins_of(best):
                best = [*reversed(made), *rest]
                most_waste = (bins_of(best) - 1) * capacity - total - waste
        if not left:
            continue
        for items, times, spent in islice(steps(left, capacity, most_waste, work, grain), nth, nth + 1):
            order += 1
            heappush(heap, (departures, depth - 1, order, ((items, times), path), bins + times, waste + spent, 0))
            order += 1
            heappush(heap, (departures + 1, depth, order, path, bins, waste, nth + 1))
    return best


def bin_completion(counts: dict[int, int], capacity: int, budget: int = BUDGET) -> list[Pattern]:
    """Fillings with their numbers of bins that hold every item, in as few bins as found."""
    counts = {s: n for s, n in counts.items() if n}
    if any(not 0 < s <= capacity for s in counts):
        raise ValueError("sizes must lie between 1 and the capacity")
    best = best_fit(counts, capacity)
    goal = lower_bound(counts, capacity)
    for grain in GRAINS:
        if bins_of(best) == goal:
            break
        work = Work(budget // len(GRAINS))
        best = search(counts, capacity, best, goal, work, grain)
        if work.left >= 0:
            break  # nothing is left to try
    return best
