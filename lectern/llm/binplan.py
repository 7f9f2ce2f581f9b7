"""Bin completion over a histogram of lengths.

The state is how many items of each length remain, so the work depends on the number of different lengths (at most the
capacity), not on the number of documents. A plan is a list of (pattern, bins): so many bins filled by that pattern.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

Plan = list[tuple[tuple[int, ...], int]]


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing, many equal items and equal bins at a time."""
    open_bins: dict[int, list[list]] = {}  # free space -> [pattern, bins]
    frees: list[int] = []

    def put(free: int, pattern: tuple[int, ...], bins: int) -> None:
        if free not in open_bins:
            open_bins[free] = []
            frees.insert(bisect_left(frees, free), free)
        open_bins[free].append([pattern, bins])

    for length in sorted((x for x, n in counts.items() if n > 0), reverse=True):
        left = counts[length]
        while left:
            i = bisect_left(frees, length)
            if i == len(frees):
                each = capacity // length
                if full := left // each:
                    put(capacity - each * length, (length,) * each, full)
                if rest := left % each:
                    put(capacity - rest * length, (length,) * rest, 1)
                break
            free = frees[i]
            group = open_bins[free][-1]
            each = min(free // length, left)
            bins = min(group[1], left // each)
            group[1] -= bins
            if not group[1]:
                open_bins[free].pop()
                if not open_bins[free]:
                    del open_bins[free]
                    frees.pop(i)
            put(free - each * length, group[0] + (length,) * each, bins)
            left -= bins * each
    return [(p, n) for groups in open_bins.values() for p, n in groups]


def dominated(a: tuple[int, ...], b: tuple[int, ...], steps: int = 200) -> bool:
    """Whether filling ``a`` splits into parts that fit one by one into the items of ``b``: then ``b`` is at least as good.

    Items that both hold may stay for themselves, so only the others are placed. False where ``steps`` don't settle it.
    """
    if sum(a) > sum(b):
        return False
    if sum(a) == sum(b) and len(a) <= len(b):
        return a == b  # every item of b needs a part that fills it
    mine, others = Counter(a), Counter(b)
    rest, rooms = sorted((mine - others).elements(), reverse=True), sorted((others - mine).elements())
    todo = steps

    def place(i: int) -> bool:
        nonlocal todo
        todo -= 1
        if i == len(rest):
            return True
        tried = set()
        for k, room in enumerate(rooms):
            if room >= rest[i] and room not in tried and todo > 0:
                tried.add(room)
                rooms[k] -= rest[i]
                if place(i + 1):
                    return True
                rooms[k] += rest[i]
        return False

    return place(0)


class Sums:
    """Bitmaps of the sums up to ``room`` that items can make: ``reach[i]`` of the i smallest lengths.

    They hold for the counts given and, as an upper bound, for any smaller ones.
    """

    def __init__(self, lengths: list[int], counts: dict[int, int], room: int):
        self.lengths = lengths.copy()
        self.reach = [1]
        mask = (2 << room) - 1
        for x in lengths:
            bits, n, k = self.reach[-1], min(counts[x], room // x), 1
            while n > 0 and bits != mask:
                bits |= bits << x * min(k, n) & mask
                n, k = n - k, 2 * k
            self.reach.append(bits)


def fillings(sums: Sums, counts: dict[int, int], room: int, most: int, steps: int, width: int, waste: int) -> list[tuple[int, ...]]:
    """Undominated maximal fillings of ``room`` that leave at most ``waste`` free, the least waste and largest items first.

    For each sum that the bitmaps allow, the largest first, lengths are gone through downwards, and of each as many copies
    as leave a sum that smaller ones can make. So a filling costs a step for each length in it, however many items it has,
    and where the bitmaps are exact no step is in vain. An item that fills what is left exactly ends its branch, as it
    dominates all else that could stand there. The list is complete where it ends within ``steps`` and ``width``.
    """
    lengths, reach, kept, todo = sums.lengths, sums.reach, [], steps

    def take(filling: tuple[int, ...], free: int) -> None:
        upto = bisect_right(lengths, free)
        if any(counts[x] > filling.count(x) for x in lengths[:upto]):
            return  # not maximal
        if not any(dominated(filling, k) for k in kept):
            kept.append(filling)

    def grow(taken: tuple[int, ...], left: int, upto: int, free: int) -> None:
        nonlocal todo
        if not left:
            take(taken, free)
            return
        i = bisect_right(lengths, left, 0, upto)
        if i and lengths[i - 1] == left and counts[left]:
            take((*taken, left), free)
            return
        while i and reach[i] >> left & 1:
            i -= 1
            x = lengths[i]
            for n in range(min(counts[x], left // x), 0, -1):
                if reach[i] >> left - n * x & 1:
                    if todo <= 0 or len(kept) >= width:
                        return
                    todo -= 1
                    grow(taken + (x,) * n, left - n * x, i, free)

    top = bisect_right(lengths, min(room, most))
    bits = reach[top] & (2 << room) - 1
    while bits and todo > 0 and len(kept) < width:
        total = bits.bit_length() - 1
        if room - total > waste:
            break
        grow((), total, top, room - total)
        bits ^= 1 << total
        todo -= 1
    return kept


def plan_bins(counts: dict[int, int], capacity: int, nodes: int = 20_000, steps: int = 300, width: int = 8) -> Plan:
    """Fewest bins found for the histogram.

    Best-fit decreasing gives the incumbent. The search fills bins around the largest item left: it lists undominated
    fillings of the room beside it, tries them in order of waste, and cuts a branch once the waste so far leaves no room for
    a better total (or, until it has a plan of its own, an equal one). A filling is used for as many bins as its items allow
    at once, so the first plan takes a few nodes a length; from there the search goes back from the leaves. It ends with a
    plan of its own at the volume bound, else after ``nodes`` nodes with the best plan known.

    Every item is packed whatever the limits are. They bound how much of the tree is seen: ``steps`` of enumeration and
    ``width`` fillings at a node, ``nodes`` nodes, 200 steps of a test for dominance. So the plan is proven optimal where it
    meets the bound, and else at most as large as best-fit decreasing's. Bitmaps are made anew whenever a sixty-fourth of
    the lengths may have run out.
    """
    counts = {int(k): int(n) for k, n in counts.items() if n > 0}
    if any(k < 1 or k > capacity for k in counts):
        raise ValueError("lengths must lie between 1 and the capacity")
    total = sum(k * n for k, n in counts.items())
    bound = max(-(-total // capacity), sum(n for k, n in counts.items() if 2 * k > capacity))
    best, own = best_fit(counts, capacity), False
    size = sum(n for _, n in best)
    left, lengths = dict(counts), sorted(counts)
    plan: Plan = []
    bins = waste = 0

    def put(pattern: tuple[int, ...], times: int) -> None:
        """Packs so many bins (or, below 0, takes them out again)."""
        nonlocal bins, waste
        for x, n in Counter(pattern).items():
            had = left[x]
            left[x] = had - n * times
            if had and not left[x]:
                del lengths[bisect_left(lengths, x)]
            elif left[x] and not had:
                lengths.insert(bisect_left(lengths, x), x)
        bins, waste = bins + times, waste + (capacity - sum(pattern)) * times

    def choices(sums: Sums | None, age: int) -> tuple[Iterator[tuple[int, ...]], Sums, int]:
        """The patterns of the next bin, the largest item left with an undominated filling beside it, and the bitmaps used."""
        if sums is None or age >= max(1, len(lengths) // 64):
            sums, age = Sums(lengths, left, capacity), 0
        large = lengths[-1]
        left[large] -= 1
        found = fillings(sums, left, capacity - large, large, steps, width, (size - own) * capacity - total - waste)
        left[large] += 1
        return iter([(large, *f) for f in found]), sums, age + 1

    frames = [choices(None, 0)] if lengths else []
    while frames and (size > bound or not own):
        allowed = (size - own) * capacity - total - waste  # what may still be left free, if this is to be kept
        pattern = next(frames[-1][0], None) if allowed >= 0 and nodes >= 0 else None
        if pattern is None:
            frames.pop()
            if plan:
                done, times = plan.pop()
                put(done, -times)
            continue
        free = capacity - sum(pattern)
        times = min(left[x] // n for x, n in Counter(pattern).items())
        if free * times > allowed:
            times = max(1, allowed // free)
        if free * times > allowed:
            continue
        put(pattern, times)
        plan.append((pattern, times))
        nodes -= 1
        if lengths:
            frames.append(choices(*frames[-1][1:]))
            continue
        if bins < size or not own and bins == size:
            best, size, own = plan.copy(), bins, True
        put(*plan.pop()[:1], -times)
    return best
