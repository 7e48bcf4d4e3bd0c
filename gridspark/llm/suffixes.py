"""Linear suffix sorting by Lyndon groups: no recursion, no renaming.

Phase 1 sorts suffixes by their Lyndon prefix. Groups start as one per symbol and are taken from the highest to the
lowest. For each suffix of the group, the nearest position to the left in a lower group (found by jumping along
previous-smaller pointers) gets its prefix extended by the group's prefix; those positions leave their group for new
groups just above it, more repeats higher. Phase 2 scans the order from the smallest suffix up and emits, into the
next free place of its group, every suffix whose next smaller suffix is the one just read.
"""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes of `text` in ascending order; integers of any size as symbols, [] gives []."""
    n = len(text)
    if n < 2:
        return list(range(n))
    # Initial groups: one per symbol. order lists suffixes by group, at is its inverse, first[i] the start of i's group.
    places: dict[int, list[int]] = {}
    for i, x in enumerate(text):
        if x in places:
            places[x].append(i)
        else:
            places[x] = [i]
    order: list[int] = []
    first = [0] * n
    end: dict[int, int] = {}
    for x in sorted(places):
        s = len(order)
        for i in places[x]:
            first[i] = s
        order += places[x]
        end[s] = len(order)
    at = [0] * n
    for k, i in enumerate(order):
        at[i] = k
    before = [-1] * n
    top = n
    while top > 0:
        low = first[order[top - 1]]
        if top - low == 1:
            # One suffix: the common case, kept short.
            i = order[low]
            j = i - 1
            while j >= 0 and first[j] > low:
                j = before[j]
            before[i] = j
            if j >= 0:
                s = first[j]
                e = end[s] - 1
                if e > s:
                    k = at[j]
                    o = order[e]
                    order[k] = o
                    at[o] = k
                    order[e] = j
                    at[j] = e
                    end[s] = e
                    first[j] = e
                    end[e] = e + 1
            top = low
            continue
        members = order[low:top]
        members.sort()
        count: dict[int, int] = {}
        last = -1
        for i in members:
            j = i - 1
            while j >= 0 and first[j] > low:
                j = before[j]
            if j >= 0 and first[j] == low:
                j = before[last]  # the member to the left has the same previous smaller
            before[i] = j
            last = i
            if j >= 0:
                count[j] = count.get(j, 0) + 1
        top = low
        if not count:
            continue
        if max(count.values()) == 1:
            classes = [list(count)]
        else:
            by: dict[int, list[int]] = {}
            for j, m in count.items():
                by.setdefault(m, []).append(j)
            classes = [by[m] for m in sorted(by, reverse=True)]
        for moved in classes:
            edges: dict[int, int] = {}
            for j in moved:
                s = first[j]
                e = edges.get(s)
                if e is None:
                    e = end[s]
                e -= 1
                edges[s] = e
                k = at[j]
                o = order[e]
                order[k] = o
                at[o] = k
                order[e] = j
                at[j] = e
            for s, e in edges.items():
                stop = end[s]
                if e > s:
                    end[s] = e
                    end[e] = stop
                    for k in range(e, stop):
                        first[order[k]] = e
    # Phase 2.
    free = list(range(n))
    out = [-1] * n
    done = bytearray(n)
    i = n - 1
    out[first[i]] = i
    free[first[i]] += 1
    done[i] = 1
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not done[j]:
            s = first[j]
            out[free[s]] = j
            free[s] += 1
            done[j] = 1
            j = before[j]
    return out
