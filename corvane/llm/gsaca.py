"""Suffix array by linear grouping construction.

Phase 1 sorts suffixes into groups by their longest Lyndon prefix: groups are processed in descending
order, and each sends its members' previous smaller suffixes upward, those that more members point to
further. Phase 2 emits the order: from the smallest suffix on, each placed suffix puts the chain of
previous smaller suffixes before it at the front of what is left of their groups. No ranks are renamed
and nothing is sorted again. Every suffix is placed once, and every pointer is followed to a final one.
"""

from __future__ import annotations


def suffix_array(text: str) -> list[int]:
    """The start positions of the suffixes of text in ascending order; a suffix that is a prefix of another is the smaller."""
    n = len(text)
    if not n:
        return []
    # groups by first symbol, linked from the lowest up; each lists its members in ascending order
    members: list[list[int]] = []
    group = [0] * n
    of: dict[str, int] = {}
    for c in sorted(set(text)):
        of[c] = len(members)
        members.append([])
    for i, c in enumerate(text):
        g = of[c]
        group[i] = g
        members[g].append(i)
    below = list(range(-1, len(members) - 1))
    above = [*range(1, len(members)), -1]
    top = len(members) - 1
    prev, done = [-1] * n, bytearray(n)
    g = top
    while g >= 0:
        points: dict[int, int] = {}
        mine = [s for s in members[g] if group[s] == g]
        members[g] = mine
        for s in mine:
            j = s - 1
            while j >= 0 and done[j]:
                j = prev[j]
            prev[s] = j
            done[s] = 1
            if j >= 0:
                points[j] = points.get(j, 0) + 1
        if points:
            made: dict[tuple[int, int], int] = {}
            if len(points) > 1:
                order = sorted(points) if len(set(points.values())) == 1 else sorted(points, key=lambda j: (-points[j], j))
            else:
                order = list(points)
            for j in order:  # those that most point to go first, so that they end up highest
                v, count = group[j], points[j]
                w = made.get((v, count), -1)
                if w < 0:
                    w = made[v, count] = len(members)
                    members.append([])
                    up = above[v]
                    below.append(v)
                    above.append(up)
                    above[v] = w
                    if up >= 0:
                        below[up] = w
                members[w].append(j)
                group[j] = w
        g = below[g]
    # phase 2
    g = group[0]
    while below[g] >= 0:
        g = below[g]
    front, at = [0] * len(members), 0
    while g >= 0:
        front[g] = at
        at += sum(1 for s in members[g] if group[s] == g)
        g = above[g]
    out, placed = [-1] * n, bytearray(n)
    j = n - 1  # before the empty suffix, the smallest of all
    i = -1
    while True:
        while j >= 0 and not placed[j]:
            g = group[j]
            out[front[g]] = j
            front[g] += 1
            placed[j] = 1
            j = prev[j]
        i += 1
        if i == n:
            return out
        j = out[i] - 1
