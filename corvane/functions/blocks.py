"""Longest-matching-block comparison of two sequences, in memory that grows with their length.

The longest block that both have is taken first (of equal ones the earliest in the first sequence, then in the second), then what lies left
and right of it by itself. A block is found by an automaton of all substrings of the second sequence's stretch, which the
first one's is read through once; it knows where each substring ends first. So a stretch takes time and memory by its length,
however often its elements repeat.
"""

from __future__ import annotations

from collections.abc import Sequence


def substrings(b: Sequence, low: int, high: int) -> tuple[list[dict], list[int], list[int], list[int]]:
    """The automaton of the substrings of b[low:high]: steps, suffix links, longest lengths and first ends of its states."""
    steps, link, longest, ends = [{}], [-1], [0], [low]
    last = 0
    for at in range(low, high):
        x, now = b[at], len(steps)
        steps.append({})
        link.append(0)
        longest.append(longest[last] + 1)
        ends.append(at + 1)
        state = last
        while state >= 0 and x not in steps[state]:
            steps[state][x] = now
            state = link[state]
        if state >= 0:
            to = steps[state][x]
            if longest[to] != longest[state] + 1:  # the shorter strings of that state part from the longer ones
                part = len(steps)
                steps.append(steps[to].copy())
                link.append(link[to])
                longest.append(longest[state] + 1)
                ends.append(ends[to])
                link[to] = part
                while state >= 0 and steps[state].get(x) == to:
                    steps[state][x] = part
                    state = link[state]
                to = part
            link[now] = to
        last = now
    return steps, link, longest, ends


#: The least piece that a long block is looked for by, characters that may be looked through for each of the stretches' (as much work as an automaton's), and meetings of pieces, for each piece.
PIECE, LOOKS, MEETINGS = 8, 400, 4


def _alike(a: str, b: str, i: int, j: int, most: int) -> int:
    """How many characters from a[i] and b[j] on are equal, at most `most`."""
    n, step = 0, 16
    while n < most:
        step = min(step, most - n)
        if a[i + n : i + n + step] == b[j + n : j + n + step]:
            n, step = n + step, 2 * step
        elif step == 1:
            break
        else:
            step = max(step // 4, 1)
    return n


def _alike_before(a: str, b: str, i: int, j: int, most: int) -> int:
    """The same of what ends before a[i] and b[j]."""
    n, step = 0, 16
    while n < most:
        step = min(step, most - n)
        if a[i - n - step : i - n] == b[j - n - step : j - n]:
            n, step = n + step, 2 * step
        elif step == 1:
            break
        else:
            step = max(step // 4, 1)
    return n


def _long_block(a: str, b: str, a0: int, a1: int, b0: int, b1: int) -> tuple[int, int, int] | None:
    """longest_block() of two texts, or None where no block is long enough, or where its pieces meet too often, to be told by them.

    A block of 2 * size - 1 characters holds a whole piece a[a0 + k * size : a0 + (k + 1) * size], so once the longest block that holds one is as long, no other is longer, and of equal ones none is missed.
    """
    size = min(a1 - a0, b1 - b0)
    budget = LOOKS * (a1 - a0 + b1 - b0)
    while size >= PIECE:
        pieces = (a1 - a0) // size
        budget -= pieces * (b1 - b0)
        if budget < 0:
            return None
        best, left = (0, 0, 0), MEETINGS * pieces + 64
        for at in range(a0, a1 - size + 1, size):
            piece, j = a[at : at + size], b0 - 1
            while (j := b.find(piece, j + 1, b1)) >= 0:
                left -= 1
                if left < 0:
                    return None
                back = _alike_before(a, b, at, j, min(at - a0, j - b0))
                n = back + size + _alike(a, b, at + size, j + size, min(a1 - at, b1 - j) - size)
                best = min(best, (-n, at - back, j - back))
        if -best[0] >= 2 * size - 1:
            return best[1], best[2], -best[0]
        size //= 2
    return None


def longest_block(a: Sequence, b: Sequence, a0: int, a1: int, b0: int, b1: int) -> tuple[int, int, int]:
    """(i, j, n) of the longest block a[i:i + n] == b[j:j + n] within the stretches; n is 0 where there is none."""
    if isinstance(a, str) and isinstance(b, str) and (told := _long_block(a, b, a0, a1, b0, b1)):
        return told
    steps, link, longest, ends = substrings(b, b0, b1)
    state = size = 0
    best = (a0, b0, 0)
    for at in range(a0, a1):
        x = a[at]
        while state and x not in steps[state]:
            state = link[state]
            size = longest[state]
        if x in steps[state]:
            state, size = steps[state][x], size + 1
            if size > best[2]:
                best = (at + 1 - size, ends[state] - size, size)
    return best


def matching_blocks(a: Sequence, b: Sequence) -> list[tuple[int, int, int]]:
    """(i, j, n) of the blocks that both have, in order, neighbours joined."""
    found, stretches = [], [(0, len(a), 0, len(b))]
    while stretches:
        a0, a1, b0, b1 = stretches.pop()
        if a0 == a1 or b0 == b1:
            continue
        i, j, n = longest_block(a, b, a0, a1, b0, b1)
        if n:
            found.append((i, j, n))
            stretches += [(a0, i, b0, j), (i + n, a1, j + n, b1)]
    out: list[tuple[int, int, int]] = []
    for i, j, n in sorted(found):
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            i, j, m = out.pop()
            n += m
        out.append((i, j, n))
    return out


def changes(a: Sequence, b: Sequence) -> list[tuple[int, int, int, int]]:
    """(i0, i1, j0, j1): the stretches a[i0:i1] that became b[j0:j1], in order."""
    out, i0, j0 = [], 0, 0
    for i, j, n in [*matching_blocks(a, b), (len(a), len(b), 0)]:
        if i0 < i or j0 < j:
            out.append((i0, i, j0, j))
        i0, j0 = i + n, j + n
    return out
