"""Carrying a cut mask from one version of a text to another: lines first, then words and characters of what changed.

Two sequences are compared in three steps. What both begin or end with is taken off, the longer of the two first. Elements that stand
once on either side are anchors, of which the longest chain that rises on both sides is kept (patience piles, n log n). Between
anchors the gaps are compared by the shortest edit script in linear space: two searches from both ends meet in the middle, and the
halves are compared alike; elements that only one side has are left out before. Memory grows with the texts, not with their product.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd

from quillstage.functions.speech import lazy
from quillstage.functions.text import CURVED, STRAIGHT

Span = tuple[int, int]
#: (place in a, place in b, length)
Block = tuple[int, int, int]
_STRAIGHT = str.maketrans(CURVED, STRAIGHT)
_WORDS = re.compile(r"\w+|\s+|[^\w\s]")


def rising(pairs: list[Span]) -> list[Span]:
    """The longest chain of pairs, given by rising first places, that rises in the second ones too."""
    tops: list[int] = []
    at: list[int] = []
    below: list[int] = []
    for k, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        below.append(at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(j)
            at.append(k)
        else:
            tops[pile], at[pile] = j, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = below[k]
    return out[::-1]


def _middle(a: Sequence, b: Sequence) -> tuple[int, int, int, int]:
    """A run of equal elements, perhaps empty, of a shortest edit script, where searches from both ends meet: from (x, y) to (u, v)."""
    n, m = len(a), len(b)
    lean, most = n - m, (n + m + 1) // 2
    # how far each diagonal is reached; negative diagonals lie at the end of the lists
    forth, back = [0] * (2 * most + 3), [0] * (2 * most + 3)
    for d in range(most + 1):
        diagonals = range(-d + 2 * max(0, d - m), d - 2 * max(0, d - n) + 1, 2)
        for k in diagonals:
            x = forth[k + 1] if k == -d or (k != d and forth[k - 1] < forth[k + 1]) else forth[k - 1] + 1
            y, first = x - k, x
            while x < n and y < m and a[x] == b[y]:
                x, y = x + 1, y + 1
            forth[k] = x
            if lean % 2 and abs(lean - k) < d and x + back[lean - k] >= n:
                return first, first - k, x, y
        for k in diagonals:
            x = back[k + 1] if k == -d or (k != d and back[k - 1] < back[k + 1]) else back[k - 1] + 1
            y, first = x - k, x
            while x < n and y < m and a[n - 1 - x] == b[m - 1 - y]:
                x, y = x + 1, y + 1
            back[k] = x
            if not lean % 2 and abs(lean - k) <= d and x + forth[lean - k] >= n:
                return n - x, m - y, n - first, m - first + k
    raise AssertionError("the searches always meet")


def _shortest(a: Sequence, b: Sequence) -> Iterator[Span]:
    """Pairs of places of a longest common subsequence, in no order."""
    waiting = [(0, len(a), 0, len(b))]
    while waiting:
        i, n, j, m = waiting.pop()
        while i < n and j < m and a[i] == b[j]:
            yield i, j
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            yield n, m
        if i < n and j < m:
            x, y, u, v = _middle(a[i:n], b[j:m])
            yield from ((i + x + k, j + y + k) for k in range(u - x))
            waiting += [(i, i + x, j, j + y), (i + u, n, j + v, m)]


def _ends(a: Sequence, b: Sequence, i: int, n: int, j: int, m: int) -> tuple[int, int]:
    """How many elements of a[i:n] and b[j:m] are equal at the beginning and at the end, the longer taken first."""
    most = min(n - i, m - j)
    head = next((k for k in range(most) if a[i + k] != b[j + k]), most)
    tail = next((k for k in range(most) if a[n - 1 - k] != b[m - 1 - k]), most)
    return (head, min(tail, most - head)) if head >= tail else (min(head, most - tail), tail)


def matching(a: Sequence, b: Sequence) -> list[Block]:
    """Blocks of equal elements, in order, as long as they can be."""
    pairs: list[Span] = []
    waiting = [(0, len(a), 0, len(b))]
    while waiting:
        i, n, j, m = waiting.pop()
        head, tail = _ends(a, b, i, n, j, m)
        pairs += [(i + k, j + k) for k in range(head)] + [(n - 1 - k, m - 1 - k) for k in range(tail)]
        i, n, j, m = i + head, n - tail, j + head, m - tail
        if i == n or j == m:
            continue
        ours, theirs = Counter(a[i:n]), Counter(b[j:m])
        there = {x: k for k, x in enumerate(b[j:m], j) if theirs[x] == 1 and ours[x] == 1}
        anchors = rising([(k, there[x]) for k, x in enumerate(a[i:n], i) if x in there])
        if anchors:
            pairs += anchors
            for (x, y), (u, v) in zip([(i - 1, j - 1), *anchors], [*anchors, (n, m)], strict=True):
                if x + 1 < u and y + 1 < v:
                    waiting.append((x + 1, u, y + 1, v))
            continue
        left, right = [k for k in range(i, n) if a[k] in theirs], [k for k in range(j, m) if b[k] in ours]
        pairs += [(left[x], right[y]) for x, y in _shortest([a[k] for k in left], [b[k] for k in right])]
    blocks: list[Block] = []
    for i, j in sorted(pairs):
        if blocks and blocks[-1][0] + blocks[-1][2] == i and blocks[-1][1] + blocks[-1][2] == j:
            blocks[-1] = (*blocks[-1][:2], blocks[-1][2] + 1)
        else:
            blocks.append((i, j, 1))
    return blocks


def _places(parts: Sequence[str], between: int) -> list[int]:
    """Where each of the parts begins, with that many characters between them, and where one more would."""
    out, at = [0], 0
    for part in parts:
        at += len(part) + between
        out.append(at)
    return out


def _gaps(blocks: list[Block], n: int, m: int) -> Iterator[tuple[int, int, int, int]]:
    """What lies between blocks and belongs to both sides."""
    i = j = 0
    for x, y, k in [*blocks, (n, m, 0)]:
        if i < x and j < y:
            yield i, x, j, y
        i, j = x + k, y + k


def equal_stretches(a: str, b: str) -> Iterator[Block]:
    """Blocks of equal characters of two texts: whole lines with their ends, and within changed lines words, and within changed words characters."""
    lines = a.split("\n"), b.split("\n")
    at = [_places(x, 1) for x in lines]
    found = matching(*lines)
    yield from ((at[0][i], at[1][j], at[0][i + n] - at[0][i]) for i, j, n in found)
    for i, x, j, y in _gaps(found, len(lines[0]), len(lines[1])):
        p, q = at[0][i], at[1][j]
        words = _WORDS.findall(a[p : at[0][x] - 1]), _WORDS.findall(b[q : at[1][y] - 1])
        of = [_places(w, 0) for w in words]
        same = matching(*words)
        yield from ((p + of[0][u], q + of[1][v], of[0][u + n] - of[0][u]) for u, v, n in same)
        for u, s, v, t in _gaps(same, len(words[0]), len(words[1])):
            f, g = p + of[0][u], q + of[1][v]
            yield from ((f + k, g + o, n) for k, o, n in matching(a[f : p + of[0][s]], b[g : q + of[1][t]]))


def merged(spans: list[Span]) -> list[Span]:
    """Disjoint spans in order that cover what any of the spans covers."""
    out: list[Span] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        elif s < e:
            out.append((s, e))
    return out


def carried(source: str, reviewed: str, cut: list[Span]) -> list[Span]:
    """Spans of ``source`` that stand opposite the spans ``cut`` of ``reviewed``, merged and in order. Apostrophes and spaces that only look different are alike."""
    cut, source, reviewed = merged(cut), source.translate(_STRAIGHT), reviewed.translate(_STRAIGHT)
    stops = [e for _, e in cut]
    found: list[Span] = []
    for i, j, n in equal_stretches(reviewed, source):
        for k in range(bisect_right(stops, i), len(cut)):
            s, e = cut[k]
            if s >= i + n:
                break
            found.append((max(s, i) + j - i, min(min(e, i + n) + j - i, len(source))))
    return merged(found)


@lazy("array<struct<start:int,stop:int>>")
def carry(source: pd.Series, reviewed: pd.Series, cut: pd.Series) -> pd.Series:
    return pd.Series(
        [
            [{"start": s, "stop": e} for s, e in carried(x or "", y or "", [(c["start"], c["stop"]) for c in (z if z is not None else [])])] for x,
            y, z in zip(source, reviewed, cut, strict=True)
        ],
        dtype=object
    )
