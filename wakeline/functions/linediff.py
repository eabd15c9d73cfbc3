"""Shortest edit scripts of line lists, in bounded memory.

Level d of the walk holds, for every diagonal, the furthest line that d edits
reach; all diagonals of a level are advanced together in numpy. The way back
needs every level, which would take memory with the square of the edits. So
levels are kept at a stride that doubles whenever those kept exceed CELLS, and
the levels between two kept ones are walked again, from the last stretch to the
first, when the way back comes to them.
"""

from __future__ import annotations

import numpy as np

#: Values of kept levels that one stretch may hold.
CELLS = 1 << 22

#: A level: the lowest diagonal and the furthest line on it and on every second one above.
Level = tuple[int, np.ndarray]


class Walk:
    """The levels of two lists of lines, given as numbers."""

    def __init__(self, before: list[str], after: list[str]):
        number: dict[str, int] = {}
        self.n, self.m = len(before), len(after)
        self.a = np.array([*(number.setdefault(s, len(number)) for s in before), -1], np.int64)
        self.b = np.array([*(number.setdefault(s, len(number)) for s in after), -2], np.int64)

    def _slide(self, level: Level) -> Level:
        """Follow equal lines from each place; behind the last line of either side nothing is equal."""
        low, x = level
        k = low + 2 * np.arange(len(x))
        same = lambda at: at[self.a[np.minimum(x[at], self.n)] == self.b[np.minimum(x[at] - k[at], self.m)]]
        at = same(np.arange(len(x)))
        while len(at):
            x[at] += 1
            at = same(at)
        return level

    def first(self) -> Level:
        return self._slide((0, np.zeros(1, np.int64)))

    def next(self, level: Level) -> Level:
        """One edit more: down from the diagonal above where that reaches further, else right from the one below."""
        low, x = level
        below, above = np.concatenate([[-2], x]), np.concatenate([x, [-2]])
        x, low = np.where(below < above, above, below + 1), low - 1
        first = max(0, (-self.m - low + 1) // 2)  # diagonals outside the lists lead nowhere
        last = len(x) - max(0, (low + 2 * (len(x) - 1) - self.n + 1) // 2)
        return self._slide((low + 2 * first, x[first:last]))

    def ended(self, level: Level) -> bool:
        at, odd = divmod(self.n - self.m - level[0], 2)
        return not odd and 0 <= at < len(level[1]) and level[1][at] >= self.n

    def kept(self, start: int, level: Level, stop: int | None) -> tuple[dict[int, Level], int, int]:
        """Levels from start up to stop (or the end) at a stride, the stride, and the level that it came to."""
        held, stride, size, d = {start: level}, 1, len(level[1]), start
        while not self.ended(level) if stop is None else d < stop:
            level, d = self.next(level), d + 1
            if (d - start) % stride == 0:
                held[d] = level
                size += len(level[1])
                while size > CELLS and len(held) > 3:
                    stride *= 2
                    held = {e: v for e, v in held.items() if (e - start) % stride == 0}
                    size = sum(len(v[1]) for v in held.values())
        return held, stride, d

    def back(self, start: int, level: Level, stop: int | None, end: tuple[int, int], edits: list[tuple[int, int, bool]]) -> tuple[int, int]:
        """Append the edits of levels stop to start + 1, the last first, as (line before, line after, is insertion); where they begin."""
        held, stride, stop = self.kept(start, level, stop)
        for d in sorted(held, reverse=True):
            top = min(d + stride, stop)
            if top - d > 1:
                end = self.back(d, held[d], top, end, edits)
            elif top - d == 1:
                low, x = held[d]
                k = end[0] - end[1]
                at = (k - 1 - low) // 2
                below = int(x[at]) if 0 <= at < len(x) else -2
                above = int(x[at + 1]) if 0 <= at + 1 < len(x) else -2
                end = (above, above - k - 1) if below < above else (below, below - k + 1)
                edits.append((*end, below < above))
        return end


def edits(before: list[str], after: list[str]) -> list[tuple[int, int, bool]]:
    """The edits of a shortest script in order: lines consumed of either side, and whether the next of after is inserted (else the next of before is deleted)."""
    walk = Walk(before, after)
    found: list[tuple[int, int, bool]] = []
    walk.back(0, walk.first(), None, (len(before), len(after)), found)
    return found[::-1]


def script(before: list[str], after: list[str]) -> list[tuple[str, str]]:
    """The whole script as (kind, line)."""
    out: list[tuple[str, str]] = []
    x = 0
    for at, to, inserted in edits(before, after):
        out += [("equal", line) for line in before[x:at]]
        out.append(("insert", after[to]) if inserted else ("delete", before[at]))
        x = at if inserted else at + 1
    return out + [("equal", line) for line in before[x:]]
