"""Z-order (Morton) key of a tile: the bits of column and row in turn, so that tiles close on the map are mostly close in the key.

A rectangle of tiles is a few ranges of the key: squares of the quad tree inside it, neighbours joined, and beyond a given
number the smallest gaps closed. The ranges hold every tile of the rectangle and some others, so they select files and row
groups while the rectangle itself stays the condition on rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 24

# The public steps that spread 32 bits of a number to the even places of 64.
_SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def _spread(x: Column) -> Column:
    for shift, mask in _SPREAD:
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return x


def z_key(col: str | Column, row: str | Column) -> Column:
    """Key of a tile (0 <= col, row < 2^24)."""
    c, r = (F.col(x) if isinstance(x, str) else x for x in (col, row))
    return _spread(c.cast("long")).bitwiseOR(F.shiftleft(_spread(r.cast("long")), 1))


def z_number(col: int, row: int) -> int:
    """The same for one tile."""
    return sum(((col >> i & 1) << 2 * i) | ((row >> i & 1) << 2 * i + 1) for i in range(BITS))


def z_ranges(min_col: int, max_col: int, min_row: int, max_row: int, most: int = 16, bits: int = BITS) -> list[tuple[int, int]]:
    """At most ``most`` ranges (first, last) that cover the keys of a rectangle; none for an empty one. Squares are opened
    breadth first until there are some times as many as asked for, so the work does not depend on the rectangle."""
    side = 1 << bits
    lo_c, hi_c, lo_r, hi_r = max(0, min_col), min(side - 1, max_col), max(0, min_row), min(side - 1, max_row)
    if lo_c > hi_c or lo_r > hi_r:
        return []
    done, edge, level = [], [(0, 0)], bits
    while edge:
        whole = []
        for c, r in edge:
            c0, r0, c1, r1 = c << level, r << level, (c + 1 << level) - 1, (r + 1 << level) - 1
            if c1 < lo_c or c0 > hi_c or r1 < lo_r or r0 > hi_r:
                continue
            inside = lo_c <= c0 and c1 <= hi_c and lo_r <= r0 and r1 <= hi_r
            (done if inside else whole).append((c, r, level))
        if level == 0 or len(done) + len(whole) > 8 * most:
            done += whole
            break
        level -= 1
        edge = [(2 * c + i, 2 * r + j) for c, r, _ in whole for i in (0, 1) for j in (0, 1)]
    spans = sorted((z_number(c << v, r << v), z_number(c << v, r << v) + (1 << 2 * v) - 1) for c, r, v in done)
    out = [list(spans[0])]
    for a, b in spans[1:]:
        if a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    gaps = sorted(range(1, len(out)), key=lambda i: out[i][0] - out[i - 1][1])
    closed = set(gaps[:max(0, len(out) - most)])
    return [(a, b) for a, b in _joined(out, closed)]


def _joined(spans: Sequence[Sequence[int]], closed: set[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for i, (a, b) in enumerate(spans):
        out = [*out[:-1], (out[-1][0], b)] if i in closed else [*out, (a, b)]
    return out


def in_ranges(key: Column, ranges: Sequence[tuple[int, int]]) -> Column:
    out = F.lit(False)
    for i, (a, b) in enumerate(ranges):
        out = key.between(a, b) if i == 0 else out | key.between(a, b)
    return out
