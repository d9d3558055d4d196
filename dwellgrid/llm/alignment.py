"""Edit distances by banded alignment; the cells of a column are the bits of one integer."""

from __future__ import annotations

from collections.abc import Hashable, Sequence


def banded(a: Sequence[Hashable], b: Sequence[Hashable], limit: int) -> int | None:
    """The edit distance of two sequences, or None if it is above ``limit``.

    Only diagonals at most ``limit`` away from the main one are looked at.
    """
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > limit:
        return None
    front = 0
    while front < len(a) and a[front] == b[front]:
        front += 1
    back = 0
    while back < len(a) - front and a[-1 - back] == b[-1 - back]:
        back += 1
    a, b = a[front : len(a) - back], b[front : len(b) - back]
    if not len(a):
        return len(b) if len(b) <= limit else None
    n = len(a)
    band = min(limit, n - 1) if len(b) - n <= n - 1 else None
    if band is None:  # so short that the band is the whole table
        found = _whole(a, b)
        return found if found <= limit else None
    where: dict[Hashable, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << 2 * band + 1) - 1
    up, down = ((1 << band + 1) - 1) << band, 0
    distance, corner, row = band, 1 << 2 * band, 1 << 2 * band - 1 if band else 1
    for j, y in enumerate(b):
        at = where.get(y, 0)
        same = (at >> j - band if j >= band else at << band - j) & full
        diagonal = ((((same & up) + up) ^ up) | same | down) & full
        right_up = (down | ~(diagonal | up)) & full
        right_down = diagonal & up
        if j < n - band:
            distance += not diagonal & corner
            if distance - (2 * band) > limit:
                return None
        else:
            distance += bool(right_up & row) - bool(right_down & row)
            row >>= 1
        lower = diagonal >> 1
        up = (right_down | ~(lower | right_up)) & full
        down = lower & right_up
    if band < limit and distance > band:  # the true path may leave a band narrower than the limit
        distance = _whole(a, b)
    return distance if distance <= limit else None


def _whole(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    where: dict[Hashable, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, distance = full, 0, len(a)
    for y in b:
        same = where.get(y, 0)
        vertical = same | down
        diagonal = (((same & up) + up) ^ up) | same
        right_up = (down | ~(diagonal | up)) & full
        right_down = up & diagonal
        distance += bool(right_up & last) - bool(right_down & last)
        right_up = (right_up << 1 | 1) & full
        up = ((right_down << 1) | ~(vertical | right_up)) & full
        down = right_up & vertical
    return distance


def inside(pattern: Sequence[Hashable], region: Sequence[Hashable]) -> int:
    """The least edit distance of ``pattern`` to any stretch of ``region``."""
    if not len(pattern):
        return 0
    where: dict[Hashable, int] = {}
    for i, x in enumerate(pattern):
        where[x] = where.get(x, 0) | 1 << i
    full, last = (1 << len(pattern)) - 1, 1 << len(pattern) - 1
    up, down, distance = full, 0, len(pattern)
    best = distance
    for y in region:
        same = where.get(y, 0)
        vertical = same | down
        diagonal = (((same & up) + up) ^ up) | same
        right_up = (down | ~(diagonal | up)) & full
        right_down = up & diagonal
        distance += bool(right_up & last) - bool(right_down & last)
        best = min(best, distance)
        right_up = (right_up << 1) & full
        up = ((right_down << 1) | ~(vertical | right_up)) & full
        down = right_up & vertical
    return best
