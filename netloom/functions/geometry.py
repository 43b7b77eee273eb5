"""Lattice geometry in plain Python."""

from __future__ import annotations


def cross(o, a, b) -> int:
    """Twice the signed area of the triangle; positive for a left turn."""
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def convex_hull(points) -> list:
    """Corners in counter-clockwise order; points on edges are left out."""
    ordered = sorted({tuple(p) for p in points})
    if len(ordered) < 3:
        return ordered
    halves = []
    for run in (ordered, ordered[::-1]):
        chain: list = []
        for p in run:
            while len(chain) > 1 and cross(chain[-2], chain[-1], p) <= 0:
                chain.pop()
            chain.append(p)
        halves += chain[:-1]
    return halves


def hull_cells(points, width: int, height: int) -> int:
    """Lattice points of a width x height lattice within or on the hull: in each row, those between the hull's ends."""
    hull = convex_hull(points)
    low, high = max(0, min(p[1] for p in hull)), min(height - 1, max(p[1] for p in hull))
    total = 0
    for y in range(low, high + 1):
        left, right = None, None
        for a, b in zip(hull, hull[1:] + hull[:1], strict=True):
            if a[1] == b[1] == y:
                ends = [(a[0], 1), (b[0], 1)]
            elif min(a[1], b[1]) <= y <= max(a[1], b[1]):
                n, d = a[0] * (b[1] - a[1]) + (y - a[1]) * (b[0] - a[0]), b[1] - a[1]
                ends = [(n, d) if d > 0 else (-n, -d)]
            else:
                continue
            for n, d in ends:
                up, down = -(-n // d), n // d
                left, right = up if left is None else min(left, up), down if right is None else max(right, down)
        if left is not None and left <= right:
            total += max(0, min(width - 1, right) - max(0, left) + 1)
    return total


def curve(width: int, height: int) -> list[tuple[int, int]]:
    """A space-filling walk over a rectangle of any size: each cell once, from cell to cell along a Hilbert-like recursion."""
    out: list[tuple[int, int]] = []
    sign = lambda v: (v > 0) - (v < 0)
    todo = [((0, 0), (width, 0), (0, height)) if width >= height else ((0, 0), (0, height), (width, 0))]
    while todo:
        (x, y), major, minor = todo.pop()
        n, m = abs(sum(major)), abs(sum(minor))
        step, side = (sign(major[0]), sign(major[1])), (sign(minor[0]), sign(minor[1]))
        if m == 1:
            out += [(x + k * step[0], y + k * step[1]) for k in range(n)]
        elif n == 1:
            out += [(x + k * side[0], y + k * side[1]) for k in range(m)]
        elif 2 * n > 3 * m:
            half = n // 2 + (n // 2 % 2 if n > 2 else 0)
            first = (step[0] * half, step[1] * half)
            todo += [((x + first[0], y + first[1]), (major[0] - first[0], major[1] - first[1]), minor), ((x, y), first, minor)]
        else:
            half_n, half_m = n // 2, m // 2 + (m // 2 % 2 if m > 2 else 0)
            a, b = (step[0] * half_n, step[1] * half_n), (side[0] * half_m, side[1] * half_m)
            back = ((x + major[0] - step[0] + b[0] - side[0], y + major[1] - step[1] + b[1] - side[1]), (-b[0], -b[1]), (a[0] - major[0], a[1] - major[1]))
            todo += [back, ((x + b[0], y + b[1]), major, (minor[0] - b[0], minor[1] - b[1])), ((x, y), b, a)]
    return out
