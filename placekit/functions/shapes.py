"""Polygons of any shape in arrays: areas in common, clipping to boxes, simpler rings, lines in cells.

A polygon is a list of rings, each an (n, 2) array of x and y that may or may not end where it starts; a point is inside if it
is inside an odd number of rings, so holes and parts need no mark.
"""

from __future__ import annotations

import numpy as np

Ring = np.ndarray


def segments(rings: list[Ring]) -> np.ndarray:
    """(n, 4): x0, y0, x1, y1 of every edge; open rings are closed."""
    out = []
    for r in rings:
        r = np.asarray(r, float).reshape(-1, 2)
        if len(r) > 1:
            closed = r if (r[0] == r[-1]).all() else np.vstack([r, r[:1]])
            out.append(np.hstack([closed[:-1], closed[1:]]))
    return np.vstack(out) if out else np.zeros((0, 4))


def _meetings(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """y of the points where edges of ``a`` cross edges of ``b``."""
    p, r = a[:, None, :2], (a[:, 2:] - a[:, :2])[:, None]
    q, s = b[None, :, :2], (b[:, 2:] - b[:, :2])[None]
    cross = r[..., 0] * s[..., 1] - r[..., 1] * s[..., 0]
    d = q - p
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (d[..., 0] * s[..., 1] - d[..., 1] * s[..., 0]) / cross
        u = (d[..., 0] * r[..., 1] - d[..., 1] * r[..., 0]) / cross
    met = (cross != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
    at = (p[..., 1] + np.where(met, t, 0) * r[..., 1])[met]
    return at


def _spans(edges: np.ndarray, y: float) -> np.ndarray:
    """Where the line at ``y`` is inside, as pairs of x."""
    meets = (edges[:, 1] > y) != (edges[:, 3] > y)
    e = edges[meets]
    return np.sort(e[:, 0] + (y - e[:, 1]) / (e[:, 3] - e[:, 1]) * (e[:, 2] - e[:, 0])).reshape(-1, 2)


def common_area(a: list[Ring], b: list[Ring]) -> float:
    """Area that two polygons share. Between two heights at which no edge ends or crosses another, the shared width is
    linear, so its value in the middle is exact."""
    ea, eb = segments(a), segments(b)
    if not len(ea) or not len(eb):
        return 0.0
    low = max(ea[:, [1, 3]].min(), eb[:, [1, 3]].min())
    high = min(ea[:, [1, 3]].max(), eb[:, [1, 3]].max())
    if high <= low:
        return 0.0
    heights = np.concatenate([ea[:, 1], eb[:, 1], _meetings(ea, eb), [low, high]])
    heights = np.unique(heights[(heights >= low) & (heights <= high)])
    total = 0.0
    for y0, y1 in zip(heights[:-1], heights[1:]):
        sa, sb = _spans(ea, (y0 + y1) / 2), _spans(eb, (y0 + y1) / 2)
        if len(sa) and len(sb):
            wide = np.minimum(sa[:, None, 1], sb[None, :, 1]) - np.maximum(sa[:, None, 0], sb[None, :, 0])
            total += wide[wide > 0].sum() * (y1 - y0)
    return float(total)


def area(rings: list[Ring]) -> float:
    """Area of a polygon whose rings may hold one another."""
    return common_area(rings, rings)


def holds(rings: list[Ring], x: float, y: float) -> bool:
    e = segments(rings)
    meets = (e[:, 1] > y) != (e[:, 3] > y)
    e = e[meets]
    return bool((x < e[:, 0] + (y - e[:, 1]) / (e[:, 3] - e[:, 1]) * (e[:, 2] - e[:, 0])).sum() % 2)


def touch(a: list[Ring], b: list[Ring]) -> bool:
    """Whether two polygons have a point in common."""
    ea, eb = segments(a), segments(b)
    if not len(ea) or not len(eb):
        return False
    if len(_meetings(ea, eb)):
        return True
    return holds(a, *eb[0, :2]) or holds(b, *ea[0, :2])


def clip_ring(ring: Ring, box: tuple[float, float, float, float]) -> Ring:
    """The ring inside a box (x0, y0, x1, y1), side by side; parts that the box parts stay joined along its border, which adds no area."""
    out = np.asarray(ring, float).reshape(-1, 2)
    if len(out) > 1 and (out[0] == out[-1]).all():
        out = out[:-1]
    for axis, limit, keep in ((0, box[0], 1), (1, box[1], 1), (0, box[2], -1), (1, box[3], -1)):
        if not len(out):
            return out
        nxt = np.roll(out, -1, 0)
        inside, after = keep * (out[:, axis] - limit) >= 0, keep * (nxt[:, axis] - limit) >= 0
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (limit - out[:, axis]) / (nxt[:, axis] - out[:, axis])
        cut = out + np.where(inside != after, t, 0)[:, None] * (nxt - out)
        cut[:, axis] = np.where(inside != after, limit, cut[:, axis])
        both = np.stack([out, cut], 1).reshape(-1, 2)
        out = both[np.stack([inside, inside != after], 1).reshape(-1)]
    return out


def clip_line(line: Ring, box: tuple[float, float, float, float]) -> list[Ring]:
    """The parts of a line inside a box, in order."""
    line, parts = np.asarray(line, float).reshape(-1, 2), []
    for p, q in zip(line[:-1], line[1:]):
        lo, hi, d = 0.0, 1.0, q - p
        for axis, a, b in ((0, box[0], box[2]), (1, box[1], box[3])):
            if d[axis] == 0:
                if not a <= p[axis] <= b:
                    lo, hi = 1.0, 0.0
                continue
            t = sorted(((a - p[axis]) / d[axis], (b - p[axis]) / d[axis]))
            lo, hi = max(lo, t[0]), min(hi, t[1])
        if lo > hi:
            continue
        start, end = p + lo * d, p + hi * d
        if parts and lo == 0 and (parts[-1][-1] == p).all():
            parts[-1].append(end)
        else:
            parts.append([start, end])
    return [np.array(x) for x in parts]


def simplify(line: Ring, tolerance: float, least: int = 2) -> Ring:
    """Points of a line no farther than ``tolerance`` from what stays; the farthest point of a stretch stays, again and again.

    A ring (first point equal to the last, ``least`` 4) is parted at the point farthest from its start, so it stays a ring.
    """
    p = np.asarray(line, float).reshape(-1, 2)
    if len(p) <= least:
        return p
    keep = np.zeros(len(p), bool)
    keep[[0, -1]] = True
    ring = (p[0] == p[-1]).all()
    far = int(((p - p[0]) ** 2).sum(1).argmax())
    todo = [(0, far), (far, len(p) - 1)] if ring and far else [(0, len(p) - 1)]
    keep[far] |= ring
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d, rel = p[b] - p[a], p[a + 1 : b] - p[a]
        long = float((d**2).sum())
        t = np.clip(rel @ d / long, 0, 1) if long else np.zeros(len(rel))
        off = ((rel - t[:, None] * d) ** 2).sum(1)
        i = int(off.argmax())
        if off[i] > tolerance * tolerance:
            i += a + 1
            keep[i] = True
            todo += [(a, i), (i, b)]
    if keep.sum() < least:  # what is left of a ring is no area: its points stay
        return p
    return p[keep]


def mask(rings: list[Ring], wide: int, high: int) -> np.ndarray:
    """(high, wide) of whether the middle of each cell is inside; rings in units of cells."""
    e, out = segments(rings), np.zeros((high, wide), bool)
    middle = np.arange(wide) + 0.5
    for j in range(high):
        s = _spans(e, j + 0.5) if len(e) else np.zeros((0, 2))
        out[j] = (np.searchsorted(s[:, 0], middle, side="right") - np.searchsorted(s[:, 1], middle, side="right")) > 0
    return out


def burn(line: Ring, wide: int, high: int) -> np.ndarray:
    """(n, 2) of the cells i, j that a line passes, one for each step of the longer axis; steps outside go."""
    p, out = np.asarray(line, float).reshape(-1, 2), []
    for a, b in zip(p[:-1], p[1:]):
        n = max(1, int(np.ceil(np.abs(b - a).max())))
        out.append(np.floor(a + np.arange(n + 1)[:, None] / n * (b - a)).astype(np.int64))
    cells = np.unique(np.vstack(out), axis=0) if out else np.zeros((0, 2), np.int64)
    return cells[(cells >= 0).all(1) & (cells[:, 0] < wide) & (cells[:, 1] < high)]
