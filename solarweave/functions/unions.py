"""Areas that groups of polygons cover together, each group inside a window of its own, by vertical slabs; the edges of many groups lie in the same numpy arrays.

Between neighbouring x of a group's corners and crossings no edges change places, so what is
covered there is the slab's width times what is covered of its middle line. Edges that touch,
lie on each other or cross themselves need no care: rounding moves an area by no more than
itself, so nothing is snapped and no piece is matched with another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from solarweave.functions import overlay
from solarweave.functions.overlays import chosen

#: Edges of a group from which its window is halved; pairs of edges, or places on middle lines, that are held together.
MOST_EDGES, PAIRS = 96, 1 << 18
#: A window whose halves hold more than this share of its edges, so many times in a row, is halved no further.
SHARE, IN_A_ROW = 0.9, 4


def covered(edges: np.ndarray, of: np.ndarray, group: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Area of windows (n, 4: x1, y1, x2, y2) that the polygons of each group cover; edges (m, 4) lie in order of their polygon, polygons in order of their group.

    A polygon is inside where an upright ray meets its edges an odd number of times; a window whose
    sides aren't in order holds nothing. Windows of many edges are halved until few are left or
    one polygon holds them whole, so that work doesn't grow with the square of a group's size
    unless all of it meets at one place.
    """
    row = group[of]
    size = windows[:, 2:] - windows[:, :2]
    edges = edges - np.tile(windows[row, :2], 2)
    swap = edges[:, 0] > edges[:, 2]
    edges[swap] = edges[swap][:, [2, 3, 0, 1]]
    met = (edges[:, 2] >= 0) & (edges[:, 0] <= size[row, 0]) & (size > 0).all(axis=1)[row]
    edges, of, row = edges[met], of[met], row[met]
    count = np.bincount(row, minlength=len(windows))
    many = count > MOST_EDGES
    if not many.any():
        return _together(edges, of, row, size)
    few = ~many[row]
    out = _together(edges[few], of[few], row[few], size)
    first = np.cumsum(count) - count
    for g in np.flatnonzero(many).tolist():
        own = slice(first[g], first[g] + count[g])
        out[g] = _halved(*_different(edges[own], of[own]), size[g])
    return out


def _different(edges: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """edges and their polygons, without polygons that have the same edges in the same order as an earlier one."""
    starts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    seen, kept = set(), np.zeros(len(starts), bool)
    for k, (a, b) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), len(of)], strict=True)):
        key = edges[a:b].tobytes()
        kept[k] = key not in seen
        seen.add(key)
    kept = np.repeat(kept, np.diff(np.append(starts, len(of))))
    return edges[kept], of[kept]


def _halved(edges: np.ndarray, of: np.ndarray, size: np.ndarray) -> float:
    """Area of one window from (0, 0) to size, halved until few edges meet in a part of it."""
    total, todo = 0.0, [(edges, of, (0.0, 0.0, float(size[0]), float(size[1])), 0)]
    leaves: list[tuple[np.ndarray, np.ndarray, tuple]] = []
    held = 0
    while todo:
        e, p, (x1, y1, x2, y2), stuck = todo.pop()
        before = len(e)
        met = (e[:, 2] > x1) & (e[:, 0] < x2)
        e, p = e[met], p[met]
        own = np.unique(p, return_inverse=True)[1].ravel()
        near = (np.maximum(e[:, 1], e[:, 3]) > y1) & (np.minimum(e[:, 1], e[:, 3]) < y2)
        cut = np.bincount(own, near) > 0
        x, y = (x1 + x2) / 2, (y1 + y2) / 2
        under = np.flatnonzero((e[:, 0] <= x) & (x < e[:, 2]))
        under = under[e[under, 1] + (x - e[under, 0]) / (e[under, 2] - e[under, 0]) * (e[under, 3] - e[under, 1]) < y]
        if ((np.bincount(own[under], minlength=len(cut)) % 2 == 1) & ~cut).any():  # one polygon holds it all
            total += (x2 - x1) * (y2 - y1)
            continue
        e, p = e[cut[own]], p[cut[own]]
        stuck = stuck + 1 if len(e) > SHARE * before else 0
        if len(e) <= MOST_EDGES or stuck > IN_A_ROW:
            leaves.append((e, p, (x1, y1, x2, y2)))
            held += len(e)
            if held > PAIRS:
                total, leaves, held = total + _leaves(leaves), [], 0
        elif x2 - x1 >= y2 - y1:
            todo += [(e, p, (x1, y1, x, y2), stuck), (e, p, (x, y1, x2, y2), stuck)]
        else:
            todo += [(e, p, (x1, y1, x2, y), stuck), (e, p, (x1, y, x2, y2), stuck)]
    return total + _leaves(leaves)


def _leaves(leaves: list[tuple[np.ndarray, np.ndarray, tuple]]) -> float:
    """Area of parts of a window that are left to be swept."""
    if not leaves:
        return 0.0
    row = np.repeat(np.arange(len(leaves)), [len(e) for e, _, _ in leaves])
    windows, of = np.array([w for _, _, w in leaves]), np.concatenate([p for _, p, _ in leaves])
    edges = np.concatenate([e for e, _, _ in leaves]) - np.tile(windows[row, :2], 2)
    return float(_together(edges, of, row, windows[:, 2:] - windows[:, :2]).sum())


def _together(edges: np.ndarray, of: np.ndarray, row: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Areas of windows from (0, 0) to size, chunk by chunk of rows in order; upright edges bound nothing from below or above, so they are left out."""
    slanted = edges[:, 0] < edges[:, 2]
    edges, of, row = edges[slanted], of[slanted], row[slanted]
    count, out = np.bincount(row, minlength=len(size)), np.zeros(len(size))
    cost, ends = np.cumsum(count * (count + 8)), np.cumsum(count)
    at = 0
    while at < len(size):
        stop = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + PAIRS, "right")))
        a, b = ends[at] - count[at], ends[stop - 1]
        if a < b:
            out[at:stop] = _swept(edges[a:b], of[a:b], row[a:b] - at, size[at:stop])
        at = stop
    return out


def _pairs(low: np.ndarray, high: np.ndarray, row: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of edges of one row whose x meet; those of one large row block by block."""
    if row[0] == row[-1] and len(row) ** 2 > 2 * PAIRS:
        for i, j in overlay._pairs(low, high, low, high):
            yield i[i < j], j[i < j]
        return
    own = np.arange(len(row))
    i, j = chosen(own + 1, np.searchsorted(row, row, "right") - own - 1)
    met = (low[i] < high[j]) & (low[j] < high[i])
    yield i[met], j[met]


def _swept(edges: np.ndarray, of: np.ndarray, row: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Areas of windows from (0, 0) to size; edges run to the right."""
    x1, y1, x2, y2 = edges.T
    dx, dy, wide, high = x2 - x1, y2 - y1, size[row, 0], size[row, 1]
    low, top = np.minimum(y1, y2), np.maximum(y1, y2)
    places, its = [np.clip(x1, 0.0, wide), np.clip(x2, 0.0, wide)], [row, row]
    for line in (np.zeros(len(row)), high):
        k = np.flatnonzero((low < line) & (line < top))
        places.append(np.clip(x1[k] + (line[k] - y1[k]) / dy[k] * dx[k], 0.0, wide[k]))
        its.append(row[k])
    for i, j in _pairs(x1, x2, row):
        near = (low[i] < top[j]) & (low[j] < top[i])
        i, j = i[near], j[near]
        with np.errstate(divide="ignore", invalid="ignore"):  # those of one direction don't cross
            t = ((x1[j] - x1[i]) * dy[j] - (y1[j] - y1[i]) * dx[j]) / (dx[i] * dy[j] - dy[i] * dx[j])
            x = x1[i] + t * dx[i]
        k = np.flatnonzero((x > np.maximum(np.maximum(x1[i], x1[j]), 0.0)) & (x < np.minimum(np.minimum(x2[i], x2[j]), wide[i])))
        places.append(x[k])
        its.append(row[i[k]])
    places, its = np.concatenate(places), np.concatenate(its)
    order = np.lexsort((places, its))
    sorted_x, sorted_row = places[order], its[order]
    new = np.concatenate(([True], (sorted_x[1:] > sorted_x[:-1]) | (sorted_row[1:] != sorted_row[:-1])))
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    at, owner = sorted_x[new], sorted_row[new]
    first, last = number[: len(row)], number[len(row) : 2 * len(row)]  # the slabs of each edge
    middle, width = (at[:-1] + at[1:]) / 2, np.diff(at)
    length = np.zeros(len(middle))
    active = np.cumsum(np.bincount(first, minlength=len(at)) - np.bincount(last, minlength=len(at)))[:-1]
    total = np.cumsum(active)
    begin = 0
    while begin < len(middle):
        stop = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + 2 * PAIRS, "right")))
        a, b = np.maximum(first, begin), np.minimum(last, stop)
        some = np.flatnonzero(a < b)
        if len(some):
            a, b = a[some], b[some]
            i, slab = chosen(a, b - a)
            i = some[i]
            y = np.clip(y1[i] + (middle[slab] - x1[i]) / dx[i] * dy[i], 0.0, high[i])
            low_y, high_y, at_slab = _intervals(y, slab, of[some], a, b)
            length[begin:stop] = _joined(low_y, high_y, at_slab - begin, stop - begin)
        begin = stop
    return np.bincount(owner[:-1], width * length, len(size))


def _intervals(y: np.ndarray, slab: np.ndarray, of: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower, upper, slab) of what each polygon holds of its slabs' middle lines: the places where its edges, of slabs first to last, meet them, in pairs."""
    starts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    polygon = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(of))))
    left = np.minimum.reduceat(first, starts)
    span = np.maximum.reduceat(last, starts) - left
    base = np.cumsum(span) - span
    line = slab + np.repeat((base - left)[polygon], last - first)
    count = np.bincount(line, minlength=int(span.sum()))
    y, begin = y[np.argsort(line, kind="stable")], np.cumsum(count) - count
    at = np.arange(len(count)) - np.repeat(base - left, span)
    out = []
    for n in np.unique(count[count > 1]).tolist():
        own = np.flatnonzero(count == n)
        met = y[begin[own][:, None] + np.arange(n)]
        met.sort(axis=1)
        out.append((met[:, 0 : n - 1 : 2].ravel(), met[:, 1:n:2].ravel(), np.repeat(at[own], n // 2)))
    low, high, at = (np.concatenate(c) for c in zip(*out, strict=True))
    some = low < high
    return low[some], high[some], at[some]


def _joined(low: np.ndarray, high: np.ndarray, slab: np.ndarray, n: int) -> np.ndarray:
    """Length that the intervals of each of n slabs cover: from the least lower to the greatest upper end, without the gaps between the ends, each kind in its order."""
    out, count = np.zeros(n), np.bincount(slab, minlength=n)
    order, begin = np.argsort(slab, kind="stable"), np.cumsum(count) - count
    low, high = low[order], high[order]
    for k in np.unique(count[count > 0]).tolist():
        own = np.flatnonzero(count == k)
        at = begin[own][:, None] + np.arange(k)
        a, b = np.sort(low[at], axis=1), np.sort(high[at], axis=1)
        out[own] = b[:, -1] - a[:, 0] - np.maximum(a[:, 1:] - b[:, :-1], 0.0).sum(axis=1)
    return out
