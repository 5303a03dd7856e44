"""The points of one tile, and of the cells around it, in whole-array steps by the plan's 32-bit rules.

A tile is a rectangle of cells. With the points of four cells around it, everything about its own points can be said by
one task: those within two cells get their core mark (``near``), and what is within two cells of the tile's own
cells makes edges and takes border points. Bounds come before points: cells whose boxes settle a count, an edge or
a nearest core point never meet point by point.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from cellweave.functions.grid import LOW_HALF
from cellweave.operators.stencil import FULL, HALF, OTHERS
from cellweave.params import Params

#: Pairs of points compared at a time; pairs of cells with more are halved until their parts have no more.
BLOCK = 1_000_000
NOISE = np.iinfo(np.int64).min

#: Lowest and highest own cell in x and y, both included.
Rectangle = tuple[int, int, int, int]
WHOLE: Rectangle = (-(1 << 40), 1 << 40, -(1 << 40), 1 << 40)


def cell_coordinates(x: np.ndarray, y: np.ndarray, params: Params) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.floor(v * np.float32(params.inv_r)).astype(np.int64) for v in (x, y))


def pack(kx: np.ndarray, ky: np.ndarray) -> np.ndarray:
    return (kx << 32) | (ky & LOW_HALF)


class _Cells:
    """Occupied cells of points sorted by cell: keys, first point, size and box."""

    def __init__(self, x: np.ndarray, y: np.ndarray, kx: np.ndarray, ky: np.ndarray, key: np.ndarray):
        self.x, self.y = x, y
        self.key, self.start, self.n = np.unique(key, return_index=True, return_counts=True)
        self.kx, self.ky = kx[self.start], ky[self.start]
        self.low = [np.minimum.reduceat(v, self.start) if len(v) else v for v in (x, y)]
        self.high = [np.maximum.reduceat(v, self.start) if len(v) else v for v in (x, y)]
        self.of = np.repeat(np.arange(len(self.n)), self.n)

    def around(self, where: Rectangle, rings: int) -> np.ndarray:
        """Which cells are in the rectangle or at most so many cells from it."""
        x0, x1, y0, y1 = where
        return (self.kx >= x0 - rings) & (self.kx <= x1 + rings) & (self.ky >= y0 - rings) & (self.ky <= y1 + rings)

    def at(self, a: np.ndarray, offsets: list[tuple[int, int]], other: _Cells) -> tuple[np.ndarray, np.ndarray]:
        """(of ``a``, of ``other``): the occupied cells at the offsets from the cells ``a``."""
        here, there = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for dx, dy in offsets if len(other.key) else ():
            key = pack(self.kx[a] + dx, self.ky[a] + dy)
            at = np.minimum(np.searchsorted(other.key, key), len(other.key) - 1)
            found = np.flatnonzero(other.key[at] == key)
            here.append(a[found])
            there.append(at[found])
        return np.concatenate(here), np.concatenate(there)

    def gap(self, a: np.ndarray, other: _Cells, b: np.ndarray) -> np.ndarray:
        """Squared distance of the boxes."""
        g = [np.maximum(np.maximum(self.low[k][a] - other.high[k][b], other.low[k][b] - self.high[k][a]), np.float32(0)) for k in (0, 1)]
        return g[0] * g[0] + g[1] * g[1]

    def span(self, a: np.ndarray, other: _Cells, b: np.ndarray) -> np.ndarray:
        """Squared distance that no two points of the boxes exceed."""
        g = [np.maximum(self.high[k][a] - other.low[k][b], other.high[k][b] - self.low[k][a]) for k in (0, 1)]
        return g[0] * g[0] + g[1] * g[1]

    def to_box(self, x: np.ndarray, y: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, largest) squared distance of points to the boxes ``b``."""
        near, far = [], []
        for v, low, high in zip((x, y), self.low, self.high, strict=True):
            near.append(np.maximum(np.maximum(v - high[b], low[b] - v), np.float32(0)))
            far.append(np.maximum(v - low[b], high[b] - v))
        return near[0] * near[0] + near[1] * near[1], far[0] * far[0] + far[1] * far[1]

    def extremes(self) -> list[np.ndarray]:
        """For each cell its points of least and largest x and y."""
        out = []
        for v in (self.x, self.y):
            order = np.lexsort((v, self.of))
            out += [order[self.start], order[self.start + self.n - 1]]
        return out

    def points_of(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``cells``, point) for all points of the cells."""
        n = self.n[cells]
        row = np.repeat(np.arange(len(cells)), n)
        return row, self.start[cells][row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


def _blocks(sizes: np.ndarray) -> Iterator[slice]:
    """Slices of rows whose sizes add up to about ``BLOCK``; a row by itself may be larger."""
    total = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + BLOCK, side="right")))
        yield slice(at, end)
        at = end


def _met(x: np.ndarray, y: np.ndarray, cells: _Cells, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, point of the row's cell ``b``, squared distance) of points x, y and all points of one cell each."""
    for part in _blocks(cells.n[b]):
        row, q = cells.points_of(b[part])
        row = row + part.start
        dx, dy = cells.x[q] - x[row], cells.y[q] - y[row]
        yield row, q, dx * dx + dy * dy


def core_marks(cells: _Cells, judged: np.ndarray, params: Params) -> np.ndarray:
    """Whether each point of the ``judged`` cells is core.

    Boxes first: a cell is settled if it is full, if it and the cells that lie within eps of all of it as a whole hold
    enough points, or if all cells within reach don't. Then the same by points against boxes. Only points that
    are still between their bounds meet points.
    """
    eps_sq, need = np.float32(params.eps_sq), params.min_samples
    at_least = np.where(judged, cells.n, 0)
    a, b = cells.at(np.flatnonzero(judged & (cells.n < need)), OTHERS, cells)
    close = cells.gap(a, cells, b) <= eps_sq
    a, b = a[close], b[close]
    whole = cells.span(a, cells, b) <= eps_sq
    at_least = at_least + np.bincount(a[whole], cells.n[b[whole]], len(cells.n)).astype(np.int64)
    at_most = at_least + np.bincount(a[~whole], cells.n[b[~whole]], len(cells.n)).astype(np.int64)
    open_ = (at_least < need) & (at_most >= need)
    core = (at_least >= need)[cells.of]
    a, b = a[~whole], b[~whole]
    a, b = a[open_[a]], b[open_[a]]
    row, p = cells.points_of(a)
    b = b[row]
    near, far = cells.to_box(cells.x[p], cells.y[p], b)
    n = len(cells.x)
    count = at_least[cells.of] + np.bincount(p[far <= eps_sq], cells.n[b[far <= eps_sq]], n).astype(np.int64)
    left = (near <= eps_sq) & (far > eps_sq)
    p, b = p[left], b[left]
    most = count + np.bincount(p, cells.n[b], n).astype(np.int64)
    left = (count[p] < need) & (most[p] >= need)
    p, b = p[left], b[left]
    for row, _, d2 in _met(cells.x[p], cells.y[p], cells, b):
        count += np.bincount(p[row[d2 <= eps_sq]], minlength=n)
    return core | (count >= need) & open_[cells.of]


def within_reach(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, eps_sq: np.float32) -> bool:
    """Whether a point of one set is within eps of one of the other.

    Sets are halved at the middle of their longer side until pairs of parts are few enough to compare; parts whose
    boxes are too far apart go, the nearest are looked at first, and one pair within eps ends the search.
    """
    todo = [(ax, ay, bx, by)]
    while todo:
        ax, ay, bx, by = todo.pop()
        for _ in range(2):  # of each set only what is within eps of the other's box
            gx = np.maximum(np.maximum(bx.min() - ax, ax - bx.max()), np.float32(0))
            gy = np.maximum(np.maximum(by.min() - ay, ay - by.max()), np.float32(0))
            keep = gx * gx + gy * gy <= eps_sq
            ax, ay, bx, by = bx, by, ax[keep], ay[keep]
            if not len(bx):
                break
        if not len(bx) or not len(ax):
            continue
        if len(ax) * len(bx) <= BLOCK or (np.ptp(ax) == 0 and np.ptp(ay) == 0 and np.ptp(bx) == 0 and np.ptp(by) == 0):
            small, large = ((ax, ay), (bx, by)) if len(ax) <= len(bx) else ((bx, by), (ax, ay))
            for at in range(0, len(small[0]), max(1, BLOCK // len(large[0]))):
                part = slice(at, at + max(1, BLOCK // len(large[0])))
                dx, dy = large[0] - small[0][part, None], large[1] - small[1][part, None]
                if (dx * dx + dy * dy <= eps_sq).any():
                    return True
                if np.ptp(small[0]) == 0 and np.ptp(small[1]) == 0:
                    break  # equal points
            continue
        if max(np.ptp(bx), np.ptp(by)) > max(np.ptp(ax), np.ptp(ay)) or len(ax) == 1:
            ax, ay, bx, by = bx, by, ax, ay
        along = ax if np.ptp(ax) >= np.ptp(ay) else ay
        middle = np.partition(along, len(along) // 2)[len(along) // 2]
        low = along < middle if (along < middle).any() else along <= middle
        halves = [(ax[h], ay[h], bx, by) for h in (low, ~low)]
        apart = [abs(float(h[0].mean()) - float(bx.mean())) + abs(float(h[1].mean()) - float(by.mean())) for h in halves]
        todo += halves if apart[0] > apart[1] else halves[::-1]
    return False


def _contracted(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``parent`` (each node's least node so far) after the edges a, b."""
    while True:
        low = np.minimum(parent[a], parent[b])
        hooked = parent.copy()
        np.minimum.at(hooked, parent[a], low)
        np.minimum.at(hooked, parent[b], low)
        while not np.array_equal(jumped := hooked[hooked], hooked):
            hooked = jumped
        if np.array_equal(hooked, parent):
            return parent
        parent = hooked


def components(cores: _Cells, own: np.ndarray, params: Params) -> np.ndarray:
    """The least cell of each cell's component, over pairs of core cells of which one at least is ``own``.

    Pairs that four extreme points of either cell settle are contracted first. The others are looked at in rising
    number of point pairs, in batches; a pair whose ends are in one component by then is dropped.
    """
    eps_sq = np.float32(params.eps_sq)
    parent = np.arange(len(cores.n))
    a, b = cores.at(parent, HALF, cores)
    close = (own[a] | own[b]) & (cores.gap(a, cores, b) <= eps_sq)
    a, b = a[close], b[close]
    sure = cores.span(a, cores, b) <= eps_sq
    extreme = cores.extremes() if len(a) else []
    for p in extreme:
        for q in extreme:
            dx, dy = cores.x[q[b]] - cores.x[p[a]], cores.y[q[b]] - cores.y[p[a]]
            sure |= dx * dx + dy * dy <= eps_sq
    parent = _contracted(parent, a[sure], b[sure])
    a, b = a[~sure], b[~sure]
    while True:
        apart = parent[a] != parent[b]
        a, b = a[apart], b[apart]
        if not len(a):
            return parent
        size = cores.n[a] * cores.n[b]
        order = np.argsort(size, kind="stable")
        a, b, size = a[order], b[order], size[order]
        now = next(_blocks(size))
        ends = [slice(cores.start[c], cores.start[c] + cores.n[c]) for c in (a[0], b[0])]
        if size[0] > BLOCK:
            found = np.array([within_reach(cores.x[ends[0]], cores.y[ends[0]], cores.x[ends[1]], cores.y[ends[1]], eps_sq)])
        else:
            found = np.zeros(now.stop, bool)
            row, p = cores.points_of(a[now])
            near, _ = cores.to_box(cores.x[p], cores.y[p], b[now][row])
            row, p = row[near <= eps_sq], p[near <= eps_sq]
            for of, _, d2 in _met(cores.x[p], cores.y[p], cores, b[now][row]):
                found[row[of[d2 <= eps_sq]]] = True
        parent = _contracted(parent, a[now][found], b[now][found])
        a, b = a[now.stop :], b[now.stop :]


def nearest_cores(others: _Cells, cores: _Cells, core_ids: np.ndarray, params: Params) -> np.ndarray:
    """For each point of ``others`` its nearest core point within eps, ties to the smaller id; -1 if there is none.

    The farthest corner of any box bounds the nearest distance, so boxes beyond it are dropped before points meet.
    """
    eps_sq = np.float32(params.eps_sq)
    best = np.full(len(others.x), -1)
    a, b = others.at(np.arange(len(others.n)), FULL, cores)
    close = others.gap(a, cores, b) <= eps_sq
    row, p = others.points_of(a[close])
    b = b[close][row]
    near, far = cores.to_box(others.x[p], others.y[p], b)
    bound = np.full(len(others.x), eps_sq)
    np.minimum.at(bound, p, far)
    keep = near <= bound[p]
    p, b = p[keep], b[keep]
    least = np.full(len(others.x), np.float32(np.inf))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
    for row, q, d2 in _met(others.x[p], others.y[p], cores, b):
        ok = d2 <= bound[p[row]]
        row, q, d2 = p[row[ok]], q[ok], d2[ok]
        np.minimum.at(least, row, d2)
        ok = d2 == least[row]
        found.append((row[ok], q[ok], d2[ok]))
    row, q, d2 = (np.concatenate(c) for c in zip(*found, strict=True))
    ok = d2 == least[row]
    row, q = row[ok], q[ok]
    order = np.lexsort((core_ids[q], row))
    first = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
    best[row[first]] = q[first]
    return best


@dataclass
class Solved:
    """Of the points in the order given: whether they are the tile's ``own``, ``core``, and the cell that names their component
    in this tile (``NOISE`` for noise); of components with own core points: ``names`` and the smallest own core id;
    ``links``: pairs of a name and another core cell of its component that other tiles know too."""

    own: np.ndarray
    core: np.ndarray
    root: np.ndarray
    names: np.ndarray
    first_core: np.ndarray
    links: tuple[np.ndarray, np.ndarray]


def solve(ids: np.ndarray, x: np.ndarray, y: np.ndarray, params: Params, where: Rectangle = WHOLE) -> Solved:
    """Everything about the points whose cells are ``where``, given all points of up to four cells around."""
    given_x, given_y = cell_coordinates(x, y, params)
    order = np.argsort(pack(given_x, given_y), kind="stable")
    ids, x, y, kx, ky = (v[order] for v in (ids, x, y, given_x, given_y))
    key = pack(kx, ky)
    cells = _Cells(x, y, kx, ky, key)
    mine = cells.around(where, 0)[cells.of]
    core = core_marks(cells, cells.around(where, 2), params)
    inside = np.flatnonzero(core)
    cores = _Cells(x[inside], y[inside], kx[inside], ky[inside], key[inside])
    own = cores.around(where, 0)
    parent = components(cores, own, params)
    # the least cell by key is the least by position, as cells are sorted
    root = np.full(len(x), NOISE)
    root[inside] = cores.key[parent[cores.of]]
    outside = np.flatnonzero(~core & mine)
    others = _Cells(x[outside], y[outside], kx[outside], ky[outside], key[outside])
    best = nearest_cores(others, cores, ids[inside], params)
    found = best >= 0
    root[outside[found]] = cores.key[parent[cores.of[best[found]]]]
    # cells that other tiles have in their two rings: those at the rim, and those around
    inner = (where[0] + 2, where[1] - 2, where[2] + 2, where[3] - 2)
    shared = ~cores.around(inner, 0) & (parent != np.arange(len(parent)))
    of = inside[mine[inside]]
    names, at = np.unique(root[of], return_inverse=True)
    first = np.full(len(names), np.iinfo(np.int64).max)
    np.minimum.at(first, at, ids[of])
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return Solved(mine[back], core[back], root[back], names, first, (cores.key[parent[shared]], cores.key[shared]))


def numbered(names: np.ndarray, first_core: np.ndarray, links: tuple[np.ndarray, np.ndarray], numbering: str) -> tuple[np.ndarray, np.ndarray]:
    """(cell, cluster) for all cells in ``names`` and ``links``: components over the links, numbered by their least cell
    or by their smallest core id."""
    nodes, inverse = np.unique(np.concatenate([names, *links]), return_inverse=True)
    at, a, b = np.split(inverse, [len(names), len(names) + len(links[0])])
    parent = _contracted(np.arange(len(nodes)), a, b)
    by = np.full(len(nodes), np.iinfo(np.int64).max)
    np.minimum.at(by, parent[at], first_core if numbering == "first_core" else parent[at])
    roots = np.unique(parent)
    number = np.empty(len(nodes), np.int64)
    number[roots[np.argsort(by[roots], kind="stable")]] = np.arange(len(roots))
    return nodes, number[parent]


def cluster(ids: np.ndarray, x: np.ndarray, y: np.ndarray, params: Params, numbering: str) -> np.ndarray:
    """The label of each point of one tile that is all there is; -1 for noise."""
    s = solve(ids, x, y, params)
    nodes, number = numbered(s.names, s.first_core, s.links, numbering)
    label = np.full(len(ids), -1, np.int32)
    known = s.root != NOISE
    label[known] = number[np.searchsorted(nodes, s.root[known])]
    return label
