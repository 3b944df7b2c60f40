"""The one-to-one matching of a crowded key (J12), from its places: its pairs are never listed.

Pairs come first, so a mark can be left over only on one side of the plane's parts: where truth abounds
every found mark has a partner, where found marks abound every truth, elsewhere both (the parts of
Dulmage and Mendelsohn). Breadth-first searches over the places find the parts; pairs across parts
are in no matching of most pairs. Within a part one side is matched whole, at least cost: first over
the nearest partners of each mark, then all pairs within reach are held against the prices found,
box by box, and those that undercut them are taken in, until none does. Prices are kept meanwhile.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np

NEAREST = 6           # partners each mark starts with
PAIRS_AT_ONCE = 1_000_000
FINER = 8             # boxes a side of the reach is cut into
FREE, HOLE = -1, -2   # columns without a row: spare ones, and ones a row has just left


class Grid:
    """Places by square cell."""

    def __init__(self, at: np.ndarray, size: float):
        self.size = size
        self.cell = np.floor(at / size).astype(np.int64)
        self.low, self.span = (self.cell.min(axis=0) - 1, self.cell.max(axis=0) - self.cell.min(axis=0) + 3) if len(at) else (np.zeros(2, np.int64), np.ones(2, np.int64))
        code = self.code(self.cell)
        self.order = np.argsort(code, kind="stable")
        self.codes, self.first, self.count = np.unique(code[self.order], return_index=True, return_counts=True)

    def code(self, cell: np.ndarray) -> np.ndarray:
        """One number a cell; -1 where no place can be."""
        c = cell - self.low
        return np.where(((c >= 0) & (c < self.span)).all(axis=1), c[:, 0] * self.span[1] + c[:, 1], -1)

    def find(self, cell: np.ndarray) -> np.ndarray:
        """Number of each cell among the occupied ones, or -1."""
        if not len(self.codes):
            return np.full(len(cell), -1)
        code = self.code(cell)
        k = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[k] == code, k, -1)


def spread_out(left: np.ndarray, first: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(left[k], first[k] .. first[k] + count[k] - 1) for all k, about so many pairs at once."""
    total = np.cumsum(count)
    at = 0
    while at < len(count):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS_AT_ONCE)))
        n = count[at:end]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(left[at:end], n), np.repeat(first[at:end], n) + step
        at = end


def gap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.hypot(a[:, 0] - b[:, 0], a[:, 1] - b[:, 1])


def nearest_pairs(a: np.ndarray, b: np.ndarray, r: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within ``r`` of each place of ``a`` with the ``k`` nearest of ``b``: circles grow until they hold so many."""
    open_, out, size = np.arange(len(a)), [], r / 32
    while len(open_) and len(b):
        size = min(size, r)
        grid, i, j, d = Grid(b, size), [], [], []
        cell = np.floor(a[open_] / size).astype(np.int64)
        near = [(open_[(f := grid.find(cell + (dx, dy))) >= 0], f[f >= 0]) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
        rows, cells = (np.concatenate(x) for x in zip(*near, strict=True))
        turn = np.argsort(rows, kind="stable")  # a row's pairs come together
        for p, q in spread_out(rows[turn], grid.first[cells[turn]], grid.count[cells[turn]]):
            q = grid.order[q]
            dist = gap(a[p], b[q])
            ok = dist <= size
            p, q, dist = _best(p[ok], q[ok], dist[ok], k)
            i.append(p), j.append(q), d.append(dist)
        i, j, _ = _best(*(np.concatenate(x) if x else np.zeros(0, int) for x in (i, j, d)), k)
        full = np.bincount(i, minlength=len(a)) >= min(k, len(b)) if size < r else np.ones(len(a), bool)
        out.append((i[full[i]], j[full[i]]))
        open_, size = open_[~full[open_]], size * 2
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int))


def _best(i: np.ndarray, j: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` pairs of each ``i`` with the least ``d``."""
    order = np.lexsort((j, d, i))
    i, j, d = i[order], j[order], d[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    return i[rank < k], j[rank < k], d[rank < k]


def reached(frontier: np.ndarray, at: np.ndarray, r: float) -> np.ndarray:
    """For each place some row of ``frontier`` within ``r`` of it, or -1."""
    out = np.full(len(at), -1)
    if not len(frontier) or not len(at):
        return out
    grid = Grid(frontier, r)
    cell = np.floor(at / r).astype(np.int64)
    for dx, dy in sorted(((x, y) for x in (-1, 0, 1) for y in (-1, 0, 1)), key=lambda o: abs(o[0]) + abs(o[1])):
        open_ = np.flatnonzero(out < 0)
        f = grid.find(cell[open_] + (dx, dy))
        open_, f = open_[f >= 0], f[f >= 0]
        done = 0
        while len(open_):
            some = np.minimum(grid.count[f] - done, 8 + done)  # most are near one of the first
            for p, q in spread_out(np.arange(len(open_)), grid.first[f] + done, some):
                q = grid.order[q]
                ok = gap(at[open_[p]], frontier[q]) <= r
                out[open_[p[ok]]] = q[ok]
            done += 8 + done
            more = (out[open_] < 0) & (grid.count[f] > done)
            open_, f = open_[more], f[more]
    return out


def search(a: np.ndarray, b: np.ndarray, r: float, mate: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Alternating paths from all free ``a``, breadth first: (those of a reached, of b reached, whether the matching grew)."""
    in_a, in_b = mate < 0, np.zeros(len(b), bool)
    root, parent = np.where(in_a, np.arange(len(a)), -1), np.full(len(b), -1)
    front, grew, spent = np.flatnonzero(in_a), False, set()
    while len(front):
        left = np.flatnonzero(~in_b)
        by = reached(a[front], b[left], r)
        left, by = left[by >= 0], front[by[by >= 0]]
        in_b[left], parent[left] = True, by
        for j in left[owner[left] < 0].tolist():
            if int(root[parent[j]]) in spent:
                continue
            spent.add(int(root[parent[j]]))
            grew = True
            while j >= 0:  # trees of different roots share no mark
                i = int(parent[j])
                owner[j], j, mate[i] = i, int(mate[i]), j
        front = owner[left]
        if grew:  # trees that have grown a path are done with
            live = ~np.isin(root[by], list(spent))
            front, by = front[live], by[live]
        in_a[front], root[front] = True, root[by]
    return in_a, in_b, grew


def most_pairs(a: np.ndarray, b: np.ndarray, r: float, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A matching of most pairs within ``r``: partners of ``a`` and of ``b``. Grown over the pairs (i, j) first, then over all."""
    mate, owner = np.full(len(a), -1), np.full(len(b), -1)
    order = np.argsort(gap(a[i], b[j]), kind="stable")
    m, o = mate.tolist(), owner.tolist()
    for p, q in zip(i[order].tolist(), j[order].tolist(), strict=True):
        if m[p] < 0 and o[q] < 0:
            m[p], o[q] = q, p
    first = np.searchsorted(i, np.arange(len(a) + 1)).tolist()
    to = j.tolist()
    seen = [-1] * len(b)
    more, turn = True, 0
    while more:  # depth first over the listed pairs, each column once a round
        more, turn = False, turn + 1
        for start in range(len(a)):
            if m[start] >= 0 or first[start] == first[start + 1]:
                continue
            path, at = [start], {start: first[start]}
            via = []
            while path:
                p = path[-1]
                if at[p] == first[p + 1]:
                    path.pop()
                    via and via.pop()
                    continue
                q = to[at[p]]
                at[p] += 1
                if seen[q] == turn:
                    continue
                seen[q] = turn
                via.append(q)
                if o[q] < 0:
                    for p, q in zip(path, via, strict=True):
                        m[p], o[q] = q, p
                    more = True
                    break
                path.append(o[q])
                at[o[q]] = first[o[q]]
    mate[:], owner[:] = m, o
    while search(a, b, r, mate, owner)[2]:
        pass
    return mate, owner


def undercut(a: np.ndarray, b: np.ndarray, r: float, u: np.ndarray, v: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs within ``r`` nearer than ``u + v`` of their ends, the worst few a row. Boxes too far apart for their prices are passed over."""
    size = r / FINER
    ga, gb = Grid(a, size), Grid(b, size)
    top = lambda g, w: np.maximum.reduceat(w[g.order], g.first)
    ua, vb = top(ga, u), top(gb, v)
    cell = ga.cell[ga.order[ga.first]]
    out = []
    for dx in range(-FINER - 1, FINER + 2):
        for dy in range(-FINER - 1, FINER + 2):
            apart = np.hypot(max(0, abs(dx) - 1), max(0, abs(dy) - 1)) * size * (1 - 1e-9)
            if apart > r:
                continue
            f = gb.find(cell + (dx, dy))
            here = np.flatnonzero((f >= 0) & (ua + np.where(f >= 0, vb[f], 0) > apart))
            if len(here):
                out.append((here, f[here]))
    if not out:
        return tuple(np.zeros(0, t) for t in (int, int, float))
    ca, cb = (np.concatenate(x) for x in zip(*out, strict=True))
    found = []
    # each row of a box of a, then each of b
    for c, k in spread_out(np.arange(len(ca)), ga.first[ca], ga.count[ca]):
        for p, q in spread_out(ga.order[k], gb.first[cb[c]], gb.count[cb[c]]):
            q = gb.order[q]
            d = gap(a[p], b[q])
            ok = (d <= r) & (d < u[p] + v[q] - slack)
            found.append((p[ok], q[ok], (d - u[p] - v[q])[ok]))
    p, q, w = _best(*(np.concatenate(x) for x in zip(*found, strict=True)), 6)
    return p, q, gap(a[p], b[q])


class Prices:
    """Each row matched with a column of its own, at least cost, over pairs that may be added to.

    Free columns are held by spare rows to whom all columns are alike; their common price is ``free``,
    and no column's is higher. So all columns have a row and any prices are a fair start.
    """

    def __init__(self, n: int, m: int):
        self.to: list[list[int]] = [[] for _ in range(n)]
        self.cost: list[list[float]] = [[] for _ in range(n)]
        self.v, self.owner, self.mate, self.paid = [0.0] * m, [FREE] * m, [-1] * n, [0.0] * n
        self.free, self.holes = 0.0, set()

    def add(self, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> None:
        for p, q, c in zip(i.tolist(), j.tolist(), d.tolist(), strict=True):
            self.to[p].append(q)
            self.cost[p].append(c)
            if (old := self.mate[p]) >= 0:
                self.mate[p], self.owner[old] = -1, HOLE
                self.holes.add(old)

    def settle(self, rows: list[int]) -> None:
        """Match ``rows``, each by the way of least cost: over columns' rows, and over the spare ones while there are holes."""
        v, owner, mate, paid, holes = self.v, self.owner, self.mate, self.paid, self.holes
        for start in rows:
            best: dict[int, float] = {}
            way: dict[int, tuple[int, float]] = {}
            settled: dict[int, float] = {}
            heap: list[tuple[float, int]] = []
            row, base, spare, bound = start, 0.0, -1, float("inf")
            while True:
                if row >= 0:
                    for j, c in zip(self.to[row], self.cost[row]):
                        d = base + c - v[j]
                        if d < bound and d < best.get(j, bound) and j not in settled:
                            best[j], way[j] = d, (row, c)
                            heappush(heap, (d, j))
                            if owner[j] == HOLE or owner[j] == FREE and not holes:
                                bound = d + 1e-12 * abs(d)
                while heap[0][1] in settled or heap[0][0] > best[heap[0][1]]:
                    heappop(heap)
                d, j = heappop(heap)
                settled[j] = d
                row = owner[j]
                if row == HOLE or row == FREE and not holes:
                    end = j
                    break
                if row >= 0:
                    base = d - (paid[row] - v[j])
                elif spare < 0:
                    spare = j  # its spare row may take any other column; the others' rows are like it
                    bound = min(bound, (d + self.free - max(v[k] for k in holes)) * (1 + 1e-12) + 1e-12)
                    for k, price in enumerate(v):
                        e = d + self.free - price
                        if e < bound and k not in settled and e < best.get(k, bound):
                            best[k], way[k] = e, (-1, 0.0)
                            heappush(heap, (e, k))
            reach = settled[end]
            for j, d in settled.items():
                if d < reach:
                    v[j] += d - reach
            if spare >= 0:
                # all spare rows' columns are as far as the first
                self.free += min(0.0, settled[spare] - reach)
                for k, p in enumerate(owner):
                    if p == FREE:
                        v[k] = self.free
            holes.discard(end)
            while True:
                row, c = way[end]
                if row < 0:
                    owner[end], v[end] = FREE, self.free
                    end = spare
                    continue
                owner[end] = row
                old, mate[row], paid[row] = mate[row], end, c
                if row == start:
                    break
                end = old


def cheapest(a: np.ndarray, b: np.ndarray, r: float, mate: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Partners of all ``a`` in ``b`` of least total distance, where ``mate`` is some choice of partners within ``r``."""
    rows = np.arange(len(a))
    code = np.unique(np.concatenate([pairs[0] * len(b) + pairs[1], rows * len(b) + mate]))
    i, j = code // len(b), code % len(b)
    d = gap(a[i], b[j])
    lonely = np.argsort(-np.bincount(i, d, len(a)) / np.bincount(i, minlength=len(a)), kind="stable")
    p, todo, first = Prices(len(a), len(b)), lonely, True
    p.add(i, j, d)
    while len(todo):
        p.settle(todo.tolist())
        got = np.array(p.mate)
        v = np.array(p.v)
        u = gap(a, b[got]) - v[got]
        more = undercut(a, b, r, u, v, 1e-9 * (1 + r))
        todo = np.unique(more[0])
        if first and len(todo) > len(a) / 8:  # over the nearest alone, prices lie so far off that they are sooner found anew
            p, todo, first = Prices(len(a), len(b)), lonely, False
            p.add(i, j, d)
        p.add(*more)
    return np.array(p.mate)


def match_places(a: np.ndarray, b: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """The one-to-one pairs (i, j) of places within ``r``: most pairs, then least total distance."""
    if not len(a) or not len(b):
        return np.zeros(0, int), np.zeros(0, int)
    i, j = nearest_pairs(a, b, r, NEAREST)
    q, p = nearest_pairs(b, a, r, NEAREST)
    code = np.unique(np.concatenate([i * len(b) + j, p * len(b) + q]))
    i, j = code // len(b), code % len(b)
    mate, owner = most_pairs(a, b, r, i, j)
    many_a = search(a, b, r, mate, owner)[:2]
    many_b = search(b, a, r, owner, mate)[1::-1]
    out = []
    rest = ~(many_a[0] | many_b[0]), ~(many_a[1] | many_b[1])
    for side, (in_a, in_b) in (("a", many_b), ("a", rest), ("b", many_a)):
        x, y = np.flatnonzero(in_a), np.flatnonzero(in_b)
        inside = in_a[i] & in_b[j]
        pair = np.searchsorted(x, i[inside]), np.searchsorted(y, j[inside])
        if side == "b" and len(y):
            out.append((x[cheapest(b[y], a[x], r, np.searchsorted(x, owner[y]), pair[::-1])], y))
        elif side == "a" and len(x):
            out.append((x, y[cheapest(a[x], b[y], r, np.searchsorted(y, mate[x]), pair)]))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int))
