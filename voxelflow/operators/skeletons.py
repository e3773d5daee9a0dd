"""Skeletons of one volume: thinning, a tree of shortest paths, and the graph of a skeleton. Numpy kernels, one volume a task."""

from __future__ import annotations

from functools import cache
from itertools import product

import numpy as np

from .components import local_labels

_AROUND = [d for d in product((-1, 0, 1), repeat=3) if any(d)]
_FACES = [d for d in _AROUND if sum(map(abs, d)) == 1]
_WITHIN_18 = [d for d in _AROUND if sum(map(abs, d)) < 3]
#: Paths, penalty scale and exponent of the shortest-path skeleton, for much and little detail, and where the first finds too little.
PATHS = {"fine": {"scale": 0.4, "const": 30.0, "penalty": 1e5, "exponent": 4.0, "max_paths": 2500}, "mild": {"scale": 1.2, "const": 150.0, "penalty": 1e5, "exponent": 4.0, "max_paths": 200}, "retry": {"scale": 0.5, "const": 50.0, "penalty": 1e5, "exponent": 4.0, "max_paths": 500}}


def _parts(cells: list, near: list) -> list[set]:
    left, out = set(cells), []
    while left:
        todo = [left.pop()]
        part = set(todo)
        while todo:
            c = todo.pop()
            for d in near:
                n = (c[0] + d[0], c[1] + d[1], c[2] + d[2])
                if n in left:
                    left.remove(n)
                    part.add(n)
                    todo.append(n)
        out.append(part)
    return out


@cache
def _removable(code: int) -> bool:
    """Whether a cell with these neighbours (a bit each) can go: one part inside, one outside by faces, and no end of a line."""
    inside = [d for i, d in enumerate(_AROUND) if code >> i & 1]
    if len(inside) < 2 or len(_parts(inside, _AROUND)) != 1:
        return False
    outside = [d for d in _WITHIN_18 if d not in set(inside)]
    return sum(any(f in part for f in _FACES) for part in _parts(outside, _FACES)) == 1


def thin(mask: np.ndarray) -> np.ndarray:
    """A mask reduced to lines: cells are taken from six sides in turn while that keeps its parts, tunnels and ends.

    Cells of like parity along all axes never touch, so of each of the eight classes all that can go do so at once: neighbour codes are
    gathered for whole arrays, and each different code is judged once.
    """
    m = np.pad(mask.astype(bool), 1)
    flat, sides = m.reshape(-1), m.shape
    step = lambda d: (d[0] * sides[1] + d[1]) * sides[2] + d[2]
    around = [step(d) for d in _AROUND]
    left = np.flatnonzero(flat)
    while True:
        before = len(left)
        for face in _FACES:
            free = left[~flat[left + step(face)]]
            z, y, x = np.unravel_index(free, sides)
            parity = (z % 2) * 4 + (y % 2) * 2 + x % 2
            gone = 0
            for k in range(8):
                cells = free[parity == k]
                if not len(cells):
                    continue
                code = np.zeros(len(cells), np.int64)
                for i, o in enumerate(around):
                    code |= flat[cells + o].astype(np.int64) << i
                different, which = np.unique(code, return_inverse=True)
                can = np.fromiter(map(_removable, different.tolist()), bool, len(different))[which]
                flat[cells[can]] = False
                gone += int(can.sum())
            if gone:
                left = left[flat[left]]
        if len(left) == before:
            return m[1:-1, 1:-1, 1:-1]


def skeleton_graph(skeleton: np.ndarray, ends_at_nodes: bool = True) -> tuple[list[np.ndarray], list[tuple[int, int, np.ndarray]]]:
    """Nodes, by their rounded centres, and edges (node, node, points in order) of a thin mask.

    Cells with one, or more than two, of 26 neighbours are nodes, touching ones together; runs of the others between nodes are edges. A
    run that closes on itself has a node at its first cell. With `ends_at_nodes` an edge's points begin and end at its nodes.
    """
    cells = set(map(tuple, np.argwhere(skeleton).tolist()))
    near = {c: [n for d in _AROUND if (n := (c[0] + d[0], c[1] + d[1], c[2] + d[2])) in cells] for c in cells}
    knots = {c for c, n in near.items() if len(n) != 2}
    rest = cells - knots
    loops = [p for p in _parts(sorted(rest), _AROUND) if not any(n in knots for c in p for n in near[c])]
    for loop in loops:
        knots.add(min(loop))
    groups = sorted((sorted(p) for p in _parts(sorted(knots), _AROUND)), key=lambda g: g[0])
    where = {c: i for i, g in enumerate(groups) for c in g}
    nodes = [np.rint(np.mean(g, axis=0)).astype(np.int64) for g in groups]
    edges, used = [], set()
    for i, g in enumerate(groups):
        for c in g:
            for first in sorted(near[c]):
                if first in where or first in used:
                    continue
                path, last = [first], c
                while path[-1] not in where:
                    used.add(path[-1])
                    ahead = [n for n in near[path[-1]] if n != last and n not in used]
                    ahead.sort(key=lambda n: (n not in where, n))
                    if not ahead:
                        break
                    last = path[-1]
                    path.append(ahead[0])
                if path[-1] in where:
                    j = where[path[-1]]
                    points = np.array([c, *path])
                    if ends_at_nodes:
                        points[0], points[-1] = nodes[i], nodes[j]
                    edges.append((i, j, points))
    return nodes, edges


def depth(mask: np.ndarray) -> np.ndarray:
    """The distance of every cell of a mask to the nearest cell outside, the border of the array counting as outside."""
    out = np.pad(np.where(mask, np.inf, 0.0), 1)
    for axis in range(3):
        n = out.shape[axis]
        moved = np.moveaxis(out, axis, 0)
        best = np.full_like(moved, np.inf)
        for shift in range(-(n - 1), n):
            if shift and (shift * shift >= moved[np.isfinite(moved)].max(initial=0) + n * n):
                continue
            a, b = max(0, shift), min(n, n + shift)
            best[a:b] = np.minimum(best[a:b], moved[a - shift : b - shift] + shift * shift)
        out = np.moveaxis(best, 0, axis)
    return np.sqrt(out[1:-1, 1:-1, 1:-1])


def _near(cells: np.ndarray, shape: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """For cells in order, the numbers of their 26 neighbours, their own where one is missing, and the lengths of the steps."""
    sides = [n + 2 for n in shape]
    number = lambda p: ((p[:, 0] + 1) * sides[1] + p[:, 1] + 1) * sides[2] + p[:, 2] + 1
    index = number(cells)
    out = np.empty((len(cells), len(_AROUND)), np.int64)
    for i, d in enumerate(_AROUND):
        wanted = index + (d[0] * sides[1] + d[1]) * sides[2] + d[2]
        at = np.minimum(np.searchsorted(index, wanted), len(index) - 1)
        out[:, i] = np.where(index[at] == wanted, at, np.arange(len(index)))
    return out, np.sqrt([sum(map(abs, d)) for d in _AROUND])


def _shortest(near: np.ndarray, steps: np.ndarray, cost: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Least sums of cell costs from a start, and each cell's cell before: cells that came nearer pass it on until none does."""
    far, before = np.full(len(near), np.inf), np.arange(len(near))
    far[start] = 0.0
    front = np.array([start])
    while len(front):
        to = near[front].ravel()
        new = (far[front][:, None] + cost[near[front]] * steps).ravel()
        source = np.repeat(front, len(steps))
        better = new < far[to] - 1e-12
        to, new, source = to[better], new[better], source[better]
        order = np.lexsort((source, new, to))
        to, new, source = to[order], new[order], source[order]
        first = np.ones(len(to), bool)
        first[1:] = to[1:] != to[:-1]
        front = to[first]
        far[front], before[front] = new[first], source[first]
    return far, before


def path_skeleton(mask: np.ndarray, scale: float, const: float, penalty: float, exponent: float, max_paths: int) -> list[np.ndarray]:
    """A tree of paths, from the cell furthest from an end to what isn't covered yet, along the middle of the mask.

    A path covers the cells within scale * depth + const of it. Each connected part has a tree of its own; longest first.
    """
    cells = np.argwhere(mask)
    if not len(cells):
        return []
    deep_all = depth(mask)[tuple(cells.T)]
    labels = local_labels(*cells.T, *mask.shape[1:], 26)
    out = []
    for label in np.unique(labels):
        part, deep = cells[labels == label], deep_all[labels == label]
        near, steps = _near(part, mask.shape)
        even = np.ones(len(part))
        root = int(_shortest(near, steps, even, 0)[0].argmax())
        far, _ = _shortest(near, steps, even, root)
        _, before = _shortest(near, steps, 1e-3 + penalty * (1 - deep / (1.01 * deep.max())) ** exponent, root)
        left, covered, lines = np.ones(len(part), bool), np.zeros(len(part), bool), []
        covered[root] = True
        while left.any() and len(lines) < max_paths:
            path = [int(np.where(left, far, -1.0).argmax())]
            while not covered[path[-1]]:
                path.append(int(before[path[-1]]))
            lines.append(part[path])
            covered[path] = True
            for p in path:
                reach = scale * deep[p] + const
                at = np.flatnonzero(left)
                left[at[((part[at] - part[p]) ** 2).sum(axis=1) <= reach * reach]] = False
                if not left.any():
                    break
        out.append((int(covered.sum()), lines))
    return [line for _, lines in sorted(out, key=lambda x: -x[0]) for line in lines]


def path_graph(lines: list[np.ndarray]) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray]]]:
    """Nodes and edges of a tree of paths: every point is a node, by its first appearance; an edge joins two that follow one another.

    An edge's points lie evenly between its ends, max(int(distance) + 1, 2) of them, cut to integers; their number is its weight.
    """
    number: dict[tuple[int, ...], int] = {}
    edges: dict[tuple[int, int], np.ndarray] = {}
    for line in lines:
        points = [tuple(map(int, p)) for p in line]
        for p in points:
            number.setdefault(p, len(number))
        for p, q in zip(points[:-1], points[1:], strict=True):
            ends = number[p], number[q]
            if ends[0] != ends[1] and ends not in edges and ends[::-1] not in edges:
                n = max(int(float(np.linalg.norm(np.subtract(q, p)))) + 1, 2)
                edges[ends] = (np.array(p) + np.linspace(0, 1, n)[:, None] * np.subtract(q, p)).astype(np.int64)
    return np.array(list(number), np.int64).reshape(-1, 3), [(a, b, line) for (a, b), line in edges.items()]
