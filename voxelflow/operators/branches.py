"""Branches of a tree: polylines are simplified and densified, a branch's cells are smoothed by frustums, gaps are filled.

Each branch is a group of its own, modelled in numpy in one task from its own cells and polyline; branches don't wait for each
other. Gap filling is a second pass that joins a branch to the one before it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.offsets import box
from ..functions.geometry import facets, fit_ellipse, hull_2d, in_hull_2d, points_in_ellipse, points_in_frustum, principal_axes, triangle_area

#: Least triangle areas that are tried for a branch, coarse to fine, and the one used without trying.
AREAS, AREA = (20.0, 15.0, 10.0, 5.0, 2.0, 1.0), 10.0
#: Points whose gaps are filled together.
TOGETHER = 1 << 15
#: Points put between neighbours, and how many neighbours a point has.
FACTOR, NEIGHBOURS = 100, 10


# ---- polylines ------------------------------------------------------------------------------------------------------


def simplify(points: np.ndarray, least: float = 0.51) -> np.ndarray:
    """The points left when the one that spans the smallest triangle with its neighbours goes, until none spans less than `least`.

    Ends stay. Areas that were entered before a neighbour went are still honoured, as they come up.
    """
    n = len(points)
    if n <= 2:
        return points
    p = np.asarray(points, float)
    before, after, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n

    def area(i: int) -> float:
        u, v = p[i] - p[before[i]], p[after[i]] - p[before[i]]
        return 0.5 * float(np.linalg.norm(np.cross(u, v)))

    queue = [(area(i), i) for i in range(1, n - 1)]
    heapq.heapify(queue)
    while queue:
        size, i = heapq.heappop(queue)
        if not alive[i]:
            continue
        if size >= least:
            break
        alive[i] = False
        a, b = before[i], after[i]
        after[a], before[b] = b, a
        for j in (a, b):
            if 0 < j < n - 1:
                heapq.heappush(queue, (area(j), j))
    return points[np.array(alive)]


def kept_indices(points: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Where the points stand that are among the kept ones, by value."""
    if not len(points) or not len(kept):
        return np.zeros(0, np.int64)
    _, which = np.unique(np.concatenate([points, kept]), axis=0, return_inverse=True)
    return np.flatnonzero(np.isin(which[: len(points)], which[len(points) :]))


def segmentations(points: np.ndarray, adaptive: bool = True) -> list[np.ndarray]:
    """Index lists of the breaks of a polyline: its ends, then what each area of AREAS leaves, without repetitions."""
    out = [np.array([0, len(points) - 1])] if adaptive else []
    for least in AREAS if adaptive else (AREA,):
        found = kept_indices(points, simplify(points, least))
        if not any(np.array_equal(found, x) for x in out):
            out.append(found)
    return out


def _all_pairs(p: np.ndarray, which: np.ndarray, k: int) -> np.ndarray:
    out = []
    for a in range(0, len(which), 512):
        near = ((p[which[a : a + 512], None] - p[None]) ** 2).sum(axis=2)
        out.append(np.lexsort((np.broadcast_to(np.arange(len(p)), near.shape), near), axis=1)[:, :k])
    return np.concatenate([np.zeros((0, k), np.int64), *out])


def nearest(points: np.ndarray, k: int) -> np.ndarray:
    """(n, k): numbers of each point's nearest points, itself included, by distance and number.

    Cells of a grid, no two alike, look around themselves first; only what finds too few within reach is compared with all.
    """
    p = np.asarray(points, float)
    todo = np.arange(len(p))
    if len(p) <= 1024 or (p != np.rint(p)).any() or np.ptp(p, axis=0).prod() > 2**50:
        return _all_pairs(p, todo, k)
    cells = (p - p.min(axis=0)).astype(np.int64) + 4
    sides = cells.max(axis=0) + 5
    code = (cells[:, 0] * sides[1] + cells[:, 1]) * sides[2] + cells[:, 2]
    order = np.argsort(code, kind="stable")
    ranked = code[order]
    if (ranked[1:] == ranked[:-1]).any():
        return _all_pairs(p, todo, k)
    out = np.zeros((len(p), k), np.int64)
    for reach in (2, 4):
        around = np.array(box(reach, reach, reach))
        length2 = (around**2).sum(axis=1)
        around, length2 = around[length2 <= reach * reach], length2[length2 <= reach * reach]
        steps = (around[:, 0] * sides[1] + around[:, 1]) * sides[2] + around[:, 2]
        left = []
        for a in range(0, len(todo), 4096):
            part = todo[a : a + 4096]
            wanted = code[part][:, None] + steps
            at = np.minimum(np.searchsorted(ranked, wanted), len(ranked) - 1)
            name = np.where(ranked[at] == wanted, length2 * len(p) + order[at], np.iinfo(np.int64).max)
            name = np.sort(name, axis=1)[:, :k]
            full = name.shape[1] == k and name[:, -1] < np.iinfo(np.int64).max
            full = np.broadcast_to(full, len(part))
            out[part[full]] = name[full] % len(p)
            left.append(part[~full])
        todo = np.concatenate([np.zeros(0, np.int64), *left])
    out[todo] = _all_pairs(p, todo, k)
    return out


def densify(points: np.ndarray, factor: int = 2, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """The points, and factor - 1 points evenly between each and those of its nearest neighbours that come after it.

    A point counts among its own neighbours; of equally near ones those of smaller index come first.
    """
    p = np.asarray(points, float)
    n = len(p)
    if n < 2 or factor < 2:
        return p.copy()
    order = nearest(p, min(neighbours, n))
    i, j = np.nonzero(order > np.arange(n)[:, None])
    first, second = p[i], p[order[i, j]]
    steps = (np.arange(1, factor) / factor)[None, :, None]
    return np.concatenate([p, (first[:, None] + steps * (second - first)[:, None]).reshape(-1, 3)])


def densified(points: DataFrame, by: str, order: str, factor: int = 2, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(by, z, y, x): `densify` of each polyline; many polylines are one group, so that short ones cost no call each."""
    groups = max(1, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kind = dict(points.dtypes)[by]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for name, own in rows.sort_values([by, order]).groupby(by, sort=False):
            p = densify(own[list("zyx")].to_numpy(), factor, neighbours)
            out.append(pd.DataFrame({by: np.full(len(p), name), **{a: p[:, i] for i, a in enumerate("zyx")}}))
        return pd.concat(out)

    dealt = points.select(by, order, *"zyx").withColumn("deal", F.pmod(F.xxhash64(by), F.lit(4 * groups)))
    return dealt.groupBy("deal").applyInPandas(run, f"{by} {kind}, z double, y double, x double")


def polyline_areas(points: DataFrame, by: str, order: str) -> DataFrame:
    """(by, order, area) of the triangle of each inner point of a polyline with its neighbours."""
    w = Window.partitionBy(by).orderBy(order)
    side = lambda f: [f(F.col(a).cast("double")).over(w) for a in "zyx"]
    area = triangle_area(side(F.lag), [F.col(a).cast("double") for a in "zyx"], side(F.lead))
    return points.select(by, order, area.alias("area")).where("area is not null")


def interpolate(points: DataFrame, by: str, order: str) -> DataFrame:
    """Cells of the straight lines between consecutive points: max(int(distance) + 1, 2) of each, both ends included, cut to integers."""
    w = Window.partitionBy(by).orderBy(order)
    ahead = points.select(by, order, *"zyx", *[F.lead(a).over(w).alias(f"{a}2") for a in "zyx"]).where("z2 is not null")
    gap = F.sqrt(sum((F.pow(F.col(f"{a}2") - F.col(a), F.lit(2.0)) for a in "zyx"), F.lit(0.0)))
    n = F.greatest(F.floor(gap).cast("int") + 1, F.lit(2))
    steps = ahead.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = [(F.col(a) + (F.col(f"{a}2") - F.col(a)) * (F.col("k") / (F.col("n") - 1))).cast("int").alias(a) for a in "zyx"]
    return steps.select(by, order, "k", *at)


def simplified(points: DataFrame, by: str, order: str, least: float = AREA) -> DataFrame:
    """The points (by, order, z, y, x) that `simplify` leaves of each polyline."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        p = rows[list("zyx")].to_numpy(float)
        return rows.iloc[kept_indices(p, simplify(p, least))][[by, order, *"zyx"]]

    kinds = dict(points.dtypes)
    return points.groupBy(by).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in (by, order, *"zyx")))


# ---- a branch's cells -----------------------------------------------------------------------------------------------


def _near(values: np.ndarray, at: float) -> np.ndarray:
    """Which heights are within a hundredth of their range of a height."""
    reach = np.ptp(values) / 100 if len(values) else 0.0
    return np.abs(values - at) <= reach + 1e-5 * abs(at)


def _limited(ellipse: tuple, limit: tuple, shrink: bool) -> tuple:
    """An ellipse held by another: its axes take the other's lengths if its major is longer; axes of no length are the other's."""
    a, b = (float(np.linalg.norm(v)) for v in ellipse[1:])
    p, q = (float(np.linalg.norm(v)) for v in limit[1:])
    if shrink and a > p and q > 0:
        return ellipse[0], ellipse[1] / max(a, 1e-300) * p, ellipse[2] / max(b, 1e-300) * q
    return (ellipse[0], limit[1], limit[2]) if a == 0 or b == 0 else ellipse


def _frustum(cells: np.ndarray, dense: np.ndarray, ends: np.ndarray, cut: bool) -> tuple[np.ndarray, list[np.ndarray], float] | None:
    """Which cells (in axes of the branch) lie between ellipses fitted at two heights; the points at them; the last one's least half axis."""
    if cut:
        axis = ends[1] - ends[0]
        along = (dense - ends[0]) @ axis / max(float(np.linalg.norm(axis)), 1e-10)
        dense = dense[(along >= 0) & (along <= np.linalg.norm(axis))]
    if not len(dense):
        return None
    bases = [dense[_near(dense[:, 0], e[0])] for e in ends]
    first, second = (fit_ellipse(b, e) for b, e in zip(bases, ends, strict=True))
    second = _limited(second, first, True)
    first = _limited(first, second, False)
    return points_in_frustum(cells, first, second), bases, float(min(np.linalg.norm(v) for v in second[1:]))


def smooth_branch(cells: np.ndarray, line: np.ndarray, segments: bool = True) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], float]:
    """A branch's cells that lie in frustums along its polyline.

    Returns the cells, the points at the first and last end, gaps (pairs of neighbouring ends to be filled), and the thickness. Breaks of the
    polyline are tried from coarse to fine; more cells are better, and two tries in a row that aren't better end the search. Tries without any
    cell don't count.
    """
    if not len(cells) or len(line) < 2:
        return np.zeros((0, 3), np.int64), [np.zeros((0, 3))] * 2, [], 0.0
    cells = np.asarray(cells, np.int64)
    dense = densify(cells, FACTOR)
    mean, axes = principal_axes(dense)
    turned, dense, path = ((np.asarray(p, float) - mean) @ axes.T for p in (cells, dense, line))
    back = lambda p: p @ axes + mean
    best: tuple = (-1, None)
    worse = 0
    for breaks in segmentations(np.asarray(line)) if segments else [np.array([0, len(line) - 1])]:
        inside = np.zeros(len(cells), bool)
        bases: list[list[np.ndarray]] = []
        thickness = 0.0
        for i, j in zip(breaks[:-1], breaks[1:], strict=True):
            stays = i != 0 or (j - i >= 2 and np.array_equal(line[i + 1], line[j - 1]))
            a, b = (i, j) if stays else (i + 1, j - 1)
            ends = path[[a, b]]
            made = _frustum(turned, dense, ends, segments)
            found = made[0] if made else np.zeros(len(cells), bool)
            if not found.any():
                for e in ends:
                    at = _near(turned[:, 0], e[0])
                    found[np.flatnonzero(at)[points_in_ellipse(turned[at], fit_ellipse(turned[at], e))]] = True
            inside |= found
            if made:
                bases.append(made[1])
                thickness = made[2]
        score = int(inside.sum())
        if score > best[0]:
            best, worse = (score, (inside, bases, thickness)), 0
        elif score:
            worse += 1
            if worse == 2:
                break
    inside, bases, thickness = best[1]
    ends = [back(bases[0][0]), back(bases[-1][1])] if bases else [np.zeros((0, 3))] * 2
    gaps = [np.concatenate([back(p[1]), back(q[0])]) for p, q in zip(bases[:-1], bases[1:], strict=True)]
    return cells[inside], ends, gaps, thickness


# ---- gaps -----------------------------------------------------------------------------------------------------------


def _line(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = int(np.abs(np.rint(b) - np.rint(a)).max()) + 1
    return np.rint(a + np.linspace(0, 1, n)[:, None] * (b - a)).astype(np.int64)


def fill_gap(points: np.ndarray) -> np.ndarray:
    """The cells between points: the point, the line between the furthest two, the polygon in their plane, or their hull.

    What the points span decides: nothing, a line, a plane or space. Only cells among the points are painted.
    """
    p = np.unique(np.asarray(points, float), axis=0)
    if len(p) < 2:
        return np.rint(p).astype(np.int64)
    mean = p.mean(axis=0)
    rank = np.linalg.matrix_rank(p - mean, tol=1e-5)
    if rank <= 1 or len(p) == 2:
        along = (p - mean) @ (p[-1] - p[0])
        return np.unique(_line(p[along.argmin()], p[along.argmax()]), axis=0)
    low, high = np.floor(p.min(axis=0)).astype(int), np.ceil(p.max(axis=0)).astype(int)
    if rank == 2:
        _, axes = principal_axes(p)
        flat = (p - mean) @ axes[:2].T
        drop = int(np.abs(axes[2]).argmax())  # the plane is a function of the other two coordinates
        keep = [a for a in range(3) if a != drop]
        grid = np.stack(np.meshgrid(*(np.arange(low[a], high[a] + 1) for a in keep), indexing="ij"), -1).reshape(-1, 2)
        cells = np.zeros((len(grid), 3))
        cells[:, keep] = grid
        cells[:, drop] = mean[drop] - ((grid - mean[keep]) @ axes[2][keep]) / axes[2][drop]
        inside = in_hull_2d((cells - mean) @ axes[:2].T, hull_2d(flat))
        return np.unique(np.concatenate([np.rint(cells[inside]), np.rint(p)]).astype(np.int64), axis=0)
    planes = facets(p)
    marked = np.rint(p).astype(np.int64)
    if planes is None:
        return np.unique(marked, axis=0)
    out = [marked]
    for z in range(low[0], high[0] + 1):  # a slice at a time bounds the memory
        layer = np.stack(np.meshgrid([z], np.arange(low[1], high[1] + 1), np.arange(low[2], high[2] + 1), indexing="ij"), -1).reshape(-1, 3)
        out.append(layer[(layer @ planes[0].T <= planes[1] + 1e-9).all(axis=1)])
    return np.unique(np.concatenate(out), axis=0)


def _side(group: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, y, x): of every row of each group the first whole x that isn't left of its hull; the points are the leftmost of their rows, in order."""
    while True:
        same = group[1:] == group[:-1]
        inner = np.flatnonzero(same[1:] & same[:-1]) + 1
        dy, dx = y[inner + 1] - y[inner - 1], x[inner + 1] - x[inner - 1]
        gone = inner[(x[inner] - x[inner - 1]) * dy >= dx * (y[inner] - y[inner - 1])]
        if not len(gone):
            break
        group, y, x = (np.delete(c, gone) for c in (group, y, x))
    on = np.append(same, False)
    rows = np.where(on, np.append(y[1:] - y[:-1], 1), 1)
    dx = np.where(on, np.append(x[1:] - x[:-1], 0), 0)
    at = np.repeat(np.arange(len(y)), rows)
    step = np.arange(len(at)) - np.repeat(np.cumsum(rows) - rows, rows)
    return group[at], y[at] + step, x[at] - (-step * dx[at]) // rows[at]


def spans(group: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group, y, first x, last x): `fill_gap` of many groups of cells of a slice each, in whole numbers.

    Group numbers ascend. Points of a line give the cells on it between the ends, others the cells of their polygon row by row.
    """
    order = np.lexsort((x, y, group))
    group, y, x = (np.asarray(c, np.int64)[order] for c in (group, y, x))
    if not len(group):
        return group, y, x, x
    starts = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
    sizes = np.diff(starts, append=len(group))
    ends = starts + sizes - 1
    ay, ax, by, bx = y[starts], x[starts], y[ends], x[ends]
    wide = lambda c: np.repeat(c, sizes)
    flat = np.logical_and.reduceat(wide(by - ay) * (x - wide(ax)) == wide(bx - ax) * (y - wide(ay)), starts)

    n = np.maximum(np.abs(by - ay), np.abs(bx - ax))[flat]
    at = np.repeat(np.flatnonzero(flat), n + 1)
    k, of = np.arange(len(at)) - np.repeat(np.cumsum(n + 1) - n - 1, n + 1), np.repeat(n, n + 1)
    t = np.where(k == of, np.where(of == 0, 0.0, 1.0), k * (1.0 / np.maximum(of, 1)))
    ly, lx = (np.rint(a[at] + t * (b[at] - a[at])).astype(np.int64) for a, b in ((ay, by), (ax, bx)))

    solid = ~wide(flat)
    row = np.diff(group, prepend=group[0] - 1).astype(bool) | np.diff(y, prepend=y[0]).astype(bool)
    first, last = solid & row, solid & np.append(row[1:], True)
    g, py, low = _side(group[first], y[first], x[first])
    high = -_side(group[last], y[last], -x[last])[2]
    full = low <= high
    return np.concatenate([group[starts][at], g[full]]), np.concatenate([ly, py[full]]), np.concatenate([lx, low[full]]), np.concatenate([lx, high[full]])


def flat_gaps(points: DataFrame, by: str) -> DataFrame:
    """(by, z, y, x): the cells between the cells that each `by` has in a slice, as `fill_gap`; rows without a cell are left out.

    Slices come sorted through each task, many are filled at once, and rows of cells are spread only after it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, enough = [], TOGETHER

        def filled(rows: pa.Table) -> pa.RecordBatch:
            z, y, x = (rows.column(a).to_numpy().astype(np.int64) for a in "zyx")
            name = rows.column(by).combine_chunks()
            other = _changes(rows, by)
            new = np.append(0, np.flatnonzero(other))
            at, y, low, high = spans(np.cumsum(other), y, x)
            return pa.record_batch([name.take(pa.array(new[at])), *(pa.array(c.astype(np.int32)) for c in (z[new[at]], y, low, high))], [by, "z", "y", "low", "high"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < enough:
                continue
            rows = pa.Table.from_batches(held)
            last = np.flatnonzero(_changes(rows, by))
            cut = int(last[-1]) if len(last) else 0
            if cut:
                yield filled(rows.slice(0, cut))
            held = rows.slice(cut).to_batches()
            enough = max(TOGETHER, 2 * (rows.num_rows - cut))
        if held and (rows := pa.Table.from_batches(held)).num_rows:
            yield filled(rows)

    kind = dict(points.dtypes)[by]
    sorted_ = points.select(by, *[F.col(a).cast("int").alias(a) for a in "zyx"]).dropna().repartition(by, "z").sortWithinPartitions(by, "z")
    made = sorted_.mapInArrow(run, f"{by} {kind}, z int, y int, low int, high int")
    return made.select(by, "z", "y", F.explode(F.sequence("low", "high")).alias("x"))


def _changes(rows: pa.Table, by: str) -> np.ndarray:
    """Whether a row is of another `by` or slice than the one before; the first is not."""
    other = np.zeros(rows.num_rows, bool)
    for c in (by, "z"):
        v = rows.column(c).combine_chunks().to_numpy(zero_copy_only=False)
        other[1:] |= v[1:] != v[:-1]
    return other
