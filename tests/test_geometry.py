"""Shapes with known answers."""

import heapq
import itertools
import math

import numpy as np
import pytest

from voxelflow.functions import geometry as g, offsets as o
from voxelflow.operators import branches as b, skeletons as s
from voxelflow.operators.fronts import arrival_times
from voxelflow.operators.hulls import hull_cells
from voxelflow.operators.mixture import fit_histogram
from voxelflow.operators.sweeps import shared_blobs, sweep


def test_offsets():
    assert [len(x) for x in (o.face(), o.edge(), o.full(), o.in_slice(4), o.in_slice(8))] == [6, 18, 26, 4, 8]
    assert [len(o.itk_ball(r, r, r)) for r in (1, 3, 5)] == [19, 179, 739]
    assert len(o.itk_ball(6, 6, 3)) == 631
    assert [len(o.exact_ball(r)) for r in (1.0, 2.0, 5.0)] == [7, 33, 515]
    with pytest.raises(ValueError):
        o.neighbours(5)


def test_frustum_example():
    points = np.array([(3.5, 3.5, 4.0), (3.6, 3.6, 4.1), (3.7, 3.7, 4.2)])
    first = np.zeros(3), np.array([6.0, 0, 0]), np.array([0, 2.0, 0])
    second = np.array([3.0, 3, 5]), np.array([8.0, 0, 0]), np.array([0, 1.0, 0])
    found = g.points_in_frustum(points, first, second)
    axis = second[0] / np.linalg.norm(second[0])
    for p, inside in zip(points, found, strict=True):
        t = p @ axis / np.linalg.norm(second[0])
        across = p - (p @ axis) * axis
        value = (across[0] / (6 * (1 - t) + 8 * t)) ** 2 + (across[1] / (2 * (1 - t) + t)) ** 2
        assert inside == (0 <= t <= 1 and value <= 1)


def test_ellipse_fit():
    t = np.linspace(0, 2 * np.pi, 40, endpoint=False)
    p = np.stack([np.full(40, 2.0), 5 + 4 * np.cos(t), 7 + 2 * np.sin(t)], 1)
    centre, major, minor = g.fit_ellipse(p, p.mean(axis=0))
    assert np.allclose(centre, [2, 5, 7], atol=1e-6)
    assert np.allclose(sorted([np.linalg.norm(major), np.linalg.norm(minor)]), [2, 4], atol=1e-6)
    dot = g.fit_ellipse(p[:1], p[0])
    assert np.linalg.norm(dot[1]) <= 1e-9
    nothing = g.fit_ellipse(np.zeros((0, 3)), np.array([1.0, 2, 3]))
    assert np.allclose(nothing[0], [1, 2, 3])
    pair = g.fit_ellipse(np.array([[0.0, 0, 0], [0, 0, 6]]), np.zeros(3))
    assert math.isclose(np.linalg.norm(pair[1]), 3) and math.isclose(np.linalg.norm(pair[2]), 3)


def test_collinear_and_symmetric():
    line = np.array([[0.0, 0], [1, 1], [2, 2], [3, 3]])
    assert g.collinear(line) and g.symmetric(line)
    assert not g.symmetric(np.array([[0.0, 0], [1, 1], [3, 3]]))
    assert not g.collinear(np.array([[0.0, 0], [1, 1], [2, 3]]))
    assert g.collinear(line[:2])


def test_simplify():
    zigzag = np.array([(i, i % 2 * 0.1, 0) for i in range(10)], float)
    kept = b.simplify(zigzag, 0.51)
    assert np.array_equal(kept[[0, -1]], zigzag[[0, -1]]) and len(kept) == 2
    corner = np.array([(0, 0, 0), (5, 0, 0), (5, 5, 0)], float)
    assert len(b.simplify(corner, 10.0)) == 3
    assert len(b.simplify(corner[:2], 10.0)) == 2
    options = b.segmentations(np.concatenate([zigzag, corner + 20]))
    assert options[0].tolist() == [0, 12]


def test_densify():
    p = np.array([(0, 0, 0), (4, 0, 0)])
    assert b.densify(p, 4).tolist() == [[0, 0, 0], [4, 0, 0], [1, 0, 0], [2, 0, 0], [3, 0, 0]]
    assert len(b.densify(p[:1], 4)) == 1 and len(b.densify(p, 1)) == 2


def test_nearest_points():
    """Cells of a thick and of a thin mask, with far ones and with repeated ones: as all pairs."""
    r = np.random.default_rng(8)
    thick = np.argwhere(r.random((14, 14, 14)) < 0.8)
    thin = np.argwhere(r.random((30, 30, 30)) < 0.06)
    for p in (thick, thin, np.concatenate([thick, [[400, 3, -90]]]), np.concatenate([thin, thin[:9]]), thick + 0.5):
        assert len(p) > 1024
        assert np.array_equal(b.nearest(p, 10), b._all_pairs(np.asarray(p, float), np.arange(len(p)), 10))


def test_kept_indices_with_repeated_points():
    p = np.array([(0, 0, 0), (1, 1, 1), (0, 0, 0), (2, 0, 1)])
    assert b.kept_indices(p, p[[0, 3]]).tolist() == [0, 2, 3] and b.kept_indices(p, p[:0]).tolist() == []


def brute_simplify(points, least):
    """Every area that was ever entered is looked at again and again, the smallest first."""
    p = [tuple(map(float, q)) for q in points]
    left, n = list(range(len(p))), len(p)

    def area(i):
        at = left.index(i)
        a, q, c = (np.array(p[j]) for j in left[at - 1 : at + 2])
        return 0.5 * float(np.linalg.norm(np.cross(a - q, c - q)))

    entered = [(area(i), i) for i in range(1, n - 1)]
    while entered:
        entered.sort()
        size, i = entered.pop(0)
        if i in left:
            if size >= least:
                break
            at = left.index(i)
            around = [left[at - 1], left[at + 1]]
            left.remove(i)
            entered += [(area(j), j) for j in around if 0 < j < n - 1]
    return [points[i] for i in left]


def test_simplify_against_brute_force():
    r = np.random.default_rng(3)
    for k in range(60):
        p = np.cumsum(r.integers(-3, 4, (r.integers(3, 40), 3)), axis=0).astype(float)
        for least in (0.51, 2.0, 10.0):
            assert np.allclose(b.simplify(p, least), brute_simplify(p, least))


def test_thinning_keeps_what_it_must():
    """Parts, holes and tunnels of random masks (by Euler's number), and nothing that could go is left but ends."""
    def parts(m, near):
        return len(s._parts(list(map(tuple, np.argwhere(m).tolist())), near))

    def euler(m):
        faces = np.pad(m, 1).astype(int)
        total = 0
        for axes in itertools.product((0, 1), repeat=3):
            cells = faces
            for axis, wide in enumerate(axes):
                if not wide:
                    cells = np.maximum(cells, np.roll(cells, 1, axis))
            total += (-1) ** sum(axes) * int(cells.sum())
        return total

    r = np.random.default_rng(4)
    for k in range(25):
        m = r.random((7, 8, 9)) < r.choice((0.3, 0.6, 0.9))
        thin = s.thin(m)
        assert not (thin & ~m).any()
        assert parts(thin, s._AROUND) == parts(m, s._AROUND) and euler(thin) == euler(m)
        assert parts(~np.pad(thin, 1), s._FACES) == parts(~np.pad(m, 1), s._FACES)
        assert np.array_equal(s.thin(thin), thin)


def test_shortest_paths_against_a_queue():
    r = np.random.default_rng(5)
    mask = r.random((6, 9, 11)) < 0.6
    cells = np.argwhere(mask)
    near, steps = s._near(cells, mask.shape)
    cost = r.random(len(cells)) + 0.1
    far, before = s._shortest(near, steps, cost, 0)
    want, queue = {0: 0.0}, [(0.0, 0)]
    while queue:
        d, i = heapq.heappop(queue)
        if d > want[i]:
            continue
        for j, step in zip(near[i].tolist(), steps.tolist()):
            if j != i and d + cost[j] * step < want.get(j, math.inf):
                want[j] = d + cost[j] * step
                heapq.heappush(queue, (want[j], j))
    assert all(math.isclose(far[i], want.get(i, math.inf), rel_tol=1e-9) for i in range(len(cells)))


def test_path_graph():
    lines = [np.array([(0, 0, 0), (0, 0, 1), (0, 1, 2)]), np.array([(0, 5, 2), (0, 1, 2), (0, 0, 1)])]
    nodes, edges = s.path_graph(lines)
    assert nodes.tolist() == [[0, 0, 0], [0, 0, 1], [0, 1, 2], [0, 5, 2]]
    assert [(a, c, len(line)) for a, c, line in edges] == [(0, 1, 2), (1, 2, 2), (3, 2, 5)]


def test_gap_fill():
    assert b.fill_gap(np.array([[1.2, 2, 3]])).tolist() == [[1, 2, 3]]
    assert b.fill_gap(np.array([[0, 0, 0], [3, 0, 0]])).tolist() == [[i, 0, 0] for i in range(4)]
    falling = b.fill_gap(np.array([[0, 3, 0], [3, 0, 0]]))
    assert [0, 3, 0] in falling.tolist() and [0, 0, 0] not in falling.tolist()
    square = b.fill_gap(np.array([[0, 0, 0], [0, 3, 0], [0, 0, 3], [0, 3, 3]]))
    assert len(square) == 16
    cube = b.fill_gap(np.array([[z, y, x] for z in (0, 3) for y in (0, 3) for x in (0, 3)]))
    assert len(cube) == 64


def test_hull():
    cells = hull_cells(np.array([0, 0, 4, 4]), np.array([0, 4, 0, 4]), False)
    assert len(cells) == 25
    assert hull_cells(np.array([2]), np.array([3])).tolist() == [[2, 3]]
    assert hull_cells(np.array([0, 2]), np.array([0, 2]), False).tolist() == [[0, 0], [1, 1], [2, 2]]


def test_smooth_branch_of_a_cylinder():
    z, y, x = np.indices((30, 15, 15))
    cells = np.argwhere((y - 7) ** 2 + (x - 7) ** 2 <= 16)
    line = np.array([(i, 7, 7) for i in range(30)], float)
    kept, ends, _, thickness = b.smooth_branch(cells, line)
    assert len(kept) > 0.7 * len(cells)
    assert 3 < thickness < 5 and all(len(e) for e in ends)
    assert len(b.smooth_branch(np.zeros((0, 3)), line)[0]) == 0


def test_thinning_keeps_parts_and_tunnels():
    z, y, x = np.indices((7, 21, 21))
    r = np.hypot(y - 10, x - 10)
    ring = (r >= 5) & (r <= 8) & (z >= 2) & (z <= 4)
    line = s.thin(ring)
    nodes, edges = s.skeleton_graph(line)
    assert line.sum() < 60 and len(edges) == 1 and edges[0][0] == edges[0][1]
    bar = np.zeros((5, 5, 20), bool)
    bar[1:4, 1:4, 2:18] = True
    nodes, edges = s.skeleton_graph(s.thin(bar))
    assert len(nodes) == 2 and len(edges) == 1


def test_depth_and_paths():
    ball = sum((a - 5) ** 2 for a in np.indices((11, 11, 11))) <= 16
    assert math.isclose(s.depth(ball)[5, 5, 5], math.sqrt(17))
    bar = np.zeros((5, 5, 30), bool)
    bar[1:4, 1:4, 2:28] = True
    lines = s.path_skeleton(bar, **s.PATHS["fine"])
    assert len(lines) == 1 and len(lines[0]) >= 24


def test_front():
    seeds = np.zeros((5, 5, 21), bool)
    seeds[:, :, 0] = True
    t = arrival_times(np.full((5, 5, 21), 2.0), seeds)
    assert np.allclose(t[2, 2], np.arange(21) / 2)
    assert np.isinf(arrival_times(np.full((5, 5, 21), 2.0), seeds, stop=3.0)[2, 2, 8])
    blocked = np.full((1, 1, 9), 1.0)
    blocked[0, 0, 4] = 0
    start = np.zeros((1, 1, 9), bool)
    start[0, 0, 0] = True
    assert np.isinf(arrival_times(blocked, start)[0, 0, 4:]).all()


def test_mixture():
    r = np.random.default_rng(1)
    v, n = np.unique(np.concatenate([r.normal(m, d, k).round() for m, d, k in ((-850, 40, 4000), (-300, 60, 3000), (50, 30, 5000))]), return_counts=True)
    mean, weight, std = fit_histogram(v, n)
    assert np.allclose(mean, [-850, -300, 50], atol=6) and np.allclose(std, [40, 60, 30], atol=6)
    assert np.allclose(weight, [4 / 12, 3 / 12, 5 / 12], atol=0.02)


def test_hull_facets():
    r = np.random.default_rng(2)
    p = r.normal(size=(60, 3))
    normals, offsets = g.facets(p)
    assert (p @ normals.T <= offsets + 1e-9).all()
    assert not (np.array([[9.0, 9, 9]]) @ normals.T <= offsets).all()
    assert g.facets(p[:3]) is None


def test_sweep_follows_shrinking_blobs():
    layer, small, wide = (np.zeros((9, 9), bool) for _ in range(3))
    layer[2:5, 2:5] = small[3, 3] = wide[1:7, 1:7] = True
    assert shared_blobs(layer, small).sum() == 1
    assert shared_blobs(layer, wide).sum() == 0
    assert shared_blobs(small, np.roll(small, 4, axis=0)).sum() == 0
    mask = np.zeros((9, 9, 9), bool)
    mask[4, 2:6, 2:6] = mask[5, 3:5, 3:5] = mask[6, 3, 3] = mask[8, 3, 3] = True
    found = sweep(mask, (4, 8, 8))
    assert found.sum() == 16 + 4 + 1 and not found[8].any()


def test_frustum_axes_are_brought_in_line():
    """Turned by a quarter and by half a circle the second ellipse is the same one."""
    points = np.random.default_rng(5).uniform(-6, 6, (4000, 3)) + [5, 0, 0]
    first = np.zeros(3), np.array([0, 5.0, 0]), np.array([0, 0, 2.0])
    second = np.array([10.0, 0, 0]), np.array([0, 3.0, 1.0]), np.array([0, -0.6, 1.8])
    want = g.points_in_frustum(points, first, second)
    assert 0.1 < want.mean() < 0.9
    for a, b in ((-second[1], -second[2]), (second[2], second[1]), (-second[2], second[1]), (second[1], -second[2])):
        assert np.array_equal(g.points_in_frustum(points, first, (second[0], a, b)), want)
    centre = g.points_in_frustum(np.array([[5.0, 3.5, 0], [5.0, 0, 1.5]]), first, (second[0], second[2], -second[1]))
    assert centre.all()


def test_frustum_columns_are_as_numpy(spark):
    r = np.random.default_rng(6)
    points = r.uniform(-6, 6, (500, 3)) + [5, 0, 0]
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "i int, z double, y double, x double")
    for turn in (0.0, 0.5 * np.pi, np.pi, 0.8):
        c, s_ = np.cos(turn), np.sin(turn)
        first = (0.0, 0.0, 0.0), (0.0, 5.0, 0.0), (0.0, 0.0, 2.0)
        second = (10.0, 1.0, 0.0), (0.0, 3 * c, 3 * s_), (0.0, -2 * s_, 2 * c)
        got = {x.i for x in df.where(g.in_frustum([df.z, df.y, df.x], first[0], second[0], first[1], first[2], second[1], second[2])).collect()}
        assert got == set(np.flatnonzero(g.points_in_frustum(points, tuple(map(np.array, first)), tuple(map(np.array, second)))).tolist())


def test_tries_without_cells_do_not_count(monkeypatch):
    """Of the tries' sizes the third is best: an empty one before it is no try, two smaller ones after it end the search."""
    cells, line = np.array([(i, 0, 0) for i in range(40)]), np.array([(i, 0, 0) for i in range(40)], float)
    sizes = iter([0, 0, 0, 7, 5, 0, 6, 30])
    tried = []

    def made(turned, dense, ends, cut):
        tried.append(next(sizes))
        return np.arange(len(turned)) < tried[-1], [dense[:1], dense[:1]], 1.0

    monkeypatch.setattr(b, "segmentations", lambda line: [np.array([0, 39])] * 8)
    monkeypatch.setattr(b, "_frustum", made)
    monkeypatch.setattr(b, "points_in_ellipse", lambda p, e: np.zeros(len(p), bool))
    assert len(b.smooth_branch(cells, line)[0]) == 7 and tried == [0, 0, 0, 7, 5, 0, 6]


def test_hull_facets_of_points_in_few_planes():
    """Points evenly between cells, turned there and back as a branch's are, lie in few planes but for their last digits."""
    cube = np.array(list(itertools.product((0, 1, 2, 3), repeat=3)), float)
    p = b.densify(cube, 5)
    axes = np.linalg.qr(np.random.default_rng(5).normal(size=(3, 3)))[0]
    p = (p - p.mean(axis=0)) @ axes.T @ axes + p.mean(axis=0)
    normals, offsets = g.facets(p)
    assert len(offsets) <= 2 * 56 - 4  # on the surface are 56 cells
    assert (p @ normals.T <= offsets + 1e-9).all()
    box = np.array(list(itertools.product(range(-1, 5), repeat=3)))
    assert ((box @ normals.T <= offsets + 1e-9).all(axis=1) == ((box >= 0) & (box <= 3)).all(axis=1)).all()
    assert len(b.fill_gap(p)) == 64


def test_gaps_of_many_slices_at_once(spark, monkeypatch):
    """As each slice by itself, through batches that end within a slice; no Python call for each of them."""
    monkeypatch.setattr(b, "TOGETHER", 7)
    r = np.random.default_rng(8)
    rows = {(int(u), int(z), int(y), int(x)) for u, z, y, x in r.integers(0, (30, 3, 12, 12), (300, 4))}
    rows |= {(90, 0, i, 2 * i) for i in range(5)} | {(91, 1, 0, 0), (91, 1, 2, 7), (92, 0, 3, 3), (93, 0, 0, 0), (93, 0, 9, 1), (93, 0, 4, 1)}
    rows |= {(94, 2, int(y), int(x)) for y, x in r.integers(-40, 40, (200, 2))}
    want = set()
    for key in {k[:2] for k in rows}:
        want |= {(key[0], *c) for c in b.fill_gap(np.array([k[1:] for k in rows if k[:2] == key])).tolist()}
    out = b.flat_gaps(spark.createDataFrame([*rows, *list(rows)[:9]], "u long, z int, y int, x int"), "u")
    got = [tuple(x) for x in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert b.flat_gaps(spark.createDataFrame([], "u long, z int, y int, x int"), "u").count() == 0
