"""Operators on made-up volumes."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxelflow.functions.offsets import exact_ball, face, itk_ball, neighbours
from voxelflow.operators import components as comp, fronts, graphs, masks as m, mixture, morphology as morph, stencils
from voxelflow.plans import pipelines
from voxelflow.plans.geometry_queries import thorax, tube
from voxelflow.sources import nrrd
from voxelflow.sources.fixtures import volume


def cells(spark, array, name="a"):
    at = np.argwhere(array).astype(np.int32)
    rows = pd.DataFrame({"volume_id": name, "z": at[:, 0], "y": at[:, 1], "x": at[:, 2], "v": array[tuple(at.T)].astype(float)})
    return spark.createDataFrame(rows, "volume_id string, z int, y int, x int, v double")


def found(df):
    return {(r.z, r.y, r.x) for r in df.select("z", "y", "x").collect()}


def test_components_across_slabs(spark):
    r = np.random.default_rng(3)
    a = (r.random((20, 8, 8)) < 0.25).astype(int)
    v = volume(spark, "a", a.shape)
    mask = cells(spark, a)
    for connectivity in (6, 26, 4):
        whole = {(x.z, x.y, x.x): x.label for x in comp.label(mask, v, connectivity).collect()}
        parts = {(x.z, x.y, x.x): x.label for x in comp.label(mask, v, connectivity, depth=3).collect()}
        assert whole == parts
        assert all(label <= (z * 8 + y) * 8 + x for (z, y, x), label in whole.items())


def test_slabs_do_not_show(spark):
    r = np.random.default_rng(4)
    a = r.random((40, 9, 9)) < 0.4
    v = volume(spark, "a", a.shape)
    mask = cells(spark, a.astype(int))
    ball = itk_ball(2, 2, 2)
    by_rows = found(morph.within(morph._moved(mask, ball, []).distinct(), v))
    assert found(morph.dilate(mask, v, ball)) == by_rows


def test_opening_and_closing(spark):
    r = np.random.default_rng(5)
    a = (r.random((9, 10, 11)) < 0.6).astype(int)
    v, mask = volume(spark, "a", a.shape), cells(spark, a)
    ball = [(0, 0, 0), *face()]
    here, opened, closed = found(mask), morph.opening(mask, v, ball), morph.closing(mask, v, ball)
    assert found(opened) <= here <= found(closed)
    assert found(morph.opening(opened, v, ball)) == found(opened)
    assert found(morph.closing(closed, v, ball)) == found(closed)


def test_holes(spark):
    a = np.zeros((7, 7, 7), int)
    a[1:6, 1:6, 1:6] = 1
    a[3, 3, 3] = 0
    v = volume(spark, "a", a.shape)
    assert len(found(morph.fill_holes(cells(spark, a), v, 6))) == 125
    a[3, 3, 3:] = 0  # open to one side in space, closed in slices across
    assert len(found(morph.fill_holes(cells(spark, a), v, 6))) == 122


def filled(a, connectivity):
    """The cells of an array, and the rest that no way through the rest joins to its border."""
    steps = neighbours(connectivity)
    flat = connectivity in (4, 8)
    seen = {p for p in map(tuple, np.argwhere(a == 0).tolist()) if any(p[i] in (0, a.shape[i] - 1) for i in range(flat, 3))}
    front = list(seen)
    while front:
        p = front.pop()
        for q in (tuple(i + d for i, d in zip(p, step, strict=True)) for step in steps):
            if q not in seen and all(0 <= i < n for i, n in zip(q, a.shape, strict=True)) and not a[q]:
                seen.add(q)
                front.append(q)
    return {p for p in np.ndindex(a.shape) if p not in seen and (not flat or a[p[0]].any())}


@pytest.mark.parametrize("connectivity", [4, 8, 6, 26])
def test_holes_across_slabs(spark, connectivity):
    """Two volumes at once: ways out that wind through several slabs, and slabs without a cell of the mask."""
    r = np.random.default_rng(8)
    a = r.random((20, 9, 9)) < (0.7 if connectivity in (4, 6) else 0.9)
    a[6:13] = False
    a[12, 1:8, 1:8] = a[17, 1:8, 1:8] = a[12:18, [1, 7], 1:8] = a[12:18, 1:8, [1, 7]] = True
    b = ~a[:11]
    mask = cells(spark, a, "a").unionByName(cells(spark, b, "b"))
    v = volume(spark, "a", a.shape).unionByName(volume(spark, "b", b.shape))
    for depth in (3, 32):
        got = morph.fill_holes(mask, v, connectivity, depth=depth).collect()
        assert len(got) == len(set(got))
        for name, array in (("a", a), ("b", b)):
            assert {(x.z, x.y, x.x) for x in got if x.volume_id == name} == filled(array, connectivity)


def most_rows(plan):
    """The most rows that any step of a query made that has run."""
    kind = plan.getClass().getSimpleName()
    inner = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else []
    below = plan.children()
    made = plan.metrics().get("numOutputRows")
    return max([made.get().value() if made.isDefined() else 0, *map(most_rows, inner + [below.apply(i) for i in range(below.size())])])


@pytest.mark.parametrize("connectivity", [4, 6])
def test_holes_make_no_row_of_every_cell(spark, connectivity):
    """Spark takes such a table for as small as the one of volumes, and may send it to all machines."""
    a = np.zeros((20, 80, 80), int)
    a[5:10, 5:10, 5:10] = 1
    a[6:9, 6:9, 6:9] = 0
    df = morph.fill_holes(cells(spark, a), volume(spark, "a", a.shape), connectivity)
    assert len(df.collect()) == 125
    assert 98 <= most_rows(df._jdf.queryExecution().executedPlan()) < 1000


def test_closing_by_ball(spark):
    """Each part closed by a ball of its own, near all sides of the volume and across slabs, in one plan for all radii."""
    r = np.random.default_rng(9)
    shape, radii = (14, 12, 13), [1.0, 1.4, 2.0, 2.3, 1.0]
    v = volume(spark, "a", shape)
    masks = [cells(spark, r.random(shape) < 0.06) for _ in radii]
    parts = [x.select(*m.KEYS, F.lit(k).alias("k"), F.lit(radii[k]).alias("radius")) for k, x in enumerate(masks)]
    want = set.union(*[found(morph.closing(x, v, exact_ball(radius))) for x, radius in zip(masks, radii, strict=True)])
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).unionByName(parts[4])
    for depth in (3, 32):
        assert found(morph.closing_by_ball(every, "k", v, depth)) == want


def test_plan_of_closed_branches_does_not_grow_with_radii(spark):
    v = volume(spark, "a", (5, 5, 5))
    plans = []
    for n in (2, 9):
        labels = spark.createDataFrame([("a", 2, 2, 2, k) for k in range(n)], "volume_id string, z int, y int, x int, edge_id int")
        sizes = spark.createDataFrame([("a", k, 1 - k / 20) for k in range(n)], "volume_id string, edge_id int, size double")
        plans.append(pipelines._closed(labels, sizes, v)._jdf.queryExecution().optimizedPlan().toString().count("\n"))
    assert plans[0] == plans[1]


def test_empty_tables(spark):
    none = cells(spark, np.zeros((2, 2, 2), int))
    v = volume(spark, "a", (2, 2, 2))
    assert comp.label(none, v).count() == 0
    assert comp.largest_component(none, v).count() == 0
    assert morph.closing(none, v, exact_ball(1.0)).count() == 0
    assert morph.fill_holes(none, v).count() == 0
    assert stencils.tubeness(none, v).count() == 0
    assert m.overlap(none, none).count() == 0


def test_gradient_of_a_slope(spark):
    z, y, x = np.indices((5, 6, 7))
    v = volume(spark, "a", (5, 6, 7), (2.0, 1.0, 1.0))
    out = {(r.z, r.y, r.x): r.v for r in stencils.gradient_magnitude(cells(spark, 2 * z + 3 * x + 1), v).collect()}
    assert out[2, 3, 3] == pytest.approx(np.hypot(1.0, 3.0))
    assert out[0, 3, 3] == pytest.approx(np.hypot(0.5, 3.0))


def test_tube_is_brighter_inside(spark):
    z, y, x = np.indices((12, 15, 15))
    a = 100.0 * ((y - 7) ** 2 + (x - 7) ** 2 <= 4) + 1
    out = {(r.z, r.y, r.x): r.v for r in stencils.tubeness(cells(spark, a), volume(spark, "a", a.shape)).collect()}
    assert out[6, 7, 7] > 0.8 and out[6, 1, 1] == 0
    line = {(r.z, r.y, r.x): r.v for r in stencils.line_response(cells(spark, a), volume(spark, "a", a.shape), 2.0).collect()}
    assert line[6, 7, 7] > 0 and (6, 0, 0) not in line


def test_front_table(spark):
    a = np.ones((3, 3, 12))
    t = fronts.fast_march(cells(spark, a), cells(spark, np.pad(np.ones((3, 3, 1)), ((0, 0), (0, 0), (0, 11)))), volume(spark, "a", a.shape), 5.0)
    assert {r.x: round(r.v, 6) for r in t.collect()} == {i: float(i) for i in range(6)}


def test_fronts_cross_slabs(spark):
    """A front that goes up, over and down again through thin slabs: as in one."""
    r = np.random.default_rng(9)
    speed = r.random((14, 6, 7)) + 0.2
    speed[2:, :, 3] = 0
    speed[:, 2, 5] = 0
    seeds = np.zeros(speed.shape)
    seeds[13, 0, 0] = seeds[6, 5, 1] = 1
    v = volume(spark, "a", speed.shape, (2.0, 1.0, 0.5))
    want = fronts.arrival_times(speed, seeds > 0, (2.0, 1.0, 0.5), 45.0)
    for depth in (4, 64):
        got = {(x.z, x.y, x.x): x.v for x in fronts.fast_march(cells(spark, speed), cells(spark, seeds), v, 45.0, depth).collect()}
        assert got.keys() == set(map(tuple, np.argwhere(np.isfinite(want)).tolist()))
        assert all(abs(want[i] - t) < 1e-7 for i, t in got.items())
    assert np.isfinite(want[:, :, 4:]).any() and not np.isfinite(want).all()


def test_spline_resampling(spark):
    """Against the spline's equations solved along each axis; slabs don't show; cells of the old grid keep their values."""
    r = np.random.default_rng(11)
    a = r.normal(size=(45, 6, 7))

    def system(n):
        m = np.eye(n) * 4 / 6
        for i in range(n):
            for j in (i - 1, i + 1):
                m[i, abs(j) if j < n else 2 * (n - 1) - j] += 1 / 6
        return m

    c = a
    for axis in range(3):
        c = np.moveaxis(np.linalg.solve(system(a.shape[axis]), np.moveaxis(c, axis, 0).reshape(a.shape[axis], -1)).reshape(np.moveaxis(c, axis, 0).shape), 0, axis)
    basis = lambda u: np.where(np.abs(u) < 1, 2 / 3 - u**2 + np.abs(u) ** 3 / 2, np.where(np.abs(u) < 2, (2 - np.abs(u)) ** 3 / 6, 0))
    want = c
    for axis, s in enumerate((1.0, 1.5, 3.0)):
        n = a.shape[axis]
        p = np.arange(round(n * s / 2.0)) * 2.0 / s
        k = np.arange(-4, n + 4)
        mirror = np.minimum(np.abs(k) % (2 * n - 2), 2 * n - 2 - np.abs(k) % (2 * n - 2))
        want = np.moveaxis(np.tensordot(basis(p[:, None] - k), np.take(want, mirror, axis), (1, axis)), 0, axis)
    v = volume(spark, "a", a.shape, (1.0, 1.5, 3.0))
    for depth in (7, 64):
        got = {(x.z, x.y, x.x): x.v for x in stencils.resample_spline(cells(spark, a), v, 2.0, depth=depth).collect()}
        assert len(got) == want.size and all(abs(want[i] - x) < 1e-8 for i, x in got.items())
    same = {(x.z, x.y, x.x): x.v for x in stencils.resample_spline(cells(spark, a), volume(spark, "a", a.shape, (2.0, 2.0, 2.0)), 2.0).collect()}
    assert all(abs(a[i] - x) < 1e-9 for i, x in same.items()) and len(same) == a.size


def test_constrained_dilation_of_a_wide_ball(spark):
    r = np.random.default_rng(10)
    labels, mask = r.integers(0, 4, (40, 7, 8)), r.random((40, 7, 8)) < 0.02
    v, ball = volume(spark, "a", labels.shape), itk_ball(3, 3, 3)
    got = found(morph.constrained_dilation(cells(spark, mask.astype(int)), cells(spark, labels).withColumn("label", F.col("v").cast("int")), v, ball))
    want = {tuple(np.add(c, d)) for c in np.argwhere(mask).tolist() for d in ball if all(0 <= i < n for i, n in zip(np.add(c, d), labels.shape)) and labels[tuple(np.add(c, d))] == labels[tuple(c)]}
    assert got == want


def test_thresholds_of_a_volume_are_written(spark, tmp_path):
    r = np.random.default_rng(14)
    a = np.rint(r.choice([-850.0, -300.0, 50.0], (12, 20, 20)) + r.normal(0, 25, (12, 20, 20)))
    a[a == 0] = 1  # a cell of value 0 has no row
    image = cells(spark, a)
    lungs = image.where("x > 1").select("volume_id", "z", "y", "x")
    labels, cuts = mixture.threshold_volume(image, lungs, path=str(tmp_path / "cuts"))
    assert len(cuts) == 4 and cuts[0] < -850 < cuts[1] < -300 < cuts[2] < 50 < cuts[3]
    assert [float(x.threshold) for x in spark.read.csv(str(tmp_path / "cuts"), header=True).collect()] == cuts
    least = a[:, :, 2:].min()
    want = {i: 0 if a[i] == least else int(np.searchsorted(cuts, a[i], "right")) for i in np.ndindex(a.shape) if i[2] > 1}
    assert {(x.z, x.y, x.x): x.label for x in labels.collect()} == want


def test_levels_two_ways(spark):
    nodes = spark.createDataFrame([("g", i, 9 - i, 0, 0) for i in range(8)] + [("h", 1, 0, 0, 0)], "graph_id string, node_id int, z int, y int, x int")
    edges = spark.createDataFrame([("g", a, b) for a, b in ((0, 1), (1, 2), (0, 3), (3, 2), (2, 4), (4, 5))], "graph_id string, src int, dst int")
    one = {tuple(r) for r in graphs.levels(nodes, edges).collect()}
    two = {tuple(r) for r in graphs.levels_by_join(nodes, edges).select("graph_id", "node_id", "dist", "parent").collect()}
    assert one == two and ("g", 2, 2, 1) in one and ("h", 1, 0, None) in one
    assert {r.node_id for r in graphs.largest_graph(nodes, edges).where("graph_id = 'g'").collect()} == set(range(6))


def test_nrrd_round_trip(spark, tmp_path):
    a = np.arange(24, dtype=np.int16).reshape(2, 3, 4) - 5
    for name, compressed in (("p", True), ("q", False)):
        (tmp_path / f"{name}.nrrd").write_bytes(nrrd.encode(a, (2.0, 1.0, 0.5), compressed))
    vols = {r.volume_id: r for r in nrrd.read_volumes(spark, str(tmp_path)).collect()}
    assert (vols["p"].nz, vols["p"].ny, vols["p"].nx, vols["p"].sz, vols["p"].sx) == (2, 3, 4, 2.0, 0.5)
    voxels = nrrd.read_voxels(spark, str(tmp_path / "q.nrrd"))
    assert {(r.z, r.y, r.x): r.v for r in voxels.collect()} == {i: float(a[i]) for i in np.ndindex(a.shape)}
    back = nrrd.encoded_volumes(voxels, nrrd.read_volumes(spark, str(tmp_path / "q.nrrd"))).first()
    assert (nrrd.parse(bytes(back.content))[1] == a).all()
    with pytest.raises(TypeError):
        nrrd.coerce(spark, 3)
    assert nrrd.coerce(spark, None) is None
    with pytest.raises(KeyError, match="x, y"):
        nrrd.roi_labels(spark, ["x", "y"], {"z": 1})
    assert [r.label for r in nrrd.roi_labels(spark, ["z"], {"z": 7}).collect()] == [7]


def test_nrrd_geometry_goes_through(spark, tmp_path):
    """Origin and direction through read and write; bzip2, text and detached data; files by the sink."""
    import bz2

    a = np.arange(24, dtype=np.int16).reshape(2, 3, 4)
    turned = [0.0, 1.0, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "p.nrrd").write_bytes(nrrd.encode(a, (2.0, 1.0, 0.5), True, [1.5, -2.0, 30.0], turned, "right-anterior-superior"))
    head = b"NRRD0004\ntype: short\ndimension: 3\nsizes: 4 3 2\nendian: little\nencoding: "
    (tmp_path / "in" / "q.nrrd").write_bytes(head + b"bzip2\n\n" + bz2.compress(a.tobytes()))
    (tmp_path / "in" / "t.nrrd").write_bytes(head + b"text\n\n" + " ".join(map(str, a.ravel())).encode())
    (tmp_path / "in" / "h.nhdr").write_bytes(head + b"raw\ndata file: h.raw\n")
    (tmp_path / "in" / "h.raw").write_bytes(a.tobytes())
    volumes = nrrd.read_volumes(spark, str(tmp_path / "in"))
    voxels = nrrd.read_voxels(spark, str(tmp_path / "in"))
    got = {r.volume_id: r for r in volumes.collect()}
    assert set(got) == {"p", "q", "t", "h"} and got["p"].origin == [1.5, -2.0, 30.0] and got["p"].direction == turned and got["q"].origin == [0.0] * 3
    for name in got:
        assert {(r.z, r.y, r.x): r.v for r in voxels.where(F.col("volume_id") == name).collect()} == {i: float(a[i]) for i in np.ndindex(a.shape)}
    assert nrrd.write_nrrd(voxels, volumes, str(tmp_path / "out")) == 4
    back = {r.volume_id: r for r in nrrd.read_volumes(spark, str(tmp_path / "out")).collect()}
    assert (back["p"].origin, back["p"].direction, back["p"].space, back["p"].sy) == ([1.5, -2.0, 30.0], turned, "right-anterior-superior", 1.0)
    mask = voxels.where("v > 100").select("volume_id", "z", "y", "x")
    assert nrrd.write_nrrd(mask, volumes.where("volume_id = 'p'"), str(tmp_path / "empty"), "uint8") == 1
    assert not nrrd.parse((tmp_path / "empty" / "p.nrrd").read_bytes())[1].any()
    plain = volume(spark, "p", a.shape)
    assert nrrd.with_geometry(plain, volumes).first().origin == [1.5, -2.0, 30.0]


def test_region_plug_ins(spark):
    image = cells(spark, np.ones((2, 2, 2)))
    asked = {}

    def plug_in(image, names, **options):
        asked.update(options, names=names)
        return image.select("volume_id", "z", "y", "x", (F.col("x") + 1).alias("label"))

    table = {"left": 1, "right": 2}
    assert nrrd.segment_regions(image, ["left"], table, plug_in, {"fast": 1}, 3).count() == 4
    assert asked == {"names": ["left"], "device": "gpu:3", "fast": True, "quiet": True, "verbose": False}
    assert nrrd.region_options({"device": "cpu"})["device"] == "cpu" and nrrd.region_options()["device"] == "gpu"
    with pytest.raises(KeyError, match="neck"):
        nrrd.segment_regions(image, ["neck", "left"], table, plug_in)


def test_pipelines_on_phantoms(spark):
    image, lungs, v = thorax(spark)
    lung_mask = lungs.select(*m.KEYS)
    middle = pipelines.mediastinum(lung_mask, v)
    pipe = pipelines.trachea(image, lung_mask, v)
    assert pipe.count() and m.minus(pipe, lung_mask).count() == pipe.count()
    assert m.intersect(middle, lung_mask).count() == 0
    out = pipelines.airways(image, lungs, v, [-1100.0, -500.0, -200.0, 200.0])
    assert out["airways"].count() and m.intersect(out["airways"], out["walls"]).count() == 0
    assert m.minus(pipelines.vessels(image, lungs, v), lung_mask).count() == 0


def test_tree_model_stays_within(spark):
    rough, v = tube(spark)
    out = pipelines.smooth_tree(rough, rough, v)
    assert out.count() > 0.3 * rough.count() and m.minus(out, rough).count() == 0


def test_lobe_tables(spark):
    regions = spark.createDataFrame([("a", 0, 0, i, i) for i in range(6)], "volume_id string, z int, y int, x int, label int")
    assert pipelines.lungs(regions).count() == 5
    assert {r.x: r.label for r in pipelines.lungs(regions, binary=False).collect()} == {1: 1, 2: 1, 3: 2, 4: 2, 5: 2}
    assert {r.x: r.label for r in pipelines.lobes(regions, {1: 3, 5: 1}).collect()} == {1: 3, 5: 1}
    assert F is not None and len(pipelines.LOBES) == 5


def test_diffusion_of_a_volume_of_two_slabs(spark):
    """As on the whole array, with the mean over the volume; one half is much rougher than the other."""
    r = np.random.default_rng(12)
    a = r.normal(0, 1, (50, 6, 7)) + np.where(np.arange(50) < 32, 100, 0)[:, None, None] * r.random((50, 6, 7))
    got = np.zeros(a.shape)
    for x in stencils.curvature_diffusion(cells(spark, a), volume(spark, "a", a.shape), steps=2).collect():
        got[x.z, x.y, x.x] = x.v
    for _ in range(2):
        p = np.pad(a, 1, mode="edge")
        mean2 = sum(((np.roll(p, -1, i) - np.roll(p, 1, i)) / 2)[1:-1, 1:-1, 1:-1] ** 2 for i in range(3)).mean()
        a = stencils._diffuse(a, mean2, 0.0625, 3.0)
    assert np.allclose(got, a, rtol=0, atol=1e-9)


def test_all_points_at_the_ends_of_a_wide_branch(monkeypatch):
    ends = [np.random.default_rng(k).random((3000, 3)) for k in (1, 2)]
    monkeypatch.setattr(pipelines, "smooth_branch", lambda cells, line: (np.zeros((1, 3), np.int64), ends, [], 1.0))
    made = pipelines._modelled(("a", 1), pd.DataFrame(np.zeros((1, 3), int), columns=list("zyx")), pd.DataFrame({"line": [[0, 0, 0, 1, 0, 0]]}))
    for kind, end in zip(("first", "last"), ends, strict=True):
        assert np.array_equal(made[made["kind"] == kind][list("zyx")].to_numpy(float), end)


def test_nearest_edge_sends_each_place_once(spark, monkeypatch):
    """However many polylines cross in a place, its task gets one row of it; pairs are compared in parts."""
    monkeypatch.setattr(graphs, "PAIRS", 4)
    a = np.zeros((4, 9, 9))
    a[0, 0, :5] = a[3, 8, 8] = 1
    where = [(0, 0, 1), (3, 8, 7), (0, 0, 3)]
    lines = spark.createDataFrame([("a", e, *where[e % 3]) for e in range(1, 3001)], "volume_id string, edge_id int, z int, y int, x int")
    out = graphs.nearest_edge(cells(spark, a), lines)
    got = {(r.z, r.y, r.x): (r.edge_id, r.distance) for r in out.collect()}
    assert got == {(0, 0, 0): (3, 1.0), (0, 0, 1): (3000, 0.0), (0, 0, 2): (2, 1.0), (0, 0, 3): (2999, 0.0), (0, 0, 4): (2, 1.0), (3, 8, 8): (1, 1.0)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    side = plan[plan.index("FlatMapCoGroupsInPandas") :]
    assert "min(edge_id" in side


def test_volumes_and_branches_without_partner(spark):
    """A volume without polylines, a graph without nodes, and a branch that has no cell of its own."""
    a = np.zeros((2, 3, 3))
    a[0, 0, 0] = a[1, 2, 2] = 1
    lines = spark.createDataFrame([("a", 1, 0, 0, 0)], "volume_id string, edge_id int, z int, y int, x int")
    got = graphs.nearest_edge(cells(spark, a, "a").unionByName(cells(spark, a, "b")), lines).collect()
    assert {(r.volume_id, r.z, r.edge_id) for r in got} == {("a", 0, 1), ("a", 1, 1)}
    nodes = spark.createDataFrame([("a", i, i, 0, 0) for i in range(2)], "graph_id string, node_id int, z int, y int, x int")
    edges = spark.createDataFrame([("a", 0, 1), ("b", 0, 1)], "graph_id string, src int, dst int")
    assert {tuple(r) for r in graphs.levels(nodes, edges).collect()} == {("a", 1, 0, None), ("a", 0, 1, 1)}
    line = pd.DataFrame({"line": [[0, 0, 0, 1, 0, 0, 2, 0, 0]]})
    made = pipelines._modelled(("a", 1), pd.DataFrame(columns=list("zyx")), line)
    assert {tuple(x) for x in made[made["kind"] == "cell"][list("zyx")].to_numpy(int).tolist()} <= {(z, 0, 0) for z in range(3)}
    assert (made["kind"] == "thickness").sum() == 1


def test_tree_of_a_volume_without_branches(spark):
    """A volume of one cell beside one with a branch: it has no edge, so its model is empty."""
    a = np.zeros((14, 5, 5), int)
    a[1:13, 1:4, 1:4] = 1
    one = np.zeros(a.shape, int)
    one[3, 2, 2] = 1
    v = volume(spark, "a", a.shape).unionByName(volume(spark, "b", a.shape))
    rough = cells(spark, a, "a").unionByName(cells(spark, one, "b")).select(*m.KEYS)
    assert {r.volume_id for r in pipelines.smooth_tree(rough, rough, v).collect()} == {"a"}
