"""Queries of points, polylines, graphs, filters and pipelines over the fixtures, and SQL where it can say the same."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.geometry import between_endpoints, collinear, fit_ellipse, gauss_crossings, in_ellipse, in_frustum, principal_axes
from ..functions.offsets import itk_ball
from ..operators import branches, components as comp, fronts, graphs, hulls, masks as m, mixture, stencils
from ..operators.sweeps import sweep_from_centre
from ..session import stored
from ..sources.fixtures import GRID_SHAPE, GRID_SQL, POLY_SQL, VEC_SQL, alike, grid, grid_volume, poly, stack, stack_volumes, vec, vec_volume, volume
from . import filter_sql as fs, pipelines
from .mask_queries import BORDER, GRID, INSIDE, NEAR6, NEAR26, NX, NY, NZ, VEC, dilated, eroded, filled, labelled, passed

POLY = f"poly as ({POLY_SQL})"
QUERIES = {}
SQL = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _cells(df: DataFrame, *more: str) -> DataFrame:
    return df.select("z", "y", "x", *more)


def _at() -> list:
    return [F.col(a).cast("double") for a in "zyx"]



# ---- formulas and predicates ----------------------------------------------------------------------------------------

_PAIRS = [(-850.0, -700.0, 60.0, 90.0), (-700.0, 20.0, 90.0, 40.0), (0.0, 10.0, 5.0, 5.0), (1.0, 9.0, 2.0, 3.5)]
_query(
    "gauss_crossings",
    "with p(m1, m2, s1, s2) as (values " + ", ".join(f"({a}::double, {b}::double, {c}::double, {d}::double)" for a, b, c, d in _PAIRS) + "), q as (select *, 1 / (2 * s1 * s1) - 1 / (2 * s2 * s2) as a, m2 / (s2 * s2) - m1 / (s1 * s1) as b, m1 * m1 / (2 * s1 * s1) - m2 * m2 / (2 * s2 * s2) - ln(s2 / s1) as c from p), "
    "r as (select *, case when abs(a) < 1e-12 then -c / b else (-b - sqrt(b * b - 4 * a * c)) / (2 * a) end as u, case when abs(a) < 1e-12 then -c / b else (-b + sqrt(b * b - 4 * a * c)) / (2 * a) end as w from q) "
    "select m1, m2, round(least(u, w), 6) as low, round(greatest(u, w), 6) as high from r",
)(lambda s, d: (lambda df: df.select("m1", "m2", *[F.round(c, 6).alias(n) for c, n in zip(gauss_crossings(*map(F.col, ("m1", "m2", "s1", "s2"))), ("low", "high"), strict=True)]))(s.createDataFrame(_PAIRS, "m1 double, m2 double, s1 double, s2 double")))

_C1, _C2 = (5.0, 2.0, 2.0), (40.0, 8.0, 6.0)
_H = float(np.linalg.norm(np.subtract(_C2, _C1)))
_U = [float(b - a) / _H for a, b in zip(_C1, _C2, strict=True)]
_ALONG = " + ".join(f"({a} - {c:.1e}) * {u:.17e}" for a, c, u in zip("zyx", _C1, _U, strict=True))
_query("between_endpoints", f"with {GRID} select z, y, x from grid where {_ALONG} between 0 and {_H:.17e}")(lambda s, d: _cells(grid(s, d).where(between_endpoints(_at(), _C1, _C2, 0.0))))
_query("point_in_ellipse", f"with {GRID} select z, y, x from grid where pow((z - 25) / 20.0, 2) + pow((y - 5) / 4.0, 2) <= 1")(lambda s, d: _cells(grid(s, d).where(in_ellipse(_at(), (25.0, 5.0, 4.0), (20.0, 0.0, 0.0), (0.0, 4.0, 0.0)))))


def _frustum_sql() -> str:
    """Axes along y and x that shrink from the first end to the second."""
    a1, b1, a2, b2 = (0.0, 5.0, 0.0), (0.0, 0.0, 4.0), (0.0, 2.0, 0.0), (0.0, 0.0, 3.0)
    across = ", ".join(f"({a} - {c:.1e}) - al * {u:.17e} as w{a}" for a, c, u in zip("zyx", _C1, _U, strict=True))
    terms = []
    for p, q in ((a1, a2), (b1, b2)):
        half = [f"({i:.1e} * (1 - t) + {j:.1e} * t)" for i, j in zip(p, q, strict=True)]
        dot = " + ".join(f"w{a} * {h}" for a, h in zip("zyx", half, strict=True))
        size = " + ".join(f"{h} * {h}" for h in half)
        terms.append(f"pow(({dot}) / ({size}), 2)")
    return f"with {GRID}, q as (select *, {_ALONG} as al from grid), r as (select *, al / {_H:.17e} as t, {across} from q) select z, y, x from r where al between 0 and {_H:.17e} and {' + '.join(terms)} <= 1"


_query("point_in_frustum", _frustum_sql())(lambda s, d: _cells(grid(s, d).where(in_frustum(_at(), _C1, _C2, (0.0, 5.0, 0.0), (0.0, 0.0, 4.0), (0.0, 2.0, 0.0), (0.0, 0.0, 3.0)))))

# ---- polylines ------------------------------------------------------------------------------------------------------

_STEP = "lag(z) over w as z0, lag(y) over w as y0, lag(x) over w as x0, lead(z) over w as z2, lead(y) over w as y2, lead(x) over w as x2"
_query(
    "triangle_areas",
    f"with {POLY}, q as (select *, {_STEP} from poly window w as (partition by user_id order by i)), r as (select user_id, i, z - z0 as a, y - y0 as b, x - x0 as c, z2 - z0 as d, y2 - y0 as e, x2 - x0 as f from q where z0 is not null and z2 is not null) "
    "select user_id, i, round(0.5 * sqrt(pow(b * f - c * e, 2) + pow(c * d - a * f, 2) + pow(a * e - b * d, 2)), 6) as area from r",
)(lambda s, d: branches.polyline_areas(poly(s, d), "user_id", "i").withColumn("area", F.round("area", 6)))
_LERP = ", ".join(f"cast(trunc({a} + ({a}2 - {a}) * (cast(k as double) / (n - 1))) as int) as {a}" for a in "zyx")
_query(
    "polyline_interpolate",
    f"with {POLY}, q as (select *, lead(z) over w as z2, lead(y) over w as y2, lead(x) over w as x2 from poly window w as (partition by user_id order by i)), r as (select *, greatest(cast(floor(sqrt(pow(z2 - z, 2) + pow(y2 - y, 2) + pow(x2 - x, 2))) as int) + 1, 2) as n from q where z2 is not null) select user_id, i, cast(k as int) as k, {_LERP} from r, lateral (select unnest(range(0, n)) as k) u",
)(lambda s, d: branches.interpolate(poly(s, d), "user_id", "i"))
_query(
    "collinear_flag",
    f"with {POLY}, q as (select user_id, i, y, x, first_value(y) over w as y0, first_value(x) over w as x0, nth_value(y, 2) over w as y1, nth_value(x, 2) over w as x1 from poly window w as (partition by user_id order by i rows between unbounded preceding and unbounded following)) "
    "select user_id, bool_and(abs((y1 - y0) * (x - x0) - (x1 - x0) * (y - y0)) <= 1e-8) as collinear from q group by user_id",
)(lambda s, d: _collinear(poly(s, d)))


def _collinear(points: DataFrame) -> DataFrame:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"user_id": rows["user_id"].iloc[:1], "collinear": [collinear(rows.sort_values("i")[["y", "x"]].to_numpy(float))]})

    return points.groupBy("user_id").applyInPandas(run, "user_id long, collinear boolean")


@_query("kept_indices", f"with {POLY} select user_id, i from poly p semi join (select user_id, z, y, x from poly where x >= 10) k using (user_id, z, y, x)")
def _kept(s: SparkSession, d: str) -> DataFrame:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        p = rows[list("zyx")].to_numpy()
        return rows.iloc[branches.kept_indices(p, p[p[:, 2] >= 10])][["user_id", "i"]]

    return poly(s, d).groupBy("user_id").applyInPandas(run, "user_id long, i int")


_query(
    "densify_points",
    f"with {POLY}, nb as (select a.user_id, a.i as i, b.i as j, row_number() over (partition by a.user_id, a.i order by pow(a.z - b.z, 2) + pow(a.y - b.y, 2) + pow(a.x - b.x, 2), b.i) as rn from poly a join poly b using (user_id)), e as (select * from nb where rn <= 10 and j > i), "
    "o as (select user_id, cast(z as double) as z, cast(y as double) as y, cast(x as double) as x from poly union all select e.user_id, a.z + (b.z - a.z) * k / 4.0, a.y + (b.y - a.y) * k / 4.0, a.x + (b.x - a.x) * k / 4.0 from e join poly a on a.user_id = e.user_id and a.i = e.i join poly b on b.user_id = e.user_id and b.i = e.j cross join range(1, 4) t(k)) "
    "select user_id, count(*) as n, round(sum(z), 3) as z, round(sum(y), 3) as y, round(sum(x), 3) as x from o group by user_id",
)(lambda s, d: _densified(poly(s, d)))


def _densified(points: DataFrame) -> DataFrame:
    made = branches.densified(points, "user_id", "i", 4)
    return made.groupBy("user_id").agg(F.count("*").alias("n"), *[F.round(F.sum(a), 3).alias(a) for a in "zyx"])


_query("simplify_polyline")(lambda s, d: branches.simplified(poly(s, d), "user_id", "i"))


@_query("segment_options")
def _segment_options(s: SparkSession, d: str) -> DataFrame:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = branches.segmentations(rows.sort_values("i")[list("zyx")].to_numpy(float))
        return pd.DataFrame({"user_id": rows["user_id"].iloc[0], "option": np.arange(len(found), dtype=np.int32), "breaks": [f.tolist() for f in found]})

    return poly(s, d).groupBy("user_id").applyInPandas(run, "user_id long, option int, breaks array<int>")


@_query("pca_transform")
def _pca(s: SparkSession, d: str) -> DataFrame:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        p = rows[list("zyx")].to_numpy(float)
        mean, axes = principal_axes(p)
        t = (p - mean) @ axes.T
        assert np.allclose(axes @ axes.T, np.eye(3))
        return rows[["user_id", "i"]].assign(a=t[:, 0], b=t[:, 1], c=t[:, 2])

    return poly(s, d).groupBy("user_id").applyInPandas(run, "user_id long, i int, a double, b double, c double")


def _spread_sql() -> str:
    """Variances along the principal axes: the eigenvalues of the covariances, by the cosine of a third of an angle."""
    cov = ", ".join(f"covar_samp({p}, {q}) as {n}" for p, q, n in (("z", "z", "a"), ("y", "y", "b"), ("x", "x", "c"), ("z", "y", "d"), ("z", "x", "e"), ("y", "x", "f")))
    return (
        f"with {POLY}, m as (select user_id, {cov} from poly group by user_id), q as (select *, (a + b + c) / 3 as q from m), p as (select *, sqrt((pow(a - q, 2) + pow(b - q, 2) + pow(c - q, 2) + 2 * (d * d + e * e + f * f)) / 6) as p from q), "
        "t as (select *, acos(greatest(-1.0, least(1.0, ((a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e)) / (2 * p * p * p)))) / 3 as t from p) "
        "select user_id, round(q + 2 * p * cos(t), 4) as a, round(3 * q - (q + 2 * p * cos(t)) - (q + 2 * p * cos(t + 2 * pi() / 3)), 4) as b, round(q + 2 * p * cos(t + 2 * pi() / 3), 4) as c from t"
    )


_query("pca_variances", _spread_sql())(lambda s, d: _pca(s, d).groupBy("user_id").agg(*[F.round(F.var_samp(c), 4).alias(c) for c in "abc"]))


@_query("ellipse_fit")
def _ellipses(s: SparkSession, d: str) -> DataFrame:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        p = rows[list("zyx")].to_numpy(float)
        parts = fit_ellipse(p, p.mean(axis=0))
        return pd.DataFrame({"user_id": rows["user_id"].iloc[0], "centre": [parts[0].tolist()], "major": [parts[1].tolist()], "minor": [parts[2].tolist()]})

    return poly(s, d).groupBy("user_id").applyInPandas(run, "user_id long, centre array<double>, major array<double>, minor array<double>")


def _gap_sql() -> str:
    """A line between the ends where all points lie on one; else the cells on the inner side of all lines through two points that have
    every point on one side."""
    return (
        f"with {POLY}, p as (select distinct user_id, z, y, x from poly), e as (select user_id, z, min({{'y': y, 'x': x}}) as a, max({{'y': y, 'x': x}}) as b, min(y) as y0, max(y) as y1, min(x) as x0, max(x) as x1 from p group by 1, 2), "
        "f as (select e.*, s.flat from e join (select user_id, z, bool_and((b.y - a.y) * (x - a.x) = (b.x - a.x) * (y - a.y)) as flat from p join e using (user_id, z) group by 1, 2) s using (user_id, z)), "
        "n as (select *, greatest(abs(b.y - a.y), abs(b.x - a.x)) as n from f where flat), k as (select user_id, z, a, b, case when n = 0 then 0.0 when k = n then 1.0 else k * (cast(1.0 as double) / n) end as t from n, lateral (select unnest(range(0, n + 1)) as k) u), "
        "side as (select q.user_id, q.z, q.y as ay, q.x as ax, r.y - q.y as dy, r.x - q.x as dx from p q join p r using (user_id, z) join f using (user_id, z) where not flat and (q.y <> r.y or q.x <> r.x)), "
        "edge as (select s.* from side s join p using (user_id, z) group by all having min(dy * (x - ax) - dx * (y - ay)) >= 0), "
        "cell as (select user_id, z, y, x from f, lateral (select unnest(range(y0, y1 + 1)) as y) u, lateral (select unnest(range(x0, x1 + 1)) as x) w where not flat) "
        "select distinct user_id, z, cast(round_even(a.y + t * (b.y - a.y), 0) as int) as y, cast(round_even(a.x + t * (b.x - a.x), 0) as int) as x from k "
        "union all select c.user_id, c.z, cast(c.y as int), cast(c.x as int) from cell c join edge e using (user_id, z) group by 1, 2, 3, 4 having min(e.dy * (c.x - e.ax) - e.dx * (c.y - e.ay)) >= 0"
    )


# the gaps between a user's points of one hour
_query("gap_fill", _gap_sql())(lambda s, d: branches.flat_gaps(poly(s, d), "user_id"))


@_query("branch_smooth")
def _branch(s: SparkSession, d: str) -> DataFrame:
    """Components of the grid as branches, along the middles of their slices."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        cells = rows[list("zyx")].to_numpy(np.int64)
        line = rows.groupby("z")[list("zyx")].mean().sort_index().to_numpy()
        kept, _, _, thickness = branches.smooth_branch(cells, line)
        return pd.DataFrame({"label": [rows["label"].iloc[0]], "cells": [len(cells)], "kept": [len(kept)], "thickness": [thickness]})

    return comp.label(m.threshold(grid(s, d), 17), grid_volume(s)).groupBy("label").applyInPandas(run, "label long, cells long, kept long, thickness double")


# ---- graphs ---------------------------------------------------------------------------------------------------------


def _lines(s: SparkSession, d: str) -> DataFrame:
    """The polylines as edges over the grid volume."""
    p = poly(s, d)
    return p.select(F.lit("grid").alias("volume_id"), (F.col("user_id") + 1).cast("int").alias("edge_id"), "z", F.pmod("y", F.lit(NY)).alias("y"), F.pmod("x", F.lit(NX)).alias("x"))


_query(
    "nearest_edge",
    f"with {GRID}, {POLY}, ln as (select cast(user_id + 1 as int) as edge_id, z, ((y % {NY}) + {NY}) % {NY} as y, ((x % {NX}) + {NX}) % {NX} as x from poly), d as (select g.z, g.y, g.x, edge_id, min(pow(g.z - ln.z, 2) + pow(g.y - ln.y, 2) + pow(g.x - ln.x, 2)) as d2 from (select * from grid where v >= 14) g, ln group by all), "
    "r as (select *, row_number() over (partition by z, y, x order by d2, case when d2 = 0 then -edge_id else edge_id end) as rn from d) select z, y, x, edge_id, round(sqrt(d2), 6) as distance from r where rn = 1",
)(lambda s, d: _cells(graphs.nearest_edge(m.threshold(grid(s, d), 14), _lines(s, d)).withColumn("distance", F.round("distance", 6)), "edge_id", "distance"))


def _cell_graph(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Cells of v >= 16 as nodes by linear index, upside down; touching ones are joined."""
    cells = m.threshold(grid(s, d), 16).select(F.col("volume_id").alias("graph_id"), ((F.col("z") * NY + F.col("y")) * NX + F.col("x")).alias("node_id"), "z", "y", "x")
    steps = F.array(*[F.struct(F.lit(z).alias("dz"), F.lit(y).alias("dy"), F.lit(x).alias("dx")) for z, y, x in ((0, 0, 1), (0, 1, 0), (1, 0, 0))])
    ahead = cells.select("graph_id", F.col("node_id").alias("src"), (F.col("z")).alias("z0"), F.col("y").alias("y0"), F.col("x").alias("x0"), F.inline(steps))
    ahead = ahead.select("graph_id", "src", (F.col("z0") + F.col("dz")).alias("z"), (F.col("y0") + F.col("dy")).alias("y"), (F.col("x0") + F.col("dx")).alias("x"))
    return cells.withColumn("z", NZ - 1 - F.col("z")), ahead.join(cells.withColumnRenamed("node_id", "dst"), ["graph_id", "z", "y", "x"]).select("graph_id", "src", "dst")


_tables, _head = labelled("select z, y, x from grid where v >= 16")
_BFS = (
    f"{_head}{GRID}, {_tables}, top as (select id from cells order by z, id limit 1), bfs(id, dist) as (select id, 0 from top union select link.b, dist + 1 from bfs join link on link.a = bfs.id where dist < 120), "
    "lev as (select id, min(dist) as dist from bfs group by id) "
)
_query("bfs_order", _BFS + "select cells.id as node_id, cast(dist as int) as dist, cast(row_number() over (order by dist nulls last, cells.id) - 1 as int) as ord from cells left join lev using (id)")(lambda s, d: graphs.node_order(*_cell_graph(s, d)).drop("graph_id"))
_query("bfs_tree", _BFS + "select min(p.id) as src, c.id as dst from lev c join link on link.a = c.id join lev p on p.id = link.b and p.dist = c.dist - 1 group by c.id")(lambda s, d: graphs.tree(*_cell_graph(s, d)).drop("graph_id"))
_query("edge_numbering", f"{_head}{GRID}, {_tables} select a as src, b as dst, cast(row_number() over (order by a, b) as int) as edge_id from link where a < b")(lambda s, d: graphs.numbered(_cell_graph(s, d)[1]).drop("graph_id"))
_query(
    "edge_thickness",
    _BFS + ", ord as (select cells.id, row_number() over (order by dist nulls last, cells.id) as o from cells left join lev using (id)), e as (select a, b, case when p.o > q.o then a else b end as later from link join ord p on p.id = a join ord q on q.id = b where a < b), th as (select (z * 11 + y) * 9 + x as id, v from grid where v % 4 > 0) "
    "select a as src, b as dst, round(coalesce(v, 0) / cast(max(coalesce(v, 0)) over () as double), 6) as size from e left join th on th.id = later",
)(lambda s, d: _thickness(s, d))


def _thickness(s: SparkSession, d: str) -> DataFrame:
    nodes, edges = _cell_graph(s, d)
    thick = grid(s, d).where("v % 4 > 0").select(F.col("volume_id").alias("graph_id"), ((F.col("z") * NY + F.col("y")) * NX + F.col("x")).alias("node_id"), F.col("v").alias("thickness"))
    return graphs.edge_thickness(edges, graphs.node_order(nodes, edges), thick).select("src", "dst", F.round("size", 6).alias("size"))


_query("largest_graph", _head + f"{GRID}, {_tables} select id as node_id from lab join cells using (z, y, x) where label = (select label from lab group by label order by count(*) desc, label limit 1)")(lambda s, d: graphs.largest_graph(*_cell_graph(s, d)).drop("graph_id"))

# ---- filters --------------------------------------------------------------------------------------------------------


def _gradient_sql() -> str:
    gap = lambda a: f"pow((coalesce(lead(v) over w{a}, v) - coalesce(lag(v) over w{a}, v)) / 2.0, 2)"
    ways = ", ".join(f"w{a} as (partition by {', '.join(c for c in 'zyx' if c != a)} order by {a})" for a in "zyx")
    return f"with {VEC} select z, y, x, round(sqrt({' + '.join(gap(a) for a in 'zyx')}), 6) as v from vec window {ways}"


_query("gradient_magnitude", _gradient_sql())(lambda s, d: _cells(stencils.gradient_magnitude(vec(s, d), vec_volume(s, d), ragged=True).withColumn("v", F.round("v", 6)), "v"))
_query("em_thresholds", f"with recursive {VEC}, {fs.mixed('vec')}, {fs.crossings('vec')} select 'vec' as volume_id, i, round(threshold, 4) as threshold from cut")(lambda s, d: mixture.thresholds(vec(s, d)).withColumn("threshold", F.round("threshold", 4)))
_query("mixture_components", f"with recursive {VEC}, {fs.mixed('vec')} select 'vec' as volume_id, i, round(mean, 4) as mean, round(weight, 6) as weight, round(std, 4) as std from mix")(
    lambda s, d: mixture.mixture(vec(s, d)).select("volume_id", "i", *[F.round(c, n).alias(c) for c, n in (("mean", 4), ("weight", 6), ("std", 4))])
)
_CELLS = fs.dense(GRID_SHAPE, "grid")
_GRID_SIDES = f"shp as (select {NZ} as n0, {NY} as n1, {NX} as n2)"


def _over_scales(sigmas: list[float], each: str) -> str:
    """Tables of curvatures for each scale, and table best (z, y, x, v) of the greatest value of `each`, in which s is the scale."""
    tables = ", ".join(f"ev{i} as materialized (with {fs.eigenvalues('cells', 'shp', sigma, 'h', GRID_SHAPE)} select * from h)" for i, sigma in enumerate(sigmas))
    values = " union all ".join(f"select z, y, x, {each.replace('{s}', repr(float(sigma)))} as v from ev{i}" for i, sigma in enumerate(sigmas))
    return f"{_GRID_SIDES}, {tables}, best as (select z, y, x, max(v) as v from ({values}) q group by 1, 2, 3)"


_TUBE = _over_scales(list(stencils.TUBE_SIGMAS), "pow({s}, 2) * sqrt(greatest(-e0, 0) * greatest(-e1, 0))")
_query("tubeness", f"with {GRID}, {_CELLS}, {_TUBE} select z, y, x, round(case when (v - lo) / (hi - lo) < 0.025 then 0 else (v - lo) / (hi - lo) end, 6) as v from best, (select min(v) as lo, max(v) as hi from best) e")(
    lambda s, d: _cells(stencils.tubeness(grid(s, d), grid_volume(s)).withColumn("v", F.round("v", 6)), "v")
)
_query(
    "vesselness",
    f"with {VEC}, shp as (select max(z) + 1 as n0, 20 as n1, 64 as n2 from vec), ev as materialized (with {fs.eigenvalues('vec', 'shp', 1.0, 'h')} select *, least(-e1, -e0) as n from h) select z, y, x from ev where n > 0 and n * exp(-0.5 * pow(e2 / (case when e2 <= 0 then 0.5 else 2.0 end * n), 2)) >= 30",
)(lambda s, d: _cells(stencils.vesselness(vec(s, d), m.threshold(vec(s, d), -1000), vec_volume(s, d), ragged=True)[0]))
_BLOB = _over_scales(
    stencils.log_steps(1.0, 2.0, 3),
    "case when e2 < 0 and e0 < 0 and e1 < 0 then (1 - exp(-pow(e2 * pow({s}, 2), 2) / abs(e0 * e1 * pow({s}, 4)) / (2 * 0.04))) * (1 - exp(-(e0 * e0 + e1 * e1 + e2 * e2) * pow({s}, 4) / 800)) else 0 end",
)
_query("blobness", f"with {GRID}, {_CELLS}, {_BLOB}, own as (select best.* from best semi join grid using (z, y, x)) select z, y, x from own, (select min(v) as lo, max(v) as hi from own) e where floor((v - lo) / (hi - lo) * 255) >= 126")(
    lambda s, d: _cells(stencils.blobs(grid(s, d), m.threshold(grid(s, d), 1), grid_volume(s), 1.0, 2.0, 3))
)
_query("diffusion", f"with {GRID}, {_CELLS}, {fs.diffused('cells', 5)} select z, y, x, round(v, 6) as v from d5")(lambda s, d: _cells(stencils.curvature_diffusion(grid(s, d), grid_volume(s)).withColumn("v", F.round("v", 6)), "v"))
_query("fast_march", f"with recursive {GRID}, sd as (select z, y, x from grid where v >= 20), {fs.front('grid', 'sd', NY, NX, 2.0, 80)} select z, y, x, round(v, 6) as v from march")(
    lambda s, d: _cells(fronts.fast_march(grid(s, d), m.threshold(grid(s, d), 20), grid_volume(s), 2.0).withColumn("v", F.round("v", 6)), "v")
)
_MSK = "msk as (select z, y, x from grid where v >= 17)"
_query("hull_by_slice", f"with {GRID}, {_MSK}, {fs.hull('msk', NY, NX)} select z, y, x from hull")(lambda s, d: _cells(hulls.hull_by_slice(m.threshold(grid(s, d), 17))))
_CLOSED = f"di as ({dilated('select z, y, x from msk', itk_ball(1, 1, 1))}), closed as ({eroded('select * from di', itk_ball(1, 1, 1), True)})"
_query("body_hull", f"with {GRID}, {_MSK}, {_CLOSED}, {fs.hull('closed', NY, NX)} select z, y, x from hull union select z, y, x from closed")(lambda s, d: _cells(hulls.body_hull(m.threshold(grid(s, d), 17), grid_volume(s))))
_query(
    "resample_nearest",
    f"with {GRID} select cast(a as int) as z, cast(b as int) as y, cast(c as int) as x, v from range(0, 25) r(a), range(0, 6) s(b), range(0, 4) t(c) join grid on grid.z = least(a * 2, 49) and grid.y = least(b * 2, 10) and grid.x = least(c * 2, 8)",
)(lambda s, d: _cells(stencils.resample_nearest(grid(s, d), grid_volume(s), 2.0), "v"))


_query("resample_spline", f"with {GRID}, {_CELLS}, {fs.splined('cells', GRID_SHAPE, 1.5)} select z, y, x, round(v, 6) as v from spline")(lambda s, d: _cells(stencils.resample_spline(grid(s, d), grid_volume(s), 1.5).withColumn("v", F.round("v", 6)), "v"))
_query("top_node")(lambda s, d: pipelines.top_node(comp.largest_component(m.threshold(grid(s, d), 16), grid_volume(s)), grid_volume(s)).select("z", "y", "x"))


@_query("skeleton")
def _skeleton(s: SparkSession, d: str) -> DataFrame:
    return _cells(pipelines.skeleton(comp.largest_component(m.threshold(grid(s, d), 16), grid_volume(s)), grid_volume(s)))


@_query("skeleton_graph")
def _skeleton_graph(s: SparkSession, d: str) -> DataFrame:
    _, edges = pipelines.skeleton_tables(m.threshold(grid(s, d), 16), grid_volume(s))
    return edges.select("src", "dst", (F.size("line") / 3).cast("int").alias("points"))


def _parts_sql() -> str:
    tables, head = labelled("select z, y, x from grid where v >= 18", 26)
    return f"{head}{GRID}, {tables} select label, count(*) as cells, true as inside from lab group by label"


@_query("thinned_parts", _parts_sql())
def _thinned(s: SparkSession, d: str) -> DataFrame:
    """Each part's cells by 26 neighbours, and whether thinning left exactly one part of it, within it."""
    mask, v = m.threshold(grid(s, d), 18), grid_volume(s)
    whole, lines = (stored(comp.label(x, v, 26)) for x in (mask, pipelines.thinned(mask, v)))
    under = lines.select(*m.KEYS, F.col("label").alias("line")).join(whole, m.KEYS, "left").groupBy("label").agg((F.countDistinct("line") == 1).alias("inside"))
    return m.label_sizes(whole).withColumnRenamed("n", "cells").join(under, "label", "full").select("label", "cells", F.coalesce("inside", F.lit(False)).alias("inside"))


@_query("path_skeleton")
def _paths(s: SparkSession, d: str) -> DataFrame:
    """Edges of the tree of shortest paths through the stacks' volumes."""
    return pipelines.path_graphs(m.threshold(stack(s, d), 2), stack_volumes(s, d)).where("src >= 0").select("graph_id", "src", "dst")


_GAPS = "select z, y, x from grid where v >= 12"
_query("skeleton_clumps", f"{filled(_GAPS, NEAR6, BORDER).rpartition('select z, y, x from msk union all')[0].rstrip()}, full_ as (select z, y, x from msk union all (select z, y, x from rest except select z, y, x from out_)), er as ({eroded('select * from full_', itk_ball(1, 1, 1), False)}) select z, y, x from full_ except ({dilated('select * from er', itk_ball(1, 1, 1))})")(
    lambda s, d: _cells(pipelines.without_clumps(m.threshold(grid(s, d), 12), grid_volume(s)))
)


def _prepared_sql() -> str:
    """Holes by 26 neighbours, then parts by faces of more than 50 cells, labelled by rounds of the least label around."""
    head = filled("select z, y, x from grid where v >= 16", NEAR26, BORDER).rpartition("select z, y, x from msk union all")[0].rstrip()
    return f"{head}, full_ as (select (z * {NY} + y) * {NX} + x as id, z, y, x from (select z, y, x from msk union all (select z, y, x from rest except select z, y, x from out_)) q), {passed('full_', 150)} select z, y, x from lab where label in (select label from lab group by label having count(*) > 50) or (select count(distinct label) from lab) = 1"


_query("path_preparation", _prepared_sql())(lambda s, d: _cells(pipelines.path_preparation(m.threshold(grid(s, d), 16), grid_volume(s))))


@_query("clean_graph", _head + f"{GRID}, {_tables}, " + """big as (select id from lab join cells using (z, y, x) where label = (select label from lab group by label order by count(*) desc, label limit 1)),
    top as (select id from big join cells using (id) order by z, id limit 1), bfs(id, dist) as (select id, 0 from top union select link.b, dist + 1 from bfs join link on link.a = bfs.id where dist < 120),
    lev as (select id, min(dist) as dist from bfs group by id) select least(min(p.id), c.id) as a, greatest(min(p.id), c.id) as b from lev c join link on link.a = c.id join lev p on p.id = link.b and p.dist = c.dist - 1 group by c.id""")
def _clean(s: SparkSession, d: str) -> DataFrame:
    nodes, edges = _cell_graph(s, d)
    kept = pipelines.clean_graph(nodes, edges)[1]
    return kept.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


_query("contour_sweep", f"with recursive {GRID}, cell as (select (z * {NY} + y) * {NX} + x as id, z, y, x from grid where v >= 14), {fs.swept('cell', tuple(n // 2 for n in GRID_SHAPE))} select z, y, x from sweep")(lambda s, d: _cells(sweep_from_centre(m.threshold(grid(s, d), 14), grid_volume(s))))

# ---- pipelines on phantoms ------------------------------------------------------------------------------------------


def thorax(s: SparkSession, d: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Image, lung labels and volumes of made-up chests: two lungs of air with vessels, tissue around, and a tube of air between.

    With tables there is a chest for each 25 slices of the vectors, whose values are its noise; without there is one.
    """
    shape = (24, 40, 56)
    z, y, x = np.indices(shape).astype(float)
    image = np.full(shape, 40.0)
    label = np.zeros(shape, int)
    for i, cx in enumerate((15.0, 41.0)):
        lung = ((z - 12) / 11) ** 2 + ((y - 20) / 14) ** 2 + ((x - cx) / 9) ** 2 <= 1
        label[lung] = i + 1
        image[lung] = -850
        image[lung & ((y - 20 - (z - 12) / 2) ** 2 + (x - cx) ** 2 <= 2)] = 30
    pipe = (y - 20) ** 2 + (x - 28) ** 2
    image[pipe <= 30] = 60
    image[pipe <= 9] = -1000
    bronchi = ((y - 20) ** 2 + (z - 11) ** 2 <= 5) & (x > 14) & (x < 42)
    image[((y - 20) ** 2 + (z - 11) ** 2 <= 16) & (pipe > 9) & (x > 14) & (x < 42) & (label == 0)] = 60
    image[bronchi] = -1000
    noise = (z * 7 + y * 13 + x * 29) % 11 - 5 if d is None else 0 * z
    rows = np.stack([*np.nonzero(np.ones(shape)), (image + noise).ravel(), label.ravel()], 1)
    table = s.createDataFrame(pd.DataFrame({"volume_id": "thorax", "z": rows[:, 0].astype(np.int32), "y": rows[:, 1].astype(np.int32), "x": rows[:, 2].astype(np.int32), "v": rows[:, 3], "label": rows[:, 4].astype(np.int32)}))
    volumes = volume(s, "thorax", shape)
    if d is not None:
        number = F.concat(F.lit("thorax"), F.floor(F.col("z") / 25).cast("string"))
        rough = vec(s, d).select(number.alias("volume_id"), (F.col("z") % 25).alias("z"), F.col("y").alias("y20"), "x", (F.pmod("v", F.lit(11)) - 5).alias("noise"))
        table = stored(table.drop("volume_id").withColumn("y20", F.col("y") % 20).join(rough, ["z", "y20", "x"]).select("volume_id", "z", "y", "x", (F.col("v") + F.col("noise")).alias("v"), "label"))
        volumes = stored(alike(rough.select("volume_id").distinct(), shape))
    return table.select(*m.KEYS, "v"), table.where("label > 0").select(*m.KEYS, "label"), volumes


def tube(s: SparkSession, d: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The mask of a forked tube, and its volume; with tables one for each 25 slices of the vectors, with holes where values are greatest."""
    shape = (40, 24, 32)
    z, y, x = np.indices(shape).astype(float)
    fork = ((y - 12) ** 2 + (x - 16) ** 2 <= 9) & (z >= 20) | ((y - 12) ** 2 + (np.abs(x - 16) - (20 - z) / 2) ** 2 <= 6) & (z < 20) & (z > 2)
    at = np.argwhere(fork).astype(np.int32)
    table, volumes = s.createDataFrame(pd.DataFrame({"volume_id": "tube", "z": at[:, 0], "y": at[:, 1], "x": at[:, 2]})), volume(s, "tube", shape)
    if d is None:
        return table, volumes
    number = F.concat(F.lit("tube"), F.floor(F.col("z") / 25).cast("string"))
    rough = vec(s, d).select(number.alias("volume_id"), (F.col("z") % 25).alias("z25"), F.col("y").alias("y20"), "x", (F.col("v") > 330).alias("hole"))
    shape_ = F.broadcast(table.drop("volume_id").withColumns({"z25": F.col("z") % 25, "y20": F.col("y") % 20}))  # some 1,200 cells
    joined = rough.where("not hole").join(shape_, ["z25", "y20", "x"])
    return stored(joined.select("volume_id", "z", "y", "x")), stored(alike(rough.select("volume_id").distinct(), shape))


def chest(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Image, lung mask and volume made from the vectors: strong values are lung, and a tube of air runs through all slices."""
    pipe = (F.col("y") - 10) * (F.col("y") - 10) + (F.col("x") - 32) * (F.col("x") - 32)
    image = vec(s, d).withColumn("v", F.when(pipe <= 20, -1000 + F.pmod("v", F.lit(7))).otherwise(F.col("v")))
    return image, image.where("v >= 280").where(pipe > 60).select(*m.KEYS), vec_volume(s, d)


_PIPE = "(y - 10) * (y - 10) + (x - 32) * (x - 32)"
_ROOM = "z between 0 and (select max(z) from vec) and y between 0 and 19 and x between 0 and 63"


def _middle_sql() -> str:
    """Table middle: closed lungs, hulls of the slices, what they hold besides, opened by a ball of radius 3."""
    ball, three = itk_ball(1, 1, 1), itk_ball(3, 3, 3)
    room = lambda q: q.replace(INSIDE, _ROOM)
    shut = f"select b.z, b.y, b.x from chest b cross join (values {', '.join(map(str, ball))}) o(dz, dy, dx) left join di s on s.z = b.z + dz and s.y = b.y + dy and s.x = b.x + dx group by 1, 2, 3 having bool_and(s.z is not null or not (b.z + dz between 0 and (select max(z) from vec) and b.y + dy between 0 and 19 and b.x + dx between 0 and 63))"
    return (
        f"{VEC}, chest as (select z, y, x, case when {_PIPE} <= 20 then -1000 + ((v % 7) + 7) % 7 else v end as v from vec), lung as (select z, y, x from chest where v >= 280 and {_PIPE} > 60), "
        f"di as ({room(dilated('select * from lung', ball))}), closed as ({shut}), {fs.hull('closed', 20, 64)}, between_ as (select z, y, x from hull except select z, y, x from closed), "
        f"er as ({eroded('select * from between_', three, False)}), middle as ({room(dilated('select * from er', three))})"
    )


_query("mediastinum_pipeline", f"with {_middle_sql()} select z, y, x from middle")(lambda s, d: (lambda t: _cells(pipelines.mediastinum(t[1], t[2])))(chest(s, d)))
_query(
    "trachea_pipeline",
    f"with recursive {_middle_sql()}, inner_ as (select chest.* from chest semi join middle using (z, y, x)), air as (select z, y, x from inner_ where v between (select min(v) from inner_) and floor((select min(v) from inner_) / 3.0) and (select min(v) from inner_) < 0), "
    "thin as (select b.z, b.y, b.x from air b cross join range(-1, 2) p(dy) cross join range(-1, 2) q(dx) left join air s on s.z = b.z and s.y = b.y + dy and s.x = b.x + dx group by 1, 2, 3 having bool_and(s.z is not null or not (b.y + dy between 0 and 19 and b.x + dx between 0 and 63))), "
    f"cell as (select (z * 20 + y) * 64 + x as id, z, y, x from thin), {passed('cell', 150, 26)} select z, y, x from lab where label = (select label from lab group by label order by count(*) desc, label desc limit 1)",
)(lambda s, d: (lambda t: _cells(pipelines.trachea(*t)))(chest(s, d)))
_REGIONS = f"{VEC}, reg as (select z, y, x, cast(((v % 8) + 8) % 8 as int) as label from vec)"


def _regions(s: SparkSession, d: str) -> DataFrame:
    return vec(s, d).select(*m.KEYS, F.pmod("v", F.lit(8)).cast("int").alias("label"))


_query("lungs_pipeline", f"with {_REGIONS} select z, y, x, case when label in (1, 2) then 1 else 2 end as label from reg where label between 1 and 5")(lambda s, d: _cells(pipelines.lungs(_regions(s, d).where("label < 6"), binary=False), "label"))
_query("lungs_mask_pipeline", f"with {_REGIONS} select z, y, x from reg where label between 1 and 5")(lambda s, d: _cells(pipelines.lungs(s.range(0).select(), plug_in=lambda _: pipelines.lobes(_regions(s, d), {i: i for i in range(1, 6)}))))
_query("lobes_pipeline", f"with {_REGIONS} select z, y, x, case label when 7 then 1 when 3 then 2 when 4 then 3 when 5 then 4 else 5 end as label from reg where label in (7, 3, 4, 5, 1)")(lambda s, d: _cells(pipelines.lobes(_regions(s, d), {7: 1, 3: 2, 4: 3, 5: 4, 1: 5}), "label"))
_query("run_pipeline")(lambda s, d: (lambda t: pipelines.run(s, t[0], t[2], t[1]).select(*m.KEYS))(thorax(s, d)))
_query("airways_pipeline")(lambda s, d: (lambda t: pipelines.airways(t[0], t[1], t[2], [-1100.0, -500.0, -200.0, 200.0])["airways"].select(*m.KEYS))(thorax(s, d)))
_query("vessels_pipeline")(lambda s, d: (lambda t: pipelines.vessels(t[0], t[1], t[2]).select(*m.KEYS))(thorax(s, d)))
_query("tree_pipeline")(lambda s, d: (lambda t: pipelines.smooth_tree(t[0], t[0], t[1]).select(*m.KEYS))(tube(s, d)))
assert NZ == GRID_SHAPE[0] and GRID_SQL and VEC_SQL
