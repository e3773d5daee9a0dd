"""Queries of mask algebra, aggregates, morphology and components over the fixture volumes, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.offsets import Offset, box, exact_ball, face, full, itk_ball
from ..operators import components as comp, masks as m, morphology as morph
from ..sources.fixtures import GRID_SHAPE, GRID_SQL, STACK_SQL, VEC_SQL, grid, grid_volume, stack, stack_volumes, vec, vec_volume

NZ, NY, NX = GRID_SHAPE
GRID = f"grid as ({GRID_SQL})"
VEC = f"vec as ({VEC_SQL})"
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


def _mask(spark: SparkSession, d: str, least: int) -> DataFrame:
    return m.threshold(grid(spark, d), least)


def _values(offsets: list[Offset]) -> str:
    return "(values " + ", ".join(map(str, offsets)) + ") o(dz, dy, dx)"


INSIDE = f"z between 0 and {NZ - 1} and y between 0 and {NY - 1} and x between 0 and {NX - 1}"


def dilated(mask: str, offsets: list[Offset], bounded: bool = True) -> str:
    return f"select distinct * from (select z + dz as z, y + dy as y, x + dx as x from ({mask}) s, {_values(offsets)}) q" + (f" where {INSIDE}" if bounded else "")


def eroded(mask: str, offsets: list[Offset], border: bool) -> str:
    """border: whether cells outside the volume count as inside."""
    table = f"select z, y, x from range(0, {NZ}) a(z), range(0, {NY}) b(y), range(0, {NX}) c(x)"
    base = table if border else mask
    rule = f"s.z is not null or not (b.z + dz between 0 and {NZ - 1} and b.y + dy between 0 and {NY - 1} and b.x + dx between 0 and {NX - 1})" if border else "s.z is not null"
    return f"select cast(b.z as int) as z, cast(b.y as int) as y, cast(b.x as int) as x from ({base}) b cross join {_values(offsets)} left join ({mask}) s on s.z = b.z + dz and s.y = b.y + dy and s.x = b.x + dx group by 1, 2, 3 having bool_and({rule})"


def labelled(mask: str, connectivity: int = 6) -> tuple[str, str]:
    """Common tables that end with lab(z, y, x, label), and what must stand before them."""
    near = {6: "abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x) = 1", 26: "abs(a.z - b.z) <= 1 and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1 and a.id <> b.id", 4: "a.z = b.z and abs(a.y - b.y) + abs(a.x - b.x) = 1"}[connectivity]
    return (
        f"cells as (select (z * {NY} + y) * {NX} + x as id, z, y, x from ({mask}) q), link as (select a.id as a, b.id as b from cells a join cells b on {near}), "
        "walk(id, l) as (select id, id from cells union select link.b, walk.l from walk join link on link.a = walk.id where walk.l < link.b), "
        "lab as (select z, y, x, cast(min(l) as bigint) as label from walk join cells using (id) group by 1, 2, 3)",
        "with recursive ",
    )


def filled(mask: str, near: str, edge: str) -> str:
    """A query: the mask and the holes of its complement."""
    return f"""with recursive {GRID}, msk as ({mask}), rest as (
        select cast(z as int) as z, cast(y as int) as y, cast(x as int) as x from range(0, {NZ}) a(z), range(0, {NY}) b(y), range(0, {NX}) c(x)
        except select z, y, x from msk),
        link as (select a.z as az, a.y as ay, a.x as ax, b.z as bz, b.y as by_, b.x as bx from rest a join rest b on {near}),
        out_(z, y, x) as (select z, y, x from rest where {edge} union select bz, by_, bx from out_ join link on az = z and ay = y and ax = x)
        select z, y, x from msk union all (select z, y, x from rest except select z, y, x from out_)"""


def passed(cells: str, rounds: int, connectivity: int = 6) -> str:
    """Tables that end with lab: the cells (id, z, y, x) and their label, by rounds in which each takes the least label around it.

    For large parts, where `labelled` would follow every label that a cell has had. Needs `recursive`.
    """
    near = {6: "abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x) <= 1", 26: "abs(a.z - b.z) <= 1 and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1"}[connectivity]
    return (
        f"lab_link as (select a.id as a, b.id as b from {cells} a join {cells} b on {near}), lab_t(r, id, l) as (select 0, id, id from {cells} union all "
        f"select any_value(r) + 1, a, min(l) from lab_t join lab_link on b = id where r < {rounds} group by a), lab as (select c.*, l as label from lab_t join {cells} c using (id) where r = {rounds})"
    )


# ---- mask algebra ---------------------------------------------------------------------------------------------------

_A, _B = "select z, y, x from grid where v >= 12", "select z, y, x from grid where v <= 14"

_query("mask_threshold", f"with {GRID} {_A}")(lambda s, d: _cells(_mask(s, d, 12)))
_query("mask_band", f"with {GRID} select z, y, x, case when v between 8 and 16 then v else 0 end as v from grid")(lambda s, d: _cells(m.keep_band(grid(s, d), 8, 16), "v"))
_query("mask_above_minimum", f"with {VEC} select z, y, x from vec where v > (select min(v) from vec)")(lambda s, d: _cells(m.above_minimum(vec(s, d))))
_query("mask_above_slice_minimum", f"with {VEC} select z, y, x from (select *, min(v) over (partition by z) as lo from vec) q where v > lo")(lambda s, d: _cells(m.above_minimum(vec(s, d), True)))
_query("mask_semi", f"with {GRID}, {VEC} select z, y, x, v from grid semi join (select z, y, x from vec where v > 0) s using (z, y, x)")(lambda s, d: _cells(m.masked(grid(s, d), m.threshold(vec(s, d), 1).withColumn("volume_id", F.lit("grid"))), "v"))
_query("mask_default_fill", f"with {GRID} select z, y, x, case when v >= 12 then v else -1 end as v from grid")(lambda s, d: _cells(m.masked(grid(s, d), _mask(s, d, 12), -1), "v"))
_query("mask_union", f"with {GRID} {_A} union {_B}")(lambda s, d: _cells(m.union(_mask(s, d, 12), m.threshold(grid(s, d), None, 14))))
_query("mask_intersect", f"with {GRID} {_A} intersect {_B}")(lambda s, d: _cells(m.intersect(_mask(s, d, 12), m.threshold(grid(s, d), None, 14))))
_query("mask_anti", f"with {GRID} {_A} except {_B}")(lambda s, d: _cells(m.minus(_mask(s, d, 12), m.threshold(grid(s, d), None, 14))))
_query("mask_complement_in_region", f"with {GRID} select z, y, x from grid where v < 12")(lambda s, d: _cells(m.minus(m.threshold(grid(s, d), 1), _mask(s, d, 12))))
_query("mask_same_cells", f"with {GRID} select cast(not exists((({_A}) except ({_B})) union all (({_B}) except ({_A}))) as boolean) as same")(lambda s, d: m.same_cells(_mask(s, d, 12), m.threshold(grid(s, d), None, 14)).select("same"))
_query("image_product", f"with {GRID} select z, y, x, v * (v + 1) as v from grid")(lambda s, d: _cells(m.product(grid(s, d), grid(s, d).withColumn("v", F.col("v") + 1)), "v"))

# ---- maps -----------------------------------------------------------------------------------------------------------

_EXT = "(select min(v) as lo, max(v) as hi from vec) e"
_query("bounded_reciprocal", f"with {GRID} select z, y, x, round(1.0 / (1.0 + cast(v as double)), 9) as v from grid")(lambda s, d: _cells(m.bounded_reciprocal(grid(s, d)).withColumn("v", F.round("v", 9)), "v"))
_query("minmax_normalise", f"with {VEC} select z, y, x, round(case when n < 0.025 then 0.0 else n end, 9) as v from (select z, y, x, cast(v - lo as double) / (hi - lo) as n from vec, {_EXT}) q")(lambda s, d: _cells(m.normalise(vec(s, d)).withColumn("v", F.round("v", 9)), "v"))
_query("rescale_255", f"with {VEC} select z, y, x, cast(floor(cast(v - lo as double) / (hi - lo) * 255) as int) as v from vec, {_EXT}")(lambda s, d: _cells(m.rescale_bytes(vec(s, d)), "v"))
_query("speed_map", f"with {VEC}, top as (select max(v) as t from vec) select z, y, x, round(case when v > -100 then 0.001 + 0.999 * pow(1 - least(greatest(cast(v as double) / t, 0.0), 1.0), 2.0) else 0.001 end, 9) as v from vec, top")(lambda s, d: _cells(m.vesselness_speed(vec(s, d), m.threshold(vec(s, d), -99)).withColumn("v", F.round("v", 9)), "v"))
_query("arrival_to_mask", f"with {VEC} select z, y, x, case when t <= 1000 then t + 1 else 0.0 end as v from (select z, y, x, least(greatest(cast(v as double) * 5, 0.0), 10000.0) as t from vec) q")(lambda s, d: _cells(m.arrival_mask(vec(s, d).withColumn("v", F.col("v") * 5)), "v"))
_query("gaussian_pdf", f"with {VEC} select z, y, x, round(exp(-0.5 * pow((v - 10.0) / 120.0, 2)) / (120.0 * sqrt(2 * pi())), 12) as p from vec")(lambda s, d: _cells(vec(s, d).withColumn("p", F.round(m.gaussian_pdf(F.col("v"), 10.0, 120.0), 12)), "p"))
_query("interval_labels", f"with {VEC} select z, y, x, case when v = (select min(v) from vec) then 0 when v >= -600 and v < -100 then 1 when v >= -100 and v < 80 then 2 when v >= 80 and v < 600 then 3 else 0 end as label from vec")(lambda s, d: _cells(m.intervals(vec(s, d), [-600, -100, 80, 600]), "label"))


def _labels(s: SparkSession, d: str) -> DataFrame:
    return vec(s, d).select("volume_id", "z", "y", "x", F.pmod(F.col("v"), F.lit(7)).cast("int").alias("label"))


LAB = f"{VEC}, lab as (select z, y, x, cast(((v % 7) + 7) % 7 as int) as label, v from vec)"
_query("recode_classes", f"with {LAB} select z, y, x, case label when 1 then 4 when 2 then 5 when 6 then 1 end as label from lab where label in (1, 2, 6)")(lambda s, d: _cells(m.recode(_labels(s, d), {1: 4, 2: 5, 6: 1}), "label"))
_query("group_classes", f"with {LAB} select z, y, x, case when label in (1, 2) then 1 else 2 end as label from lab where label > 0")(lambda s, d: _cells(m.group_labels(_labels(s, d), [1, 2]), "label"))

# ---- aggregates -----------------------------------------------------------------------------------------------------

_query("histogram", f"with {GRID} select v, count(*) as n from grid group by v")(lambda s, d: m.histogram(grid(s, d)).select("v", "n"))
_query("label_stats", f"with {LAB} select label, count(*) as n, min(v) as least, max(v) as greatest, round(avg(v), 6) as mean from lab group by label")(lambda s, d: m.label_statistics(vec(s, d), _labels(s, d)).select("label", "n", "least", "greatest", F.round("mean", 6).alias("mean")))
_query("label_sizes", f"with {LAB} select label, count(*) as n, cast(count(*) * 0.75 as double) as size from lab group by label")(lambda s, d: m.label_sizes(_labels(s, d), vec_volume(s, d).withColumns({"sz": F.lit(1.5), "sy": F.lit(0.5), "sx": F.lit(1.0)})).select("label", "n", "size"))
_query("modal_label", f"with {LAB} select label from lab where v > 50 group by label order by count(*) desc, label limit 1")(lambda s, d: m.modal_label(_labels(s, d), m.threshold(vec(s, d), 51)).select("label"))
_query("weighted_bincount", f"with {LAB} select label, cast(sum(case when v > 50 then 0 else 1 end) as bigint) as outside from lab group by label")(lambda s, d: m.outside_counts(_labels(s, d), m.threshold(vec(s, d), 51)).select("label", "outside"))
_query("iou_dice", f"with {GRID}, a as ({_A}), b as ({_B}), n as (select (select count(*) from a) as a, (select count(*) from b) as b, (select count(*) from a semi join b using (z, y, x)) as c) select round(cast(c as double) / (a + b - c), 9) as iou, round(2.0 * c / (a + b), 9) as dice from n")(lambda s, d: m.overlap(_mask(s, d, 12), m.threshold(grid(s, d), None, 14)).select(F.round("iou", 9).alias("iou"), F.round("dice", 9).alias("dice")))
_query("iou_by_label", f"with {LAB} select label, round(cast(sum(case when v > 50 then 1 else 0 end) as double) / (count(*) + (select count(*) from vec where v > 50) - sum(case when v > 50 then 1 else 0 end)), 9) as iou from lab group by label")(lambda s, d: m.overlap_by_label(_labels(s, d), m.threshold(vec(s, d), 51)).select("label", F.round("iou", 9).alias("iou")))
_query("bbox_padded", f"with {GRID}, lab as (select *, v % 5 as label from grid where v >= 17) select label, " + ", ".join(f"cast(greatest(min({a}) - 5, 0) as int) as {a}0, cast(least(max({a}) + 6, {n}) as int) as {a}1" for a, n in zip("zyx", GRID_SHAPE, strict=True)) + " from lab group by label")(lambda s, d: m.bounding_box(grid(s, d).where("v >= 17").withColumn("label", F.col("v") % 5), grid_volume(s)).drop("volume_id"))
_query("axis_spread", f"with {GRID}, g as (select v % 5 as label, " + ", ".join(f"avg({a}) as c{a}, var_pop({a}) as var_{a}" for a in "zyx") + " from grid where v >= 12 group by 1) select label, " + ", ".join(f"round(c{a}, 6) as c{a}, round(var_{a}, 6) as var_{a}" for a in "zyx") + ", case when var_z <= var_y and var_z <= var_x then 0 when var_y <= var_x then 1 else 2 end as flat_axis from g")(lambda s, d: m.spread(grid(s, d).where("v >= 12").withColumn("label", F.col("v") % 5), ["label"]).select("label", *[F.round(f"{p}{a}", 6).alias(f"{p}{a}") for p in ("c", "var_") for a in "zyx"], "flat_axis"))

# ---- morphology -----------------------------------------------------------------------------------------------------

_M = "select z, y, x from grid where v >= 14"
_query("offsets_exact_ball", "select cast(count(*) as bigint) as n from range(-2, 3) a(z), range(-2, 3) b(y), range(-2, 3) c(x) where z * z + y * y + x * x <= 4")(lambda s, d: s.createDataFrame([(len(exact_ball(2.0)),)], "n long"))
_query("dilate6", f"with {GRID} " + dilated(_M, [(0, 0, 0), *face()]))(lambda s, d: _cells(morph.dilate(_mask(s, d, 14), grid_volume(s), [(0, 0, 0), *face()])))
_query("dilate_box_by_slice", f"with {GRID} " + dilated(_M, box(0, 1, 1)))(lambda s, d: _cells(morph.dilate_by_slice(_mask(s, d, 14), grid_volume(s))))
_query("erode_box_by_slice", f"with {GRID} " + eroded("select z, y, x from grid where v >= 8", box(0, 1, 1), True) + f" and bool_or(s.z is not null and dz = 0 and dy = 0 and dx = 0)")(lambda s, d: _cells(morph.erode_by_slice(_mask(s, d, 8), grid_volume(s))))
_E8 = "select z, y, x from grid where v >= 8"
_query("open_by_slice", f"with {GRID}, er as (" + eroded(_E8, box(0, 1, 1), True) + ") " + dilated("select * from er", box(0, 1, 1)))(lambda s, d: _cells(morph.open_by_slice(_mask(s, d, 8), grid_volume(s))))
_query("erode_ball", f"with {GRID} " + eroded(_E8, itk_ball(1, 1, 1), False))(lambda s, d: _cells(morph.erode(_mask(s, d, 8), grid_volume(s), itk_ball(1, 1, 1))))
_query("open_ball", f"with {GRID}, er as (" + eroded(_E8, itk_ball(1, 1, 1), False) + ") " + dilated("select * from er", itk_ball(1, 1, 1)))(lambda s, d: _cells(morph.opening(_mask(s, d, 8), grid_volume(s), itk_ball(1, 1, 1))))
for _name, _ball in (("close_ball", itk_ball(1, 1, 1)), ("close_ball_3", itk_ball(3, 3, 3)), ("close_aniso_6_6_3", itk_ball(6, 6, 3)), ("close_exact_ball_2", exact_ball(2.0))):
    _query(_name, f"with {GRID}, di as (" + dilated("select z, y, x from grid where v >= 16", _ball) + ") " + eroded("select * from di", _ball, True))(lambda s, d, ball=_ball: _cells(morph.closing(_mask(s, d, 16), grid_volume(s), ball)))
_query(
    "constrained_dilation",
    f"with {GRID}, reg as (select z, y, x, v % 3 as label from grid), seeds as (select z, y, x, label from reg semi join (select z, y, x from grid where v >= 17) q using (z, y, x)), moved as (select distinct s.z + dz as z, s.y + dy as y, s.x + dx as x, label as own from seeds s, {_values(itk_ball(1, 1, 1))}) "
    f"select distinct z, y, x from moved left join reg using (z, y, x) where {INSIDE} and coalesce(label, 0) = own",
)(lambda s, d: _cells(morph.constrained_dilation(_mask(s, d, 17), grid(s, d).withColumn("label", F.col("v") % 3), grid_volume(s), itk_ball(1, 1, 1))))

# ---- components and holes -------------------------------------------------------------------------------------------

_C17 = "select z, y, x from grid where v >= 17"


def _with(mask: str, connectivity: int = 6) -> str:
    tables, head = labelled(mask, connectivity)
    return f"{head}{GRID}, {tables} "


_query("components6", _with(_C17) + "select z, y, x, label from lab")(lambda s, d: _cells(comp.label(_mask(s, d, 17), grid_volume(s), 6), "label"))
_query("components26", _with("select z, y, x from grid where v >= 19", 26) + "select z, y, x, label from lab")(lambda s, d: _cells(comp.label(_mask(s, d, 19), grid_volume(s), 26), "label"))
_query("component_sizes", _with(_C17) + "select label, count(*) as n from lab group by label")(lambda s, d: m.label_sizes(comp.label(_mask(s, d, 17), grid_volume(s), 6)).select("label", "n"))
_query("largest_component", _with(_C17) + "select z, y, x from lab where label = (select label from lab group by label order by count(*) desc, label limit 1)")(lambda s, d: _cells(comp.largest_component(_mask(s, d, 17), grid_volume(s))))
_query("largest_component_last", _with(_C17) + "select z, y, x from lab where label = (select label from lab group by label order by count(*) desc, label desc limit 1)")(lambda s, d: _cells(comp.largest_component(_mask(s, d, 17), grid_volume(s), 6, True)))
_query("drop_small", _with(_C17) + "select z, y, x from lab where label in (select label from lab group by label having count(*) > 10)")(lambda s, d: _cells(comp.drop_small(_mask(s, d, 17), grid_volume(s), 10)))
_REF = "select z, y, x from grid where v >= 15 and z < 20"
_query("most_similar_component", _with(_C17) + f", ref as ({_REF}), sc as (select label, cast(sum(case when ref.z is null then 0 else 1 end) as double) / (count(*) + (select count(*) from ref) - sum(case when ref.z is null then 0 else 1 end)) as iou from lab left join ref using (z, y, x) group by label) select z, y, x from lab where label = (select label from sc where iou > 0 order by iou desc, label limit 1)")(lambda s, d: _cells(comp.most_similar_component(_mask(s, d, 17), _mask(s, d, 15).where("z < 20"), grid_volume(s))))
_query("reach_outside", _with(_C17) + "select z, y, x from lab where label in (select label from lab where z >= 20)")(lambda s, d: _cells(comp.reaching_outside(_mask(s, d, 17), grid(s, d).where("z < 20"), grid_volume(s))))
_query("overlap_keep", _with(_C17) + "select z, y, x from lab where label in (select label from lab join grid using (z, y, x) where v >= 20) union select z, y, x from grid where v >= 20")(lambda s, d: _cells(comp.touching_components(_mask(s, d, 17), _mask(s, d, 20), grid_volume(s))))
_query(
    "leak_removal",
    _with("select z, y, x from grid where (v >= 16 and z >= 20) or (v >= 15 and z between 25 and 40)") + ", tr as (select label from lab join grid using (z, y, x) where v >= 15 and z between 25 and 40 group by label order by count(*) desc, label limit 1) "
    "select z, y, x from grid where v >= 16 and z < 20 union select z, y, x from lab semi join tr using (label) semi join (select z, y, x from grid where v >= 16 and z >= 20) q using (z, y, x)",
)(lambda s, d: _cells(comp.without_leaks(_mask(s, d, 16), grid(s, d).where("z < 20"), _mask(s, d, 15).where("z between 25 and 40"), grid_volume(s))))
_query("reconstruct_by_slice", _with(_E8, 4) + ", er as (" + eroded(_E8, box(0, 1, 1), True) + ") select z, y, x from lab where label in (select label from lab semi join er using (z, y, x))")(lambda s, d: _cells(morph.reconstruct_by_slice(_mask(s, d, 8), grid_volume(s))))
NEAR6 = "abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x) = 1"
NEAR26 = "abs(a.z - b.z) <= 1 and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1 and (a.z <> b.z or a.y <> b.y or a.x <> b.x)"
BORDER = f"z = 0 or z = {NZ - 1} or y = 0 or y = {NY - 1} or x = 0 or x = {NX - 1}"
_M12 = "select z, y, x from grid where v >= 12"
_Q4 = "a.z = b.z and abs(a.y - b.y) + abs(a.x - b.x) = 1"
_YX = f"y = 0 or y = {NY - 1} or x = 0 or x = {NX - 1}"
_query("fill_holes_by_slice", filled(_M12, _Q4, _YX))(lambda s, d: _cells(morph.fill_holes_by_slice(_mask(s, d, 12), grid_volume(s))))
_query("fill_holes_3d_6", filled(_M12, NEAR6, BORDER))(lambda s, d: _cells(morph.fill_holes(_mask(s, d, 12), grid_volume(s), 6)))
_query("fill_holes_3d_26", filled("select z, y, x from grid where v >= 8", NEAR26, BORDER))(lambda s, d: _cells(morph.fill_holes(_mask(s, d, 8), grid_volume(s), 26)))


def largest_component_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold the count grid, label it, keep the largest component: its size and bounding box."""
    labels = comp.label(_mask(spark, sf_dir, 4), grid_volume(spark), 6)
    kept = labels.join(m.best_label(m.label_sizes(labels), "n"), ["volume_id", "label"], "left_semi")
    return m.label_sizes(kept).join(m.bounding_box(kept, grid_volume(spark), 0), ["volume_id", "label"])


_query(
    "largest_component_report",
    f"with recursive {GRID}, cells as (select (z * {NY} + y) * {NX} + x as id, z, y, x from grid where v >= 4), {passed('cells', 150)} "
    "select 'grid' as volume_id, cast(label as bigint) as label, count(*) as n, min(z) as z0, max(z) + 1 as z1, min(y) as y0, max(y) + 1 as y1, min(x) as x0, max(x) + 1 as x1 from lab group by label order by n desc, label limit 1",
)(largest_component_report)
_query("open_ball_3", f"with {GRID}, er as (" + eroded("select z, y, x from grid where v >= 3", itk_ball(3, 3, 3), False) + ") " + dilated("select * from er", itk_ball(3, 3, 3)))(lambda s, d: _cells(morph.opening(_mask(s, d, 3), grid_volume(s), itk_ball(3, 3, 3))))
_query("erode_ball_5", f"with {VEC} " + eroded("select z, y, x from vec where z <> 12 or y <> 10 or x <> 30", itk_ball(5, 5, 5), False))(lambda s, d: _cells(morph.erode(vec(s, d).where("z <> 12 or y <> 10 or x <> 30"), vec_volume(s, d), itk_ball(5, 5, 5))))
_query(
    "most_similar_score",
    _with(_C17) + f", ref as ({_REF}), sc as (select label, cast(sum(case when ref.z is null then 0 else 1 end) as double) / (count(*) + (select count(*) from ref) - sum(case when ref.z is null then 0 else 1 end)) as iou from lab left join ref using (z, y, x) group by label) select label, round(iou, 9) as iou from sc where iou > 0 order by iou desc, label limit 1",
)(lambda s, d: comp.most_similar_with_score(_mask(s, d, 17), _mask(s, d, 15).where("z < 20"), grid_volume(s))[1].select("label", F.round("iou", 9).alias("iou")))

# ---- volumes that grow in number with the tables ----------------------------------------------------------------------

STACK = f"stack as ({STACK_SQL})"
_query("stack_dilate", f"with {STACK} select distinct volume_id, z + dz as z, y + dy as y, x + dx as x from (select * from stack where v >= 2) s, {_values([(0, 0, 0), *face()])} where z + dz between 0 and {NZ - 1} and y + dy between 0 and {NY - 1} and x + dx between 0 and {NX - 1}")(
    lambda s, d: morph.dilate(m.threshold(stack(s, d), 2), stack_volumes(s, d), [(0, 0, 0), *face()])
)
_query(
    "stack_components",
    f"with recursive {STACK}, cells as (select volume_id, cast(substr(volume_id, 2) as bigint) * {NZ * NY * NX} + (z * {NY} + y) * {NX} + x as id, z, y, x from stack where v >= 2), "
    "link as (select a.id as a, b.id as b from cells a join cells b on a.volume_id = b.volume_id and abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x) <= 1), "
    "t(r, id, l) as (select 0, id, id from cells union all select any_value(r) + 1, a, min(l) from t join link on b = id where r < 150 group by a) "
    f"select volume_id, l % {NZ * NY * NX} as label, count(*) as n from t join cells using (id) where r = 150 group by 1, 2",
)(lambda s, d: m.label_sizes(comp.label(m.threshold(stack(s, d), 2), stack_volumes(s, d), 6)))
assert len(full()) == 26
