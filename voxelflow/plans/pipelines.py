"""The composite pipelines: lungs, lobes, mediastinum, trachea, airways, vessels, and the model of an airway tree.

Lung and lobe regions are an input relation (volume_id, z, y, x, label); a plug-in may make them. Every function takes tables of
any number of volumes and returns masks (volume_id, z, y, x).
"""

from __future__ import annotations

import logging
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.offsets import itk_ball
from ..operators import components as comp, masks as m, morphology as morph, stencils
from ..operators.branches import fill_gap, smooth_branch
from ..operators.fronts import fast_march
from ..operators.graphs import edge_thickness, largest_graph, nearest_edge, node_order, tree
from ..operators.hulls import body_hull, hull_by_slice
from ..operators.mixture import thresholds as mixture_thresholds
from ..operators.skeletons import PATHS, path_graph, path_skeleton, skeleton_graph, thin
from ..operators.slabs import boxed, by_volume
from ..session import stored
from ..sources.nrrd import coerce, write_nrrd

log = logging.getLogger(__name__)
KEYS = m.KEYS
#: Names of the lobes, upper left first, in the order of their labels 1 to 5.
LOBES = ("lung_upper_lobe_left", "lung_lower_lobe_left", "lung_upper_lobe_right", "lung_middle_lobe_right", "lung_lower_lobe_right")
#: Intensity of air, the greatest that seeds may have; what stands outside a body, and outside the mediastinum.
AIR, OUTSIDE_BODY, OUTSIDE_MEDIASTINUM = -700.0, 8000.0, -1024.0
#: Nodes of a skeleton above which the tree of shortest paths is taken, and closing radius per thickness.
NODES, CLOSING = 211, 2.0


def lungs(regions: DataFrame, binary: bool = True, plug_in: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The mask of any lobe, or labels 1 left and 2 right. regions: lobe labels 1 to 5, or what a plug-in makes them from."""
    regions = plug_in(regions) if plug_in else regions
    return regions.where("label > 0").select(*KEYS) if binary else m.group_labels(regions, [1, 2])


def lobes(regions: DataFrame, codes: dict[int, int]) -> DataFrame:
    """Lobe labels 1 to 5 from the regions' own codes."""
    return m.recode(regions, codes)


def mediastinum(lung_mask: DataFrame, volumes: DataFrame, image: DataFrame | None = None) -> DataFrame:
    """What the slices' hulls of the closed lungs hold besides them, opened by a ball of radius 3; or the image there, -1024 outside."""
    closed = stored(morph.closing(lung_mask, volumes, itk_ball(1, 1, 1)))
    between = m.minus(hull_by_slice(closed), closed)
    mask = morph.opening(between, volumes, itk_ball(3, 3, 3))
    return mask if image is None else m.masked(image, mask, OUTSIDE_MEDIASTINUM)


def trachea(image: DataFrame, lung_mask: DataFrame, volumes: DataFrame) -> DataFrame:
    """The largest piece of air in the mediastinum: values from the least to a third of it, eroded slice by slice. Empty without air."""
    inside = stored(m.masked(image, mediastinum(lung_mask, volumes)))
    least = inside.groupBy("volume_id").agg(F.min("v").alias("least")).where("least < 0")
    air = inside.join(least, "volume_id").where((F.col("v") >= F.col("least")) & (F.col("v") <= F.floor(F.col("least") / 3))).select(*KEYS)
    return comp.largest_component(morph.erode_by_slice(air, volumes), volumes, 26, last=True)


def _cuts(image: DataFrame, lung_mask: DataFrame, volumes: DataFrame, thresholds: list[float] | None) -> DataFrame:
    """(volume_id, air, tissue): the second and third threshold, of all volumes or by a mixture fitted to each one's lungs."""
    if thresholds is not None:
        return volumes.select("volume_id", F.lit(float(thresholds[1])).alias("air"), F.lit(float(thresholds[2])).alias("tissue"))
    rows = mixture_thresholds(m.masked(image, lung_mask))
    return rows.groupBy("volume_id").agg(*[F.max(F.when(F.col("i") == i, F.col("threshold"))).alias(n) for i, n in ((1, "air"), (2, "tissue"))])


def airways(image: DataFrame, lung_labels: DataFrame, volumes: DataFrame, thresholds: list[float] | None = None) -> dict[str, DataFrame]:
    """airways, walls, trachea and walls_filled of any number of volumes. lung_labels: a mask, or labels 1 left and 2 right.

    thresholds: four, for all volumes; by default those of a mixture fitted to each volume. A volume without air in its trachea gives nothing; if
    all are, that is an error.
    """
    lung_labels = lung_labels if "label" in lung_labels.columns else lung_labels.withColumn("label", F.lit(1))
    lung_mask = lung_labels.select(*KEYS)
    cuts = stored(_cuts(image, lung_mask, volumes, thresholds))
    pipe = stored(trachea(image, lung_mask, volumes))
    hull = stored(body_hull(lung_mask, volumes))
    body = m.masked(image, hull, OUTSIDE_BODY)
    tissue = stored(body.join(cuts, "volume_id").where("v >= tissue").select(*KEYS))  # all outside the hull, too
    scaffold = stored(comp.largest_component(m.minus(hull, tissue), volumes))
    ones = scaffold.withColumn("v", F.lit(1.0))
    first = m.masked(m.bounded_reciprocal(stencils.gradient_magnitude(ones, volumes)), scaffold)
    second = stencils.tubeness(ones, volumes)
    core = morph.erode(hull, volumes, itk_ball(5, 5, 5))
    speed = stored(m.masked(m.product(first, second), core).where("v > 0"))

    smooth = stored(stencils.curvature_diffusion(m.masked(image, scaffold, OUTSIDE_BODY), volumes))
    air = m.masked(smooth, pipe).join(cuts, "volume_id").where(F.col("v") < F.least(F.lit(AIR), "air")).groupBy("volume_id").agg(F.avg("v").cast("int").alias("mean"))
    limits = stored(m.masked(image, lung_mask).groupBy("volume_id").agg(F.min("v").cast("int").alias("lowest")).join(air, "volume_id"))
    log.info("trachea, hull and scaffold are stored; limits of seeds are known")
    if limits.isEmpty():
        raise ValueError("no air in the trachea")
    seeds = smooth.join(limits, "volume_id").where("v >= lowest and v <= mean and v < 0").select(*KEYS)
    reached = fast_march(speed, m.intersect(seeds, speed), volumes, 10.0).select(*KEYS)
    found = stored(comp.most_similar_component(reached, pipe, volumes))
    clean = comp.without_leaks(found, lung_mask, pipe, volumes)
    wide = morph.constrained_dilation(clean, lung_labels, volumes, itk_ball(3, 3, 3))
    walls = stored(m.intersect(wide, tissue))
    filled = stored(morph.fill_holes_by_slice(morph.closing(walls, volumes, itk_ball(6, 6, 3)), volumes))
    return {"airways": m.intersect(m.minus(filled, walls), found), "walls": walls, "trachea": pipe, "walls_filled": filled}


def vessels(image: DataFrame, lung_labels: DataFrame, volumes: DataFrame, lobe_labels: DataFrame | None = None, middle: DataFrame | None = None, binary: bool = True) -> DataFrame:
    """Vessels in the lungs without what a front from their blobs reaches beyond them; by lobe label unless `binary`."""
    lung_mask = lung_labels.select(*KEYS)
    mask, response = stencils.vesselness(image, lung_mask, volumes)
    mask = stored(mask)
    speed = m.vesselness_speed(response, lung_mask)
    middle = mediastinum(lung_mask, volumes) if middle is None else middle
    lobe_labels = lung_mask.withColumn("label", F.lit(1)) if lobe_labels is None else lobe_labels
    found = stored(m.intersect(m.lookup(m.union(middle, mask), lobe_labels.where("label > 0")), lung_mask))
    seeds = morph.closing(stencils.blobs(found.withColumn("v", F.lit(1.0)), found, volumes, 1.0, 12.0, 10), volumes, itk_ball(3, 3, 3))
    front = stored(fast_march(speed, m.intersect(seeds, speed), volumes, 1.0).select(*KEYS))
    kept = m.minus(found, comp.reaching_outside(front, found, volumes))
    return kept if binary else m.lookup(kept, lobe_labels)


def thinned(mask: DataFrame, volumes: DataFrame) -> DataFrame:
    """A mask thinned to lines. A volume's mask, in its bounding box, is one task."""

    def kernel(rows: pd.DataFrame, info: dict) -> pd.DataFrame:
        array, low = boxed(rows)
        at = np.argwhere(thin(array)) + low
        return pd.DataFrame({"volume_id": info["volume_id"], **{a: at[:, i].astype(np.int32) for i, a in enumerate("zyx")}})

    return by_volume(mask.select(*KEYS), volumes, kernel, "volume_id string, z int, y int, x int")


def skeleton(mask: DataFrame, volumes: DataFrame) -> DataFrame:
    """The lines of a mask: thinned, holes of that filled, and the clumps that filling leaves taken away again."""
    return without_clumps(stored(thinned(mask, volumes)), volumes)


def without_clumps(lines: DataFrame, volumes: DataFrame) -> DataFrame:
    """A mask with its holes filled, less what an opening by a ball of radius 1 keeps of that."""
    filled = stored(morph.fill_holes(lines, volumes, 6))
    return m.minus(filled, morph.opening(filled, volumes, itk_ball(1, 1, 1)))


def path_preparation(mask: DataFrame, volumes: DataFrame) -> DataFrame:
    """What the tree of shortest paths is found in: holes filled by all 26 neighbours, parts of at most 50 cells dropped if there are several."""
    return comp.drop_small(morph.fill_holes(mask, volumes, 26), volumes, 50)


_GRAPH = "graph_id string, node_id int, z int, y int, x int, src int, dst int, line array<int>"


def _tables(nodes, edges, low: np.ndarray, graph_id: str) -> pd.DataFrame:
    out = [(graph_id, i, *map(int, p + low), -1, -1, []) for i, p in enumerate(nodes)]
    out += [(graph_id, -1, 0, 0, 0, i, j, (line + low).ravel().tolist()) for i, j, line in edges]
    return pd.DataFrame(out, columns=["graph_id", "node_id", "z", "y", "x", "src", "dst", "line"])


def line_graph(lines: DataFrame, volumes: DataFrame, ends_at_nodes: bool = True) -> DataFrame:
    """Nodes and edges of thin masks in one table; an edge has node_id -1."""

    def kernel(rows: pd.DataFrame, info: dict) -> pd.DataFrame:
        array, low = boxed(rows)
        return _tables(*skeleton_graph(array, ends_at_nodes), low, info["volume_id"])

    return by_volume(lines.select(*KEYS), volumes, kernel, _GRAPH)


def path_graphs(mask: DataFrame, volumes: DataFrame, detail: str = "fine") -> DataFrame:
    """As `line_graph`, of the tree of shortest paths; of the parts that of most points. Too few points with "fine" are tried again."""

    def kernel(rows: pd.DataFrame, info: dict) -> pd.DataFrame:
        array, low = boxed(rows)
        found = path_graph(path_skeleton(array, **PATHS[detail]))
        if detail == "fine" and len(found[0]) < min(3000, len(rows) // 500):
            found = path_graph(path_skeleton(array, **PATHS["retry"]))
        return _tables(*found, low, info["volume_id"])

    return by_volume(path_preparation(mask, volumes), volumes, kernel, _GRAPH)


def clean_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The largest connected part of each graph, and of its edges those of the breadth-first tree from the node of greatest z."""
    kept = stored(largest_graph(nodes, edges))
    nodes = nodes.join(kept, ["graph_id", "node_id"], "left_semi")
    edges = edges.join(kept.withColumnRenamed("node_id", "src"), ["graph_id", "src"], "left_semi")
    way = tree(nodes, edges)
    both = way.unionByName(way.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst")))
    return nodes, edges.join(both, ["graph_id", "src", "dst"], "left_semi")


def _split(both: DataFrame) -> tuple[DataFrame, DataFrame]:
    return both.where("node_id >= 0").select("graph_id", "node_id", "z", "y", "x"), both.where("src >= 0").select("graph_id", "src", "dst", "line")


def skeleton_tables(mask: DataFrame, volumes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """node (graph_id, node_id, z, y, x) and edge (graph_id, src, dst, line) of each volume's skeleton; line: points as z, y, x in turn.

    The mask's largest part is thinned, and the graph of that is cleaned. Where it has more than NODES nodes, the tree of shortest
    paths of the mask is taken instead.
    """
    nodes, edges = _split(stored(line_graph(skeleton(comp.largest_component(mask, volumes), volumes), volumes)))
    nodes, edges = (stored(x) for x in clean_graph(nodes, edges))
    wide = stored(nodes.groupBy("graph_id").agg(F.count("*").alias("n")).where(F.col("n") > NODES).select(F.col("graph_id").alias("volume_id")))
    if wide.isEmpty():
        return nodes, edges
    paths = _split(stored(path_graphs(mask.join(wide, "volume_id", "left_semi"), volumes)))
    few = wide.withColumnRenamed("volume_id", "graph_id")
    kept = stored(largest_graph(*paths))
    paths = paths[0].join(kept, ["graph_id", "node_id"], "left_semi"), paths[1].join(kept.withColumnRenamed("node_id", "src"), ["graph_id", "src"], "left_semi")
    return tuple(stored(x.join(few, "graph_id", "left_anti").unionByName(y)) for x, y in zip((nodes, edges), paths, strict=True))


def top_node(mask: DataFrame, volumes: DataFrame) -> DataFrame:
    """(volume_id, z, y, x) of the skeleton's node with the greatest z of each volume's mask; of several the first."""
    nodes, _ = _split(line_graph(skeleton(mask, volumes), volumes, False))
    best = nodes.groupBy("graph_id").agg(F.min(F.struct((-F.abs("z")).alias("up"), "node_id", "z", "y", "x")).alias("m"))
    return best.select(F.col("graph_id").alias("volume_id"), "m.z", "m.y", "m.x")


def _oriented(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(volume_id, edge_id, src, dst, line) of the tree's edges, lines from parent to child."""
    way = tree(nodes, edges)
    there = edges.select("graph_id", "src", "dst", "line")
    triples = F.flatten(F.reverse(F.transform(F.sequence(F.lit(0), F.size("line") - 1, F.lit(3)), lambda i: F.slice("line", i + 1, 3))))
    back = edges.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"), triples.alias("line"))
    lines = there.unionByName(back).groupBy("graph_id", "src", "dst").agg(F.min("line").alias("line"))
    joined = way.join(lines, ["graph_id", "src", "dst"])
    number = F.row_number().over(Window.partitionBy("graph_id").orderBy("src", "dst"))
    return joined.withColumn("edge_id", number).withColumnRenamed("graph_id", "volume_id")


def _points(edges: DataFrame) -> DataFrame:
    """(volume_id, edge_id, z, y, x) of the edges' lines."""
    at = F.explode(F.sequence(F.lit(0), F.size("line") - 1, F.lit(3)))
    rows = edges.select("volume_id", "edge_id", "line", at.alias("i"))
    return rows.select("volume_id", "edge_id", *[F.element_at("line", F.col("i") + k + 1).alias(a) for k, a in enumerate("zyx")])


def _closed(labels: DataFrame, sizes: DataFrame, volumes: DataFrame) -> DataFrame:
    """Every branch closed by a ball of its own radius, twice its size to one decimal, and all of them together."""
    radius = F.bround(F.col("size") * CLOSING, 1)
    by_radius = stored(labels.join(sizes.select("volume_id", "edge_id", radius.alias("radius")), ["volume_id", "edge_id"]))
    wide = by_radius.where("radius >= 1").select("edge_id", *KEYS, F.col("radius").cast("double").alias("radius"))
    return by_radius.select(*KEYS).unionByName(morph.closing_by_ball(wide, "edge_id", volumes)).distinct()


def _modelled(key: tuple, cells: pd.DataFrame, line: pd.DataFrame) -> pd.DataFrame:
    """Cells, all points at both ends, and the thickness of one smoothed branch. One that others leave no cell has those at its ends."""
    names = ["volume_id", "edge_id", "kind", "z", "y", "x", "value"]
    if not len(line):
        return pd.DataFrame(columns=names)
    path = np.array(line["line"].iloc[0], float).reshape(-1, 3)
    mine = np.concatenate([cells[list("zyx")].to_numpy(np.int64), np.rint(path[[0, -1]]).astype(np.int64)])
    kept, ends, gaps, thickness = smooth_branch(np.unique(mine, axis=0), path)
    kept = np.concatenate([kept, *[fill_gap(g) for g in gaps]])
    rows = [(*key, "cell", *map(float, c), 0.0) for c in np.unique(kept, axis=0)]
    rows += [(*key, kind, *map(float, p), 0.0) for kind, base in zip(("first", "last"), ends, strict=True) for p in base]
    rows.append((*key, "thickness", 0.0, 0.0, 0.0, thickness))
    return pd.DataFrame(rows, columns=names)


def model_tree(rough: DataFrame, airway_mask: DataFrame, volumes: DataFrame) -> DataFrame:
    """The modelled airway tree: branches smoothed by frustums, gaps between them filled, connected airways added, branches closed."""
    nodes, edges = skeleton_tables(rough, volumes)
    edges = stored(_oriented(edges, nodes))
    points = _points(edges)
    labels = nearest_edge(rough, points)

    made = stored(labels.groupBy("volume_id", "edge_id").cogroup(edges.select("volume_id", "edge_id", "line").groupBy("volume_id", "edge_id")).applyInPandas(_modelled, "volume_id string, edge_id int, kind string, z double, y double, x double, value double"))
    whole = [F.col(a).cast("int").alias(a) for a in "zyx"]
    cells = made.where("kind = 'cell'").select("volume_id", *whole)

    # the last base of a branch and the first one of each that goes on from it
    base = lambda kind, node: made.where(F.col("kind") == kind).join(edges.select("volume_id", "edge_id", F.col(node).alias("node")), ["volume_id", "edge_id"])
    after = base("first", "src").select("volume_id", "node", F.col("edge_id").alias("child"), "z", "y", "x")
    children = after.select("volume_id", "node", "child").distinct()
    before = base("last", "dst").join(children, ["volume_id", "node"]).select("volume_id", "node", "child", "z", "y", "x")

    def gap(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = fill_gap(rows[list("zyx")].to_numpy(float))
        return pd.DataFrame({"volume_id": key[0], **{a: found[:, i].astype(np.int32) for i, a in enumerate("zyx")}})

    gaps = before.unionByName(after.join(before.select("volume_id", "child").distinct(), ["volume_id", "child"], "left_semi")).groupBy("volume_id", "child").applyInPandas(gap, "volume_id string, z int, y int, x int")
    modelled = stored(morph.within(cells.unionByName(gaps).distinct(), volumes))
    modelled = comp.touching_components(airway_mask, modelled, volumes)

    thick = made.where("kind = 'thickness'").join(edges.select("volume_id", "edge_id", "dst"), ["volume_id", "edge_id"]).select(F.col("volume_id").alias("graph_id"), F.col("dst").alias("node_id"), F.col("value").alias("thickness"))
    sizes = edge_thickness(edges.select(F.col("volume_id").alias("graph_id"), "src", "dst"), node_order(nodes, edges.withColumnRenamed("volume_id", "graph_id")), thick)
    sizes = sizes.withColumnRenamed("graph_id", "volume_id").join(edges.select("volume_id", "src", "dst", "edge_id"), ["volume_id", "src", "dst"])
    return _closed(stored(nearest_edge(stored(modelled), points)), sizes, volumes)


def smooth_tree(rough: DataFrame, airway_mask: DataFrame, volumes: DataFrame) -> DataFrame:
    """The modelled tree within the rough mask."""
    rough = stored(rough.select(*KEYS))
    return m.intersect(model_tree(rough, airway_mask, volumes), rough)


def run(spark: SparkSession, image: str | DataFrame, volumes: DataFrame, lung_labels: str | DataFrame | None = None, path: str | tuple[str, str] | None = None, plug_in: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Airways of an image given as a path or a table. Without lung labels a plug-in makes them from the image.

    path: a folder, below which airways and filled walls are written as Parquet; or two folders, one for each, that get NRRD files with the
    geometry of `volumes`.
    """
    cells = coerce(spark, image)
    regions = coerce(spark, lung_labels)
    if regions is None:
        if plug_in is None:
            raise ValueError("neither lung labels nor a plug-in")
        regions = stored(lungs(cells, binary=False, plug_in=plug_in))
    out = airways(cells, regions, volumes)
    if isinstance(path, str):
        out["airways"].write.mode("overwrite").parquet(f"{path}/airways")
        out["walls_filled"].write.mode("overwrite").parquet(f"{path}/walls_filled")
    elif path:
        for name, folder in zip(("airways", "walls_filled"), path, strict=True):
            write_nrrd(out[name], volumes, folder, "uint8")
    return out["airways"]
