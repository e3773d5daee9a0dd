"""Connected components of masks, and what is chosen by component.

A component's label is its smallest linear index (z * ny + y) * nx + x. Slabs of slices are labelled by themselves in numpy;
labels that touch across a seam make a small link table, whose components are found by joins; labels are then replaced by the
smallest of their component. A volume of one slab has no seams and no iteration. Connectivity 4 or 8 goes slice by slice and
never has seams.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.offsets import neighbours
from ..session import settled, stored
from .masks import KEYS, best_label, label_sizes, lookup, minus, modal_label, outside_counts, overlap_by_label, union, with_label
from .slabs import DEPTH


def local_labels(z: np.ndarray, y: np.ndarray, x: np.ndarray, ny: int, nx: int, connectivity: int) -> np.ndarray:
    """Labels of cells in one array: links between neighbours, then the smallest label is passed on until nothing changes."""
    z, y, x = (a.astype(np.int64) for a in (z, y, x))
    index = (z * (ny + 2) + y + 1) * (nx + 2) + x + 1  # a margin keeps neighbours beyond a border apart
    order = np.argsort(index)
    ranked = index[order]
    pairs = []
    for dz, dy, dx in neighbours(connectivity):
        if (dz, dy, dx) > (0, 0, 0):
            wanted = ranked + (dz * (ny + 2) + dy) * (nx + 2) + dx
            at = np.minimum(np.searchsorted(ranked, wanted), len(ranked) - 1)
            found = np.flatnonzero(ranked[at] == wanted)
            pairs.append(np.stack([found, at[found]]))
    a, b = np.concatenate(pairs, axis=1)
    top = np.arange(len(ranked))
    while True:
        low = np.minimum(top[a], top[b])
        new = top.copy()
        np.minimum.at(new, top[a], low)
        np.minimum.at(new, top[b], low)
        while (jump := new[new]).tobytes() != new.tobytes():
            new = jump
        if (new == top).all():
            break
        top = new
    out = np.empty(len(ranked), np.int64)
    out[order] = top
    linear = (z * ny + y) * nx + x
    return linear[order][out]


def label_roots(links: DataFrame) -> DataFrame:
    """(volume_id, node, root) of links (volume_id, a, b): the smallest label passed along links, with a jump to the root's root."""
    both = settled(links.select("volume_id", "a", "b").unionByName(links.select("volume_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = both.groupBy("volume_id", F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root"))
    before = None
    while True:
        roots = settled(roots)
        now = roots.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
        if now == before:
            return roots
        before = now
        step = both.join(roots.withColumnRenamed("node", "b"), ["volume_id", "b"]).select("volume_id", F.col("a").alias("node"), "root").unionByName(roots)
        step = step.groupBy("volume_id", "node").agg(F.min("root").alias("root"))
        jump = roots.select("volume_id", F.col("node").alias("root"), F.col("root").alias("next"))
        roots = step.join(jump, ["volume_id", "root"], "left").select("volume_id", "node", F.least("root", F.coalesce("next", "root")).alias("root"))


def seam_links(local: DataFrame, connectivity: int, depth: int = DEPTH) -> DataFrame:
    """(volume_id, a, b) of labels of slabs that touch across a seam, a in the upper slab. local: (volume_id, z, y, x, label) of seam slices at least."""
    down = local.where(F.col("z") % depth == 0).where("z > 0").select("volume_id", "z", "y", "x", F.col("label").alias("b"))
    steps = F.array(*[F.struct(F.lit(y).alias("dy"), F.lit(x).alias("dx")) for z, y, x in neighbours(connectivity) if z == 1])
    up = local.where(F.col("z") % depth == depth - 1).select("volume_id", "z", "y", "x", "label", F.inline(steps))
    up = up.select("volume_id", (F.col("z") + 1).alias("z"), (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"), F.col("label").alias("a"))
    return up.join(down, KEYS).select("volume_id", "a", "b").distinct()


def label(mask: DataFrame, volumes: DataFrame, connectivity: int = 6, depth: int = DEPTH) -> DataFrame:
    """(volume_id, z, y, x, label) of the mask's cells."""
    flat = connectivity in (4, 8)
    sides = volumes.select("volume_id", "ny", "nx")
    cells = mask.select(*KEYS).join(sides, "volume_id").withColumn("slab", F.col("z") if flat else F.floor(F.col("z") / depth).cast("int"))

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        z, y, x = (rows[a].to_numpy() for a in "zyx")
        return rows[KEYS].assign(label=local_labels(z, y, x, int(rows["ny"].iloc[0]), int(rows["nx"].iloc[0]), connectivity))

    local = cells.groupBy("volume_id", "slab").applyInPandas(kernel, "volume_id string, z int, y int, x int, label long")
    if flat or volumes.agg(F.max("nz")).first()[0] <= depth:
        return local
    local = stored(local)
    links = stored(seam_links(local, connectivity, depth))
    if links.isEmpty():
        return local
    roots = label_roots(links).withColumnRenamed("node", "label")
    return local.join(roots, ["volume_id", "label"], "left").select(*KEYS, F.coalesce("root", "label").alias("label"))


def components_by_size(mask: DataFrame, volumes: DataFrame, connectivity: int = 26) -> DataFrame:
    """(volume_id, label, n)."""
    return label_sizes(label(mask, volumes, connectivity))


def largest_component(mask: DataFrame, volumes: DataFrame, connectivity: int = 6, last: bool = False) -> DataFrame:
    """The cells of each volume's largest component; of several the one with the smallest label, or the largest if `last`."""
    labels = stored(label(mask, volumes, connectivity))
    return with_label(labels, best_label(label_sizes(labels), "n", last))


def most_similar_component(mask: DataFrame, reference: DataFrame, volumes: DataFrame) -> DataFrame:
    """The cells of the component with the highest intersection over union with the reference; none if none overlaps."""
    return most_similar_with_score(mask, reference, volumes)[0]


def most_similar_with_score(mask: DataFrame, reference: DataFrame, volumes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cells of the most similar component, and (volume_id, label, iou) of it."""
    labels = stored(label(mask, volumes, 6))
    scores = stored(overlap_by_label(labels, reference).where("iou > 0"))
    best = stored(best_label(scores, "iou"))
    return with_label(labels, best), scores.join(best, ["volume_id", "label"], "left_semi")


def drop_small(mask: DataFrame, volumes: DataFrame, least: int = 50, connectivity: int = 6) -> DataFrame:
    """The components of more than `least` cells; a single component stays, whatever its size."""
    labels = stored(label(mask, volumes, connectivity))
    sizes = label_sizes(labels)
    single = sizes.groupBy("volume_id").agg(F.count("*").alias("k")).where("k = 1").select("volume_id")
    kept = sizes.where(F.col("n") > least).unionByName(sizes.join(single, "volume_id", "left_semi")).distinct()
    return with_label(labels, kept)


def touching_components(candidates: DataFrame, mask: DataFrame, volumes: DataFrame) -> DataFrame:
    """The mask and every component of the candidates that has a cell in it."""
    labels = stored(label(candidates, volumes, 6))
    return union(mask, with_label(labels, lookup(mask, labels).select("volume_id", "label").distinct()))


def reaching_outside(mask: DataFrame, region: DataFrame, volumes: DataFrame) -> DataFrame:
    """The components of the mask with a cell outside the region."""
    labels = stored(label(mask, volumes, 6))
    return with_label(labels, outside_counts(labels, region).where("outside > 0"))


def without_leaks(airways: DataFrame, lungs: DataFrame, trachea: DataFrame, volumes: DataFrame) -> DataFrame:
    """Airways in the lungs, and of those outside the ones that hang together with the trachea.

    Trachea and airways outside the lungs are labelled together; the label that most cells of the trachea have stays.
    """
    inside = airways.select(*KEYS).join(lungs.select(*KEYS), KEYS, "left_semi")
    outside = minus(airways, lungs)
    labels = stored(label(union(trachea, outside), volumes, 6))
    main = with_label(labels, modal_label(labels, trachea))
    return union(inside, outside.join(main, KEYS, "left_semi"))
