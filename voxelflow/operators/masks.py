"""Voxel relations: projections, predicates, joins by position, set operations and aggregates.

An image is (volume_id, z, y, x, v); a mask is (volume_id, z, y, x), a cell without a row is outside; labels are
(volume_id, z, y, x, label). Everything is a plan of built-in expressions: positions join by equality on all four keys, and what
is computed for a volume is an aggregate that is combined before its shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

KEYS = ["volume_id", "z", "y", "x"]


# ---- predicates and maps --------------------------------------------------------------------------------------------


def threshold(image: DataFrame, lower: float | None = None, upper: float | None = None) -> DataFrame:
    """The mask of values from `lower` to `upper`, both included."""
    rows = image if lower is None else image.where(F.col("v") >= lower)
    return (rows if upper is None else rows.where(F.col("v") <= upper)).select(*KEYS)


def keep_band(image: DataFrame, lower: float, upper: float) -> DataFrame:
    """The image with values outside the band, both ends included, as 0."""
    return image.select(*KEYS, F.when(F.col("v").between(lower, upper), F.col("v")).otherwise(F.lit(0)).alias("v"))


def above_minimum(image: DataFrame, by_slice: bool = False) -> DataFrame:
    """The mask of values above the least of the volume, or of the slice; an even slice has none."""
    part = ["volume_id", "z"] if by_slice else ["volume_id"]
    least = image.groupBy(*part).agg(F.min("v").alias("least"))
    return image.join(least, part).where("v > least").select(*KEYS)


def bounded_reciprocal(image: DataFrame) -> DataFrame:
    """1 / (1 + v)."""
    return image.select(*KEYS, (1 / (1 + F.col("v").cast("double"))).alias("v"))


def arrival_mask(times: DataFrame, limit: float = 1000.0, highest: float = 10000.0) -> DataFrame:
    """Arrival times to reached values: v + 1 up to `limit` after clamping to [0, highest], else 0."""
    t = F.least(F.greatest(F.col("v").cast("double"), F.lit(0.0)), F.lit(highest))
    return times.select(*KEYS, F.when(t <= limit, t + 1).otherwise(0.0).alias("v"))


def _extremes(image: DataFrame) -> DataFrame:
    return image.join(image.groupBy("volume_id").agg(F.min("v").cast("double").alias("lo"), F.max("v").cast("double").alias("hi")), "volume_id")


def normalise(image: DataFrame, cut: float = 0.025) -> DataFrame:
    """(v - min) / (max - min) of the volume, values under `cut` as 0; an even volume is 0."""
    n = F.when(F.col("hi") > F.col("lo"), (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return _extremes(image).select(*KEYS, F.when(n < cut, 0.0).otherwise(n).alias("v"))


def rescale_bytes(image: DataFrame) -> DataFrame:
    """Values as integers 0 to 255, linear between the volume's extremes, rounded down; an even volume is 0."""
    n = F.when(F.col("hi") > F.col("lo"), (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return _extremes(image).select(*KEYS, F.floor(n * 255).cast("int").alias("v"))


def vesselness_speed(response: DataFrame, mask: DataFrame, low: float = 1e-3, high: float = 1.0, power: float = 2.0) -> DataFrame:
    """Speed that falls with the response: low + (high - low) * (1 - n) ** power, n = clipped v / max; `low` outside the mask.

    Values that are no finite numbers count as 0; without a positive maximum n is 0.
    """
    v = F.col("v").cast("double")
    clean = response.select(*KEYS, F.when(F.isnan(v) | v.isNull() | (F.abs(v) == float("inf")), 0.0).otherwise(v).alias("v"))
    top = clean.groupBy("volume_id").agg(F.max("v").alias("top"))
    n = F.when(F.col("top") > 0, F.least(F.greatest(F.col("v") / F.col("top"), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    inside = mask.select(*KEYS).withColumn("inside", F.lit(True))
    speed = F.when(F.col("inside"), low + (high - low) * F.pow(1 - n, F.lit(power))).otherwise(F.lit(low))
    return clean.join(top, "volume_id").join(inside, KEYS, "left").select(*KEYS, speed.alias("v"))


def recode(labels: DataFrame, codes: dict[int, int]) -> DataFrame:
    """Labels by a table; a label that isn't in it goes."""
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    return labels.where(F.col("label").isin(*codes)).select(*KEYS, table[F.col("label")].alias("label"))


def group_labels(labels: DataFrame, first: list[int]) -> DataFrame:
    """Label 1 for the labels in `first`, 2 for any other above 0."""
    return labels.where("label > 0").select(*KEYS, F.when(F.col("label").isin(*first), 1).otherwise(2).alias("label"))


def intervals(image: DataFrame, thresholds: list[float]) -> DataFrame:
    """Label i + 1 where thresholds[i] <= v < thresholds[i + 1]; 0 for the volume's least value and outside all intervals."""
    label = reduce(lambda out, i: F.when((F.col("v") >= thresholds[i]) & (F.col("v") < thresholds[i + 1]), i + 1).otherwise(out), range(len(thresholds) - 1), F.lit(0))
    least = image.groupBy("volume_id").agg(F.min("v").alias("least"))
    return image.join(least, "volume_id").select(*KEYS, F.when(F.col("v") == F.col("least"), 0).otherwise(label).alias("label"))


def gaussian_pdf(x: Column, mean: float, std: float) -> Column:
    return F.exp(-0.5 * F.pow((x - mean) / std, 2)) / (std * (2 * 3.141592653589793) ** 0.5)


# ---- joins and sets -------------------------------------------------------------------------------------------------


def masked(image: DataFrame, mask: DataFrame, outside: float | None = None) -> DataFrame:
    """The image within a mask; outside it nothing, or the value `outside`."""
    if outside is None:
        return image.join(mask.select(*KEYS), KEYS, "left_semi")
    inside = mask.select(*KEYS).withColumn("inside", F.lit(True))
    return image.join(inside, KEYS, "left").select(*KEYS, F.when(F.col("inside"), F.col("v")).otherwise(F.lit(outside)).alias("v"))


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """Values multiplied where both images have the cell."""
    return a.join(b.select(*KEYS, F.col("v").alias("w")), KEYS).select(*KEYS, (F.col("v") * F.col("w")).alias("v"))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*KEYS).join(b.select(*KEYS), KEYS, "left_semi")


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*KEYS).join(b.select(*KEYS), KEYS, "left_anti")


def union(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [p.select(*KEYS) for p in parts]).distinct()


def same_cells(a: DataFrame, b: DataFrame) -> DataFrame:
    """(volume_id, same): whether two masks have the same cells."""
    both = a.select(*KEYS).distinct().withColumn("side", F.lit(1)).unionByName(b.select(*KEYS).distinct().withColumn("side", F.lit(-1)))
    odd = both.groupBy(*KEYS).agg(F.sum("side").alias("s"))
    return odd.groupBy("volume_id").agg((F.max(F.abs("s")) == 0).alias("same"))


def lookup(mask: DataFrame, labels: DataFrame) -> DataFrame:
    """The labels of a mask's cells; a cell without one goes."""
    return mask.select(*KEYS).join(labels.select(*KEYS, "label"), KEYS)


# ---- aggregates -----------------------------------------------------------------------------------------------------


def histogram(image: DataFrame) -> DataFrame:
    """(volume_id, v, n)."""
    return image.groupBy("volume_id", "v").agg(F.count("*").alias("n"))


def label_statistics(image: DataFrame, labels: DataFrame) -> DataFrame:
    """(volume_id, label, n, least, greatest, mean) of the values under each label."""
    under = image.join(labels.select(*KEYS, "label"), KEYS)
    return under.groupBy("volume_id", "label").agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("greatest"), F.avg("v").alias("mean"))


def label_sizes(labels: DataFrame, volumes: DataFrame | None = None) -> DataFrame:
    """(volume_id, label, n), with the size in units of space if the volumes' spacing is given."""
    sizes = labels.groupBy("volume_id", "label").agg(F.count("*").alias("n"))
    if volumes is None:
        return sizes
    return sizes.join(volumes, "volume_id").select("volume_id", "label", "n", (F.col("n") * F.col("sz") * F.col("sy") * F.col("sx")).alias("size"))


def modal_label(labels: DataFrame, mask: DataFrame) -> DataFrame:
    """(volume_id, label) of the label that most cells of the mask have; of several the smallest."""
    counts = lookup(mask, labels).groupBy("volume_id", "label").agg(F.count("*").alias("n"))
    return counts.groupBy("volume_id").agg(F.min(F.struct(-F.col("n"), "label")).alias("m")).select("volume_id", "m.label")


def outside_counts(labels: DataFrame, mask: DataFrame) -> DataFrame:
    """(volume_id, label, outside): how many of a label's cells aren't in the mask."""
    inside = mask.select(*KEYS).withColumn("inside", F.lit(1))
    return labels.join(inside, KEYS, "left").groupBy("volume_id", "label").agg(F.sum(F.when(F.col("inside").isNull(), 1).otherwise(0)).alias("outside"))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(volume_id, iou, dice) of two masks; both 0 where both are empty."""
    sides = a.select(*KEYS).withColumns({"a": F.lit(1), "b": F.lit(0)}).unionByName(b.select(*KEYS).withColumns({"a": F.lit(0), "b": F.lit(1)}))
    cells = sides.groupBy(*KEYS).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    sums = cells.groupBy("volume_id").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum(F.col("a") * F.col("b")).alias("both"), F.count("*").alias("n"))
    return sums.select("volume_id", (F.col("both") / F.col("n")).alias("iou"), (2 * F.col("both") / (F.col("a") + F.col("b"))).alias("dice"))


def overlap_by_label(labels: DataFrame, mask: DataFrame) -> DataFrame:
    """(volume_id, label, iou) of every label's cells with the mask: one join for all labels."""
    inside = mask.select(*KEYS).withColumn("inside", F.lit(1))
    per = labels.join(inside, KEYS, "left").groupBy("volume_id", "label").agg(F.count("*").alias("n"), F.sum(F.coalesce("inside", F.lit(0))).alias("both"))
    total = mask.groupBy("volume_id").agg(F.count("*").alias("m"))
    return per.join(total, "volume_id").select("volume_id", "label", (F.col("both") / (F.col("n") + F.col("m") - F.col("both"))).alias("iou"))


def bounding_box(labels: DataFrame, volumes: DataFrame, padding: int = 5) -> DataFrame:
    """(volume_id, label, z0, z1, y0, y1, x0, x1): each label's cells with padding, clipped to the volume; ends are exclusive."""
    ends = [f(a).alias(f"{a}{i}") for a in "zyx" for i, f in enumerate((F.min, F.max))]
    found = labels.groupBy("volume_id", "label").agg(*ends).join(volumes, "volume_id")
    cuts = [c for a in "zyx" for c in (F.greatest(F.col(f"{a}0") - padding, F.lit(0)).alias(f"{a}0"), F.least(F.col(f"{a}1") + padding + 1, F.col(f"n{a}")).alias(f"{a}1"))]
    return found.select("volume_id", "label", *cuts)


def spread(cells: DataFrame, by: list[str]) -> DataFrame:
    """By group: centre and variance along each axis, and the axis of least variance (0 z, 1 y, 2 x; of several the first)."""
    out = cells.groupBy(*by).agg(*[F.avg(a).alias(f"c{a}") for a in "zyx"], *[F.var_pop(a).alias(f"var_{a}") for a in "zyx"])
    flat = F.when((F.col("var_z") <= F.col("var_y")) & (F.col("var_z") <= F.col("var_x")), 0).when(F.col("var_y") <= F.col("var_x"), 1).otherwise(2)
    return out.withColumn("flat_axis", flat)


def best_label(scores: DataFrame, score: str, last: bool = False) -> DataFrame:
    """(volume_id, label) with the highest score; of several the smallest label, or the largest if `last`."""
    order = Window.partitionBy("volume_id").orderBy(F.col(score).desc(), F.col("label").desc() if last else F.col("label").asc())
    return scores.withColumn("rn", F.row_number().over(order)).where("rn = 1").select("volume_id", "label")


def with_label(labels: DataFrame, chosen: DataFrame) -> DataFrame:
    """The mask of the labels chosen by (volume_id, label)."""
    return labels.join(chosen.select("volume_id", "label"), ["volume_id", "label"], "left_semi").select(*KEYS)
