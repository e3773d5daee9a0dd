"""Thresholds between the normal components of a volume's values, fitted to its histogram."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geometry import gauss_crossings
from .masks import KEYS, histogram, intervals, masked

#: Components, and the value above which nothing enters the fit.
COMPONENTS, HIGHEST = 3, 500


def fit_histogram(values: np.ndarray, counts: np.ndarray, k: int = COMPONENTS, rounds: int = 100, tol: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, weights and standard deviations by mean, by expectation and maximisation from equal parts of the sorted values."""
    order = np.argsort(values)
    v, n = np.asarray(values, float)[order], np.asarray(counts, float)[order]
    part = np.minimum(((np.cumsum(n) - n / 2) / n.sum() * k).astype(int), k - 1)
    r = np.eye(k)[part]
    before = -np.inf
    for _ in range(rounds):
        size = (n[:, None] * r).sum(axis=0) + 1e-12
        mean = (n[:, None] * r * v[:, None]).sum(axis=0) / size
        var = (n[:, None] * r * (v[:, None] - mean) ** 2).sum(axis=0) / size + 1e-6
        weight = size / size.sum()
        log = np.log(weight) - 0.5 * np.log(2 * np.pi * var) - (v[:, None] - mean) ** 2 / (2 * var)
        top = log.max(axis=1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(log - top).sum(axis=1))
        r = np.exp(log - total[:, None])
        now = float((n * total).sum() / n.sum())
        if abs(now - before) < tol:
            break
        before = now
    order = np.argsort(mean)
    return mean[order], weight[order], np.sqrt(var[order])


def mixture(image: DataFrame, k: int = COMPONENTS, highest: float = HIGHEST) -> DataFrame:
    """(volume_id, i, mean, weight, std): components by mean. The volume's least value and values above `highest` stay out.

    Only counts by value are gathered, a volume's in one task: as many rows as there are different values.
    """
    least = image.groupBy("volume_id").agg(F.min("v").alias("least"))
    counts = histogram(image).join(least, "volume_id").where((F.col("v") > F.col("least")) & (F.col("v") <= highest)).drop("least")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        mean, weight, std = fit_histogram(rows["v"].to_numpy(), rows["n"].to_numpy(), k)
        return pd.DataFrame({"volume_id": rows["volume_id"].iloc[0], "i": np.arange(len(mean), dtype=np.int32), "mean": mean, "weight": weight, "std": std})

    return counts.groupBy("volume_id").applyInPandas(run, "volume_id string, i int, mean double, weight double, std double")


def crossing(m1: Column, m2: Column, s1: Column, s2: Column, highest: Column) -> Column:
    """The greater crossing of two densities if it is below `highest`, else the smaller."""
    low, high = gauss_crossings(m1, m2, s1, s2)
    return F.when(high < highest, high).otherwise(low)


def thresholds(image: DataFrame, k: int = COMPONENTS, highest: float = HIGHEST) -> DataFrame:
    """(volume_id, i, threshold): the least value - 1, the crossings of neighbouring components, and the greatest value + 1."""
    span = image.groupBy("volume_id").agg(F.min("v").cast("double").alias("lo"), F.max("v").cast("double").alias("hi"), F.max(F.when(F.col("v") <= highest, F.col("v"))).cast("double").alias("top"))
    order = Window.partitionBy("volume_id").orderBy("i")
    ahead = [F.lead(c).over(order).alias(f"{c}2") for c in ("mean", "std")]
    pairs = mixture(image, k, highest).select("*", *ahead).where("mean2 is not null").join(span, "volume_id")
    middle = pairs.select("volume_id", (F.col("i") + 1).alias("i"), crossing(F.col("mean"), F.col("mean2"), F.col("std"), F.col("std2"), F.col("top")).alias("threshold"))
    ends = span.select("volume_id", F.inline(F.array(F.struct(F.lit(0).alias("i"), (F.col("lo") - 1).alias("threshold")), F.struct(F.lit(k).alias("i"), (F.col("hi") + 1).alias("threshold")))))
    return ends.unionByName(middle)


def threshold_volume(image: DataFrame, lungs: DataFrame, k: int = COMPONENTS, path: str | None = None) -> tuple[DataFrame, list[float]]:
    """Labels by interval within the lungs of one volume, and the thresholds, written as CSV to `path` if given."""
    inside = masked(image, lungs)
    rows = thresholds(inside, k).orderBy("i")
    cuts = [float(r["threshold"]) for r in rows.collect()]  # k + 1 numbers
    if path:
        rows.select("threshold").coalesce(1).write.mode("overwrite").csv(path, header=True)
    return intervals(inside, cuts).select(*KEYS, "label"), cuts
