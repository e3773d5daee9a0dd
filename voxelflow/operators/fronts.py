"""Arrival times of a front that starts at seeds and moves with a given speed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import settled
from .masks import KEYS
from .slabs import DEPTH, dense, sparse, spread_slabs


def arrival_times(speed: np.ndarray, seeds: np.ndarray, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), stop: float = np.inf, known: np.ndarray | None = None) -> np.ndarray:
    """The solution of |grad T| = 1 / speed with T = 0 at the seeds, infinite where T would exceed `stop`.

    All cells are updated from their neighbours at once until nothing changes, which reaches the same fixed point as
    taking them in the order of their times. Speed 0 is never passed. known: times that are no less than the solution, to go on from.
    """
    slow = np.where(speed > 0, 1.0 / np.where(speed > 0, speed, 1.0), np.inf)
    t = np.where(seeds, 0.0, np.inf if known is None else known)
    h = np.array(spacing, float)
    while True:
        p = np.pad(t, 1, constant_values=np.inf)
        near = np.stack([np.minimum(np.roll(p, 1, i), np.roll(p, -1, i))[1:-1, 1:-1, 1:-1] for i in range(3)])
        order = np.argsort(near, axis=0, kind="stable")
        a = np.take_along_axis(near, order, 0)
        g = h[order]
        new = a[0] + g[0] * slow
        with np.errstate(invalid="ignore"):
            for m in (2, 3):  # as many axes as have a neighbour that is earlier than the result
                w = 1 / g[:m] ** 2
                finite = np.where(np.isfinite(a[:m]), a[:m], 0.0)
                sw, sa, saa = w.sum(axis=0), (w * finite).sum(axis=0), (w * finite**2).sum(axis=0)
                disc = sa**2 - sw * (saa - slow**2)
                root = (sa + np.sqrt(np.maximum(disc, 0))) / sw
                ok = np.isfinite(a[m - 1]) & np.isfinite(slow) & (disc >= 0) & (new > a[m - 1])
                new = np.where(ok, np.minimum(new, root), new)
        new = np.minimum(t, new)
        new[new > stop] = np.inf
        new[seeds] = 0.0
        if ((new < t - 1e-9) & np.isfinite(new)).sum() == 0:
            return new
        t = new


def fast_march(speed: DataFrame, seeds: DataFrame, volumes: DataFrame, stop: float = 60.0, depth: int = DEPTH) -> DataFrame:
    """(volume_id, z, y, x, v): arrival times up to `stop`. Cells without speed aren't passed.

    A slab of `depth` slices, with a slice more on either side, is one task. A slab's times are the solution given those of its neighbours as
    they are so far, which are no less than the true ones; slabs go on from them until none has changed. A volume of one slab is solved
    at once.
    """
    marked = speed.select(*KEYS, F.col("v").cast("double").alias("v")).join(seeds.select(*KEYS).distinct().withColumn("seed", F.lit(True)), KEYS, "left")

    def kernel(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        one = rows.iloc[0]
        start, stop_z = int(key[1]) * depth, min((int(key[1]) + 1) * depth, int(one["nz"]))
        a, b = max(0, start - 1), min(int(one["nz"]), stop_z + 1)
        shape = (b - a, int(one["ny"]), int(one["nx"]))
        rate, seed = dense(rows, a, shape, "v", 0.0), dense(rows[rows["seed"].notna()], a, shape, None, 0)
        before = dense(rows, a, shape, "t", np.inf)
        t = arrival_times(rate, seed, tuple(float(one[f"s{c}"]) for c in "zyx"), stop, before)
        own = slice(start - a, stop_z - a)
        out = sparse(t[own], str(key[0]), start, rate[own] > 0, "t")
        at = out["z"].to_numpy() - a, out["y"].to_numpy(), out["x"].to_numpy()
        return out.assign(v=rate[at], seed=pd.array(np.where(seed[at], True, None), dtype="boolean"), moved=(t[at] < before[at] - 1e-9).astype(np.int8))

    state = marked.withColumn("t", F.lit(float("inf")))
    schema = "volume_id string, z int, y int, x int, t double, v double, seed boolean, moved byte"
    many = volumes.agg(F.max("nz")).first()[0] or 0
    while True:
        spread = spread_slabs(state.select(*KEYS, "v", "seed", "t"), volumes, 1, depth, ["nz", "ny", "nx", "sz", "sy", "sx"])
        state = spread.groupBy("volume_id", "slab").applyInPandas(kernel, schema)
        if many <= depth:
            break
        state = settled(state)
        if not state.agg(F.max("moved")).first()[0]:
            break
    return state.where(F.col("t") < float("inf")).select(*KEYS, F.col("t").alias("v"))
