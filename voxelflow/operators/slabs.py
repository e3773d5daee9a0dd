"""Dense kernels over sparse volumes: slabs of slices with a halo, each an array in one task.

A slab holds `depth` slices and `halo` more on either side, so a kernel that looks no further than `halo` gives the same
result for any depth, and a volume is as many tasks as it has slabs. Rows are copied to the slabs that need them by an explode;
the group key is (volume_id, slab).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .masks import KEYS

#: Slices of a slab without its halo.
DEPTH = 32


def dense(rows: pd.DataFrame, z0: int, shape: tuple[int, int, int], value: str | None, fill: float) -> np.ndarray:
    """An array of `shape` whose first slice is z0; a mask where `value` is None."""
    out = np.zeros(shape, bool) if value is None else np.full(shape, fill, np.float64)
    out[rows["z"].to_numpy() - z0, rows["y"].to_numpy(), rows["x"].to_numpy()] = True if value is None else rows[value].to_numpy()
    return out


def sparse(array: np.ndarray, volume_id: str, z0: int, keep: np.ndarray, name: str | None) -> pd.DataFrame:
    """Rows of the cells where `keep` holds."""
    z, y, x = np.nonzero(keep)
    out = {"volume_id": volume_id, "z": (z + z0).astype(np.int32), "y": y.astype(np.int32), "x": x.astype(np.int32)}
    if name is not None:
        out[name] = array[z, y, x]
    return pd.DataFrame(out)


def boxed(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The mask of some cells in their bounding box, and the box's first cell."""
    at = rows[list("zyx")].to_numpy(np.int64)
    low = at.min(axis=0)
    out = np.zeros(at.max(axis=0) - low + 1, bool)
    out[tuple((at - low).T)] = True
    return out, low


def spread_slabs(voxels: DataFrame, volumes: DataFrame, halo: int | Column, depth: int, geometry: list[str]) -> DataFrame:
    """The rows with `geometry` of their volume and slab: a row for each slab that a cell lies in or within `halo` slices of."""
    last = F.floor((F.col("nz") - 1) / depth).cast("int")
    low = F.greatest(F.floor((F.col("z") - halo) / depth).cast("int"), F.lit(0))
    high = F.least(F.floor((F.col("z") + halo) / depth).cast("int"), last)
    return voxels.join(volumes.select("volume_id", *geometry), "volume_id").withColumn("slab", F.explode(F.sequence(low, high)))


def by_slab(
    voxels: DataFrame,
    volumes: DataFrame,
    kernel: Callable[[np.ndarray, dict], np.ndarray],
    halo: int,
    value: str | None = "v",
    out: str | None = "v",
    out_type: str = "double",
    fill: float = 0.0,
    everywhere: bool = False,
    depth: int = DEPTH,
    more: tuple[str, ...] = (),
) -> DataFrame:
    """The rows of `kernel`'s array: cells that aren't 0 or False, or all cells of slabs with any row if `everywhere`.

    kernel(array, info) gets the slab with its halo as far as the volume goes, and the volume's row and z0, and returns an array
    of the same shape; what it returns for the halo is dropped. more: further columns of `volumes` that the row has.
    """
    geometry = ["nz", "ny", "nx", "sz", "sy", "sx", *more]
    spread = spread_slabs(voxels.select(*KEYS, *([value] if value else [])), volumes, halo, depth, geometry)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        name, slab = str(key[0]), int(key[1])
        info = {g: rows[g].iloc[0] for g in geometry}
        start, stop = slab * depth, min((slab + 1) * depth, int(info["nz"]))
        a, b = max(0, start - halo), min(int(info["nz"]), stop + halo)
        array = dense(rows, a, (b - a, int(info["ny"]), int(info["nx"])), value, fill)
        made = kernel(array, info | {"z0": a})[start - a : stop - a]
        return sparse(made, name, start, np.ones(made.shape, bool) if everywhere else made != 0, out)

    schema = "volume_id string, z int, y int, x int" + (f", {out} {out_type}" if out else "")
    return spread.groupBy("volume_id", "slab").applyInPandas(run, schema)


def by_volume(voxels: DataFrame, volumes: DataFrame, kernel: Callable[[pd.DataFrame, dict], pd.DataFrame], schema: str) -> DataFrame:
    """kernel(rows, the volume's row) for each whole volume in one task: for kernels that need all of it, whose size one volume bounds."""
    names = [f for f in volumes.columns if f != "volume_id"]
    joined = voxels.join(volumes, "volume_id")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return kernel(rows.drop(columns=names), {"volume_id": str(key[0])} | {n: rows[n].iloc[0] for n in names})

    return joined.groupBy("volume_id").applyInPandas(run, schema)
