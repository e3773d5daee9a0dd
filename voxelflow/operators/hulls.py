"""Convex hulls slice by slice."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.geometry import hull_2d, in_hull_2d
from .masks import KEYS, union
from .morphology import closing
from ..functions.offsets import itk_ball


def hull_cells(y: np.ndarray, x: np.ndarray, corners_of_cells: bool = True) -> np.ndarray:
    """The cells of a slice whose centres lie in the hull of some cells; by the middles of their sides, or by their centres."""
    p = np.stack([y, x], 1).astype(float)
    if corners_of_cells:
        p = np.concatenate([p + d for d in ((-0.5, 0), (0.5, 0), (0, -0.5), (0, 0.5))])
    corners = hull_2d(p)
    low, high = p.min(axis=0), p.max(axis=0)
    grid = np.stack(np.meshgrid(np.arange(np.ceil(low[0]), high[0] + 1), np.arange(np.ceil(low[1]), high[1] + 1), indexing="ij"), -1).reshape(-1, 2)
    if len(corners) < 3:
        line = corners[-1] - corners[0]
        rest = grid - corners[0]
        return grid[(np.abs(line[0] * rest[:, 1] - line[1] * rest[:, 0]) < 1e-9) & (grid >= low).all(axis=1) & (grid <= high).all(axis=1)].astype(np.int32)
    return grid[in_hull_2d(grid, corners)].astype(np.int32)


def hull_by_slice(mask: DataFrame, corners_of_cells: bool = True) -> DataFrame:
    """Every slice of the mask replaced by its convex hull; an empty slice stays empty. A slice is one task's group."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        cells = hull_cells(rows["y"].to_numpy(), rows["x"].to_numpy(), corners_of_cells)
        return pd.DataFrame({"volume_id": key[0], "z": np.int32(key[1]), "y": cells[:, 0], "x": cells[:, 1]})

    return mask.select(*KEYS).groupBy("volume_id", "z").applyInPandas(run, "volume_id string, z int, y int, x int")


def body_hull(mask: DataFrame, volumes: DataFrame) -> DataFrame:
    """A mask closed by a ball of radius 1, and the hulls of the slices of that."""
    closed = closing(mask, volumes, itk_ball(1, 1, 1))
    return union(closed, hull_by_slice(closed))
