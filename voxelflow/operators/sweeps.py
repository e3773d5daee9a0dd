"""Blobs that go on from slice to slice: a stack of contours that is swept outward from a centre along all axes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .components import local_labels
from .slabs import by_volume, dense, sparse


def _blobs(layer: np.ndarray) -> np.ndarray:
    """Labels from 1 of the 8-connected parts of a flat mask; 0 outside."""
    out = np.zeros(layer.shape, np.int64)
    y, x = np.nonzero(layer)
    if len(y):
        _, number = np.unique(local_labels(np.zeros(len(y)), y, x, *layer.shape, 8), return_inverse=True)
        out[y, x] = number + 1
    return out


def shared_blobs(before: np.ndarray, layer: np.ndarray) -> np.ndarray:
    """The blobs of a layer that overlap a blob of the one before it which is at least as large."""
    old, new = _blobs(before), _blobs(layer)
    both = (old > 0) & (new > 0)
    pairs = np.unique(np.stack([old[both], new[both]]), axis=1)
    old_size, new_size = np.bincount(old.ravel()), np.bincount(new.ravel())
    kept = {int(n) for o, n in pairs.T if new_size[n] <= old_size[o]}
    return np.isin(new, sorted(kept)) & (new > 0)


def sweep(mask: np.ndarray, centre: tuple[int, int, int]) -> np.ndarray:
    """What goes on from the slices through the centre, in both directions along each axis."""
    out = np.zeros(mask.shape, bool)
    for axis in range(3):
        layers, found = np.moveaxis(mask, axis, 0), np.moveaxis(out, axis, 0)
        for step in (1, -1):
            last = layers[centre[axis]]
            found[centre[axis]] |= last
            i = centre[axis] + step
            while 0 <= i < len(layers) and last.any():
                last = shared_blobs(last, layers[i])
                found[i] |= last
                i += step
    return out


def sweep_from_centre(mask: DataFrame, volumes: DataFrame, centre: tuple[int, int, int] | None = None) -> DataFrame:
    """The cells of each volume's mask that `sweep` reaches; the centre is the volume's middle unless given. A volume is one task."""

    def kernel(rows: pd.DataFrame, info: dict) -> pd.DataFrame:
        shape = tuple(int(info[f"n{a}"]) for a in "zyx")
        found = sweep(dense(rows, 0, shape, None, 0), centre or tuple(n // 2 for n in shape))
        return sparse(found, info["volume_id"], 0, found, None)

    return by_volume(mask.select("volume_id", "z", "y", "x"), volumes, kernel, "volume_id string, z int, y int, x int")
