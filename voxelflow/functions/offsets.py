"""Neighbourhoods and structuring elements as lists of (dz, dy, dx), the centre included unless said otherwise."""

from __future__ import annotations

from itertools import product

Offset = tuple[int, int, int]


def face() -> list[Offset]:
    """The six neighbours that share a face, without the centre."""
    return [(-1, 0, 0), (0, -1, 0), (0, 0, -1), (0, 0, 1), (0, 1, 0), (1, 0, 0)]


def full() -> list[Offset]:
    """The 26 neighbours, without the centre."""
    return [d for d in box(1, 1, 1) if any(d)]


def edge() -> list[Offset]:
    """The 18 neighbours that share a face or an edge, without the centre."""
    return [d for d in full() if sum(map(abs, d)) < 3]


def in_slice(connectivity: int = 4) -> list[Offset]:
    """The 4 or 8 neighbours within a slice, without the centre."""
    return [d for d in box(0, 1, 1) if any(d) and (connectivity == 8 or 0 in d[1:])]


def box(rz: int, ry: int, rx: int) -> list[Offset]:
    return list(product(range(-rz, rz + 1), range(-ry, ry + 1), range(-rx, rx + 1)))


def itk_ball(rz: int, ry: int, rx: int) -> list[Offset]:
    """An ellipsoid with semi-axes of half a voxel more than the radii: radius 1 gives 19 cells."""
    half = (rz + 0.5, ry + 0.5, rx + 0.5)
    return [d for d in box(rz, ry, rx) if sum((c / h) ** 2 for c, h in zip(d, half, strict=True)) <= 1]


def exact_ball(radius: float) -> list[Offset]:
    """Cells whose distance is at most the radius: 1 gives 7 cells, 2 gives 33."""
    r = int(radius)
    return [d for d in box(r, r, r) if sum(c * c for c in d) <= radius * radius]


def neighbours(connectivity: int) -> list[Offset]:
    """By the number of neighbours: 4 and 8 within a slice; 6, 18 and 26 in the volume."""
    table = {4: lambda: in_slice(4), 8: lambda: in_slice(8), 6: face, 18: edge, 26: full}
    if connectivity not in table:
        raise ValueError(f"connectivity {connectivity}")
    return table[connectivity]()
