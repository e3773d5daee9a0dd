"""The voxel queries by name, and their SQL."""

from __future__ import annotations

from .geometry_queries import QUERIES as SHAPES, SQL as SHAPE_SQL
from .mask_queries import QUERIES as MASKS, SQL as MASK_SQL, largest_component_report

QUERIES = {**MASKS, **SHAPES}
SQL = {**MASK_SQL, **SHAPE_SQL}

__all__ = ["QUERIES", "SQL", "largest_component_report"]
