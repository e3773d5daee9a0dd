"""Voxel, label-map, graph and polyline analytics as Spark DataFrame plans."""
