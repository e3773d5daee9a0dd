"""Graphs of nodes and edges: order, trees, thickness, and the nearest edge of a cell.

node is (graph_id, node_id, z, y, x), edge (graph_id, src, dst); edges have no direction. A skeleton's graph has hundreds of nodes,
so breadth-first levels are found for each graph in one task, many graphs at a time. `levels_by_join` does the same for
a graph that is too large for a task: joins of a frontier with the edges, each level stored so that plans stay short.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..session import settled, stored
from .components import label_roots
from .slabs import DEPTH

#: Side of the blocks of cells that are compared with polyline points together, and pairs that are compared at once.
BLOCK, PAIRS = 8, 1 << 19


def both_ways(edges: DataFrame) -> DataFrame:
    """(graph_id, src, dst) of every edge in both directions, without loops and repetitions."""
    there = edges.select("graph_id", "src", "dst")
    return there.unionByName(there.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src != dst").distinct()


def top_nodes(nodes: DataFrame) -> DataFrame:
    """(graph_id, node_id) of the node with the greatest z; of several the smallest id."""
    return nodes.groupBy("graph_id").agg(F.min(F.struct(-F.col("z"), "node_id")).alias("m")).select("graph_id", "m.node_id")


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, node_id, dist, parent): steps from the top node, and the smallest node one step nearer. Unreached nodes are left out."""
    kinds = dict(nodes.dtypes)

    def run(mine: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for a, b in zip(links["src"].tolist(), links["dst"].tolist(), strict=True):
            if a != b:
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)
        z, ids = mine["z"].to_numpy(), mine["node_id"].tolist()
        top = min(i for i, at in zip(ids, z, strict=True) if at == z.max())
        out, front = {top: (0, None)}, [top]
        while front:
            ahead: dict = {}
            for a in sorted(front):
                for b in near.get(a, ()):
                    if b not in out:
                        ahead.setdefault(b, a)
            out |= {b: (out[a][0] + 1, a) for b, a in ahead.items()}
            front = list(ahead)
        parent = pd.array([p for _, p in out.values()], dtype="Int64" if kinds["node_id"] in ("int", "bigint") else object)
        return pd.DataFrame({"graph_id": mine["graph_id"].iloc[0], "node_id": list(out), "dist": [d for d, _ in out.values()], "parent": parent})

    def checked(mine: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        return run(mine, links) if len(mine) else pd.DataFrame(columns=["graph_id", "node_id", "dist", "parent"])

    joined = nodes.select("graph_id", "node_id", "z").groupBy("graph_id").cogroup(edges.select(F.col("graph_id").alias("of_graph"), "src", "dst").groupBy("of_graph"))
    return joined.applyInPandas(checked, f"graph_id {kinds['graph_id']}, node_id {kinds['node_id']}, dist int, parent {kinds['node_id']}")


def levels_by_join(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, node_id, dist, parent): as `levels`, for graphs of any size."""
    links = settled(both_ways(edges))
    front = settled(top_nodes(nodes).select("graph_id", "node_id", F.lit(0).alias("dist"), F.lit(None).cast(dict(nodes.dtypes)["node_id"]).alias("parent")))
    seen = front
    step = 0
    while not front.isEmpty():
        step += 1
        ahead = front.select("graph_id", F.col("node_id").alias("src")).join(links, ["graph_id", "src"])
        fresh = ahead.groupBy("graph_id", F.col("dst").alias("node_id")).agg(F.lit(step).alias("dist"), F.min("src").alias("parent"))
        front = settled(fresh.join(seen.select("graph_id", "node_id"), ["graph_id", "node_id"], "left_anti"))
        seen = seen.unionByName(front)
        if step % 8 == 0:
            seen = settled(seen)
    return settled(seen)


def node_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, node_id, dist, ord): nodes by distance from the top and id, unreached ones last."""
    found = nodes.select("graph_id", "node_id").join(levels(nodes, edges), ["graph_id", "node_id"], "left")
    order = Window.partitionBy("graph_id").orderBy(F.col("dist").asc_nulls_last(), "node_id")
    return found.select("graph_id", "node_id", "dist", (F.row_number().over(order) - 1).alias("ord"))


def tree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, src, dst): each reached node but the top below its parent; edges that would close a cycle go."""
    return levels(nodes, edges).where("parent is not null").select("graph_id", F.col("parent").alias("src"), F.col("node_id").alias("dst"))


def numbered(edges: DataFrame) -> DataFrame:
    """The edges with edge_id 1, 2, ... of each graph, by src and dst."""
    return edges.withColumn("edge_id", F.row_number().over(Window.partitionBy("graph_id").orderBy("src", "dst")))


def edge_thickness(edges: DataFrame, order: DataFrame, thickness: DataFrame) -> DataFrame:
    """(graph_id, src, dst, size): the thickness of an edge's later node over the graph's greatest; 0 where it is missing.

    order: (graph_id, node_id, ord); thickness: (graph_id, node_id, thickness).
    """
    place = order.select("graph_id", "node_id", "ord")
    named = edges.join(place.toDF("graph_id", "src", "a"), ["graph_id", "src"]).join(place.toDF("graph_id", "dst", "b"), ["graph_id", "dst"])
    later = named.withColumn("node_id", F.when(F.col("a") > F.col("b"), F.col("src")).otherwise(F.col("dst")))
    sized = later.join(thickness.select("graph_id", "node_id", "thickness"), ["graph_id", "node_id"], "left").withColumn("t", F.coalesce(F.col("thickness").cast("double"), F.lit(0.0)))
    top = F.max("t").over(Window.partitionBy("graph_id"))
    return sized.select("graph_id", "src", "dst", F.when(top > 0, F.col("t") / top).otherwise(F.col("t")).alias("size"))


def largest_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, node_id) of the connected part with most nodes; of several the one with the smallest node."""
    links = edges.select(F.col("graph_id").alias("volume_id"), F.col("src").alias("a"), F.col("dst").alias("b")).where("a != b")
    joined = label_roots(links).select(F.col("volume_id").alias("graph_id"), F.col("node").alias("node_id"), "root")
    roots = stored(nodes.select("graph_id", "node_id").join(joined, ["graph_id", "node_id"], "left").withColumn("root", F.coalesce("root", "node_id")))
    sizes = roots.groupBy("graph_id", "root").agg(F.count("*").alias("n"))
    best = sizes.groupBy("graph_id").agg(F.min(F.struct(-F.col("n"), "root")).alias("m")).select("graph_id", "m.root")
    return roots.join(best, ["graph_id", "root"], "left_semi").select("graph_id", "node_id")


def nearest_edge(cells: DataFrame, edge_points: DataFrame) -> DataFrame:
    """(volume_id, z, y, x, edge_id, distance) of the polyline nearest to each cell.

    edge_points: (volume_id, edge_id, z, y, x). A cell on polylines is of the one with the greatest id; of equally near ones it is
    of the smallest. Exact positions are an equality join; the rest is compared slab by slab with the volume's polyline points,
    and in a slab by blocks of BLOCK cells a side with those points that can be nearest to any of it. Of a position only the greatest
    and the smallest edge count, so that however many polylines cross there, a volume has no more points than cells.
    """
    keys = ["volume_id", "z", "y", "x"]
    places = edge_points.groupBy(*keys).agg(F.max("edge_id").alias("last"), F.min("edge_id").alias("edge_id"))
    exact = cells.select(*keys).join(places, keys).select(*keys, F.col("last").alias("edge_id"), F.lit(0.0).alias("distance")).distinct()
    rest = cells.select(*keys).join(exact, keys, "left_anti").withColumn("slab", F.floor(F.col("z") / DEPTH).cast("int"))
    slabs = rest.select("volume_id", "slab").distinct()
    points = places.drop("last").join(slabs.select("volume_id", (F.col("slab") + 0).alias("slab")), "volume_id")

    def run(mine: pd.DataFrame, lines: pd.DataFrame) -> pd.DataFrame:
        out = mine[keys].copy()
        if not len(lines) or not len(mine):
            return pd.DataFrame(columns=[*keys, "edge_id", "distance"])
        lines = lines.sort_values("edge_id", kind="stable")
        p, q, ids = mine[list("zyx")].to_numpy(np.int64), lines[list("zyx")].to_numpy(np.int64), lines["edge_id"].to_numpy()
        edge, far = np.zeros(len(p), np.int64), np.zeros(len(p))
        _, block = np.unique(p // BLOCK, axis=0, return_inverse=True)
        order = np.argsort(block.ravel(), kind="stable")
        for mine in np.split(order, np.flatnonzero(np.diff(block.ravel()[order])) + 1):
            # only points that may be nearer to some cell of the block than the one that is nearest to all of it
            low, high = p[mine].min(axis=0), p[mine].max(axis=0)
            least = (np.maximum(0, np.maximum(low - q, q - high)) ** 2).sum(axis=1)
            most = (np.maximum(np.abs(q - low), np.abs(q - high)) ** 2).sum(axis=1)
            near = np.flatnonzero(least <= most.min())
            for part in np.array_split(mine, min(len(mine), len(mine) * len(near) // PAIRS + 1)):
                d2 = ((p[part, None] - q[near][None]) ** 2).sum(axis=2)
                at = d2.argmin(axis=1)
                edge[part], far[part] = ids[near[at]], np.sqrt(d2[np.arange(len(at)), at])
        return out.assign(edge_id=edge, distance=far)

    near = rest.groupBy("volume_id", "slab").cogroup(points.groupBy("volume_id", "slab")).applyInPandas(run, "volume_id string, z int, y int, x int, edge_id int, distance double")
    return exact.select(*keys, F.col("edge_id").cast("int").alias("edge_id"), "distance").unionByName(near)
