"""Tables of the library: pixels, voxels, points, and graphs as vertices and edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOXEL = "struct<z:int,r:int,c:int>"
PIXELS = "image_id long, z int, r int, c int, v int"
VOXELS = "image_id long, z int, r int, c int"
POINTS = "frame int, pid long, x double, y double, z double"
VERTICES = f"graph_id string, id long, x double, y double, z double, pts array<{VOXEL}>"
EDGES = f"graph_id string, eid long, src long, dst long, pts array<{VOXEL}>"


@dataclass(frozen=True)
class NetworkFrame:
    """A graph, or many keyed by ``graph_id``: vertices (id, ...) and edges (src, dst, ...)."""

    vertices: DataFrame
    edges: DataFrame

    def simplified(self) -> DataFrame:
        """Undirected edges src < dst, once each, without loops."""
        return simple(self.edges)

    def ends(self) -> DataFrame:
        """Both directions of every edge."""
        return both_ways(self.edges)


def simple(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """(src, dst, ...) in both directions, in one pass over the edges."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    ends = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.select(F.explode(ends).alias("e"), *rest).select("e.*", *rest)
