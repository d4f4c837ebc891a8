"""From images or points to graphs and their properties, in one call."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Crop, crop, rotated, shifted
from ..errors import InvalidArgumentsError
from ..operators import components, imaging, measures, morphology, paths, points, skeleton, weights
from ..schema import NetworkFrame, both_ways


def from_images(pixels: DataFrame, options: imaging.Options | dict | str, crop_to: list[float] | None = None, rotate: float | None = None, giant: bool = True,
                weight: Sequence[str] = (), r_j: float = 0.0, rho: float = 1.0, debubble: list[int] | None = None, merge: int | None = None,
                prune: int | None = None, least_size: int | None = None) -> NetworkFrame:
    """Filter, threshold, crop, thin, clean, trace, keep the giant component of every image, weigh.

    With ``rotate`` (degrees) the square around the crop is traced, turned about
    its centre and clipped to the crop. Vertex ids are (image_id, id) structs.
    """
    if rotate is not None and crop_to is None:
        raise InvalidArgumentsError("a rotation needs a crop")
    o = options if isinstance(options, imaging.Options) else imaging.Options.of(options)
    binary = imaging.binarized(pixels, o)
    box = Crop.of(crop_to)
    wide = box.outer() if rotate is not None else box
    shape = pixels.groupBy("image_id").agg((F.max("z") + 1).alias("depth"), (F.max("r") + 1).alias("height"), (F.max("c") + 1).alias("width"))
    voxels = morphology.image_skeleton(binary, shape, [v for b in wide.bounds for v in b] if wide else None, True, debubble, merge, prune, least_size)
    g = skeleton.vectorised(voxels)
    key = lambda c: F.struct("image_id", F.col(c).alias("id"))
    v = g.vertices.withColumn("id", key("id"))
    e = g.edges.withColumns({"src": key("src"), "dst": key("dst")})
    if rotate is not None:
        (x0, x1), (y0, y1) = wide.bounds
        (a0, a1), (b0, b1) = box.bounds
        turned = rotated(v, rotate, ((x1 - x0) / 2, (y1 - y0) / 2))
        dx, dy = ((x1 - x0) - (a1 - a0)) / 2, ((y1 - y0) - (b1 - b0)) / 2
        inside = F.col("x").between(dx, dx + a1 - a0) & F.col("y").between(dy, dy + b1 - b0)
        v = shifted(turned.where(inside), ("x", "y"), {"x": dx, "y": dy})
        e = points.induced(e, v, "id")
    g = giants(NetworkFrame(v, e)) if giant else NetworkFrame(v, e)
    if weight:
        image = crop(binary, [x for b in wide.bounds for x in b] if wide else None)
        g = NetworkFrame(g.vertices, weights.weighted(weights.pixel_widths(g.edges, image), list(weight), r_j, rho))
    return g


def giants(g: NetworkFrame) -> NetworkFrame:
    """The largest component of every image."""
    c = components.components(NetworkFrame(g.vertices.select("id"), g.edges.select("src", "dst")))
    n = c.groupBy("component").agg(F.count("*").alias("n"))
    top = n.groupBy(F.col("component.image_id").alias("image_id")).agg(F.max_by("component", F.struct("n", -F.col("component.id"))).alias("component"))
    ids = c.join(top.select("component"), "component").select("id")
    return NetworkFrame(g.vertices.join(ids, "id", "left_semi"), g.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi"))


def from_points(cloud: DataFrame, rule: dict | DataFrame, periodic: tuple[float, float, float] | None = None) -> NetworkFrame:
    """By ``{"r_max": r}``, ``{"num_neighbors": k}`` with or without ``"r_max": r``, or a table of bonds; points are counted from their least corner."""
    own = shifted(cloud)
    if isinstance(rule, DataFrame):
        edges = points.edge_list_graph(own, rule)
    elif "num_neighbors" in rule:
        edges = points.knn_graph(own, rule["num_neighbors"], rule.get("r_max")).select("src", "dst", "length")
    elif "r_max" in rule:
        edges = points.cutoff_graph(own, rule["r_max"], box=periodic)
    else:
        raise InvalidArgumentsError("a rule names r_max or num_neighbors, or is a table of bonds")
    return NetworkFrame(own.withColumnRenamed("pid", "id"), edges)


def summary(g: NetworkFrame) -> DataFrame:
    """(metric, value) of a graph."""
    size = measures.size(g).first()
    rows = [(k, None if size[k] is None else float(size[k])) for k in size.asDict()]
    for name, df in (("average_clustering", measures.average(measures.clustering(g), "clustering", "v")), ("assortativity", measures.assortativity(g)), ("diameter", paths.diameter(g))):
        rows.append((name, df.first()[0]))
    return g.edges.sparkSession.createDataFrame(rows, "metric string, value double")


def plot_rows(g: NetworkFrame, values: DataFrame, key: str = "id", value: str = "value") -> DataFrame:
    """Every voxel of a graph's vertices (or, by ``eid``, edges) with its value, for drawing."""
    rows = g.vertices if key == "id" else g.edges
    return rows.join(values.select(key, value), key).select(key, F.explode("pts").alias("p"), value).select(key, "p.*", value)


def register_kernel(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> Callable[[NetworkFrame], DataFrame]:
    """Make an operator of a function over Arrow batches of edges, in both directions, one vertex's edges in one partition."""

    def operator(g: NetworkFrame) -> DataFrame:
        return both_ways(g.edges.select("src", "dst")).repartition("src").sortWithinPartitions("src").mapInArrow(kernel, schema)

    return operator
