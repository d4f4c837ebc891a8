"""Binary images and skeletons as tables of set voxels (image_id, z, r, c)."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgumentsError, StructuralElementError
from ..schema import NetworkFrame
from .components import components
from .groups import by_batches, by_keys, pieces
from .iterate import stored
from .thinning import skeletons

AT = ["image_id", "z", "r", "c"]
AROUND = [(z, r, c) for z, r, c in product((-1, 0, 1), repeat=3) if (z, r, c) != (0, 0, 0)]
PLANAR = [(0, r, c) for _, r, c in [(0, *rc) for rc in product((-1, 0, 1), repeat=2)] if (r, c) != (0, 0)]

# 3 by 3 patterns of a branch point, one per family. Mirror images,
# and (but for the one named below) transposes, count as well.
CROSSINGS = (
    ((1, 0, 1), (0, 1, 0), (1, 0, 1)),
    ((0, 1, 0), (1, 1, 1), (0, 1, 0)),
    ((0, 0, 0), (1, 1, 1), (0, 1, 0)),
    ((1, 0, 1), (0, 1, 0), (1, 0, 0)),
    ((1, 0, 1), (0, 1, 0), (0, 1, 0)),
    ((0, 1, 0), (1, 1, 0), (0, 0, 1)),
    ((0, 1, 0), (1, 1, 0), (1, 0, 1)),
    ((0, 1, 1), (0, 1, 1), (1, 0, 0)),
    ((1, 1, 1), (0, 1, 1), (1, 0, 0)),
    ((1, 1, 1), (0, 1, 1), (1, 0, 1)),
    ((1, 0, 0), (1, 1, 1), (0, 1, 0)),
)
NOT_TRANSPOSED = 8


def branch_codes() -> list[int]:
    """The 9-bit codes (raster order, first cell lowest) of all branch patterns."""
    out = set()
    for n, pattern in enumerate(CROSSINGS):
        p = np.array(pattern)
        for q in [p] if n == NOT_TRANSPOSED else [p, p.T]:
            for a in (q, np.flipud(q), np.fliplr(q), np.flipud(np.fliplr(q))):
                out.add(int((a.ravel() << np.arange(9)).sum()))
    return sorted(out)


def _steps(offsets: Iterable[tuple[int, int, int]]) -> Column:
    return F.array(*(F.struct(F.lit(z).alias("dz"), F.lit(r).alias("dr"), F.lit(c).alias("dc"), F.lit(n).alias("n")) for n, (z, r, c) in enumerate(offsets)))


def offered(voxels: DataFrame, offsets: Iterable[tuple[int, int, int]]) -> DataFrame:
    """(image_id, z, r, c, n): the places each voxel is the n-th neighbour of."""
    moved = voxels.select("image_id", F.explode(_steps(offsets)).alias("s"), "z", "r", "c")
    return moved.select("image_id", (F.col("z") - F.col("s.dz")).alias("z"), (F.col("r") - F.col("s.dr")).alias("r"), (F.col("c") - F.col("s.dc")).alias("c"), F.col("s.n").alias("n"))


def neighbour_counts(voxels: DataFrame, planar: bool = False) -> DataFrame:
    """Voxels with n_neighbours: one union and one aggregate, no self-join."""
    own = voxels.select(*AT, F.lit(1).alias("own"), F.lit(0).alias("near"))
    near = offered(voxels, PLANAR if planar else AROUND).select(*AT, F.lit(0).alias("own"), F.lit(1).alias("near"))
    return own.unionByName(near).groupBy(*AT).agg(F.max("own").alias("own"), F.sum("near").cast("int").alias("n_neighbours")).where("own = 1").drop("own")


def codes(voxels: DataFrame) -> DataFrame:
    """Voxels with the 9-bit code of their plane's neighbourhood, themselves included."""
    plane = [(0, r, c) for r, c in product((-1, 0, 1), repeat=2)]
    bits = offered(voxels, plane).groupBy(*AT).agg(F.sum(F.pow(F.lit(2), F.col("n"))).cast("int").alias("code"))
    return bits.where(F.col("code").bitwiseAND(1 << 4) > 0)


def end_points(voxels: DataFrame) -> DataFrame:
    """Voxels with at most one neighbour in their plane."""
    return neighbour_counts(voxels, planar=True).where("n_neighbours <= 1").select(*AT)


def branch_points(voxels: DataFrame) -> DataFrame:
    """Voxels whose neighbourhood is a branch pattern."""
    return codes(voxels).where(F.col("code").isin(branch_codes())).select(*AT)


def prune(voxels: DataFrame, times: int) -> DataFrame:
    """``times`` over: end points go, unless they were branch points at first."""
    fixed = stored(branch_points(voxels))
    for _ in range(times):
        gone = end_points(voxels).join(fixed, AT, "left_anti")
        voxels = stored(voxels.join(gone, AT, "left_anti"))
    return voxels


def ball(radius: int, planar: bool) -> list[tuple[int, int, int]]:
    depth = (0,) if planar else range(-radius, radius + 1)
    return [(z, r, c) for z in depth for r in range(-radius, radius + 1) for c in range(-radius, radius + 1) if z * z + r * r + c * c <= radius * radius]


def dilated(voxels: DataFrame, element: list[tuple[int, int, int]], box: DataFrame | None = None) -> DataFrame:
    """Places that some voxel reaches; within ``box`` (image_id, depth, height, width), if given."""
    out = offered(voxels, element).select(*AT).distinct()
    if box is None:
        return out
    inside = F.col("z").between(0, F.col("depth") - 1) & F.col("r").between(0, F.col("height") - 1) & F.col("c").between(0, F.col("width") - 1)
    return out.join(box.hint("merge"), "image_id").where(inside).select(*AT)  # a broadcast would pass a row an image through the driver


def closed(voxels: DataFrame, element: list[tuple[int, int, int]], box: DataFrame) -> DataFrame:
    """Dilation, then erosion; outside the image is background to both."""
    grown = dilated(voxels, element, box)
    full = offered(grown, element).groupBy(*AT).agg(F.count("*").alias("n")).where(F.col("n") == len(element))
    return full.select(*AT)


#: Voxels of an image whose objects are told apart in one task.
FEW = 1 << 18


def remove_objects(voxels: DataFrame, size: int, few: int = FEW) -> DataFrame:
    """Components of at least ``size`` voxels, touching corners included. Images of at most ``few`` voxels are labelled in a task each, others by joins."""
    voxels = stored(voxels.select(*AT))
    large = stored(voxels.groupBy("image_id").agg(F.count("*").alias("n")).where(F.col("n") > few).select("image_id"))
    if large.isEmpty():
        return _large_objects(voxels, size)
    some = voxels.join(large, "image_id", "left_semi")
    labelled = components(voxel_graph(some))
    big = labelled.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= size)
    kept = labelled.join(big, "component", "left_semi").select("id")
    return _large_objects(voxels.join(large, "image_id", "left_anti"), size).unionByName(with_ids(some).join(kept, "id", "left_semi").select(*AT))


def _drawn_together(x: np.ndarray) -> np.ndarray:
    """Places along an axis with every gap cut to 2: neighbours stay neighbours, others stay apart."""
    values, at = np.unique(x, return_inverse=True)
    return np.concatenate([[0], np.cumsum(np.minimum(np.diff(values), 2))])[at]


def _large_objects(voxels: DataFrame, size: int) -> DataFrame:
    """As ``remove_objects``, every image in one task; those of a batch are labelled together, one above the other with a gap."""

    def of_images(images: list[tuple[tuple[int, ...], np.ndarray]]) -> list[pd.DataFrame]:
        if not images:
            return []
        at = np.concatenate([own for _, own in images])
        n = np.array([len(own) for _, own in images])
        low, deep = (np.array([f(own[:, 0]) for _, own in images]) for f in (np.min, np.ptp))
        above = np.repeat(np.cumsum(deep + 2) - deep - 2 - low, n)
        z, r, c = (_drawn_together(x) for x in (at[:, 0] + above, at[:, 1], at[:, 2]))
        rows, columns = int(r.max()) + 2, int(c.max()) + 2
        held, place = np.unique((z * rows + r) * columns + c, return_inverse=True)
        pairs = [np.zeros((2, 0), np.int64)]
        for dz, dr, dc in (s for s in AROUND if s > (0, 0, 0)):
            to = np.searchsorted(held, held + (dz * rows + dr) * columns + dc)
            hit = np.flatnonzero((to < len(held)) & (held[np.minimum(to, len(held) - 1)] == held + (dz * rows + dr) * columns + dc))
            pairs.append(np.stack([hit, to[hit]]))
        piece = pieces(len(held), *np.concatenate(pairs, 1))
        kept = (np.bincount(piece, minlength=len(held))[piece] >= size)[place]
        z, r, c = at[kept].T.astype("int32")
        return [pd.DataFrame({"image_id": np.repeat([k[0] for k, _ in images], n)[kept], "z": z, "r": r, "c": c})]

    return by_batches(voxels, 1, of_images, "image_id long, z int, r int, c int")


def with_ids(voxels: DataFrame) -> DataFrame:
    """Voxels with an id: image, then raster order."""
    return voxels.withColumn("id", F.struct("image_id", "z", "r", "c"))


def voxel_graph(voxels: DataFrame) -> NetworkFrame:
    """Set voxels joined to neighbouring ones, each pair once."""
    half = [s for s in AROUND if s > (0, 0, 0)]
    own = with_ids(voxels)
    near = own.select("id", "image_id", F.explode(_steps(half)).alias("s"), "z", "r", "c")
    at = near.select(F.col("id").alias("src"), "image_id", (F.col("z") + F.col("s.dz")).alias("z"), (F.col("r") + F.col("s.dr")).alias("r"), (F.col("c") + F.col("s.dc")).alias("c"))
    return NetworkFrame(own.select("id"), at.join(own.withColumnRenamed("id", "dst"), AT).select("src", "dst"))


def by_image(voxels: DataFrame, kernel: Callable[[int, np.ndarray], list[pd.DataFrame]], schema: str) -> DataFrame:
    """``kernel`` on every image's id and voxels (rows of z, r, c in raster order); many small images share a batch."""
    return by_keys(voxels.select(*AT), 1, lambda key, at: kernel(key[0], at), schema)


def skeletonize(voxels: DataFrame) -> DataFrame:
    """Skeletons image by image; a stack of one slice is thinned as a volume one voxel thick."""
    return skeletons(voxels)


def debubble(voxels: DataFrame, radii: list[int], box: DataFrame, planar: bool = True) -> DataFrame:
    """For each radius, a closing and a new skeleton."""
    if not isinstance(radii, list):
        raise StructuralElementError("structuring elements are given as a list of radii")
    for r in radii:
        voxels = stored(skeletonize(closed(voxels, ball(r, planar), box)))
    return voxels


def merge_nodes(voxels: DataFrame, radius: int, box: DataFrame) -> DataFrame:
    """Branch points widened by a disk and joined with the skeleton, then thinned; planes only."""
    voxels = stored(voxels.select(*AT))
    if not voxels.where("z <> 0").isEmpty():
        raise TypeError("nodes are merged in planes only")
    wide = dilated(branch_points(voxels), ball(radius, True), box)
    return skeletonize(voxels.unionByName(wide).distinct())


def image_skeleton(binary: DataFrame, box: DataFrame, crop_to: list[float] | None = None, skeleton: bool = True, debubble_by: list[int] | None = None,
                   merge_by: int | None = None, prune_by: int | None = None, least_size: int | None = None, planar: bool = True) -> DataFrame:
    """Set pixels to a clean skeleton; options act in this order: debubble, merge, prune, remove."""
    from ..functions.geometry import crop

    if not skeleton and any(x is not None for x in (debubble_by, merge_by, prune_by)):
        raise InvalidArgumentsError("cleaning needs the skeleton")
    v = crop(binary.where("v > 0").select(*AT), crop_to)
    if not skeleton:
        return v
    v = stored(skeletonize(v))
    if debubble_by is not None:
        v = debubble(v, debubble_by, box, planar)
    if merge_by is not None:
        v = merge_nodes(v, merge_by, box)
    if prune_by is not None:
        v = prune(v, prune_by)
    return remove_objects(v, least_size) if least_size is not None else v
