"""Edge weights from length and width."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgumentsError
from .groups import by_batches
from .iterate import stored

KINDS = ("VariableWidthConductance", "FixedWidthConductance", "Resistance", "Area", "Width", "Length", "InverseLength")
#: The column each kind is kept in.
COLUMN = {"VariableWidthConductance": "conductance", "FixedWidthConductance": "conductance", "Resistance": "resistance", "Area": "area", "Width": "width", "Length": "length", "InverseLength": "inverse_length", "PerpBisector": "perp_bisector"}


def weight(kind: str | None, length: Column, width: Column, r_j: float = 0.0, rho: float = 1.0) -> Column:
    """The weight of an edge; edges of fewer than two voxels and results of 0 weigh 1."""
    n, w = length.cast("double"), width.cast("double")
    formula = {
        None: lambda: w / 10,
        "VariableWidthConductance": lambda: F.try_divide(F.lit(1.0), F.try_divide(n * rho, w * w) + 2 * r_j),
        "FixedWidthConductance": lambda: F.try_divide(F.lit(1.0), n * rho + 2 * r_j),
        "Resistance": lambda: F.try_divide(n * rho, w * w) + 2 * r_j,
        "Area": lambda: w * w,
        "Width": lambda: w,
        "Length": lambda: n,
        "InverseLength": lambda: F.try_divide(F.lit(1.0), n),
    }
    if kind not in formula:
        raise TypeError(f"unknown weight {kind!r}")
    value = formula[kind]()
    return F.when((n < 2) | value.isNull() | (value == 0), 1.0).otherwise(value)


def weighted(edges: DataFrame, kinds: Sequence[str], r_j: float = 0.0, rho: float = 1.0) -> DataFrame:
    """Edges (pts, pixel_width) with a column for each kind of weight."""
    if isinstance(kinds, str) or not isinstance(kinds, Sequence):
        raise TypeError("weights are given as a list of kinds")
    if len(columns := [COLUMN[k] for k in kinds if k in COLUMN]) > len(set(columns)):
        raise InvalidArgumentsError("two kinds of weight are kept in the same column")
    length = F.size("pts")
    width = F.when(length < 2, 10).otherwise(F.col("pixel_width"))
    return edges.withColumns({COLUMN[k]: weight(k, length, width, r_j, rho) for k in kinds if k != "PerpBisector"})


def orthogonal(d: np.ndarray) -> np.ndarray:
    """A unit vector orthogonal to ``d``; in the plane of the last two axes if ``d`` lies there."""
    if abs(d[0]) < 1e-12:
        out = np.array([0.0, -d[2], d[1]])
    else:
        out = np.cross(d, [1.0, 0.0, 0.0] if abs(d[0]) < 0.9 * np.linalg.norm(d) else [0.0, 1.0, 0.0])
    n = np.linalg.norm(out)
    return out / n if n else out


def span(image: np.ndarray, pts: np.ndarray) -> tuple[int, list[int], list[int]]:
    """Width of foreground across an edge at its middle voxel, and the two outermost points inside."""
    mid, u = pts[len(pts) // 2], orthogonal((pts[-1] - pts[0]).astype(float))
    ends = []
    for sign in (1, -1):
        last = mid.astype(float)
        for k in range(0 if u.any() else max(image.shape), max(image.shape) + 1):
            at = np.floor(mid + sign * k * u + 0.5).astype(int)
            if (at < 0).any() or (at >= image.shape).any() or not image[tuple(at)]:
                break
            last = mid + sign * k * u
        ends.append(last)
    a, b = (np.floor(e + 0.5).astype(int) for e in ends)
    return int(math.sqrt(((ends[0] - ends[1]) ** 2).sum())), a.tolist(), b.tolist()


def pixel_widths(edges: DataFrame, pixels: DataFrame, key: str = "image_id") -> DataFrame:
    """Edges with pixel_width and perp_bisector, measured image by image (numbered) on its foreground pixels; short edges have width 10 and no bisector."""
    kind = dict(edges.dtypes)[key]
    edges = stored(edges)  # they are read twice
    at = F.posexplode("pts").alias("i", "p")
    points = edges.select(key, F.lit(1).alias("kind"), "eid", at).select(key, "kind", "eid", "i", *(F.col(f"p.{a}").alias(a) for a in "zrc"))
    none = [F.lit(0).alias("eid"), F.lit(0).alias("i")]
    shapes = pixels.groupBy(key).agg(*((F.max(a) + 1).alias(a) for a in "zrc")).select(key, F.lit(-1).alias("kind"), *none, *"zrc")
    on = pixels.where("v > 0").select(key, F.lit(0).alias("kind"), *none, *"zrc")
    rows = shapes.unionByName(on).unionByName(points).withColumns({c: F.col(c).cast("long") for c in ("kind", "eid", "i", *"zrc")})

    def of_images(images: list[tuple[tuple[int, ...], np.ndarray]]) -> list[pd.DataFrame]:
        out = []
        for (of,), own in images:
            first, last = np.searchsorted(own[:, 0], [0, 1])
            image = np.zeros(own[0, 3:] if first else np.ones(3, int), bool)
            image[tuple(own[first:last, 3:].T)] = True
            lines = own[last:]
            for line in np.split(lines, np.flatnonzero(np.diff(lines[:, 1])) + 1) if len(lines) else ():
                out.append((of, line[0, 1], *(span(image, line[:, 3:]) if len(line) >= 2 else (10, None, None))))
        return [pd.DataFrame(out, columns=[key, "eid", "pixel_width", "l1", "l2"])] if out else []

    found = by_batches(rows, 1, of_images, f"{key} {kind}, eid long, pixel_width int, l1 array<int>, l2 array<int>")
    named = found.select(key, "eid", "pixel_width", F.when(F.col("l1").isNotNull(), F.struct("l1", "l2")).alias("perp_bisector"))
    return edges.join(named, [key, "eid"])
