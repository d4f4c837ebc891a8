"""Element-wise geometry: crops, shifts, rotations, lattice lines, angles."""

from __future__ import annotations

import ast
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgumentsError


@dataclass(frozen=True)
class Crop:
    """A half-open box. Two axes: x (columns), y (rows); three axes: array order."""

    bounds: tuple[tuple[float, float], ...]

    @classmethod
    def of(cls, values: list[float] | tuple[float, ...] | None) -> Crop | None:
        """From 2 or 3 sizes, or 4 or 6 starts and stops; None: no crop."""
        if values is None:
            return None
        if len(values) in (2, 3):
            values = [v for size in values for v in (0, size)]
        if len(values) not in (4, 6):
            raise InvalidArgumentsError("a crop has 2, 3, 4 or 6 numbers")
        return cls(tuple(zip(values[::2], values[1::2], strict=True)))

    @classmethod
    def parse(cls, text: str) -> Crop | None:
        return cls.of(ast.literal_eval(text))

    def __str__(self) -> str:
        return str(tuple(v for pair in self.bounds for v in pair))

    def whole(self) -> Crop:
        """Starts rounded down and stops up."""
        return Crop(tuple((math.floor(a), math.ceil(b)) for a, b in self.bounds))

    def outer(self) -> Crop:
        """The square about the centre that holds every rotation of a two-axis crop."""
        if len(self.bounds) != 2:
            raise InvalidArgumentsError("only a crop of two axes has an outer crop")
        (x0, x1), (y0, y1) = self.bounds
        half = math.hypot(x1 - x0, y1 - y0) / 2
        cx, cy = (x0 + x1) / 2, (y0 + y1) / 2
        return Crop(((cx - half, cx + half), (cy - half, cy + half))).whole()

    def planar(self) -> Crop:
        """The crop without its first axis, if it has three."""
        return Crop(self.bounds[-2:])

    def depth(self) -> tuple[float, float] | None:
        return self.bounds[0] if len(self.bounds) == 3 else None

    def names(self) -> tuple[str, ...]:
        return ("c", "r") if len(self.bounds) == 2 else ("z", "r", "c")

    def condition(self) -> Column:
        """Whether a row of pixels or voxels lies inside."""
        out = F.lit(True)
        for name, (a, b) in zip(self.names(), self.bounds, strict=True):
            out &= (F.col(name) >= a) & (F.col(name) < b)
        return out


def crop(rows: DataFrame, values: list[float] | None) -> DataFrame:
    """Rows inside, coordinates counted from the crop's start."""
    box = Crop.of(values)
    if box is None:
        return rows
    inside = rows.where(box.condition())
    return inside.withColumns({n: F.col(n) - int(a) for n, (a, _) in zip(box.names(), box.bounds, strict=True)})


def rotating_crop(height: int, width: int) -> Crop:
    """The largest centred square that stays inside an image however it is rotated."""
    side = min(height, width) / math.sqrt(2)
    cx, cy = width / 2, height / 2
    return Crop(((math.ceil(cx - side / 2), math.floor(cx + side / 2)), (math.ceil(cy - side / 2), math.floor(cy + side / 2))))


def shifted(points: DataFrame, axes: tuple[str, ...] = ("x", "y", "z"), by: dict[str, float] | None = None) -> DataFrame:
    """Points less each axis's least value, or less ``by``; one broadcast row."""
    if by is not None:
        return points.withColumns({a: F.col(a) - by[a] for a in axes})
    least = points.agg(*(F.min(a).alias(f"__{a}") for a in axes))
    return points.crossJoin(F.broadcast(least)).withColumns({a: F.col(a) - F.col(f"__{a}") for a in axes}).drop(*(f"__{a}" for a in axes))


def centred(points: DataFrame, axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Points less half of each axis's largest value."""
    most = points.agg(*((F.max(a) / 2).alias(f"__{a}") for a in axes))
    return points.crossJoin(F.broadcast(most)).withColumns({a: F.col(a) - F.col(f"__{a}") for a in axes}).drop(*(f"__{a}" for a in axes))


def inside(points: DataFrame, box: list[float], axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """One row: whether all points are in the closed box."""
    ok = F.lit(True)
    for a, lo, hi in zip(axes, box[::2], box[1::2], strict=False):
        ok &= F.col(a).between(lo, hi)
    return points.agg(F.bool_and(ok).alias("inside"))


def varying_axes(points: DataFrame, axes: tuple[str, ...]) -> list[str]:
    """Axes with more than one value: one row of minima and maxima decides."""
    row = points.agg(*(F.min(a) != F.max(a) for a in axes)).first()
    return [a for a, varies in zip(axes, row, strict=True) if varies]


def reduced(points: DataFrame, axes: tuple[str, ...]) -> DataFrame:
    """Points without constant axes."""
    kept = varying_axes(points, axes)
    return points.drop(*(a for a in axes if a not in kept))


def rotated(points: DataFrame, degrees: float, centre: tuple[float, float], a: str = "x", b: str = "y") -> DataFrame:
    """Points turned about ``centre`` in the plane of two axes."""
    s, c = math.sin(math.radians(degrees)), math.cos(math.radians(degrees))
    da, db = F.col(a) - centre[0], F.col(b) - centre[1]
    return points.withColumns({a: da * c - db * s + centre[0], b: da * s + db * c + centre[1]})


def lattice_line(p: list[Column], q: list[Column], samples: int = 50) -> Column:
    """Sorted distinct lattice points on ``samples`` even steps from p to q, truncated to integers."""
    point = lambda i: F.array(*((a + (b - a) * i / (samples - 1)).cast("int") for a, b in zip(p, q, strict=True)))
    return F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), point)))


def split_by_lengths(values: Column, lengths: Column) -> Column:
    """Consecutive runs of ``values`` with the given lengths."""
    start = lambda i: F.aggregate(F.slice(lengths, F.lit(1), i), F.lit(0), lambda s, x: s + x)
    return F.transform(lengths, lambda n, i: F.slice(values, start(i) + 1, n))


def angle(da: Column, db: Column) -> Column:
    """Direction in [0, 180) of a vector with components along axis 0 and axis 1; none: 0, along axis 0 alone: 90."""
    return F.when(db == 0, F.when(da == 0, 0.0).otherwise(90.0)).when(da == 0, 0.0).otherwise(
        F.degrees(F.atan(da / db)) + F.when((da > 0) != (db > 0), 180.0).otherwise(0.0))


def octant(x: str = "x", y: str = "y", z: str = "z") -> Column:
    """0 to 7 by the coordinates' signs; null on a boundary."""
    on_boundary = (F.col(x) == 0) | (F.col(y) == 0) | (F.col(z) == 0)
    bit = lambda c, w: F.when(F.col(c) > 0, w).otherwise(0)
    return F.when(~on_boundary, bit(x, 4) + bit(y, 2) + bit(z, 1))
