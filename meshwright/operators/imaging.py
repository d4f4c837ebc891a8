"""Image filters over pixel tables (image_id, z, r, c, v), v from 0 to 255.

Neighbourhood filters deal an image into square tiles with a halo as wide as the
kernel reaches. One shuffle sends each pixel to its tile, and those near a tile's
edge to the neighbours' as well; numpy then filters a tile at once. So a task
holds tiles and never a whole image. Outside the image, pixels are mirrored
without the edge (or repeated, for the adaptive threshold), or do not count; nor
do pixels that are not in the table.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .groups import by_keys
from .iterate import stored

PLANE = ["image_id", "z"]
AT = [*PLANE, "r", "c"]

SCHARR_X = ((-3, 0, 3), (-10, 0, 10), (-3, 0, 3))
SOBEL_X = ((-1, 0, 1), (-2, 0, 2), (-1, 0, 1))


def transposed(kernel):
    return tuple(zip(*kernel, strict=True))


def gaussian(size: int) -> list[float]:
    """One-dimensional weights; the small sizes' are fixed fractions."""
    small = {1: [1.0], 3: [0.25, 0.5, 0.25], 5: [0.0625, 0.25, 0.375, 0.25, 0.0625]}
    if size in small:
        return small[size]
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    w = [math.exp(-((i - (size - 1) / 2) ** 2) / (2 * sigma * sigma)) for i in range(size)]
    return [x / sum(w) for x in w]


def derivative(size: int, order: int) -> list[int]:
    """One-dimensional derivative weights: binomial smoothing, differenced ``order`` times."""
    w = [1]
    for _ in range(size - 1 - order):
        w = [a + b for a, b in zip([*w, 0], [0, *w], strict=True)]
    for _ in range(order):
        w = [b - a for a, b in zip([*w, 0], [0, *w], strict=True)]
    return w


def laplacian_kernel(size: int = 5) -> list[list[int]]:
    second, smooth = derivative(size, 2), derivative(size, 0)
    return [[a * d + b * c for c, d in zip(second, smooth, strict=True)] for a, b in zip(second, smooth, strict=True)]


def outer(weights: list[float]) -> list[list[float]]:
    return [[a * b for b in weights] for a in weights]


#: Side of a tile; images whose sizes go to every task.
TILE, BROADCAST_SHAPES = 64, 1_000_000


def tiled(pixels: DataFrame, half: int, value: Callable[[np.ndarray, np.ndarray], np.ndarray], border: str | None = "reflect", tile: int = TILE) -> DataFrame:
    """Pixels with ``value`` of the windows of 2 ``half`` + 1 pixels a side around them and of their own values.

    ``value`` gets arrays (cell, r, c) and (r, c), NaN where no pixel is; ``border``
    names numpy's way to go on beyond the image, None leaves NaN there.
    """
    shape = stored(pixels.groupBy("image_id").agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w")))
    shape = F.broadcast(shape) if shape.count() <= BROADCAST_SHAPES else shape  # a row per image; pixels are then shuffled to their tiles only
    reaching = lambda x, n: F.sequence(F.floor(F.greatest(F.col(x) - half, F.lit(0)) / tile), F.floor(F.least(F.col(x) + half, F.col(n) - 1) / tile))
    dealt = pixels.select(*AT, "v").join(shape, "image_id").withColumn("tr", F.explode(reaching("r", "h"))).withColumn("tc", F.explode(reaching("c", "w")))

    def of_tile(key: tuple[int, ...], p: np.ndarray) -> list[pd.DataFrame]:
        image, z, *at, h, w = key
        low = [t * tile for t in at]
        high = [min(a + tile, n) for a, n in zip(low, (h, w), strict=True)]
        first, last = [max(0, a - half) for a in low], [min(n, b + half) for b, n in zip(high, (h, w), strict=True)]
        held = np.full((last[0] - first[0], last[1] - first[1]), np.nan)
        held[p[:, 0] - first[0], p[:, 1] - first[1]] = p[:, 2]
        beyond = [(half - (a - f), half - (x - b)) for a, f, x, b in zip(low, first, last, high, strict=True)]
        wide = np.pad(held, beyond, mode=border) if border else np.pad(held, beyond, constant_values=np.nan)
        side = 2 * half + 1
        cells = np.moveaxis(np.lib.stride_tricks.sliding_window_view(wide, (side, side)), (2, 3), (0, 1)).reshape(side * side, high[0] - low[0], high[1] - low[1])
        own = wide[half : wide.shape[0] - half, half : wide.shape[1] - half]
        r, c = np.nonzero(~np.isnan(own))
        found = (r + low[0], c + low[1], value(cells, own)[r, c])
        return [pd.DataFrame({"image_id": image, "z": np.int32(z), **{n: x.astype("int32") for n, x in zip("rcv", found, strict=True)}})]

    return by_keys(dealt.select(*PLANE, "tr", "tc", "h", "w", "r", "c", "v"), 6, of_tile, "image_id long, z int, r int, c int, v int")


def under(cells: np.ndarray, kernel) -> np.ndarray:
    """The sum of windows' values by a kernel's weights."""
    weights = np.array(kernel, float).ravel()
    return np.nansum(cells * weights[:, None, None], 0)


def byte(value: np.ndarray) -> np.ndarray:
    """Rounded half to even, within 0 and 255."""
    return np.clip(np.rint(value), 0, 255)


def gamma_corrected(pixels: DataFrame, gamma: float) -> DataFrame:
    if gamma == 1:
        return pixels
    return pixels.withColumn("v", F.floor(F.pow(F.col("v") / 255, F.lit(1 / gamma)) * 255).cast("int"))


#: Pixels of a slice whose spectrum one task takes; larger slices go by rows and columns.
SPECTRUM = 1 << 22


def low_pass(pixels: DataFrame, window: int, most: int = SPECTRUM) -> DataFrame:
    """A Hamming window's square root to the power ``window`` over a slice's spectrum, stretched to 0-255.

    The spectrum of a large slice is taken row by row and then column by column, and
    taken back the same way: a task holds a row or a column, three shuffles turn them.
    """
    shape = pixels.groupBy(*PLANE).agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"))
    large = stored(shape.where(F.col("h").cast("long") * F.col("w") > most))
    own = pixels.select(*AT, "v")
    if large.isEmpty():
        return _low_pass_of_slices(own, window)
    small = _low_pass_of_slices(own.join(large, PLANE, "left_anti"), window)
    return small.unionByName(_low_pass_by_lines(own.join(large, PLANE), window))


def _low_pass_of_slices(pixels: DataFrame, window: int) -> DataFrame:
    def of_slice(p: pd.DataFrame) -> pd.DataFrame:
        h, w = p["r"].max() + 1, p["c"].max() + 1
        image = np.zeros((h, w))
        image[p["r"], p["c"]] = p["v"]
        mask = np.sqrt(np.outer(np.hamming(h), np.hamming(w))) ** window
        out = np.abs(np.fft.ifft2(np.fft.ifftshift(np.fft.fftshift(np.fft.fft2(image)) * mask)))
        low, high = out.min(), out.max()
        out = (out - low) / (high - low) * 255 if high > low else np.zeros_like(out)
        return p.assign(v=np.floor(out[p["r"], p["c"]] + 1e-9).astype("int32"))

    return pixels.groupBy(*PLANE).applyInPandas(of_slice, "image_id long, z int, r int, c int, v int")


def _lines(values: DataFrame, line: str, along: str, kernel: Callable[[np.ndarray, int, int], np.ndarray]) -> DataFrame:
    """(image_id, z, h, w, r, c, re, im): ``kernel`` on every line (a row or column) of complex values, its number and the image's size across it; gaps are zeros."""
    keys = [*PLANE, "h", "w", line]
    lines = values.groupBy(*keys).agg(F.collect_list(F.struct(along, "re", "im")).alias("p"))
    n = "w" if along == "c" else "h"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            re, im = [], []
            for p, size, across, nth in zip(frame["p"], frame[n], frame["h" if n == "w" else "w"], frame[line], strict=True):
                x = np.zeros(size, complex)
                x[[q[along] for q in p]] = [complex(q["re"], q["im"]) for q in p]
                y = kernel(x, nth, across)
                re.append(y.real)
                im.append(y.imag)
            yield frame[keys].assign(re=re, im=im)

    kinds = ", ".join(f"{k} {t}" for k, t in lines.dtypes if k != "p")
    out = lines.mapInPandas(run, f"{kinds}, re array<double>, im array<double>")
    return out.select(*keys, F.posexplode(F.arrays_zip("re", "im")).alias(along, "y")).select(*keys, along, "y.re", "y.im")


def _low_pass_by_lines(pixels: DataFrame, window: int) -> DataFrame:
    """As ``_low_pass_of_slices``, of pixels with their slice's h and w."""
    part = lambda n: np.sqrt(np.fft.ifftshift(np.hamming(n))) ** window  # noqa: E731  the window is a product of one along each axis
    none = F.lit(0.0).alias("im")
    rows = _lines(pixels.select(*AT, "h", "w", F.col("v").cast("double").alias("re"), none), "r", "c", lambda x, nth, across: np.fft.fft(x))
    columns = _lines(rows, "c", "r", lambda x, nth, across: np.fft.ifft(np.fft.fft(x) * part(len(x)) * part(across)[nth]))
    back = _lines(columns, "r", "c", lambda x, nth, across: np.abs(np.fft.ifft(x)) + 0j)
    out = stored(back.select(*AT, F.col("re").alias("out")))
    ends = out.groupBy(*PLANE).agg(F.min("out").alias("low"), F.max("out").alias("high"))
    wide = F.col("high") - F.col("low")
    v = F.when(wide > 0, F.floor((F.col("out") - F.col("low")) / wide * 255 + 1e-9)).otherwise(0).cast("int")
    return pixels.select(*AT).join(out, AT).join(ends, PLANE).select(F.col("image_id").cast("long").alias("image_id"), *(F.col(a).cast("int").alias(a) for a in "zrc"), v.alias("v"))


def median(pixels: DataFrame, size: int = 5) -> DataFrame:
    """The value whose rank is half the neighbours inside the image."""

    def value(cells: np.ndarray, own: np.ndarray) -> np.ndarray:
        n = (~np.isnan(cells)).sum(0)
        return np.take_along_axis(np.sort(cells, 0), (n // 2)[None], 0)[0]

    return tiled(pixels, size // 2, value, None)


def gaussian_blur(pixels: DataFrame, size: int) -> DataFrame:
    kernel = outer(gaussian(size))
    return tiled(pixels, size // 2, lambda cells, own: byte(under(cells, kernel)))


def disk(radius: int) -> list[list[int]]:
    return [[int(i * i + j * j <= radius * radius) for j in range(-radius, radius + 1)] for i in range(-radius, radius + 1)]


def autolevel(pixels: DataFrame, radius: int) -> DataFrame:
    """Stretch by the least and largest value in a disk."""
    held = np.array(disk(radius), bool).ravel()

    def value(cells: np.ndarray, own: np.ndarray) -> np.ndarray:
        low, high = np.fmin.reduce(cells[held], 0), np.fmax.reduce(cells[held], 0)
        wide = high > low
        return np.where(wide, np.floor(255 * (own - low) / np.where(wide, high - low, 1)), 0)

    return tiled(pixels, radius, value, None)


def blended(own: np.ndarray, gradient: np.ndarray) -> np.ndarray:
    return byte(0.75 * own + 0.25 * gradient)


def gradient_blend(pixels: DataFrame, kernel_x) -> DataFrame:
    """Three quarters image, one quarter mean absolute gradient."""
    both = kernel_x, transposed(kernel_x)

    def value(cells: np.ndarray, own: np.ndarray) -> np.ndarray:
        gx, gy = (byte(np.abs(under(cells, k))) for k in both)
        return blended(own, byte(0.5 * gx + 0.5 * gy))

    return tiled(pixels, 1, value)


def laplacian_blend(pixels: DataFrame, size: int = 5) -> DataFrame:
    kernel = laplacian_kernel(size)
    return tiled(pixels, size // 2, lambda cells, own: blended(own, byte(np.abs(under(cells, kernel)))))


def _foreground(light: Column, fg_color: int) -> Column:
    return F.when(light != F.lit(bool(fg_color)), 255).otherwise(0)


def threshold(pixels: DataFrame, at: float, fg_color: int = 0) -> DataFrame:
    """255 above ``at``; inverted if the foreground is dark."""
    return pixels.select(*AT, _foreground(F.col("v") > at, fg_color).alias("v"))


def threshold_adaptive(pixels: DataFrame, size: int, fg_color: int = 0, less: int = 2) -> DataFrame:
    """255 above the Gaussian mean of ``size`` less ``less``."""
    kernel, dark = outer(gaussian(size)), bool(fg_color)
    return tiled(pixels, size // 2, lambda cells, own: np.where((own > byte(under(cells, kernel)) - less) != dark, 255, 0), "edge")


def otsu_levels(pixels: DataFrame) -> DataFrame:
    """(image_id, z, level): the value that parts the histogram with most variance between; the least of equals."""
    n = pixels.groupBy(*PLANE, "v").agg(F.count("*").cast("double").alias("n"))
    below, every = Window.partitionBy(*PLANE).orderBy("v"), Window.partitionBy(*PLANE)
    s = n.select(*PLANE, "v", F.sum("n").over(below).alias("w0"), F.sum(F.col("n") * F.col("v")).over(below).alias("s0"), F.sum("n").over(every).alias("w"), F.sum(F.col("n") * F.col("v")).over(every).alias("s"))
    w1 = F.col("w") - F.col("w0")
    gap = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / w1
    between = F.when(w1 > 0, F.col("w0") * w1 * gap * gap).otherwise(0.0)
    return s.select(*PLANE, "v", F.round(between / (F.col("w") * F.col("w")), 9).alias("b")).groupBy(*PLANE).agg(F.max_by("v", F.struct("b", -F.col("v"))).alias("level"))


def threshold_otsu(pixels: DataFrame, fg_color: int = 0) -> DataFrame:
    levels = otsu_levels(pixels)
    return pixels.join(levels, PLANE).select(*AT, _foreground(F.col("v") > F.col("level"), fg_color).alias("v"))


@dataclass(frozen=True)
class Options:
    """The filter chain's settings; numbers may come as text."""

    Thresh_method: int = 0
    gamma: float = 1.0
    md_filter: int = 0
    g_blur: int = 0
    autolvl: int = 0
    fg_color: int = 0
    laplacian: int = 0
    scharr: int = 0
    sobel: int = 0
    lowpass: int = 0
    asize: int = 3
    bsize: int = 1
    wsize: int = 1
    thresh: float = 128.0

    @classmethod
    def of(cls, given: dict | str) -> Options:
        """From a dictionary or JSON text; unknown keys are left out."""
        given = json.loads(given) if isinstance(given, str) else given
        kinds = {f.name: float if f.name in ("gamma", "thresh") else int for f in fields(cls)}
        return cls(**{k: kinds[k](float(v)) for k, v in given.items() if k in kinds})

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Options:
        """From a JSON file."""
        return cls.of(spark.read.text(path, wholetext=True).first()["value"])

    def write(self, spark: SparkSession, path: str) -> None:
        """To a folder of one JSON file, which ``read`` takes as well."""
        spark.createDataFrame([(self.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    def to_json(self) -> str:
        return json.dumps({f.name: getattr(self, f.name) for f in fields(self)})


def odd(k: int) -> int:
    """The kernel size a slider position stands for."""
    return 2 * k + 1


def binarized(pixels: DataFrame, o: Options) -> DataFrame:
    """The filter chain in its fixed order, then the threshold: v is 0 or 255."""
    p = gamma_corrected(pixels.select(*AT, "v"), o.gamma)
    for on, step in (
        (o.lowpass, lambda p: low_pass(p, o.wsize)),
        (o.md_filter, median),
        (o.g_blur, lambda p: gaussian_blur(p, o.bsize)),
        (o.autolvl, lambda p: autolevel(p, o.bsize)),
        (o.scharr, lambda p: gradient_blend(p, SCHARR_X)),
        (o.sobel, lambda p: gradient_blend(p, SOBEL_X)),
        (o.laplacian, laplacian_blend),
    ):
        if on:
            p = step(p)
    if o.Thresh_method == 0:
        return threshold(p, o.thresh, o.fg_color)
    if o.Thresh_method == 1:
        return threshold_adaptive(p, o.asize, o.fg_color)
    if o.Thresh_method == 2:
        return threshold_otsu(p, o.fg_color)
    raise ValueError(f"unknown threshold method {o.Thresh_method}")
