"""Around a pixel classifier: patches, balanced areas of interest, masks by name, inference."""

from __future__ import annotations

import configparser
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgumentsError
from .groups import by_keys
from .imaging import AT, TILE

#: Distinct values that a mask's classes are named from.
MOST_CLASSES = 10_000


@dataclass(frozen=True)
class Params:
    """Settings of a pixel classifier, kept in INI files."""

    half: int = 12
    scales: int = 4
    factor: int = 2
    batch: int = 1024
    epochs: int = 3
    fraction: float = 0.3

    @classmethod
    def parse(cls, text: str, section: str = "params") -> Params:
        """From INI text; keys that are not there keep their defaults, others are left out."""
        given = configparser.ConfigParser()
        given.read_string(text)
        kinds = {f.name: type(f.default) for f in fields(cls)}
        return cls(**{k: kinds[k](v) for k, v in given[section].items() if k in kinds})

    def to_ini(self, section: str = "params") -> str:
        return "\n".join([f"[{section}]", *(f"{f.name} = {getattr(self, f.name)}" for f in fields(self)), ""])


def multi_scale(pixels: DataFrame, areas: DataFrame, p: Params = Params()) -> DataFrame:
    """(image_id, z, r, c, scale, patch): windows of one size whose pixels lie 1, ``factor``, ``factor`` squared, ... apart."""
    every = [patches(pixels, areas, p.half, p.factor**k).withColumn("scale", F.lit(k)) for k in range(p.scales)]
    return reduce(DataFrame.unionByName, every).select(*AT, "scale", "patch")


def patches(pixels: DataFrame, areas: DataFrame, half: int = 12, step: int = 1, tile: int = TILE) -> DataFrame:
    """(image_id, z, r, c, patch): the (2 half + 1) squared window about every pixel of ``areas``, of every ``step``-th pixel, row by row, 0 outside, values about 0 within half a unit.

    Pixels go to tiles with a halo as wide as a window reaches, areas to their own
    tile: one shuffle, and a window's pixels are no rows of their own.
    """
    reach = half * step
    near = lambda x, n: F.explode(F.sequence(F.floor((F.col(x) - n) / tile), F.floor((F.col(x) + n) / tile)))
    dealt = lambda rows, n: rows.withColumn("tr", near("r", n)).withColumn("tc", near("c", n)).select("image_id", "z", "tr", "tc", "asked", "r", "c", "v")
    held = dealt(pixels.select(*AT, F.col("v").cast("long").alias("v"), F.lit(0).alias("asked")), reach)
    both = held.unionByName(dealt(areas.select(*AT).distinct().withColumns({"v": F.lit(0).cast("long"), "asked": F.lit(1)}), 0))
    steps = (np.arange(2 * half + 1) - half) * step

    def of_tile(key: tuple[int, ...], p: np.ndarray) -> list[pd.DataFrame]:
        image, z, *at = key
        own, asked = p[p[:, 0] == 0, 1:], p[p[:, 0] == 1, 1:3]
        if not len(asked):
            return []
        low = np.array(at) * tile - reach
        values = np.zeros((tile + 2 * reach, tile + 2 * reach))
        values[own[:, 0] - low[0], own[:, 1] - low[1]] = own[:, 2] / 255 - 0.5
        r, c = ((asked[:, k] - low[k])[:, None] + steps for k in (0, 1))
        windows = values[r[:, :, None], c[:, None, :]].reshape(len(asked), -1)
        place = {"image_id": image, "z": np.int32(z), "r": asked[:, 0].astype("int32"), "c": asked[:, 1].astype("int32")}
        return [pd.DataFrame({**place, "patch": [*windows]})]

    return by_keys(both, 4, of_tile, "image_id long, z int, r int, c int, patch array<double>")


def augmented(patched: DataFrame, half: int = 12) -> DataFrame:
    """Every patch in its eight turned and mirrored forms."""
    side = 2 * half + 1
    index = np.arange(side * side).reshape(side, side)
    forms = [f for k in range(4) for f in (np.rot90(index, k), np.fliplr(np.rot90(index, k)))]
    orders = F.array(*(F.struct(F.lit(i).alias("form"), F.array(*map(F.lit, f.ravel().tolist())).alias("order")) for i, f in enumerate(forms)))
    out = patched.select("*", F.explode(orders).alias("o"))
    return out.withColumn("patch", F.transform("o.order", lambda i: F.element_at("patch", i + 1))).withColumn("form", F.col("o.form")).drop("o")


def balanced(areas: DataFrame, fraction: float, label: str = "label") -> DataFrame:
    """Rows of each class repeated or thinned by a hash so that all have about the largest class's share ``fraction``."""
    n = areas.groupBy(label).agg(F.count("*").alias("n"))
    most = n.agg((F.max("n") * fraction).alias("wanted"))
    times = n.crossJoin(F.broadcast(most)).select(label, (F.col("wanted") / F.col("n")).alias("times"))  # a row per class
    rest = F.col("times") - F.floor("times")
    u = F.pmod(F.xxhash64(*AT), F.lit(1_000_003)) / 1_000_003
    copies = (F.floor("times") + F.when(u < rest, 1).otherwise(0)).cast("int")
    out = areas.join(F.broadcast(times), label).withColumn("__copies", copies).where("__copies > 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).drop("times", "__copies")


def with_masks(images: DataFrame, masks: DataFrame, default: str = "default") -> DataFrame:
    """Images (name) with the mask of the same base name, case ignored, else the default mask."""
    base = lambda c: F.lower(F.regexp_extract(c, r"([^/]*?)(\.[^./]*)?$", 1))
    own = masks.select(base(F.col("name")).alias("base"), F.col("mask").alias("own"))
    rest = masks.where(base(F.col("name")) == default.lower()).agg(F.max("mask").alias("rest"))
    return images.withColumn("base", base(F.col("name"))).join(own, "base", "left").crossJoin(F.broadcast(rest)).withColumn("mask", F.coalesce("own", "rest")).drop("own", "rest", "base")


def as_classes(rows: DataFrame, column: str) -> DataFrame:
    """Values as integers from 0 in their order."""
    found = rows.select(column).where(F.col(column).isNotNull()).distinct().limit(MOST_CLASSES + 1).collect()
    if len(found) > MOST_CLASSES:
        raise InvalidArgumentsError(f"a mask has at most {MOST_CLASSES} classes")
    values = sorted(r[0] for r in found)
    named = F.create_map(*(F.lit(x) for i, v in enumerate(values) for x in (v, i))) if values else F.create_map(F.lit(0), F.lit(0))
    return rows.withColumn("class", F.try_element_at(named, F.col(column)))


def predicted(patched: DataFrame, model: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Pixels 255 where ``model`` (patches to probabilities) says more than a half."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            p = model(np.stack(frame["patch"].to_numpy()))
            yield frame[AT].assign(v=np.where(p > 0.5, 255, 0).astype("int32"))

    return patched.select(*AT, "patch").mapInPandas(run, "image_id long, z int, r int, c int, v int")
