"""Thinning by simple points in eight subfields, one image in a task or an image in many tiles.

A pass takes the voxels that have an open face and more than one neighbour and,
colour by colour, deletes those that are simple. Colours are the parities of the three
coordinates: voxels of one colour never touch, so deleting all of them at once
is the same as one after another, topology is kept, and the result does not
depend on how an image is dealt. Along an axis on which the image is one voxel
thick no face is open. A point is simple if its neighbours are one piece (faces,
edges and corners count) and the open places around it that share a face with it
are one piece through faces, within its 18-neighbourhood; both pieces grow as
bits of the 27-bit code of the neighbourhood, for all candidates at once.

An image whose box is small (``BOX`` cells, known before) is thinned in one task.
A larger one is packed into words of 64 voxels along c and dealt into tiles with
a halo: what is decided in a pass depends on voxels at most ``REACH`` away, so a
tile makes ``PASSES`` passes by itself, keeps its own part and sends its border
to its neighbours by the next shuffle, until no voxel goes. Empty space takes no
tile, however wide the box is.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .groups import by_batches, by_keys
from .iterate import forget, stored

#: Cells of a box that one task holds; passes between two shuffles; how far a pass looks: a border and eight colours.
BOX, PASSES, REACH = 1 << 22, 2, 9
#: A tile's side along z and r, and its words along c.
SIDE, WORDS = 64, 4

AT = ["image_id", "z", "r", "c"]
CELLS = list(product((-1, 0, 1), repeat=3))
CENTRE = 13
FACES = [n for n, c in enumerate(CELLS) if sum(map(abs, c)) == 1]


def _mask(cells) -> np.int32:
    return np.int32(sum(1 << n for n in cells))


FACE, NEAR18 = _mask(FACES), _mask(n for n, c in enumerate(CELLS) if 1 <= sum(map(abs, c)) <= 2)
#: Cells that have a neighbour one step down, or up, each axis; the step's number of bits.
AXES = [(step, _mask(n for n, c in enumerate(CELLS) if c[axis] > -1), _mask(n for n, c in enumerate(CELLS) if c[axis] < 1)) for axis, step in enumerate((9, 3, 1))]


def _grown(x: np.ndarray, by_face: bool) -> np.ndarray:
    """Sets of cells with their neighbours: through faces only, or all."""
    out = x
    for step, above, below in AXES:
        of = x if by_face else out
        out = out | ((of & above) >> step) | ((of & below) << step)
    return out


def _reached(seed: np.ndarray, inside: np.ndarray, by_face: bool) -> np.ndarray:
    while True:
        more = _grown(seed, by_face) & inside
        if (more == seed).all():
            return seed
        seed = more


def simple(code: np.ndarray) -> np.ndarray:
    """Whether the centres of 27-bit neighbourhoods can go without changing topology."""
    on = code & ~np.int32(1 << CENTRE)
    one_piece = (on != 0) & (_reached(on & -on, on, False) == on)
    off = ~code & NEAR18
    faces = off & FACE
    return one_piece & (faces != 0) & (_reached(faces & -faces, off, True) & FACE == faces)


def thinned(volume: np.ndarray, flat: tuple[bool, bool, bool], passes: int | None = None, origin: tuple[int, int, int] = (0, 0, 0)) -> np.ndarray:
    """A volume of booleans after so many passes, or as many as change it; ``flat`` axes have no open faces, ``origin`` gives the parities."""
    on = np.pad(volume, 1)
    held = np.flatnonzero(on)
    _thin(on, held, np.full(len(held), sum(f << k for k, f in enumerate(flat))), passes, origin)
    return on[1:-1, 1:-1, 1:-1]


def thinned_together(images: list[np.ndarray]) -> list[np.ndarray]:
    """The voxels (rows of z, r, c) that thinning leaves of each image, all in one volume: one above the other with a gap, at places of the same parity."""
    placed, at = [], 0
    for own in images:
        low = own.min(0)
        at += (at ^ int(low[0])) & 1
        placed.append(own - low + [at + 1, 1 + (low[1] & 1), 1 + (low[2] & 1)])
        at = int(placed[-1][:, 0].max()) + 1
    every = np.concatenate(placed)
    shape = every.max(0) + 2
    flat = np.repeat([sum(int(n == 0) << k for k, n in enumerate(np.ptp(own, 0))) for own in images], [*map(len, images)])
    on = np.zeros(shape, bool)
    on[tuple(every.T)] = True
    place = np.ravel_multi_index(tuple(every.T), shape)
    order = np.argsort(place, kind="stable")
    _thin(on, place[order], flat[order], None, (0, 0, 0))
    left = on.ravel()[place]
    return [own[kept] for own, kept in zip(images, np.split(left, np.cumsum([*map(len, images)])[:-1]), strict=True)]


def _thin(on: np.ndarray, held: np.ndarray, flat: np.ndarray, passes: int | None, origin: tuple[int, int, int]) -> None:
    """Passes over a volume with a margin, in place; ``held`` are the places of its voxels, ``flat`` their images' flat axes as bits."""
    cells, shape = on.ravel(), on.shape
    strides = (shape[1] * shape[2], shape[2], 1)
    steps = [sum(a * b for a, b in zip(c, strides, strict=True)) for c in CELLS]
    while passes is None or passes > 0:
        border = np.zeros(len(held), bool)
        for n in FACES:
            axis = [abs(x) for x in CELLS[n]].index(1)
            border |= ~cells[held + steps[n]] & (flat >> axis & 1 == 0)
        at = held[border]
        near = sum(cells[at + step].astype(np.int8) for step in steps)
        at = at[near > 2]  # itself, and more than the one neighbour of an end
        place = np.unravel_index(at, shape)
        colour = sum(((p - 1 + o) & 1) << (2 - k) for k, (p, o) in enumerate(zip(place, origin, strict=True)))
        gone = 0
        for k in range(8):
            own = at[colour == k]
            if not len(own):
                continue
            code = np.zeros(len(own), np.int32)
            for n, step in enumerate(steps):
                code |= cells[own + step].astype(np.int32) << n
            own = own[simple(code)]
            cells[own] = False
            gone += len(own)
        if not gone:
            break
        kept = cells[held]
        held, flat = held[kept], flat[kept]
        passes = None if passes is None else passes - 1


def boxes(voxels: DataFrame) -> DataFrame:
    """(image_id, cells, flat): the cells of each image's box, and its axes of one voxel as bits."""
    side = [F.max(a).cast("long") - F.min(a) + 1 for a in AT[1:]]
    n = voxels.groupBy("image_id").agg(*(s.alias(f"n{k}") for k, s in enumerate(side)))
    cells = F.col("n0").cast("double") * F.col("n1") * F.col("n2")
    return n.select("image_id", cells.alias("cells"), sum(((F.col(f"n{k}") == 1).cast("int") * (1 << k) for k in (1, 2)), (F.col("n0") == 1).cast("int")).alias("flat"))


def skeletons(voxels: DataFrame, box: int = BOX, passes: int = PASSES, side: int = SIDE, words: int = WORDS) -> DataFrame:
    """Skeletons of all images: those of a small box in one task each, others tile by tile."""
    voxels = stored(voxels.select(*AT))
    sized = stored(boxes(voxels))
    large = sized.where(F.col("cells") > box)
    if large.isEmpty():
        return in_one_task(voxels)
    small = in_one_task(voxels.join(large, "image_id", "left_anti"))
    return small.unionByName(in_tiles(voxels.join(large.select("image_id", "flat"), "image_id"), passes, side, words))


def in_one_task(voxels: DataFrame) -> DataFrame:
    """Every image in one task; small ones of a batch are thinned together."""

    def of_images(groups: list[tuple[tuple[int, ...], np.ndarray]]) -> list[pd.DataFrame]:
        out, some, wide, high = [], [], np.zeros(2, np.int64), 0
        for key, at in [*groups, (None, None)]:
            size = None if at is None else np.ptp(at, 0) + 4
            if some and (size is None or (high + size[0]) * np.prod(np.maximum(wide, size[1:])) > BOX):
                left = thinned_together([own for _, own in some])
                z, r, c = np.concatenate(left).T.astype("int32")
                out.append(pd.DataFrame({"image_id": np.repeat([k for k, _ in some], [*map(len, left)]), "z": z, "r": r, "c": c}))
                some, wide, high = [], np.zeros(2, np.int64), 0
            if at is not None:
                some.append((key[0], at))
                wide, high = np.maximum(wide, size[1:]), high + size[0]
        return out

    return by_batches(voxels.select(*AT), 1, of_images, "image_id long, z int, r int, c int")


def packed(voxels: DataFrame) -> DataFrame:
    """(image_id, flat, z, r, w, bits): 64 voxels along c a row."""
    bit = F.expr("shiftleft(1L, c & 63)")
    return voxels.groupBy("image_id", "flat", "z", "r", F.shiftright("c", 6).alias("w")).agg(F.bit_or(bit).alias("bits"))


def unpacked(rows: DataFrame) -> DataFrame:
    c = F.explode(F.expr("filter(sequence(0, 63), i -> (shiftright(bits, i) & 1) = 1)"))
    return rows.select("image_id", "z", "r", "w", c.alias("i")).select("image_id", F.col("z").cast("int").alias("z"), F.col("r").cast("int").alias("r"), (F.col("w") * 64 + F.col("i")).cast("int").alias("c"))


def in_tiles(voxels: DataFrame, passes: int = PASSES, side: int = SIDE, words: int = WORDS) -> DataFrame:
    """Images of voxels (image_id, flat, z, r, c), however large: rounds of passes over tiles until none loses a voxel."""
    state = stored(packed(voxels))
    done, halo = None, passes * REACH
    wide = -(-halo // 64)

    def dealt(rows: DataFrame) -> DataFrame:
        near = lambda a, h, t: F.explode(F.sequence(F.floor((F.col(a) - h) / t), F.floor((F.col(a) + h) / t)))
        tiles = rows.withColumn("tz", near("z", halo, side)).withColumn("tr", near("r", halo, side)).withColumn("tw", near("w", wide, words))
        return tiles.select("image_id", "flat", "tz", "tr", "tw", "z", "r", "w", "bits")

    def of_tile(key: tuple[int, ...], rows: np.ndarray) -> list[pd.DataFrame]:
        image, flat, *tile = key
        low = [tile[0] * side - halo, tile[1] * side - halo, tile[2] * words - wide]
        held = np.zeros((side + 2 * halo, side + 2 * halo, words + 2 * wide), "<i8")
        held[tuple(rows[:, k] - low[k] for k in range(3))] = rows[:, 3]
        volume = np.unpackbits(held.view(np.uint8), axis=2, bitorder="little").astype(bool)
        out = thinned(volume, tuple(bool(flat >> k & 1) for k in range(3)), passes, (low[0], low[1], low[2] * 64))
        out = np.packbits(out, axis=2, bitorder="little").view("<i8")[halo:-halo, halo:-halo, wide:-wide]
        z, r, w = np.nonzero(out)
        return [pd.DataFrame({"image_id": image, "flat": flat, "z": z + low[0] + halo, "r": r + low[1] + halo, "w": w + low[2] + wide, "bits": out[z, r, w]})]

    def sizes(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("image_id").agg(F.sum(F.bit_count("bits")).alias(name))

    while True:
        after = stored(by_keys(dealt(state), 5, of_tile, "image_id long, flat int, z long, r long, w long, bits long"))
        moved = stored(sizes(state, "n").join(sizes(after, "m"), "image_id").where("n <> m").select("image_id"))
        settled = after.join(moved, "image_id", "left_anti")
        done = settled if done is None else done.unionByName(settled)
        if moved.isEmpty():
            return unpacked(done)
        forget(state)
        state = stored(after.join(moved, "image_id", "left_semi"))
