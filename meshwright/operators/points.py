"""Graphs from points: cutoff and nearest-neighbour rules by bucketed joins."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain, pairwise, product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .iterate import stored

AXES = ("x", "y", "z")


def _cubes_around(keys: list[Column], periods: list[int] | None) -> Column:
    """Cubes a point is sent to, and whether one is its own: half of the 26 around, as the other half sends here; with periods all, wrapped round, once each."""
    steps = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if periods or (a, b, c) >= (0, 0, 0)]
    wrap = lambda c, i: F.pmod(c, F.lit(periods[i])) if periods else c
    cube = lambda step: F.struct(*(wrap(k + s, i).cast("long").alias(n) for i, (k, s, n) in enumerate(zip(keys, step, "uvw", strict=True))))
    return F.array_distinct(F.array(*(F.struct(cube(step).alias("cube"), F.lit(bool(periods) or step == (0, 0, 0)).alias("own")) for step in steps)))


def cutoff_graph(points: DataFrame, r_max: float, group: tuple[str, ...] = (), box: tuple[float, float, float] | None = None) -> DataFrame:
    """Pairs src < dst within ``r_max``, with their length, per group; ``box``: minimum-image distance.

    Points are dealt into cubes of side ``r_max``; one side is sent to its own and
    to half of the cubes around, so an equi-join on the cube finds every pair once.
    """
    g = list(group)
    if box:
        periods = [max(1, int(side // r_max)) for side in box]
        sides = [side / n for side, n in zip(box, periods, strict=True)]
        at = [F.pmod(F.floor((F.col(a) - F.floor(F.col(a) / side) * side) / s), F.lit(n)).cast("long") for a, side, s, n in zip(AXES, box, sides, periods, strict=True)]
    else:
        periods, at = None, [F.floor(F.col(a) / r_max).cast("long") for a in AXES]
    own = points.select(*g, "pid", *AXES, F.struct(*(k.alias(n) for k, n in zip(at, "uvw", strict=True))).alias("cube"))
    sent = own.select(*g, F.col("pid").alias("p"), *(F.col(a).alias(f"{a}0") for a in AXES), F.explode(_cubes_around([F.col("cube.u"), F.col("cube.v"), F.col("cube.w")], periods)).alias("to"))
    left = sent.select(*g, "p", *(f"{a}0" for a in AXES), F.col("to.cube").alias("cube"), F.col("to.own").alias("own"))
    right = own.withColumnRenamed("pid", "q")
    steps = []
    for i, a in enumerate(AXES):
        d = F.col(a) - F.col(f"{a}0")
        steps.append(d - F.lit(box[i]) * F.rint(d / box[i]) if box else d)  # a half rounds either way to the same distance
    length = F.sqrt(reduce(lambda p, q: p + q, (d * d for d in steps)))
    pairs = left.join(right, [*g, "cube"]).where("NOT own OR p < q").select(*g, F.least("p", "q").alias("src"), F.greatest("p", "q").alias("dst"), length.alias("length"))
    return pairs.where(F.col("length") <= r_max)


#: Points that a task holds to find pairs in their order, about 140 bytes each; and pairs in a batch.
MOST_POINTS, BATCH = 2_000_000, 1 << 17


def cutoff_in_order(points: DataFrame, r_max: float) -> DataFrame:
    """The pairs and lengths of ``cutoff_graph``, sorted by src and dst over all partitions, without a shuffle of pairs.

    Every task gets all points, up to ``MOST_POINTS`` (counted first), and a range of
    ids: for each of them it looks at the points of the 27 cubes around, which are kept
    by id, so pairs come out sorted. Ranges of low ids are shorter, as such points have
    more others above them. More points than that are paired and sorted by shuffles.
    """
    spark, kind = points.sparkSession, dict(points.dtypes)["pid"]
    finite = reduce(lambda p, q: p & q, (F.abs(F.col(a).cast("double")) < float("inf") for a in AXES))  # nor null or NaN
    own = stored(points.where(finite & F.col("pid").isNotNull()).select("pid", *(F.col(a).cast("double").alias(a) for a in AXES)))
    n = own.count()
    if n > MOST_POINTS:
        return cutoff_graph(own, r_max).orderBy("src", "dst")
    tasks = max(1, min(4 * spark.sparkContext.defaultParallelism, n // 64))
    ends = (n * (1 - np.sqrt(1 - np.arange(tasks + 1) / tasks))).astype(int)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        every = pa.Table.from_batches(held)
        part = every["part"][0].as_py()
        ids = every["pid"].to_pandas().to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, xyz = ids[order], np.stack([every[a].to_numpy()[order] for a in AXES])
        for src, dst, length in _in_order(ids, xyz, r_max, ends[part], ends[part + 1]):
            yield pa.RecordBatch.from_pandas(pd.DataFrame({"src": ids[src], "dst": ids[dst], "length": length}), preserve_index=False)

    dealt = own.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    return dealt.repartitionById(tasks, F.col("part")).mapInArrow(run, f"src {kind}, dst {kind}, length double")


def _in_order(ids: np.ndarray, xyz: np.ndarray, r_max: float, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of pairs within ``r_max``, and lengths, from each of the points low to high - 1 to those of larger ids; ``ids`` are sorted."""
    cube, of = np.unique(np.floor(xyz.T / r_max), axis=0, return_inverse=True)
    of, place = of.ravel(), {tuple(c): k for k, c in enumerate(cube.tolist())}
    members = np.split(np.argsort(of, kind="stable").astype(np.int32), np.cumsum(np.bincount(of))[:-1])
    around: dict[int, np.ndarray] = {}  # of each cube that is asked for, the points of the cubes around, by id
    above, held, rows = np.searchsorted(ids, ids, "right"), [], 0
    for s in range(low, high):
        if (near := around.get(of[s])) is None:
            u, v, w = cube[of[s]].tolist()
            near = around[of[s]] = np.sort(np.concatenate([members[k] for a, b, c in product((-1, 0, 1), repeat=3) if (k := place.get((u + a, v + b, w + c))) is not None]))
        near = near[np.searchsorted(near, above[s]) :]
        x, y, z = (axis[near] - axis[s] for axis in xyz)
        length = np.sqrt(x * x + y * y + z * z)
        hit = np.flatnonzero(length <= r_max)
        held.append((np.full(len(hit), s), near[hit], length[hit]))
        rows += len(hit)
        if rows >= BATCH or s == high - 1:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, rows = [], 0


#: Sides of cells to a radius: two points of one cell are nearer than it, by a share that rounding does not reach.
CELLS = 1.74


def linked(points: DataFrame, r_max: float, group: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (src, dst) within ``r_max``, per group, that join the same points as all pairs of ``cutoff_graph`` do, some for each point.

    All points of a cell of side ``r_max / CELLS`` are within ``r_max``, so each is tied
    to the cell's least. Of two cells near each other one pair within ``r_max`` is
    enough: a point is sent only to those cells, in one half of the directions, whose
    box it may reach, and a task looks at blocks of the pairs until one is found.
    """
    g, side = list(group), r_max / CELLS
    finite = reduce(lambda p, q: p & q, (F.abs(F.col(a).cast("double")) < float("inf") for a in AXES))
    at = [F.floor(F.col(a) / side).cast("long").alias(n) for a, n in zip(AXES, "uvw", strict=True)]
    own = stored(points.where(finite).select(*g, "pid", *(F.col(a).cast("double").alias(a) for a in AXES), *at))
    cell = [*g, "u", "v", "w"]
    least = own.groupBy(*cell).agg(F.min("pid").alias("src"))
    ties = own.join(least, cell).where("src <> pid").select("src", F.col("pid").alias("dst"))

    #: a pair of cells is named by its first cell and the number of its step: a point goes there as one of its first cell's, or of the other's
    ways = [(n, first, s, tuple(x if first else -x for x in s)) for n, s in enumerate(s for s in product(range(-2, 3), repeat=3) if s > (0, 0, 0)) for first in (True, False)]
    every = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(first).alias("first"), *(F.lit(0 if first else -x).alias(f"to_{k}") for k, x in zip("uvw", s, strict=True)), *(F.lit(x).alias(k) for k, x in zip("uvw", to, strict=True))) for n, first, s, to in ways))

    def reaches(way: Column) -> Column:
        """Whether a point is within the radius of the cell so many steps on, widened a little."""
        low = [(F.col(k) + way[k]) * F.lit(side) - F.col(a) for a, k in zip(AXES, "uvw", strict=True)]
        gaps = [F.greatest(x, -x - F.lit(side), F.lit(0.0)) for x in low]
        return gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2] <= (r_max * 1.000001) ** 2

    places = own.groupBy(*cell, *AXES).agg(F.min("pid").alias("pid"))
    sent = places.withColumn("to", F.explode(F.filter(every, reaches))).select(*g, *((F.col(k) + F.col(f"to.to_{k}")).alias(k) for k in "uvw"), F.col("to.n").alias("n"), F.col("to.first").alias("first"), "pid", *AXES)
    kind, names = dict(points.dtypes), [*cell, "n"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # of a pair of cells that may go on in the next batch
        for frame in chain(batches, [None]):
            rows = pd.concat([*held, *([] if frame is None else [frame])], ignore_index=True) if held or frame is not None else []
            if not len(rows):
                continue
            at = rows[names].to_numpy()
            ends = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1).tolist(), *([len(rows)] if frame is None else [])]
            held = [] if frame is None else [rows.iloc[ends[-1] :]]
            ids, first, xyz = rows["pid"].to_numpy(), rows["first"].to_numpy(), rows[[*AXES]].to_numpy()
            found = [(ids[a + p], ids[a + q]) for a, b in pairwise(ends) if (hit := _one_within(first[a:b], xyz[a:b], r_max)) for p, q in [hit]]
            yield pd.DataFrame(found, columns=["src", "dst"]).astype({"src": ids.dtype, "dst": ids.dtype})

    spread = sent.repartition(*names).sortWithinPartitions(*names, "pid")
    return ties.unionByName(spread.mapInPandas(run, f"src {kind['pid']}, dst {kind['pid']}"))


def _one_within(first: np.ndarray, xyz: np.ndarray, r_max: float) -> tuple[int, int] | None:
    """Places of a point of the first and one of the other cell within ``r_max``, if there are any; blocks of 256 by 256."""
    a, b = np.flatnonzero(first), np.flatnonzero(~first)
    for i in range(0, len(a), 256):
        for j in range(0, len(b), 256):
            p, q = xyz[a[i : i + 256]], xyz[b[j : j + 256]]
            d = q[None] - p[:, None]
            hit = np.sqrt(d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2]) <= r_max
            if hit.any():
                k = int(hit.argmax())
                return int(a[i + k // len(q)]), int(b[j + k % len(q)])
    return None


#: Points of the sample that radii are guessed from.
SAMPLE = 2000


def guessed(points: DataFrame, k: int, n: int) -> DataFrame:
    """``points`` with ``level`` and ``most``: the binary exponents of a radius that should hold some k others, and of one that surely does.

    Both come from the distance to the k-th nearest of a sample: the sample's points
    are points, so that many lie within; fewer points are nearer by as much as the
    sample is thinner, to the power of one over the number of axes that vary.
    """
    at = [F.col(a).cast("double").alias(a) for a in AXES]
    held = points.orderBy(F.xxhash64("pid", *AXES), "pid").select(*at).limit(max(SAMPLE, 2 * k)).toPandas().to_numpy(float)  # so many rows
    farthest = points.agg(F.max(F.greatest(*(F.abs(F.col(a).cast("double")) for a in AXES)))).first()[0] or 1.0
    ends = np.ceil(np.log2(farthest)) + np.array([-50, 3])  # cubes are told apart by 50 bits; the largest radius holds all
    axes = max(1, int((held.max(0) > held.min(0)).sum()))
    thinner = (len(held) / n) ** (1 / axes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            xyz, bound = frame[[*AXES]].to_numpy(float), [np.zeros(0)]
            for some in np.array_split(xyz, -(-len(xyz) // 256)):
                gap = ((some[:, None, :] - held[None]) ** 2).sum(2)
                bound.append(np.sqrt(np.partition(gap, k, 1)[:, k]))  # a point may be in the sample itself
            most = np.concatenate(bound)
            with np.errstate(divide="ignore"):
                level, sure = (np.ceil(np.clip(np.log2(x * 1.000001), *ends)).astype("int32") for x in (most * thinner, most))
            yield frame.assign(level=level, most=sure)

    kind = dict(points.dtypes)["pid"]
    return points.select("pid", *at).mapInPandas(run, f"pid {kind}, x double, y double, z double, level int, most int")


def within(queries: DataFrame, points: DataFrame) -> DataFrame:
    """(src, dst, length) for every query and every other point within 2 to the query's ``level``: queries are sent to the 27 cubes of that side around, points to their cube of every side that is asked for."""
    levels = [r["level"] for r in queries.select("level").distinct().collect()]  # binary exponents
    side = F.pow(F.lit(2.0), F.col("level"))
    at = [F.floor(F.col(a) / side).cast("long") for a in AXES]
    cubes = F.array(*(F.struct(*((c + s).alias(n) for c, s, n in zip(at, step, "uvw", strict=True))) for step in product((-1, 0, 1), repeat=3)))
    asked = queries.select(F.col("pid").alias("src"), "level", *(F.col(a).alias(f"{a}0") for a in AXES), F.explode(cubes).alias("cube"))
    sent = points.select(F.col("pid").alias("dst"), *AXES, F.explode(F.array(*map(F.lit, levels))).alias("level"))
    held = sent.select("dst", *AXES, "level", F.struct(*(c.alias(n) for c, n in zip(at, "uvw", strict=True))).alias("cube"))
    gap = [F.col(a) - F.col(f"{a}0") for a in AXES]
    length = F.sqrt(gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2])
    return asked.join(held, ["level", "cube"]).where("src <> dst").withColumn("length", length).where(F.col("length") <= side).select("src", "dst", "length")


def nearest(points: DataFrame, k: int) -> DataFrame:
    """(src, dst, length, rank) of the k nearest others of every point, however far; ties by pid.

    Every point asks with a radius that suits the density around it, guessed from a
    sample, so clusters and outliers each look into cubes of their own size. Points
    that find fewer than k ask again with twice the radius, at most the one that
    surely holds k. Of points in one place only the k + 1 with the least ids can be
    anyone's neighbours; the others ask and are not asked for.
    """
    finite = reduce(lambda p, q: p & q, (F.abs(F.col(a).cast("double")) < float("inf") for a in AXES))  # nor null or NaN
    own = stored(points.select("pid", *AXES).where(finite))
    n = own.count()
    least = min(k, n - 1)
    if least < 1:
        return own.limit(0).select(F.col("pid").alias("src"), F.col("pid").alias("dst"), F.lit(0.0).alias("length"), F.lit(0).alias("rank"))
    place = F.row_number().over(Window.partitionBy(*AXES).orderBy("pid"))
    asked_for = stored(own.withColumn("place", place).where(F.col("place") <= k + 1).select("pid", *AXES))
    open_, found = stored(guessed(own, least, n)), None
    rank = F.row_number().over(Window.partitionBy("src").orderBy("length", "dst"))
    while True:
        near = stored(within(open_, asked_for).withColumn("rank", rank).where(F.col("rank") <= k))
        done = near.groupBy(F.col("src").alias("pid")).agg(F.count("*").alias("n")).where(F.col("n") >= least).select("pid")
        got = near.join(done.withColumnRenamed("pid", "src"), "src", "left_semi")
        found = got if found is None else found.unionByName(got)
        open_ = stored(open_.join(done, "pid", "left_anti").withColumn("level", F.least(F.col("level") + 1, F.greatest("most", "level"))))
        if open_.isEmpty():
            return found


def knn_graph(points: DataFrame, k: int, r_max: float | None = None) -> DataFrame:
    """Pairs (query, point, rank) of the k nearest, within ``r_max`` if it is given, of which those with query < point are edges."""
    near = nearest(points, k).where("src < dst")
    return near if r_max is None else near.where(F.col("length") <= r_max)  # ranks within a radius are ranks among all


def edge_list_graph(points: DataFrame, bonds: DataFrame) -> DataFrame:
    """Given pairs with the distance of their ends; pairs with an unknown end are dropped."""
    p = lambda n: points.select(F.col("pid").alias(n), F.struct(*AXES).alias(f"{n}_at"))
    at = bonds.join(p("src"), "src").join(p("dst"), "dst")
    gap = lambda a: F.col(f"dst_at.{a}") - F.col(f"src_at.{a}")
    return at.select("src", "dst", F.sqrt(sum((gap(a) * gap(a) for a in AXES[1:]), gap("x") * gap("x"))).alias("length"))


def bounding_box(points: DataFrame, periodic: bool = False) -> DataFrame:
    """One row of box sides: the largest value on each axis, doubled unless periodic, so that no image is near."""
    return points.agg(*((F.max(a) * (1 if periodic else 2)).alias(f"l{a}") for a in AXES))


def with_neighbours(points: DataFrame, edges: DataFrame, group: tuple[str, ...] = (), keep_isolated: bool = False) -> DataFrame:
    """The points that some edge has; all, if isolated ones are kept."""
    if keep_isolated:
        return points
    ends = edges.select(*group, F.explode(F.array("src", "dst")).alias("pid")).distinct()
    return points.join(ends, [*group, "pid"], "left_semi")


def induced(edges: DataFrame, vertices: DataFrame, key: str = "pid") -> DataFrame:
    """Edges with both ends among the vertices."""
    kept = vertices.select(F.col(key))
    return edges.join(kept.withColumnRenamed(key, "src"), "src", "left_semi").join(kept.withColumnRenamed(key, "dst"), "dst", "left_semi")
