"""Graphs of near points whose edges tasks find themselves: the points are dealt out, never the edges.

Edges of such a graph grow with the square of its points. A task that gets all
points finds the neighbours it needs in columns of cells, so what is shuffled
are the points times the tasks, and no table of edges is made, sorted or sent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import NetworkFrame
from .iterate import ranked, stored

AXES = ("x", "y", "z")
#: Points of a graph that go to every task, some 150 bytes each there; and pairs that are looked at in one piece.
MOST_POINTS, PIECE = 2_000_000, 1 << 20


@dataclass(frozen=True)
class PointGraph(NetworkFrame):
    """The pairs within ``r_max`` of vertices (id, x, y, z, ...); ``edges`` is their table, for those who need one."""

    r_max: float
    known: dict = field(default_factory=dict, compare=False, repr=False)

    def points(self) -> DataFrame | None:
        """(at, id, x, y, z), numbered from 0, of vertices that may go to every task; none if they are too many, or if an id is null or comes twice. Coordinates that are not finite are NaN."""
        if "points" not in self.known:
            at = [F.col(a).cast("double").alias(a) for a in AXES]
            finite = reduce(lambda p, q: p & q, (F.abs(F.col(a)) < float("inf") for a in AXES))
            own = self.vertices.select("id", *at).select("id", *(F.when(finite, F.col(a)).otherwise(float("nan")).alias(a) for a in AXES))
            plain = self.vertices.limit(MOST_POINTS + 1).count() <= MOST_POINTS
            if plain:
                own = stored(own)
                n, n_ids = own.agg(F.count("*"), F.count_distinct("id")).first()
                plain = n == n_ids  # nulls are not counted as ids
            self.known["points"] = stored(ranked(own, [], ["id"], "at").select(F.col("at").cast("int").alias("at"), "id", *AXES)) if plain else None
        return self.known["points"]

    def n_near(self) -> int:
        """How many neighbours all vertices have together, counted by tasks that get all points."""
        if "n_near" not in self.known:
            def run(ids, cloud, flags, part, tasks):
                yield pd.DataFrame({"n": [sum(len(near) for _, near in cloud.neighbours(part, tasks))]})

            self.known["n_near"] = on_points(self, {}, run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        return self.known["n_near"]


class Cloud:
    """Points sorted into columns of cells of half the radius, so that those a column's cells may reach are some ranges."""

    def __init__(self, xyz: np.ndarray, r_max: float) -> None:
        side = r_max / 2 * (1 + 1e-9)  # so that rounding leaves no pair beyond two cells
        with np.errstate(over="ignore"):
            cells = np.floor(xyz / side)
        for k in range(3):  # places on an axis, with gaps of more than two as three
            values, of = np.unique(cells[:, k], return_inverse=True)
            with np.errstate(invalid="ignore"):
                gaps = np.minimum(np.nan_to_num(np.diff(values), nan=3.0), 3.0)
            cells[:, k] = np.concatenate([[0.0], np.cumsum(gaps)])[of]
        self.blank = np.isnan(xyz).any(1)
        self.order = np.lexsort((*cells.T[::-1], self.blank))
        self.n = int((~self.blank).sum())
        self.xyz, self.r_max = xyz[self.order], r_max
        cells = cells[self.order][: self.n].astype(np.int64)
        wide, tall = (int(cells[:, k].max(initial=0)) + 6 for k in (1, 2))
        columns, self.first, of = np.unique(cells[:, 0] * wide + cells[:, 1] + 2, return_index=True, return_inverse=True)
        self.columns, self.wide, self.tall = columns, wide, tall
        key = of * tall + cells[:, 2] + 2  # sorted
        self.cells, at, size = np.unique(key, return_index=True, return_counts=True)
        self.at, self.ends, self.key = at, np.append(at, self.n), key

    def around(self, cell: int) -> list[tuple[int, int]]:
        """Ranges of the points of the cells up to two from one of ``cells``."""
        column, level = divmod(int(self.cells[cell]), self.tall)
        steps = (self.columns[column] + np.arange(-2, 3)[:, None] * self.wide + np.arange(-2, 3)).ravel()
        found = np.minimum(np.searchsorted(self.columns, steps), len(self.columns) - 1)
        own = found[self.columns[found] == steps] * self.tall + level
        low, high = np.searchsorted(self.key, own - 2), np.searchsorted(self.key, own + 2, "right")
        return [(a, b) for a, b in zip(low.tolist(), high.tolist(), strict=True) if a < b]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """The cells around each cell, one after the other, and where each cell's begin."""
        own = [np.concatenate([np.arange(a, b) for a, b in np.searchsorted(self.at, self.around(cell)).tolist()]) for cell in range(len(self.cells))]
        return np.concatenate(own), np.cumsum([0, *map(len, own)])[:-1]

    def candidates(self, cell: int) -> np.ndarray:
        return np.concatenate([np.arange(a, b) for a, b in self.around(cell)])

    def lengths(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Distances, as ``points.cutoff_graph`` takes them."""
        total = None
        for axis in self.xyz.T:
            d = axis[rows][:, None] - axis[columns][None]
            d *= d
            total = d if total is None else np.add(total, d, out=total)
        return np.sqrt(total, out=total)

    def tiles(self, part: int = 0, parts: int = 1, low: int = 0, high: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, columns, whether they are near) of cells' points, from low up to high, and of all that are around them; a point is near itself."""
        high = self.n if high is None else high
        for cell in range(np.searchsorted(self.ends, low, "right") - 1 + part, np.searchsorted(self.at, high), parts):
            own, columns = np.arange(max(low, self.ends[cell]), min(high, self.ends[cell + 1])), self.candidates(cell)
            per = max(1, PIECE // len(columns))
            for k in range(0, len(own), per):
                rows = own[k : k + per]
                yield rows, columns, self.lengths(rows, columns) <= self.r_max

    def neighbours(self, part: int = 0, parts: int = 1) -> Iterator[tuple[int, np.ndarray]]:
        """(place, places of its neighbours) of every vertex that a part's cells hold."""
        for rows, columns, near in self.tiles(part, parts):
            near[np.arange(len(rows)), np.searchsorted(columns, rows)] = False
            size = np.cumsum(near.sum(1))
            flat = columns[np.nonzero(near)[1]].astype(np.int32)
            yield from zip(rows.tolist(), np.split(flat, size[:-1]), strict=True)

    def lists(self, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, size, to): the neighbours of all vertices, of which there are ``most``."""
        n = len(self.xyz)
        start, size, to, filled = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(most, np.int32), 0
        for rows, columns, near in self.tiles():
            near[np.arange(len(rows)), np.searchsorted(columns, rows)] = False
            flat = columns[np.nonzero(near)[1]]
            size[rows] = near.sum(1)
            start[rows] = filled + np.cumsum(size[rows]) - size[rows]
            to[filled : filled + len(flat)] = flat
            filled += len(flat)
        return start, size, to


    def bits(self, low: int, high: int) -> tuple[int, np.ndarray]:
        """The neighbours of the points from low up to high as bits in words, and how many words before come to nothing."""
        cells = range(np.searchsorted(self.ends, low, "right") - 1, np.searchsorted(self.at, high))
        ranges = [ends for cell in cells for ends in self.around(cell)]
        first, last = min(a for a, _ in ranges) // 64, -(-max(b for _, b in ranges) // 64)
        out = np.zeros((high - low, last - first), np.uint64)
        for rows, columns, near in self.tiles(low=low, high=high):
            near[np.arange(len(rows)), np.searchsorted(columns, rows)] = False
            flag = np.zeros((len(rows), 64 * (last - first)), bool)
            flag[:, columns - 64 * first] = near
            out[rows - low] = np.packbits(flag, axis=1, bitorder="little").view(np.uint64)
        return first, out


def on_points(g: PointGraph, flags: dict[str, DataFrame], kernel: Callable[..., Iterator[pd.DataFrame]], schema: str, tasks: int | None = None) -> DataFrame:
    """What ``kernel`` yields for the ids, all points, which of them are among each of ``flags``, a task's number and how many there are; ids and flags are in the points' order."""
    spark, rows = g.edges.sparkSession, g.points()
    for flag, some in flags.items():
        rows = rows.join(some.select("id").distinct().withColumn(flag, F.lit(True)), "id", "left")
    rows = stored(rows.select("at", "id", *AXES, *(F.coalesce(flag, F.lit(False)).alias(flag) for flag in flags)))
    tasks = max(1, min(tasks or spark.sparkContext.defaultParallelism, rows.count()))
    r_max, names = g.r_max, list(flags)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        every = pa.Table.from_batches(held)
        part, order = every["part"][0].as_py(), np.argsort(every["at"].to_numpy())
        cloud = Cloud(np.stack([every[a].to_numpy()[order] for a in AXES], 1), r_max)
        order = order[cloud.order]
        ids, of = every["id"].to_pandas().to_numpy()[order], {name: every[name].to_numpy()[order] for name in names}
        for frame in kernel(ids, cloud, of, part, tasks):
            yield from pa.Table.from_pandas(frame, preserve_index=False).to_batches()

    return rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))).repartitionById(tasks, F.col("part")).mapInArrow(run, schema)


@dataclass(frozen=True)
class PointGraphs(NetworkFrame):
    """Graphs told apart by ``by``: of each the pairs within ``r_max`` of its vertices (by, id, x, y, z, ...).

    Weights are named functions of the length. ``ties`` (by, src, dst) are further
    edges, from vertices that are no points to some that are, of their graph's mean weight.
    """

    r_max: float
    by: str
    weights: dict[str, Callable[[np.ndarray], np.ndarray]]
    ties: DataFrame | None = None
    tied_by: str | None = None


#: Points of a graph between which distances are taken at a time.
BLOCK = 512


class Blocks:
    """Points of several graphs, one after the other, in blocks of near ones; ``at`` is where each of them is among the caller's."""

    def __init__(self, of: np.ndarray, xyz: np.ndarray, r_max: float) -> None:
        self.r_max, parts = r_max, []
        for graph in np.unique(of):
            todo = [np.flatnonzero(of == graph)]
            while todo:
                own = todo.pop()
                if len(own) <= BLOCK:
                    parts.append(own)
                    continue
                axis = int(np.argmax(np.ptp(np.nan_to_num(xyz[own]), axis=0)))
                half = np.argpartition(xyz[own, axis], len(own) // 2)
                todo += [own[half[len(own) // 2 :]], own[half[: len(own) // 2]]]
        self.at = np.concatenate([*parts, np.zeros(0, int)])
        self.ends = np.cumsum([0, *map(len, parts)])
        self.xyz = np.ascontiguousarray(xyz[self.at].T)
        self.of = [of[p[0]] for p in parts]
        low, high = (np.array([f(xyz[p], axis=0) for p in parts]).reshape(-1, 3) for f in (np.min, np.max))
        self.low, self.high = low - r_max * 1e-9, high + r_max * 1e-9

    def pairs(self) -> list[tuple[int, int]]:
        """Blocks of one graph, a block and itself or a later one, that some pair may be near between."""
        out = []
        for i in range(len(self.of)):
            j = np.arange(i, np.searchsorted(self.of, self.of[i], "right"))
            gap = np.maximum(0, np.maximum(self.low[j] - self.high[i], self.low[i] - self.high[j]))
            out += [(i, int(k)) for k in j[(gap * gap).sum(1) <= (self.r_max * 1.000001) ** 2]]
        return out

    def tile(self, i: int, j: int) -> tuple[slice, slice, np.ndarray, np.ndarray]:
        """Places of two blocks' points, their lengths, and which are near; of a block and itself each pair once."""
        rows, columns = slice(self.ends[i], self.ends[i + 1]), slice(self.ends[j], self.ends[j + 1])
        total = None
        for axis in self.xyz:
            d = axis[rows, None] - axis[None, columns]
            d *= d
            total = d if total is None else np.add(total, d, out=total)
        length = np.sqrt(total, out=total)
        near = length <= self.r_max
        return rows, columns, length, np.triu(near, 1) if i == j else near


#: Points of a graph between which all numbers are held in a task: a matrix of 1.15 GB.
MOST_DENSE = 12_000


def dense(g: NetworkFrame, by: str | None, few: int, *weights: str | None) -> bool:
    """Whether graphs are of points, some of more than a few, and all few enough for a task that takes the distances in a graph itself."""
    if not isinstance(g, PointGraphs) or by != g.by or g.ties is not None or not set(weights) <= {*g.weights}:
        return False
    most = g.vertices.groupBy(by).count().agg(F.max("count")).first()[0] or 0
    return few < most <= MOST_DENSE


def each_graph(g: PointGraphs, kernel: Callable[..., Iterator[pd.DataFrame]], schema: str, columns: list[str], most: int) -> DataFrame:
    """What ``kernel`` yields for a graph's name, its vertices by id (id, x, y, z and ``columns``), a part's number and how many there are: up to ``most`` tasks a graph, if there are few graphs."""
    spark = g.vertices.sparkSession
    own = stored(g.vertices.select(F.col(g.by).alias("of"), "id", *(F.col(a).cast("double").alias(a) for a in AXES), *columns).dropDuplicates(["of", "id"]))
    sizes = own.groupBy("of").agg(F.count("*").alias("n"))
    parts = max(1, min(most, spark.sparkContext.defaultParallelism // max(1, sizes.count())))
    sizes = sizes.select(F.col("of").alias("name"), "n", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    sizes = stored(sizes.select("name", "part", (F.row_number().over(Window.orderBy(F.desc("n"), "name", "part")) - 1).alias("task")))  # a row per task
    tasks = max(1, sizes.count())
    dealt = own.join(sizes, own["of"] == sizes["name"]).drop("name").repartitionById(tasks, F.col("task"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if own := [f for f in frames if len(f)]:
            v = pd.concat(own).sort_values("id", ignore_index=True)
            yield from kernel(v["of"].iat[0], v, int(v["part"].iat[0]), parts)

    return dealt.mapInPandas(run, schema)


def stripes(v: pd.DataFrame, r_max: float, rows: int = 256) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Some vertices after the others: their distances to all, and which are near; none is near itself."""
    xyz = v[[*AXES]].to_numpy(float).T
    for k in range(0, len(v), rows):
        own, total = slice(k, min(k + rows, len(v))), None
        for axis in xyz:
            d = axis[own, None] - axis
            d *= d
            total = d if total is None else np.add(total, d, out=total)
        length = np.sqrt(total, out=total)
        near = length <= r_max
        near[np.arange(own.stop - k), np.arange(k, own.stop)] = False
        yield own, length, near
