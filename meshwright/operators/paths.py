"""Shortest paths and what is counted along them.

The graph goes to every worker as arrays if its edges are at most ``MOST_EDGES``
(counted first); sources are then spread over tasks, whole levels of vertices are
expanded at once, and what a measure needs of a source is reduced before it
leaves the task. Partial sums meet in one aggregate.

A larger graph stays in tables. Steps from all sources at once are taken as
bits, 64 sources to a long and a row per vertex in reach of any of them; weighted
distances come from a frontier join. Paths are counted hop by hop along the
edges that shortest paths use, and shared out backwards, deepest vertices first.
Sources come in blocks, so that no table of all pairs is ever held.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidArgumentsError
from ..schema import NetworkFrame, both_ways, simple
from . import near, waves
from .waves import of_points
from .components import components
from .iterate import forget, stored

#: Edges, and vertices, of a graph that goes to every worker.
MOST_EDGES = 5_000_000
#: Rows of (source or 64 sources, vertex) that a block of sources makes at most.
BLOCK_ROWS = 50_000_000
#: Lengths that differ by less than this share of them (or this, below 1) are the same.
TIE = 1e-10


@dataclass
class Csr:
    """Neighbours of each vertex, with the edge's place and weight."""

    ids: np.ndarray
    start: np.ndarray
    to: np.ndarray
    edge: np.ndarray
    weight: np.ndarray
    ends: np.ndarray

    def around(self, v: int) -> slice:
        return slice(self.start[v], self.start[v + 1])


def fits(g: NetworkFrame) -> bool:
    """Whether a graph's edges and vertices may go to every worker."""
    return all(rows.limit(MOST_EDGES + 1).count() <= MOST_EDGES for rows in (g.edges, g.vertices))


def csr(g: NetworkFrame, weight: str | None = None) -> Csr:
    """The graph as arrays; the caller has checked that it fits."""
    edges = g.edges if weight else simple(g.edges)
    frame = edges.select("src", "dst", (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")).orderBy("src", "dst").toPandas()
    return arrays(g.vertices.select("id").distinct().toPandas()["id"].to_numpy(), frame)


def arrays(ids: np.ndarray, frame: pd.DataFrame) -> Csr:
    """Neighbours of each id from edges (src, dst, w)."""
    ids = np.sort(ids)
    s, d = np.searchsorted(ids, frame["src"].to_numpy()), np.searchsorted(ids, frame["dst"].to_numpy())
    a, b, w, k = np.concatenate([s, d]), np.concatenate([d, s]), np.tile(frame["w"].to_numpy(), 2), np.tile(np.arange(len(s)), 2)
    order = np.lexsort((b, a))
    start = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=len(ids)))]).astype(np.int64)
    return Csr(ids, start, b[order], k[order], w[order], np.stack([s, d], 1))


def around(c: Csr, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For all edges out of a level's vertices: the place of the vertex in the level, and the edge's place."""
    n = c.start[level + 1] - c.start[level]
    of = np.repeat(np.arange(len(level)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + c.start[level][of]


def levels(c: Csr, s: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Numbers of steps from ``s`` (infinite out of reach), and the vertices by that number."""
    dist, out = np.full(len(c.ids), np.inf), [np.array([s])]
    dist[s] = 0.0
    while True:
        near = c.to[around(c, out[-1])[1]]
        new = np.unique(near[np.isinf(dist[near])])
        if not len(new):
            return dist, out
        dist[new] = len(out)
        out.append(new)


def nearest_first(c: Csr, s: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """By weight: distances, numbers of shortest paths, and vertices by distance from ``s``."""
    dist, ways, order = np.full(len(c.ids), np.inf), np.zeros(len(c.ids)), []
    dist[s], ways[s] = 0.0, 1.0
    heap, done = [(0.0, s)], np.zeros(len(c.ids), bool)
    while heap:
        d, v = heapq.heappop(heap)
        if done[v]:
            continue
        done[v] = True
        order.append(v)
        for u, w in zip(c.to[c.around(v)].tolist(), c.weight[c.around(v)].tolist(), strict=True):
            way = d + w
            if way < dist[u] - TIE * max(1.0, way):
                dist[u], ways[u] = way, ways[v]
                heapq.heappush(heap, (way, u))
            elif abs(way - dist[u]) <= TIE * max(1.0, way) and not done[u]:
                ways[u] += ways[v]
    return dist, ways, order


def by_weight(c: Csr, s: int) -> np.ndarray:
    """Weighted distances: all edges out of the vertices that came nearer, at once, until none does."""
    dist = np.full(len(c.ids), np.inf)
    dist[s], level = 0.0, np.array([s])
    while len(level):
        of, edge = around(c, level)
        before = dist.copy()
        np.minimum.at(dist, c.to[edge], before[level[of]] + c.weight[edge])
        level = np.flatnonzero(dist < before)
    return dist


def lengths(c: Csr, s: int, weighted: bool) -> np.ndarray:
    """Distances from ``s``."""
    return by_weight(c, s) if weighted else levels(c, s)[0]


def shares(c: Csr, s: int, targets: np.ndarray, weighted: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of all shortest paths from ``s`` to each target, the shares that pass each vertex (ends left out) and each edge."""
    passing, on_edge = np.zeros(len(c.ids)), np.zeros(len(c.ends))
    if not weighted:
        dist, by_level = levels(c, s)
        ways = np.zeros(len(c.ids))
        ways[s] = 1.0
        for n, level in enumerate(by_level[:-1]):
            of, edge = around(c, level)
            on = dist[c.to[edge]] == n + 1
            ways += np.bincount(c.to[edge[on]], ways[level[of[on]]], len(ways))
        for n in range(len(by_level) - 1, 0, -1):
            level = by_level[n]
            of, edge = around(c, level)
            back = dist[c.to[edge]] == n - 1
            v, edge = level[of[back]], edge[back]
            part = (passing[v] + targets[v]) * ways[c.to[edge]] / ways[v]
            passing += np.bincount(c.to[edge], part, len(passing))
            on_edge += np.bincount(c.edge[edge], part, len(on_edge))
    else:
        dist, ways, order = nearest_first(c, s)
        for v in reversed(order):
            load = passing[v] + (targets[v] and 1.0)
            if v == s or not load:
                continue
            near = c.around(v)
            for u, w, k in zip(c.to[near].tolist(), c.weight[near].tolist(), c.edge[near].tolist(), strict=True):
                if abs(dist[u] + w - dist[v]) <= TIE * max(1.0, dist[v]) and ways[u]:
                    part = load * ways[u] / ways[v]
                    on_edge[k] += part
                    passing[u] += part
    passing[s] = 0.0
    return passing, on_edge


def from_sources(g: NetworkFrame, sources: DataFrame, kernel: Callable[[Csr, np.ndarray], Iterator[pd.DataFrame]], schema: str, weight: str | None) -> DataFrame:
    """What ``kernel`` yields for each batch of sources, with the graph at hand; the caller has checked that it fits."""
    spark = g.edges.sparkSession
    held = spark.sparkContext.broadcast(csr(g, weight))  # its size was checked

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = held.value
        for frame in frames:
            at = np.searchsorted(c.ids, frame["id"].to_numpy())
            yield from kernel(c, at)

    spread = sources.select("id").distinct().repartition(spark.sparkContext.defaultParallelism * 2, "id")
    return spread.mapInPandas(run, schema)


def _kind(g: NetworkFrame) -> str:
    return dict(g.vertices.dtypes)["id"]


def distances(g: NetworkFrame, sources: DataFrame | None = None, weight: str | None = None) -> DataFrame:
    """(src, dst, distance) of all pairs in reach, dst <> src."""
    sources = g.vertices.select("id") if sources is None else sources
    if weight is None and of_points(g) or not fits(g):
        return frontier(g, sources, weight)

    def kernel(c: Csr, at: np.ndarray) -> Iterator[pd.DataFrame]:
        for s in at.tolist():
            d = lengths(c, s, weight is not None)
            hit = np.flatnonzero(np.isfinite(d) & (np.arange(len(d)) != s))
            yield pd.DataFrame({"src": np.repeat(c.ids[s], len(hit)), "dst": c.ids[hit], "distance": d[hit]})

    return from_sources(g, sources, kernel, f"src {_kind(g)}, dst {_kind(g)}, distance double", weight)


def reach(g: NetworkFrame, weight: str | None = None) -> DataFrame:
    """(id, n, total, longest) for every vertex that is not isolated: others in reach, the sum of their distances, and the largest."""
    if weight is None and of_points(g) or not fits(g):
        return reach_by_frontier(g, weight) if weight else waves.reach(g) if waves.held(g) else reach_by_bits(g)

    def kernel(c: Csr, at: np.ndarray) -> Iterator[pd.DataFrame]:
        rows = []
        for s in at.tolist():
            d = lengths(c, s, weight is not None)
            d = d[np.isfinite(d)]
            if len(d) > 1:
                rows.append((c.ids[s], len(d) - 1, d.sum(), d.max()))
        yield pd.DataFrame(rows, columns=["id", "n", "total", "longest"])

    return from_sources(g, g.vertices, kernel, f"id {_kind(g)}, n long, total double, longest double", weight)


def frontier(g: NetworkFrame, sources: DataFrame, weight: str | None = None) -> DataFrame:
    """As ``distances``: whole waves of sources, if a task may hold the graph and there are no weights; else by joins of the pairs whose distance changed with the edges, until none does."""
    if weight is None and waves.held(g):
        return waves.distances(g, sources)
    known = pairs_in_reach(g, sources, weight)
    return known.where("s <> v").select(F.col("s").alias("src"), F.col("v").alias("dst"), F.col("d").alias("distance"))


def pairs_in_reach(g: NetworkFrame, sources: DataFrame, weight: str | None = None) -> DataFrame:
    """(s, v, d) of every source and vertex in its reach, itself too; a stored table."""
    step = F.col(weight).cast("double") if weight else F.lit(1.0)
    ends = stored(both_ways(g.edges.select("src", "dst", step.alias("w"))).groupBy("src", "dst").agg(F.min("w").alias("w")))
    held = stored(sources.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(0.0).alias("d")).distinct())
    known = fresh = held
    while not fresh.isEmpty():
        offered = fresh.join(ends, fresh["v"] == ends["src"]).groupBy("s", F.col("dst").alias("to")).agg(F.min(F.col("d") + F.col("w")).alias("new")).withColumnRenamed("to", "v")
        both = stored(known.join(offered, ["s", "v"], "full"))
        forget(held)
        held = both
        better = F.col("d").isNull() | (F.col("new") < F.col("d"))
        fresh = both.where(better & F.col("new").isNotNull()).select("s", "v", F.col("new").alias("d"))
        known = both.select("s", "v", F.least("d", "new").alias("d"))
    forget(ends)
    return known


def in_blocks(sources: DataFrame, rows_per_source: float) -> Iterator[DataFrame]:
    """The sources in blocks that make at most ``BLOCK_ROWS`` rows each."""
    own = stored(sources.select("id").distinct())
    n = max(1, math.ceil(own.count() * rows_per_source / BLOCK_ROWS))
    for k in range(n):
        yield own.where(F.pmod(F.xxhash64("id"), F.lit(n)) == k)


def reach_by_frontier(g: NetworkFrame, weight: str | None) -> DataFrame:
    """As ``reach``, block by block of sources; of each only the sums are kept."""
    n, out = g.vertices.count(), None
    for some in in_blocks(g.vertices, n):
        known = pairs_in_reach(g, some, weight)
        sums = known.where("s <> v").groupBy(F.col("s").alias("id")).agg(F.count("*").alias("n"), F.sum("d").alias("total"), F.max("d").alias("longest"))
        kept = stored(sums)
        out = kept if out is None else out.unionByName(kept)
    return out


def reach_by_bits(g: NetworkFrame, sources: DataFrame | None = None) -> DataFrame:
    """As ``reach`` without weights: whole waves from 64 sources in a long, a row per vertex and 64 sources.

    A level is one join with the edges and an OR; what is new is counted bit by bit.
    """
    ends = stored(both_ways(simple(g.edges)))
    n, out = g.vertices.count(), None
    for some in in_blocks(g.vertices if sources is None else sources, n / 64):
        tagged = stored(some.withColumn("m", F.monotonically_increasing_id()).select("id", F.shiftright("m", 6).alias("word"), F.col("m").bitwiseAND(63).cast("int").alias("bit")))
        held = seen = stored(tagged.groupBy("word", F.col("id").alias("v")).agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("seen")))
        fresh, level, tallies = seen.withColumnRenamed("seen", "new"), 0, None
        while True:
            level += 1
            got = fresh.join(ends, fresh["v"] == ends["src"]).groupBy("word", F.col("dst").alias("v")).agg(F.bit_or("new").alias("got"))
            both = seen.join(got, ["word", "v"], "full").select("word", "v", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("seen", "got")))
            step = stored(both.select("word", "v", F.col("seen").bitwiseOR(F.col("got")).alias("seen"), F.col("got").bitwiseAND(F.bitwise_not("seen")).alias("new")))
            forget(held)
            held, seen, fresh = step, step.select("word", "v", "seen"), step.where("new <> 0").select("word", "v", "new")
            counts = F.array(*(F.sum(F.shiftright("new", k).bitwiseAND(1)) for k in range(64)))
            tally = stored(fresh.groupBy("word").agg(counts.alias("counts")).withColumn("level", F.lit(level)))
            if tally.isEmpty():
                break
            tallies = tally if tallies is None else tallies.unionByName(tally)
        forget(held)
        if tallies is not None:
            per = tallies.select("word", "level", F.posexplode("counts").alias("bit", "k")).where("k > 0").groupBy("word", "bit")
            sums = per.agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("level")).cast("double").alias("total"), F.max("level").cast("double").alias("longest"))
            kept = stored(tagged.join(sums, ["word", "bit"]).select("id", "n", "total", "longest"))
            out = kept if out is None else out.unionByName(kept)
    none = F.lit(None)
    return g.vertices.limit(0).select("id", none.cast("long").alias("n"), none.cast("double").alias("total"), none.cast("double").alias("longest")) if out is None else out


def diameter(g: NetworkFrame, weight: str | None = None) -> DataFrame:
    """One row: the longest finite distance."""
    if weight is None and (of_points(g) or not fits(g)):
        return waves.diameter(g) if waves.held(g) else diameter_by_bounds(g)
    return reach(g, weight).agg(F.max("longest").alias("diameter"))


def diameter_by_bounds(g: NetworkFrame) -> DataFrame:
    """As ``diameter``, for graphs of any size: sources by distance from the middle of a long path, farthest first.

    Two sweeps find the ends of a long path in every component, two more its
    middle and the distances from there. Two vertices at most k from their middle
    are at most 2 k apart, so sources end when the longest distance found is that.
    """
    spark = g.edges.sparkSession

    def sweep(starts: DataFrame) -> DataFrame:
        return pairs_in_reach(g, starts)

    def farthest(known: DataFrame) -> DataFrame:
        return stored(known.groupBy("s").agg(F.max_by("v", F.struct("d", "v")).alias("id")).select("id").distinct())

    own = components(NetworkFrame(g.vertices.select("id"), g.edges.select("src", "dst")))
    first = farthest(sweep(stored(own.select(F.col("component").alias("id")).distinct())))
    one = sweep(first)
    ends = stored(one.groupBy("s").agg(F.max_by("v", F.struct("d", "v")).alias("id"), F.max("d").alias("far")))
    two = sweep(ends.select("id"))
    both = one.select(F.col("s").alias("a"), "v", F.col("d").alias("da")).join(two.select("v", F.col("d").alias("db")), "v").join(ends.select(F.col("s").alias("a"), "far"), "a")
    middle = both.where("da + db = far AND da = floor(far / 2)").groupBy("a").agg(F.min("v").alias("id"))
    level = stored(sweep(stored(middle.select("id"))).select(F.col("v").alias("id"), "d"))
    found = ends.agg(F.max("far")).first()[0]
    sizes = [(r["d"], r["n"]) for r in level.groupBy("d").agg(F.count("*").alias("n")).orderBy(F.desc("d")).collect()]  # a row per level
    while sizes and found < 2 * sizes[0][0]:
        high, n = sizes.pop(0)
        low = high
        while sizes and n + sizes[0][1] <= 64 * spark.sparkContext.defaultParallelism:
            low, more = sizes.pop(0)
            n += more
        found = max(found, reach_by_bits(g, level.where(F.col("d").between(low, high))).agg(F.max("longest")).first()[0] or 0.0)
    return spark.createDataFrame([(found or None,)], "diameter double")


def closeness(g: NetworkFrame, weight: str | None = None) -> DataFrame:
    """(id, closeness): vertices in reach over the sum of their distances; null for isolated ones."""
    return g.vertices.select("id").join(reach(g, weight).select("id", (F.col("n") / F.col("total")).alias("closeness")), "id", "left")


def _both_kinds(g: NetworkFrame, sources: DataFrame, targets: DataFrame | None, weight: str | None, edges: bool = True) -> DataFrame:
    """(kind, src, dst, value): sums over sources of what ``shares`` gives, nodes and, unless they are not asked for, edges.

    Without weights by waves, if a task may hold the graph (and, for edges, a number for each of its ends too).
    """
    spark = g.edges.sparkSession
    small = not (weight is None and not edges and of_points(g)) and fits(g)
    if weight is None and (small or (not edges and waves.held(g))):
        return waves.shares(g, sources, targets, edges)
    if not small:
        return counted_over_tables(g, sources, targets, weight)
    wanted = None if targets is None else spark.sparkContext.broadcast(set(r[0] for r in targets.select("id").distinct().collect()))  # vertices of a graph that fits
    kind = _kind(g)

    def kernel(c: Csr, at: np.ndarray) -> Iterator[pd.DataFrame]:
        is_target = np.ones(len(c.ids), bool) if wanted is None else np.array([i in wanted.value for i in c.ids.tolist()], bool)
        node, edge = np.zeros(len(c.ids)), np.zeros(len(c.ends))
        for s in at.tolist():
            p, e = shares(c, s, is_target, weight is not None)
            node, edge = node + p, edge + e
        a, b = c.ids[c.ends[:, 0]], c.ids[c.ends[:, 1]]
        yield pd.DataFrame({"kind": "node", "src": c.ids, "dst": c.ids, "value": node})
        yield pd.DataFrame({"kind": "edge", "src": a, "dst": b, "value": edge})

    return from_sources(g, sources, kernel, f"kind string, src {kind}, dst {kind}, value double", weight).groupBy("kind", "src", "dst").agg(F.sum("value").alias("value"))


def counted_over_tables(g: NetworkFrame, sources: DataFrame, targets: DataFrame | None, weight: str | None) -> DataFrame:
    """As ``_both_kinds``, for graphs of any size: block by block of sources, level by level. Weights must be positive."""
    step = F.col(weight).cast("double") if weight else F.lit(1.0)
    own = stored((g.edges if weight else simple(g.edges)).select("src", "dst", step.alias("w")))
    if not own.where("w <= 0 OR w IS NULL").isEmpty():
        raise InvalidArgumentsError("shortest paths are counted over positive weights")
    ends = stored(both_ways(own.where("src <> dst").withColumns({"a": F.col("src"), "b": F.col("dst")})))
    wanted = None if targets is None else stored(targets.select(F.col("id").alias("v")).distinct())
    none = F.lit(0.0).alias("value")
    rows = g.vertices.select(F.lit("node").alias("kind"), F.col("id").alias("src"), F.col("id").alias("dst"), none).distinct()
    rows = rows.unionByName(own.select(F.lit("edge").alias("kind"), "src", "dst", none).distinct())
    for some in in_blocks(sources.join(g.vertices.select("id").distinct(), "id", "left_semi"), g.vertices.count()):
        rows = rows.unionByName(_counted_block(NetworkFrame(g.vertices, own), some, ends, wanted, weight and "w"))
    return rows.groupBy("kind", "src", "dst").agg(F.sum("value").alias("value"))


def _counted_block(g: NetworkFrame, sources: DataFrame, ends: DataFrame, wanted: DataFrame | None, weight: str | None) -> DataFrame:
    """(kind, src, dst, value) of one block of sources, stored."""
    known = stored(pairs_in_reach(g, sources, weight))
    at = lambda v, d: known.select("s", F.col("v").alias(v), F.col("d").alias(d))
    used = at("src", "du").join(ends, "src").join(at("dst", "dv"), ["s", "dst"])
    tie = F.abs(F.col("du") + F.col("w") - F.col("dv")) <= TIE * F.greatest(F.lit(1.0), "dv")
    used = stored(used.where(tie).select("s", F.col("src").alias("u"), F.col("dst").alias("v"), "a", "b"))
    #: numbers of paths by their number of edges; a vertex's level is the most edges
    hop, level = stored(sources.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(1.0).alias("n"))), 0
    hops = hop.withColumn("level", F.lit(0))
    while True:
        step = hop.withColumnRenamed("v", "u").join(used, ["s", "u"]).groupBy("s", "v").agg(F.sum("n").alias("n"))
        hop, level = stored(step), level + 1
        if hop.isEmpty():
            break
        hops = hops.unionByName(hop.withColumn("level", F.lit(level)))
    ways = stored(hops.groupBy("s", "v").agg(F.sum("n").alias("n"), F.max("level").alias("level")))
    near, far = ways.toDF("s", "u", "nu", "at"), ways.toDF("s", "v", "nv", "level")
    share = stored(used.join(near, ["s", "u"]).join(far, ["s", "v"]).select("s", "u", "v", "a", "b", "at", "level", (F.col("nu") / F.col("nv")).alias("share")))
    ending = ways.where("s <> v") if wanted is None else ways.where("s <> v").join(wanted, "v", "left_semi")
    own = stored(ending.select("s", "v", "level", F.lit(1.0).alias("load")))
    parts = None
    for depth in range(level - 1, 0, -1):
        load = own.where(F.col("level") == depth).select("s", "v", "load")
        if parts is not None:
            load = load.unionByName(parts.where(F.col("at") == depth).select("s", F.col("u").alias("v"), F.col("part").alias("load")))
        load = load.groupBy("s", "v").agg(F.sum("load").alias("load"))
        moved = share.where(F.col("level") == depth).join(load, ["s", "v"]).select("s", "u", "a", "b", "at", (F.col("load") * F.col("share")).alias("part"))
        moved = stored(moved)
        parts = moved if parts is None else parts.unionByName(moved)
    if parts is None:
        return stored(g.vertices.limit(0).select(F.lit("node").alias("kind"), F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("value")))
    node = parts.where("s <> u").groupBy("u").agg(F.sum("part").alias("value")).select(F.lit("node").alias("kind"), F.col("u").alias("src"), F.col("u").alias("dst"), "value")
    edge = parts.groupBy("a", "b").agg(F.sum("part").alias("value")).select(F.lit("edge").alias("kind"), F.col("a").alias("src"), F.col("b").alias("dst"), "value")
    out = stored(node.unionByName(edge))
    forget(known, used, ways, share, own)
    return out


def node_betweenness(g: NetworkFrame) -> DataFrame:
    """(id, betweenness): over unordered pairs, divided by N (N - 1)."""
    n = g.vertices.select("id").distinct().count()
    got = _both_kinds(g, g.vertices, None, None, edges=False).where("kind = 'node'")
    return got.select(F.col("src").alias("id"), (F.col("value") / 2 / max(1, n * (n - 1))).alias("betweenness"))


def average_betweenness(g: NetworkFrame) -> DataFrame:
    """One row: the average of ``node_betweenness``. Shortest paths over d edges pass d - 1 vertices, so distances are enough."""
    n = g.vertices.select("id").distinct().count()
    passed = F.coalesce(F.sum(F.col("total") - F.col("n")), F.lit(0.0)) / 2 / max(1, n * (n - 1)) / max(1, n)
    return reach(g).agg(F.when(F.lit(n > 0), passed).alias("average_betweenness"))


def boundary_betweenness(g: NetworkFrame, sources: DataFrame, targets: DataFrame, weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, betweenness) and (src, dst, betweenness): half the sum over sources and targets."""
    got = _both_kinds(g, sources, targets, weight).withColumn("value", F.col("value") / 2)
    return (got.where("kind = 'node'").select(F.col("src").alias("id"), F.col("value").alias("betweenness")),
            got.where("kind = 'edge'").select("src", "dst", F.col("value").alias("betweenness")))


def node_boundary_betweenness(g: NetworkFrame, sources: DataFrame, targets: DataFrame, weight: str | None = None) -> DataFrame:
    """The first of ``boundary_betweenness`` alone, which needs no numbers for edges."""
    got = _both_kinds(g, sources, targets, weight, edges=False).where("kind = 'node'")
    return got.select(F.col("src").alias("id"), (F.col("value") / 2).alias("betweenness"))


def gyration(g: NetworkFrame, length: str = "resistance", mass: str | None = "conductance", sampling: int = 1, ordered: bool = False, whole: bool = False, by: str | None = None) -> DataFrame:
    """One row: over pairs i < j, along one shortest path by ``length``, sums of mass times products of the steps between neighbours on the path.

    Vertices carry x and y. Columns: xx, yy, xy. ``sampling``: only every so many
    vertices, by id, are ends of pairs; ``ordered``: every pair counts both ways;
    ``whole``: coordinates without their fractions; ``by``: a column of vertices and
    edges that tells graphs apart, whose sums are added up.

    A task gets a graph and some of its vertices as sources; tasks are shared out
    by the graphs' vertices times edges. Nothing passes the driver. Of near points
    (``near.PointGraphs``) only the points come.
    """
    if sampling == 1 and not whole and near.dense(g, by, FEW_POINTS, length, mass):
        return _gyration_of_points(g, length, mass, ordered)
    key = by or "__one"
    own = g if by else NetworkFrame(g.vertices.withColumn(key, F.lit(1)), g.edges.withColumn(key, F.lit(1)))
    counts = [rows.groupBy(key).agg(F.count("*").cast("double").alias(n)) for rows, n in ((own.vertices, "n"), (own.edges, "m"))]
    sizes = stored(counts[0].join(counts[1], key))
    if not sizes.where(F.greatest("n", "m") > MOST_EDGES).isEmpty():
        raise InvalidArgumentsError(f"gyration holds at most {MOST_EDGES} edges and vertices in a task")
    work = sizes.agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 1.0
    most = 4 * g.edges.sparkSession.sparkContext.defaultParallelism
    dealt = sizes.select(key, F.explode(F.sequence(F.lit(0), F.least(F.ceil(most * F.col("n") * F.col("m") / work), F.ceil("n")).cast("int") - 1)).alias("__block"))
    blocks = stored(dealt.select(key, "__block", F.count("*").over(Window.partitionBy(key)).cast("int").alias("__blocks")))  # a row per task
    axis = (lambda a: F.col(a).cast("long").cast("double").alias(a)) if whole else (lambda a: F.col(a).cast("double").alias(a))
    vertices = own.vertices.select(key, "id", axis("x"), axis("y")).join(blocks, key)
    edges = own.edges.select(F.col(key).alias("__of"), "src", "dst", F.col(length).cast("double").alias("w"), (F.col(mass) if mass else F.lit(1.0)).cast("double").alias("heavy"))
    edges = edges.join(blocks.select(F.col(key).alias("__of"), F.col("__block").alias("__in")), "__of")

    def of_block(v: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if not len(v) or not len(e):
            return pd.DataFrame({"xx": [], "yy": [], "xy": []})
        v, e = v.drop_duplicates("id").sort_values("id"), e.sort_values(["src", "dst"])
        c = arrays(v["id"].to_numpy(), e)
        at = np.arange(len(c.ids))
        at = at[(at % sampling == 0) & (at // sampling % v["__blocks"].iat[0] == v["__block"].iat[0])]
        return pd.DataFrame([gyration_sums(c, v[["x", "y"]].to_numpy(), e["heavy"].to_numpy()[c.edge], at, sampling) * (1 + ordered)], columns=["xx", "yy", "xy"])

    sums = vertices.groupBy(key, "__block").cogroup(edges.groupBy("__of", "__in")).applyInPandas(of_block, "xx double, yy double, xy double")
    return sums.agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("xx", "yy", "xy")))


#: Points of a graph up to which their edges are made and weighed as others are.
FEW_POINTS = 1500


def _gyration_of_points(g: near.PointGraphs, length: str, mass: str, ordered: bool) -> DataFrame:
    """As ``gyration``; a task takes some of a graph's points as sources."""
    r_max, weigh, heavy = g.r_max, g.weights[length], g.weights[mass]

    def run(_, v: pd.DataFrame, part: int, parts: int) -> Iterator[pd.DataFrame]:
        size, to, apart = [np.zeros(0, int)], [np.zeros(0, np.int32)], [np.zeros(0)]
        for _, far, hit in near.stripes(v, r_max):
            size.append(hit.sum(1))
            to.append(np.nonzero(hit)[1].astype(np.int32))
            apart.append(far[hit])
        size, to, apart = map(np.concatenate, (size, to, apart))
        start, xy = np.cumsum(size) - size, v[["x", "y"]].to_numpy(float)
        cost, out = weigh(apart), np.zeros(3)
        least = cost.min(initial=np.inf)
        for s in range(part, len(v), parts):
            _, above, edge, turn = nearest_tree(start, size, to, cost, least, s)
            way = np.flatnonzero(turn > 0)
            count = np.zeros(len(v))
            count[way[way > s]] = 1.0
            for k in range(turn.max(initial=0), 1, -1):
                own = way[turn[way] == k]
                count += np.bincount(above[own], count[own], len(v))
            dx, dy = (xy[way] - xy[above[way]]).T
            load = count[way] * heavy(apart[edge[way]])
            out += (load * dx * dx).sum(), (load * dy * dy).sum(), (load * dx * dy).sum()
        yield pd.DataFrame([out * (1 + ordered)], columns=["xx", "yy", "xy"])

    sums = near.each_graph(g, run, "xx double, yy double, xy double", [], 64)
    return sums.agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("xx", "yy", "xy")))


def nearest_tree(start: np.ndarray, size: np.ndarray, to: np.ndarray, cost: np.ndarray, least: float, s: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distances from ``s``, the first best vertex before each on the way from there, the place of the edge between them, and the turn it was found in, 0 for s and out of reach.

    A turn looks at all edges of those vertices only that any that came nearer in the turn before could bring nearer, by the ``least`` cost.
    """
    dist, turn = np.full(len(size), np.inf), np.zeros(len(size), np.int32)
    above, edge = (np.zeros(len(size), np.int64) for _ in range(2))
    own = np.arange(start[s], start[s] + size[s])
    fresh, k, linked = to[own], 1, np.flatnonzero(size)
    dist[s], dist[fresh], above[fresh], edge[fresh], turn[fresh] = 0.0, cost[own], s, own, 1
    while len(fresh):
        k += 1
        some, came = linked[dist[linked] > dist[fresh].min() + least * (1 - 1e-12)], []
        for own in waves._pieces(size, some):
            place, first = waves._places(start, size, own), np.cumsum(size[own]) - size[own]
            way = dist.take(to[place].astype(np.intp), mode="clip")
            way += cost[place]
            best = np.minimum.reduceat(way, first)
            better = best < dist[own]
            if better.any():
                hit = np.flatnonzero(way == np.repeat(np.where(better, best, np.nan), size[own]))
                came.append((own[better], best[better], place[hit[np.searchsorted(hit, first[better])]]))
        fresh = np.concatenate([c[0] for c in came]) if came else np.zeros(0, int)
        if len(fresh):
            dist[fresh], edge[fresh], turn[fresh] = np.concatenate([c[1] for c in came]), np.concatenate([c[2] for c in came]), k
            above[fresh] = to[edge[fresh]]
    return dist, above, edge, turn


def gyration_sums(c: Csr, xy: np.ndarray, mass: np.ndarray | None, sources: np.ndarray, sampling: int = 1) -> np.ndarray:
    """The sums (xx, yy, xy) from these sources to every ``sampling``-th later vertex; ``mass`` is in the order of the neighbours.

    The paths from a source are a tree: targets are counted from its leaves up, so
    every edge is weighed once with the number of targets beyond it.
    """
    out, degree = np.zeros(3), np.diff(c.start)
    of, linked = np.repeat(np.arange(len(c.ids)), degree), degree > 0
    for s in sources.tolist():
        dist = by_weight(c, s)
        beyond = np.zeros(len(c.ids))
        beyond[s + sampling :: sampling] = 1.0
        beyond[np.isinf(dist)] = 0.0
        if not beyond.any():
            continue
        with np.errstate(invalid="ignore"):
            off = np.where(dist[c.to] < dist[of], np.abs(dist[c.to] + c.weight - dist[of]), np.inf)
        best = np.flatnonzero(off == np.repeat(np.minimum.reduceat(off, c.start[:-1][linked]), degree[linked]))
        way = best[np.concatenate([[True], np.diff(of[best]) != 0])]  # each vertex's first best edge towards s
        way = way[np.isfinite(dist[of[way]]) & (of[way] != s)]
        way = way[np.argsort(-dist[of[way]], kind="stable")]
        count = beyond.tolist()
        for v, u in zip(of[way].tolist(), c.to[way].tolist(), strict=True):
            count[u] += count[v]
        dx, dy = (xy[of[way]] - xy[c.to[way]]).T
        heavy = np.array(count)[of[way]] * (mass[way] if mass is not None else 1.0)
        out += (heavy * dx * dx).sum(), (heavy * dy * dy).sum(), (heavy * dx * dy).sum()
    return out
