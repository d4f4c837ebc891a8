"""Connected components by randomised contraction.

A graph of at most ``FEW_EDGES`` edges (counted first) is solved in one task, as
rounds of joins would cost more than the work. A larger one is contracted until
it is that small: in a random order of the vertices, another one each round, all
vertices turn into the first of themselves and their neighbours; edges that so
become loops or repeat others go. A fixed share of the vertices is expected to
go in each round, whatever the shape, so all rounds together cost little more
than the first. The vertices' way is then followed back from the last round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import NetworkFrame, both_ways
from .iterate import FEW_ROWS, HOT_KEYS, forget, hot_keys, looked_up, stored

FEW_EDGES = 200_000


def components(g: NetworkFrame, few: int = FEW_EDGES) -> DataFrame:
    """(id, component): the least id that is reachable. Edges with a null end join nothing."""
    kind = dict(g.vertices.select("id").dtypes)["id"]
    edges = stored(g.edges.select("src", "dst").where("src <> dst"))
    n, steps = edges.count(), []
    while n > (0 if kind.startswith(("struct", "array", "map")) else few):
        before = edges
        edges, step = contracted(before, n, len(steps))
        steps.append(step)
        forget(before)
        n = edges.count()
    if n:
        found = stored(edges.coalesce(1).mapInPandas(_least_of_each, f"id {kind}, component {kind}"))
    else:
        found = edges.select(F.col("src").alias("id"), F.col("dst").alias("component"))  # no rows
    for step in reversed(steps):
        hot = hot_keys(step, "first", step.count())
        ways = looked_up(step.select("id", "first"), found.toDF("first", "component"), "first", hot, outer=True)
        after = stored(ways.select("id", F.coalesce("component", "first").alias("component")))
        forget(found, step)
        found = after
    if steps:
        least = found.groupBy("component").agg(F.min("id").alias("least"))
        found = looked_up(found, least, "component", hot_keys(found, "component", found.count())).select("id", F.col("least").alias("component"))
    own = g.vertices.select("id").distinct()
    return own.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def contracted(edges: DataFrame, n: int, turn: int) -> tuple[DataFrame, DataFrame]:
    """The ``n`` ``edges`` between the vertices that all turn into, each once and without loops; and (id, first, n), what each turns into."""
    placed = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("place"), F.col(c).alias("id"))  # noqa: E731  the order of this turn
    near = both_ways(edges).groupBy("src").agg(F.min(placed("dst")).alias("near"), F.count("*").alias("n"))
    step = stored(near.select(F.col("src").alias("id"), F.least(placed("src"), "near")["id"].alias("first"), "n"))
    hot = step.where(F.col("n") > max(FEW_ROWS, 2 * n // HOT_KEYS))  # at most ``HOT_KEYS`` vertices, as their edges' ends are ``2 * n``
    to = step.select("id", "first")
    half = looked_up(edges, to.toDF("src", "a"), "src", hot.select(F.col("id").alias("src"))).select("a", "dst")
    both = looked_up(half, to.toDF("dst", "b"), "dst", hot.select(F.col("id").alias("dst")))
    return stored(both.where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()), step


def _least_of_each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over all edges; a root is its tree's least id."""
    above: dict = {}

    def root(x):
        while (up := above.setdefault(x, x)) != x:
            above[x] = x = above[up]
        return x

    for frame in frames:
        for a, b in zip(frame["src"].tolist(), frame["dst"].tolist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                above[max(a, b)] = min(a, b)
    yield pd.DataFrame({"id": list(above), "component": [root(x) for x in above]})


def giant(g: NetworkFrame) -> NetworkFrame:
    """The largest component (of equals the one with the least id)."""
    c = components(g)
    sizes = c.groupBy("component").agg(F.count("*").alias("n"))
    most = sizes.agg(F.max("n").alias("n"))
    chosen = sizes.join(F.broadcast(most), "n").agg(F.min("component").alias("component"))  # one row each
    ids = stored(c.join(F.broadcast(chosen), "component").select("id"))
    edges = g.edges.join(ids.toDF("src"), "src", "left_semi")
    return NetworkFrame(g.vertices.join(ids, "id", "left_semi"), edges)


def giant_of_each(g: NetworkFrame, by: str, links: DataFrame | None = None) -> NetworkFrame:
    """The largest component (of equals the one with the least id) of each of the graphs that the vertices' column ``by`` tells apart; ids are unique over all.

    ``links``: fewer edges, if at hand, that have the same components.
    """
    own = stored(g.vertices.select(by, "id").join(components(NetworkFrame(g.vertices.select("id"), g.edges if links is None else links)), "id"))
    sizes = own.groupBy(by, "component").agg(F.count("*").alias("n"))
    most = sizes.groupBy(by).agg(F.max("n").alias("n"))
    chosen = sizes.join(most, [by, "n"]).groupBy(by).agg(F.min("component").alias("component"))
    ids = stored(own.join(chosen, [by, "component"]).select("id"))
    return NetworkFrame(g.vertices.join(ids, "id", "left_semi"), g.edges.join(ids.toDF("src"), "src", "left_semi"))


def renumbered(g: NetworkFrame) -> NetworkFrame:
    """Ids from 0 in the order of the old ones: ranges of ids are numbered apart, then offset."""
    ids = g.vertices.select("id").distinct().repartitionByRange("id").sortWithinPartitions("id")
    numbered = stored(ids.select("id", F.monotonically_increasing_id().alias("m")).select("id", F.shiftright("m", 33).alias("p"), (F.col("m").bitwiseAND((1 << 33) - 1)).alias("i")))
    before, start = {}, 0
    for r in numbered.groupBy("p").agg(F.count("*").alias("n")).orderBy("p").collect():  # a row per partition
        before[r["p"]], start = start, start + r["n"]
    offset = F.create_map(*(F.lit(x) for kv in before.items() for x in kv)) if before else F.create_map(F.lit(0), F.lit(0))
    new = numbered.select("id", (F.try_element_at(offset, F.col("p")) + F.col("i")).alias("new"))
    v = g.vertices.join(new, "id").drop("id").withColumnRenamed("new", "id")
    e = g.edges.join(new.toDF("src", "s"), "src").join(new.toDF("dst", "d"), "dst").drop("src", "dst").withColumnsRenamed({"s": "src", "d": "dst"})
    return NetworkFrame(v, e)
