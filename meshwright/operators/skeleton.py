"""Skeletons to graphs: node voxels, node clusters, traced edges.

A voxel with exactly two neighbours lies on an edge, any other in a node. Nodes
are clusters of touching node voxels; edges are runs of edge voxels between two
of them, with the node voxels they touch at either end. Closed runs become a
node with a loop.

Images of at most ``FEW`` voxels are traced in a task each. In a larger one runs
are lists that are ranked by pointer doubling: every way into an edge voxel points
on to the next one, pointers double by joins until they leave the run, so order
and both ends are known after as many rounds as a run's length has binary digits,
and no task holds an image.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import VOXEL, NetworkFrame, both_ways
from .components import components
from .groups import by_batches
from .iterate import forget, ranked, stored
from .morphology import AROUND, AT, neighbour_counts, voxel_graph, with_ids

#: Voxels of an image that is traced in one task.
FEW = 1 << 18


def marked(voxels: DataFrame) -> DataFrame:
    """Voxels with mark: 1 on an edge, 2 in a node."""
    return neighbour_counts(voxels).select(*AT, F.when(F.col("n_neighbours") == 2, 1).otherwise(2).alias("mark"))


def nodes(voxels: DataFrame) -> DataFrame:
    """Clusters of node voxels: image_id, node (the least voxel), n_voxels, centroid truncated to integers."""
    inner = marked(voxels).where("mark = 2").select(*AT)
    labels = components(voxel_graph(inner))
    own = with_ids(inner).join(labels, "id")
    return own.groupBy("image_id", "component").agg(F.count("*").alias("n_voxels"), *(F.avg(a).cast("int").alias(a) for a in "zrc")).withColumnRenamed("component", "node")


def trace(at: list[tuple[int, int, int]], multi: bool = False, iso: bool = True, ring: bool = True) -> tuple[list[dict], list[dict]]:
    """Nodes and edges of one image, from its voxels."""
    every = sorted(at)
    on = set(every)
    near = {p: [q for s in AROUND if (q := (p[0] + s[0], p[1] + s[1], p[2] + s[2])) in on] for p in every}
    is_node = {p: len(near[p]) != 2 for p in every}
    node_of: dict[tuple, int] = {}
    clusters: list[list[tuple]] = []
    for p in every:
        if is_node[p] and p not in node_of:
            stack, own = [p], []
            node_of[p] = len(clusters)
            while stack:
                q = stack.pop()
                own.append(q)
                for u in near[q]:
                    if is_node[u] and u not in node_of:
                        node_of[u] = len(clusters)
                        stack.append(u)
            if not iso and len(own) == 1 and not near[p]:
                node_of[p] = -1
                continue
            clusters.append(sorted(own))
    runs, used = [], set()
    for p in every:
        if not is_node[p]:
            continue
        for first in sorted(u for u in near[p] if not is_node[u]):
            if first in used:
                continue
            run, before, here = [p], p, first
            while not is_node[here]:
                used.add(here)
                run.append(here)
                a, b = near[here]
                before, here = here, (b if a == before else a)
            runs.append([*run, here])
    ends = [(node_of[r[0]], node_of[r[-1]]) for r in runs]
    if ring:
        for p in every:
            if not is_node[p] and p not in used:
                run, before, here = [p], p, min(near[p])
                used.add(p)
                while here != p:
                    used.add(here)
                    run.append(here)
                    a, b = near[here]
                    before, here = here, (b if a == before else a)
                ends.append((len(clusters), len(clusters)))
                clusters.append([p])
                runs.append([*run, p])
    seen, edges = set(), []
    for (s, d), run in zip(ends, runs, strict=True):
        if multi or (s, d) not in seen:
            seen.add((s, d))
            edges.append({"src": s, "dst": d, "pts": run})
    return [{"id": i, "pts": own, "o": [int(sum(q[k] for q in own) / len(own)) for k in range(3)]} for i, own in enumerate(clusters)], edges


def vectorised(voxels: DataFrame, multi: bool = False, iso: bool = True, ring: bool = True, few: int = FEW) -> NetworkFrame:
    """Graphs of all images: vertices and edges keyed by image_id and graph-local ids. Images of at most ``few`` voxels are traced in a task each, others by joins."""
    voxels = stored(voxels.select(*AT))
    large = stored(voxels.groupBy("image_id").agg(F.count("*").alias("n")).where(F.col("n") > few).select("image_id"))
    if large.isEmpty():
        return in_one_task(voxels, multi, iso, ring)
    small = in_one_task(voxels.join(large, "image_id", "left_anti"), multi, iso, ring)
    joined = by_doubling(voxels.join(large, "image_id", "left_semi"), multi, iso, ring)
    return NetworkFrame(small.vertices.unionByName(joined.vertices), small.edges.unionByName(joined.edges))


def in_one_task(voxels: DataFrame, multi: bool, iso: bool, ring: bool) -> NetworkFrame:
    """As ``vectorised``, traced image by image."""
    as_voxel = lambda run: [{"z": z, "r": r, "c": c} for z, r, c in run]

    def of_images(images: list[tuple[tuple[int, ...], np.ndarray]]) -> list[pd.DataFrame]:
        rows = []
        for (image,), at in images:
            own, edges = trace(list(map(tuple, at.tolist())), multi, iso, ring)
            rows += [(image, "vertex", n["id"], None, None, *map(float, n["o"]), as_voxel(n["pts"])) for n in own]
            rows += [(image, "edge", i, e["src"], e["dst"], None, None, None, as_voxel(e["pts"])) for i, e in enumerate(edges)]
        return [pd.DataFrame(rows, columns=["image_id", "kind", "id", "src", "dst", "z", "r", "c", "pts"], dtype=object)] if rows else []

    schema = f"image_id long, kind string, id long, src long, dst long, z double, r double, c double, pts array<{VOXEL}>"
    both = by_batches(voxels.select(*AT), 1, of_images, schema)
    vertices = both.where("kind = 'vertex'").select("image_id", "id", F.col("z").alias("z"), F.col("r").alias("y"), F.col("c").alias("x"), "pts")
    edges = both.where("kind = 'edge'").select("image_id", F.col("id").alias("eid"), "src", "dst", "pts")
    return NetworkFrame(vertices, edges)


def runs(between: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From edge voxels (v, a, b; a and b the neighbours), runs (v, p, first, rank, last, end): the node voxel a run starts at, its first
    and last edge voxel, v's place from 1, and the node voxel it ends at; and the edge voxels of closed runs.

    A run starts at the end whose (node voxel, edge voxel) comes first. Voxels are any comparable ids.
    """
    ways = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("w")), F.struct(F.col("b").alias("u"), F.col("a").alias("w")))
    arcs = between.select("v", F.explode(ways).alias("way")).select(F.col("way.u").alias("u"), "v", F.col("way.w").alias("w"))
    on_edge = between.select(F.col("v").alias("w"), F.lit(True).alias("goes_on"))
    start = arcs.join(on_edge, "w", "left")
    #: each way into v: how many steps are known, the way that follows them, or the edge and node voxel it leaves the run by
    ahead = F.when(F.col("goes_on"), F.struct(F.col("v").alias("u"), F.col("w").alias("v")))
    left = F.when(F.col("goes_on").isNull(), F.struct(F.col("w").alias("node"), F.col("v").alias("edge")))
    state = stored(start.select("u", "v", F.lit(1).cast("long").alias("n"), ahead.alias("ahead"), left.alias("left")))
    open_before = None
    while (open_now := state.where("left IS NULL").count()) and open_now != open_before:
        then = state.select(F.struct("u", "v").alias("ahead"), F.col("n").alias("m"), F.col("ahead").alias("next"), F.col("left").alias("end"))
        going = state.where("left IS NULL").join(then, "ahead")
        moved = going.select("u", "v", (F.col("n") + F.col("m")).alias("n"), F.col("next").alias("ahead"), F.col("end").alias("left"))
        after = stored(state.where("left IS NOT NULL").unionByName(moved))
        forget(state)
        state, open_before = after, open_now
    per = state.where("left IS NOT NULL").groupBy("v").agg(F.min(F.struct("left", "n")).alias("one"), F.max(F.struct("left", "n")).alias("two"))
    found = per.select("v", F.col("one.left.node").alias("p"), F.col("one.left.edge").alias("first"), F.col("one.n").alias("rank"), F.col("two.left.edge").alias("last"), F.col("two.left.node").alias("end"))
    return found, state.where("left IS NULL").select("v").distinct()


def by_doubling(voxels: DataFrame, multi: bool = False, iso: bool = True, ring: bool = True) -> NetworkFrame:
    """As ``vectorised``, for images of any size: clusters by components, runs by pointer doubling."""
    own = stored(with_ids(voxels.select(*AT).distinct()).select("id"))
    pairs = stored(both_ways(voxel_graph(own.select("id.*")).edges))
    around = pairs.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("a"), F.max("dst").alias("b"))
    known = stored(own.join(around.withColumnRenamed("src", "id"), "id", "left").withColumn("n", F.coalesce("n", F.lit(0))))
    between = stored(known.where("n = 2").select(F.col("id").alias("v"), "a", "b"))
    inner = stored(known.where("n <> 2").select("id", "n"))
    touching = pairs.join(inner.select(F.col("id").alias("src")), "src", "left_semi").join(inner.select(F.col("id").alias("dst")), "dst", "left_semi")
    labels = components(NetworkFrame(inner.select("id"), touching.where("src < dst")))
    kept = inner.join(labels, "id").where("n > 0") if not iso else inner.join(labels, "id")
    member = stored(kept.select("id", "component"))
    image = F.col("component.image_id")
    clusters = ranked(member.groupBy("component").agg(F.count("*").alias("n")).withColumn("image_id", image), ["image_id"], ["component"], "node")
    n_clusters = clusters.groupBy("image_id").agg(F.count("*").alias("n_clusters"))

    found, closed = runs(between)
    found = stored(found.withColumn("closed", F.lit(False)))
    if ring:
        circle = between.join(stored(closed), "v", "left_semi")
        links = circle.select(F.col("v").alias("src"), F.explode(F.array("a", "b")).alias("dst")).where("src < dst")
        heads = stored(components(NetworkFrame(circle.select(F.col("v").alias("id")), links)).select(F.col("component").alias("v")).distinct())
        found = stored(found.unionByName(runs(stored(circle.join(heads, "v", "left_anti")))[0].withColumn("closed", F.lit(True))))
        rings = ranked(heads.select(F.col("v").alias("component"), F.col("v.image_id").alias("image_id")), ["image_id"], ["component"], "node")
        rings = rings.join(n_clusters, "image_id", "left").withColumn("node", F.col("node") + F.coalesce("n_clusters", F.lit(0)))
        member = member.unionByName(heads.select(F.col("v").alias("id"), F.col("v").alias("component")))
        clusters = clusters.select("image_id", "component", "node").unionByName(rings.select("image_id", "component", "node"))
    node_of = stored(member.join(clusters.select("component", "image_id", "node"), "component").select("id", "image_id", "node"))

    voxel = lambda c: F.struct(*(F.col(f"{c}.{a}").cast("int").alias(a) for a in "zrc"))
    points = node_of.groupBy("image_id", F.col("node").cast("long").alias("id")).agg(F.sort_array(F.collect_list(voxel("id"))).alias("pts"), *(F.avg(f"id.{a}").cast("int").cast("double").alias(n) for a, n in zip("zrc", "zyx", strict=True)))
    vertices = points.select("image_id", "id", "z", "y", "x", "pts")

    inside = F.transform(F.sort_array(F.collect_list(F.struct("rank", voxel("v").alias("at")))), lambda s: s["at"])
    lines = found.groupBy("closed", "p", "first", "last", "end").agg(inside.alias("inside"))
    at = lambda c, name: node_of.select(F.col("id").alias(c), F.col("node").alias(name))
    lines = lines.join(at("p", "s"), "p").join(at("end", "d"), "end").withColumn("image_id", F.col("p.image_id"))
    lines = stored(lines.select("image_id", "closed", "p", "first", F.col("s").cast("long").alias("src"), F.col("d").cast("long").alias("dst"), F.concat(F.array(voxel("p")), "inside", F.array(voxel("end"))).alias("pts")))
    if not multi:
        first = lines.groupBy("image_id", "src", "dst").agg(F.min(F.struct("closed", "p", "first")).alias("f")).select("f.*")
        lines = lines.join(first, ["closed", "p", "first"], "left_semi")
    edges = ranked(lines, ["image_id"], ["closed", "p", "first"], "eid")
    return NetworkFrame(vertices, edges.select("image_id", F.col("eid").cast("long").alias("eid"), "src", "dst", "pts"))


def voxels_of(g: NetworkFrame) -> DataFrame:
    """All voxels of a graph's vertices and edges."""
    parts = [t.select("image_id", F.explode("pts").alias("p")).select("image_id", "p.*") for t in (g.vertices, g.edges)]
    return parts[0].unionByName(parts[1]).distinct()
