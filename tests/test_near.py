"""Graphs of near points, whose edges tasks find, against the same graphs with a table of edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwright.operators import measures, near, paths, points
from meshwright.schema import NetworkFrame
from meshwright.sources import graphs


def cloud(spark, n=120, seed=3):
    """Points in some clusters, two in one place, outliers, and some that are nowhere."""
    rng = np.random.default_rng(seed)
    xyz = rng.normal(0, 0.2, (n, 3)) + rng.integers(0, 2, (n, 1))
    rows = [(int(i), *map(float, p)) for i, p in zip(rng.permutation(n) - 5, xyz, strict=True)]
    rows += [(1000, *rows[0][1:]), (1002, float("nan"), 0.0, 0.0), (1003, None, 1.0, 1.0), (1004, -4e7, 9.0, 9.0), (1005, -4e7, 9.0, 9.2)]
    return spark.createDataFrame(rows, "pid long, x double, y double, z double")


def both(spark, r_max=0.25, **more):
    """The graph by a table of edges, and by points only: its table of edges cannot be read."""
    p = cloud(spark, **more)
    v = p.withColumnRenamed("pid", "id")
    edges = points.cutoff_graph(p, r_max)
    none = edges.withColumn("length", F.raise_error(F.lit("edges are not asked for")).cast("double")).withColumn("src", F.when(F.col("length") > 0, F.col("src")))
    return NetworkFrame(v, edges), near.PointGraph(v, none, r_max)


def rows(df):
    return sorted(map(tuple, df.collect()))


def same(got, want, n_keys=1):
    got, want = rows(got), want if isinstance(want, list) else rows(want)
    assert [r[:n_keys] for r in got] == [r[:n_keys] for r in want]
    for a, b in zip(got, want, strict=True):
        assert a[n_keys:] == pytest.approx(b[n_keys:], nan_ok=True), a


def test_lists_are_the_near_pairs():
    rng = np.random.default_rng(1)
    for n, spread in ((1, 1.0), (200, 0.2), (300, 3.0)):
        xyz = rng.normal(0, spread, (n, 3))
        xyz[n // 2 :: 7] = xyz[0]
        xyz[3::50, 1] = np.nan
        xyz[4::50, 2] = 1e300
        c = near.Cloud(xyz, 0.25)
        want = np.sqrt(((c.xyz[:, None] - c.xyz[None]) ** 2).sum(2)) <= 0.25
        np.fill_diagonal(want, False)
        start, size, to = c.lists(int(want.sum()))
        got = np.zeros_like(want)
        for v in range(n):
            got[v, to[start[v] : start[v] + size[v]]] = True
        assert (got == want).all() and size.sum() == want.sum()


def test_reach_and_closeness_from_points(spark):
    g, own = both(spark)
    same(paths.reach(own), paths.reach(g))
    assert rows(paths.average_betweenness(own))[0] == pytest.approx(rows(paths.average_betweenness(g))[0])
    got, want = (dict(rows(paths.closeness(x).where("id IS NOT NULL").na.fill(-1.0))) for x in (own, g))
    assert got == pytest.approx(want)


@pytest.mark.parametrize("seed", range(3))
def test_diameter_from_points(spark, seed):
    g, own = both(spark, 0.3 - 0.05 * seed, n=60 + 60 * seed, seed=seed)
    assert paths.diameter(own).first()[0] == paths.diameter(g).first()[0]


def test_diameter_of_nothing(spark):
    v = spark.createDataFrame([], "id long, x double, y double, z double")
    assert paths.diameter(near.PointGraph(v, points.cutoff_graph(v.withColumnRenamed("id", "pid"), 1.0), 1.0)).first()[0] is None


def test_ids_that_come_twice_go_by_edges(spark):
    v = spark.createDataFrame([(1, 0.0), (1, 5.0), (2, 0.1)], "id long, x double").select("id", "x", F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    g = near.PointGraph(v, points.cutoff_graph(v.withColumnRenamed("id", "pid"), 1.0), 1.0)
    assert g.points() is None
    assert rows(paths.distances(g)) == [(1, 2, 1.0), (2, 1, 1.0)]


def test_distances_from_points_come_tile_by_tile(spark):
    g, own = both(spark)
    assert rows(paths.distances(own)) == rows(paths.distances(g))
    some = own.vertices.where("id % 3 = 0").select("id")
    got = paths.frontier(own, some)
    assert rows(got) == rows(paths.distances(g, some))
    held = [(r["src"], r["dst"]) for r in got.coalesce(1).collect()]
    assert sum(a[0] != b[0] for a, b in zip(held, held[1:])) < len(held) / 4  # sources come in runs


def test_clustering_from_points(spark, monkeypatch):
    g, own = both(spark, 0.4, n=300)
    want = rows(measures.clustering(g))
    same(measures.clustering(own), want)
    monkeypatch.setattr(measures, "BLOCK_BYTES", 0)  # many blocks
    same(measures.clustering(own), want)


def test_lengths_that_the_ends_tell_are_not_stored(spark, tmp_path):
    g = both(spark)[0]
    want = rows(g.edges.select("src", "dst", "length"))
    graphs.write_graph(g, f"{tmp_path}/g", {"periodic": False}, straight=True)
    assert "length" not in spark.read.parquet(f"{tmp_path}/g/edges").columns
    own, options = graphs.read_graph(spark, f"{tmp_path}/g")
    assert rows(own.edges.select("src", "dst", "length")) == want and options == {"periodic": False}
    twice = NetworkFrame(g.vertices.unionByName(g.vertices), g.edges)  # no one place to take a length from
    graphs.write_graph(twice, f"{tmp_path}/h", straight=True)
    assert rows(graphs.read_graph(spark, f"{tmp_path}/h")[0].edges.select("src", "dst", "length")) == want


def test_betweenness_from_points(spark):
    g, own = both(spark)
    same(paths.node_betweenness(own), paths.node_betweenness(g))
    ends = [own.vertices.where(x).select("id") for x in ("id % 3 = 0", "id % 3 = 1")]
    same(paths.node_boundary_betweenness(own, *ends), paths.node_boundary_betweenness(g, *ends))
