"""Ways for graphs beyond a task against the kernels that hold a graph in one."""

import gzip

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from meshwright.errors import InvalidArgumentsError
from meshwright.operators import flows, paths, points, waves
from meshwright.schema import NetworkFrame
from meshwright.sources import graphs


def random_graph(spark, n, m, seed, ties=True):
    """Some pieces, isolated vertices, a loop; weights with ties or without."""
    rng = np.random.default_rng(seed)
    pairs = {tuple(sorted(map(int, p))) for p in rng.integers(0, n, (m, 2))} | {(0, 0)}
    weight = (lambda: float(rng.integers(1, 4))) if ties else (lambda: float(rng.random() + 0.1))
    rows = [(a, b, weight()) for a, b in sorted(pairs)]
    xy = rng.random((n + 3, 2)).tolist()
    return NetworkFrame(spark.createDataFrame([(i, *xy[i]) for i in range(n + 3)], "id long, x double, y double"), spark.createDataFrame(rows, "src long, dst long, w double"))


def rows(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def same(got, want, keys, values):
    got, want = rows(got, *keys), rows(want, *keys)
    assert set(got) == set(want)
    for k, r in want.items():
        assert [got[k][v] for v in values] == pytest.approx([r[v] for v in values]), k


@pytest.mark.parametrize("weight", [None, "w"])
def test_betweenness_over_tables(spark, monkeypatch, weight):
    g = random_graph(spark, 12, 17, 1)
    sources, targets = g.vertices.where("id < 8"), g.vertices.where("id > 5")
    ask = (lambda: paths._both_kinds(g, sources, targets, weight)) if weight else (lambda: paths.node_betweenness(g))
    keys, value = (("kind", "src", "dst"), "value") if weight else (("id",), "betweenness")
    want = spark.createDataFrame((got := ask()).collect(), got.schema)
    monkeypatch.setattr(paths, "MOST_EDGES", 0)
    monkeypatch.setattr(paths, "BLOCK_ROWS", 150)
    same(ask(), want, keys, [value])


def test_weights_must_be_positive(spark, monkeypatch):
    g = random_graph(spark, 5, 5, 3)
    monkeypatch.setattr(paths, "MOST_EDGES", 0)
    with pytest.raises(InvalidArgumentsError):
        paths.boundary_betweenness(NetworkFrame(g.vertices, g.edges.withColumn("w", F.lit(0.0))), g.vertices, g.vertices, "w")


@pytest.mark.parametrize("weight", [None, "w"])
def test_reach_in_blocks(spark, monkeypatch, weight):
    g = random_graph(spark, 70, 150, 5, ties=False)
    want = spark.createDataFrame(paths.reach(g, weight).collect(), "id long, n long, total double, longest double")
    longest = paths.diameter(g, weight).first()[0]
    monkeypatch.setattr(paths, "MOST_EDGES", 0)
    monkeypatch.setattr(paths, "BLOCK_ROWS", 60 if weight is None else 4_000)
    same(paths.reach(g, weight), want, ("id",), ["n", "total", "longest"])
    assert paths.diameter(g, weight).first()[0] == longest


def test_diameter_by_bounds_of_shapes(spark, monkeypatch):
    monkeypatch.setattr(paths, "MOST_EDGES", 0)
    line = [(i, i + 1) for i in range(7)]
    ring = [(100 + i, 100 + (i + 1) % 5) for i in range(5)]
    for pairs, want in ((line + ring, 7), ([], None)):
        e = spark.createDataFrame(pairs, "src long, dst long")
        v = spark.createDataFrame([(x,) for x in sorted({x for p in pairs for x in p} | {999})], "id long")
        assert paths.diameter(NetworkFrame(v, e)).first()[0] == want


def test_vertices_count_as_well(spark, monkeypatch):
    g = NetworkFrame(spark.range(40).select("id"), spark.createDataFrame([(1, 2)], "src long, dst long"))
    monkeypatch.setattr(paths, "MOST_EDGES", 30)
    assert not paths.fits(g)
    monkeypatch.setattr(paths, "MOST_EDGES", 40)
    assert paths.fits(g)


def test_gyration_by_trees_is_the_walk_of_every_pair():
    """Every path walked back by itself, on random graphs."""
    rng = np.random.default_rng(6)
    for n, m, sampling in ((30, 45, 1), (30, 25, 3), (12, 40, 2)):
        import pandas as pd

        pairs = sorted({tuple(sorted(p)) for p in rng.integers(0, n, (m, 2)).tolist() if p[0] != p[1]})
        frame = pd.DataFrame([(*p, rng.random() + 0.1) for p in pairs], columns=["src", "dst", "w"])
        c, xy = paths.arrays(np.arange(n), frame), rng.random((n, 2))
        mass = rng.random(len(c.to))
        mass[np.argsort(c.edge, kind="stable")] = np.repeat(rng.random(len(pairs)), 2)
        sources = np.arange(0, n, sampling)
        want = np.zeros(3)
        for s in sources.tolist():
            dist = paths.nearest_first(c, s)[0]
            for t in range(s + sampling, n, sampling):
                v = t
                while np.isfinite(dist[t]) and v != s:
                    near = np.arange(c.start[v], c.start[v + 1])
                    near = near[dist[c.to[near]] < dist[v]]
                    k = near[np.argmin(np.abs(dist[c.to[near]] + c.weight[near] - dist[v]))]
                    dx, dy = xy[v] - xy[c.to[k]]
                    want += mass[k] * np.array([dx * dx, dy * dy, dx * dy])
                    v = int(c.to[k])
        assert paths.gyration_sums(c, xy, mass, sources, sampling) == pytest.approx(want)


def test_sparse_solves_are_the_dense_ones(spark, monkeypatch):
    """Two pieces and isolated vertices; parallel edges with weights."""
    g = random_graph(spark, 30, 50, 9, ties=False)
    g = NetworkFrame(g.vertices.withColumns({"low": F.expr("id % 5 = 1"), "high": F.expr("id % 7 IN (2, 3)")}), g.edges.unionByName(g.edges.where("src % 3 = 1")).where("src <> dst"))
    ask = {
        "pinv": (lambda: flows.pseudo_inverse(g, "w"), ("row", "col"), "value"),
        "linear": (lambda: flows.random_walk_betweenness(g, "low", "high", "w").groupBy("src", "dst").agg(F.sum("betweenness").alias("betweenness")), ("src", "dst"), "betweenness"),
        "plain": (lambda: flows.random_walk_betweenness(g, [1, 2, 3], [2, 8], None), ("src", "dst"), "betweenness"),
        "all": (lambda: flows.current_flow_betweenness(g, "w").groupBy("src", "dst").agg(F.sum("betweenness").alias("betweenness")), ("src", "dst"), "betweenness"),
        "resistance": (lambda: flows.effective_resistance(g, 1, 4, "w"), (), "by_inverse"),
    }
    ghost = lambda: flows.random_walk_betweenness(joined, [0, 1], [3], "w", ghost=True)
    joined = NetworkFrame(spark.range(4).select("id"), spark.createDataFrame([(0, 1, 1.0), (1, 2, 0.5), (2, 3, 2.0), (0, 3, 0.7)], "src long, dst long, w double"))
    ask["ghost"] = (ghost, ("src", "dst"), "betweenness")
    want = {k: rows(f(), *keys) for k, (f, keys, _) in ask.items()}
    monkeypatch.setattr(flows, "MOST_VERTICES", 2)
    monkeypatch.setattr(flows, "NUMBERS", 400)
    for k, (f, keys, value) in ask.items():
        got = rows(f(), *keys)
        assert set(got) == set(want[k]), k
        assert [got[x][value] for x in sorted(got)] == pytest.approx([want[k][x][value] for x in sorted(got)], abs=1e-8), k
    monkeypatch.setattr(paths, "MOST_EDGES", 3)
    with pytest.raises(InvalidArgumentsError):
        flows.current_flow_betweenness(g, "w")


def test_dense_steps_come_in_ranges_of_edges(monkeypatch):
    """No more numbers at a time than are allowed, and the same sums."""
    import pandas as pd

    rng = np.random.default_rng(2)
    pairs = sorted({tuple(sorted(p)) for p in rng.integers(0, 9, (30, 2)).tolist() if p[0] != p[1]})
    c = paths.arrays(np.arange(9), pd.DataFrame([(*p, rng.random()) for p in pairs], columns=["src", "dst", "w"]))
    q, asked = rng.random((9, 9)), []

    def total(steps):
        asked.append(steps.size)
        return steps.sum(0)

    monkeypatch.setattr(flows, "NUMBERS", 40)
    a, b = c.ends.T
    assert flows.by_ranges(c, q, total) == pytest.approx(((q[a] - q[b]) * flows._edge_weights(c)[:, None]).sum(1))
    assert max(asked) <= 40 and sum(asked) == len(pairs) * 9


def test_waves_are_the_levels_of_each_source(spark, monkeypatch):
    """Pieces, isolated vertices and a loop; no table of pairs is joined with the edges."""
    from meshwright.operators import waves

    g = random_graph(spark, 150, 260, 4)
    some = g.vertices.where("id % 2 = 0")
    monkeypatch.setattr(waves, "PIECE", 7)
    monkeypatch.setattr(waves, "WORDS", 1)
    monkeypatch.setattr(paths, "pairs_in_reach", None)
    got = {(r["src"], r["dst"]): r["distance"] for r in paths.frontier(g, some).collect()}
    assert got == {(r["src"], r["dst"]): r["distance"] for r in paths.distances(g, some).collect()}
    want = spark.createDataFrame(paths.reach(g).collect(), "id long, n long, total double, longest double")
    monkeypatch.setattr(paths, "MOST_EDGES", 0)
    same(paths.reach(g), want, ("id",), ["n", "total", "longest"])


def test_the_laplacian_times_a_matrix_goes_by_blocks_of_columns(spark, monkeypatch):
    """Blocks smaller than a matrix, two graphs; a vertex without edges has its row."""
    monkeypatch.setattr(flows, "NUMBERS", 40)
    v = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (1, 7)], "frame int, id long")
    e = spark.createDataFrame([(0, 1, 2, 2.0), (0, 2, 3, 0.5)], "frame int, src long, dst long, w double")
    q = spark.createDataFrame([(0, i, j, float(i == j)) for i in (1, 2, 3) for j in (1, 2, 3)] + [(1, 7, 7, 1.0)], "frame int, row long, col long, value double")
    got = rows(flows.laplacian_times(NetworkFrame(v, e), q, "w", by="frame"), "frame", "row", "col")
    want = [[2.0, -2.0, 0.0], [-2.0, 2.5, -0.5], [0.0, -0.5, 0.5]]
    assert len(got) == 10 and got[1, 7, 7]["value"] == 0
    assert [[got[0, i, j]["value"] for j in (1, 2, 3)] for i in (1, 2, 3)] == [pytest.approx(r) for r in want]


def test_beyond_what_a_task_holds_waves_go_over_tables(spark, monkeypatch):
    from meshwright.operators import waves

    g = random_graph(spark, 20, 30, 5)
    want = spark.createDataFrame(paths.reach(g).collect(), "id long, n long, total double, longest double")
    monkeypatch.setattr(paths, "MOST_EDGES", 0)
    monkeypatch.setattr(waves, "MOST_NEAR", 0)
    assert not waves.held(g)
    same(paths.reach(g), want, ("id",), ["n", "total", "longest"])
    assert paths.diameter(g).first()[0] == max(r["longest"] for r in want.collect())


@pytest.mark.parametrize("rows_at_once", [2, 256])
def test_shares_by_waves(spark, monkeypatch, rows_at_once):
    g = random_graph(spark, 40, 90, 11)
    monkeypatch.setattr(waves, "ROWS", rows_at_once)
    sources, targets = g.vertices.where("id < 30"), g.vertices.where("id > 12")
    want = paths.counted_over_tables(g, sources, targets, None)
    want = spark.createDataFrame(want.where("src <> dst OR kind = 'node'").collect(), want.schema)
    same(waves.shares(g, sources, targets, True), want, ("kind", "src", "dst"), ["value"])
    same(waves.shares(g, sources, targets, False), want.where("kind = 'node'"), ("kind", "src", "dst"), ["value"])


def test_node_betweenness_makes_no_tables_where_a_task_may_hold_the_graph(spark, monkeypatch):
    g = random_graph(spark, 20, 30, 12)
    monkeypatch.setattr(paths, "MOST_EDGES", 0)
    monkeypatch.setattr(paths, "counted_over_tables", None)
    assert paths.node_betweenness(g).count() == paths.node_boundary_betweenness(g, g.vertices, g.vertices).count() == 23


def test_average_betweenness_needs_distances_only(spark, monkeypatch):
    g = random_graph(spark, 25, 30, 13)
    want = paths.node_betweenness(g).agg(F.avg("betweenness")).first()[0]
    monkeypatch.setattr(paths, "_both_kinds", None)
    assert paths.average_betweenness(g).first()[0] == pytest.approx(want)
    assert paths.average_betweenness(NetworkFrame(g.vertices.limit(0), g.edges.limit(0))).first()[0] is None


def test_cutoff_in_order(spark, monkeypatch, tmp_path):
    """pairs come sorted over all partitions, the same as by cubes and lengths too, and reach files so; also points that are far out, in one place, or nowhere."""
    rng = np.random.default_rng(5)
    xyz = np.concatenate([rng.normal(0, 0.1, (300, 3)), np.zeros((3, 3)), [[1e6, 0, 0], [1e6, 0, 0.01], [np.nan, 0, 0], [np.inf, 0, 0]]])
    ids = rng.permutation(len(xyz)) * 7
    p = spark.createDataFrame([(int(i), *map(float, row)) for i, row in zip(ids, xyz, strict=True)], "pid long, x double, y double, z double").repartition(3)
    want = sorted(map(tuple, points.cutoff_graph(p.where("abs(x) < 1e9"), 0.08).collect()))
    got = [tuple(r) for r in points.cutoff_in_order(p, 0.08).collect()]
    assert len(want) > 500 and got == want
    g = NetworkFrame(p.withColumnRenamed("pid", "id"), points.cutoff_in_order(p, 0.08))
    graphs.write_csv(g, str(tmp_path), ordered=True, compression="gzip")
    rows = [tuple(map(int, line.split(","))) for f in sorted((tmp_path / "edgeList.csv").glob("part-*.csv.gz")) for line in gzip.open(f, "rt")]
    assert rows == [r[:2] for r in want]
    monkeypatch.setattr(points, "MOST_POINTS", 100)
    assert [tuple(r) for r in points.cutoff_in_order(p, 0.08).collect()] == want
    assert points.cutoff_in_order(p.where("pid < 0"), 0.08).count() == 0


def test_stored_edges_take_little_room(spark, tmp_path):
    """ends of sorted edges are stored as differences, a few bits each; lengths come back to the last bit."""
    rng = np.random.default_rng(6)
    p = spark.createDataFrame([(100_000 * i, *map(float, row)) for i, row in enumerate(rng.random((1500, 3)))], "pid long, x double, y double, z double")
    edges = points.cutoff_in_order(p, 0.5)
    graphs.write_graph(NetworkFrame(p.withColumnRenamed("pid", "id"), edges), str(tmp_path), {"periodic": False})
    columns = [c for f in (tmp_path / "edges").rglob("*.parquet") for m in [pq.ParquetFile(f).metadata] for k in range(m.num_row_groups) for c in map(m.row_group(k).column, range(m.num_columns))]
    ends = [c for c in columns if c.path_in_schema in ("src", "dst")]
    assert {e for c in ends for e in c.encodings if e != "RLE"} == {"DELTA_BINARY_PACKED"}
    assert sum(c.total_compressed_size for c in ends) < 4 * edges.count()
    assert sorted(map(tuple, graphs.read_graph(spark, str(tmp_path))[0].edges.collect())) == sorted(map(tuple, points.cutoff_graph(p, 0.5).collect()))
