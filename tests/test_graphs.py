"""Closed forms on four-vertex graphs, invariants, and agreement of independent ways."""

import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwright.errors import InvalidArgumentsError
from meshwright.operators import components, flows, iterate, measures, paths, points
from meshwright.schema import NetworkFrame

PATH, CYCLE, STAR = [(0, 1), (1, 2), (2, 3)], [(0, 1), (1, 2), (2, 3), (0, 3)], [(0, 1), (0, 2), (0, 3)]
COMPLETE = [(i, j) for i in range(4) for j in range(i + 1, 4)]
SHAPES = {"path": PATH, "cycle": CYCLE, "star": STAR, "complete": COMPLETE}


def graph(spark, pairs, n=4):
    e = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src long, dst long, w double")
    return NetworkFrame(spark.createDataFrame([(i,) for i in range(n)], "id long"), e)


def by_id(df, column):
    return {r["id"]: r[column] for r in df.collect()}


@pytest.mark.parametrize(
    ("shape", "density", "diameter", "clustering", "assortativity", "closeness", "between", "connectivity", "r03", "r02"),
    [
        ("path", 1 / 2, 3, 0, -0.5, [1 / 2, 3 / 4, 3 / 4, 1 / 2], [0, 1 / 6, 1 / 6, 0], 1, 3, 2),
        ("cycle", 2 / 3, 2, 0, None, [3 / 4] * 4, [1 / 24] * 4, 2, 3 / 4, 1),
        ("star", 1 / 2, 2, 0, -1, [1, 3 / 5, 3 / 5, 3 / 5], [1 / 4, 0, 0, 0], 1, 1, 1),
        ("complete", 1, 1, 1, None, [1] * 4, [0] * 4, None, 1 / 2, 1 / 2),
    ],
)
def test_closed_forms(spark, shape, density, diameter, clustering, assortativity, closeness, between, connectivity, r03, r02):
    g = graph(spark, SHAPES[shape])
    assert measures.size(g).first()["density"] == pytest.approx(density)
    assert paths.diameter(g).first()[0] == diameter
    assert measures.average(measures.clustering(g), "clustering", "c").first()[0] == pytest.approx(clustering)
    got = measures.assortativity(g).first()[0]
    assert got is None if assortativity is None else got == pytest.approx(assortativity)
    assert [by_id(paths.closeness(g), "closeness")[i] for i in range(4)] == pytest.approx(closeness)
    assert [by_id(paths.node_betweenness(g), "betweenness")[i] for i in range(4)] == pytest.approx(between)
    got = flows.average_nodal_connectivity(g).first()[0]
    assert got is None if connectivity is None else got == connectivity
    for t, r in ((3, r03), (2, r02)):
        row = flows.effective_resistance(g, 0, t).first()
        assert row["by_inverse"] == pytest.approx(r) and row["by_determinants"] == pytest.approx(r)


def test_boundary_betweenness_on_a_path(spark):
    g = graph(spark, PATH)
    one = lambda i: spark.createDataFrame([(i,)], "id long")
    node, edge = paths.boundary_betweenness(g, one(0), one(3))
    assert by_id(node, "betweenness") == {0: 0, 1: 0.5, 2: 0.5, 3: 0}
    assert [r["betweenness"] for r in edge.collect()] == [0.5] * 3


def random_graph(spark, n=24, m=50, seed=4):
    rng = np.random.default_rng(seed)
    pairs = {tuple(sorted(map(int, rng.choice(n, 2, replace=False)))) for _ in range(m)} | {(i, i + 1) for i in range(n - 1)}
    e = spark.createDataFrame([(a, b, float(rng.integers(1, 5))) for a, b in sorted(pairs)], "src long, dst long, w double")
    return NetworkFrame(spark.createDataFrame([(i,) for i in range(n)], "id long"), e), sorted(pairs)


def test_handshake_and_strength(spark):
    g, pairs = random_graph(spark)
    assert measures.degree(g).agg(F.sum("degree")).first()[0] == 2 * len(pairs)
    assert measures.degree(g, "w").agg(F.sum("degree")).first()[0] == 2 * g.edges.agg(F.sum("w")).first()[0]


def test_kernel_and_frontier_agree(spark):
    g, _ = random_graph(spark)
    for weight in (None, "w"):
        a = {(r["src"], r["dst"]): r["distance"] for r in paths.distances(g, weight=weight).collect()}
        b = {(r["src"], r["dst"]): r["distance"] for r in paths.frontier(g, g.vertices, weight).collect()}
        assert a == b


def test_weighted_boundary_flow_is_conserved(spark):
    g, _ = random_graph(spark)
    s, t = spark.createDataFrame([(0,)], "id long"), spark.createDataFrame([(23,)], "id long")
    node, edge = paths.boundary_betweenness(g, s, t, "w")
    into = edge.where("src = 23 OR dst = 23").agg(F.sum("betweenness")).first()[0]
    assert into == pytest.approx(0.5)


def disjoint_by_cuts(pairs, n, s, t):
    """Fewest vertices whose removal parts s and t, by trying all sets."""
    from itertools import combinations

    others = [v for v in range(n) if v not in (s, t)]
    for k in range(len(others) + 1):
        for cut in combinations(others, k):
            seen, stack = {s}, [s]
            while stack:
                v = stack.pop()
                for a, b in pairs:
                    for x, y in ((a, b), (b, a)):
                        if x == v and y not in seen and y not in cut:
                            seen.add(y)
                            stack.append(y)
            if t not in seen:
                return k
    return None


def test_nodal_connectivity_against_cuts(spark):
    g, pairs = random_graph(spark, 8, 12, 3)
    joined = set(pairs)
    want = [disjoint_by_cuts(pairs, 8, s, t) for s in range(8) for t in range(s + 1, 8) if (s, t) not in joined]
    assert flows.average_nodal_connectivity(g).first()[0] == pytest.approx(sum(want) / len(want))


def test_current_is_conserved_and_ways_agree(spark):
    g, _ = random_graph(spark)
    dense = by_id(flows.potentials(g, 0, 23), "potential")
    assert dense[0] - dense[23] == pytest.approx(flows.effective_resistance(g, 0, 23).first()["by_inverse"])
    loose = by_id(flows.relaxed(g, 0, 23, tolerance=1e-8, most=60), "potential")
    assert all(loose[i] == pytest.approx(dense[i], abs=1e-5) for i in dense)
    e = flows.random_walk_betweenness(g, [0], [23], "w")
    assert e.where("src = 0 OR dst = 0").agg(F.sum("betweenness")).first()[0] == pytest.approx(1.0)
    ghost = flows.random_walk_betweenness(g, [0], [23], "w", ghost=True)
    assert {(r[0], r[1]): round(r[2], 6) for r in ghost.collect()} == {(r[0], r[1]): round(r[2], 6) for r in e.collect()}


def test_all_pairs_current_against_sums(spark):
    g, _ = random_graph(spark, 8, 10, 1)
    fast = {(r[0], r[1]): r[2] for r in flows.current_flow_betweenness(g, "w").collect()}
    c = paths.csr(g, "w")
    q, total = flows.inverse(flows.laplacian(c)), {}
    w = {tuple(c.ids[c.ends[k]]): c.weight[list(c.edge).index(k)] for k in range(len(c.ends))}
    for (a, b), x in w.items():
        total[(a, b)] = sum(abs(x * ((q[a] - q[b])[u] - (q[a] - q[b])[v])) for u in range(8) for v in range(u + 1, 8))
    assert fast == pytest.approx(total)


def test_unreachable_terminals_are_null(spark):
    g = graph(spark, [(0, 1), (2, 3)])
    assert set(by_id(flows.potentials(g, 0, 3), "potential").values()) == {None}


@pytest.mark.parametrize("few", [0, 10**6])
def test_components_of_chains_and_hubs(spark, few):
    edges = [(i, i + 1) for i in range(1, 60)] + [(1000, 1001 + i) for i in range(700)] + [(5000, 5001), (5001, 5000), (7, 7)]
    g = measures.graph_of(spark.createDataFrame(edges, "src long, dst long"))
    rows = [r["id"] for r in g.vertices.collect()]
    g = NetworkFrame(g.vertices.unionByName(spark.createDataFrame([(9000,)], "id long")), g.edges)
    got = {r["id"]: r["component"] for r in components.components(g, few).collect()}
    assert got == {i: 1 if i < 100 else 1000 if i < 5000 else 5000 for i in rows} | {9000: 9000}


@pytest.mark.parametrize("few", [0, 40])
def test_components_against_a_walk(spark, few):
    rng = np.random.default_rng(few)
    pairs = [(f"v{a}", f"v{b}") for a, b in rng.integers(0, 150, (110, 2))] + [(f"w{i * 7 % 90}", f"w{(i + 1) * 7 % 90}") for i in range(89)] + [("v1", None), (None, "v2")]
    g = NetworkFrame(spark.createDataFrame([(f"v{i}",) for i in range(150)] + [(f"w{i}",) for i in range(90)], "id string"), spark.createDataFrame(pairs, "src string, dst string"))
    near = {}
    for a, b in pairs:
        if a and b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    got = by_id(components.components(g, few), "component")
    assert len(got) == 240
    for start in got:
        seen, todo = {start}, [start]
        while todo:
            new = near.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        assert got[start] == min(seen)


def test_contraction_shrinks_paths(spark):
    """A path in an order that is bad for least labels loses a third of its vertices or more in a turn."""
    n = 3000
    edges = spark.range(n - 1).select((F.col("id") + 1).alias("src"), F.col("id").alias("dst"))
    after, step = components.contracted(edges, n - 1, 0)
    assert step.count() == n and step.agg(F.sum("n")).first()[0] == 2 * (n - 1)
    assert after.count() == step.select("first").distinct().count() - 1 < n * 2 / 3


def test_lookups_of_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(iterate, "FEW_ROWS", 10)
    rows = spark.createDataFrame([(i % 3 if i < 900 else i, i) for i in range(1000)] + [(None, -1)], "k long, i long")
    table = spark.createDataFrame([(k, str(k)) for k in (0, 1, 950, 951)], "k long, name string")
    for hot in (iterate.hot_keys(rows, "k", 100), rows.limit(0)):
        inner = {(r["i"], r["name"]) for r in iterate.looked_up(rows, table, "k", hot).collect()}
        assert inner == {(i, str(i % 3)) for i in range(900) if i % 3 < 2} | {(950, "950"), (951, "951")}
        assert iterate.looked_up(rows, table, "k", hot, outer=True).count() == 1001


def test_components_giant_and_renumbering(spark):
    g = graph(spark, [(5, 9), (9, 7), (1, 2)], 10)
    own = by_id(components.components(g), "component")
    assert own[5] == own[7] == own[9] == 5 and own[1] == own[2] == 1 and own[0] == 0
    assert {(r["src"], r["dst"]) for r in components.renumbered(components.giant(g)).edges.collect()} == {(0, 2), (2, 1)}


def test_empty_graph(spark):
    g = graph(spark, [], 0)
    row = measures.size(g).first()
    assert row["n_nodes"] == 0 and row["density"] is None
    assert paths.diameter(g).first()[0] is None
    assert components.components(g).count() == 0


def test_closed_walks_is_the_trace(spark):
    g, pairs = random_graph(spark, 9, 14, 2)
    a = np.zeros((9, 9))
    for s, d in pairs:
        a[s, d] = a[d, s] = 1
    assert measures.closed_walks(g, 5).first()[0] == np.trace(np.linalg.matrix_power(a, 5)) / 2


def test_gyration_of_a_line(spark):
    e = spark.createDataFrame([(0, 1, 1.0, 2.0), (1, 2, 1.0, 2.0)], "src long, dst long, resistance double, conductance double")
    v = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 2.0, 3.0)], "id long, x double, y double")
    row = paths.gyration(NetworkFrame(v, e)).first()
    assert (row["xx"], row["yy"], row["xy"]) == (8.0, 36.0, 12.0)


def test_gyration_of_many_graphs_is_shared_out(spark, monkeypatch):
    """A line in each of three graphs, and lone vertices in a fourth; no graph passes the driver."""
    monkeypatch.setattr(paths, "csr", None)
    e = spark.createDataFrame([(k, 10 * k + i, 10 * k + i + 1, 1.0, 2.0) for k in range(3) for i in range(2)], "k int, src long, dst long, resistance double, conductance double")
    at = [(0.0, 0.0), (1.0, 0.0), (2.0, 3.0)]
    v = spark.createDataFrame([(k, 10 * k + i, *at[i]) for k in range(4) for i in range(3)], "k int, id long, x double, y double")
    row = paths.gyration(NetworkFrame(v, e), by="k").first()
    assert (row["xx"], row["yy"], row["xy"]) == (24.0, 108.0, 36.0)


def test_nearest_within_a_radius_take_no_table_of_near_pairs(spark, monkeypatch):
    """A crowd of which all are near each other, copies of one point, a lone one, and points that have no place."""
    rng = np.random.default_rng(8)
    at = np.concatenate([rng.normal(0, 0.01, (80, 3)), np.zeros((9, 3)), rng.normal(0, 0.3, (40, 3)), [[50.0, 0, 0]]])
    df = spark.createDataFrame([*((i, *map(float, p)) for i, p in enumerate(at)), (500, float("nan"), 0.0, 0.0), (501, None, 0.0, 0.0), (502, float("inf"), 0.0, 0.0)], "pid long, x double, y double, z double")
    gap = np.sqrt(((at[:, None] - at[None]) ** 2).sum(2))
    want = {(i, j, k + 1) for i in range(len(at)) for k, j in enumerate(sorted((j for j in range(len(at)) if j != i), key=lambda j, i=i: (gap[i, j], j))[:3]) if gap[i, j] <= 0.1 and i < j}
    monkeypatch.setattr(points, "cutoff_graph", None)
    assert {(r["src"], r["dst"], r["rank"]) for r in points.knn_graph(df, 3, 0.1).collect()} == want


def test_linked_points_are_in_the_components_of_all_near_pairs(spark):
    """Crowds, copies, lone points and points on the borders of cells, in two groups; a crowd of n points takes some n pairs."""
    rng = np.random.default_rng(9)
    at = np.concatenate([rng.normal(0, 0.02, (150, 3)), np.repeat(rng.random((5, 3)), 6, 0), rng.random((120, 3)) * 1.2 - 0.6, np.arange(-12, 12)[:, None] * [0.1 / points.CELLS, 0, 0] + [0, 3, 0], [[float(k), 5, 5] for k in range(3)]])
    rows = [(i % 2, i, *map(float, p)) for i, p in enumerate(at)]
    df = spark.createDataFrame([*rows, (0, 900, float("nan"), 0.0, 0.0), (0, 901, None, 0.0, 0.0)], "frame int, pid long, x double, y double, z double")
    v = df.select(F.col("pid").alias("id"))
    for group in ((), ("frame",)):
        near, few = points.cutoff_graph(df, 0.1, group).cache(), points.linked(df, 0.1, group).cache()
        every, some = ({tuple(r) for r in x.select(F.least("src", "dst"), F.greatest("src", "dst")).collect()} for x in (near, few))
        assert some <= every and 0 < len(some) < len(every) / 5
        assert {tuple(r) for r in components.components(NetworkFrame(v, few)).collect()} == {tuple(r) for r in components.components(NetworkFrame(v, near)).collect()}


def test_periodic_distances_round_without_decimals(spark):
    """Half a box apart either way; Spark's round of doubles goes through decimals, pair by pair."""
    df = spark.createDataFrame([(0, 0.0, 0.25, 0.0), (1, 0.5, 0.75, 0.0), (2, 0.95, 0.25, 0.0)], "pid long, x double, y double, z double")
    g = points.cutoff_graph(df, 0.8, box=(1.0, 1.0, 1.0))
    assert {(r["src"], r["dst"], round(r["length"], 9)) for r in g.collect()} == {(0, 1, round(0.5**0.5, 9)), (0, 2, 0.05), (1, 2, round((0.45**2 + 0.5**2) ** 0.5, 9))}
    plan = g._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" not in plan and "rint(" in plan.lower()


def test_nearest_of_points_far_and_near(spark):
    rng = np.random.default_rng(4)
    at = np.concatenate([rng.normal(0, 0.1, (60, 3)), rng.normal(50, 5, (7, 3)), [[1e4, 0, 0]]])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(at)], "pid long, x double, y double, z double")
    gap = np.sqrt(((at[:, None] - at[None]) ** 2).sum(2))
    want = {(i, int(j), k + 1) for i in range(len(at)) for k, j in enumerate([j for j in np.argsort(gap[i], kind="stable") if j != i][:3])}
    assert {(r["src"], r["dst"], r["rank"]) for r in points.nearest(df, 3).collect()} == want
    assert {(r["src"], r["dst"], r["rank"]) for r in points.knn_graph(df, 3).collect()} == {w for w in want if w[0] < w[1]}
    assert points.nearest(df.limit(2), 5).count() == 2 and points.nearest(df.limit(0), 2).count() == 0


def test_nearest_of_clusters_copies_and_planes(spark, monkeypatch):
    """Radii from a small sample; ties, copies of a point, and points in a plane."""
    monkeypatch.setattr(points, "SAMPLE", 12)
    rng = np.random.default_rng(8)
    cloud = np.concatenate([rng.normal(0, 1e-4, (40, 3)), rng.random((30, 3)) * 100, np.tile([[5.0, 5.0, 5.0]], (12, 1)), [[1e6, 0, 0], [-1e6, 3, 0]]])
    plane = np.concatenate([rng.integers(0, 6, (40, 2)), np.zeros((40, 1))], 1)
    for at in (cloud, plane):
        df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(at)], "pid long, x double, y double, z double")
        gap = np.sqrt(((at[:, None] - at[None]) ** 2).sum(2))
        want = {(i, j, k + 1) for i in range(len(at)) for k, (_, j) in enumerate(sorted((gap[i, j], j) for j in range(len(at)) if j != i)[:3])}
        assert {(r["src"], r["dst"], r["rank"]) for r in points.nearest(df, 3).collect()} == want
    assert points.nearest(df.selectExpr("pid", "0D AS x", "0D AS y", "0D AS z"), 3).count() == 120


def test_blocks_of_a_graph():
    """Two triangles at a vertex, a bridge to a square, and a piece apart."""
    import pandas as pd

    pairs = [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (2, 4), (4, 5), (5, 6), (6, 7), (7, 8), (5, 8), (9, 10)]
    c = paths.arrays(np.arange(12), pd.DataFrame([(*p, 1.0) for p in pairs], columns=["src", "dst", "w"]))
    own, piece = flows.blocks(c)
    assert sorted([*flows._bits(b)] for b in own) == [[0, 1, 2], [2, 3, 4], [4, 5], [5, 6, 7, 8], [9, 10]]
    assert piece == [0] * 9 + [9, 9, 11]
    flow = flows.SplitFlow(c)
    assert [flow.between(*p) for p in ((0, 3), (6, 8), (5, 7), (0, 9), (0, 11), (1, 8))] == [1, 2, 2, 0, 0, 1]


def test_many_graphs_at_once(spark):
    """Two frames: a path and a star; each solved as if alone."""
    v = spark.createDataFrame([(f, 10 * f + i, float(i), 0.0, i == 0, i == 3) for f in (0, 1) for i in range(4)], "frame int, id long, x double, y double, low boolean, high boolean")
    e = spark.createDataFrame([(f, 10 * f + a, 10 * f + b, 1.0) for f, pairs in ((0, PATH), (1, STAR)) for a, b in pairs], "frame int, src long, dst long, w double")
    g = NetworkFrame(v, e)
    wired = flows.with_terminals(g, flows.Terminals("x", (0.0, 0.0), (3.0, 3.0)), "w", by="frame")
    got = {r["frame"]: (r["by_inverse"], r["by_determinants"]) for r in flows.effective_resistance(wired, by="frame").collect()}
    assert np.allclose(got[0], 5) and np.allclose(got[1], 3)
    for own in (flows.potentials(wired, by="frame"), flows.relaxed(wired, F.expr("id < 0 AND id % 2 <> 0"), F.expr("id < 0 AND id % 2 = 0"), by="frame")):
        inflow = by_id(flows.inflows(wired, own), "inflow")
        assert all(abs(x - (0 if i >= 0 else 1 if i % 2 else -1)) < 1e-8 for i, x in inflow.items())
    walk = {(r["src"], r["dst"]): r["betweenness"] for r in flows.random_walk_betweenness(g, "low", "high", "w", by="frame").collect()}
    assert np.allclose([walk[0, 1], walk[2, 3], walk[10, 13], walk[10, 11]], [1, 1, 1, 0])
    assert {r["frame"]: r["average_nodal_connectivity"] for r in flows.average_nodal_connectivity(g, by="frame").collect()} == {0: 1.0, 1: 1.0}
    q = {(r["row"], r["col"]): r["value"] for r in flows.pseudo_inverse(g, by="frame").collect()}
    assert np.isclose(q[0, 0] + q[3, 3] - 2 * q[0, 3], 3) and (0, 10) not in q
    assert flows.terminal_voxels(wired).where("src = -1").count() == 11
    with pytest.raises(InvalidArgumentsError):
        flows.relaxed(wired, F.expr("id < 0 AND id % 2 <> 0"), F.expr("id < 0 AND id % 2 = 0"), most=1, by="frame")


def test_many_graphs_too_large_for_dense_solves(spark, monkeypatch):
    """Three connected graphs, one of which lies apart from its target, solved over a table of edges as densely; and terminals without an edge."""
    rng = np.random.default_rng(12)
    v, e = [], []
    for f in range(3):
        at = rng.random((14, 2))
        v += [(f, 100 * f + i, *map(float, p), bool(p[0] < 0.4), bool(p[0] > 0.6) and f < 2) for i, p in enumerate(at)]
        e += [(f, 100 * f + i, 100 * f + j, float(rng.random() + 0.1)) for i in range(14) for j in range(i + 1, 14) if j == i + 1 or rng.random() < 0.2]
    g = NetworkFrame(spark.createDataFrame(v, "frame int, id long, x double, y double, low boolean, high boolean"), spark.createDataFrame(e, "frame int, src long, dst long, w double"))
    wired = flows.with_terminals(g, flows.Terminals("x", (0.0, 0.4), (0.6, 1.0)), "w", by="frame")
    cut = NetworkFrame(wired.vertices, wired.edges.where("frame < 2 OR src >= 0"))
    monkeypatch.setattr(flows, "RANGE", 16)

    def solved():
        yield {r["frame"]: (r["by_inverse"], r["by_determinants"]) for r in flows.effective_resistance(wired, by="frame").collect()}
        yield {r["id"]: r["potential"] for r in flows.potentials(cut, by="frame").collect()}
        yield {(r["frame"], r["src"], r["dst"]): r["betweenness"] for r in flows.random_walk_betweenness(g, "low", "high", weight="w", ghost=True, by="frame").collect()}
        yield by_id(flows.relaxed(wired, F.expr("id < 0 AND id % 2 <> 0"), F.expr("id < 0 AND id % 2 = 0"), by="frame"), "potential")

    want = [*solved()]
    monkeypatch.setattr(flows, "MOST_VERTICES", 5)
    got = [*solved()]
    for a, b in zip(want, got, strict=True):
        assert a.keys() == b.keys() and len(a)
        for k in a:
            assert (a[k] is None and b[k] is None) or np.allclose(a[k], b[k], atol=1e-7)
    assert any(x is None for x in got[1].values())
    monkeypatch.setattr(flows, "MOST_HELD", 0)  # tables only
    own = by_id(flows.relaxed(wired, F.expr("id < 0 AND id % 2 <> 0"), F.expr("id < 0 AND id % 2 = 0"), by="frame"), "potential")
    assert own.keys() == got[3].keys() and all(abs(own[k] - got[3][k]) < 1e-7 for k in own)


def test_gyration_by_samples_and_both_ways(spark):
    v = spark.createDataFrame([(i, i + 0.5, 0.0) for i in range(4)], "id long, x double, y double")
    e = spark.createDataFrame([(a, b, 1.0, 1.0) for a, b in PATH], "src long, dst long, resistance double, conductance double")
    g = NetworkFrame(v, e)
    assert [paths.gyration(g, **how).first()["xx"] for how in ({}, {"ordered": True}, {"sampling": 2}, {"whole": True})] == [10.0, 20.0, 2.0, 10.0]


def test_levels_against_heaps(spark):
    """Distances and shares by whole levels agree with those by weight, all weights being one."""
    rng = np.random.default_rng(3)
    pairs = sorted({(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 30, (60, 2)) if a != b})
    c = paths.csr(graph(spark, pairs, 30), "w")
    targets = rng.random(30) < 0.5
    for s in range(30):
        assert (paths.lengths(c, s, False) == paths.lengths(c, s, True)).all()
        for a, b in zip(paths.shares(c, s, targets, False), paths.shares(c, s, targets, True), strict=True):
            assert np.allclose(a, b)


def test_scratch_is_cleared(spark):
    with iterate.scratch():
        kept = iterate.stored(spark.range(3))
        assert kept.count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(kept.stored_at).count()


def test_what_is_left_goes_at_the_end(tmp_path):
    """A program that stops its session, and one that does not."""
    for last in ("", "spark.stop()"):
        code = f"""
import sys
sys.path.insert(0, {str(Path(iterate.__file__).parents[2])!r})
from pyspark.sql import SparkSession
from meshwright.operators.iterate import stored
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate()
print(stored(spark.range(3)).count(), len([*__import__("pathlib").Path({str(tmp_path)!r}).glob("round-*")]))
{last}
"""
        out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
        assert out.stdout.split()[-2:] == ["3", "1"] and not [*tmp_path.glob("round-*")], out.stderr[-500:]


def test_degrees_of_few_vertices_are_broadcast(spark, monkeypatch):
    """The edges are not shuffled to their ends' degrees; beyond that many vertices they are, with the same result."""
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (1, 3), (3, 4)], "src long, dst long")
    got, plans = [], []
    monkeypatch.setattr(measures, "stored", lambda df: df.localCheckpoint())
    with_no_hint = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most in (10, 0):
            monkeypatch.setattr(measures, "BROADCAST_VERTICES", most)
            df = measures.assortativity(measures.graph_of(e))
            plans.append(df._jdf.queryExecution().toString())
            got.append(df.first()[0])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", with_no_hint)
    assert "SortMergeJoin" not in plans[0] and "BroadcastHashJoin" in plans[0] and "SortMergeJoin" in plans[1]
    assert got[0] == pytest.approx(got[1])


@pytest.mark.parametrize("block_bytes", [100_000_000, 40])
def test_triangles_of_dense_graphs_by_bits(spark, monkeypatch, block_bytes):
    """The same as by wedges: isolated vertices, a loop and repeated edges, whatever the number of blocks."""
    rng = np.random.default_rng(8)
    pairs = [tuple(map(int, p)) for p in rng.integers(0, 40, (260, 2))] + [(1, 1), (3, 2), (2, 3)]
    g = graph(spark, pairs, 43)
    want = by_id(measures.clustering(g), "clustering")
    monkeypatch.setattr(measures, "DENSE", 0)
    monkeypatch.setattr(measures, "BLOCK_BYTES", block_bytes)
    assert by_id(measures.clustering(g), "clustering") == pytest.approx(want)


def test_terminals_need_no_edges(spark):
    v = spark.createDataFrame([(0, 0, 0.0, 1.0), (0, 1, 5.0, 3.0), (1, 2, 0.0, 0.0)], "frame int, id long, x double, y double")
    got = flows.terminals(v, flows.Terminals("x", (0.0, 1.0), (4.0, 5.0)), by="frame")
    assert {(r["frame"], r["src"], r["dst"]) for r in got.edges.collect()} == {(0, -1, 0), (0, -2, 1), (1, -3, 2)}
    assert {r["id"]: (r["x"], r["y"]) for r in got.vertices.where("id < 0").collect()} == {-1: (-10.0, 2.0), -2: (15.0, 2.0), -3: (-10.0, 0.0), -4: (10.0, 0.0)}


@pytest.mark.parametrize("n", [8, 90])
def test_closed_walks_start_by_start(spark, monkeypatch, n):
    rng = np.random.default_rng(n)
    pairs = {tuple(sorted(map(int, p))) for p in rng.integers(0, n, (n, 2))}
    a = np.zeros((n, n))
    for x, y in pairs:
        a[x, y] = a[y, x] = x != y
    g = NetworkFrame(spark.range(n).select("id"), spark.createDataFrame(sorted(pairs), "src long, dst long"))
    monkeypatch.setattr(measures.waves, "PIECE", 4)
    for k in (3, 4):
        assert "Join" not in measures.closed_walks(g, k)._jdf.queryExecution().toString()
        assert measures.closed_walks(g, k).first()[0] == np.trace(np.linalg.matrix_power(a, k)) / 2


@pytest.mark.parametrize("parts", [1, 3])
def test_connectivity_bounds_against_flows(parts):
    """on clouds, two clouds with a neck and random graphs the bounds meet at the number of disjoint paths, but for few pairs; sums over parts are the whole."""
    import pandas as pd

    rng, settled, pairs = np.random.default_rng(8), 0, 0
    for trial in range(9):
        n = 26
        xy = np.concatenate([rng.normal(0, 0.12, (n, 2)), rng.normal(0.45 if trial % 3 == 1 else 0, 0.12, (n, 2))])
        a = np.triu(rng.random((n, n)) < 0.3 if trial % 3 == 2 else np.hypot(*(xy[:, None] - xy[None]).T) < 0.22, 1)
        i, j = np.nonzero(a)
        c = paths.arrays(np.arange(len(a)), pd.DataFrame({"src": i, "dst": j, "w": 1.0}))
        flow = flows.SplitFlow(c)
        want = {(s, t): flow.between(s, t) for s in range(len(a)) for t in range(s + 1, len(a)) if not a[s, t]}
        got = np.array([flows.connectivities(c, part, parts) for part in range(parts)]).sum(0)
        assert got.tolist() == [sum(want.values()), len(want)]
        for block in flows.blocks(c)[0]:
            at = [*flows._bits(block)]
            k, m = np.nonzero(a[np.ix_(at, at)])
            low, high = flows.bounds(paths.arrays(np.arange(len(at)), pd.DataFrame({"src": k, "dst": m, "w": 1.0})))
            for s, t in ((s, t) for s in range(len(at)) for t in range(s + 1, len(at)) if not a[at[s], at[t]]):
                assert low[s, t] <= want[at[s], at[t]] <= high[s, t]
                settled, pairs = settled + int(low[s, t] == high[s, t]), pairs + 1
    assert pairs > 1000 and settled > 0.95 * pairs
