"""Whole ways from images and points to properties."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meshwright.errors import InvalidArgumentsError
from meshwright.operators import points
from meshwright.plans import network
from meshwright.streaming.trajectories import edges_of_frames


def cross(spark, images=2):
    image = np.zeros((21, 21), int)
    image[9:12, 2:19] = 255
    image[2:19, 9:12] = 255
    return spark.createDataFrame([(i, 0, r, c, int(v)) for i in range(images) for (r, c), v in np.ndenumerate(image)], "image_id long, z int, r int, c int, v int")


def test_images_to_weighted_graphs(spark):
    g = network.from_images(cross(spark), {"thresh": 100}, weight=["Length", "Width"])
    degrees = g.edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").count()
    most = degrees.groupBy("id.image_id").agg(F.max("count").alias("k")).collect()
    assert len(most) == 2 and all(r["k"] >= 3 for r in most)
    assert g.edges.where("length >= 3 AND width IS NOT NULL").count() == g.edges.count()
    drawn = network.plot_rows(g, g.vertices.select("id", F.lit(1.0).alias("value")))
    assert drawn.count() >= g.vertices.count()


def test_rotation_keeps_the_crop(spark):
    g = network.from_images(cross(spark, 1), {"thresh": 100}, crop_to=[5, 16, 5, 16], rotate=45, giant=False)
    assert g.vertices.where("x < 0 OR x > 11 OR y < 0 OR y > 11").count() == 0
    with pytest.raises(InvalidArgumentsError):
        network.from_images(cross(spark, 1), {}, rotate=45)


def cloud(spark, n=60):
    rng = np.random.default_rng(3)
    return spark.createDataFrame([(0, i, *map(float, rng.random(3))) for i in range(n)], "frame int, pid long, x double, y double, z double")


def brute(df, r, box=None):
    rows, out = df.collect(), set()
    for a in rows:
        for b in rows:
            d = np.array([b[k] - a[k] for k in "xyz"])
            d = d - box * np.rint(d / box) if box else d
            if a["pid"] < b["pid"] and np.sqrt((d * d).sum()) <= r:
                out.add((a["pid"], b["pid"]))
    return out


@pytest.mark.parametrize("r", [0.1, 0.3, 0.6])
def test_cutoffs_against_all_pairs(spark, r):
    c = cloud(spark)
    pairs = lambda e: sorted((x["src"], x["dst"]) for x in e.collect())
    assert pairs(points.cutoff_graph(c, r)) == sorted(brute(c, r))
    if r <= 0.5:
        assert pairs(points.cutoff_graph(c, r, box=(1.0, 1.0, 1.0))) == sorted(brute(c, r, 1.0))


def test_rules(spark):
    c = cloud(spark)
    assert network.from_points(c, {"r_max": 0.3}).edges.count() == len(brute(c, 0.3))
    assert network.from_points(c, {"num_neighbors": 2, "r_max": 2.0}).edges.count() >= 30
    assert network.from_points(c, spark.createDataFrame([(0, 1), (2, 99)], "src long, dst long")).edges.count() == 1
    with pytest.raises(InvalidArgumentsError):
        network.from_points(c, {})
    got = {r["metric"]: r["value"] for r in network.summary(network.from_points(c, {"r_max": 0.5})).collect()}
    assert got["n_nodes"] == 60 and got["diameter"] >= 2


def test_kernels_see_whole_vertices(spark):
    def degrees(batches):
        for b in batches:
            t = pa.Table.from_batches([b]).group_by("src").aggregate([("dst", "count")])
            yield from t.rename_columns(["src", "n"]).to_batches()

    g = network.from_points(cloud(spark), {"r_max": 0.3})
    assert network.register_kernel(degrees, "src long, n long")(g).agg(F.sum("n")).first()[0] == 2 * g.edges.count()


def test_frames_as_they_arrive(spark, tmp_path):
    c = cloud(spark)
    c.write.parquet(str(tmp_path / "in"))
    edges_of_frames(spark.readStream.schema(c.schema).parquet(str(tmp_path / "in")), 0.3, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(brute(c, 0.3))
