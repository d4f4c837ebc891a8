"""Images, points and graphs derived from the driver's tables, with the SQL that derives the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.iterate import stored
from ..operators.near import PointGraph
from ..operators.points import cutoff_graph, cutoff_in_order
from ..schema import NetworkFrame


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as an 8 by 8 image."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("i", "e"))
    v = F.floor(F.least(F.greatest(F.col("e").cast("double") + 0.5, F.lit(0.0)), F.lit(1.0)) * 255).cast("int")
    return e.where("i < 64").select("image_id", F.lit(0).alias("z"), F.expr("CAST(i div 8 AS int)").alias("r"), F.expr("CAST(i % 8 AS int)").alias("c"), v.alias("v"))


IMAGES = """images AS (SELECT vec_id AS image_id, CAST(0 AS INTEGER) AS z, CAST((i - 1) // 8 AS INTEGER) AS r, CAST((i - 1) % 8 AS INTEGER) AS c,
  CAST(floor(least(greatest(CAST(embedding[i] AS DOUBLE) + 0.5, 0), 1) * 255) AS INTEGER) AS v FROM embeddings, range(1, 65) t(i))"""

#: Pixels above this are set in the binary images.
BRIGHT = 140


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(spark, sf_dir).where(F.col("v") > BRIGHT).select("image_id", "z", "r", "c")


VOXELS = f"{IMAGES}, voxels AS (SELECT image_id, z, r, c FROM images WHERE v > {BRIGHT})"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit(1).alias("depth"), F.lit(8).alias("height"), F.lit(8).alias("width"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three components of every embedding, with its label as frame."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").alias("frame"), F.col("vec_id").alias("pid"), *(F.col("embedding")[i].cast("double").alias(a) for i, a in enumerate("xyz")))


POINTS = "pts AS (SELECT label AS frame, vec_id AS pid, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"

#: Distance below which points are joined.
CUTOFF = 0.08


def near_graph(spark: SparkSession, sf_dir: str, cutoff: float = CUTOFF) -> NetworkFrame:
    p = points(spark, sf_dir)
    return PointGraph(p.select(F.col("pid").alias("id"), "x", "y", "z"), cutoff_graph(p, cutoff), cutoff)


def near_graph_in_order(spark: SparkSession, sf_dir: str) -> NetworkFrame:
    """The near graph with its edges sorted by src and dst over all partitions, for files."""
    p = points(spark, sf_dir)
    return NetworkFrame(p.select(F.col("pid").alias("id"), "x", "y", "z"), cutoff_in_order(p, CUTOFF))


NEAR = f"""{POINTS}, near AS (SELECT a.pid AS src, b.pid AS dst, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS length
  FROM pts a JOIN pts b ON a.pid < b.pid WHERE sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) <= {CUTOFF})"""


#: The near graph as SQL's edges, ends and verts; isolated points are vertices.
NEAR_GRAPH = f"""{NEAR}, edges AS (SELECT src, dst FROM near), ends AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges), verts AS (SELECT pid AS id FROM pts)"""


def supply_graph(spark: SparkSession, sf_dir: str) -> NetworkFrame:
    """Parts and their suppliers, over all lines of orders: a bipartite graph, suppliers numbered from 10,000,000."""
    li = table(spark, sf_dir, "lineitem").where("l_partkey IS NOT NULL AND l_suppkey IS NOT NULL")
    e = li.select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 10_000_000).alias("dst")).distinct()
    return NetworkFrame(e.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), e)


SUPPLY = """edges AS (SELECT DISTINCT l_partkey AS src, l_suppkey + 10000000 AS dst FROM lineitem),
ends AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges), verts AS (SELECT DISTINCT src AS id FROM ends)"""


def user_graph(spark: SparkSession, sf_dir: str) -> NetworkFrame:
    """Users whose events follow one another in the order of all events.

    Events are dealt into ranges of that order; a range's last event is followed
    by the first one of the next range, so no task sees the whole order.
    """
    ev = table(spark, sf_dir, "events").select("ts", "event_id", "user_id")
    own = stored(ev.repartitionByRange("ts", "event_id").withColumn("part", F.spark_partition_id()))
    first = own.groupBy("part").agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("user_id"))
    after = first.select("part", F.lead("user_id").over(Window.orderBy("part")).alias("then"))  # a row per range
    inner = F.lead(F.struct("user_id")).over(Window.partitionBy("part").orderBy("ts", "event_id"))
    seq = own.withColumn("next", inner).join(F.broadcast(after), "part").withColumn("n", F.when(F.col("next").isNull(), F.col("then")).otherwise(F.col("next.user_id")))
    e = seq.where("n <> user_id").select(F.least("user_id", "n").alias("src"), F.greatest("user_id", "n").alias("dst")).distinct()
    return NetworkFrame(e.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), e)


USERS = """seq AS (SELECT user_id AS a, lead(user_id) OVER (ORDER BY ts, event_id) AS b FROM events),
edges AS (SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM seq WHERE b IS NOT NULL AND a <> b),
ends AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges), verts AS (SELECT DISTINCT src AS id FROM ends)"""
