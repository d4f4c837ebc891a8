"""Cutting lineage between rounds of an iteration, and joins that bear hot keys."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: At most this many keys are broadcast as hot ones; a key is hot if it holds more than its share of the rows, and not few of them.
HOT_KEYS, FEW_ROWS = 1000, 256


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. Where none is set, a temporary one serves local sessions; a cluster needs one."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if base is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="meshwright-"))
        base = sc.getCheckpointDir()
    return base.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the cluster's shared checkpoint folder and read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    _left.add(path)
    for held in _open[-1:]:
        held.append(out)
    return out


_open: list[list[DataFrame]] = []
#: Tables that were stored and not deleted; a result may still read them, so they stay until the program ends.
_left: set[str] = set()


@atexit.register
def _clear() -> None:
    """Delete what is left, also if the session was stopped before; a program that is killed leaves its tables."""
    if _left and (jvm := SparkContext._jvm) is not None:
        conf = jvm.org.apache.hadoop.conf.Configuration()
        for path in _left:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        _left.clear()


@contextmanager
def scratch() -> Iterator[None]:
    """Tables stored inside are deleted at the end; write what is to stay before."""
    _open.append([])
    try:
        yield
    finally:
        forget(*_open.pop())


def forget(*tables: DataFrame | None) -> None:
    """Delete stored tables that no plan reads any more."""
    for df in tables:
        if path := getattr(df, "__dict__", {}).get("stored_at"):
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
            _left.discard(path)


def hot_keys(rows: DataFrame, key: str, n_rows: int) -> DataFrame:
    """The keys that hold more than a ``HOT_KEYS``-th of ``n_rows`` rows each: so at most that many."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > max(FEW_ROWS, n_rows // HOT_KEYS)).select(key)


def looked_up(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame, outer: bool = False) -> DataFrame:
    """``rows`` with the columns of ``table`` (one row per key): ``hot`` keys' by a broadcast, so that no task gets all rows of one.

    Rows whose key is not in ``table`` go, unless ``outer``. Rows of hot keys pass
    the shuffle for the other keys under salts that match nothing.
    """
    own = [c for c in table.columns if c != key]
    few = table.join(F.broadcast(hot.select(key)), key, "left_semi").select(key, F.struct(*own).alias("__few"))
    at = rows.join(F.broadcast(few), key, "left")  # ``HOT_KEYS`` rows at most
    salt = F.when(F.col("__few").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 20)) + 1).cast("int")
    both = at.withColumn("__salt", salt).join(table.select(key, F.lit(0).alias("__salt"), F.struct(*own).alias("__rest")), [key, "__salt"], "left")
    found = both.withColumn("__got", F.coalesce("__few", "__rest"))
    return (found if outer else found.where(F.col("__got").isNotNull())).select(*rows.columns, *(F.col("__got")[c].alias(c) for c in own))


def ranked(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with their place from 0 among those that agree in ``by``, in ``order``; ranges of rows are numbered apart, so no task gets all of a group."""
    part, own = f"{name}_part", stored(rows.repartitionByRange(*by, *order).withColumn(f"{name}_part", F.spark_partition_id()))
    sizes = own.groupBy(*by, part).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(*by, part, F.coalesce(before, F.lit(0)).alias(f"{name}_before"))  # a row per range and group
    within = F.row_number().over(Window.partitionBy(*by, part).orderBy(*order)) - 1
    return own.withColumn(name, within).join(sizes, [*by, part]).withColumn(name, F.col(name) + F.col(f"{name}_before")).drop(part, f"{name}_before")
