"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, walked through as
often as its target asks, at most ``PASSES`` times. A document's virtual finish
time is the number of its source's words up to its end, divided by the source's
target: at time 1 every source has given what it should. All documents of all
sources are put in order of that time and taken until the next one would exceed
the budget.

The budget is all words of all documents. A source's target is its weight's
share of it, but at most ``PASSES`` times its own words; what is cut off goes to
the other sources by weight. As capped sources are those with the least words to
weight, running sums over one row per source find them.

No task sees a source whole: documents are dealt into ranges of (source, shuffled
order), words are added up within ranges, and the sums before a range come from
one row per range and source. The place where the budget ends is found by
histograms of the finish time that narrow down to a few documents.

The order is shuffled by a digest of doc_id and text: reruns agree, and rows that
are the same in all of doc_id, source and text are interchangeable. Null texts
have no words; a null source is a source of its own, the last; documents without
words are never taken. Of documents that end at the same time the one of the
first source comes first. With no words at all nothing is taken and targets are
0. An empty table gives no rows. Further columns, whatever their names, are left
out of ``schedule`` and kept by ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

#: The sources' weights in the order of their names, over and over; how often a document is taken at most.
WEIGHTS, PASSES = (5, 2, 1), 3
WORD = r"[^\x20\x09-\x0D]+"
#: Bins of a histogram, and the documents that are put in order at last.
BINS, FEW = 1024, 10_000


def sized(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(doc_id, source, size, turn, row): number of words, place in the shuffled order, and a number for rows that agree in all else."""
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.md5(F.coalesce(F.col(text), F.lit("")))))
    words = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), words.alias("size"), digest.alias("turn"), F.monotonically_increasing_id().alias("row"))


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """(source, place, weight, source_size, target) of every source; windows run over one row per source."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), F.col("place") % len(weights) + 1)
    own = sizes.withColumn("place", by_name).withColumn("weight", weight.cast("long")).withColumn("cap", passes * F.col("source_size"))
    exact = lambda c: c.cast("decimal(38,0)")
    order = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    own = own.withColumn("rest", rest).withColumn("left", left)
    own = own.withColumn("capped", exact(F.col("cap")) * exact(F.col("left")) <= exact(F.col("weight")) * exact(F.col("rest")))
    first = F.first(F.when(~F.col("capped"), F.struct("rest", "left")), ignorenulls=True).over(every)
    own = own.withColumn("level", first)
    share = (exact(F.col("weight")) * exact(F.col("level.rest"))).cast("double") / F.col("level.left")
    return own.select("source", "place", "weight", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def queued(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Every row that has words, with its source's place, size and target and ``upto``: the source's words up to its end in the first pass."""
    ranged = rows.where("size > 0").repartitionByRange("source", "turn", "row").withColumn("part", F.spark_partition_id())
    own = stored(ranged)
    sums = own.groupBy("source", "part").agg(F.sum("size").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(F.col("source").alias("of"), F.col("part").alias("of_part"), F.coalesce(before, F.lit(0)).alias("before"))  # a row per range and source
    within = F.sum("size").over(Window.partitionBy("part", "source").orderBy("turn", "row").rowsBetween(Window.unboundedPreceding, 0))
    at = own.withColumn("within", within).join(sums, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part")))
    known = sources.select(F.col("source").alias("name"), "place", "source_size", "target")
    upto = at.withColumn("upto", F.col("before") + F.col("within")).join(known, F.col("source").eqNullSafe(F.col("name")))
    return upto.select("doc_id", "source", "size", "turn", "row", "place", "source_size", "target", "upto")


def finish(n: Column) -> Column:
    """Virtual finish time in the n-th pass, from 0."""
    return (n * F.col("source_size") + F.col("upto")).cast("double") / F.col("target")


def taken_times(queue: DataFrame, passes: int, budget: int) -> Column:
    """How often each row of ``queue`` is taken: passes that end no later than the last document within the budget."""
    turns = queue.select("size", "place", "turn", "row", F.explode(F.array(*(finish(F.lit(n)) for n in range(passes)))).alias("at"))
    n_before, rows = 0, turns
    while True:
        low, high, n, words = rows.agg(F.min("at"), F.max("at"), F.count("*"), F.sum("size")).first()
        if not n or n_before + words <= budget:
            return F.lit(passes)
        if n <= FEW or low == high:
            break
        width = (high - low) / BINS
        bin_of = F.least(F.floor((F.col("at") - low) / width).cast("int"), F.lit(BINS - 1))
        held = rows.groupBy(bin_of.alias("bin")).agg(F.sum("size").alias("words")).orderBy("bin").collect()  # ``BINS`` rows at most
        for r in held:
            if n_before + r["words"] > budget:
                break
            n_before += r["words"]
        rows = rows.where(bin_of == r["bin"])
    end = None  # ``FEW`` rows at most, or as many as sources that end at once
    for r in rows.orderBy("at", "place", "turn", "row").collect():
        if n_before + r["size"] > budget:
            end = r
            break
        n_before += r["size"]
    own = ("place", "turn", "row")  # of those that end at once; in a source no two do
    key = F.struct(F.lit(end["at"]).alias("at"), *(F.lit(end[c]).cast(dict(queue.dtypes)[c]).alias(c) for c in own))
    times = [(F.struct(finish(F.lit(n)).alias("at"), *own) < key).cast("int") for n in range(passes)]
    return sum(times[1:], times[0])


def schedule(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, times, finish) of every document; finish is the first pass's virtual finish time."""
    rows = stored(sized(docs, key, text, source))
    sources = stored(targets(rows, weights, passes))
    budget = sources.agg(F.sum("source_size")).first()[0] or 0
    queue = stored(queued(rows, sources))
    times = taken_times(queue, passes, budget).cast("long")
    served = queue.select("doc_id", "source", "turn", "size", "source_size", "target", times.alias("times"), finish(F.lit(0)).alias("finish"))
    known = sources.select(F.col("source").alias("name"), "source_size", "target")
    idle = rows.where("size = 0").join(known, F.col("source").eqNullSafe(F.col("name")))
    idle = idle.select("doc_id", "source", "turn", "size", "source_size", "target", F.lit(0).cast("long").alias("times"), F.lit(None).cast("double").alias("finish"))
    return served.unionByName(idle).withColumn("taken", F.col("times") * F.col("size"))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, in the order of their virtual finish times over all tasks.

    Rows that agree in doc_id, source and text are given as one row's copies.
    """
    own = lambda c: c + "_" * max(map(len, docs.columns))  # noqa: E731  longer than any other name
    plan = schedule(docs, key, text, source, weights, passes).where("times > 0").groupBy("doc_id", "source", "turn")
    per = plan.agg(F.sum("times").cast("int").alias(own("times")), F.min("finish").alias(own("finish")), F.first(F.col("source_size") / F.col("target")).alias(own("round")))
    per = per.withColumnsRenamed({c: own(c) for c in ("doc_id", "source", "turn")})
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.md5(F.coalesce(F.col(text), F.lit("")))))
    one = docs.withColumn(own("own"), digest).dropDuplicates([key, source, own("own")])
    both = one.join(per, F.col(key).eqNullSafe(F.col(own("doc_id"))) & F.col(source).eqNullSafe(F.col(own("source"))) & (F.col(own("own")) == F.col(own("turn"))))
    again = both.withColumn(own("pass"), F.explode(F.sequence(F.lit(0), F.col(own("times")) - 1)))
    return again.orderBy(F.col(own("finish")) + F.col(own("pass")) * F.col(own("round")), own("turn")).select(*(f"`{c}`" for c in docs.columns))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all documents by the sources' weights takes of each."""
    return schedule(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
             md5(concat_ws(':', CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS turn, row_number() OVER () AS nr FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 3 * CAST(sum(size) AS BIGINT) AS cap FROM d GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sizes),
weighed AS (SELECT *, [5, 2, 1][place % 3 + 1] AS weight FROM placed),
levels AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS gone
           FROM weighed WINDOW b AS (ORDER BY CAST(cap AS DOUBLE) / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, cap * gone <= weight * rest AS capped FROM levels),
level AS (SELECT max(rest) AS rest, max(gone) AS gone FROM (SELECT rest, gone FROM capped WHERE NOT capped ORDER BY CAST(cap AS DOUBLE) / weight, place LIMIT 1)),
targets AS (SELECT source, place, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE CAST(weight * level.rest AS DOUBLE) / CAST(level.gone AS DOUBLE) END AS target FROM capped, level),
queue AS (SELECT d.*, t.place, t.source_size, t.target, sum(size) OVER (PARTITION BY d.source ORDER BY turn, nr) AS upto FROM d JOIN targets t ON t.source IS NOT DISTINCT FROM d.source WHERE size > 0),
turns AS (SELECT nr, size, place, turn, CAST(n * source_size + upto AS DOUBLE) / target AS due FROM queue, range(3) p(n)),
mix AS (SELECT nr, size, sum(size) OVER (ORDER BY due, place, turn, nr) AS total FROM turns),
taken AS (SELECT nr, CAST(sum(size) AS BIGINT) AS taken FROM mix WHERE total <= (SELECT sum(size) FROM d) GROUP BY nr)
SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(taken.taken, 0) AS taken FROM d JOIN targets t ON t.source IS NOT DISTINCT FROM d.source LEFT JOIN taken ON taken.nr = d.nr
"""
