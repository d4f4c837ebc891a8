"""Shards of even size by balanced label propagation.

Documents with equal texts are linked. All members of such a group are alike, so
the propagation runs on one row per (group, shard) with a count. At first every
member is where the hash of its id puts it. In each round joins find, for every
group that is still split, the shard that holds most of its members among those
that have room for all of it; if none of its own has, another one with room.
Asks are accepted up to each shard's quota: groups are dealt into bins by hash,
bins are summed per shard, and bins that fit the room left are taken whole. The
members of an accepted group move there and stay. Bins change from round to
round; the last ``FEW`` groups are placed largest first.

A group that exceeds a shard fills whole shards before the first round, and its
rest goes on as a group. Rounds end when no group that is left fits the room of
any shard. At most as many groups as shards are left then (none, as long as
documents without links leave room); each is cut over the shards with most room.
Documents without links fill what remains, so that counts differ by one at most
(law ``rows``).

Ranks within groups that are cut and slots within shards are counted in two
steps, within a salted share and then over the shares: no task sees all of a
group or shard. The driver sees a row per shard and bin.

Null texts count as empty and are linked with empty ones; very long texts are
only hashed and measured. Repeated rows are documents of their own. Ties are
broken by text digest, then doc_id, null first. An empty table gives no rows.
Further columns, whatever their names, are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import n_partitions, stored, table

SHARDS = 16
#: Bins per shard and round, and how many groups may be left for the driver.
BINS, FEW = 1024, 64
#: Stand for the digest of documents without a link, and of those whose shard needs no rank.
ALONE, WHOLE = b"", b"\1"

Runs = list[tuple[int, int]]


def whole_shards(large: dict[bytes, int], capacity: list[int]) -> tuple[dict[bytes, Runs], list[int]]:
    """The shards (shard, count) that large groups fill, and the room left in each shard."""
    room, filled = list(capacity), {}
    for key, total in sorted(large.items(), key=lambda g: (-g[1], g[0])):
        for shard, size in enumerate(capacity):
            if 0 < size == room[shard] <= total:
                filled.setdefault(key, []).append((shard, size))
                total -= size
                room[shard] = 0
    return filled, room


def accepted(demand: dict[tuple[int, int], int], room: list[int]) -> list[tuple[int, int]]:
    """The bins (shard, bin) that are taken: those with least demand first, as long as they fit."""
    out, left = [], list(room)
    for (shard, b), n in sorted(demand.items(), key=lambda x: (x[1], x[0])):
        if n <= left[shard]:
            left[shard] -= n
            out.append((shard, b))
    return out


def placed(groups: list[tuple[bytes, int, dict[int, int]]], room: list[int]) -> dict[bytes, int]:
    """Shards for groups (key, total, members by shard), largest first, each where most of it is among those with room; ``room`` shrinks."""
    out = {}
    for key, total, held in sorted(groups, key=lambda g: (-g[1], g[0])):
        fits = [s for s in range(len(room)) if room[s] >= total]
        if fits:
            out[key] = best = max(fits, key=lambda s: (held.get(s, 0), room[s], -s))
            room[best] -= total
    return out


def cut(groups: dict[bytes, int], room: list[int]) -> dict[bytes, Runs]:
    """Groups that fit nowhere over the shards with most room, largest first; ``room`` shrinks."""
    out: dict[bytes, Runs] = {}
    for key, total in sorted(groups.items(), key=lambda g: (-g[1], g[0])):
        while total:
            best = max(range(len(room)), key=lambda s: (room[s], -s))
            n = min(total, room[best])
            out.setdefault(key, []).append((best, n))
            room[best] -= n
            total -= n
    return out


def share(parts: int, *of: str | Column) -> Column:
    return F.pmod(F.xxhash64(*of), F.lit(parts)).cast("int")


def propagate(state: DataFrame, room: list[int], bins: int = BINS, few: int = FEW) -> tuple[DataFrame, dict[bytes, Runs]]:
    """(key, shard) for groups of ``state`` (key, total, shard, n) that stay whole, and the runs of the others; ``room`` shrinks."""
    spark, turn = state.sparkSession, 0
    settled = spark.createDataFrame([], "key binary, shard int")
    while True:
        turn += 1
        n_groups, least = state.agg(F.count_distinct("key"), F.min("total")).first()
        if n_groups <= few or least > max(room):  # in the second case fewer groups than shards are left
            held = state.groupBy("key", "total").agg(F.collect_list(F.struct("shard", "n")).alias("held")).collect()
            groups = [(bytes(r["key"]), r["total"], dict(map(tuple, r["held"]))) for r in held]
            own = placed(groups, room)
            last = spark.createDataFrame([(bytearray(k), s) for k, s in own.items()], "key binary, shard int")
            return settled.unionByName(last), cut({k: total for k, total, _ in groups if k not in own}, room)
        rooms = F.broadcast(spark.createDataFrame(list(enumerate(room)), "shard int, room long"))  # a row per shard
        fits = state.join(rooms, "shard").where("room >= total")
        near = fits.groupBy("key").agg(F.max_by("shard", F.struct("n", F.xxhash64("key", "shard"))).alias("near"))
        seats = F.filter(F.array(*(F.struct(F.lit(s).alias("shard"), F.lit(n).cast("long").alias("room")) for s, n in enumerate(room))), lambda x: x.room >= F.col("total"))
        other = F.try_element_at(seats, (F.pmod(F.xxhash64("key", F.lit(turn)), F.greatest(F.size(seats), F.lit(1))) + 1).cast("int"))["shard"]
        groups = state.select("key", "total").distinct().join(near, "key", "left")
        asks = stored(groups.select("key", F.coalesce("near", other).alias("shard"), "total", share(bins, "key", F.lit(turn)).alias("bin")))
        demand = {(r["shard"], r["bin"]): r["n"] for r in asks.where("shard IS NOT NULL").groupBy("shard", "bin").agg(F.sum("total").alias("n")).collect()}  # ``bins`` rows per shard at most
        taken = accepted(demand, room)
        for one in taken:
            room[one[0]] -= demand[one]
        if not taken:
            bins *= 4  # every ask fits alone: smaller bins do in the end
            continue
        moves = asks.join(F.broadcast(spark.createDataFrame(taken, "shard int, bin int")), ["shard", "bin"]).select("key", "shard")
        settled = stored(settled.unionByName(moves))
        state = stored(state.join(moves.select("key"), "key", "left_anti"))


def ranked(rows: DataFrame, sizes: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` (with a ``salt``) plus ``rank`` from 0 within ``group``: within each salt, after the ``sizes`` (group, salt, n) of the salts before."""
    local = rows.withColumn("rank", F.row_number().over(Window.partitionBy(group, "salt").orderBy(*order)) - 1)
    before = F.coalesce(F.sum("n").over(Window.partitionBy(group).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return local.join(sizes.select(group, "salt", before.alias("before")), [group, "salt"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before")


def shard(docs: DataFrame, shards: int = SHARDS, bins: int = BINS, few: int = FEW) -> DataFrame:
    """One row per document: size, checksum, law, shard, slot."""
    spark = docs.sparkSession
    parts = max(64, n_partitions(spark))
    text = F.coalesce("text", F.lit(""))
    thin = stored(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("key"))
                  .withColumn("salt", share(parts, "doc_id", "key")))
    n = thin.count()
    capacity = [n // shards + (i < n % shards) for i in range(shards)]

    shares = stored(thin.groupBy("key", "salt").agg(F.count("*").alias("n")))
    linked = stored(shares.groupBy("key").agg(F.sum("n").alias("total")).where("total > 1"))
    large = {bytes(r["key"]): r["total"] for r in linked.where(F.col("total") > min(capacity)).collect()}  # hardly more rows than shards
    filled, room = whole_shards(large, capacity)
    less = spark.createDataFrame([(bytearray(k), sum(m for _, m in runs)) for k, runs in filled.items()], "key binary, less long")
    rest = linked.join(F.broadcast(less), "key", "left").select("key", (F.col("total") - F.coalesce("less", F.lit(0))).alias("total")).where("total > 0")
    # every member's first shard is its salt's
    start = stored(shares.join(rest, "key").groupBy("key", "total", (F.col("salt") % shards).alias("shard")).agg(F.sum("n").alias("n")))
    settled, runs = propagate(start, room, bins, few)
    settled = stored(settled)

    # members of cut groups, and documents without links, find their shards by rank
    ends = {r["key"]: r["shard"] for r in settled.join(F.broadcast(less), "key", "left_semi").collect()}  # rests of large groups
    cuts: dict[bytes, Runs] = {ALONE: list(enumerate(room))}
    for key in {*filled, *runs}:
        tail = [(ends[key], large[key])] if key in ends else runs.get(key, [])
        cuts[key] = [*filled.get(key, []), *tail]
    bounds = []
    for key, own in cuts.items():
        high = 0
        for s, m in own:
            high += m
            bounds.append((bytearray(key), high, s))
    runs_of = spark.createDataFrame(bounds, "group binary, high long, shard int").groupBy("group").agg(F.sort_array(F.collect_list(F.struct("high", "shard"))).alias("runs"))  # a few rows per shard
    whole = settled.join(F.broadcast(less), "key", "left_anti").select("key", F.col("shard").alias("whole"))
    group = F.when(F.col("total").isNull(), F.lit(bytearray(ALONE))).when(F.col("whole").isNull(), F.col("key")).otherwise(F.lit(bytearray(WHOLE)))
    named = stored(shares.join(linked, "key", "left").join(whole, "key", "left").select("key", "salt", "n", "whole", group.alias("group")))
    sizes = named.groupBy("group", "salt").agg(F.sum("n").alias("n"))
    member = ranked(thin.join(named.drop("n"), ["key", "salt"]), sizes, "group", "key", "doc_id")
    by_rank = F.filter("runs", lambda x: x.high > F.col("rank"))[0]["shard"]
    found = member.join(F.broadcast(runs_of), "group", "left").select("doc_id", "size", "text_crc32", "key", F.coalesce("whole", by_rank).alias("shard"))
    found = stored(found.withColumn("salt", share(parts, "doc_id", "key", F.lit("slot"))))  # a shard that ranks filled holds few of the other salts
    slotted = ranked(found, found.groupBy("shard", "salt").agg(F.count("*").alias("n")), "shard", "key", "doc_id")
    return slotted.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("rank").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 16 shards whose counts differ by one at most."""
    return shard(table(spark, sf_dir, "documents"))
