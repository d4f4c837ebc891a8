"""Best-fit packing by minimum bin slack.

Only the count of pieces of each length decides the bins, so a histogram of at
most ``capacity`` rows goes to the driver. There, bin after bin, a bitset
subset-sum over the lengths left finds the fullest combination with the longest
piece; the combination is used as often as the counts allow and removed. Pieces
then find their places from their rank among the pieces of their length, which
is counted within partitions first: no task sees all pieces of one length.

An empty or null text is one piece that holds the end id alone; a very long one
is cut into as many pieces as it needs. Ties in length are broken by partition
and row order; any order gives as many sequences. Repeated rows are packed as
often as they occur; rows with a null doc_id are documents too. An empty table
gives no rows. Further columns, whatever their names, are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import encoder
from .common import small_batches, stored, table

VOCABULARY, END_ID, CAPACITY = "byte_bpe_50k.json", 2, 1024
#: Up to this many (length, partition) rows are broadcast, of some 150 bytes each in memory; more are joined by a shuffle.
BROADCAST_SHARES = 300_000


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The (length, copies) that fill ``room`` best: subset sums as bits of an integer, one step per power-of-two share of a length's copies."""
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, share = min(counts[length], room // length), 1
        while left:
            take = min(share, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            share *= 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return sorted(chosen.items(), reverse=True)


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(bins, [(length, copies in each)]): what all bins hold, fullest combinations first from the longest piece down."""
    counts = {k: v for k, v in counts.items() if v}
    out = []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        rest = fullest({k: v for k, v in counts.items() if v}, capacity - longest)
        counts[longest] += 1
        held = dict(rest)
        held[longest] = held.get(longest, 0) + 1
        times = min(counts[k] // n for k, n in held.items())
        for k, n in held.items():
            counts[k] -= times * n
        counts = {k: v for k, v in counts.items() if v}
        out.append((times, sorted(held.items(), reverse=True)))
    return out


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; all but the first are full."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((start, capacity) for start in range(first, n, capacity))]


def narrow_ids(spec: str, end_id: int) -> bool:
    """Whether two bytes hold every id."""
    return max(Tokenizer.from_str(spec).get_vocab_size(), end_id + 1) <= 1 << 16


def pieces(docs: DataFrame, spec: str, end_id: int, capacity: int) -> DataFrame:
    """Every piece with its length, its ids, and its rank among this partition's pieces of that length.

    Ids are two bytes each, low byte first, if all of the vocabulary's fit; else four.
    """
    small_batches(docs.sparkSession)
    size = 2 if narrow_ids(spec, end_id) else 4
    tail = end_id.to_bytes(size, "little")
    names = ["doc_id", "piece", "start", "length", "ids", "part", "rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen, part = encoder(spec, size), [0] * (capacity + 1), TaskContext.get().partitionId()
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = enc.encode(text.as_py() or "") + tail
                for k, (start, length) in enumerate(cut(len(ids) // size, capacity)):
                    row = doc, k, start, length, ids[size * start : size * (start + length)], part, seen[length]
                    seen[length] += 1
                    for column, value in zip(rows, row, strict=True):
                        column.append(value)
            kinds = [batch.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names)

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids binary, part int, rank long")


def places(found: list[tuple[int, list[tuple[int, int]]]], capacity: int) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first bin, copies in a bin, offset of the first copy) in rank order."""
    used, out, bin0 = [0] * (capacity + 1), {}, 0
    for times, held in found:
        offset = 0
        for length, copies in held:
            out.setdefault(length, []).append((used[length], bin0, copies, offset))
            used[length] += times * copies
            offset += copies * length
        bin0 += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(docs: DataFrame, spec: str, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: where it is in its document, its ids and their checksum, and in which sequence, from which offset, it lies."""
    spark = docs.sparkSession
    cut_up = stored(pieces(docs, spec, end_id, capacity))
    shares = cut_up.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in shares.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    where = spark.sparkContext.broadcast(places(patterns(counts, capacity), capacity))  # a few rows per length
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shares = stored(shares.select("length", "part", F.coalesce(before, F.lit(0)).alias("before")))
    small = shares.count() <= BROADCAST_SHARES
    ranked = cut_up.join(F.broadcast(shares) if small else shares, ["length", "part"])
    narrow = narrow_ids(spec, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy() + batch.column("before").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for one in np.unique(length):
                at, rows = np.flatnonzero(length == one), where.value[int(one)]
                row = rows[np.searchsorted(rows[:, 0], rank[at], "right") - 1]
                nth = rank[at] - row[:, 0]
                sequence[at] = row[:, 1] + nth // row[:, 2]
                offset[at] = row[:, 3] + nth % row[:, 2] * one
            kept = ["doc_id", "piece", "start", "length"]
            ids = batch.column("ids")
            if narrow:
                ids = pa.array([np.frombuffer(x.as_buffer(), "<u2").astype("<u4").tobytes() for x in ids], pa.binary())
            crc = pa.array([zlib.crc32(x.as_buffer()) for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), ids, crc, pa.array(sequence), pa.array(offset)], [*kept, "ids", "ids_crc32", "sequence_id", "offset"])

    kind = dict(docs.dtypes)["doc_id"]
    return ranked.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids binary, ids_crc32 long, sequence_id long, offset long")


def vocabulary(name: str = VOCABULARY) -> str:
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack every document into sequences of at most 1024 ids; checksums stand for the ids."""
    return pack(table(spark, sf_dir, "documents"), vocabulary()).drop("ids")
