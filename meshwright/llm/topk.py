"""Exact top-k by inner product over a bit-sliced index.

Components are quantised to integers. A block of rows keeps, for every
dimension, its values less the block's least as bit slices: one bitmap per
binary digit. For a query, the slices of all dimensions are added with bitmap
arithmetic, each as often as the query's component has digits; a negative
component takes the complement, and constants are left out of the order. Carry-
save adders turn three bitmaps of one weight into one and a carry. The slices of
the sum, most significant first, then split the rows into surely selected and
still tied; ties that straddle the boundary are resolved by vec_id.

Queries and rows both come in blocks of about as many bytes, joined block by
block: every row is sent once per block of queries and every query once per
block of rows, and a block's slices serve thousands of queries. Each pair of
blocks answers with k rows a query. A query's own vec_id is no candidate for it.

Vectors that are null, or hold null or non-finite components, take no part; a
shorter vector counts as filled up with zeros. Of repeated vec_ids all rows are
candidates, the first in component order is the query; rows with a null vec_id
take no part. Components are held as doubles, which are exact as they are whole;
blocks with components beyond 53 bits count in integers of any length. Ranks
follow the exact sums, however large; a score beyond a long is shown as the
nearest long. A double whose quantised value is no double any more (beyond
7e305) counts as not finite. An empty table gives no rows. Further columns,
whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, stored, table

K, SCALE, EVERY = 5, 256, 50
#: Numbers in a block of the index (rows times dimensions), queries in a block of queries at most, and in one that is made small for more tasks.
NUMBERS, QUERIES, FEWEST = 1 << 21, 8192, 64
#: Whole doubles below are machine integers; scores within are shown as they are.
EXACT, LONGS = 1 << 53, (-(1 << 63), (1 << 63) - 1)


def packed(bits: np.ndarray) -> np.ndarray:
    """Booleans over rows (last axis) as 64-bit words."""
    pad = -bits.shape[-1] % 64
    if pad:
        bits = np.concatenate([bits, np.zeros((*bits.shape[:-1], pad), bool)], -1)
    return np.packbits(bits, axis=-1, bitorder="little").view("<u8")


class Index:
    """Bit slices of one block: rows by (vec_id, arrival)."""

    def __init__(self, ids: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], values[order]
        self.largest = int(np.abs(self.values).max(initial=0))
        base = self.values.min(0)
        above = (self.values - base).T
        width = np.array([int(x).bit_length() for x in above.max(1)])
        self.all = packed(np.ones(len(ids), bool))
        #: dimension and digit of every slice; the slices, and after them their complements
        self.dimension = np.repeat(np.arange(len(width)), width)
        self.digit = np.concatenate([np.arange(w) for w in width]).astype(np.int64)
        plain = [packed((row >> np.arange(w).astype(row.dtype)[:, None]) & 1 == 1) for row, w in zip(above, width, strict=True) if w]
        slices = np.concatenate([np.zeros((0, len(self.all)), "<u8"), *plain])
        self.slices = np.concatenate([slices, slices ^ self.all])

    def added(self, query: np.ndarray) -> list[np.ndarray]:
        """The slices of the sum over dimensions of component times value, up to a constant; least significant first."""
        size = np.abs(query)[self.dimension]
        digits = np.arange(int(size.max(initial=0)).bit_length()).astype(size.dtype)
        used, of = np.nonzero((size >> digits[:, None]) & 1)
        weight = used + self.digit[of]
        of = of + len(self.dimension) * (query[self.dimension[of]] < 0)
        order = np.argsort(weight, kind="stable")
        own = np.split(of[order], np.cumsum(np.bincount(weight))[:-1]) if len(of) else []
        out: list[np.ndarray] = []
        carried: list[np.ndarray] = []
        while len(out) < len(own) or carried:
            stack = self.slices[own[len(out)]] if len(out) < len(own) else self.slices[:0]
            stack, carried = np.concatenate([stack, *carried]), []
            while len(stack) > 2:
                n = len(stack) // 3
                a, b, c = stack[:n], stack[n : 2 * n], stack[2 * n : 3 * n]
                ab = a ^ b
                carried.append((a & b) | (ab & c))
                stack = np.concatenate([ab ^ c, stack[3 * n :]])
            if len(stack) == 2:
                carried.append(stack[:1] & stack[1:])
                stack = stack[:1] ^ stack[1:]
            out.append(stack[0] if len(stack) else np.zeros_like(self.all))
        return out

    def top(self, query: np.ndarray, own: int, k: int) -> np.ndarray:
        """Positions of the k best rows but ``own``; of ties the first."""
        tied, sure = self.all.copy(), np.zeros_like(self.all)
        for at in range(np.searchsorted(self.ids, own), np.searchsorted(self.ids, own, "right")):
            tied[at // 64] &= ~np.uint64(1 << at % 64)
        need = k
        for digit in reversed(self.added(query)):
            high = tied & digit
            n = int(np.bitwise_count(high).sum())
            if n > need:
                tied = high
            else:
                sure |= high
                need -= n
                tied = tied & ~digit
                if not need:
                    break
        places = lambda words: np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))
        rest = places(tied)[:need] if need else np.zeros(0, np.int64)  # rows lie by vec_id: the first are the smallest
        return np.concatenate([places(sure), rest])


def scores(values: np.ndarray, query: np.ndarray, largest: int) -> tuple[np.ndarray, list[bytes]]:
    """Inner products as longs, and bytes whose order is that of the products that are shown as the same long."""
    if largest * int(np.abs(query).max(initial=0)) * max(1, len(query)) < 1 << 62:
        exact = values.astype(np.int64) @ query.astype(np.int64)
        return exact, [b"\x80"] * len(exact)
    exact = [sum(map(int.__mul__, row, query.tolist())) for row in values.tolist()]
    return np.array([min(max(x, LONGS[0]), LONGS[1]) for x in exact], np.int64), [*map(beyond, exact)]


def beyond(x: int) -> bytes:
    """Bytes in the order of numbers that are shown as the same long: longer ones and larger ones later, negative ones the other way round."""
    if LONGS[0] <= x <= LONGS[1]:
        return b"\x80"
    size = (abs(x).bit_length() + 7) // 8
    data = size.to_bytes(2, "big") + abs(x).to_bytes(size, "big")
    return b"\xff" + data if x > 0 else b"\x00" + bytes(255 - b for b in data)


def quantised(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(vec_id, v): whole vectors only, components as whole doubles."""
    clean = F.expr(f"`{vector}` IS NOT NULL AND NOT exists(`{vector}`, x -> x IS NULL OR isnan(x) OR abs(CAST(x AS double) * {scale}) = double('infinity'))")

    def whole(x):
        scaled = x.cast("double") * scale
        return F.when(F.abs(scaled) < EXACT, F.floor(scaled).cast("double")).otherwise(scaled)  # doubles that large are whole

    return vectors.where(F.col(key).isNotNull()).where(clean).select(F.col(key).cast("long").alias("vec_id"), F.transform(vector, whole).alias("v"))


def blocks(rows: DataFrame, n: int, name: str) -> DataFrame:
    """Rows gathered in ``n`` blocks by the hash of vec_id; one row a block."""
    size = F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    return rows.groupBy(size.alias(name)).agg(F.collect_list("vec_id").alias(f"{name}_ids"), F.collect_list("v").alias(f"{name}_v"))


def matrix(rows: np.ndarray, dims: int) -> np.ndarray:
    """Rows filled up with zeros: machine integers, or Python's where one is too large."""
    out = np.zeros((len(rows), dims))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    if np.abs(out).max(initial=0.0) < EXACT:
        return out.astype(np.int64)
    return np.array([[*map(int, row)] for row in out.tolist()], object).reshape(out.shape)


def top_k(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, scale: int = SCALE, every: int = EVERY) -> DataFrame:
    """The k best rows for each query: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = stored(quantised(vectors, key, vector, scale))
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    n_rows, dims = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    n_asked = asked.count()
    n_blocks = max(1, -(-n_rows * max(1, dims or 1) // NUMBERS))
    enough = -(-2 * spark.sparkContext.defaultParallelism // n_blocks)  # blocks of queries that keep all cores busy
    n_query_blocks = max(1, -(-n_asked // QUERIES), min(enough, -(-n_asked // FEWEST)))
    index = blocks(rows, n_blocks, "r")
    queries = blocks(asked, n_query_blocks, "q").withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, built = None, None
        for frame in frames:
            for r in frame.itertuples():
                dims = max(max(map(len, r.r_v)), max(map(len, r.q_v)))
                if last != r.r or built.values.shape[1] != dims:
                    last, built = r.r, Index(np.asarray(r.r_ids), matrix(r.r_v, dims))
                out: list[tuple[np.ndarray, ...]] = []
                for own, query in zip(r.q_ids, matrix(r.q_v, dims), strict=True):
                    at = built.top(query, own, k)
                    out.append((np.full(len(at), own), built.ids[at], *scores(built.values[at], query, built.largest)))
                own, at, score, rest = zip(*out, strict=True)
                yield pd.DataFrame({"query_id": np.concatenate(own), "vec_id": np.concatenate(at), "score": np.concatenate(score), "beyond": [*chain.from_iterable(rest)]})

    spread = queries.join(index, "r").repartition(n_blocks * n_query_blocks, "r", "q")
    best = spread.mapInPandas(run, "query_id long, vec_id long, score long, beyond binary")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best rows for every fiftieth vector."""
    return top_k(table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, r.vec_id AS vec_id,
             CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * r.v[i])) AS BIGINT) AS score
      FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
