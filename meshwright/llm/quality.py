"""Quality by importance resampling.

Two generative models over hashed n-grams, one of all documents and one of
labelled good ones, give each text an importance weight: the mean log ratio of
its n-grams, times ``SHARPNESS``, is the weight's logarithm. ``k`` texts are
drawn without replacement in proportion to their weights by Gumbel top-k: the k
largest of log weight plus Gumbel noise. So a text that is 1 / ``SHARPNESS``
less likely an n-gram than another has a chance smaller by a factor of e.

An n-gram is a run of two or three bytes, or a pair of words one or two apart of
which only is kept whether both are the same: texts that repeat words have too
many such pairs.

The share drawn is that of the good ones among all labelled documents. The raw
model, the share, the weights and the draw are over all rows; the target model
counts at most ``MAX_LABELS`` good labelled ones, taken by the hash of their
doc_id. The noise is a function of text and seed, so equal texts fare alike, and
rows tied with the last one drawn are drawn too.

Null and empty texts have no n-grams and the log weight 0; their noise decides.
Very long texts are read whole. Of several labels of a doc_id the best counts;
rows that share a doc_id share its label; null doc_ids and null labels count for
nothing. With no label, or no good one, every row is kept. An empty table gives
no rows. Further columns, whatever their names, pass through ``keep`` as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import over_batches, small_batches, stored, table

BUCKETS, SIZES, LAGS, MAX_LABELS, SHARPNESS, SMOOTHING, SEED = 1 << 15, (2, 3), (1, 2), 20_000, 50.0, 1.0, 9
#: Every n-gram's number: byte n-grams' buckets, and two events for each lag of words.
EVENTS = BUCKETS + 2 * len(LAGS)


def grams(text: str) -> np.ndarray:
    """The numbers of a text's n-grams."""
    b = np.frombuffer(text.encode(), np.uint8).astype(np.uint32)
    out = []
    for n in SIZES:
        if len(b) >= n:
            h = np.full(len(b) - n + 1, n, np.uint32)
            for i in range(n):
                h = (h ^ b[i : len(b) - n + 1 + i]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            out.append(h & np.uint32(BUCKETS - 1))
    words = text.split()
    for k, lag in enumerate(LAGS):
        if len(words) > lag:
            same = sum(map(eq, words, words[lag:]))
            out.append(np.repeat(np.uint32([BUCKETS + 2 * k, BUCKETS + 2 * k + 1]), [same, len(words) - lag - same]))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def gumbel(text: str, seed: int = SEED) -> float:
    """Standard Gumbel noise of a text."""
    return -math.log(-math.log((xxhash.xxh64_intdigest(text.encode(), seed) + 0.5) / 2**64))


@dataclass
class Model:
    """The n-grams' log ratios, and the share of documents to draw."""

    ratio: Broadcast
    share: float

    def weigh(self, text: str) -> tuple[float, int]:
        """A text's mean log ratio, and how many n-grams it has."""
        g = grams(text)
        return (float(self.ratio.value[g].mean()) if len(g) else 0.0), len(g)


def rated(labels: DataFrame) -> DataFrame:
    """(doc_id, good) of every labelled document."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
    return known.groupBy("doc_id").agg((F.max("quality") > 0).alias("good"))


def share_of_good(known: DataFrame) -> float:
    """The share of good ones among all labelled documents; 1 without a good one."""
    return known.agg(F.avg(F.col("good").cast("double")).alias("p")).first()["p"] or 1.0


def counted(docs: DataFrame) -> np.ndarray:
    """Counts by n-gram: of all texts, and of those with ``target``."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, EVENTS), np.int64)
        for batch in batches:
            for text, target in zip(batch.column("text"), batch.column("target").to_pylist(), strict=True):
                n = np.bincount(grams(text.as_py() or ""), minlength=EVENTS)
                total[0] += n
                if target:
                    total[1] += n
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])], ["event", "raw", "target"])

    out = np.zeros((2, EVENTS))
    for r in docs.select("text", "target").mapInArrow(run, "event long, raw long, target long").groupBy("event").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():  # a row per n-gram number
        out[:, r["event"]] = r["raw"], r["target"]
    return out


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log of the target model's over the raw model's probability of each n-gram, both smoothed; 0 without a target."""
    p = (target + SMOOTHING) / (target.sum() + SMOOTHING * EVENTS)
    q = (raw + SMOOTHING) / (raw.sum() + SMOOTHING * EVENTS)
    return np.log(p / q) if target.sum() else np.zeros(EVENTS)


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> Model:
    """Both models and the share."""
    known = rated(labels)
    good = stored(known.where("good").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels))
    marked = docs.select("doc_id", "text").join(F.broadcast(good), "doc_id", "left")  # ``max_labels`` rows at most
    raw, target = counted(marked.select("text", F.coalesce("good", F.lit(False)).alias("target")))
    return Model(docs.sparkSession.sparkContext.broadcast(log_ratios(raw, target)), share_of_good(known))


def scored(docs: DataFrame, model: Model, sharpness: float = SHARPNESS, seed: int = SEED, columns: list[str] | None = None, names: tuple[str, str, str] = ("log_weight", "n_grams", "gumbel_key")) -> DataFrame:
    """``columns`` of ``docs`` (all, if none are named) with log weight, number of n-grams and Gumbel key appended under ``names``."""
    columns = docs.columns if columns is None else columns
    kinds = dict(docs.dtypes)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = [t.as_py() or "" for t in batch.column("text")]
        got = [model.weigh(t) for t in own]
        weights = [sharpness * w for w, _ in got]
        keys = [w + gumbel(t, seed) for w, t in zip(weights, own, strict=True)]
        found = [pa.array(weights, pa.float64()), pa.array([n for _, n in got], pa.int64()), pa.array(keys, pa.float64())]
        return pa.RecordBatch.from_arrays([*map(batch.column, columns), *found], [*columns, *names])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), f"`{names[0]}` double", f"`{names[1]}` long", f"`{names[2]}` double"])
    return over_batches(docs.select(*(f"`{c}`" for c in dict.fromkeys([*columns, "text"]))), kernel, schema)


def kth_largest(rows: DataFrame, column: str, k: int, bins: int = 1024, few: int = 10_000) -> float:
    """The k-th largest value: histograms narrow it down until ``few`` values are left."""
    if k <= 0:
        return math.inf
    while True:
        low, high, n = rows.agg(F.min(column), F.max(column), F.count(column)).first()
        if n < k:
            return -math.inf
        if low == high:
            return low
        if n <= few:
            return sorted((r[0] for r in rows.select(column).collect()), reverse=True)[k - 1]  # ``few`` rows at most
        width = (high - low) / bins
        bin_of = F.least(F.floor((F.col(column) - low) / width).cast("int"), F.lit(bins - 1))
        held = {r["bin"]: r["n"] for r in rows.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n")).collect()}  # ``bins`` rows at most
        for b in sorted(held, reverse=True):
            if held[b] >= k:
                rows = rows.where(bin_of == b)
                break
            k -= held[b]


def drawn(rows: DataFrame, key: str, share: float) -> float:
    """The least key among the ``share`` of rows with the largest ones, rounded up."""
    return kth_largest(rows, key, math.ceil(share * rows.count() - 1e-9))


def keep(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, sharpness: float = SHARPNESS, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that importance resampling draws, with all their columns; no row is shuffled, each is scored once."""
    model = fit(docs, labels, max_labels)
    names = tuple(n + "_" * max(map(len, docs.columns)) for n in ("w", "n", "k"))  # longer than any other name
    rows = stored(scored(docs, model, sharpness, seed, names=names))
    least = drawn(rows, names[2], model.share)
    return rows.where(F.col(names[2]) >= least).select(*(f"`{c}`" for c in docs.columns))


def op9_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log weight, Gumbel key and draw of every document."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    rows = stored(scored(docs, model, columns=["doc_id"]))
    return rows.withColumn("selected", F.col("gumbel_key") >= drawn(rows, "gumbel_key", model.share))
