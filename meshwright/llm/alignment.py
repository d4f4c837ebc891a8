"""Alignment of two tokenizers: which ids of one stand for which ids of the other.

Both tokenizers encode the same bytes, a space and the text. Tokens are vertices
of a bipartite graph, joined where their byte ranges overlap; union-find gives
its connected components, which are exactly the minimal groups: they end where
both tokenizers end a token. Every token of one side of a group is linked with
every one of the other side. Links are then counted over the corpus: in how many
documents an id pair is linked, and which pairs are the most frequent of their
first id.

What a document links is a list of distinct id pairs with how often each is
linked, so a group of many tokens makes no more pairs than it has distinct ids.
The counts of pairs go to every task if they are at most ``BROADCAST_PAIRS``;
otherwise they are joined by a shuffle that bears hot pairs.

Null and empty texts, and those of which either side's tokens do not spell the
same bytes, have no tokens: zeros and an empty digest. Very long texts are
encoded whole. Repeated rows and doc_ids, null ones too, give a row each and
count as documents each. Ties for an id's most frequent pair all count. An empty
table gives no rows. Further columns, whatever their names, are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.iterate import hot_keys, looked_up
from .bpe import Encoder
from .common import small_batches, stored, table

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: How many counted pairs go to every task; links of a group that are listed one by one.
BROADCAST_PAIRS, MOST_LINKS = 2_000_000, 4096


def overlap_groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The component of each token of both sides, numbered in order; tokens overlap if their ranges share a byte.

    Union-find over all overlaps at once: trees hook onto the lesser root, then paths are halved, until every overlap lies in one tree.
    """
    n_a = len(ends_a)
    cuts = np.union1d(ends_a, ends_b)
    x, y = np.searchsorted(ends_a, cuts), n_a + np.searchsorted(ends_b, cuts)  # an overlap for every piece between two ends
    above = np.arange(n_a + len(ends_b))
    while True:
        roots = above[x], above[y]
        apart = np.flatnonzero(roots[0] != roots[1])
        if not len(apart):
            break
        one, other = roots[0][apart], roots[1][apart]
        np.minimum.at(above, np.maximum(one, other), np.minimum(one, other))
        while (above[above] != above).any():
            above = above[above]
    # a component's root is its least vertex, its first token of the first side
    of_a = np.cumsum(above[:n_a] == np.arange(n_a)) - 1
    return of_a, of_a[above[n_a:]]


class Aligner:
    """Both tokenizers, and what they make of a text."""

    def __init__(self, first: str, second: str) -> None:
        with open(first, encoding="utf-8") as f:
            self.a = Encoder(f.read())
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        self.bytes_a = self.a.token_bytes
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(name[3:5], 16)]) if self.b.is_byte(i) else name.replace("▁", " ").encode() for i, name in enumerate(names)]
        self.lengths = [np.array([*map(len, x)], np.int64) for x in (self.bytes_a, self.bytes_b)]
        self.size_b = len(names)
        #: ids as text with what follows them: of the first side a comma or bar, then of the second a comma or semicolon
        self.shown = [str(i).encode() + end for size, ends in ((len(self.bytes_a), b",|"), (self.size_b, b",;")) for end in (ends[:1], ends[1:]) for i in range(size)]

    def encoded(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Both sides' ids; None if either does not spell the same bytes."""
        raw = (" " + text).encode()
        a = np.frombuffer(self.a.encode(" " + text), "<u4").astype(np.int64)
        b = np.array(self.b.encode(text), np.int64)
        same = all(b"".join(map(spelled.__getitem__, ids.tolist())) == raw for spelled, ids in ((self.bytes_a, a), (self.bytes_b, b)))
        return (a, b) if same else None

    def groups(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return overlap_groups(*(np.cumsum(size[ids]) for size, ids in zip(self.lengths, (a, b), strict=True)))

    def links(self, a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct link codes in order, and how often each is linked. Large groups link distinct ids, with their numbers."""
        n_a, n_b = np.bincount(of_a), np.bincount(of_b)
        start_b = np.cumsum(n_b) - n_b
        small = n_a * n_b <= MOST_LINKS
        own = np.flatnonzero(small[of_a])
        times = n_b[of_a[own]]
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        codes = [np.repeat(a[own], times) * self.size_b + b[np.repeat(start_b[of_a[own]], times) + nth]]
        weights = [np.ones(len(codes[0]), np.int64)]
        for g in np.flatnonzero(~small):
            (x, n), (y, m) = (np.unique(ids[of == g], return_counts=True) for ids, of in ((a, of_a), (b, of_b)))
            codes.append((x[:, None] * self.size_b + y).ravel())
            weights.append((n[:, None] * m).ravel())
        distinct, place = np.unique(np.concatenate(codes), return_inverse=True)
        return distinct, np.bincount(place, np.concatenate(weights), len(distinct)).astype(np.int64)

    def spelled(self, a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray) -> bytes:
        """Groups as text: ids of the first side, a bar, ids of the second; groups parted by semicolons."""
        last_a, last_b = (np.append(of[1:] != of[:-1], True) for of in (of_a, of_b))
        size_a = len(self.bytes_a)
        which = np.concatenate([a + size_a * last_a, 2 * size_a + b + self.size_b * last_b])
        order = np.argsort(np.concatenate([2 * of_a, 2 * of_b + 1]), kind="stable")
        return b"".join(map(self.shown.__getitem__, which[order].tolist()))[:-1]

    def document(self, text: str) -> tuple[int, int, bytes, np.ndarray, np.ndarray]:
        """Tokens of either side, groups as text, distinct link codes in order and how often each is linked."""
        if not text or (ids := self.encoded(text)) is None:
            return 0, 0, b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
        of = self.groups(*ids)
        return len(ids[0]), len(ids[1]), self.spelled(*ids, *of), *self.links(*ids, *of)


@lru_cache(maxsize=1)
def aligner(first: str, second: str) -> Aligner:
    """One aligner per worker process."""
    return Aligner(first, second)


NAMES = ["row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]


def linked(docs: DataFrame, first: str, second: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, row, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times): every document's tokens, groups and links; ``row`` tells rows apart."""
    small_batches(docs.sparkSession)
    kinds = [pa.int64()] * 5 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, row = aligner(first, second), TaskContext.get().partitionId() << 33
        for batch in batches:
            out: list[list] = [[] for _ in NAMES]
            for value in batch.column(1):
                n_a, n_b, shown, pairs, times = own.document(value.as_py() or "")
                groups = shown.count(b";") + 1 if shown else 0
                for column, x in zip(out, (row, n_a, n_b, groups, int(times.sum()), hashlib.sha256(shown).hexdigest() if shown else "", pairs, times), strict=True):
                    column.append(x)
                row += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], [key, *NAMES])

    schema = f"`{key}` {dict(docs.dtypes)[key]}, " + ", ".join(f"{n} {'string' if n.endswith('256') else 'array<long>' if n in ('pairs', 'times') else 'long'}" for n in NAMES)
    return docs.select(key, text).mapInArrow(run, schema)


def pair_counts(found: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): in how many documents an id pair is linked, and whether no other pair of its first id is in more."""
    n = stored(found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")))
    first = F.floor(F.col("pair") / size_b).cast("long")
    most = n.groupBy(first.alias("a")).agg(F.max("n").alias("most"))
    return n.withColumn("a", first).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def scored_by_broadcast(found: DataFrame, counts: DataFrame) -> DataFrame:
    """``found`` with n_best and count_sum; the counts' number was checked."""
    held = counts.orderBy("pair").toPandas()
    tables = found.sparkSession.sparkContext.broadcast(tuple(held[c].to_numpy() for c in ("pair", "n", "best")))
    kept = [c for c in found.columns if c not in ("pairs", "times")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = tables.value
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times").flatten().to_numpy()
            of = np.repeat(np.arange(batch.num_rows), pairs.value_lengths().to_numpy())
            at = np.searchsorted(pair, pairs.flatten().to_numpy())
            n_best, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(n_best, of, times * best[at])
            np.add.at(total, of, times * n[at])
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(n_best), pa.array(total)], [*kept, "n_best", "count_sum"])

    schema = ", ".join([*(f"`{c}` {t}" for c, t in found.dtypes if c in kept), "n_best long", "count_sum long"])
    return found.mapInArrow(run, schema)


def scored_by_join(found: DataFrame, counts: DataFrame) -> DataFrame:
    """``found`` with n_best and count_sum; hot pairs' counts are broadcast, all others' joined by a shuffle."""
    links = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("row", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
    hot = stored(hot_keys(links, "pair", found.agg(F.sum(F.size("pairs"))).first()[0] or 0))
    of = looked_up(links, counts, "pair", hot)
    sums = of.groupBy("row").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    none = F.lit(0).cast("long")
    both = found.drop("pairs", "times").join(sums, "row", "left")
    return both.withColumns({c: F.coalesce(c, none) for c in ("n_best", "count_sum")})


def align(docs: DataFrame, first: str, second: str, key: str = "doc_id", text: str = "text", broadcast: int = BROADCAST_PAIRS) -> tuple[DataFrame, DataFrame]:
    """Every document's figures, and (a, b, n, best): the id pairs linked anywhere."""
    size_b = sentencepiece.SentencePieceProcessor(model_file=second).get_piece_size()
    found = stored(linked(docs, first, second, key, text))
    counts = stored(pair_counts(found, size_b))
    per = scored_by_broadcast(found, counts) if counts.count() <= broadcast else scored_by_join(found, counts)
    pairs = counts.select(F.floor(F.col("pair") / size_b).cast("long").alias("a"), (F.col("pair") % size_b).alias("b"), "n", "best")
    return per.select(key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"), pairs


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of all documents' tokens under two tokenizers."""
    return align(table(spark, sf_dir, "documents"), *map(public_tokenizers.path, (FIRST, SECOND)))[0]
