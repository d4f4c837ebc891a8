"""N-gram Jaccard join with Bayesian pruning.

Every different text gets the set of its five-word shingles (64-bit hashes) and
128 MinHash values. Texts that agree on one of 32 bands of four values share a
bucket; at a similarity of 0.8 a pair is missed by all bands once in 2e7.
Candidate pairs are compared on growing runs of MinHash values, and dropped as
soon as the posterior probability that they reach the threshold, from a uniform
prior, is below ``TOLERANCE``. What is left is verified on the shingle sets.

Buckets of up to ``SMALL`` texts give all their pairs. Texts that share a larger
one are crowded, and pairs of them are sought anew by rare shingles. Two sets of
the threshold's similarity share one of their rarest shingles: of n, ordered by
how many crowded texts have them, one of the first n - ceil(0.8 n) + 1 (prefix
filter). A text whose rarest ones are its own has no partner. Shingles that up
to ``SMALL`` texts have among their rarest give pairs; texts that larger ones
connect gather, each in one crowd, and all of a crowd are compared, in blocks:
each block prunes and verifies inside one task and gives a count of links for
each text and the few links that join its classes. So every link counts once,
and no pairs of a crowd are listed.

One row per document: doc_id, class_id (the least doc_id of its class), n_links
(all verified links of its text to other texts), n_copies (documents with the
same text). Copies share a row's class and links.

Words are what blanks part; a text of one to four words is one shingle. Null and
empty texts have no shingle and no link; they are classes by copies, null being
empty. Null doc_ids count as the largest; rows that repeat a doc_id each have
their own text's class. Very long texts are read whole. An empty table gives no
rows. Further columns, whatever their names, are left out, and kept as they are
by ``one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.components import components
from ..operators.iterate import hot_keys, looked_up
from ..schema import NetworkFrame
from .common import over_batches, small_batches, stored, table

WORDS, THRESHOLD, TOLERANCE = 5, 0.8, 1e-5
BANDS, PER_BAND, STEP = 32, 4, 16
#: Texts of a small bucket; texts and shingles in a share of a crowd at most; shares that a crowd has if they hold so many texts.
SMALL, BLOCK, BLOCK_GRAMS, SHARES, SHARE = 16, 1024, 1 << 21, 16, 128
#: Keys up to this many are broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_KEYS = 200_000

VALUES = BANDS * PER_BAND
_seed = np.random.default_rng(20).integers(1, 1 << 31, (2, VALUES), dtype=np.uint32) * 2 + 1


class Words(dict):
    """Hashes of words, kept while they are few."""

    MOST = 150_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode())
        return h


@lru_cache(maxsize=1)
def words() -> Words:
    return Words()


def shingles(text: str) -> np.ndarray:
    """The sorted set of a text's shingles."""
    own = text.split()
    if not own:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words().__getitem__, own), np.uint64, len(own))
    n = min(WORDS, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = (out ^ h[i : len(h) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def min_hashes(own: np.ndarray) -> np.ndarray:
    """The least value of each of 128 hash functions over a set of shingles."""
    out = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    x = (own >> np.uint64(32)).astype(np.uint32) ^ own.astype(np.uint32)
    for at in range(0, len(x), 512):
        h = x[at : at + 512, None] * _seed[0]
        h ^= h >> np.uint32(15)
        h *= _seed[1]
        h ^= h >> np.uint32(13)
        np.minimum(out, h.min(0), out=out)
    return out


@lru_cache(maxsize=8)
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """For 16, 32, ... compared values, the fewest matches with which a pair is kept.

    With a uniform prior the posterior of m matches of n is Beta(m+1, n-m+1); the
    chance that it exceeds t is that of at most m successes in n+1 trials at t.
    """
    out = []
    for n in range(STEP, VALUES + 1, STEP):
        chance, m = 0.0, 0
        while (chance := chance + comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)) < tolerance:
            m += 1
        out.append(m)
    return tuple(out)


def survivors(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of row pairs of MinHash values, the positions of those that no run of values rules out."""
    left, matches = np.arange(len(a)), np.zeros(len(a), np.int32)
    for i, least in enumerate(least_matches()):
        run = slice(i * STEP, (i + 1) * STEP)
        matches = matches + (a[left, run] == b[left, run]).sum(1)
        kept = matches >= least
        left, matches = left[kept], matches[kept]
    return left


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def key() -> F.Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, key, sig): the text's digest and MinHash values; no values without words."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        sig = []
        for t in batch.column("text"):
            own = shingles(t.as_py() or "")
            sig.append(min_hashes(own).tobytes() if len(own) else None)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(sig, pa.binary())], ["doc_id", "key", "sig"])

    return over_batches(docs.select("doc_id", "text", key().alias("key")), kernel, f"doc_id {dict(docs.dtypes)['doc_id']}, key binary, sig binary")


def banded(nodes: DataFrame) -> DataFrame:
    """(band, key): a row for each band, its number and values hashed to one long."""
    of_band = (np.arange(BANDS, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, BANDS, PER_BAND).astype(np.uint64)
        h = np.broadcast_to(of_band, sig.shape[:2]).copy()
        for i in range(PER_BAND):
            h = (h ^ sig[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        keys = batch.column("key").take(pa.array(np.repeat(np.arange(len(sig)), BANDS)))
        return pa.RecordBatch.from_arrays([pa.array(h.ravel().view(np.int64)), keys], ["band", "key"])

    return over_batches(nodes.select("key", "sig"), kernel, "band long, key binary")


def pruned(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that Bayesian comparison of their MinHash values keeps."""
    sig = nodes.select("key", "sig")
    both = pairs.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b")

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, VALUES) for c in ("sig_a", "sig_b"))
        at = pa.array(survivors(a, b))
        return pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], ["a", "b"])

    return over_batches(both.select("a", "b", "sig_a", "sig_b"), kernel, "a binary, b binary")


def shingle_sets(docs: DataFrame, nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, grams): the shingle sets of the texts with these keys, read again from one document each."""
    wanted = stored(keys.distinct().join(nodes.select("key", "first_id"), "key"))
    small = wanted.count() <= BROADCAST_KEYS
    own = docs.select("doc_id", "text", key().alias("key")).alias("d")
    w = (F.broadcast(wanted) if small else wanted).alias("w")
    first = own.join(w, (F.col("d.key") == F.col("w.key")) & F.col("d.doc_id").eqNullSafe(F.col("w.first_id")), "left_semi")

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("key"), pa.array([shingles(t.as_py() or "").tobytes() for t in batch.column("text")], pa.binary())], ["key", "grams"])

    return over_batches(first.select("key", "text"), kernel, "key binary, grams binary").groupBy("key").agg(F.any_value("grams").alias("grams"))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets reach the threshold."""
    both = pairs.join(sets.toDF("a", "grams_a"), "a").join(sets.toDF("b", "grams_b"), "b")

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = ([np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in ("grams_a", "grams_b"))
        return batch.select(["a", "b"]).filter(pa.array([jaccard(x, y) >= THRESHOLD for x, y in zip(a, b, strict=True)], pa.bool_()))

    return over_batches(both.select("a", "b", "grams_a", "grams_b"), kernel, "a binary, b binary")


def grams_of(sets: DataFrame) -> DataFrame:
    """(gram, key, n): a row for each shingle of each set, and how many its set has."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("grams")]
        sizes = np.array([len(x) for x in own], np.int64)
        keys = batch.column("key").take(pa.array(np.repeat(np.arange(len(own)), sizes)))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(own)), keys, pa.array(np.repeat(sizes, sizes))], ["gram", "key", "n"])

    return over_batches(sets.select("key", "grams"), kernel, "gram long, key binary, n long")


def rarest(sets: DataFrame) -> DataFrame:
    """(gram, key, n, held): the shingles of each set's prefix that other sets' prefixes have too, and how many do."""
    every = stored(grams_of(sets))
    n_rows = every.count()
    held = stored(every.groupBy("gram").agg(F.count("*").alias("held")).where("held > 1"))
    limit = hot_keys(every, "gram", n_rows)
    known = looked_up(every, held, "gram", limit)
    own = Window.partitionBy("key")
    place = F.row_number().over(own.orderBy("held", "gram")) + F.col("n") - F.count("*").over(own)  # shingles of this set alone come first
    prefix = F.col("n") - F.ceil(F.col("n") * THRESHOLD - 1e-9) + 1
    first = stored(known.withColumn("place", place).where(F.col("place") <= prefix).select("gram", "key", "n"))
    shared = stored(first.groupBy("gram").agg(F.count("*").alias("held"), F.min("key").alias("least")).where("held > 1"))
    return stored(looked_up(first, shared, "gram", hot_keys(first, "gram", first.count())))


def paired(groups: DataFrame, by: str) -> DataFrame:
    """(a, b), a < b: all pairs of keys in each of the small groups (``by``, key)."""
    small = groups.groupBy(by).agg(F.sort_array(F.collect_list("key")).alias("k"))  # at most SMALL keys each
    return small.select(F.explode(F.expr("flatten(transform(k, (x, i) -> transform(slice(k, i + 2, size(k)), y -> struct(x AS a, y AS b))))")).alias("p")).select("p.*").distinct()


def block_links(rows: pd.DataFrame) -> pd.DataFrame:
    """Links found in one block: (a, n) for the texts that have some, (a, b) with n = 0 for those that join its classes."""
    sig = np.stack([np.frombuffer(x, np.uint32) for x in rows["sig"]])
    grams = [np.frombuffer(x, np.uint64) for x in rows["grams"]]
    keys, side, within = rows["key"].to_numpy(), rows["side"].to_numpy(), rows["of"].iat[0] == rows["by"].iat[0]
    counts, label, joins = np.zeros(len(rows), np.int64), np.arange(len(rows)), []
    held = np.flatnonzero(side == 1)
    rare = prefixes(grams)
    for f in np.flatnonzero(side == 0):
        at = np.arange(f + 1, len(rows)) if within else held
        at = at[rare[f, at]]
        at = at[survivors(np.broadcast_to(sig[f], (len(at), VALUES)), sig[at])]
        if not len(at):
            continue
        sizes = np.array([len(grams[i]) for i in at])
        every = np.concatenate([grams[i] for i in at])
        place = np.minimum(np.searchsorted(grams[f], every), len(grams[f]) - 1)
        common = np.add.reduceat((grams[f][place] == every).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
        good = at[common / (sizes + len(grams[f]) - common) >= THRESHOLD]
        counts[f] += len(good)
        counts[good] += 1
        for i in good[np.unique(label[good], return_index=True)[1]]:
            if label[i] != label[f]:
                joins.append((keys[f], keys[i], 0))
                label[label == label[i]] = label[f]
    some = np.flatnonzero(counts)
    return pd.DataFrame([*joins, *((k, None, n) for k, n in zip(keys[some], counts[some], strict=True))], columns=["a", "b", "n"])


def prefixes(grams: list[np.ndarray]) -> np.ndarray:
    """For each two sets of a block, whether their prefixes meet; the order is by how many sets of the block have a shingle."""
    values, of, held = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    out, places = np.zeros((len(grams), len(grams)), bool), {}
    at = 0
    for i, own in enumerate(grams):
        ids = of[at : at + len(own)]
        at += len(own)
        n = len(own) - ceil(len(own) * THRESHOLD - 1e-9) + 1
        for x in ids[np.lexsort((ids, held[ids]))[:n]].tolist():
            if held[x] > 1:
                places.setdefault(x, []).append(i)
    for own in places.values():
        if len(own) > 1:
            out[np.ix_(own, own)] = True
    return out


def in_crowds(crowds: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """What ``block_links`` finds among the texts of each crowd (crowd, key, n), in blocks of two shares of them."""
    shares = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_GRAMS), F.least(F.ceil(F.count("*") / SHARE), F.lit(SHARES))).cast("int")
    sizes = stored(crowds.groupBy("crowd").agg(shares.alias("shares")))
    placed = looked_up(crowds, sizes, "crowd", hot_keys(crowds, "crowd", crowds.count())).withColumn("share", F.pmod(F.xxhash64("key"), F.col("shares")).cast("int"))
    # a share is in one block with itself and each other share
    other = F.explode(F.sequence(F.lit(0), F.col("shares") - 1))
    dealt = placed.select("crowd", "key", "share", other.alias("other"))
    blocks = dealt.select("crowd", "key", F.least("share", "other").alias("of"), F.greatest("share", "other").alias("by"), (F.col("share") > F.col("other")).cast("int").alias("side"))
    full = blocks.join(nodes.select("key", "sig").join(sets, "key"), "key")
    small_batches(crowds.sparkSession)
    return stored(full.groupBy("crowd", "of", "by").applyInPandas(block_links, "a binary, b binary, n long"))


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("key"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, key (the text's digest), label (the class's), class_id, n_links, n_copies per document."""
    every = stored(sketched(docs))
    texts = stored(every.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_copies"), F.any_value("sig").alias("sig")))
    nodes = texts.where("sig IS NOT NULL")
    bands = banded(nodes)
    sizes = stored(bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"))
    large = stored(sizes.where(F.col("n") > SMALL))
    hot = large.where(F.col("n") > max(256, BANDS * texts.count() // 1000))  # a thousand rows at most
    shared = stored(looked_up(bands, sizes, "band", hot))
    crowded = stored(shared.where(F.col("n") > SMALL).select("key").distinct())
    met = paired(shared.where(F.col("n") <= SMALL), "band")
    flag = crowded.withColumn("crowded", F.lit(True))
    listed = met.join(flag.toDF("a", "of_a"), "a", "left").join(flag.toDF("b", "of_b"), "b", "left").where("NOT coalesce(of_a AND of_b, false)").select("a", "b")
    pairs = stored(pruned(listed, nodes))
    sets = stored(shingle_sets(docs, nodes, ends(pairs).unionByName(crowded)))

    rare = rarest(sets.join(crowded, "key", "left_semi"))
    hubs = rare.where(F.col("held") > SMALL)
    together = components(NetworkFrame(hubs.select(F.col("key").alias("id")).distinct(), hubs.where("key <> least").select(F.col("key").alias("src"), F.col("least").alias("dst")).distinct()))
    crowd_of = stored(together.toDF("key", "crowd"))
    crowds = stored(hubs.groupBy("key").agg(F.first("n").alias("n")).join(crowd_of, "key"))
    apart = paired(rare.where(F.col("held") <= SMALL), "gram")
    apart = apart.join(crowd_of.toDF("a", "of_a"), "a", "left").join(crowd_of.toDF("b", "of_b"), "b", "left").where("NOT coalesce(of_a = of_b, false)").select("a", "b")
    pairs = pairs.unionByName(stored(pruned(apart, nodes)))

    links = stored(verified(pairs, sets))
    found = in_crowds(crowds, nodes, sets)
    counts = links.select(F.explode(F.array("a", "b")).alias("key"), F.lit(1).cast("long").alias("n")).unionByName(found.where("b IS NULL").select(F.col("a").alias("key"), "n"))
    links = stored(links.unionByName(found.where("b IS NOT NULL").select("a", "b")))
    labels = components(NetworkFrame(ends(links).distinct().withColumnRenamed("key", "id"), links.toDF("src", "dst"))).toDF("key", "label")
    degree = counts.groupBy("key").agg(F.sum("n").alias("n_links"))
    classed = texts.select("key", "first_id", "n_copies").join(labels, "key", "left").join(degree, "key", "left").withColumn("label", F.coalesce("label", "key"))
    classed = stored(classed.select("key", "label", "first_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links")))
    least = stored(classed.groupBy("label").agg(F.min("first_id").alias("class_id")))
    n_texts, n_rows = classed.count(), every.count()
    of_key = stored(looked_up(classed, least, "label", hot_keys(classed, "label", n_texts)).select("key", "label", "class_id", "n_links", "n_copies"))
    copied = of_key.where(F.col("n_copies") > max(256, n_rows // 1000))  # a thousand rows at most
    return looked_up(every.select("doc_id", "key"), of_key, "key", copied)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of every class one with the least doc_id (of several texts with it, the one of least digest); of repeated rows, one."""
    found = near_duplicates(docs)
    own_key, id_of, stays_key = (n + "_" * max(map(len, docs.columns)) for n in ("k", "i", "s"))  # longer than any other name
    first = found.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("label").agg(F.min("key").alias(stays_key), F.min("doc_id").alias(id_of))
    stays = stored(first.drop("label"))
    small = stays.count() <= BROADCAST_KEYS
    own = docs.withColumn(own_key, key())
    kept = own.join(F.broadcast(stays) if small else stays, own["doc_id"].eqNullSafe(F.col(id_of)) & (own[own_key] == F.col(stays_key))).drop(id_of, stays_key)
    # equal rows may be repeated: as each class keeps one text and id, only those are dropped
    once = found.groupBy(F.struct("doc_id", "key").alias("row")).agg(F.count("*").alias("n")).where("n > 1").isEmpty()  # as one column, so that copies of a text are dealt apart
    return kept.drop(own_key) if once else kept.dropDuplicates(["doc_id", own_key]).drop(own_key)


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and links of every document."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


#: All pairs of texts that share a shingle, and the classes their links make.
SQL = r"""
WITH RECURSIVE t AS (SELECT coalesce(text, '') AS text, min(doc_id) AS first_id, count(*) AS n_copies FROM documents GROUP BY 1),
w AS (SELECT text, first_id, n_copies, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM t),
g AS (SELECT DISTINCT first_id AS id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT first_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
rare AS (SELECT g FROM g GROUP BY g HAVING count(*) > 1),
c AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.id < b.id WHERE a.g IN (SELECT g FROM rare) GROUP BY ALL),
links AS (SELECT a, b FROM c JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE c / CAST(x.n + y.n - c AS DOUBLE) >= 0.8),
ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, r) USING KEY (id) AS (SELECT first_id, first_id FROM t UNION
  SELECT e.b, min(k.r) FROM reach k JOIN ends e ON e.a = k.id JOIN recurring.reach o ON o.id = e.b WHERE k.r < o.r GROUP BY e.b),
d AS (SELECT a, count(*) AS n_links FROM ends GROUP BY a)
SELECT doc_id, r AS class_id, coalesce(n_links, 0) AS n_links, n_copies
FROM documents JOIN t ON t.text = coalesce(documents.text, '') JOIN reach ON reach.id = t.first_id LEFT JOIN d ON d.a = t.first_id
"""
