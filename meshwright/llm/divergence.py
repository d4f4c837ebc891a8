"""Divergence of sources: how far each source's words are from every other's, and which words set it apart.

Tasks count words batch by batch in dictionaries of bounded size; (lang, source,
term) rows with partial counts are all that is shuffled. Of each language the
terms of enough documents are kept: V of them. A group of language and source
gives a kept term that it has n of the rounded share

    p(n) = 1 + floor(UNIT * (n + PRIOR) / (N + PRIOR * V)),

N being the sum of n over kept terms, so every pair of groups differs by V times
f(0, 0) = |p(0) - q(0)| before any word is looked at. The postings of the
inverted index then only correct that baseline: a term that one group alone has
by f(n, 0) - f(0, 0), counted once for each number of occurrences; a term that
both have by f(n, m) - f(n, 0) - f(0, m) + f(0, 0), found by a join of the
postings on the term. Terms that neither has are never touched. Arithmetic is
exact: products are decimals of 38 digits.

Null text, lang and source count as empty. A group without kept terms gives
them p(0); a language with V = 0 has pairs of value 0 and no terms. Very long
texts are read whole, in chunks. Ties in value are ordered by item. Rows are
documents: repeated rows and doc_ids count as often as they occur. An empty
table gives no rows. Further columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, stored, table

#: Documents a kept term is in at least; words added to every count; what shares are counted in; ranks of the term report.
LEAST_DOCS, PRIOR, UNIT, RANKS = 30, 5, 1_000_000_000, 50
#: Entries of a task's dictionaries before their counts leave it; bytes of a text that are split at once.
ENTRIES, CHUNK = 300_000, 4 << 20

#: Letters A to Z in lower case, other letters and bytes beyond ASCII as they are, the rest blank.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes, chunk: int = CHUNK) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, chunk by chunk."""
    data, at = text.translate(LETTERS), 0
    while at < len(data):
        end = at + chunk
        if end < len(data):
            cut = data.rfind(b" ", at, end)
            end = cut if cut >= at else data.find(b" ", end)
        end = len(data) if end < 0 or end >= len(data) else end + 1
        yield data[at:end].split()
        at = end


def counted(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents; a row with a null term for every group."""
    small_batches(docs.sparkSession)
    names = ["lang", "source", "term", "n", "docs"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def rows(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> pa.RecordBatch:
        out: list[list] = [[] for _ in names]
        for (own_lang, own_source), (n, of) in held.items():
            terms = [None, *n]
            for column, values in zip(out, ([own_lang] * len(terms), [own_source] * len(terms), terms, [0, *n.values()], [0, *map(of.__getitem__, n)]), strict=True):
                column += values
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in batches:
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for key, value in zip(keys, batch.column(2).cast(pa.binary()), strict=True):
                n, of = held.setdefault(key, (Counter(), Counter()))
                own: set[bytes] = set()
                for some in words(value.as_py()):
                    n.update(some)
                    own.update(some)
                of.update(own)
            if sum(len(n) for n, _ in held.values()) > ENTRIES:
                yield rows(held)
                held = {}
        if held:
            yield rows(held)

    whole = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))
    part = whole.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return part.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, v: Column) -> Column:
    """A term's share in units; null where there are no kept terms."""
    top = F.lit(UNIT).cast("decimal(10,0)") * (n + PRIOR).cast("decimal(20,0)")
    bottom = F.nullif(total + PRIOR * v, F.lit(0)).cast("decimal(20,0)")
    return F.call_function("div", top, bottom) + 1


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST_DOCS, ranks: int = RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank): every group's distance to the others of its language, and the terms it has more of than its language."""
    every = stored(counted(docs, lang, source, text))
    found = every.where("term IS NOT NULL")
    kept = stored(found.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("every")).where(F.col("docs") >= least).select("lang", "term", "every"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("every").alias("whole"))
    postings = stored(found.select("lang", "source", "term", "n").join(kept, ["lang", "term"]))
    totals = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    none = F.lit(0).cast("long")
    groups = every.where("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = groups.select("lang", "source", *(F.coalesce(c, none).alias(c) for c in ("total", "v", "whole")))
    groups = stored(groups.withColumn("p0", share(none, F.col("total"), F.col("v"))))

    own = postings.join(groups, ["lang", "source"])
    own = stored(own.select("lang", "source", "term", share(F.col("n"), F.col("total"), F.col("v")).alias("p"), "p0", share(F.col("every"), F.col("whole"), F.col("v")).alias("q")))

    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    gap = lambda a, b: F.abs(F.col(a) - F.col(b))
    baseline = groups.join(other, "lang").where("source <> item").select("lang", "source", "item", F.coalesce(F.col("v") * gap("p0", "q0"), none).alias("value"))
    alike = own.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("n"))
    alone = alike.join(other, "lang").where("source <> item").select("lang", "source", "item", (F.col("n") * (gap("p", "q0") - gap("p0", "q0"))).alias("value"))
    both_sides = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    mutual = lambda rows: rows.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", F.explode(both_sides).alias("e"), "value").select("lang", "e.*", "value")
    left, right = own.select("lang", "term", "source", "p", "p0"), own.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("r"), F.col("p0").alias("q0"))
    shared = left.join(right, ["lang", "term"]).where("source < item")
    shared = shared.select("lang", "source", "item", (gap("p", "r") - gap("p", "q0") - gap("r", "p0") + gap("p0", "q0")).alias("value")).where("value <> 0")
    pairs = baseline.unionByName(mutual(alone)).unionByName(mutual(shared))
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    terms = own.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    best = terms.withColumn("rank", rank).where(F.col("rank") <= ranks)
    columns = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), "rank")
    return columns(pairs.withColumn("rank", rank), "pair").unionByName(columns(best, "term"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of all sources of every language, and each one's fifty most telling terms."""
    return audit(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS every FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 30),
n AS MATERIALIZED (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
grid AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n, k.every FROM g JOIN kept k USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
total AS (SELECT lang, source, sum(n) AS total, count(*) AS v, sum(every) AS whole FROM grid GROUP BY ALL),
p AS MATERIALIZED (SELECT lang, source, term, n, 1 + CAST(1000000000 AS HUGEINT) * (n + 5) // (total + 5 * v) AS p, 1 + CAST(1000000000 AS HUGEINT) * (every + 5) // (whole + 5 * v) AS q
      FROM grid JOIN total USING (lang, source)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
      FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT * FROM r WHERE part = 'pair' OR rank <= 50
"""
