"""Document fingerprints as invertible Bloom lookup sketches.

A text's paragraphs are its lines, lines of more than ``PIECE`` characters cut
from their start. Their distinct 64-bit digests go into the cells of a sketch:
each digest into one cell of each third, which adds to the cell's count and is
xor-ed, with a checksum, into its sums. Subtracting two sketches cell by cell
cancels what both versions have; cells left with one digest give it away, and
peeling it off frees others. The digests recovered tell the likeness: shared
over all distinct paragraphs.

If cells are left over, the difference's size is estimated from the parities of
the digests' counts, and both versions are sketched again with enough cells for
it: by further bits, digests are dealt into parts of ``3 * PART_THIRD`` cells.
A part whose cells do not peel is halved by the next bit, which doubles its
cells, until all digests are recovered; two digests differ in some bit, so this
ends. Every digest is looked at once for each doubling, so the work grows with n
log n in a text's paragraphs. Everything is DataFrame expressions.

Null texts are empty, have no paragraphs and the sketch of no cells in use; two
texts without paragraphs have likeness 1, one with and one without 0. The next
document is that of the next doc_id, null first, ties by text; after the last
comes the first; rows of one doc_id are neighbours in the order of their texts.
A table of one row is its own next; an empty one gives no rows. Further columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import n_partitions, table

#: Characters of a paragraph; cells in a third of a fingerprint and of a retry's part; differing digests meant for a part; rounds of peeling.
PIECE, THIRD, PART_THIRD, PER_PART, ROUNDS = 160, 8, 4, 3, 10
NO_DIGESTS = "CAST(array() AS array<struct<k: bigint, s: int>>)"
#: Ranges of doc_id in which neighbours are looked up, at most.
RANGES = 10_000


def paragraphs(text: str) -> str:
    """SQL: the distinct paragraph digests of a text."""
    return rf"array_distinct(transform(regexp_extract_all({text}, '[^\\n]{{1,{PIECE}}}', 0), p -> xxhash64(p)))"


def _cell(key: str, i: str, third: int) -> str:
    """SQL: whether ``key`` belongs in cell ``i``."""
    bits = third.bit_length() - 1
    return f"(shiftrightunsigned({key}, 12 * shiftright({i}, {bits})) & {third - 1}L) = ({i} & {third - 1})"


def sketch(keys: str, third: int = THIRD) -> str:
    """SQL: the cells of an array of digests."""
    return f"""transform(sequence(0, {3 * third - 1}), i -> aggregate(filter({keys}, x -> {_cell('x', 'i', third)}),
        named_struct('c', 0, 'k', 0L, 'h', 0L), (s, x) -> named_struct('c', s.c + 1, 'k', s.k ^ x, 'h', s.h ^ xxhash64(x))))"""


def subtracted(a: str, b: str) -> str:
    """SQL: the cells of the difference of two sketches."""
    return f"zip_with({a}, {b}, (x, y) -> named_struct('c', x.c - y.c, 'k', x.k ^ y.k, 'h', x.h ^ y.h))"


def peeled(cells: str, third: int = THIRD) -> str:
    """SQL: the differing digests (k, s: 1 for the first version's, -1 for the second's); null if cells are left over."""
    pure = lambda cells: f"array_distinct(transform(filter({cells}, c -> abs(c.c) = 1 AND c.h = xxhash64(c.k)), c -> named_struct('k', c.k, 's', c.c)))"
    less = f"""transform(s.cells, (c, i) -> aggregate(filter(s.pure, p -> {_cell('p.k', 'i', third)}), c,
        (q, p) -> named_struct('c', q.c - p.s, 'k', q.k ^ p.k, 'h', q.h ^ xxhash64(p.k))))"""
    step = f"transform(array({less}), cells -> named_struct('cells', cells, 'got', concat(s.got, s.pure), 'pure', {pure('cells')}))[0]"
    start = f"transform(array({cells}), cells -> named_struct('cells', cells, 'got', {NO_DIGESTS}, 'pure', {pure('cells')}))[0]"
    return f"""aggregate(sequence(1, {ROUNDS}), {start}, (s, r) -> if(size(s.pure) = 0, s, {step}),
        s -> if(exists(s.cells, c -> c.c <> 0 OR c.k <> 0 OR c.h <> 0), NULL, s.got))"""


def parity(keys: str) -> str:
    """SQL: 64 bits, each telling whether an odd number of digests falls on it."""
    return f"aggregate({keys}, 0L, (s, k) -> s ^ shiftleft(1L, CAST(shiftrightunsigned(k, 34) & 63 AS int)))"


def halvings(a: str, b: str) -> str:
    """SQL: how often two sets are to be halved so that about ``PER_PART`` digests of a part differ.

    Of 64 parities z differ if d digests do: z is about 32 (1 - (1 - 1/32)^d).
    Where most parities are random, all digests are taken to differ.
    """
    z, n = f"bit_count({parity(a)} ^ {parity(b)})", f"(size({a}) + size({b}))"
    return f"transform(array({z}), z -> CAST(greatest(0D, ceil(log2(if(z < 26, least({n}, ln(1 - z / 32D) / ln(1 - 1 / 32D)), {n}) / {PER_PART}))) AS int))[0]"


def halved(parts: str, n: str) -> str:
    """SQL: every part (a, b) in two, by the digests' ``n``-th bit."""
    own = lambda x, bit: f"filter(p.{x}, k -> (shiftrightunsigned(k, pmod(40 + {n}, 64)) & 1) = {bit})"
    both = ", ".join(f"named_struct('a', {own('a', bit)}, 'b', {own('b', bit)})" for bit in (0, 1))
    return f"flatten(transform({parts}, p -> array({both})))"


def difference(a: str, b: str, cells_a: str, cells_b: str) -> str:
    """SQL: the differing digests of two sets; by larger sketches, where the first does not peel."""
    whole = f"CAST(array(named_struct('a', {a}, 'b', {b})) AS array<struct<a: array<bigint>, b: array<bigint>>>)"
    parts = f"transform(array({halvings(a, b)}), n -> aggregate(sequence(0, 63), named_struct('parts', {whole}), (s, i) -> if(i >= n, s, named_struct('parts', {halved('s.parts', 'i')})), s -> named_struct('n', n, 'parts', s.parts)))[0]"
    tried = f"transform(s.parts, p -> named_struct('p', p, 'd', {peeled(subtracted(sketch('p.a', PART_THIRD), sketch('p.b', PART_THIRD)), PART_THIRD)}))"
    left = "transform(filter(t, x -> x.d IS NULL), x -> x.p)"
    step = f"transform(array({tried}), t -> named_struct('n', s.n + 1, 'parts', {halved(left, 's.n')}, 'got', concat(s.got, flatten(transform(filter(t, x -> x.d IS NOT NULL), x -> x.d)))))[0]"
    start = f"transform(array({parts}), s -> named_struct('n', s.n, 'parts', s.parts, 'got', {NO_DIGESTS}))[0]"
    larger = f"aggregate(sequence(0, 64), {start}, (s, r) -> if(size(s.parts) = 0, s, {step}), s -> s.got)"
    return f"coalesce({peeled(subtracted(cells_a, cells_b))}, {larger})"


def likeness(a: str, b: str, cells_a: str, cells_b: str) -> str:
    """SQL: shared paragraphs over all distinct ones."""
    d = difference(a, b, cells_a, cells_b)
    return f"""CASE WHEN size({a}) + size({b}) = 0 THEN 1D WHEN size({a}) = 0 OR size({b}) = 0 THEN 0D
        ELSE transform(array(size({d})), d -> (size({a}) + size({b}) - d) / (size({a}) + size({b}) + d))[0] END"""


def shown(cells: str) -> str:
    """SQL: a sketch as text; cells not in use are blank."""
    return f"array_join(transform({cells}, c -> if(c.c = 0, '', concat_ws(':', c.c, lower(hex(c.k)), lower(hex(c.h))))), ',')"


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text): every document with its successor, by one shuffle.

    Ranges of doc_id are the windows' partitions; the first rows of a range are
    also sent to the range before, where they only serve as successors.
    """
    spark = docs.sparkSession
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = min(RANGES, 4 * n_partitions(spark))
    cuts = [i / n for i in range(n)]
    found = own.agg(F.percentile_approx("doc_id", cuts, 100 * n).alias("cuts"), F.min("doc_id").alias("least"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    bounds = sorted({*(found["cuts"] or []), *([found["least"]] if found["least"] is not None else [])})
    if not bounds:
        bounds = [0]
    lifts = [1 << b for b in reversed(range(len(bounds).bit_length()))]
    array = f"array({', '.join(f'{b}L' for b in bounds)})"
    below = f"aggregate(array({', '.join(map(str, lifts))}), 0, (lo, s) -> if(lo + s <= {len(bounds)} AND element_at({array}, least(lo + s, {len(bounds)})) <= doc_id, lo + s, lo))"
    placed = own.withColumn("range", F.expr(below))
    if found["nulls"]:
        start = own.where("doc_id IS NULL").agg(F.min("text")).first()[0]
        is_first = F.col("doc_id").isNull() & (F.col("text") == start)
    else:
        is_first = F.col("doc_id").eqNullSafe(bounds[0])
    last = len(bounds) if found["least"] is not None else 0
    is_bound = F.coalesce(F.expr(f"element_at({array}, greatest(range, 1)) = doc_id AND range > 0"), F.lit(False))
    at = lambda where, guest: F.struct(where.cast("int").alias("range"), F.lit(guest).alias("guest"))
    seats = F.concat(F.array(at(F.col("range"), 0)), F.when(is_bound, F.array(at(F.col("range") - 1, 1))).otherwise(F.array().cast("array<struct<range:int,guest:int>>")),
                     F.when(is_first, F.array(at(F.lit(last), 2))).otherwise(F.array().cast("array<struct<range:int,guest:int>>")))
    # the first range has no nulls before it: then its guests stand alone there and are dropped
    seated = placed.withColumn("seat", F.explode(seats)).select("doc_id", "text", "seat.*")
    w = Window.partitionBy("range").orderBy("guest", F.asc_nulls_first("doc_id"), "text")
    return seated.withColumn("next_text", F.lead("text").over(w)).where("guest = 0").select("doc_id", "text", "next_text")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint every document, its edited text and its successor, and compare them."""
    own = with_next(table(spark, sf_dir, "documents")).withColumn("n_chars", F.length("text").cast("long"))
    edited = own.withColumn("edited", F.expr("concat(left(text, CAST(n_chars - n_chars div 2 AS int)), left(next_text, CAST(n_chars div 2 AS int)))"))
    sets = edited.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), *(F.expr(paragraphs(c)).alias(a) for c, a in (("text", "a"), ("edited", "b"), ("next_text", "c"))))
    cells = sets.select("*", *(F.expr(sketch(c)).alias(f"s{c}") for c in "abc"))
    return cells.select("doc_id", "n_chars", "edited_sha256", F.expr(shown("sa")).alias("fingerprint"), F.expr(shown("sb")).alias("edited_fingerprint"),
                        F.expr(likeness("a", "b", "sa", "sb")).alias("near_edited"), F.expr(likeness("a", "c", "sa", "sc")).alias("near_next"))
