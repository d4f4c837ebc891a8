"""Divergence, mixing and alignment against brute force, and on awkward tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from meshwright.llm import alignment, divergence, mixing

from test_text import AWKWARD, documents, empty

# --- divergence of sources ---


def brute_audit(rows, least, ranks):
    """(lang, source, part, item, value, rank) by the definition, over whole grids of groups and terms."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n, docs, groups = Counter(), Counter(), set()
    for lang, source, text in ((a or "", b or "", c or "") for a, b, c in rows):
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(lower))
        groups.add((lang, source))
        n.update((lang, source, t) for t in terms)
        docs.update({(lang, t) for t in terms})
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (own, t), k in docs.items() if own == lang and k >= least]
        sources = sorted((s for own, s in groups if own == lang), key=str.encode)
        count = {s: {t: n[lang, s, t] for t in kept} for s in sources}
        every = {t: sum(count[s][t] for s in sources) for t in kept}
        share = lambda c, v=len(kept): {t: 1 + 10**9 * (k + 5) // (sum(c.values()) + 5 * v) for t, k in c.items()}
        p, q = {s: share(count[s]) for s in sources}, share(every)
        for s in sources:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s))
            terms = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if count[s][t] and p[s][t] > q[t])
            for part, found in (("pair", pairs), ("term", terms[:ranks])):
                out += [(lang, s, part, item, -v, k) for k, (v, _, item) in enumerate(found, 1)]
    return sorted(out)


def test_divergence_is_the_definition(spark):
    rng = random.Random(11)
    words = ["the", "Of", "é漢", "naïve", "x1y", "a-b", "ZEBRA", "zebra", "\x7f", "ÀB"]
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "é", None, "z"]), " ".join(rng.choices(words, [9, 5, 3, 2, 2, 2, 1, 1, 1, 1], k=rng.randrange(30)))) for _ in range(300)]
    rows += [("en", "quiet", ""), ("en", "null", None), ("xx", "alone", "nothing kept here"), ("xx", "other", None)]
    df = spark.createDataFrame([(i, *r, 1, 2) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string, n long, term int").repartition(7)
    for least, ranks in ((30, 50), (3, 2), (10**6, 50)):
        assert sorted(map(tuple, divergence.audit(df, least=least, ranks=ranks).collect())) == brute_audit(rows, least, ranks)
    assert divergence.audit(df.limit(0)).count() == 0


def test_divergence_shares_are_exact(spark):
    """Counts whose products pass 64 bits."""
    from pyspark.sql import functions as F

    n, total, v = 123_456_789_012_345, 2_345_678_901_234_567, 98_765
    row = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(v)).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (n + 5) // (total + 5 * v)


def test_words_of_long_texts_in_chunks():
    text = ("Some Wörter, and 漢字 " * 50 + "x" * 300 + " end").encode()
    whole = [w for some in divergence.words(text) for w in some]
    for chunk in (1, 7, 64, 1000):
        assert [w for some in divergence.words(text, chunk) for w in some] == whole
    assert list(divergence.words(b"")) == []


def test_divergence_of_awkward_rows(spark):
    df = documents(spark).selectExpr("*", "lang AS source")
    rows = [(r["lang"], r["source"], r["text"]) for r in df.collect()]
    assert sorted(map(tuple, divergence.audit(df, least=1).collect())) == brute_audit(rows, 1, 50)


# --- mixing ---


def water_fill(sizes, weights=(5, 2, 1), passes=3):
    """Targets by the rounds of the definition: cap those above, share the rest again."""
    names = sorted((s for s in sizes if s is not None), key=str.encode) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest, w = total - sum(passes * sizes[s] for s in capped), sum(weight[s] for s in names if s not in capped)
        target = {s: passes * sizes[s] if s in capped else weight[s] * rest / w for s in names}
        over = {s for s in names if s not in capped and target[s] > passes * sizes[s]}
        if not over:
            return names, target
        capped |= over


def brute_mix(rows, passes=3):
    """[(doc_id, size, taken)] in one list: whole queues, merged by finish time, cut at the budget."""
    sized = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), t or "") for i, s, t in rows]
    sizes = defaultdict(int)
    for _, s, n, _ in sized:
        sizes[s] += n
    names, target = water_fill(sizes)
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    turns = []
    for k, s in enumerate(names):
        own = sorted((md5(":".join([*([str(i)] if i is not None else []), md5(t)])), j) for j, (i, o, n, t) in enumerate(sized) if o == s and n)
        done = 0
        for _ in range(passes):
            for h, j in own:
                done += sized[j][2]
                turns.append((done / target[s], k, h, j))
    taken, left = [0] * len(rows), sum(sizes.values())
    for _, _, _, j in sorted(turns):
        if sized[j][2] > left:
            break
        left -= sized[j][2]
        taken[j] += sized[j][2]
    key = lambda r: tuple((x is None, x) for x in r)
    return sorted(((i, n, sizes[s], target[s], taken[j]) for j, (i, s, n, _) in enumerate(sized)), key=key)


def mix_rows(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choices(["a", "b", "c", "d", "é", None, ""], [12, 3, 3, 2, 1, 1, 1])[0]
        rows.append((i, source, rng.choice([None, "", " \t\n", "w " * rng.randrange(1, 60), "w x\x0by " * rng.randrange(1, 9)])))
    return rows + [rows[5]] * 3 + [(None, "a", "same words"), (None, "a", "same words"), (None, None, None)]


def as_rows(df):
    key = lambda r: tuple((x is None, x) for x in r)
    return sorted((tuple(r) for r in df.select("doc_id", "size", "source_size", "target", "taken").collect()), key=key)


@pytest.mark.parametrize("few", [10_000, 3])
def test_mix_is_the_definition(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "FEW", few)
    monkeypatch.setattr(mixing, "BINS", 8)
    rows = mix_rows(few)
    df = spark.createDataFrame([(*r, 7, 8) for r in rows], "doc_id long, source string, text string, size int, place int").repartition(5)
    got, want = as_rows(mixing.schedule(df)), brute_mix(rows)
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want])
    assert sum(r[4] for r in got) <= sum(r[1] for r in got) and all(r[4] <= 3 * r[1] for r in got)
    assert as_rows(mixing.schedule(df.repartition(3))) == got


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(5)
    rows = [(i, f"s{min(9, int(rng.expovariate(0.4)))}", "w " * rng.randrange(1, 40)) for i in range(3000)]
    got = spark.createDataFrame(rows, "doc_id long, source string, text string")
    per = mixing.schedule(got).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= 40 for r in per)


def test_mixed_rows_are_the_taken_ones_in_order(spark):
    rows = mix_rows(9, 150)
    df = spark.createDataFrame([(*r, "kept") for r in rows], "doc_id long, source string, text string, times string")
    plan = mixing.schedule(df)
    times = {(r["doc_id"], r["source"]): r["n"] for r in plan.groupBy("doc_id", "source").agg({"times": "sum"}).withColumnRenamed("sum(times)", "n").where("n > 0").collect()}
    out = mixing.mixed(df)
    assert out.columns == df.columns
    assert Counter((r["doc_id"], r["source"]) for r in out.collect()) == times


def test_mix_of_awkward_rows(spark):
    df = documents(spark).selectExpr("*", "lang AS source")
    assert mixing.schedule(df).count() == len(AWKWARD)
    assert mixing.schedule(empty(spark).selectExpr("*", "lang AS source")).count() == 0
    wordless = spark.createDataFrame([(1, "a", None), (2, "b", " "), (None, None, "")], "doc_id long, source string, text string")
    assert as_rows(mixing.schedule(wordless)) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0), (None, 0, 0, 0.0, 0)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=9))
def test_water_filling_by_hand(sizes):
    """The definition's rounds end with the budget shared out and nothing above its cap."""
    own = {f"s{k}": n for k, n in enumerate(sizes)}
    _, target = water_fill(own)
    assert sum(target.values()) == pytest.approx(sum(sizes)) and all(target[s] <= 3 * n + 1e-9 for s, n in own.items())


def test_targets_are_the_water_filling(spark):
    rng = random.Random(2)
    for _ in range(4):
        sizes = {f"s{k}": rng.choice([0, 1, 5, 40, 1000, 50_000]) for k in range(8)} | {None: rng.randrange(90)}
        rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r["source"]: r["target"] for r in mixing.targets(rows).collect()}
        assert got == pytest.approx(water_fill(sizes)[1])


# --- alignment ---

PATHS = [public_tokenizers.path(n) for n in (alignment.FIRST, alignment.SECOND)]


def brute_document(text):
    """(n_a, n_b, groups) of a whole text, by where both sides end."""
    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    own = alignment.aligner(*PATHS)
    ids = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)] if text else [[], []]
    spelled = [[t[i] for i in x] for t, x in zip((own.bytes_a, own.bytes_b), ids, strict=True)]
    if not text or any(b"".join(s) != (" " + text).encode() for s in spelled):
        return [], [], []
    ends = []
    for s in spelled:
        at, e = 0, []
        for x in s:
            at += len(x)
            e.append(at)
        ends.append(e)
    groups, i, j = [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        x, y = ends[0].index(end) + 1, ends[1].index(end) + 1
        groups.append((ids[0][i:x], ids[1][j:y]))
        i, j = x, y
    return *ids, groups


def brute_align(texts):
    docs = [brute_document(t or "") for t in texts]
    n = Counter()
    for *_, groups in docs:
        n.update({(x, y) for g in groups for x in g[0] for y in g[1]})
    most = defaultdict(int)
    for (x, _), k in n.items():
        most[x] = max(most[x], k)
    out = []
    for a, b, groups in docs:
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        shown = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(n[k] == most[k[0]] for k in links), sum(n[k] for k in links), hashlib.sha256(shown.encode()).hexdigest() if shown else ""))
    return out


TEXTS = [
    "Plain words, and plainer words: the naïve café's 12,345 tokens.", "Plain words again", None, "", " ", "  two  spaces ", "line\n\nline\r\n\ttab \n x", "漢字かな交じり文 и кириллица",
    "é and ﬁ", "<|endoftext|> </s> <unk> <0x0A> ▁", "x" * 3000, "😀😀 👩‍👩‍👧", "a\x00b\x1c \x85c  d", "word " * 500, " lead", "trail ", "'s don't  we'll", "\nfirst line", "tab\t tab",
]


@pytest.mark.parametrize("broadcast", [alignment.BROADCAST_PAIRS, 0])
def test_alignment_is_the_definition(spark, broadcast):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(1, TEXTS[1]), (None, TEXTS[0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, row int, pair int").repartition(3)
    got, pairs = alignment.align(df, *PATHS, broadcast=broadcast)
    want = sorted(((i is None, i or 0), *x) for (i, _), x in zip(rows, brute_align([t for _, t in rows]), strict=True))
    cols = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), *(r[c] for c in cols)) for r in got.collect()) == want
    assert pairs.where("best").count() >= pairs.select("a").distinct().count() > 50
    assert alignment.align(df.limit(0), *PATHS, broadcast=broadcast)[0].count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab é漢.'\n\t 1 ▁😀", max_size=30))
def test_documents_are_the_definition(text):
    own = alignment.aligner(*PATHS)
    n_a, n_b, shown, pairs, times = own.document(text)
    a, b, groups = brute_document(text)
    assert (n_a, n_b, shown.decode()) == (len(a), len(b), ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups))
    assert dict(zip(pairs.tolist(), times.tolist(), strict=True)) == Counter(x * own.size_b + y for g in groups for x in g[0] for y in g[1])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=12), st.randoms())
def test_components_end_where_both_end(lengths, rng):
    total = sum(lengths)
    ends_a = sorted({total, *(x for x in range(1, total) if rng.random() < 0.4)})
    ends_b = sorted({total, *(x for x in range(1, total) if rng.random() < 0.4)})
    cuts = sorted(set(ends_a) & set(ends_b))
    of = lambda ends: [sum(c < e for c in cuts) for e in ends]
    got = alignment.overlap_groups(np.array(ends_a), np.array(ends_b))
    assert [x.tolist() for x in got] == [of(ends_a), of(ends_b)]


def test_large_groups_link_their_distinct_ids(monkeypatch):
    """A group of many tokens on both sides gives the links of its listing."""
    own = alignment.aligner(*PATHS)
    rng = np.random.default_rng(1)
    a, b, of = rng.integers(0, 9, 40), rng.integers(0, 7, 50), (np.repeat([0, 1], [30, 10]), np.repeat([0, 1], [45, 5]))
    want = [x.tolist() for x in own.links(a, b, *of)]
    monkeypatch.setattr(alignment, "MOST_LINKS", 60)
    assert [x.tolist() for x in own.links(a, b, *of)] == want and sum(want[1]) == 30 * 45 + 10 * 5


def test_alignment_on_awkward_rows(spark):
    got, _ = alignment.align(documents(spark), *PATHS)
    assert got.count() == len(AWKWARD)
