"""The pipeline's stages, each on what the one before kept, and the whole against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from meshwright.llm import pii, quality
from test_text import brute_classes, brute_resampling
from tokenizers import Tokenizer


def tables(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices(["the", "er", "ing", "on", "st"], k=rng.randint(1, 3)))
    docs, labels = [], []
    for i in range(240):
        words = [word() for _ in range(rng.randint(8, 120))]
        text = " ".join(words) if i % 6 else " ".join(w.upper() + "!!" for w in words)
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, int(i % 6 > 0), 0))
    mail = docs[1][1] + " write to jo.doe@mail.example please"
    docs += [(500, docs[7][1], "en", "s", len(docs[7][1])), (501, docs[8][1] + " extra", "en", "s", 0), (502, mail, "en", "s", len(mail))]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return {d[0]: d[1] for d in docs}


def test_stages(spark, tmp_path):
    texts = tables(spark, tmp_path)
    docs, sizes = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        sizes.append(docs.select("doc_id").distinct().count())
        if k < 3:
            assert docs.columns == columns
    first = {r["doc_id"] for r in spark.read.parquet(str(tmp_path / "stage0")).collect()}
    assert {i for i in texts if i < 240 and i % 6} <= first and not {i for i in texts if i < 240 and i % 6 == 0} & first
    second = {r["doc_id"] for r in spark.read.parquet(str(tmp_path / "stage1")).collect()}
    assert 500 not in second and 7 in second
    third = {r["doc_id"]: r["text"] for r in spark.read.parquet(str(tmp_path / "stage2")).collect()}
    assert third.keys() == second and not any(pii.find(t) for t in third.values())
    assert sizes[3] == len(third)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_stages_with_odd_rows(spark, tmp_path):
    """Nulls, empty and repeated rows, a very long text, and columns whose names clash."""
    texts = tables(spark, tmp_path)
    rows = [(600, None, None, None, None), (601, "", "en", "s", 0), (None, "text without an id " * 9, "en", "s", 1), (603, texts[7], "en", "s", 1), (603, texts[7], "en", "s", 1), (604, "the er ing on st " * 20_000, "en", "s", 9)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = spark.read.parquet(str(tmp_path / "documents.parquet")).unionByName(odd).withColumns({n: F.lit(n) for n in ("key", "w", "k", "i", "s", "ids", "length", "__key", "gumbel_key")})
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, columns = docs.count(), docs.columns
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"odd{k}"))
        docs = spark.read.parquet(str(tmp_path / f"odd{k}"))
        if k < 3:
            assert docs.columns == columns and docs.count() <= before
            assert docs.select(*columns[5:]).distinct().count() == 1
    kept = {r["doc_id"] for r in docs.collect()}
    assert None in kept and 7 in kept and 603 not in kept and {600, 601} & kept == {600}


def test_stages_of_nothing(spark, tmp_path):
    tables(spark, tmp_path)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet")).limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"none{k}"))
        docs = spark.read.parquet(str(tmp_path / f"none{k}"))
        assert docs.count() == 0


def test_pipeline_against_brute_force(spark, tmp_path):
    texts = tables(spark, tmp_path)
    _, _, drawn = brute_resampling(sorted(texts.items()), [(i, int(i % 6 > 0), 0) for i in range(240)], quality.SEED)
    classes = brute_classes([(i, texts[i]) for i in sorted(drawn)])
    wanted = {i for i in drawn if classes[i][0] == i}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    clean = {i: re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[EMAIL]", texts[i]) for i in wanted}
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids, sequences = defaultdict(list), defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        assert r["start"] == len(ids[r["doc_id"]]) and r["length"] == len(r["ids"]) // 4
        ids[r["doc_id"]] += np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert ids == {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for i, t in clean.items()}
    for own in sequences.values():
        ends = [0, *(a + n for a, n in sorted(own))]
        assert [a for a, _ in sorted(own)] == ends[:-1] and ends[-1] <= 1024
    assert len(sequences) <= sum(map(len, ids.values())) / 1024 * 1.02 + 1
