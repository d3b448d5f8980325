"""Toxicity (nnPU) and quality (attention MIL): held-out accuracy, folds, edge cases."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from ratelens.llm import labelled, quality, toxicity

SCHEMA = "doc_id long, text string"


def corpus(kind, n=900, seed=4):
    """Documents of made-up words; toxic ones hold words with a marked beginning, bad ones are punctuation and repeats."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ba", "ne", "to", "ri", "la", "su", "mi"]) for _ in range(rng.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randint(20, 200))]
        y = int(rng.random() < 0.25)
        if kind == "toxic" and y:
            for _ in range(6):
                w[rng.randrange(len(w))] = "grush" + word()
        if kind == "quality" and not y:
            k = rng.randrange(len(w) // 2)
            w[k:] = [x + "%%%" for x in w[k:]] if rng.random() < 0.5 else [w[k]] * (len(w) - k)
        docs.append((i, " ".join(w)))
        if rng.random() < 0.7:
            labels.append((i, y))
    return docs, labels


def quality_of(out, labels):
    y = dict(labels)
    held = [(r.predicted, y[r.doc_id]) for r in out if r.held_out and r.doc_id in y]
    return np.mean([a == b for a, b in held]), held


@pytest.mark.parametrize("kind", ["toxic", "quality"])
def test_held_out_accuracy(spark, kind):
    docs, labels = corpus(kind)
    op = toxicity if kind == "toxic" else quality
    d = spark.createDataFrame(docs, SCHEMA)
    model = op.train(d, spark.createDataFrame(labels, f"doc_id long, {kind} int"))
    out = op.score(d, model).collect()
    accuracy, held = quality_of(out, labels)
    assert len(out) == len(docs) and len(held) > 100 and accuracy > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in out)


@pytest.mark.parametrize("kind", ["toxic", "quality"])
def test_held_out_labels_are_not_learned(spark, kind):
    docs, labels = corpus(kind, 300)
    op = toxicity if kind == "toxic" else quality
    d = spark.createDataFrame(docs, SCHEMA)
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    scores = [[r.score for r in op.score(d, op.train(d, spark.createDataFrame(x, f"doc_id long, {kind} int")))
               .orderBy("doc_id").collect()] for x in (labels, flipped)]
    assert scores[0] == scores[1]


@pytest.mark.parametrize("kind", ["toxic", "quality"])
def test_nulls_repeats_long_texts_and_clashing_columns(spark, kind):
    docs, labels = corpus(kind, 200)
    op = toxicity if kind == "toxic" else quality
    odd = [(1000, None), (1001, ""), (1002, " \n "), (None, "ba ne"), (5, docs[5][1]), (1003, "ba ne to " * 60000)]
    d = spark.createDataFrame(docs + odd, SCHEMA).withColumns({c: F.lit(1) for c in ("score", "y", "n", "x", "held_out")})
    bad = [(7, None), (None, 1), (8, 5)]
    model = op.train(d, spark.createDataFrame(labels + bad + labels[:5], f"doc_id long, {kind} int"))
    out = op.score(d, model)
    rows = out.collect()
    assert len(rows) == len(docs) + len(odd) and all(r.score is not None and 0 <= r.score <= 1 for r in rows)
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, set()).add(r.score)
    assert len(by_id[5]) == 1 and by_id[1000] == by_id[1001] == by_id[1002]
    assert not [r for r in rows if r.doc_id is None][0].held_out
    assert op.score(spark.createDataFrame([], SCHEMA), model).count() == 0


@pytest.mark.parametrize("kind", ["toxic", "quality"])
def test_without_labels_or_with_one_label(spark, kind):
    op = toxicity if kind == "toxic" else quality
    d = spark.createDataFrame([(i, f"ba ne {i}") for i in range(20)], SCHEMA)
    for rows in ([], [(i, 1) for i in range(20)], [(i, 0) for i in range(20)]):
        out = op.score(d, op.train(d, spark.createDataFrame(rows, f"doc_id long, {kind} int"))).collect()
        assert len(out) == 20 and all(0 <= r.score <= 1 for r in out)
    empty = spark.createDataFrame([], SCHEMA)
    assert op.score(empty, op.train(empty, spark.createDataFrame([], f"doc_id long, {kind} int"))).count() == 0


def test_sample_bounds_hold(spark):
    docs, labels = corpus("quality", 300)
    d, y = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")
    known = labelled.training_labels(y, "quality")
    assert labelled.first_by_hash(known, 7, 1).count() == 7
    model = quality.train(d, y, documents=30, passages=40)
    assert quality.score(d, model).count() == 300


def test_nnpu_risk_stays_non_negative_with_a_wrong_prior():
    rng = np.random.default_rng(0)
    positive = np.arange(400) < 100
    row = np.flatnonzero(positive | (rng.random(400) < 0.1))
    for prior in (0.05, 0.3, 0.9):
        w = toxicity.fit_nnpu(row, np.zeros(len(row), np.int64), positive, 1, prior, 0)
        assert np.isfinite(w).all() and w[0] > 0


def test_training_holds_one_copy_of_the_passages_of_16_bits():
    import tracemalloc

    import pandas as pd
    rng = np.random.default_rng(5)
    x = np.sqrt(rng.integers(0, 4, (4000, quality.WIDTH)) / 300).astype("<f2")
    n = np.tile([1, 199, 40, 160], 10)
    rows = pd.DataFrame({"n": n, "x": [zlib.compress(a.tobytes(), 1) for a in np.split(x, np.cumsum(n)[:-1])]})
    tracemalloc.start()
    got = quality.unpacked(rows)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.dtype == np.float16 and (got == x).all() and most < 1.5 * x.nbytes
    row, y = np.arange(4000) // 10, (np.arange(400) % 2).astype(np.float32)
    narrow, wide = quality.fit(got, row, y, epochs=1), quality.fit(got.astype(np.float32), row, y, epochs=1)
    assert all((narrow[k] == wide[k]).all() for k in wide)


def test_passages_cover_whole_texts():
    import pyarrow as pa
    texts = pa.array(["a " * 200, None, "b " * 64, "c"])
    rows = np.concatenate([row + i for i, _, _, row in quality.encode(texts)])
    assert np.bincount(rows).tolist() == [4, 1, 1, 1]


def test_table_labels(spark):
    docs = spark.read.parquet(f"{brute.SF_SMALL}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{brute.SF_SMALL}/labels.parquet")
    out = quality.score(docs, quality.train(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in out]) > 0.9
