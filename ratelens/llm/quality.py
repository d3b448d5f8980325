"""Operator 10: document quality by attention-based multiple-instance learning.

A document is a bag of passages (64 words each, the whole text). A passage is encoded as hashed byte trigrams; a learned
layer embeds it, gated attention (tanh times sigmoid) weighs it against the bag's other passages, and the weighted sum is
classified. Document labels train all of it at once, in numpy, on a bounded sample.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ratelens.llm import text
from ratelens.llm.common import written
from ratelens.llm.labelled import first_by_hash, held_out, sampled_texts, training_labels

PASSAGE_WORDS, BINS = 64, 508
#: Beside the trigrams: words equal to the word before, words, bytes a word, each scaled to about 1, and a constant.
WIDTH = BINS + 4
#: Bounds of the training sample: documents of each label, and passages in all.
DOCUMENTS, PASSAGES = 3000, 60000
#: Least steps of training, for small samples.
STEPS = 600


@dataclass(frozen=True)
class QualityModel:
    weights: dict[str, np.ndarray]


def encode(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """By chunk of rows i..j: i, j, the passages' vectors and their rows (from 0, ascending; each row has one at least)."""
    data, at = text.utf8(column)
    for i, j in text.chunks(at):
        h, row, first, end = text.words(data, at, i, j)
        count = np.bincount(row, minlength=j - i)
        passages = np.maximum(1, -(-count // PASSAGE_WORDS))
        owner = np.repeat(np.arange(j - i), passages)
        before = np.cumsum(passages) - passages
        x, more = np.zeros((len(owner), BINS), np.float32), np.zeros((len(owner), WIDTH - BINS), np.float32)
        more[:, 3] = 1
        if len(h):
            rank = np.arange(len(h)) - (np.cumsum(count) - count)[row]
            passage = before[row] + rank // PASSAGE_WORDS
            base = int(at[i])
            b = data[base:int(at[j])].astype(np.int64)
            # bytes belong to the passage of the last word that began
            word_at = np.zeros(len(b), np.int64)
            word_at[first - base] = 1
            word_at = np.cumsum(word_at) - 1
            b[(b >= 9) & (b <= 13)] = 32
            # trigrams within a row, from its first word on
            line = np.repeat(np.arange(j - i), np.diff(at[i:j + 1]))
            start = np.flatnonzero((word_at[:-2] >= 0) & (line[:-2] == line[2:])) if len(b) > 2 else np.zeros(0, np.int64)
            start = start[row[word_at[start]] == line[start]]
            tri = (b[start] * 65599 + b[start + 1]) * 65599 + b[start + 2]
            cell = passage[word_at[start]] * BINS + ((tri * 40503) >> 7) % BINS
            x = np.sqrt(np.bincount(cell, minlength=len(owner) * BINS).reshape(-1, BINS).astype(np.float32))
            n = np.maximum(np.bincount(passage, minlength=len(owner)), 1)
            again = np.zeros(len(h), bool)
            again[1:] = (h[1:] == h[:-1]) & (passage[1:] == passage[:-1])
            more[:, 0] = np.bincount(passage, again, len(owner)) / n
            more[:, 1] = np.log(n) / np.log(PASSAGE_WORDS)
            more[:, 2] = np.minimum(np.bincount(passage, end - first, len(owner)) / n, 32) / 16
        norm = np.sqrt((x * x).sum(1, keepdims=True))
        yield i, j, np.hstack([x / np.maximum(norm, 1), more]), owner


def _forward(w: dict[str, np.ndarray], x: np.ndarray, row: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """Gated attention over bags: the passages of a bag are consecutive, ``first`` has where each begins."""
    h = np.maximum(x @ w["embed"] + w["embed_bias"], 0)
    t, s = np.tanh(h @ w["tanh"]), 1 / (1 + np.exp(-(h @ w["gate"])))
    a = (t * s) @ w["attend"]
    e = np.exp(a - np.maximum.reduceat(a, first)[row])
    share = e / np.add.reduceat(e, first)[row]
    z = np.add.reduceat(share[:, None] * h, first, axis=0)
    f = z @ w["out"] + w["out_bias"]
    return {"h": h, "t": t, "s": s, "share": share, "z": z, "p": 1 / (1 + np.exp(-np.clip(f, -30, 30)))}


def fit(x: np.ndarray, row: np.ndarray, y: np.ndarray, seed: int = 0, size: int = 32, epochs: int = 12, batch: int = 64,
        rate: float = 0.004, ridge: float = 1e-5) -> dict[str, np.ndarray]:
    """Weights learned from bags: passages ``x`` (of 16 or 32 bits) of documents ``row`` (ascending from 0) labelled ``y``."""
    rng = np.random.default_rng(seed)
    draw = lambda *n: (rng.standard_normal(n) / np.sqrt(n[0])).astype(np.float32)
    rate0 = np.clip(y.mean(), 0.01, 0.99)
    w = {"embed": draw(x.shape[1], size), "embed_bias": np.zeros(size, np.float32), "tanh": draw(size, 16),
         "gate": draw(size, 16), "attend": draw(16), "out": draw(size),
         "out_bias": np.array(np.log(rate0 / (1 - rate0)), np.float32)}
    m = {k: np.zeros_like(v) for k, v in w.items()}
    v = {k: np.zeros_like(a) for k, a in w.items()}
    begin = np.searchsorted(row, np.arange(len(y) + 1))
    step = 0
    for _ in range(max(epochs, -(-STEPS * batch // len(y)))):
        order = rng.permutation(len(y))
        for i in range(0, len(y), batch):
            bags = order[i:i + batch]
            index = np.concatenate([np.arange(begin[b], begin[b + 1]) for b in bags])
            count = (begin[bags + 1] - begin[bags])
            own, first = np.repeat(np.arange(len(bags)), count), np.cumsum(count) - count
            xb = x[index].astype(np.float32)
            o = _forward(w, xb, own, first)
            df = ((o["p"] - y[bags]) / len(bags)).astype(np.float32)
            dz = df[:, None] * w["out"]
            dh = o["share"][:, None] * dz[own]
            dshare = (dz[own] * o["h"]).sum(1)
            da = o["share"] * (dshare - np.add.reduceat(o["share"] * dshare, first)[own])
            gated = o["t"] * o["s"]
            dg = da[:, None] * w["attend"]
            dt, ds = dg * o["s"] * (1 - o["t"] ** 2), dg * o["t"] * o["s"] * (1 - o["s"])
            dh = (dh + dt @ w["tanh"].T + ds @ w["gate"].T) * (o["h"] > 0)
            grad = {"embed": xb.T @ dh, "embed_bias": dh.sum(0), "tanh": o["h"].T @ dt, "gate": o["h"].T @ ds,
                    "attend": gated.T @ da, "out": o["z"].T @ df, "out_bias": df.sum()}
            step += 1
            for k in w:
                g = grad[k] + ridge * w[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                w[k] = (w[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return w


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
          documents: int = DOCUMENTS, passages: int = PASSAGES) -> QualityModel:
    """A model from labelled documents outside the held-out third.

    At most ``documents`` documents of each label, in order of a seeded hash, as long as their passages are at most
    ``passages`` (at least one document of each label is whole in it). With one label or none, every score is the
    labels' share of 1 (0.5 without labels)."""
    known = training_labels(labels, label_col)
    sample = written(first_by_hash(known.where("y = 1"), documents, 3).union(first_by_hash(known.where("y = 0"), documents, 3)),
                     "quality-sample")
    texts = written(sampled_texts(docs, sample, id_col, text_col)
                    .withColumn("n", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))), "quality-texts")
    count = F.greatest(F.lit(1), F.ceil(F.col("n") / PASSAGE_WORDS))
    size = texts.groupBy("doc_id", "y").agg(F.sum(count).cast("long").alias("passages")).orderBy(
        F.xxhash64(F.lit(3), "doc_id"), "doc_id").toPandas()
    total = known.agg(F.avg("y").alias("y")).first()["y"]
    share = {v: (size.y == v).mean() for v in (0, 1)} if len(size) else {}
    keep = []
    for v in (0, 1):  # each label its share of the passages
        mine = size[size.y == v]
        keep += list(mine.doc_id[(mine.passages.cumsum() <= passages * max(share[v], 0.2)) |
                                 (np.arange(len(mine)) == 0)]) if len(mine) else []
    if len(size) == 0 or size.y.nunique() < 2:
        p = min(max(0.5 if total is None else total, 0.01), 0.99)
        empty = np.zeros((WIDTH, 1), np.float32)
        return QualityModel({"embed": empty, "embed_bias": np.zeros(1, np.float32), "tanh": np.zeros((1, 1), np.float32),
                             "gate": np.zeros((1, 1), np.float32), "attend": np.zeros(1, np.float32),
                             "out": np.zeros(1, np.float32), "out_bias": np.array(np.log(p / (1 - p)), np.float32)})
    chosen = docs.sparkSession.createDataFrame([(x,) for x in keep], texts.select("doc_id").schema)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text.returned(batches):
            for i, j, x, row in encode(batch.column(1)):
                at = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=j - i))])
                own = batch.column(0).slice(i, j - i)
                for k in range(j - i):
                    packed = zlib.compress(x[at[k]:at[k + 1]].astype("<f2").tobytes(), 1)
                    yield pa.RecordBatch.from_arrays([own.slice(k, 1), pa.array([at[k + 1] - at[k]], pa.int32()), pa.array([packed])],
                                                     ["y", "n", "x"])

    got = (texts.join(F.broadcast(chosen), "doc_id", "left_semi").orderBy("doc_id", "text").select("y", "text")
                .mapInArrow(vectors, "y int, n int, x binary").toPandas())
    y, row, x = got.y.to_numpy().astype(np.float32), np.repeat(np.arange(len(got)), got.n), unpacked(got)
    del got
    pa.default_memory_pool().release_unused()
    text.give_back()
    model = QualityModel(fit(x, row, y))
    del x
    text.give_back()
    return model


def unpacked(packed: pd.DataFrame) -> np.ndarray:
    """The passages' vectors of documents with ``n`` passages and their packed vectors ``x``, in 16 bits: the driver holds no
    second copy of them."""
    end = np.cumsum(packed.n)
    out = np.empty((int(end.iloc[-1]), WIDTH), "<f2")
    for x, n, stop in zip(packed.x, packed.n, end):
        out[stop - n:stop] = np.frombuffer(zlib.decompress(x), "<f2").reshape(n, WIDTH)
    return out


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (1 if ``score >=
    threshold``). A null, empty or wordless text is one passage of zeros. Repeated rows get equal scores; a null id is
    not held out; columns of the new names are replaced. No rows, no rows."""
    own = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    place = own.index(text_col)

    weights = {k: v.astype(np.float64) for k, v in model.weights.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text.returned(batches):
            out = np.zeros(batch.num_rows)
            for i, j, x, row in encode(batch.column(place)):
                p = _forward(weights, x.astype(np.float64), row, np.searchsorted(row, np.arange(j - i)))["p"]
                out[i:j] = np.round(p, 12)  # whatever the rows of the batch are
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*own, "score"])

    frame = docs.select(own)
    out = frame.mapInArrow(run, StructType([*frame.schema.fields, StructField("score", DoubleType())]))
    return out.withColumn("held_out", held_out(id_col)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
