"""Operator 3: toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; a sample of all documents, whatever they are, the unlabelled. Word and word-beginning
hashes that positives hold more often (once, or three times and more) than unlabelled text are the features. Linear classifiers are
trained in numpy on the non-negative risk with class prior p:

    p E+[l(f)] + max(0, Eu[l(-f)] - p E+[l(-f)])

When the second term falls under -beta, a step goes against its gradient instead. The score is the mean
probability of a few classifiers trained on resampled unlabelled texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelens.llm import text
from ratelens.llm.common import written
from ratelens.llm.labelled import first_by_hash, held_out, sampled_texts, training_labels

#: Bounds of the training sample, the features and the classifiers.
POSITIVES, UNLABELLED, FEATURES, MODELS = 4000, 12000, 4000, 3
#: Prior if the labels hold positives alone.
PRIOR = 0.1
BEGINNINGS = (3, 4, 5, 6, 7, 8)
#: A feature's share among positives exceeds that among unlabelled texts by so many standard errors at least.
STANDARD_ERRORS = 6
OFTEN = 3


@dataclass(frozen=True)
class ToxicityModel:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray  # by model: for each hash held, for each held OFTEN times or more, and the constant
    prior: float


def _features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """By chunk of rows i..j: i, j and the rows (from 0) and hashes of its words and their beginnings."""
    data, at = text.utf8(column)
    for i, j in text.chunks(at):
        h, row, first, end = text.words(data, at, i, j)
        rows, hashes = [row], [h]
        for x, longer in text.beginnings(data, first, end, BEGINNINGS):
            rows.append(row[longer])
            hashes.append(x[longer])
        yield i, j, np.concatenate(rows), np.concatenate(hashes)


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        y = batch.column(0)
        for i, j, row, h in _features(batch.column(1)):
            order = np.lexsort((h, row))
            row, h = row[order], h[order]
            first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])])) if len(h) else row
            often = np.diff(np.append(first, len(h))) >= OFTEN
            yield pa.RecordBatch.from_arrays(
                [y.slice(i, j - i).take(pa.array(row[first])), pa.array(h[first].view(np.int64)),
                 pa.array(often.astype(np.int32))], ["y", "h", "often"])


def _held(features: np.ndarray, row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, column), by row, of the hashes that are features: one column for each held, one for each held often."""
    n = len(features)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = np.minimum(np.searchsorted(features, h), n - 1)
    hit = features[x] == h
    both, count = np.unique(row[hit] * n + x[hit], return_counts=True)
    more = both[count >= OFTEN]
    row, col = np.concatenate([both // n, more // n]), np.concatenate([both % n, n + more % n])
    order = np.argsort(row, kind="stable")
    return row[order], col[order]


def fit_nnpu(row: np.ndarray, col: np.ndarray, positive: np.ndarray, features: int, prior: float, seed: int,
             steps: int = 1000, rate: float = 0.05, ridge: float = 3e-4, beta: float = 0.0, gamma: float = 1.0) -> np.ndarray:
    """Weights of a linear classifier (the last: the constant) over the set features (row, col) of documents;
    ``positive`` marks the confirmed ones, all others are unlabelled."""
    rng = np.random.default_rng(seed)
    n = len(positive)
    chance = rng.poisson(1.0, n).astype(float) if seed else np.ones(n)  # resampled, the first as they are
    wp, wu = np.where(positive, chance, 0), np.where(positive, 0, chance)
    wp, wu = wp / max(wp.sum(), 1), wu / max(wu.sum(), 1)
    w = np.zeros(features + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        f = np.bincount(row, w[col], n) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(f, -30, 30)))  # slope of l(-f); l(f) has slope p - 1
        loss = np.logaddexp(0, f)  # l(-f)
        negative = (wu * loss).sum() - prior * (wp * loss).sum()
        if negative >= -beta:
            g = prior * wp * (p - 1) + wu * p - prior * wp * p
        else:
            g = -gamma * (wu * p - prior * wp * p)
        grad = np.append(np.bincount(col, g[row], features), g.sum()) + ridge * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        w = w - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-9)
    return w


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
          prior: float | None = None, positives: int = POSITIVES, unlabelled: int = UNLABELLED,
          features: int = FEATURES, models: int = MODELS) -> ToxicityModel:
    """A model from labelled positives and unlabelled texts outside the held-out third.

    The samples are bounded by ``positives`` and ``unlabelled`` documents. ``prior``: the share of positives; unset,
    their share among labelled rows, or PRIOR if no row is labelled 0. Without positives every score is the prior."""
    known = training_labels(labels, label_col)
    count = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("p")).first()
    if prior is None:
        prior = count["p"] / count["n"] if 0 < count["p"] < count["n"] else PRIOR
    if not count["p"]:
        return ToxicityModel(np.zeros(0, np.uint64), np.full((1, 1), np.log(prior / (1 - prior))), prior)
    pos = first_by_hash(known.where("y = 1").select("doc_id"), positives, 1).withColumn("y", F.lit(1))
    # unlabelled: drawn from all documents, the positives among them, as the prior is theirs
    rest = docs.select(F.col(id_col).alias("doc_id")).where(F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    sample = written(pos.union(first_by_hash(rest, unlabelled, 2).withColumn("y", F.lit(0)).select("doc_id", "y")),
                     "toxicity-sample")
    texts = written(sampled_texts(docs, sample, id_col, text_col), "toxicity-texts")
    size = {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    seen = texts.select("y", "text").mapInArrow(_distinct, "y int, h long, often int").groupBy("h").agg(
        *[F.sum(c).alias(n) for n, c in (("p", F.col("y")), ("u", 1 - F.col("y")), ("p_often", F.col("y") * F.col("often")),
                                         ("u_often", (1 - F.col("y")) * F.col("often")))])
    n_p, n_u = max(size.get(1, 0), 1), max(size.get(0, 0), 1)

    def excess(p: str, u: str):
        return (F.col(p) / n_p - F.col(u) / n_u) / F.sqrt((F.col(p) + F.col(u) + 1) / (n_p + n_u) / n_p)

    most = F.greatest(excess("p", "u"), excess("p_often", "u_often"))
    chosen = seen.where((F.col("p") >= 3) & (most >= STANDARD_ERRORS)).orderBy(most.desc(), "h").limit(features)
    hashes = np.sort(np.array([r["h"] for r in chosen.select("h").collect()], np.int64).view(np.uint64))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, row, h in _features(batch.column(1)):
                r, c = _held(hashes, row, h)
                at = np.concatenate([[0], np.cumsum(np.bincount(r, minlength=j - i))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(
                    pa.array(at), pa.array(c.astype(np.int32)))], ["y", "x"])

    got = texts.orderBy("doc_id", "text").select("y", "text").mapInArrow(held, "y int, x array<int>").toPandas()
    row = np.repeat(np.arange(len(got)), got.x.map(len))
    col = np.concatenate([np.asarray(x, np.int64) for x in got.x]) if len(row) else np.zeros(0, np.int64)
    weights = [fit_nnpu(row, col, got.y.to_numpy() == 1, 2 * len(hashes), prior, seed) for seed in range(models)]
    return ToxicityModel(hashes, np.array(weights), prior)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = 0.7) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` (0 to 1, higher: toxic likelier) and ``predicted`` (1 if ``score >=
    threshold``). Null, empty and wordless texts get the constant's score. Repeated rows get equal scores;
    a null id is not held out; columns of the new names are replaced. No rows, no rows."""
    own = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    place = own.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for i, j, row, h in _features(batch.column(place)):
                r, c = _held(model.features, row, h)
                f = np.array([np.bincount(r, w[c], j - i) + w[-1] for w in model.weights])
                out[i:j] = (1 / (1 + np.exp(-np.clip(f, -500, 500)))).mean(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*own, "score"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    frame = docs.select(own)
    out = frame.mapInArrow(run, StructType([*frame.schema.fields, StructField("score", DoubleType())]))
    return out.withColumn("held_out", held_out(id_col)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
