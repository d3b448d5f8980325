"""Labels, folds and bounded samples for the classifiers of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document's label may not be learned from: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def training_labels(labels: DataFrame, label_col: str, id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, y)``, one row for each labelled id that may be learned from; of contradicting labels the larger holds."""
    return (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col))
                  .groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("y")))


def first_by_hash(ids: DataFrame, n: int, seed: int) -> DataFrame:
    """The ``n`` rows of ``ids(doc_id, ...)`` of least seeded hash: a fixed random sample of bounded size."""
    return ids.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(n)


def sampled_texts(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, y, text)`` of the sampled ids, a sample whose stated bound allows the broadcast. Of rows that repeat an id
    all are kept."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return d.join(F.broadcast(sample), "doc_id").select("doc_id", "y", "text")
