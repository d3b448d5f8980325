"""Model data operators: encodings and class weights (M1, M2, M5; C8 lives in ``stats``)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import StringIndexer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def label_indexer(columns: Sequence[str], suffix: str = "_code") -> StringIndexer:
    """M1: alphabetical codes 0..k-1 per column; a value unseen at fit time gets its own
    extra code k (``handleInvalid="keep"``) rather than colliding with code 0."""
    return StringIndexer(inputCols=list(columns), outputCols=[f"{c}{suffix}" for c in columns],
                         stringOrderType="alphabetAsc", handleInvalid="keep")


def label_encode(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None,
                 suffix: str = "_code", unseen: str = "own") -> DataFrame:
    """M1: fit on ``fit_on`` (default: ``df``), add integer code columns. Values unseen at fit time, and nulls, get
    a code of their own (``unseen="own"``) or code 0 (``unseen="zero"``)."""
    model = label_indexer(columns, suffix).fit(fit_on if fit_on is not None else df)
    out = model.transform(df)
    codes = {}
    for c, labels in zip(columns, model.labelsArray):
        code = F.col(f"{c}{suffix}").cast("int")
        codes[f"{c}{suffix}"] = F.when(code >= len(labels), 0).otherwise(code) if unseen == "zero" else code
    return out.withColumns(codes)


@dataclass
class TargetEncoding:
    """M2 fitted state: per (variable, category) smoothed means and the global mean."""
    table: DataFrame          # (variable, category, count, encoding)
    global_mean: float
    columns: tuple[str, ...]

    def transform(self, df: DataFrame, suffix: str = "_te") -> DataFrame:
        """Left lookup per column; unseen or filtered categories get the global mean.
        The table has one row per category: Spark/AQE broadcast it by measured size."""
        out = df
        for c in self.columns:
            enc = (self.table.where(F.col("variable") == c)
                   .select(F.col("category").alias(c), F.col("encoding").alias(f"{c}{suffix}")))
            out = out.join(enc, c, "left").withColumn(
                f"{c}{suffix}", F.coalesce(F.col(f"{c}{suffix}"), F.lit(self.global_mean)))
        return out


def fit_target_encoding(df: DataFrame, columns: Sequence[str], y: str, smoothing: float = 1.0,
                        min_samples_leaf: int = 1, materialize: bool = True) -> TargetEncoding:
    """M2 fit: ``(n * mean + s * global) / (n + s)`` per category, kept when n >= min_leaf.
    All columns are counted in one aggregate over the unpivoted (variable, category) pairs."""
    # one aggregate: every (variable, category), plus a pseudo-variable holding all rows,
    # whose single category gives the global mean
    all_rows = "__all__"
    long = df.select(F.col(y).cast("double").alias("_y"), F.lit("*").alias(all_rows),
                     *[F.col(c).cast("string").alias(c) for c in columns]) \
        .unpivot(["_y"], [all_rows, *columns], "variable", "category").where(F.col("category").isNotNull())
    stats = long.groupBy("variable", "category").agg(F.count("_y").alias("count"), F.avg("_y").alias("mean"))
    if materialize:
        # the fitted state is written once (shared checkpoint folder) and read by every lookup
        from ratelens.sources.tables import temporary
        stats = temporary(stats, "target_encoding")
    g_row = stats.where(F.col("variable") == all_rows).select("mean").first()
    g = 0.0 if g_row is None or g_row[0] is None else float(g_row[0])
    enc = ((F.col("count") * F.col("mean") + F.lit(smoothing) * F.lit(g)) / (F.col("count") + F.lit(smoothing)))
    table = stats.where((F.col("variable") != all_rows) & (F.col("count") >= min_samples_leaf)) \
        .select("variable", "category", "count", enc.alias("encoding"))
    return TargetEncoding(table, g, tuple(columns))


def class_weight(df: DataFrame, y: str = "y") -> DataFrame:
    """M5: (n_neg, n_pos, weight = n_neg / n_pos) in one aggregate."""
    n_pos = F.count_if(F.col(y) == 1)
    n_neg = F.count_if(F.col(y) == 0)
    return df.agg(n_neg.alias("n_neg"), n_pos.alias("n_pos"),
                  F.try_divide(n_neg.cast("double"), n_pos).alias("weight"))


def weight_column(y: str, positive_weight: float) -> Column:
    """Row weight: ``positive_weight`` for positives, 1 otherwise (``weightCol``)."""
    return F.when(F.col(y) == 1, F.lit(float(positive_weight))).otherwise(F.lit(1.0))
