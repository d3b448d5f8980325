"""Outcome rates, counts, contingency tables and pivots.

Every aggregate here is a single ``groupBy``: Spark combines map-side before the
shuffle, so a hot key costs one partial row per task, never a hot reducer.
Null group keys are dropped, as pandas ``groupby`` / ``value_counts`` / ``crosstab`` do.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _not_null(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return df if cond is None else df.where(cond)


def rate_aggs(y: str = "y", with_sum: bool = True, names: Sequence[str] = ("total", "positives", "rate")) -> list[Column]:
    """count / sum / mean of a 0-1 outcome; the mean is null for an empty group."""
    total, positives, rate = names
    aggs = [F.count(F.col(y)).alias(total)]
    if with_sum:
        aggs.append(F.coalesce(F.sum(F.col(y)), F.lit(0)).cast("bigint").alias(positives))
    aggs.append(F.avg(F.col(y).cast("double")).alias(rate))
    return aggs


def outcome_rate(df: DataFrame, keys: Sequence[str], y: str = "y", with_sum: bool = True,
                 min_count: int | None = None, names: Sequence[str] = ("total", "positives", "rate")) -> DataFrame:
    """A1/A2: count, positives and rate of ``y`` by keys; ``min_count`` is the HAVING filter."""
    out = _not_null(df, keys).groupBy(*keys).agg(*rate_aggs(y, with_sum, names))
    if min_count is not None:
        out = out.where(F.col(names[0]) >= min_count)
    return out


def dense_rates(df: DataFrame, label_col: str, labels: Sequence[str], y: str = "y", with_sum: bool = True,
                names: Sequence[str] = ("total", "positives", "rate")) -> DataFrame:
    """Rates by a label column, one row per label in ``labels`` even when empty.

    The label list is a bounded driver-side list, so it is broadcast; the counts are
    aggregated first, then the few label rows are joined to them."""
    spark = df.sparkSession
    frame = spark.createDataFrame([(i, lab) for i, lab in enumerate(labels)], f"bin int, {label_col} string")
    agg = outcome_rate(df, [label_col], y, with_sum, names=names)
    out = F.broadcast(frame).join(agg, label_col, "left")
    fills = [F.coalesce(F.col(names[0]), F.lit(0)).cast("bigint").alias(names[0])]
    if with_sum:
        fills.append(F.coalesce(F.col(names[1]), F.lit(0)).cast("bigint").alias(names[1]))
    return out.select("bin", label_col, *fills, F.col(names[2]))


def mean_by(df: DataFrame, key: str, x: str, name: str | None = None) -> DataFrame:
    """A3: mean of ``x`` by ``key``."""
    return _not_null(df, [key]).groupBy(key).agg(F.avg(x).alias(name or f"mean_{x}"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """A4: counts per non-null value, most frequent first (the sort runs on the
    aggregated rows, one per value)."""
    return (_not_null(df, [col]).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.asc(col)))


def category_share(df: DataFrame, col: str) -> DataFrame:
    """A5: count and % share per category; the total is one number, counted first."""
    counts = value_counts(df, col)
    total = _not_null(df, [col]).count()
    return counts.select(col, "count", (F.col("count") * 100.0 / F.lit(total)).alias("share_pct"))


def crosstab_counts(df: DataFrame, a: str, b: str, values: Sequence[str]) -> DataFrame:
    """Contingency counts, one column per value of ``b`` (explicit list, 0 when absent)."""
    return (_not_null(df, [a, b]).groupBy(a)
            .agg(*[F.count_if(F.col(b) == F.lit(v)).alias(str(v)) for v in values]))


def crosstab_pct(df: DataFrame, a: str, b: str, values: Sequence[str]) -> DataFrame:
    """Row-normalised % per value of ``b``; a value never seen in a row gives 0.0."""
    n = F.count(F.lit(1))
    return (_not_null(df, [a, b]).groupBy(a)
            .agg(*[(F.count_if(F.col(b) == F.lit(v)) * 100.0 / n).alias(str(v)) for v in values]))


def pivot_mean(df: DataFrame, index: str, columns: str, values: str, column_values: Sequence) -> DataFrame:
    """A10: mean of ``values`` for each (index, column value); absent cells are null.
    Written as conditional aggregation over an explicit value list (one pass, no extra job)."""
    return (_not_null(df, [index, columns]).groupBy(index)
            .agg(*[F.avg(F.when(F.col(columns) == F.lit(v), F.col(values).cast("double"))).alias(str(v))
                   for v in column_values]))


def unpivot_categories(df: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(keep..., variable, category) for every categorical column: one Expand, no rescans."""
    return df.unpivot(list(keep), list(columns), "variable", "category")


def all_variables(df: DataFrame, columns: Sequence[str], outcome: str, positive: str,
                  min_count: int = 5) -> DataFrame:
    """(variable, category, rate_pct, count) over all categorical columns in one aggregate."""
    long = unpivot_categories(df.select(outcome, *columns), columns, [outcome]).where(F.col("category").isNotNull())
    pos = F.count_if(F.col(outcome) == F.lit(positive))
    return (long.groupBy("variable", "category")
            .agg(F.coalesce(pos * 100.0 / F.count(F.col(outcome)), F.lit(0.0))
                 .alias("rate_pct"), F.count(F.lit(1)).alias("count"))
            .where(F.col("count") >= min_count)
            .orderBy(F.desc_nulls_last("rate_pct"), "variable", "category"))


def top_k(df: DataFrame, k: int, order: Sequence[Column]) -> DataFrame:
    """O1+O3: sort (nulls last, keys break ties) and keep k rows: planned as a
    distributed take-ordered (each task keeps k, the driver merges k per task)."""
    return df.orderBy(*order).limit(k)


def class_balance(df: DataFrame, y: str = "y") -> DataFrame:
    """Rows per class."""
    return df.groupBy(y).agg(F.count(F.lit(1)).alias("count"))


def kpis(df: DataFrame, y: str, means: dict[str, str]) -> DataFrame:
    """Size, positives, rate % and means in one pass; empty input gives nulls."""
    return df.agg(F.count(F.lit(1)).alias("total"),
                  F.sum(F.col(y)).cast("bigint").alias("positives"),
                  (F.avg(F.col(y).cast("double")) * 100).alias("rate_pct"),
                  *[F.avg(c).alias(name) for name, c in means.items()])
