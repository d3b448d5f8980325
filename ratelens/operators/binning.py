"""Binning operators (B1-B4) at DataFrame level.

Edges are few numbers: fixed lists, or derived from the data by one small lookup
(min/max, or k+1 exact quantiles). Rows are assigned by a CASE expression and the
counts come from one aggregate; empty bins are kept (dense labels).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelens.functions.bins import cut_expr, equal_width_edges, interval_breaks, money_label
from ratelens.operators.rates import dense_rates
from ratelens.operators.scans import exact_quantiles


def cut_fixed(df: DataFrame, x, edges: Sequence[float], labels: Sequence[str], y: str = "y",
              label_col: str = "band", with_sum: bool = True, include_lowest: bool = False,
              names: Sequence[str] = ("total", "positives", "rate")) -> DataFrame:
    """B1: rates by right-closed fixed bins; rows outside every bin are left out,
    labels with no rows are kept with count 0."""
    banded = df.select(cut_expr(x, edges, labels, include_lowest=include_lowest).alias(label_col), F.col(y))
    return dense_rates(banded, label_col, labels, y, with_sum, names)


def equal_width(df: DataFrame, x: str, k: int) -> list[float]:
    """B2 edges: one aggregate for (min, max), then k equal bins (first edge lowered)."""
    lo, hi = df.agg(F.min(x).cast("double"), F.max(x).cast("double")).first()
    if lo is None:
        return []
    return equal_width_edges(lo, hi, k)


def interval_frame(df: DataFrame, edges: Sequence[float], precision: int = 0) -> DataFrame:
    """(bin, left, right, label) with displayed (rounded) breaks and ``$aK-bK`` labels."""
    br = interval_breaks(edges, precision)
    rows = [(i, float(br[i]), float(br[i + 1]), money_label(br[i], br[i + 1])) for i in range(len(edges) - 1)]
    return df.sparkSession.createDataFrame(rows, "bin int, left double, right double, label string")


def cut_equal(df: DataFrame, x: str, k: int = 5, y: str = "y", edges_from: DataFrame | None = None,
              precision: int = 0) -> DataFrame:
    """B2+B4: rates by k equal-width right-closed bins, labelled ``$aK-bK``. Edges come
    from ``edges_from`` (e.g. the unfiltered table) or from ``df`` itself; no values, no bins."""
    edges = equal_width(edges_from if edges_from is not None else df, x, k)
    if not edges:
        return df.sparkSession.createDataFrame([], "bin int, left double, right double, label string, total bigint, "
                                                   "positives bigint, rate double")
    frame = interval_frame(df, edges, precision)
    bin_ids = [str(i) for i in range(len(edges) - 1)]
    rates = cut_fixed(df, x, edges, bin_ids, y, label_col="_bin")
    return (rates.join(F.broadcast(frame), "bin")
            .select("bin", "left", "right", "label", "total", "positives", "rate"))


def quantile_edges(df: DataFrame, x: str, k: int) -> list[float]:
    """B3 edges: exact quantiles at 0, 1/k, ..., 1; equal edges are merged."""
    return quantile_edges_many(df, [x], k)[x]


def quantile_edges_many(df: DataFrame, columns, k: int) -> dict[str, list[float]]:
    """B3 edges of several columns from one job ((k+1) numbers per column to the driver)."""
    from ratelens.operators.stats import long_values
    q = exact_quantiles(long_values(df, columns), "value", [i / k for i in range(k + 1)], ["variable"]) \
        .orderBy("variable", "pi").collect()
    out: dict[str, list[float]] = {c: [] for c in columns}
    for r in q:
        edges = out[r.variable]
        if not edges or r.value > edges[-1]:
            edges.append(float(r.value))
    return out


def quantile_label_expr(x, edges: Sequence[float], prefix: str = "Q"):
    """B3 assignment: labels Q1..Qm, the first bin includes the minimum."""
    if len(edges) < 2:
        return F.when(F.col(x).isNotNull(), F.lit(f"{prefix}1")), [f"{prefix}1"]
    labels = [f"{prefix}{i + 1}" for i in range(len(edges) - 1)]
    return cut_expr(x, edges, labels, include_lowest=True), labels


def cut_quantile(df: DataFrame, x: str, k: int = 4, y: str = "y", label_col: str = "quartile") -> DataFrame:
    """Rates by k quantile bins."""
    edges = quantile_edges(df, x, k)
    expr, labels = quantile_label_expr(x, edges)
    banded = df.select(expr.alias(label_col), F.col(y))
    return dense_rates(banded, label_col, labels, y)
