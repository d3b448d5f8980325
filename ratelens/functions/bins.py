"""Bin expressions (B1-B4). Edges are a handful of driver-side numbers; the
assignment itself is a CASE expression inside whole-stage codegen."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _in_bin(x: Column, lo: float, hi: float, right: bool, first: bool, include_lowest: bool) -> Column:
    if right:
        low_ok = (x >= F.lit(lo)) if (first and include_lowest) else (x > F.lit(lo))
        return low_ok & (x <= F.lit(hi))
    return (x >= F.lit(lo)) & (x < F.lit(hi))


def cut_index_expr(x, edges: Sequence[float], right: bool = True, include_lowest: bool = False) -> Column:
    """0-based bin index of ``x`` for edges e0 < e1 < ... ; outside (or null) -> null.

    ``right=True`` gives ``(a, b]`` bins as pandas ``cut`` does (not ``Bucketizer``,
    which is left-closed)."""
    x = _c(x)
    expr = None
    for i in range(len(edges) - 1):
        cond = _in_bin(x, edges[i], edges[i + 1], right, i == 0, include_lowest)
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr


def cut_expr(x, edges: Sequence[float], labels: Sequence[str], right: bool = True,
             include_lowest: bool = False) -> Column:
    """Label of the bin of ``x`` (null when outside every bin)."""
    if len(labels) != len(edges) - 1:
        raise ValueError("need one label per bin")
    x = _c(x)
    expr = None
    for i, label in enumerate(labels):
        cond = _in_bin(x, edges[i], edges[i + 1], right, i == 0, include_lowest)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def equal_width_edges(lo: float, hi: float, k: int) -> list[float]:
    """k equal-width bins over [lo, hi]; the first edge is lowered by 0.1 % of the range
    so the minimum falls in the first right-closed bin (a constant column widens by 0.1 %)."""
    if lo == hi:
        adj = 0.001 * abs(lo) if lo != 0 else 0.001
        return [float(v) for v in np.linspace(lo - adj, hi + adj, k + 1)]
    edges = np.linspace(lo, hi, k + 1)
    edges[0] -= (hi - lo) * 0.001
    return [float(v) for v in edges]


def interval_breaks(edges: Sequence[float], precision: int = 0) -> list[float]:
    """Displayed interval breaks: the edges rounded half-even to the fewest decimals, ``precision`` or more,
    that keep distinct edges distinct."""
    for digits in range(precision, 18):
        shown = [float(round(e, digits)) for e in edges]
        if len(set(shown)) == len(set(edges)):
            return shown
    return [float(e) for e in edges]


def money_label(left: float | None, right: float | None) -> str:
    """``$4K-8K`` from an interval (truncating thousands); missing -> ``N/A``."""
    if left is None or right is None or (isinstance(left, float) and math.isnan(left)):
        return "N/A"
    return f"${int(left / 1000)}K-{int(right / 1000)}K"
