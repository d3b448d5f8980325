"""Profiles and statistics.

Many columns are handled at once by unpivoting to a long ``(variable, value)`` frame:
one aggregate per statistic family instead of one job per column.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from ratelens.operators.scans import exact_quantiles, join_keys
from ratelens.sources.tables import temporary


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns by schema type."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def long_values(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., variable, value double) with nulls dropped."""
    cols = [F.col(c).cast("double").alias(c) for c in columns]
    long = df.select(*by, *cols).unpivot(list(by), list(columns), "variable", "value")
    return long.where(F.col("value").isNotNull())


def profile(df: DataFrame) -> DataFrame:
    """(column, dtype, non_null, nulls) for every column; one aggregate."""
    fields = df.schema.fields
    row = df.agg(*[F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"),
                            F.count(F.col(f.name)).alias("non_null"),
                            F.count_if(F.col(f.name).isNull()).alias("nulls")).alias(f"_{i}")
                   for i, f in enumerate(fields)])
    return row.select(F.explode(F.array(*[F.col(f"_{i}") for i in range(len(fields))])).alias("s")).select("s.*")


def describe(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, sample std, min, 25/50/75 % (linear), max per column
    (and per ``by`` group), in long form. Quantiles are exact (scans.exact_quantiles)."""
    keys = [*by, "variable"]
    # the basics in one wide aggregate, one struct a column; only quantiles need the long form
    values = [F.col(c).cast("double") for c in columns]
    wide = df.groupBy(*by).agg(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.count(v).alias("count"), F.avg(v).alias("mean"),
                 F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
        for c, v in zip(columns, values)]).alias("_s"))
    basic = wide.select(*by, F.inline("_s")).where(F.col("count") > 0)
    q = exact_quantiles(long_values(df, columns, by), "value", [0.25, 0.5, 0.75], keys)
    qw = q.groupBy(*keys).agg(*[F.max(F.when(F.col("pi") == i, F.col("value"))).alias(n)
                                for i, n in enumerate(("q25", "q50", "q75"))])
    return join_keys(basic, qw, keys).select(*keys, "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def _q(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def _pair_r(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """One-row frame with Pearson r of each pair (column ``_k`` for the k-th pair).

    Two passes: column means and null counts (one aggregate, k numbers to the driver),
    then sums of products of centred values (one aggregate of plain sums). With nulls,
    each pair uses its pairwise-complete rows. Constant columns give null. The wide
    expressions are handed to Spark as SQL text in one call (no per-expression round trips)."""
    cols = sorted({c for p in pairs for c in p})
    first = df.selectExpr(*[f"avg(CAST({_q(c)} AS DOUBLE)) AS m_{i}" for i, c in enumerate(cols)],
                          *[f"count_if({_q(c)} IS NULL) AS z_{i}" for i, c in enumerate(cols)]).first()
    means = {c: (first[f"m_{i}"] or 0.0) for i, c in enumerate(cols)}
    complete = all(first[f"z_{i}"] == 0 for i in range(len(cols)))
    xc = {c: f"(CAST({_q(c)} AS DOUBLE) - CAST({means[c]!r} AS DOUBLE))" for c in cols}
    aggs, exprs = [], []
    if complete:
        idx = {c: i for i, c in enumerate(cols)}
        aggs.append("count(1) AS n")
        for i, c in enumerate(cols):
            aggs += [f"sum({xc[c]}) AS s_{i}", f"sum({xc[c]} * {xc[c]}) AS q_{i}"]
        for k, (a, b) in enumerate(pairs):
            aggs.append(f"sum({xc[a]} * {xc[b]}) AS p_{k}")
            ia, ib = idx[a], idx[b]
            cov = f"(p_{k} - s_{ia} * s_{ib} / n)"
            den = f"((q_{ia} - s_{ia} * s_{ia} / n) * (q_{ib} - s_{ib} * s_{ib} / n))"
            exprs.append((k, cov, den))
    else:
        for k, (a, b) in enumerate(pairs):
            both = f"({_q(a)} IS NOT NULL AND {_q(b)} IS NOT NULL)"
            xa, xb = f"(CASE WHEN {both} THEN {xc[a]} END)", f"(CASE WHEN {both} THEN {xc[b]} END)"
            aggs += [f"count_if({both}) AS n_{k}", f"sum({xa}) AS sa_{k}", f"sum({xb}) AS sb_{k}",
                     f"sum({xa} * {xb}) AS p_{k}", f"sum({xa} * {xa}) AS qa_{k}", f"sum({xb} * {xb}) AS qb_{k}"]
            cov = f"(p_{k} - sa_{k} * sb_{k} / n_{k})"
            den = f"((qa_{k} - sa_{k} * sa_{k} / n_{k}) * (qb_{k} - sb_{k} * sb_{k} / n_{k}))"
            exprs.append((k, cov, den))
    row = df.selectExpr(*aggs)
    return row.selectExpr(*[f"CASE WHEN {den} > 0 THEN {cov} / sqrt({den}) END AS _{k}"
                            for k, cov, den in exprs])


def corr_long(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson r for every ordered pair (c1, c2) of the given (P2: by default all numeric)
    columns over the rows in which both are present, null where a column is constant or no such row is left.

    Two passes: one aggregate gives means, bounds and null counts (four numbers a column to the driver), then the masked Gram
    matrix of one vector a row gives the sums of all pairs at once (``_masked_sums``). Work and state grow with the
    squared number of columns in plain arrays, not in generated expressions, so hundreds of columns are one job. NaN
    counts as missing. ``F.corr`` is avoided because it raises on zero variance under ANSI mode."""
    columns = list(columns if columns is not None else numeric_columns(df))
    k, spark = len(columns), df.sparkSession
    schema = "c1 string, c2 string, i int, j int, r double"
    if not k:
        return spark.createDataFrame([], schema)
    x = df.select(*[F.nanvl(F.col(_q(c)).cast("double"), F.lit(None)).alias(f"x{i}") for i, c in enumerate(columns)])
    first = x.agg(F.count(F.lit(1)).alias("rows"), *[
        f(f"x{i}").alias(f"{n}{i}") for i in range(k)
        for n, f in (("mean", F.avg), ("count", F.count), ("lo", F.min), ("hi", F.max))]).first()
    means = [first[f"mean{i}"] or 0.0 for i in range(k)]
    gaps = [i for i in range(k) if first[f"count{i}"] < first["rows"]]
    n, s, q, p = _masked_sums(x, means, gaps)
    with np.errstate(divide="ignore", invalid="ignore"):
        cov = p - s * s.T / n
        var = q - s * s / n
        den = var * var.T
        r = np.where(den > 0, cov / np.sqrt(den), np.nan)
    flat = np.array([first[f"lo{i}"] == first[f"hi{i}"] for i in range(k)])
    r[flat, :] = r[:, flat] = np.nan
    i, j = (a.ravel() for a in np.indices((k, k)))
    names = np.array(columns, object)
    return spark.createDataFrame(pa.table({
        "c1": pa.array(names[i], pa.string()), "c2": pa.array(names[j], pa.string()), "i": pa.array(i, pa.int32()),
        "j": pa.array(j, pa.int32()), "r": pa.array(r.ravel(), pa.float64(), mask=np.isnan(r.ravel()))}), schema)


def _masked_sums(x: DataFrame, means: Sequence[float], gaps: Sequence[int]) -> tuple[np.ndarray, ...]:
    """Over the rows in which columns a and b of ``x`` are both present, as k x k matrices at ``[a, b]``: rows, sum of a, sum of
    a squared, and sum of a times b (values less ``means``).

    With m = 1 where a value is present and x = 0 where it isn't, these are m.m, x.m, x^2.m and x.x: blocks of the Gram matrix of
    the row vector (1, x, m, x^2), which the JVM adds up along a tree of partial sums. Columns without nulls (not in ``gaps``)
    share the 1 as their m, and x^2 is needed only if there are gaps."""
    k = len(means)
    centred = [F.coalesce(F.col(f"x{i}") - F.lit(m), F.lit(0.0)) for i, m in enumerate(means)]
    parts = [F.lit(1.0), *centred, *[F.col(f"x{i}").isNotNull().cast("double") for i in gaps]]
    if gaps:
        parts += [c * c for c in centred]
    rows = MLUtils.convertVectorColumnsFromML(x.select(array_to_vector(F.array(*parts)).alias("v")), "v")
    if rows.isEmpty():
        return tuple(np.zeros((k, k)) for _ in range(4))
    g = RowMatrix(rows, numCols=len(parts)).computeGramianMatrix().toArray()
    at = np.arange(1, k + 1)
    m = np.zeros(k, int)
    m[list(gaps)] = 1 + k + np.arange(len(gaps))
    square = 1 + k + len(gaps) + np.arange(k)
    q = g[np.ix_(square, m)] if gaps else np.repeat(g[at, at][:, None], k, 1)
    return g[np.ix_(m, m)], g[np.ix_(at, m)], q, g[np.ix_(at, at)]


def corr_lower(corr: DataFrame) -> DataFrame:
    """Strictly lower triangle (row index > column index)."""
    return corr.where(F.col("i") > F.col("j"))


def top_corr(corr: DataFrame, columns: Sequence[str], k: int = 5) -> DataFrame:
    """For each column, the k others with the largest |r| (itself excluded by name).
    The window runs over the pair table (columns^2 rows), not over data rows."""
    w = W.partitionBy("c1").orderBy(F.desc_nulls_last(F.abs("r")), "c2")
    return (corr.where(F.col("c1").isin(list(columns)) & (F.col("c1") != F.col("c2")))
            .select("c1", "c2", "r", F.abs("r").alias("abs_r"), F.row_number().over(w).alias("rank"))
            .where(F.col("rank") <= k))


def outcome_corr(df: DataFrame, y: str, columns: Sequence[str], k: int = 15) -> DataFrame:
    """C4: r of each numeric column with the outcome, top k by |r| (outcome itself excluded)."""
    cols = [c for c in columns if c != y]
    corr = corr_with(df, y, cols)
    return corr.orderBy(F.desc_nulls_last("abs_r"), "variable").limit(k)


def corr_with(df: DataFrame, y: str, columns: Sequence[str]) -> DataFrame:
    """(variable, r, abs_r) of each column with ``y``."""
    row = _pair_r(df, [(c, y) for c in columns])
    structs = [f"named_struct('variable', '{c}', 'r', _{k}, 'abs_r', abs(_{k}))" for k, c in enumerate(columns)]
    return row.selectExpr(f"inline(array({', '.join(structs)}))")


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact linear-interpolated quantiles: (by..., variable, p, value)."""
    long = long_values(df, columns, by)
    q = exact_quantiles(long, "value", probs, [*by, "variable"])
    return q.select(*by, "variable", "p", F.col("value").alias("value"))


def histogram(df: DataFrame, x: str, bins: int = 30) -> DataFrame:
    """K equal-width bins over [min, max] (last bin closed), dense: empty bins give 0.
    The two bounds are a one-row lookup; the counting is one aggregate."""
    lo, hi = df.agg(F.min(x).cast("double"), F.max(x).cast("double")).first()
    spark = df.sparkSession
    if lo is None:
        return spark.createDataFrame([], "bin int, left double, right double, count bigint")
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    idx = F.least(F.floor((F.col(x).cast("double") - F.lit(lo)) * F.lit(float(bins)) / F.lit(hi - lo)),
                  F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(x).isNotNull()).groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    frame = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    width = (hi - lo)
    return (F.broadcast(frame).join(counts, "bin", "left")
            .select("bin",
                    (F.lit(lo) + F.col("bin") * F.lit(width) / F.lit(float(bins))).alias("left"),
                    (F.lit(lo) + (F.col("bin") + 1) * F.lit(width) / F.lit(float(bins))).alias("right"),
                    F.coalesce("count", F.lit(0)).cast("bigint").alias("count")))


def box_stats(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), whis: float = 1.5) -> DataFrame:
    """Quartiles, whiskers at the furthest observed point within ``whis`` IQR of the
    box, and the count of points outside the whiskers, per column (and group)."""
    long = long_values(df, columns, by)
    keys = [*by, "variable"]
    q = exact_quantiles(long, "value", [0.25, 0.5, 0.75], keys)
    qw = q.groupBy(*keys).agg(*[F.max(F.when(F.col("pi") == i, F.col("value"))).alias(n)
                                for i, n in enumerate(("q1", "median", "q3"))])
    iqr = F.col("q3") - F.col("q1")
    lo_f, hi_f = F.col("q1") - whis * iqr, F.col("q3") + whis * iqr
    v = F.col("value")
    # one row per (group, column), written first so that its size is known: the values aren't shuffled by column
    stats = (join_keys(long, temporary(qw, "fences"), keys)
             .groupBy(*keys, "q1", "median", "q3")
             .agg(F.min(F.when(v >= lo_f, v)).alias("whisker_lo"), F.max(F.when(v <= hi_f, v)).alias("whisker_hi"),
                  F.count_if((v < lo_f) | (v > hi_f)).alias("outliers"), F.count(v).alias("count")))
    # no observed point between fence and box: the whisker ends at the quartile
    return stats.select(*keys, "q1", "median", "q3", (F.col("q3") - F.col("q1")).alias("iqr"),
                        F.least("whisker_lo", "q1").alias("whisker_lo"),
                        F.greatest("whisker_hi", "q3").alias("whisker_hi"), "outliers", "count")


def standardize_stats(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """C8 fit: mean and population std per column (one aggregate; 2 numbers per column)."""
    row = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns)],
                 *[F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    out = {}
    for i, c in enumerate(columns):
        m, s = row[f"m{i}"], row[f"s{i}"]
        out[c] = (m if m is not None else 0.0, s if s else 1.0)
    return out


def standardize(df: DataFrame, columns: Sequence[str], stats: dict[str, tuple[float, float]] | None = None,
                digits: int | None = None) -> DataFrame:
    """C8 transform: (x - mean) / std with population std; std 0 divides by 1."""
    stats = stats or standardize_stats(df, columns)
    exprs = {}
    for c in columns:
        m, s = stats[c]
        e = (F.col(c).cast("double") - F.lit(m)) / F.lit(s)
        exprs[c] = F.round(e, digits) if digits is not None else e
    return df.withColumns(exprs)
