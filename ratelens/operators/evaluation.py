"""Evaluation of a scored table ``(row_id, y, score)``.

Curves are built on distinct scores with running positive / negative counts
(two-level prefix sums, see ``scans``); threshold grids bucket the score once and
need one aggregate of at most ``len(grid) + 1`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ratelens.functions.scalar import safe_ratio
from ratelens.operators.scans import cumulative, range_buckets

# fixed values: threshold grids (hundredths) of the sweep and of the F1 search
SWEEP_GRID = [(10 + 5 * i) / 100 for i in range(18)]      # 0.10 .. 0.95 step 0.05
F1_GRID = [(10 + 2 * i) / 100 for i in range(40)]         # 0.10 .. 0.88 step 0.02
# fixed values: verdict cut-offs
ROC_GOOD, ROC_FAIR, PR_GOOD, GAP_HIGH, GAP_MODERATE = 0.8, 0.7, 0.5, 0.15, 0.08


def score_counts(scored: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """Distinct scores with positives / negatives, running totals in descending score
    order (``cum_pos``, ``cum_neg``) and class totals ``P``, ``N``."""
    g = scored.where(F.col(score).isNotNull()).groupBy(score).agg(
        F.sum(F.col(y)).cast("bigint").alias("pos"), F.sum(1 - F.col(y)).cast("bigint").alias("neg"))
    bucketed = range_buckets(g, score, extra=[F.sum("pos").alias("P"), F.sum("neg").alias("N")])
    return cumulative(bucketed, [score], ["pos", "neg"], descending=True, bucketed=bucketed)


def roc_points(scored: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """E5 points: the start (0, 0) with a null threshold, then one per distinct score (threshold), fpr
    and tpr at ``score >= threshold``. No rows: the start alone."""
    c = score_counts(scored, y, score)
    start = scored.sparkSession.createDataFrame([(None, 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return start.unionByName(c.select(F.col(score).alias("threshold"),
                    safe_ratio("cum_neg", "N").alias("fpr"),
                    safe_ratio("cum_pos", "P").alias("tpr")))


def roc_corners(scored: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """E5 points without those that lie on the line between their neighbours with equal steps on both sides: after the start
    (0, 0), the first and the last score and every one whose positives or negatives differ from the next lower score's.

    The next score is found inside range buckets; a bucket's last score looks at the first of the next bucket that has any."""
    g = scored.where(F.col(score).isNotNull()).groupBy(score).agg(
        F.sum(F.col(y)).cast("bigint").alias("pos"), F.sum(1 - F.col(y)).cast("bigint").alias("neg"))
    bucketed = range_buckets(g, score, extra=[F.sum("pos").alias("P"), F.sum("neg").alias("N"), F.max(score).alias("_top")])
    step = F.struct("pos", "neg")
    heads = bucketed.groupBy("_bucket").agg(F.max_by(step, score).alias("_head"))
    heads = heads.select("_bucket", F.lag("_head").over(W.orderBy("_bucket")).alias("_after"))  # a row a bucket
    inside = W.partitionBy("_bucket").orderBy(F.desc(score))
    own = bucketed.withColumn("_next", F.lead(step).over(inside)).join(F.broadcast(heads), "_bucket")
    follows = F.coalesce("_next", "_after")
    own = own.withColumn("_corner", (F.col(score) == F.col("_top")) | follows.isNull() | (follows != step)).drop("_next", "_after")
    c = cumulative(own, [score], ["pos", "neg"], descending=True, bucketed=own).where("_corner")
    start = scored.sparkSession.createDataFrame([(None, 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return start.unionByName(c.select(F.col(score).alias("threshold"), safe_ratio("cum_neg", "N").alias("fpr"),
                                      safe_ratio("cum_pos", "P").alias("tpr")))


def pr_points(scored: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """E6 points: precision and recall at each distinct score threshold, and the end (recall 0, precision 1)
    with a null threshold."""
    c = score_counts(scored, y, score)
    end = scored.sparkSession.createDataFrame([(None, 1.0, 0.0)], "threshold double, precision double, recall double")
    return end.unionByName(c.select(F.col(score).alias("threshold"),
                    safe_ratio("cum_pos", F.col("cum_pos") + F.col("cum_neg")).alias("precision"),
                    safe_ratio("cum_pos", "P").alias("recall")))


def curve_summary(scored: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """E5 + E6 areas in one aggregate: ROC AUC (trapezoids, ties as one step),
    average precision ``sum((R_n - R_n-1) P_n)`` and the base rate."""
    c = score_counts(scored, y, score)
    tp_prev = F.col("cum_pos") - F.col("pos")
    # a sum of integers, as decimals beyond 64 bits: exact whatever the order
    trap = F.col("neg").cast("decimal(19,0)") * (F.col("cum_pos") + tp_prev).cast("decimal(19,0)")
    ap_term = F.try_divide(F.try_divide(F.col("pos"), F.col("P")) * F.col("cum_pos"),
                           F.col("cum_pos") + F.col("cum_neg"))
    agg = c.agg(F.sum(trap).alias("_trap"), F.sum(ap_term).alias("_ap"), F.max("P").alias("P"), F.max("N").alias("N"))
    return agg.select(
        F.try_divide(F.col("_trap").cast("double"), 2.0 * F.col("P") * F.col("N")).alias("roc_auc"),
        F.try_divide(F.col("_ap"), F.lit(1.0)).alias("avg_precision"),
        F.try_divide(F.col("P").cast("double"), F.col("P") + F.col("N")).alias("base_rate"))


def _grid_bucket(score: str, grid: Sequence[float]) -> str:
    """SQL: number of grid thresholds <= score (0 .. len(grid)); grid ascending."""
    parts = " ".join(f"WHEN `{score}` >= CAST({float(t)!r} AS DOUBLE) THEN {i + 1}"
                     for i, t in reversed(list(enumerate(grid))))
    return f"CASE {parts} ELSE 0 END"


def threshold_counts(scored: DataFrame, grid: Sequence[float], y: str = "y", score: str = "score",
                     by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, tn, fn at every grid threshold (prediction = score >= threshold).

    Without ``by``: each score goes to its grid bucket (one CASE), one aggregate gives
    at most len(grid)+1 rows, and suffix sums over those rows give every threshold.
    With ``by`` (a few thresholds per group, e.g. F1 per split): conditional counts in
    one grouped aggregate."""
    s = scored.where(F.col(score).isNotNull())
    if not by:
        spark = scored.sparkSession
        counts = s.groupBy(F.expr(_grid_bucket(score, grid)).alias("_b")).agg(
            F.count_if(F.col(y) == 1).alias("_pos"), F.count_if(F.col(y) == 0).alias("_neg"))
        frame = spark.createDataFrame([(i, float(grid[i - 1]) if i else None) for i in range(len(grid) + 1)],
                                      "_b int, threshold double")
        dense = F.broadcast(frame).join(counts, "_b", "left").fillna(0, ["_pos", "_neg"])
        # windows over the dense grid frame: len(grid)+1 rows, bounded by the grid
        suffix = W.orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, W.currentRow)
        whole = W.partitionBy()
        out = dense.select("_b", "threshold", F.sum("_pos").over(suffix).alias("tp"),
                           F.sum("_neg").over(suffix).alias("fp"),
                           F.sum("_pos").over(whole).alias("_P"), F.sum("_neg").over(whole).alias("_N"))
        return out.where(F.col("_b") > 0).select(
            "threshold", F.col("tp").cast("bigint").alias("tp"), F.col("fp").cast("bigint").alias("fp"),
            (F.col("_N") - F.col("fp")).cast("bigint").alias("tn"),
            (F.col("_P") - F.col("tp")).cast("bigint").alias("fn"))
    sc, yy = f"`{score}`", f"`{y}`"
    aggs = []
    for i, t in enumerate(grid):
        t = repr(float(t))
        aggs += [f"count_if({sc} >= {t} AND {yy} = 1) AS tp{i}", f"count_if({sc} >= {t} AND {yy} = 0) AS fp{i}",
                 f"count_if({sc} < {t} AND {yy} = 0) AS tn{i}", f"count_if({sc} < {t} AND {yy} = 1) AS fn{i}"]
    row = s.groupBy(*by).agg(*[F.expr(a) for a in aggs])
    structs = ", ".join(f"named_struct('threshold', CAST({float(t)!r} AS DOUBLE), 'tp', tp{i}, 'fp', fp{i}, "
                        f"'tn', tn{i}, 'fn', fn{i})" for i, t in enumerate(grid))
    return row.selectExpr(*[f"`{b}`" for b in by], f"inline(array({structs}))")


def with_metrics(counts: DataFrame) -> DataFrame:
    """precision, recall, F1, specificity from tp/fp/tn/fn; 0 where a denominator is 0."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    precision = safe_ratio(tp, tp + fp)
    recall = safe_ratio(tp, tp + fn)
    f1 = safe_ratio(2 * precision * recall, precision + recall)
    return counts.select("*", precision.alias("precision"), recall.alias("recall"),
                         f1.alias("f1"), safe_ratio(tn, tn + fp).alias("specificity"))


def threshold_sweep(scored: DataFrame, grid: Sequence[float] = SWEEP_GRID, y: str = "y",
                    score: str = "score") -> DataFrame:
    """Metrics at each threshold of the grid."""
    return with_metrics(threshold_counts(scored, grid, y, score))


def best_threshold(scored: DataFrame, grid: Sequence[float] = F1_GRID, y: str = "y",
                   score: str = "score") -> DataFrame:
    """The grid threshold with the highest F1; the lowest threshold wins ties."""
    sweep = with_metrics(threshold_counts(scored, grid, y, score))
    return sweep.agg(F.max_by(F.struct("threshold", "f1"), F.struct("f1", -F.col("threshold"))).alias("b")) \
        .select(F.col("b.threshold").alias("threshold"), F.col("b.f1").alias("f1"))


def confusion(scored: DataFrame, threshold: float = 0.5, y: str = "y", score: str = "score") -> DataFrame:
    """Dense 2x2 confusion matrix (actual, predicted, count)."""
    c = threshold_counts(scored, [threshold], y, score)
    return c.select(F.explode(F.array(
        F.struct(F.lit(0).alias("actual"), F.lit(0).alias("predicted"), F.col("tn").alias("count")),
        F.struct(F.lit(0).alias("actual"), F.lit(1).alias("predicted"), F.col("fp").alias("count")),
        F.struct(F.lit(1).alias("actual"), F.lit(0).alias("predicted"), F.col("fn").alias("count")),
        F.struct(F.lit(1).alias("actual"), F.lit(1).alias("predicted"), F.col("tp").alias("count")),
    )).alias("s")).select("s.*")


def class_report(scored: DataFrame, threshold: float = 0.5, y: str = "y", score: str = "score") -> DataFrame:
    """Per-class precision / recall / F1 / support, accuracy, macro and weighted averages."""
    c = threshold_counts(scored, [threshold], y, score)
    tp, fp, tn, fn = (F.col(k) for k in ("tp", "fp", "tn", "fn"))
    p1, r1 = safe_ratio(tp, tp + fp), safe_ratio(tp, tp + fn)
    p0, r0 = safe_ratio(tn, tn + fn), safe_ratio(tn, tn + fp)
    f1_1, f1_0 = safe_ratio(2 * p1 * r1, p1 + r1), safe_ratio(2 * p0 * r0, p0 + r0)
    s1, s0 = tp + fn, tn + fp
    n = s0 + s1
    acc = safe_ratio(tp + tn, n)

    def row(label, p, r, f, sup):
        return F.struct(F.lit(label).alias("label"), p.alias("precision"),
                        r.alias("recall"), f.alias("f1"),
                        sup.cast("bigint").alias("support"))
    w = lambda a, b: safe_ratio(a * s0 + b * s1, n)
    return c.select(F.explode(F.array(
        row("0", p0, r0, f1_0, s0), row("1", p1, r1, f1_1, s1),
        row("accuracy", acc, acc, acc, n),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f1_0 + f1_1) / 2, n),
        row("weighted avg", w(p0, p1), w(r0, r1), w(f1_0, f1_1), n),
    )).alias("s")).select("s.*")


def f1_gap(scored: DataFrame, split: str, threshold: float = 0.5, first: str = "train", second: str = "eval",
           y: str = "y", score: str = "score") -> DataFrame:
    """F1 on two splits and their difference."""
    c = with_metrics(threshold_counts(scored.where(F.col(split).isin(first, second)), [threshold], y, score,
                                      by=[split]))
    f_a = F.max(F.when(F.col(split) == first, F.col("f1")))
    f_b = F.max(F.when(F.col(split) == second, F.col("f1")))
    return c.agg(f_a.alias(f"f1_{first}"), f_b.alias(f"f1_{second}"), (f_a - f_b).alias("f1_gap"))


def verdicts(roc_auc: float | None, avg_precision: float | None, gap: float | None) -> dict[str, str]:
    """E8 verdict texts from the cut-offs above."""
    out = {}
    if roc_auc is not None:
        out["roc"] = "good" if roc_auc > ROC_GOOD else ("fair" if roc_auc > ROC_FAIR else "weak")
    if avg_precision is not None:
        out["pr"] = "good" if avg_precision > PR_GOOD else "weak"
    if gap is not None:
        out["overfit"] = "high" if gap > GAP_HIGH else ("moderate" if gap > GAP_MODERATE else "low")
    return out
