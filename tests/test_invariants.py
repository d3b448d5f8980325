"""Invariants on the driver tables (sf 0.001)."""

from pyspark.sql import functions as F

from ratelens.operators import evaluation as ev, ranks, rates
from ratelens.plans import analyses as A
from ratelens.roles import FACT_ROLES as R
from ratelens.sources.tables import fact

from conftest import SF_SMALL


def test_rate_counts_sum_to_total(spark):
    f = fact(spark, SF_SMALL)
    n = f.count()
    out = rates.outcome_rate(f, ["role"], "y").agg(F.sum("total"), F.sum("positives")).first()
    assert out[0] == n and out[1] == f.where("y = 1").count()


def test_percent_rows_sum_to_100(spark):
    f = fact(spark, SF_SMALL)
    for r in A.overtime_share(f, R).collect():
        assert abs(r.no_pct + r.yes_pct - 100.0) < 1e-6


def test_bins_plus_outside_equal_rows(spark):
    f = fact(spark, SF_SMALL)
    n = f.count()
    inside = A.tenure_bands(f, R).agg(F.sum("total")).first()[0]
    outside = f.where("tenure <= 0 OR tenure > 50").count()
    assert inside + outside == n and outside > 0  # tenure 0 falls outside (0, 1]


def test_split_disjoint_complete_and_exact(spark):
    f = fact(spark, SF_SMALL).select("row_id", "y")
    s = ranks.stratified_split(f, "row_id", "y")
    assert s.count() == f.count() and s.select("row_id").distinct().count() == f.count()
    sizes = {(r.y, r.split): r["count"] for r in s.groupBy("y", "split").count().collect()}
    for y in (0, 1):
        n = sum(v for (yy, _), v in sizes.items() if yy == y)
        assert abs(sizes[(y, "train")] - 0.6 * n) <= 1 and abs(sizes[(y, "test")] - 0.2 * n) <= 1


def test_folds_balanced_per_class(spark):
    f = fact(spark, SF_SMALL).select("row_id", "y")
    s = ranks.stratified_folds(f, "row_id", "y", 7)
    for y in (0, 1):
        counts = [r["count"] for r in s.where(F.col("y") == y).groupBy("fold").count().collect()]
        assert len(counts) == 7 and max(counts) - min(counts) <= 1


def test_running_max_is_monotone(spark):
    f = fact(spark, SF_SMALL).select("row_id", "dept", "score")
    out = ranks.running_max(f, "score", "row_id", ["dept"], hashed_order=True).toPandas()
    for _, g in out.sort_values("row_id").groupby("dept"):
        assert (g["running_max"].diff().dropna() >= 0).all()
        assert (g["running_max"] == g["score"].cummax()).all()


def test_roc_auc_pair_count(spark):
    f = fact(spark, SF_SMALL).select("y", "score").toPandas()
    pos, neg = f[f.y == 1].score.values, f[f.y == 0].score.values
    import numpy as np
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    r = ev.curve_summary(fact(spark, SF_SMALL)).first()
    assert abs(r.roc_auc - wins / (len(pos) * len(neg))) < 1e-6
