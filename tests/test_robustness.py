"""Null keys, overflow, empty input, near ties, many groups, many buckets, curve end points, written tables."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratelens.functions.bins import interval_breaks
from ratelens.operators import binning, evaluation as ev, features, ranks, rates, stats, training
from ratelens.operators.scans import exact_quantiles, range_buckets
from ratelens.plans import analyses as A
from ratelens.roles import FACT_ROLES as R
from ratelens.sources import tables


def test_split_and_folds_keep_rows_without_a_label(spark):
    rows = [(f"r{i}", None if i % 5 == 0 else i % 2) for i in range(20)]
    df = spark.createDataFrame(rows, "id string, y int")
    s = ranks.stratified_split(df, "id", "y")
    assert s.count() == 20 and s.where("split is null").count() == 0
    f = ranks.stratified_folds(df, "id", "y", 2).groupBy("y", "fold").count().collect()
    assert {(r.y, r.fold): r["count"] for r in f if r.y is None} == {(None, 0): 2, (None, 1): 2}


def test_running_max_and_quantiles_keep_null_groups(spark):
    df = spark.createDataFrame([(None, 1, 5.0), (None, 2, 3.0), ("a", 1, 1.0), ("a", 2, 2.0)], "g string, o int, v double")
    out = {(r.g, r.o): r.running_max for r in ranks.running_max(df, "v", "o", ["g"]).collect()}
    assert out == {(None, 1): 5.0, (None, 2): 5.0, ("a", 1): 1.0, ("a", 2): 2.0}
    q = {r.g: r.value for r in exact_quantiles(df, "v", [0.5], ["g"]).collect()}
    assert q == {None: 4.0, "a": 1.5}
    pct = {(r.g, r.v): r.rank_pct for r in ranks.rank_pct(df, "v", ["g"]).collect()}
    assert pct == {(None, 5.0): 1.0, (None, 3.0): 0.5, ("a", 1.0): 0.5, ("a", 2.0): 1.0}


def test_auc_of_huge_tied_counts_does_not_overflow(spark):
    weights = [(0.9, 4e11, 3e7), (0.1, 1e11, 9e11)]
    counts = spark.createDataFrame([(s, int(p), int(n)) for s, p, n in weights], "score double, pos long, neg long")
    total = counts.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    cum = counts.crossJoin(F.broadcast(total)).withColumns({
        "cum_pos": F.when(F.col("score") > 0.5, F.col("pos")).otherwise(F.col("P")),
        "cum_neg": F.when(F.col("score") > 0.5, F.col("neg")).otherwise(F.col("N"))})
    original, ev.score_counts = ev.score_counts, lambda *a: cum
    try:
        r = ev.curve_summary(counts).first()
    finally:
        ev.score_counts = original
    p, n = 5e11, 9e11 + 3e7
    assert r.roc_auc == pytest.approx((3e7 * 4e11 / 2 + 9e11 * (4e11 + 1e11 / 2)) / (p * n))


def test_curves_have_their_end_points(spark):
    rng = np.random.RandomState(1)
    df = spark.createDataFrame([(round(float(rng.rand()), 2), int(rng.rand() < 0.4)) for _ in range(300)], "score double, y int")
    roc = sorted((r.fpr, r.tpr) for r in ev.roc_points(df).collect())
    assert roc[0] == (0.0, 0.0) and roc[-1] == (1.0, 1.0)
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(roc, roc[1:]))
    assert area == pytest.approx(ev.curve_summary(df).first().roc_auc)
    ends = [r for r in ev.pr_points(df).collect() if r.threshold is None]
    assert [(r.recall, r.precision) for r in ends] == [(0.0, 1.0)]


def test_near_ties_are_ordered_by_raw_values(spark):
    # rates that agree to more than six digits
    rows = [("b", 1, 3_000_001), ("a", 1, 3_000_000)]
    df = spark.createDataFrame([(g, 3.0 / n + k) for g, k, n in rows], "role string, rate double")
    assert [r.role for r in rates.top_k(df, 2, [F.desc_nulls_last("rate"), "role"]).collect()] == ["a", "b"]
    tiny = spark.createDataFrame([("x", 1)] + [("x", 0)] * 9, "g string, y int")
    assert rates.outcome_rate(tiny, ["g"], "y").first().rate == 0.1
    third = spark.createDataFrame([("x", 1), ("x", 0), ("x", 0)], "g string, y int")
    assert rates.outcome_rate(third, ["g"], "y").first().rate == 1 / 3


def test_whisker_never_ends_inside_the_box(spark):
    r = stats.box_stats(spark.createDataFrame([(0.0,), (0.0,), (0.0,), (10.0,)], "x double"), ["x"]).first()
    assert r.q3 == 2.5 and r.whisker_hi == 2.5 and r.whisker_lo == 0.0 and r.outliers == 1


def test_equal_bins_of_no_rows(spark):
    df = spark.createDataFrame([], "income double, y int")
    assert binning.cut_equal(df, "income", 5).collect() == []
    assert binning.equal_width(df, "income", 5) == []


def test_category_detail_leaves_null_outcomes_out_of_the_percent(spark):
    df = spark.createDataFrame([("a", "Yes"), ("a", "No"), ("a", None), ("b", None)], "role string, outcome string")
    out = {r.role: r for r in A.category_detail(df, R, "role").collect()}
    assert out["a"]["count"] == 3 and out["a"].yes_pct == 50.0 and out["b"].yes_pct is None


def test_interval_breaks_keep_edges_distinct():
    assert interval_breaks([990.4, 4807.0, 8605.5]) == [990.0, 4807.0, 8606.0]
    assert interval_breaks([0.11, 0.12, 0.13]) == [0.11, 0.12, 0.13]


def test_many_groups_and_many_buckets(spark):
    df = spark.range(40_000).select((F.col("id") % 5000).alias("g"), (F.col("id") * 7 % 40_009).cast("double").alias("x"))
    got = {r.g: r.value for r in exact_quantiles(df, "x", [0.5], ["g"], buckets=64).collect()}
    pdf = df.toPandas().groupby("g").x.median()
    assert len(got) == 5000 and all(got[g] == pytest.approx(v) for g, v in pdf.items())
    one = spark.range(300_000).select(F.rand(1).alias("x"))
    used = range_buckets(one, "x", buckets=8192).select("_bucket").distinct().count()
    assert used > 8000


def test_temporary_tables_are_dropped(spark):
    tables.drop_temporary(spark)
    tables.temporary(spark.range(3).toDF("a"), "t").count()
    path = tables._TEMPORARY[-1]
    local = path.removeprefix("file:")
    assert os.path.isdir(local) and tables.drop_temporary(spark) == 1 and not os.path.exists(local)


def test_a_failed_write_raises(spark):
    bad = lambda: spark.range(1).select(F.raise_error(F.lit("no")).alias("a"))
    with pytest.raises(Exception):
        tables.materialize(spark, bad, "bad", "x")


def test_unseen_labels_get_their_own_code_or_zero(spark):
    fit = spark.createDataFrame([("a",), ("b",)], "c string")
    new = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    code = lambda **k: [r.c_code for r in features.label_encode(new, ["c"], fit, **k).collect()]
    assert code() == [0, 2, 2] and code(unseen="zero") == [0, 0, 0]


def test_rounds_stop_after_patience():
    losses = [1.0, 0.9, 0.8] + [0.85] * 30 + [0.1]
    assert training.kept_rounds(losses) == 3 and training.kept_rounds([3, 2, 1]) == 3
    assert training.kept_rounds([1, 2], patience=1) == 1


def test_correlations_choose_numeric_columns_by_type(spark):
    df = spark.createDataFrame([("x", 1, 2.0), ("y", 2, 4.5), ("z", 3, 5.0)], "s string, a int, b double")
    assert {r.c1 for r in stats.corr_long(df).collect()} == {"a", "b"}
