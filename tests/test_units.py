"""Hand-computed cases on small frames (one trap each)."""

import math

import pytest
from pyspark.sql import functions as F

from ratelens.functions.bins import cut_expr, equal_width_edges, interval_breaks, money_label
from ratelens.functions.scalar import round_even, safe_ratio, risk_tier
from ratelens.operators import binning, evaluation as ev, facets, features, ranks, rates, stats
from ratelens.operators.scans import exact_quantiles
from ratelens.plans import analyses as A
from ratelens.roles import FACT_ROLES as R
from ratelens.sources.files import HR_SCHEMA


def col(df, name, order=None):
    rows = df.orderBy(order or name).collect()
    return [r[name] for r in rows]


def test_right_closed_bins_and_out_of_range(spark):
    df = spark.createDataFrame([(None,), (0,), (1,), (2,), (3,), (50,), (51,)], "x int")
    out = df.select(cut_expr("x", [0, 1, 2, 3, 5, 10, 50], ["0-1", "1-2", "2-3", "3-5", "5-10", "10+"]).alias("b"))
    got = [r.b for r in out.collect()]
    assert got == [None, None, "0-1", "1-2", "2-3", "10+", None]


def test_dense_bins_keep_empty_labels(spark):
    df = spark.createDataFrame([(20, 1), (35, 0), (35, 1)], "age int, y int")
    out = binning.cut_fixed(df, "age", A.AGE_EDGES, A.AGE_LABELS, "y").orderBy("bin").collect()
    assert [r.band for r in out] == A.AGE_LABELS
    assert [r.total for r in out] == [1, 2, 0, 0]
    assert [r.positives for r in out] == [1, 1, 0, 0]
    assert out[2].rate is None and out[1].rate == 0.5


def test_equal_width_edges_and_labels(spark):
    df = spark.createDataFrame([(v, 0) for v in (1009, 2911, 4807, 4808, 4919, 8379, 16201, 19999)], "x int, y int")
    edges = binning.equal_width(df, "x", 5)
    assert [round(e) for e in interval_breaks(edges, 0)] == [990, 4807, 8605, 12403, 16201, 19999]
    assert edges[1] == 4807.0 and edges[0] == pytest.approx(990.01)
    out = binning.cut_equal(df, "x", 5, "y").orderBy("bin").collect()
    assert [r.label for r in out] == ["$0K-4K", "$4K-8K", "$8K-12K", "$12K-16K", "$16K-19K"]
    # 4807 is the right edge of bin 0 (right-closed); 16201 closes bin 3
    assert [r.total for r in out] == [3, 3, 0, 1, 1]
    assert money_label(None, 1.0) == "N/A"


def test_equal_width_constant_column():
    e = equal_width_edges(80.0, 80.0, 5)
    assert e[0] < 80 < e[-1] and len(e) == 6


def test_rank_pct_ties(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 3, 10, 10, 12])], "id int, x double")
    out = ranks.rank_pct(df, "x")
    got = col(out, "rank_pct", "id")
    assert got == pytest.approx([1 / 6, 2 / 6, 3 / 6, 4.5 / 6, 4.5 / 6, 1.0])


def test_quantile_interpolation(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 10, 10, 12]], "x double")
    q = exact_quantiles(df, "x", [0.25, 0.5, 1.0]).orderBy("pi").collect()
    assert [r.value for r in q] == pytest.approx([2.25, 6.5, 12.0])


def test_quantile_grouped_matches_numpy(spark):
    import numpy as np
    rows = [(g, float(v)) for g in range(3) for v in np.random.RandomState(g).randint(0, 50, 37)]
    df = spark.createDataFrame(rows, "g int, x double")
    q = exact_quantiles(df, "x", [0.1, 0.33, 0.9], by=["g"]).collect()
    for r in q:
        vals = [v for g, v in rows if g == r.g]
        assert r.value == pytest.approx(float(np.percentile(vals, r.p * 100)))


def test_repeated_quantile_edges_merge(spark):
    df = spark.createDataFrame([(1.0, 0), (1.0, 1), (1.0, 0), (1.0, 0), (2.0, 1)], "x double, y int")
    edges = binning.quantile_edges(df, "x", 4)
    assert edges == [1.0, 2.0]
    out = binning.cut_quantile(df, "x", 4, "y").orderBy("bin").collect()
    assert [r.quartile for r in out] == ["Q1"] and out[0].total == 5


def test_target_encoding_smoothing(spark):
    df = spark.createDataFrame(list(zip("abababc"[:6], [1, 0, 1, 0, 1, 0])), "g string, y int")
    df = spark.createDataFrame([("a", 1), ("b", 0), ("a", 1), ("b", 0), ("c", 1), ("a", 0)], "g string, y int")
    enc = features.fit_target_encoding(df, ["g"], "y", smoothing=1.0, min_samples_leaf=1)
    assert enc.global_mean == 0.5
    new = spark.createDataFrame([("a",), ("b",), ("c",), ("z",)], "g string")
    got = {r.g: r.g_te for r in enc.transform(new).collect()}
    assert got["a"] == pytest.approx(0.625) and got["b"] == pytest.approx(1 / 6)
    assert got["c"] == pytest.approx(0.75) and got["z"] == 0.5


def test_target_encoding_min_leaf_falls_back(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("c", 0)], "g string, y int")
    enc = features.fit_target_encoding(df, ["g"], "y", smoothing=1.0, min_samples_leaf=2)
    got = {r.g: r.g_te for r in enc.transform(df.select("g").distinct()).collect()}
    assert got["c"] == pytest.approx(2 / 3)  # global mean


def test_label_encoding_alphabetical_and_unseen(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "g string")
    new = spark.createDataFrame([("a",), ("c",), ("zz",)], "g string")
    out = features.label_encode(new, ["g"], fit_on=df)
    assert col(out, "g_code", "g") == [0, 2, 3]


def test_round_half_even(spark):
    df = spark.createDataFrame([(0.0625, 2.5)], "a double, b double")
    r = df.select(round_even("a", 3).alias("a"), round_even("b", 0).alias("b")).first()
    assert r.a == 0.062 and r.b == 2.0


def test_no_positive_gives_zero_percent(spark):
    df = spark.createDataFrame([("x", "No"), ("y", "No")], "dept string, outcome string")
    pct = rates.crosstab_pct(df, "dept", "outcome", ["No", "Yes"]).collect()
    assert all(r.Yes == 0.0 and r.No == 100.0 for r in pct)
    av = rates.all_variables(df, ["dept"], "outcome", "Yes", min_count=1).collect()
    assert all(r.rate_pct == 0.0 for r in av)


def test_empty_kpis_are_null(spark):
    df = spark.createDataFrame([], "y int, job_sat int, income double, tenure int")
    r = A.kpis(df, R).first()
    assert r.total == 0 and r.rate_pct is None and r.avg_income is None


def test_safe_ratio_zero_denominator(spark):
    r = spark.range(1).select(safe_ratio(F.lit(3), F.lit(0)).alias("a"), safe_ratio(F.lit(1), F.lit(4)).alias("b")).first()
    assert r.a == 0.0 and r.b == 0.25


def _brute_auc(pairs):
    pos = [s for s, y in pairs if y == 1]
    neg = [s for s, y in pairs if y == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def _brute_ap(pairs):
    # sum over distinct thresholds (descending) of (R_n - R_n-1) * P_n
    P = sum(y for _, y in pairs)
    ap, prev_r = 0.0, 0.0
    for t in sorted({s for s, _ in pairs}, reverse=True):
        tp = sum(1 for s, y in pairs if s >= t and y == 1)
        fp = sum(1 for s, y in pairs if s >= t and y == 0)
        r = tp / P
        ap += (r - prev_r) * tp / (tp + fp)
        prev_r = r
    return ap


def test_roc_auc_and_ap_against_brute_force(spark):
    import random
    rnd = random.Random(3)
    pairs = [(round(rnd.random(), 2), rnd.randint(0, 1)) for _ in range(300)]  # many ties
    df = spark.createDataFrame(pairs, "score double, y int")
    r = ev.curve_summary(df).first()
    assert r.roc_auc == pytest.approx(_brute_auc(pairs), abs=1e-6)
    assert r.avg_precision == pytest.approx(_brute_ap(pairs), abs=1e-6)


def test_one_class_scored_has_no_auc(spark):
    df = spark.createDataFrame([(0.2, 0), (0.7, 0)], "score double, y int")
    r = ev.curve_summary(df).first()
    assert r.roc_auc is None
    sweep = ev.threshold_sweep(df).collect()
    assert all(x.precision == 0.0 and x.recall == 0.0 and x.f1 == 0.0 for x in sweep)


def test_sweep_matches_confusion(spark):
    import random
    rnd = random.Random(5)
    df = spark.createDataFrame([(rnd.random(), rnd.randint(0, 1)) for _ in range(200)], "score double, y int")
    sweep = {round(r.threshold, 2): r for r in ev.threshold_sweep(df).collect()}
    conf = {(r.actual, r.predicted): r["count"] for r in ev.confusion(df, 0.5).collect()}
    s = sweep[0.5]
    assert (s.tp, s.fp, s.tn, s.fn) == (conf[(1, 1)], conf[(0, 1)], conf[(0, 0)], conf[(1, 0)])
    assert len(sweep) == 18 and min(sweep) == 0.1 and max(sweep) == 0.95


def test_best_threshold_grid_and_tie_rule(spark):
    assert len(ev.F1_GRID) == 40 and ev.F1_GRID[-1] == 0.88
    df = spark.createDataFrame([(0.99, 1), (0.01, 0)], "score double, y int")
    b = ev.best_threshold(df).first()
    assert b.threshold == 0.1 and b.f1 == 1.0  # every threshold gives F1 = 1: lowest wins


def test_risk_tier_cutoffs(spark):
    df = spark.createDataFrame([(0.71,), (0.7,), (0.5,), (0.31,), (0.3,)], "p double")
    got = [r.t for r in df.select(risk_tier("p").alias("t")).collect()]
    assert got == ["RIESGO CRÍTICO (>70%)", "RIESGO ALTO (50-70%)", "RIESGO MODERADO (30-50%)",
                   "RIESGO MODERADO (30-50%)", "RIESGO BAJO (<30%)"]


def test_fill_defaults_derived_values(spark):
    df = spark.createDataFrame([("r1", 3, 5000.0, 35, "Yes", "1-URGENT", 2), ("r2", 10, 9000.0, 20, "No", "2-HIGH", 1)],
                               "row_id string, tenure int, income double, age int, overtime string, travel string, "
                               "level int")
    out = {r.row_id: r for r in facets.fill_defaults(df, R).collect()}
    assert out["r1"].experience == 17 and out["r1"].role_years == 2 and out["r2"].experience == 10
    assert out["r1"].dept == "Sales" and out["r1"].job_sat == 3 and out["r1"].rate1 == 800


def test_facet_predicate_empty_and_missing(spark):
    df = spark.createDataFrame([("a", 1), ("b", 5)], "g string, x int")
    assert facets.faceted_filter(df, {"g": []}).count() == 0
    assert facets.faceted_filter(df).count() == 2
    assert facets.faceted_filter(df, {"g": ["a", "b"]}, {"x": (1, 4)}).count() == 1


def test_hr_schema_on_sample_rows(spark, tmp_path):
    header = ",".join(f.name for f in HR_SCHEMA.fields)
    line = "29,Yes,Non-Travel,515,Sales,7,2,Marketing,1,31,3,Male,44,3,1,Sales Representative,2,Single,2750,8300,1,Y," \
           "No,12,3,3,80,0,4,2,3,3,2,0,2"
    p = tmp_path / "s.csv"
    p.write_text(header + "\n" + line + "\n")
    from ratelens.sources.files import read_csv
    df = read_csv(spark, str(p))
    r = df.first()
    assert len(df.columns) == 35 and r.Age == 29 and r.MonthlyIncome == 2750 and r.Attrition == "Yes"
    assert sum(1 for f in df.schema.fields if f.dataType.simpleString() == "int") == 26


def test_correlation_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0, 80, 2.0), (2.0, 80, 4.1), (3.0, 80, 6.3)], "a double, k int, b double")
    c = {(r.c1, r.c2): r.r for r in stats.corr_long(df, ["a", "k", "b"]).collect()}
    assert c[("a", "k")] is None and c[("k", "k")] is None and c[("a", "a")] == 1.0
    import numpy as np
    assert c[("a", "b")] == pytest.approx(float(np.corrcoef([1, 2, 3], [2.0, 4.1, 6.3])[0, 1]), abs=1e-6)


def test_box_whiskers_use_observed_points(spark):
    vals = [1, 2, 3, 4, 5, 6, 7, 8, 9, 100]
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    r = stats.box_stats(df, ["x"]).first()
    assert r.q1 == 3.25 and r.q3 == 7.75 and r.whisker_hi == 9.0 and r.whisker_lo == 1.0 and r.outliers == 1


def test_histogram_dense(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (10.0,)], "x double")
    h = stats.histogram(df, "x", 5).orderBy("bin").collect()
    assert [r["count"] for r in h] == [2, 0, 0, 0, 1]


def test_hot_group_and_long_tail_stay_exact_and_balanced(spark):
    """One group holds most rows and the values have far outliers: results stay exact
    and the range buckets still spread the values (no bucket holds most of them)."""
    import numpy as np
    from ratelens.operators.scans import range_buckets
    rnd = np.random.RandomState(7)
    vals = np.concatenate([rnd.randint(0, 5000, 3000), [1e9, 2e9, 5e12]])
    rows = [("hot" if i % 10 else "cold", float(v)) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "g string, x double")
    q = {(r.g, r.p): r.value for r in exact_quantiles(df, "x", [0.1, 0.5, 0.99], by=["g"]).collect()}
    for (g, p), v in q.items():
        xs = [x for gg, x in rows if gg == g]
        assert v == pytest.approx(float(np.percentile(xs, p * 100)))
    b = range_buckets(df.select("x").distinct(), "x", buckets=64).groupBy("_bucket").count().collect()
    n = sum(r["count"] for r in b)
    assert max(r["count"] for r in b) < 0.1 * n
    pct = ranks.rank_pct(df.withColumn("id", F.monotonically_increasing_id()), "x").toPandas()
    exp = pct["x"].rank(pct=True)
    assert np.allclose(pct["rank_pct"].values, exp.values)
