"""Quantiles by brackets: exact whatever the sketches return, and few single values are shuffled."""

import numpy as np
import pandas as pd
import pytest

from ratelens.operators import scans

PROBS = [0, 0.1, 0.25, 0.5, 0.75, 0.999, 1]


def frame(spark, n=20_000):
    rng = np.random.default_rng(3)
    x = rng.normal(size=n)
    x[::3] = 1.25                       # a third of all rows hold one value
    x[1::7] = np.round(x[1::7], 1)
    g = rng.integers(0, 3, n).astype(object)
    g[g == 2] = None
    return pd.DataFrame({"g": g, "x": x}), spark.createDataFrame(pd.DataFrame({"g": g, "x": x}), "g long, x double").repartition(5)


def check(p, df):
    got = {(r.g, r.pi): r.value for r in scans.exact_quantiles(df, "x", PROBS, ["g"]).collect()}
    for k in (0, 1, None):
        v = p.x[p.g.isna() if k is None else p.g == k]
        assert [got[k, i] for i in range(len(PROBS))] == pytest.approx(np.quantile(v, PROBS).tolist(), abs=1e-12)
    whole = {r.pi: r.value for r in scans.exact_quantiles(df, "x", PROBS).collect()}
    assert [whole[i] for i in range(len(PROBS))] == pytest.approx(np.quantile(p.x, PROBS).tolist(), abs=1e-12)


def test_inside_is_sketched_again_until_it_is_small(spark, monkeypatch):
    monkeypatch.setattr(scans, "BRACKET_ROWS", 30)
    check(*frame(spark))


def test_bounds_are_widened_when_a_sketch_misses_the_rank(spark, monkeypatch):
    margins = []

    def none(k):
        return 0.002

    real = scans._brackets

    def noted(d, keys, probs, k, margin):
        margins.append(margin)
        return real(d, keys, probs, 8 if margin < 0.01 else 4096, margin)

    monkeypatch.setattr(scans, "_rank_margin", none)
    monkeypatch.setattr(scans, "_brackets", noted)
    check(*frame(spark, 3000))
    assert len(margins) > 2 and max(margins) > 0.005


def test_few_values_are_kept_single(spark):
    df = spark.range(200_000).selectExpr("CAST(hash(id) AS DOUBLE) AS _v", f"0 AS {scans._G}")
    b = scans._brackets(df, [scans._G], [0.25, 0.5], scans.SKETCH_K, scans._rank_margin(scans.SKETCH_K)).first()
    inside = df.where(f"_v BETWEEN {b['_lo0']} AND {b['_hi0']} OR _v BETWEEN {b['_lo1']} AND {b['_hi1']}").count()
    assert 0 < inside < 0.02 * 200_000


def test_nan_is_the_largest_value(spark):
    nan = float("nan")
    df = spark.createDataFrame([(x,) for x in [nan, 1.0, 2.0, nan, None, float("-inf"), float("inf")]], "x double")
    got = {r.pi: r.value for r in scans.exact_quantiles(df, "x", [0, 0.4, 0.6, 1]).collect()}
    assert got[0] == float("-inf") and got[1] == 2.0 and got[2] == float("inf") and np.isnan(got[3])
    assert scans.exact_quantiles(df.where("x IS NULL"), "x", [0.5]).collect() == []
    only = spark.createDataFrame([(nan,), (nan,)], "x double")
    assert np.isnan(scans.exact_quantiles(only, "x", [0.5]).first().value)
