"""Model operators: shape and invariants (quality near chance is expected on this data)."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from ratelens.operators import explain, facets, training
from ratelens.plans import registry as RG
from ratelens.roles import FACT_ROLES as R

from conftest import SF_SMALL

SMALL = {**training.DEFAULT_PARAMS, "n_estimators": 5, "max_depth": 3}


@pytest.fixture(scope="module")
def model(spark):
    data = RG.model_data(spark, SF_SMALL)
    return training.train(data, R, SMALL), data


def test_scores_in_unit_interval_and_threshold_on_grid(model):
    tm, data = model
    s = tm.score(data, keep=["row_id"])
    r = s.agg(F.min("score"), F.max("score"), F.count("*")).first()
    assert 0.0 <= r[0] <= r[1] <= 1.0 and r[2] == data.count()
    assert round(tm.threshold * 100) in range(10, 90, 2)


def learnable(spark, n=3000):
    """Rows whose outcome depends on age, overtime and tenure."""
    import random
    rnd = random.Random(4)
    rows = []
    for i in range(n):
        age, tenure, over = rnd.randint(18, 60), rnd.randint(0, 30), rnd.choice(["Yes", "No"])
        z = 0.12 * (38 - age) + (1.6 if over == "Yes" else -0.8) - 0.08 * (tenure - 10)
        y = int(rnd.random() < 1 / (1 + 2.718 ** -z))
        rows.append((f"r{i}", y, age, tenure, over, rnd.choice(["train", "train", "train", "test", "eval"])))
    df = spark.createDataFrame(rows, "row_id string, y int, age int, tenure int, overtime string, split string")
    return df.withColumns({**{c: F.lit("x") for c in R.categoricals if c != "overtime"},
                           **{c: F.lit(1.0) for c in R.numerics if c not in ("age", "tenure")}})


def test_rounds_are_chosen_on_the_test_split(spark):
    from ratelens.operators import evaluation as ev
    data = learnable(spark)
    params = {**SMALL, "n_estimators": 25, "subsample": 1.0, "colsample_bytree": 1.0}
    tm = training.train(data, R, params)
    one = training.train(data, R, {**params, "n_estimators": 1})
    held = data.where("split = 'eval'")
    auc = [ev.curve_summary(m.score(held, keep=["y"])).first().roc_auc for m in (tm, one)]
    assert 1 < tm.rounds_kept <= tm.rounds_tried == 25 and auc[0] > auc[1] and auc[0] > 0.75
    assert tm.model.stages[-1].getNumTrees == tm.rounds_kept
    assert tm.score(data).select("score").distinct().count() > 100
    # a missing number counts as 0, for a table and for records
    blank, zero = held.limit(5).withColumn("age", F.lit(None).cast("int")), held.limit(5).withColumn("age", F.lit(0))
    a, b = ([r.score for r in tm.score(x, keep=["row_id"]).orderBy("row_id").collect()] for x in (blank, zero))
    assert a == b
    first = held.orderBy("row_id").first().asDict()
    assert tm.score_records([first])[0]["score"] == pytest.approx(
        tm.score(held, keep=["row_id"]).orderBy("row_id").first().score)


def test_a_broken_bundle_is_reported(spark, model, tmp_path):
    tm, _ = model
    tm.save(str(tmp_path / "b"))
    (tmp_path / "b" / "meta").joinpath("part-x.txt").write_text("not json")
    for f in (tmp_path / "b" / "meta").glob("part-0*"):
        f.write_text("not json")
    with pytest.raises(Exception) as e:
        training.load_model([str(tmp_path / "b")], R)
    assert not isinstance(e.value, FileNotFoundError)
    with pytest.raises(FileNotFoundError):
        training.load_model([str(tmp_path / "missing")], R)


def test_importance_sums_to_one(model):
    tm, _ = model
    imp = explain.feature_importance(tm).collect()
    assert len(imp) == len(tm.features) == 18
    assert abs(sum(r.importance for r in imp) - 1.0) < 1e-6 or sum(r.importance for r in imp) == 0


def test_save_load_roundtrip(spark, model):
    tm, data = model
    d = tempfile.mkdtemp(prefix="ratelens-bundle-")
    tm.save(os.path.join(d, "b"))
    back = training.load_model([os.path.join(d, "missing"), os.path.join(d, "b")], R)
    assert back.threshold == tm.threshold and back.features == tm.features
    assert (back.rounds_tried, back.rounds_kept) == (tm.rounds_tried, tm.rounds_kept)
    assert [tuple(x) for x in json.loads(spark.read.text(os.path.join(d, "b", "meta")).first()[0])["importance"]] == tm.importance()
    a = tm.score(data, keep=["row_id"]).orderBy("row_id").limit(20).collect()
    b = back.score(data, keep=["row_id"]).orderBy("row_id").limit(20).collect()
    assert [x.score for x in a] == [x.score for x in b]


def test_unseen_categories_score(spark, model):
    tm, _ = model
    form = facets.fill_defaults(RG._f(spark, SF_SMALL).select(*RG.FORM_FIELDS), R)  # 'Sales' etc. are unseen
    out = tm.score(form, keep=["row_id"]).where(F.col("score").isNull()).count()
    assert out == 0


def test_shapley_rows_sum_to_score_minus_background(spark, model):
    tm, data = model
    rows = explain.sample_rows(data.where("split = 'eval'"), "row_id", 5)
    bg = explain.sample_rows(data.where("split = 'train'"), "row_id", 1, 7)  # one background row
    phi = explain.shapley(tm, rows, bg, "row_id", n_perm=3)
    sums = {r.row_id: r.s for r in phi.groupBy("row_id").agg(F.sum("phi").alias("s")).collect()}
    fx = {r.row_id: r.score for r in tm.score(rows, keep=["row_id"]).collect()}
    fb = tm.score(bg, keep=["row_id"]).first().score
    assert len(sums) == 5
    for k, v in sums.items():
        assert abs(v - (fx[k] - fb)) < 1e-9


def test_fold_f1_and_search_log(spark):
    data = RG.model_data(spark, SF_SMALL).where("split = 'train'")
    f = training.fold_f1(data, R, SMALL, folds=7).collect()
    assert sorted(r.fold for r in f) == list(range(7)) and all(0.0 <= r.f1 <= 1.0 for r in f)
    log, best = training.search(data, R, n_trials=1, space_overrides={"n_estimators": 3, "max_depth": 2})
    rows = log.collect()
    assert len(rows) == 1 and rows[0].score == pytest.approx(rows[0].mean_f1 - 0.1 * rows[0].std_f1)
    assert (best is None) == (rows[0].score <= 0) and len(rows[0].fold_f1) == 7 and rows[0].budget == 1
    assert set(json.loads(rows[0].params)) == set(training.DEFAULT_PARAMS)


def test_permutation_importance_and_report(spark, model):
    tm, data = model
    imp = explain.permutation_importance(tm, data.where("split = 'eval'"), "row_id", "y").collect()
    assert len(imp) == len(tm.features) and all(r.importance is not None for r in imp)
    rep = training.model_report(tm, data, sample=5)
    assert set(rep) >= {"summary", "importance", "attribution", "roc", "pr", "sweep", "confusion", "class_report"}
    summary = {r.metric: r.value for r in rep["summary"].collect()}
    assert 0.0 <= summary["roc_auc"] <= 1.0 and rep["sweep"].count() == 18
    conf = sum(r["count"] for r in rep["confusion"].collect())
    assert conf == data.where("split = 'eval'").count()


def test_target_encoded_model_fits_on_train_only(spark):
    data = RG.model_data(spark, SF_SMALL)
    tm = training.train(data, R, SMALL, encoding="target")
    assert tm.features[0].endswith("_te") and len(tm.features) == 18
    # the encoder saw train rows only: its stats cover exactly the train split
    s = tm.score(data, keep=["row_id"]).agg(F.count("score"), F.min("score"), F.max("score")).first()
    assert s[0] == data.count() and 0.0 <= s[1] <= s[2] <= 1.0
