"""Prefix ensembles, halving search, shared folds and the stages a bundle holds."""

import json
import types

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from ratelens.operators import features, stats, training
from ratelens.operators.stages import PopulationScaler, SmoothedTargetEncoder
from ratelens.plans import registry as RG
from ratelens.roles import FACT_ROLES as R

from conftest import SF_SMALL

SMALL = {**training.DEFAULT_PARAMS, "n_estimators": 6, "max_depth": 3}


def test_first_rounds_equal_a_shorter_fit(spark):
    data = RG.model_data(spark, SF_SMALL)
    rows = training.with_weights(Pipeline(stages=training.feature_stages(R, SMALL)).fit(data).transform(data), R, 2.0)
    trees = training.gbt(SMALL, R).fit(rows)
    short = training.gbt({**SMALL, "n_estimators": 3}, R).fit(rows)
    some = training.first_rounds(trees, 3)
    assert some.getNumTrees == 3 and some.getFeaturesCol() == training.FEATURES
    a, b = ([r.score for r in training.positive_prob(m.transform(rows)).orderBy("row_id").select("score").collect()] for m in (some, short))
    assert a == b and training.first_rounds(trees, 9) is trees


def test_slices_keep_what_one_long_fit_keeps(spark, monkeypatch):
    data = RG.model_data(spark, SF_SMALL)
    monkeypatch.setattr(training, "FIRST_SLICE", 2)
    a = training.train(data, R, {**SMALL, "n_estimators": 7})
    monkeypatch.setattr(training, "FIRST_SLICE", 7)
    b = training.train(data, R, {**SMALL, "n_estimators": 7})
    assert (a.rounds_tried, a.rounds_kept, a.threshold) == (b.rounds_tried, b.rounds_kept, b.threshold)
    x, y = ([r.score for r in m.score(data, keep=["row_id"]).orderBy("row_id").limit(50).collect()] for m in (a, b))
    assert x == y


def test_search_halves_and_the_last_rung_has_all_rounds(spark):
    data = RG.model_data(spark, SF_SMALL).where("split = 'train'")
    log, best = training.search(data, R, n_trials=4, folds=2, space_overrides={"n_estimators": 5, "max_depth": 2}, first_rung=2)
    rows = log.orderBy("step").collect()
    assert [(r.rung, r.rounds) for r in rows] == [(0, 2)] * 4 + [(1, 4)] * 2 + [(2, 5)]
    for rung in (0, 1):
        mine = [r for r in rows if r.rung == rung]
        on = {r.trial for r in mine if r.went_on}
        assert on == {r.trial for r in rows if r.rung == rung + 1}
        assert min(r.score for r in mine if r.trial in on) >= max(r.score for r in mine if r.trial not in on)
    assert (best is None) == (rows[-1].score <= 0) and all(r.budget == 4 and len(r.fold_f1) == 2 for r in rows)
    if best:
        assert json.loads(rows[-1].params) == best


def test_the_search_query_runs_every_trial_of_the_library(spark, monkeypatch):
    class Folds(list):
        orderBy = collect = lambda self, *_: self

    def fold_f1(data, roles, params, *_):
        return Folds(types.SimpleNamespace(f1=params["learning_rate"]) for _ in range(training.N_FOLDS))

    monkeypatch.setattr(training, "fold_f1", fold_f1)
    monkeypatch.setattr(training, "shared_folds", lambda *_: None)
    rows = RG.QUERIES["search_log"](spark, SF_SMALL).collect()
    assert training.N_TRIALS == 80 and {r.budget for r in rows} == {80}
    assert {r.trial for r in rows if r.rung == 0} == set(range(80))


def test_shared_folds_give_the_f1_of_separate_pipelines(spark):
    data = RG.model_data(spark, SF_SMALL).where("split = 'train'")
    shared = training.shared_folds(data, R)
    assert shared is not None
    a = {r.fold: r for r in training.fold_f1(data, R, SMALL, folds=2, shared=shared).collect()}
    for k in a:
        tr = training.fill_missing(data.where(F.col("fold") != k), R)
        model = training.pipeline(R, SMALL).fit(training.with_weights(tr, R, training.auto_weight(tr, R)))
        held = training.positive_prob(model.transform(training.fill_missing(data.where(F.col("fold") == k), R)))
        c = training.ev.with_metrics(training.ev.threshold_counts(held, [0.5], "y", "score")).first()
        assert a[k].f1 == pytest.approx(c.f1) and a[k].rows == c.tp + c.fp + c.tn + c.fn
    one_fold = data.withColumn("role", F.when((F.col("fold") == 0) & (F.col("age") > 45), "only here").otherwise(F.col("role")))
    assert training.shared_folds(one_fold, R) is None


def test_target_encoder_stage_keeps_its_values_after_load(spark, tmp_path):
    d = RG._f(spark, SF_SMALL).select("row_id", "y", "dept", "role", "travel")
    d = d.unionByName(d.limit(1).withColumns({"row_id": F.lit("n"), "dept": F.lit(None).cast("string"), "role": F.lit("lonely")}))
    cols = ["dept", "role", "travel"]
    stage = SmoothedTargetEncoder(inputCols=cols, outputCols=[f"{c}_te" for c in cols], labelCol="y", smoothing=2.0, minSamplesLeaf=3)
    Pipeline(stages=[stage]).fit(d).write().overwrite().save(str(tmp_path / "p"))
    back = PipelineModel.load(str(tmp_path / "p"))
    unseen = d.limit(2).withColumn("role", F.lit("never seen"))
    plain = features.fit_target_encoding(d, cols, "y", 2.0, 3)
    for frame in (d, unseen):
        a, b = ([tuple(round(x, 12) for x in r) for r in f.orderBy("row_id").select(*[f"{c}_te" for c in cols]).collect()]
                for f in (back.transform(frame), plain.transform(frame)))
        assert a == b


def test_scaler_stage_keeps_its_values_after_load(spark, tmp_path):
    d = RG._f(spark, SF_SMALL).select("row_id", "age", "income", "constant_col")
    cols = ["age", "income", "constant_col"]
    stage = PopulationScaler(inputCols=cols, outputCols=[f"{c}_z" for c in cols])
    Pipeline(stages=[stage]).fit(d).write().overwrite().save(str(tmp_path / "p"))
    out = PipelineModel.load(str(tmp_path / "p")).transform(d).orderBy("row_id")
    want = stats.standardize(d, cols).orderBy("row_id")
    assert [r[:] for r in out.select(*[f"{c}_z" for c in cols]).collect()] == [r[:] for r in want.select(*cols).collect()]


@pytest.mark.parametrize("encoding", ["label", "target"])
def test_bundle_holds_encoder_and_scaler(spark, tmp_path, encoding):
    data = RG.model_data(spark, SF_SMALL)
    tm = training.train(data, R, SMALL, encoding=encoding)
    tm.save(str(tmp_path / "b"))
    back = training.load_model([str(tmp_path / "b")], R)
    assert [type(s).__name__ for s in back.model.stages][1] == "PopulationScalerModel" and len(back.model.stages) == 4
    a, b = ([r.score for r in m.score(data, keep=["row_id"]).orderBy("row_id").limit(50).collect()] for m in (tm, back))
    assert a == b


def test_written_features_are_split_into_bounded_files(spark):
    from ratelens.sources.tables import temporary
    back = temporary(spark.range(1000, numPartitions=1), "bounded", 100)
    files = back.groupBy(F.input_file_name()).count().collect()
    assert len(files) == 10 and all(r["count"] == 100 for r in files) and back.count() == 1000
