"""Training, validation, search and scoring.

The model is a Spark ML pipeline: StringIndexer (or smoothed target encoding) -> population scaler of the
numbers -> VectorAssembler -> GBTClassifier; a saved bundle holds every fitted stage.
"""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelens.operators import evaluation as ev
from ratelens.operators.features import label_indexer, weight_column
from ratelens.operators.stages import PopulationScaler, SmoothedTargetEncoder
from ratelens.roles import Roles
from ratelens.sources.tables import drop_tables, temporary

# fixed values: search space of the tuned classifier (name, low, high, integer?)
SEARCH_SPACE = [
    ("n_estimators", 100, 500, True),
    ("learning_rate", 0.05, 0.2, False),
    ("max_depth", 3, 8, True),
    ("subsample", 0.6, 0.9, False),
    ("colsample_bytree", 0.6, 0.9, False),
    ("scale_pos_weight", 0.5, 2.0, False),   # multiples of the automatic class weight
    ("min_child_weight", 5, 50, True),
    ("gamma", 0.0, 0.5, False),
]
STABILITY_PENALTY = 0.1      # score = mean F1 - 0.1 * std F1
N_FOLDS = 7
N_TRIALS = 80
FIRST_RUNG = 8               # rounds of every trial in the search's first rung
SEED = 42

PATIENCE = 20
ROWS_PER_FILE = 20_000       # of written features: rows that a fit caches are spread over tasks of bounded size
ROWS_PER_TASK = 500_000      # of a fit, once each core has a task: every task sends its sums at every level of every tree
FIRST_SLICE = 25             # rounds of the first fit; later ones double until validation stops improving

DEFAULT_PARAMS = {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 5, "subsample": 0.8,
                  "colsample_bytree": 0.8, "min_child_weight": 5, "gamma": 0.0, "scale_pos_weight": 1.0}

FEATURES = "features"
WEIGHT = "_w"
MODEL_TYPE = "gbt"


def feature_names(roles: Roles, encoding: str = "label") -> list[str]:
    suffix = "_code" if encoding == "label" else "_te"
    return [f"{c}{suffix}" for c in roles.categoricals] + list(roles.numerics)


def gbt(params: dict, roles: Roles, seed: int = SEED) -> GBTClassifier:
    """M6: boosted trees with the tuned parameters mapped onto Spark's names (L1/L2
    penalties have no Spark counterpart and are not searched)."""
    return GBTClassifier(featuresCol=FEATURES, labelCol=roles.label, maxIter=int(params["n_estimators"]),
                         stepSize=float(params["learning_rate"]), maxDepth=int(params["max_depth"]),
                         subsamplingRate=float(params["subsample"]),
                         featureSubsetStrategy=str(float(params["colsample_bytree"])),
                         minInstancesPerNode=int(params["min_child_weight"]), minInfoGain=float(params["gamma"]),
                         weightCol=WEIGHT, seed=seed, cacheNodeIds=False)


def feature_stages(roles: Roles, params: dict, encoding: str = "label") -> list:
    """Encoder, scaler and assembler; numbers enter the vector scaled, under their own names in ``feature_names``."""
    cats, nums = list(roles.categoricals), list(roles.numerics)
    if encoding == "target":
        first = SmoothedTargetEncoder(inputCols=cats, outputCols=[f"{c}_te" for c in cats], labelCol=roles.label,
                                      smoothing=float(params.get("smoothing", 1.0)),
                                      minSamplesLeaf=int(params.get("min_samples_leaf", 1)))
    else:
        first = label_indexer(cats)
    own = [f"{c}_z" if c in nums else c for c in feature_names(roles, encoding)]
    return [first, PopulationScaler(inputCols=nums, outputCols=[f"{c}_z" for c in nums]),
            VectorAssembler(inputCols=own, outputCol=FEATURES, handleInvalid="keep")]


def pipeline(roles: Roles, params: dict, encoding: str = "label") -> Pipeline:
    return Pipeline(stages=[*feature_stages(roles, params, encoding), gbt(params, roles)])


def first_rounds(trees: GBTClassificationModel, rounds: int) -> GBTClassificationModel:
    """The ensemble of the first ``rounds`` trees and weights of a fitted one: what the same seeded fit gives when it stops
    there, without a second fit."""
    if rounds >= trees.getNumTrees:
        return trees
    from pyspark.sql import SparkSession
    java, jvm = trees._java_obj, SparkSession.getActiveSession().sparkContext._jvm
    gateway = SparkSession.getActiveSession().sparkContext._gateway
    own = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, rounds)
    weights = gateway.new_array(jvm.double, rounds)
    for i, (tree, weight) in enumerate(zip(list(java.trees())[:rounds], trees.treeWeights[:rounds])):
        own[i], weights[i] = tree, float(weight)
    some = jvm.org.apache.spark.ml.classification.GBTClassificationModel(java.uid(), own, weights, java.numFeatures(), java.numClasses())
    return GBTClassificationModel(java.copyValues(some, jvm.org.apache.spark.ml.param.ParamMap.empty()))


def fill_missing(df: DataFrame, roles: Roles) -> DataFrame:
    """Missing numeric features count as 0, in training and in scoring alike."""
    return df.fillna(0, [c for c in roles.numerics if c in df.columns])


def kept_rounds(losses: Sequence[float], patience: int = PATIENCE) -> int:
    """Rounds to keep: up to the least validation loss seen before ``patience`` rounds passed without a lower one."""
    best, at = float("inf"), 0
    for i, loss in enumerate(losses):
        if loss < best:
            best, at = loss, i
        elif i - at >= patience:
            break
    return at + 1


def with_weights(df: DataFrame, roles: Roles, positive_weight: float) -> DataFrame:
    return df.withColumn(WEIGHT, weight_column(roles.label, positive_weight))


def auto_weight(df: DataFrame, roles: Roles) -> float:
    """M5 as a number: n_neg / n_pos of the training rows (one aggregate)."""
    row = df.agg(F.count_if(F.col(roles.label) == 0).alias("neg"), F.count_if(F.col(roles.label) == 1).alias("pos")) \
        .first()
    return float(row.neg) / row.pos if row.pos else 1.0


def positive_prob(df: DataFrame, name: str = "score") -> DataFrame:
    """Probability of the positive class as a plain double column."""
    return df.withColumn(name, vector_to_array(F.col("probability"))[1])


@dataclass
class TrainedModel:
    model: PipelineModel
    roles: Roles
    encoding: str
    params: dict
    threshold: float = 0.5
    features: list[str] = field(default_factory=list)
    positive_weight: float = 1.0
    rounds_tried: int = 0
    rounds_kept: int = 0
    cv_score: float | None = None
    trials: list[dict] = field(default_factory=list)

    def score(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """M8: batch scoring of full records: missing numbers 0, encode, assemble, predict;
        ``score >= threshold`` -> 1. ``keep`` columns are returned as given."""
        held = {c: f"_keep_{i}" for i, c in enumerate(keep)}
        own = fill_missing(df.withColumns({n: F.col(c) for c, n in held.items()}), self.roles)
        out = positive_prob(self.model.transform(own))
        return out.select(*[F.col(n).alias(c) for c, n in held.items()], "score",
                          (F.col("score") >= F.lit(self.threshold)).cast("int").alias("prediction"))

    def score_records(self, records: Sequence[dict]) -> list[dict]:
        """Score a few records given as dictionaries (missing numbers 0, missing categories unseen)."""
        from pyspark.sql import SparkSession
        cats, nums = self.roles.categoricals, self.roles.numerics
        rows = [tuple([r.get(c) for c in cats] + [None if r.get(c) is None else float(r[c]) for c in nums] + [i])
                for i, r in enumerate(records)]
        schema = ", ".join([*[f"`{c}` string" for c in cats], *[f"`{c}` double" for c in nums], "_n int"])
        df = SparkSession.getActiveSession().createDataFrame(rows, schema)
        return [{"score": r.score, "prediction": r.prediction}
                for r in self.score(df, keep=["_n"]).orderBy("_n").collect()]

    def importance(self) -> list[tuple[str, float]]:
        return sorted(zip(self.features, self.model.stages[-1].featureImportances.toArray().tolist()),
                      key=lambda x: (-x[1], x[0]))

    def save(self, path: str) -> None:
        """The pipeline in Spark ML format plus a small JSON of everything else: model type,
        threshold, feature order, parameters, encoding, rounds, importance, best cross-validation
        score and the log of every trial with its fold scores."""
        self.model.write().overwrite().save(os.path.join(path, "model"))
        meta = {"model_type": MODEL_TYPE, "encoding": self.encoding, "params": self.params, "threshold": self.threshold,
                "features": self.features, "positive_weight": self.positive_weight, "rounds_tried": self.rounds_tried,
                "rounds_kept": self.rounds_kept, "importance": self.importance(), "cv_score": self.cv_score,
                "trials": self.trials}
        from pyspark.sql import SparkSession
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1) \
            .write.mode("overwrite").text(os.path.join(path, "meta"))


def load_model(paths: Sequence[str], roles: Roles) -> TrainedModel:
    """Load the first bundle that exists among ``paths``. Only a location without a bundle is
    passed over; one that can't be read raises."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        meta_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(os.path.join(p, "meta"))
        if not meta_path.getFileSystem(conf).exists(meta_path):
            continue
        model = PipelineModel.load(os.path.join(p, "model"))
        meta = json.loads(spark.read.text(os.path.join(p, "meta")).first()[0])
        if meta.get("model_type", MODEL_TYPE) != MODEL_TYPE:
            raise ValueError(f"{p}: a bundle of type {meta['model_type']}")
        return TrainedModel(model, roles, meta["encoding"], meta["params"], meta["threshold"], meta["features"],
                            meta["positive_weight"], meta["rounds_tried"], meta["rounds_kept"], meta["cv_score"],
                            meta["trials"])
    raise FileNotFoundError("no model bundle found: " + "; ".join(paths))


def train(data: DataFrame, roles: Roles, params: dict | None = None, encoding: str = "label",
          split: str = "split", train_name: str = "train", val_name: str = "test") -> TrainedModel:
    """M6: fit rounds on the train split in slices, positives weighted by ``scale_pos_weight`` x n_neg/n_pos;
    measure the loss of each round on the test split and keep the rounds up to the best one before
    ``PATIENCE`` rounds without improvement (the first trees of the one fit); then choose the
    F1-best grid threshold on the test split (E2)."""
    params = dict(DEFAULT_PARAMS if params is None else params)
    data = fill_missing(data, roles)
    train_rows = data.where(F.col(split) == train_name)
    val_rows = data.where(F.col(split) == val_name)
    w = auto_weight(train_rows, roles) * float(params.get("scale_pos_weight", 1.0))
    # encoders and assembler are fitted on the train split only (no validation labels leak
    # into a target encoding)
    stages = pipeline(roles, params, encoding).getStages()
    features_model = Pipeline(stages=stages[:-1]).fit(train_rows)
    own = [FEATURES, roles.label, WEIGHT]
    fit_rows = temporary(with_weights(features_model.transform(train_rows), roles, w).select(*own), "fit_rows", ROWS_PER_FILE)
    check_rows = temporary(with_weights(features_model.transform(val_rows), roles, w).select(*own), "check_rows", ROWS_PER_FILE)
    trees, tried, kept = _fitted_rounds(fit_rows, check_rows, params, roles)
    drop_tables(fit_rows, check_rows)
    model = PipelineModel(stages=[*features_model.stages, trees])
    tm = TrainedModel(model, roles, encoding, params, 0.5, feature_names(roles, encoding), w, tried, kept)
    scored = tm.score(val_rows, keep=[roles.label])
    best = ev.best_threshold(scored, y=roles.label).first()
    tm.threshold = float(best.threshold) if best is not None and best.threshold is not None else 0.5
    return tm


def shared_folds(data: DataFrame, roles: Roles, fold_col: str = "fold") -> DataFrame | None:
    """``(features, label, fold)`` with label codes, written once for all folds; None if some category occurs in one fold
    only, where that fold's encoder would not know it. Otherwise every fold's encoder has the same labels. Numbers stay unscaled:
    trees don't change with a feature's scale."""
    cats = list(roles.categoricals)
    data = fill_missing(data, roles)
    seen = (data.select(fold_col, *[F.col(c).cast("string").alias(c) for c in cats])
                .unpivot([fold_col], cats, "variable", "category").where(F.col("category").isNotNull())
                .groupBy("variable", "category").agg(F.min(fold_col).alias("a"), F.max(fold_col).alias("b")))
    if not seen.where("a = b").isEmpty():
        return None
    stages = [label_indexer(cats), VectorAssembler(inputCols=feature_names(roles), outputCol=FEATURES, handleInvalid="keep")]
    coded = Pipeline(stages=stages).fit(data).transform(data)
    return temporary(coded.select(FEATURES, roles.label, fold_col), "fold_features", ROWS_PER_FILE)


def in_tasks(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in a partition for each ``ROWS_PER_TASK`` of its ``rows`` and for each core at least, or as it is if it has fewer."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK)))


def fits_at_once(rows: int, cores: int, most: int) -> int:
    """Fits that run side by side: while they cache no more than ``ROWS_PER_TASK`` rows a core, and two beyond that, as more
    would push each other's rows out of memory."""
    return max(1, min(most, max(2, cores * ROWS_PER_TASK // max(rows, 1))))


def _fitted_rounds(fit_rows: DataFrame, check_rows: DataFrame, params: dict, roles: Roles) -> tuple[GBTClassificationModel, int, int]:
    """The kept ensemble, the rounds fitted and the rounds kept. Rounds are fitted in slices of ``FIRST_SLICE``, twice that and so on
    (a longer seeded fit begins with the shorter one's trees) until validation has stopped improving."""
    most = int(params["n_estimators"])
    checked = not check_rows.isEmpty()
    tried = min(FIRST_SLICE, most) if checked else most
    fit_rows = in_tasks(fit_rows, fit_rows.count())
    while True:
        trees = gbt({**params, "n_estimators": tried}, roles).fit(fit_rows)
        tried = trees.getNumTrees
        kept = kept_rounds(trees.evaluateEachIteration(check_rows)) if checked else tried
        if tried >= most or tried - kept >= PATIENCE:
            return first_rounds(trees, kept), tried, kept
        tried = min(2 * tried, most)


def fold_f1(data: DataFrame, roles: Roles, params: dict, fold_col: str = "fold", encoding: str = "label",
            folds: int = N_FOLDS, parallelism: int = N_FOLDS, shared: DataFrame | None = None) -> DataFrame:
    """F1 (threshold 0.5) of each held-out fold: (fold, f1, rows). The k fits are
    independent Spark jobs submitted from a few driver threads, as CrossValidator does. With label codes they read the
    features of ``shared_folds`` (handed in as ``shared``, or made here); other encodings are fitted for each fold."""
    from concurrent.futures import ThreadPoolExecutor
    if shared is None and encoding == "label":
        shared = shared_folds(data, roles, fold_col)
    data = fill_missing(data, roles) if shared is None else shared
    stages = pipeline(roles, params, encoding) if shared is None else Pipeline(stages=[gbt(params, roles)])
    classes = {(r[0], r[1]): r["n"] for r in data.groupBy(fold_col, roles.label).agg(F.count(F.lit(1)).alias("n")).collect()}

    def one(k: int) -> DataFrame:
        neg, pos = (sum(n for (f, y), n in classes.items() if f is not None and f != k and y == c) for c in (0, 1))
        w = (float(neg) / pos if pos else 1.0) * float(params.get("scale_pos_weight", 1.0))
        rows = sum(n for (f, _), n in classes.items() if f is not None and f != k)
        model = stages.fit(in_tasks(with_weights(data.where(F.col(fold_col) != k), roles, w), rows))
        held = positive_prob(model.transform(data.where(F.col(fold_col) == k)))
        c = ev.with_metrics(ev.threshold_counts(held, [0.5], roles.label, "score"))
        return c.select(F.lit(k).alias("fold"), "f1", (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"))
                        .alias("rows"))

    cores = data.sparkSession.sparkContext.defaultParallelism
    with ThreadPoolExecutor(max_workers=fits_at_once(sum(classes.values()), cores, parallelism)) as pool:
        parts = list(pool.map(one, range(folds)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sample_params(n: int, seed: int = SEED) -> list[dict]:
    """Seeded random draws from the search space (re-aimed from a Gaussian-process search)."""
    rng = np.random.RandomState(seed)
    out = []
    for _ in range(n):
        p = {}
        for name, lo, hi, is_int in SEARCH_SPACE:
            p[name] = int(rng.randint(lo, hi + 1)) if is_int else float(rng.uniform(lo, hi))
        out.append(p)
    return out


def search(data: DataFrame, roles: Roles, n_trials: int = N_TRIALS, folds: int = N_FOLDS,
           fold_col: str = "fold", encoding: str = "label", seed: int = SEED, parallelism: int = N_FOLDS,
           space_overrides: dict | None = None, first_rung: int = FIRST_RUNG) -> tuple[DataFrame, dict | None]:
    """M7: cross-validated search by successive halving. Every trial draws its parameters and is fitted on the fixed folds
    (``fold_f1``, features prepared once) for ``first_rung`` rounds; the better half of a rung goes on with twice the rounds, and the
    last one with all of its own. A score is mean F1 - 0.1 * std; the best is the last rung's first strict improvement over 0.

    Returns the log (a row for each rung and trial: its rounds, fold scores, whether it went on, and the ``budget`` of trials
    the caller gave) and the best parameters. Running best: ``ranks.running_max`` by ``step``."""
    trials = sample_params(n_trials, seed)
    for p in trials:
        p.update(space_overrides or {})
    shared = shared_folds(data, roles, fold_col) if encoding == "label" else None
    rows, alive, rung, rounds = [], list(range(n_trials)), 0, first_rung
    known: dict[tuple[int, int], tuple[list[float], float, float, float]] = {}
    best, best_score = None, 0.0
    while alive:
        last = len(alive) == 1
        for t in alive:
            n = trials[t]["n_estimators"] if last else min(rounds, trials[t]["n_estimators"])
            if (t, n) not in known:
                got = fold_f1(data, roles, {**trials[t], "n_estimators": n}, fold_col, encoding, folds, parallelism, shared)
                f1 = [float(r.f1) for r in got.orderBy("fold").collect()]
                mean, std = float(np.mean(f1)), float(np.std(f1))
                known[t, n] = f1, mean, std, mean - STABILITY_PENALTY * std
            rows.append([len(rows), rung, t, n_trials, n, json.dumps(trials[t], sort_keys=True), *known[t, n]])
            if last and known[t, n][3] > best_score:
                best_score, best = known[t, n][3], dict(trials[t])
        of_rung = {r[2]: r[-1] for r in rows if r[1] == rung}
        kept = sorted(alive, key=lambda t: (-of_rung[t], t))[:len(alive) // 2]
        for r in rows:
            if r[1] == rung:
                r.append(r[2] in kept)
        alive, rung, rounds = kept, rung + 1, rounds * 2
    log = data.sparkSession.createDataFrame(
        rows, "step int, rung int, trial int, budget int, rounds int, params string, fold_f1 array<double>, mean_f1 double, "
              "std_f1 double, score double, went_on boolean")
    return log, best


def tune(data: DataFrame, roles: Roles, n_trials: int = N_TRIALS, split: str = "split", train_name: str = "train",
         **kwargs) -> TrainedModel:
    """Search on the train split, then train with the best parameters; the bundle carries the log."""
    log, best = search(data.where(F.col(split) == train_name), roles, n_trials, **kwargs)
    tm = train(data, roles, best, kwargs.get("encoding", "label"), split, train_name)
    tm.trials = [r.asDict() for r in log.orderBy("step").collect()]
    tm.cv_score = max((t["score"] for t in tm.trials), default=None)
    return tm


def model_report(tm: TrainedModel, data: DataFrame, split: str = "split", eval_name: str = "eval",
                 train_name: str = "train", sample: int = 100, seed: int = SEED,
                 parts: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Every evaluation table of a trained model, by name (or only ``parts``). The
    scored table is written at most once (shared checkpoint folder), and only what the asked parts need is computed."""
    from ratelens.operators import explain
    from ratelens.operators.ranks import seeded_sample
    spark, y = data.sparkSession, tm.roles.label
    written: list[DataFrame] = []

    def scored() -> DataFrame:
        if not written:
            written.append(temporary(tm.score(data, keep=[y, split]), "scored"))
        return written[0]

    def held_out() -> DataFrame:
        return scored().where(F.col(split) == eval_name)

    def summary() -> DataFrame:
        c = ev.curve_summary(held_out(), y).first()
        g = ev.f1_gap(scored(), split, tm.threshold, train_name, eval_name, y).first()
        v = ev.verdicts(c.roc_auc, c.avg_precision, g.f1_gap)
        return spark.createDataFrame(
            [("roc_auc", c.roc_auc, v.get("roc")), ("avg_precision", c.avg_precision, v.get("pr")),
             ("base_rate", c.base_rate, None), ("threshold", tm.threshold, None), ("f1_train", g.f1_train, None),
             ("f1_eval", g.f1_eval, None), ("f1_gap", g.f1_gap, v.get("overfit"))],
            "metric string, value double, verdict string")

    def info() -> DataFrame:
        known = {"model_type": MODEL_TYPE, "encoding": tm.encoding, "params": tm.params, "threshold": tm.threshold,
                 "features": tm.features, "rounds_tried": tm.rounds_tried, "rounds_kept": tm.rounds_kept,
                 "cv_score": tm.cv_score}
        return spark.createDataFrame([(k, json.dumps(val)) for k, val in known.items()], "key string, value string")

    def attribution() -> DataFrame:
        rows = seeded_sample(data.where(F.col(split) == eval_name), "row_id", sample, seed)
        bg = seeded_sample(data.where(F.col(split) == train_name), "row_id", max(1, sample // 2), seed + 1)
        return explain.mean_abs_attribution(explain.shapley(tm, rows, bg, "row_id", seed=seed))

    builders = {
        "info": info, "summary": summary, "importance": lambda: explain.feature_importance(tm), "attribution": attribution,
        "roc": lambda: ev.roc_corners(held_out(), y), "pr": lambda: ev.pr_points(held_out(), y),
        "sweep": lambda: ev.threshold_sweep(held_out(), y=y),
        "confusion": lambda: ev.confusion(held_out(), tm.threshold, y),
        "class_report": lambda: ev.class_report(held_out(), tm.threshold, y),
    }
    return {k: b() for k, b in builders.items() if parts is None or k in parts}
