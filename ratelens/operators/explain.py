"""Explanations: importance table and Monte-Carlo Shapley attributions."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ratelens.operators.ranks import seeded_hash, seeded_sample
from ratelens.operators.training import FEATURES, TrainedModel, fill_missing
from ratelens.sources.tables import temporary

def feature_importance(tm: TrainedModel, top_n: int | None = None) -> DataFrame:
    """M9: (feature, importance) of the fitted trees, sorted, normalised to sum 1."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    imp = tm.model.stages[-1].featureImportances.toArray().tolist()
    df = spark.createDataFrame([(f, float(v)) for f, v in zip(tm.features, imp)], "feature string, importance double")
    df = df.orderBy(F.desc("importance"), "feature")
    return df.limit(top_n) if top_n else df


def _feature_model(tm: TrainedModel) -> PipelineModel:
    return PipelineModel(stages=tm.model.stages[:-1])


def shapley(tm: TrainedModel, rows: DataFrame, background: DataFrame, row_id: str, n_perm: int = 8,
            seed: int = 42) -> DataFrame:
    """Per-row, per-feature Shapley estimates ``(row_id, feature, phi)``.

    For each row and each of ``n_perm`` seeded feature orders, one background row is
    picked by hash (an equi-join on its index, no pair expansion); features are switched
    from the background to the row's values one at a time in that order; all hybrids
    are scored in one ``transform``; a feature's contribution is the score change when
    it is switched. The values of a row sum to its score minus the mean background
    score of its draws."""
    steps = _steps(tm, rows, background, row_id, range(n_perm), seed, paired=False)
    names = F.array(*[F.lit(f) for f in tm.features])
    phi = steps.where("_j >= 0").groupBy("_rid", "_j").agg(F.avg("_delta").alias("phi"))
    return phi.select(F.col("_rid").alias(row_id), names[F.col("_j")].alias("feature"), "phi")


def _steps(tm: TrainedModel, rows: DataFrame, background: DataFrame, row_id: str, perms: range, seed: int, paired: bool) -> DataFrame:
    """``(_rid, _perm, _j, _delta)``: the score change when feature ``_j`` is switched in the order of draw ``_perm``, and for ``_j``
    -1 the background row's score. ``paired``: draws 2k and 2k + 1 have one background row and opposite orders. No background,
    no rows."""
    fm, gbt, d = _feature_model(tm), tm.model.stages[-1], len(tm.features)
    x = fm.transform(fill_missing(rows, tm.roles)).select(F.col(row_id).alias("_rid"), vector_to_array(FEATURES).alias("_x"))
    bg = fm.transform(fill_missing(background, tm.roles)).select(vector_to_array(FEATURES).alias("_b"), seeded_hash(row_id, seed).alias("_h"))
    nb = bg.count()
    # numbering the (small, already sampled) background frame
    bg = bg.select("_b", (F.row_number().over(W.orderBy("_h")) - 1).alias("_bi"))
    draws = x.select("_rid", "_x", F.explode(F.sequence(F.lit(perms.start), F.lit(perms.stop - 1))).alias("_perm"))
    draws = draws.withColumn("_draw", F.expr("_perm div 2").cast("int") if paired else F.col("_perm"))
    draws = draws.withColumn(
        "_bi", F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "_rid", "_draw")), 1, 8), 16, 10)
                      .cast("long"), F.lit(max(nb, 1))).cast("int"))
    draws = draws.join(bg, "_bi")
    order = F.expr(f"transform(array_sort(transform(sequence(0, {d - 1}), j -> named_struct('h', "
                   f"md5(concat_ws('|', '{seed}', _rid, CAST(_draw AS STRING), CAST(j AS STRING))), 'j', j))), s -> s.j)")
    draws = draws.withColumn("_order", F.when(F.lit(paired) & (F.col("_perm") % 2 == 1), F.reverse(order)).otherwise(order))
    # position of feature j in the order, then hybrids for p = 0..d (p features switched)
    draws = draws.withColumn("_pos", F.expr(f"transform(sequence(0, {d - 1}), j -> array_position(_order, j) - 1)"))
    hyb = draws.select("_rid", "_perm", "_order", F.explode(F.sequence(F.lit(0), F.lit(d))).alias("_p"), "_x", "_b",
                       "_pos")
    hyb = hyb.withColumn(FEATURES, array_to_vector(F.expr(
        f"transform(sequence(0, {d - 1}), j -> IF(_pos[j] < _p, _x[j], _b[j]))")))
    scored = gbt.transform(hyb.select("_rid", "_perm", "_order", "_p", FEATURES)) \
        .select("_rid", "_perm", "_order", "_p", vector_to_array("probability")[1].alias("_s"))
    w = W.partitionBy("_rid", "_perm").orderBy("_p")
    return scored.select("_rid", "_perm", F.when(F.col("_p") == 0, F.lit(-1)).otherwise(F.get(F.col("_order"), F.col("_p") - 1)).alias("_j"),
                         (F.col("_s") - F.coalesce(F.lag("_s").over(w), F.lit(0.0))).alias("_delta"))


def attribution_rows(tm: TrainedModel, rows: DataFrame, background: DataFrame, row_id: str, pairs: int = 4, tolerance: float = 0.01,
                     most_pairs: int = 16, seed: int = 42) -> DataFrame:
    """M10 by row: ``(row_id, feature, phi, error, pairs, base)``. Orders come in pairs, forward and reversed, whose mean is one draw; ``error``
    is the standard error over a row's draws. Rows with a feature whose error exceeds ``tolerance`` get as many pairs again, up to
    ``most_pairs``; the others don't. A row's values sum to its score less ``base``, the mean score of its background rows. No
    background, no rows."""
    gathered, wanted, done = None, rows, 0
    while done < most_pairs:
        more = min(pairs if not done else done, most_pairs - done)
        steps = _steps(tm, wanted, background, row_id, range(2 * done, 2 * (done + more)), seed, paired=True)
        each = steps.groupBy("_rid", "_j", F.expr("_perm div 2").alias("_pair")).agg(F.avg("_delta").alias("_draw"))
        sums = each.groupBy("_rid", "_j").agg(F.count(F.lit(1)).alias("n"), F.sum("_draw").alias("s"), F.sum(F.col("_draw") ** 2).alias("q"))
        if gathered is not None:
            sums = gathered.unionByName(sums).groupBy("_rid", "_j").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")])
        gathered = temporary(sums, "attribution_sums")
        done += more
        variance = F.greatest(F.col("q") - F.col("s") ** 2 / F.col("n"), F.lit(0.0)) / F.greatest(F.col("n") - 1, F.lit(1))
        error = F.sqrt(variance / F.col("n"))
        unsure = gathered.where((F.col("_j") >= 0) & (error > tolerance)).select(F.col("_rid").alias(row_id)).distinct()
        if unsure.isEmpty():
            break
        wanted = rows.join(unsure, row_id, "left_semi")
    names = F.array(*[F.lit(f) for f in tm.features])
    base = gathered.where("_j = -1").select("_rid", (F.col("s") / F.col("n")).alias("base"))
    return gathered.where("_j >= 0").join(base, "_rid").select(
        F.col("_rid").alias(row_id), names[F.col("_j")].alias("feature"), (F.col("s") / F.col("n")).alias("phi"), error.alias("error"),
        F.col("n").alias("pairs"), "base")


def mean_abs_attribution(phi: DataFrame) -> DataFrame:
    """M10 summary: mean |phi| per feature, sorted."""
    return (phi.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs_phi"))
            .orderBy(F.desc("mean_abs_phi"), "feature"))


def sample_rows(df: DataFrame, row_id: str, k: int = 100, seed: int = 42) -> DataFrame:
    """The attribution sample: k rows in seeded-hash order."""
    return seeded_sample(df, row_id, k, seed)


def permutation_importance(tm: TrainedModel, rows: DataFrame, row_id: str, y: str, seed: int = 42) -> DataFrame:
    """M9 (model-agnostic): mean increase of log-loss when one feature's values are
    replaced by another row's values, per feature: ``(feature, importance)``.

    The donor of a row is the row half-way round the seeded-hash order (a derangement),
    found by an equi-join on exact global positions (two-level scan, no global window).
    Every (row, feature) hybrid is scored in one ``transform``."""
    from ratelens.operators.scans import cumulative, hash_buckets
    fm = _feature_model(tm)
    gbt = tm.model.stages[-1]
    d = len(tm.features)
    x = fm.transform(rows).select(F.col(row_id).alias("_rid"), F.col(y).alias("_y"),
                                  vector_to_array(FEATURES).alias("_x"), seeded_hash(row_id, seed).alias("_h"),
                                  F.lit(1).alias("_one"))
    pos = cumulative(x, ["_h"], ["_one"], bucketed=hash_buckets(x, "_h"), write_offsets=True).withColumnRenamed("cum__one", "_pos")
    total = rows.count()
    donors = pos.select(F.col("_pos").alias("_dpos"), F.col("_x").alias("_dx"))
    pairs = pos.withColumn("_dpos", F.pmod(F.col("_pos") - 1 + F.lit(total // 2), F.lit(total)) + 1) \
        .join(donors, "_dpos")
    hyb = pairs.select("_y", "_x", "_dx", F.explode(F.sequence(F.lit(-1), F.lit(d - 1))).alias("_j"))
    hyb = hyb.withColumn(FEATURES, array_to_vector(F.expr(
        f"transform(sequence(0, {d - 1}), k -> IF(k = _j, _dx[k], _x[k]))")))
    p = F.least(F.greatest(vector_to_array("probability")[1], F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = -(F.col("_y") * F.log(p) + (1 - F.col("_y")) * F.log(1 - p))
    scored = gbt.transform(hyb.select("_j", "_y", FEATURES)).select("_j", loss.alias("_loss"))
    # the mean increase is the difference of the mean losses; j = -1 is the rows' own
    means = temporary(scored.groupBy("_j").agg(F.avg("_loss").alias("_mean")), "permutation_losses")
    own = means.where("_j = -1").first()  # one number
    names = F.array(*[F.lit(f) for f in tm.features])
    return (means.where("_j >= 0")
            .select(names[F.col("_j")].alias("feature"),
                    (F.col("_mean") - F.lit(own._mean if own else None)).alias("importance"))
            .orderBy(F.desc("importance"), "feature"))
