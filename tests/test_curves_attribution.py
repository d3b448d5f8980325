"""ROC corners and per-row attributions."""

import random

import pytest
from pyspark.sql import functions as F

from ratelens.operators import evaluation as ev, explain, training
from ratelens.plans import registry as RG
from ratelens.roles import FACT_ROLES as R

from conftest import SF_SMALL


def corners(rows):
    """Kept (threshold, fp, tp) of (score, y) rows by second differences of the counts."""
    scores = sorted({s for s, _ in rows}, reverse=True)
    step = [(sum(y == 1 for s, y in rows if s == x), sum(y == 0 for s, y in rows if s == x)) for x in scores]
    keep = [i for i in range(len(scores)) if i in (0, len(scores) - 1) or step[i] != step[i + 1]]
    return [(scores[i], sum(n for _, n in step[:i + 1]), sum(p for p, _ in step[:i + 1])) for i in keep]


@pytest.mark.parametrize("n, values", [(4000, 3000), (500, 7), (300, 300), (1, 1)])
def test_corners_keep_the_curve(spark, n, values):
    rng = random.Random(n)
    rows = [(rng.randrange(values) / values, int(rng.random() < 0.1)) for _ in range(n)]
    df = spark.createDataFrame(rows, "score double, y int").repartition(5)
    got = ev.roc_corners(df).orderBy(F.desc_nulls_first("threshold")).collect()
    want = corners(rows)
    pos, neg = max(sum(y for _, y in rows), 1), max(sum(1 - y for _, y in rows), 1)
    assert [r.threshold for r in got] == [None] + [t for t, _, _ in want]
    if n > 1:
        assert [x for r in got[1:] for x in (r.fpr, r.tpr)] == pytest.approx([x for _, f, t in want for x in (f / neg, t / pos)])
        area = sum((b.fpr - a.fpr) * (a.tpr + b.tpr) / 2 for a, b in zip(got, got[1:]))
        assert area == pytest.approx(ev.curve_summary(df).first().roc_auc)
        assert len(got) < len({s for s, _ in rows}) + 1 or values < 10


def test_corners_of_no_rows(spark):
    assert [tuple(r) for r in ev.roc_corners(spark.createDataFrame([], "score double, y int")).collect()] == [(None, 0.0, 0.0)]


def test_attributions_by_row(spark):
    data = RG.model_data(spark, SF_SMALL)
    tm = training.train(data, R, {**training.DEFAULT_PARAMS, "n_estimators": 5, "max_depth": 3})
    rows = explain.sample_rows(data.where("split = 'eval'"), "row_id", 6)
    bg = explain.sample_rows(data.where("split = 'train'"), "row_id", 10, 7)
    got = explain.attribution_rows(tm, rows, bg, "row_id", pairs=2, tolerance=1e-3, most_pairs=4).collect()
    score = {r.row_id: r.score for r in tm.score(rows, keep=["row_id"]).collect()}
    for k, s in score.items():
        mine = [r for r in got if r.row_id == k]
        assert {r.feature for r in mine} == set(tm.features) and len({r.pairs for r in mine}) == 1
        assert sum(r.phi for r in mine) == pytest.approx(s - mine[0].base) and all(r.error >= 0 for r in mine)
        assert mine[0].pairs in (2, 4) and (mine[0].pairs == 4 or max(r.error for r in mine) <= 1e-3)
    assert explain.attribution_rows(tm, rows, bg.limit(0), "row_id").collect() == []
    assert explain.shapley(tm, rows, bg.limit(0), "row_id").collect() == []
