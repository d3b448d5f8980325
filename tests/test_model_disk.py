"""What model queries write, shuffle and leave behind; the split without moving rows."""

import os
import time

import pytest
from pyspark.sql import functions as F

from ratelens.operators import ranks, training
from ratelens.plans import registry as RG
from ratelens.roles import FACT_ROLES as R
from ratelens.session import checkpoint_dir
from ratelens.sources import tables

from conftest import SF_SMALL

SMALL = {**training.DEFAULT_PARAMS, "n_estimators": 3, "max_depth": 2}


def labelled(spark, n, copies=1):
    return spark.range(n * copies).select((F.col("id") % n).cast("string").alias("rid"), F.col("id").alias("place"),
                                          F.when(F.col("id") % n % 5 == 0, 1).when(F.col("id") % n % 11 != 1, 0).alias("y"))


@pytest.mark.parametrize("n", [1, 2, 3, 7, 400])
def test_cut_split_is_the_stratified_split(spark, n):
    df = labelled(spark, n)
    a = {(r.rid, r.y): r.split for r in ranks.stratified_split(df, "rid", "y").collect()}
    b = {(r.rid, r.y): r.split for r in ranks.cut_split(df, "rid", "y", ["place"]).collect()}
    assert a == b and len(b) == n


def test_cut_split_parts_rows_of_one_id(spark):
    """Thirteen ids of nine equal rows each: cuts fall between equal ids, and every class is still cut exactly."""
    df = labelled(spark, 13, copies=9)
    count = lambda s: {(r.y, r.split): r["count"] for r in s.groupBy("y", "split").count().collect()}
    ours = ranks.cut_split(df, "rid", "y", ["place"])
    assert count(ours) == count(ranks.stratified_split(df, "rid", "y")) and ours.columns == ["rid", "y", "split"]
    assert ranks.cut_split(df.where("false"), "rid", "y", ["place"]).count() == 0


def test_packed_rows_come_back_as_the_view_has_them(spark):
    view = tables.fact(spark, SF_SMALL)
    same = tables.unpacked(tables.packed(view))
    assert same.dtypes == view.dtypes and same.exceptAll(view).isEmpty() and view.exceptAll(same).isEmpty()
    parts = RG.split_data(spark, SF_SMALL)
    ranked = RG.model_data(spark, SF_SMALL).select(*parts.columns)
    assert ranked.exceptAll(parts).isEmpty() and parts.exceptAll(ranked).isEmpty()


def test_tables_leave_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {x for x in disk.getAllBlocks().mkString(" ").split() if x.startswith("shuffle_")}
    counted = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    was, before = spark.conf.get(tables._CLEANUP, None), shuffled()
    made = [tables.temporary(counted, "counted"), tables.materialize(spark, lambda: counted, "counted", str(time.time()))]
    end = time.time() + 20
    while shuffled() - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffled() - before and [t.count() for t in made] == [7, 7] and spark.conf.get(tables._CLEANUP, None) == was


def test_training_drops_its_features(spark):
    folder = os.path.join(checkpoint_dir(spark).removeprefix("file:"), "ratelens-temporary")
    held = lambda: {x for x in os.listdir(folder) if x.startswith(("fit_rows", "check_rows"))}
    tables.temporary(spark.range(1), "any")
    before = held()
    tm = training.train(RG.split_data(spark, SF_SMALL), R, SMALL)
    assert held() == before and 1 <= tm.rounds_kept <= 3


def test_a_fit_has_no_more_tasks_than_its_rows_need(spark, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    parts = lambda rows, n: training.in_tasks(spark.range(0, 1000, 1, n), rows).rdd.getNumPartitions()
    assert parts(1000, 64) == cores and parts(1000, 2) == 2
    monkeypatch.setattr(training, "ROWS_PER_TASK", 10)
    assert parts(1000, 200) == 100


def test_folds_of_many_rows_are_fitted_two_at_a_time(spark, monkeypatch):
    assert [training.fits_at_once(n, 6, 7) for n in (0, 36_000, 360_000, 2_160_000, 10**9)] == [7, 7, 7, 2, 2]
    assert training.fits_at_once(10**9, 6, 1) == 1
    asked = []
    monkeypatch.setattr(training, "fits_at_once", lambda rows, *_: asked.append(rows) or 2)
    data = RG.model_data(spark, SF_SMALL).where("split = 'train'")
    assert training.fold_f1(data, R, SMALL, folds=2).count() == 2 and asked == [data.count()]
