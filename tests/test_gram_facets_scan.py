"""Masked Gram correlations, the bitmap facet index and the checked CSV scan."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratelens.operators import facets, stats
from ratelens.operators.facet_index import FacetIndex
from ratelens.sources import files


def test_masked_gram_equals_pairwise_complete_correlations(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 40)) * rng.uniform(0.1, 1e4, 40) + rng.uniform(-1e5, 1e5, 40)
    x[:, 1] += x[:, 0]
    x[:, 7] = 80.0
    for c in range(0, 40, 3):
        x[rng.random(300) < 0.3, c] = np.nan
    x[:, 12] = np.nan
    names = [f"c.{i}" if i == 5 else f"c{i}" for i in range(40)]
    pdf = pd.DataFrame(x, columns=names)
    rows = [[None if np.isnan(v) and i % 2 else float(v) for v in r] for i, r in enumerate(x)]  # null or NaN: both missing
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` double" for n in names))
    got = {(r.c1, r.c2): r.r for r in stats.corr_long(df).collect()}
    want = pdf.corr()
    assert len(got) == 1600
    for a in names:
        for b in names:
            w = want.loc[a, b]
            if np.isnan(w):
                assert got[a, b] is None, (a, b)
            else:
                assert got[a, b] == pytest.approx(w, abs=1e-9), (a, b)


def test_two_hundred_columns_with_nulls_are_one_gram_job(spark):
    df = spark.range(2000).select(*[
        F.when(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(5)) > 0, F.pmod(F.xxhash64("id", F.lit(-1 - i)), F.lit(1000)).cast("double"))
        .alias(f"c{i}") for i in range(200)])
    got = stats.corr_long(df).where("i <= 2 and j <= 2").toPandas()
    want = df.select("c0", "c1", "c2").toPandas().corr()
    for r in got.itertuples():
        assert r.r == pytest.approx(want.loc[r.c1, r.c2], abs=1e-9)


def test_correlations_of_no_rows_and_no_columns(spark):
    df = spark.createDataFrame([], "a double, b int, s string")
    assert [(r.c1, r.c2, r.r) for r in stats.corr_long(df).collect()] == [
        ("a", "a", None), ("a", "b", None), ("b", "a", None), ("b", "b", None)]
    assert stats.corr_long(df.select("s")).count() == 0


def _people(spark, n=70_000):
    """Over two buckets of bitmaps, with nulls, NaN and ties."""
    h = lambda k, m: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(m))
    return spark.range(n, numPartitions=3).select(
        F.when(h(1, 9) > 0, F.concat(F.lit("d"), h(2, 4))).alias("dept"), h(3, 5).cast("int").alias("level"),
        h(4, 2).cast("int").alias("y"), F.when(h(5, 11) > 0, h(6, 60)).cast("int").alias("age"),
        F.when(h(7, 50) == 0, F.lit(float("nan"))).otherwise(h(8, 100_000) / 7.0).alias("pay"))


@pytest.fixture(scope="module")
def people(spark):
    df = _people(spark)
    return df, FacetIndex.build(df, ["dept", "level", "y"], ["age", "pay"], bins=16)


@pytest.mark.parametrize("isin, ranges", [
    ({}, {}), ({"dept": ["d1", "d3"]}, {}), ({"dept": ["d1"], "level": [0, 4]}, {"age": (20, 45)}),
    ({}, {"age": (7, 7), "pay": (123.0, 9876.5)}), ({"dept": []}, {}), ({"level": [9]}, {"age": (0, 60)}),
    ({}, {"pay": (float("-inf"), float("inf"))}), ({}, {"pay": (5.0, 4.0)}), ({"level": [1]}, {"pay": (-5.0, 1e9), "age": (59, 99)})])
def test_facet_index_counts_as_the_predicate_does(people, isin, ranges):
    df, index = people
    predicate = facets.facet_predicate(isin, ranges)
    assert index.share(isin, ranges).first() == facets.filter_share(df, predicate).first()
    got = {(r.facet, r.value): (r.total, r.positives) for r in index.rates("y", 1, isin, ranges).collect()}
    want = {}
    for c in ("dept", "level"):
        for r in df.where(predicate & F.col(c).isNotNull()).groupBy(c).agg(F.count("y").alias("n"), F.sum("y").alias("p")).collect():
            want[c, str(r[c])] = (r.n, r.p)
    assert got == want


def test_facet_index_of_no_rows(spark):
    index = FacetIndex.build(_people(spark, 0), ["dept", "y"], ["age"])
    assert index.share({"dept": ["d1"]}).first() == (0, 0, None)
    assert index.rates("y", 1).count() == 0


def test_facet_selection_reads_bitmaps_only(people):
    _, index = people
    plan = index.selection({"dept": ["d1"]}, {"age": (20, 45)})._jdf.queryExecution().executedPlan().toString()
    assert "facet-rows" not in plan and "PushedFilters: [Or(And(EqualTo(facet" in plan.replace("IsNotNull(facet), ", "")


def test_checked_scan_counts_every_bad_cell(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name,x\n1,ann,2.5\ntwo,bob,1.0\n3,,\n4,dan,1.5,7\n5,eve\nsix,fay,none\n")
    (tmp_path / "b.csv").write_text("id,name,x\n7,\"g, h\",0.5\n")
    schema = T.StructType().add("id", "integer").add("name", "string").add("x", "double")
    rows, rejected = files.checked_scan(spark, str(tmp_path), schema)
    assert sorted(map(tuple, rows.collect())) == [(1, "ann", 2.5), (3, None, None), (7, "g, h", 0.5)]
    assert sorted((r.line, r.cells) for r in rejected.collect()) == [
        ("4,dan,1.5,7", []), ("5,eve", []), ("six,fay,none", ["id", "x"]), ("two,bob,1.0", ["id"])]
    assert rows.select("name").count() == 3 and all(r.file.endswith("a.csv") for r in rejected.collect())


def test_checked_scan_refuses_another_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,other\n1,2\n")
    with pytest.raises(Exception, match="header"):
        files.checked_scan(spark, str(tmp_path), T.StructType().add("id", "integer").add("name", "string"))


def test_facet_index_build_sorts_no_row_for_every_facet(spark):
    """Bitmaps come from the rows as they stand: no row times facets, and bounded tasks for the single values."""
    from ratelens.sources.tables import temporary
    plans = {}

    def keep(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return temporary(df, name)

    FacetIndex.build(_people(spark, 100), ["dept", "level", "y"], ["age", "pay"], keep=keep)
    assert "Generate explode" not in plans["facet-bitmaps"] and "bitmap_construct_agg" not in plans["facet-bitmaps"]
    assert "bucket" in next(line for line in plans["facet-values"].splitlines() if "RepartitionByExpression" in line)


def test_partial_bitmaps_of_scattered_buckets():
    import pyarrow as pa

    from ratelens.operators.facet_index import _partial_bitmaps
    batch = pa.record_batch({"_bucket": pa.array([7, 7, 9, 7]), "_position": pa.array([0, 9, 1, 32767]), "dept": ["a", None, "a", "a"],
                             "age": pa.array([1.0, 2.0, None, 5.0])})
    got = [r for out in _partial_bitmaps(("dept",), {"age": [2.0, 4.0]})(iter([batch])) for r in out.to_pylist()]
    bits = {(r["facet"], r["value"], r["bucket"], [i for i in range(32768) if r["bits"][i // 8] >> i % 8 & 1][0]) for r in got}
    assert bits == {("dept", "a", 7, 0), ("dept", None, 7, 9), ("age", "0", 7, 0), ("age", "1", 7, 9),
                    ("dept", "a", 9, 1), ("age", None, 9, 1), ("dept", "a", 7, 32767), ("age", "2", 7, 32767)}
    assert all(len(r["bits"]) == 4096 for r in got)
