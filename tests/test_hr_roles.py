"""The same analyses run on the original employee-table names (HR_ROLES) and the CSV sinks."""

import os
import tempfile

from pyspark.sql import functions as F

from ratelens.operators import stats
from ratelens.operators.facets import recode_outcome
from ratelens.plans import analyses as A
from ratelens.roles import HR_ROLES as H
from ratelens.sources.files import HR_SCHEMA, read_csv, write_csv

# five invented rows of the employee table
SAMPLE5 = [
    "45,Yes,Travel_Frequently,700,Sales,3,3,Marketing,1,11,1,Male,55,2,2,Sales Executive,1,Single,6100,12000,4,Y,Yes,"
    "14,3,2,80,1,12,2,2,5,3,1,2",
    "52,No,Non-Travel,850,Sales,12,4,Medical,1,12,3,Female,70,3,4,Sales Executive,3,Married,15200,9000,2,Y,No,"
    "12,3,4,80,2,28,4,3,20,9,6,8",
    "24,Yes,Travel_Rarely,420,Research & Development,6,1,Life Sciences,1,13,2,Female,48,3,1,Laboratory Technician,2,"
    "Single,2300,5200,1,Y,Yes,18,3,3,80,0,1,1,2,0,0,0,0",
    "33,No,Travel_Rarely,1010,Research & Development,9,3,Other,1,14,4,Male,81,3,2,Research Scientist,4,Married,4700,"
    "17100,3,Y,No,13,4,3,80,1,9,2,3,7,6,2,4",
    "38,No,Travel_Frequently,930,Research & Development,2,2,Technical Degree,1,15,3,Male,63,2,3,Research Scientist,3,"
    "Married,8800,21000,0,Y,No,21,3,1,80,1,15,3,4,2,1,1,1",
]


def _hr(spark):
    d = tempfile.mkdtemp(prefix="ratelens-hr-")
    p = os.path.join(d, "hr.csv")
    with open(p, "w") as fh:
        fh.write(",".join(f.name for f in HR_SCHEMA.fields) + "\n" + "\n".join(SAMPLE5) + "\n")
    df = read_csv(spark, p)
    return df.withColumn(H.label, recode_outcome(H.outcome, null_as_negative=True))


def test_analyses_on_hr_names(spark):
    df = _hr(spark)
    by_dept = {r.Department: (r.total, r.positives) for r in A.rate_by_dept(df, H).collect()}
    assert by_dept == {"Sales": (2, 1), "Research & Development": (3, 1)}
    fat = {r.factor: r.total for r in A.fatigue(df, H).collect()}
    assert fat == {"Alta Fatiga": 3, "Normal": 2}
    ages = {r.band: r.total for r in A.age_bands(df, H).collect()}
    assert ages == {"18-30": 1, "31-40": 2, "41-50": 1, "51+": 1}
    tenure = {r.band: r.total for r in A.tenure_bands(df, H).collect()}
    assert tenure["0-1"] == 0 and sum(tenure.values()) == 4  # YearsAtCompany 0 is outside (0, 1]
    clim = {r.combination: r.total for r in A.climate(df, H).collect()}
    assert sum(clim.values()) == 5


def test_describe_matches_pandas_on_sample(spark):
    import pandas as pd
    df = _hr(spark)
    cols = ["Age", "MonthlyIncome", "EmployeeNumber"]
    got = {r.variable: r for r in stats.describe(df, cols).collect()}
    pdf = df.select(*cols).toPandas().describe()
    for c in cols:
        assert got[c]["count"] == 5
        for ours, theirs in (("mean", "mean"), ("std", "std"), ("q25", "25%"), ("q50", "50%"), ("q75", "75%")):
            assert abs(got[c][ours] - pdf.loc[theirs, c]) < 1e-6


def test_csv_sinks_round_trip(spark):
    df = _hr(spark)
    d = tempfile.mkdtemp(prefix="ratelens-sink-")
    write_csv(df.where(F.col("Department") == "Research & Development").drop(H.label), os.path.join(d, "rows"))
    back = read_csv(spark, os.path.join(d, "rows"))
    assert back.count() == 3 and back.columns == [f.name for f in HR_SCHEMA.fields]
    summary = stats.describe(df, ["Age", "MonthlyIncome"])
    write_csv(summary, os.path.join(d, "summary"))
    assert spark.read.option("header", True).csv(os.path.join(d, "summary")).count() == 2
