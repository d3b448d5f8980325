"""Facets, filters and record preparation."""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelens.roles import Roles


def facet_predicate(isin: Mapping[str, Sequence] | None = None,
                    ranges: Mapping[str, tuple] | None = None) -> Column:
    """AND of ``isin`` sets and inclusive ``between`` ranges. A facet that is not
    given is not evaluated; an empty set selects nothing (as an empty multiselect)."""
    parts: list[Column] = []
    for c, values in (isin or {}).items():
        parts.append(F.col(c).isin(list(values)) if len(values) else F.lit(False))
    for c, (lo, hi) in (ranges or {}).items():
        parts.append(F.col(c).between(lo, hi))
    return functools.reduce(operator.and_, parts) if parts else F.lit(True)


def faceted_filter(df: DataFrame, isin=None, ranges=None) -> DataFrame:
    """The filter is a plain predicate, so Catalyst pushes it into the Parquet scan."""
    return df.where(facet_predicate(isin, ranges))


def filter_share(df: DataFrame, predicate: Column) -> DataFrame:
    """Filtered rows, all rows and the % kept, in one pass."""
    n = F.count(F.lit(1))
    kept = F.count_if(predicate)
    return df.agg(kept.alias("filtered"), n.alias("total"),
                  F.round(F.try_divide(kept * 100.0, n), 6).alias("share_pct"))


def recode_outcome(outcome: str, positive: str = "Yes", negative: str = "No",
                   null_as_negative: bool = False) -> Column:
    """String outcome -> 1/0. By default anything else is null (the ``map`` form);
    ``null_as_negative`` gives the ``(x == positive).astype(int)`` form."""
    c = F.col(outcome)
    if null_as_negative:
        return F.when(c == positive, 1).otherwise(0)
    return F.when(c == positive, 1).when(c == negative, 0)


def facet_domains(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(facet, value) distinct non-null values of many columns in one pass."""
    cols = [F.col(c).cast("string").alias(c) for c in columns]
    long = df.select(*cols).unpivot([], list(columns), "facet", "value")
    return long.where(F.col("value").isNotNull()).distinct().orderBy("facet", "value")


def facet_bounds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(facet, lo, hi) truncated min / max of numeric columns, one aggregate."""
    row = df.agg(*[F.struct(F.lit(c).alias("facet"), F.min(c).cast("int").alias("lo"),
                            F.max(c).cast("int").alias("hi")).alias(f"_{i}")
                   for i, c in enumerate(columns)])
    return row.select(F.explode(F.array(*[F.col(f"_{i}") for i in range(len(columns))])).alias("s")).select("s.*")


# fixed values: defaults of the one-row scoring form, by employee-table column
FORM_DEFAULTS = {
    "Education": 3, "DistanceFromHome": 10, "WorkLifeBalance": 3, "JobSatisfaction": 3,
    "EnvironmentSatisfaction": 3, "JobInvolvement": 3, "Department": "Sales", "JobRole": "Sales Executive",
    "Gender": "Male", "MaritalStatus": "Married", "EducationField": "Technical Degree", "DailyRate": 800,
    "HourlyRate": 50, "MonthlyRate": 15000, "NumCompaniesWorked": 2, "PercentSalaryHike": 15,
    "PerformanceRating": 3, "RelationshipSatisfaction": 3, "StockOptionLevel": 1, "TrainingTimesLastYear": 3,
}
# derived defaults: TotalWorkingYears = max(Age - 18, YearsAtCompany); YearsInCurrentRole = min(YearsAtCompany, 2);
# YearsSinceLastPromotion = min(YearsAtCompany, 1); YearsWithCurrManager = min(YearsAtCompany, 2)


def default_exprs(roles: Roles) -> dict[str, Column]:
    """Default value (literal or derived from the form fields) for every feature column."""
    age, tenure = F.col(roles.age), F.col(roles.tenure)
    by_hr = {
        "TotalWorkingYears": F.greatest(age - 18, tenure),
        "YearsInCurrentRole": F.least(tenure, F.lit(2)),
        "YearsSinceLastPromotion": F.least(tenure, F.lit(1)),
        "YearsWithCurrManager": F.least(tenure, F.lit(2)),
        **{k: F.lit(v) for k, v in FORM_DEFAULTS.items()},
    }
    from ratelens.roles import HR_ROLES
    rename = {getattr(HR_ROLES, f): getattr(roles, f) for f in
              ("dept", "role", "gender", "marital", "education_field", "experience", "role_years",
               "job_sat", "env_sat", "rel_sat", "balance")}
    rename["DailyRate"] = "rate1" if roles is not HR_ROLES and "rate1" in roles.numerics else "DailyRate"
    out = {}
    for hr_name, expr in by_hr.items():
        name = rename.get(hr_name, hr_name)
        if name in roles.categoricals or name in roles.numerics:
            out[name] = expr
    return out


def fill_defaults(df: DataFrame, roles: Roles) -> DataFrame:
    """Complete scoring records: missing feature columns get their default,
    present ones keep their value unless null; numeric nulls left after that become 0."""
    defaults = default_exprs(roles)
    cols = []
    for name in (*roles.categoricals, *roles.numerics):
        if name in df.columns:
            base = F.col(name)
            cols.append((F.coalesce(base, defaults[name]) if name in defaults else base).alias(name))
        elif name in defaults:
            cols.append(defaults[name].alias(name))
    keep = [c for c in df.columns if c not in roles.categoricals and c not in roles.numerics]
    out = df.select(*keep, *cols)
    nums = [c for c in roles.numerics if c in out.columns]
    return out.fillna(0, subset=nums)
