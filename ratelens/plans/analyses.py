"""Composed analyses (Q1-Q25): each is a function (DataFrame, Roles) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelens.functions.bins import cut_expr
from ratelens.operators import binning, rates, stats
from ratelens.operators.ranks import value_ranks
from ratelens.operators.scans import exact_quantiles
from ratelens.roles import Roles
from ratelens.sources.tables import temporary

# fixed values: band edges and labels (right-closed bins)
AGE_EDGES, AGE_LABELS = [0, 30, 40, 50, 100], ["18-30", "31-40", "41-50", "51+"]
TENURE_EDGES, TENURE_LABELS = [0, 1, 2, 3, 5, 10, 50], ["0-1", "1-2", "2-3", "3-5", "5-10", "10+"]
STAGNATION_EDGES = [0, 0.4, 0.7, 1.0]
STAGNATION_LABELS = ["Bajo (<0.4)", "Medio (0.4-0.7)", "Alto (≥0.7)"]
PERCENTILE_EDGES, PERCENTILE_LABELS = [0, 0.25, 0.5, 0.75, 1.0], ["P0-25", "P25-50", "P50-75", "P75-100"]
# fixed values: group labels
FATIGUE_HIGH, FATIGUE_NORMAL = "Alta Fatiga", "Normal"
EARLY_RISK, EARLY_LOW = "Alto Riesgo (18-30, Q1, Single)", "Bajo Riesgo"
EQUITY_LOW, EQUITY_REST = "Q1 (Inferior)", "Q2-Q4"
CLIMATE_NONE, CLIMATE_OTHER = "Sin Factores de Riesgo", "Solo Otros Factores"
CLIMATE_LOW_SAT, CLIMATE_BOTH = "Solo Baja Satisfacción", "Otros Factores + Baja Satisfacción"
SAT_HIGH, SAT_LOW = "Alta (3-4)", "Baja (1-2)"
YOUNG_MAX_AGE, LOW_SAT_MAX = 30, 2
STAGNATION_GUARD = 0.1


def _y(r: Roles):
    return F.col(r.label)


def rate_by_dept(df: DataFrame, r: Roles) -> DataFrame:
    """Q1: outcome count / positives / rate and the % split of the outcome by department."""
    n = F.count(F.col(r.outcome))
    pct = [(F.count_if(F.col(r.outcome) == v) * 100.0 / n).alias(name)
           for v, name in ((r.negative, "no_pct"), (r.positive, "yes_pct"))]
    return df.where(F.col(r.dept).isNotNull()).groupBy(r.dept).agg(*rates.rate_aggs(r.label), *pct)


def dept_role(df: DataFrame, r: Roles, k: int = 15) -> DataFrame:
    """Q2: outcome by department x role, top k by rate."""
    g = rates.outcome_rate(df, [r.dept, r.role], r.label)
    return rates.top_k(g, k, [F.desc_nulls_last("rate"), F.asc(r.dept), F.asc(r.role)])


def satisfaction_rates(df: DataFrame, r: Roles) -> DataFrame:
    """Q3: outcome rate per level of each satisfaction column (one unpivot, one aggregate)."""
    long = df.select(r.label, *r.satisfaction).unpivot([r.label], list(r.satisfaction), "variable", "level")
    return rates.outcome_rate(long, ["variable", "level"], r.label)


def overtime_share(df: DataFrame, r: Roles) -> DataFrame:
    """Q4: % overtime by department."""
    return rates.crosstab_pct(df, r.dept, r.overtime, ["No", "Yes"]) \
        .withColumnRenamed("No", "no_pct").withColumnRenamed("Yes", "yes_pct")


def project_xy(df: DataFrame, r: Roles) -> DataFrame:
    """Experience vs income points with their colour columns (every row)."""
    return df.select(r.row_id, r.experience, r.income, r.level, r.outcome)


def fatigue(df: DataFrame, r: Roles) -> DataFrame:
    """Q6: overtime OR frequent travel vs the rest."""
    cond = (F.col(r.overtime) == r.yes) | (F.col(r.travel) == r.travel_frequent)
    g = df.select(F.when(cond, FATIGUE_HIGH).otherwise(FATIGUE_NORMAL).alias("factor"), r.label)
    return rates.outcome_rate(g, ["factor"], r.label)


def high_risk_roles(df: DataFrame, r: Roles, min_count: int = 3, k: int = 8) -> DataFrame:
    """Q7: role x overtime x travel with n >= 3, overtime and (frequent or rare) travel, top 8."""
    g = rates.outcome_rate(df, [r.role, r.overtime, r.travel], r.label, with_sum=False, min_count=min_count)
    g = g.where((F.col(r.overtime) == r.yes) & F.col(r.travel).isin(r.travel_frequent, r.travel_rare))
    g = g.withColumn("detail", F.concat(F.col(r.role), F.lit(" ("), F.col(r.travel), F.lit(")")))
    return rates.top_k(g, k, [F.desc_nulls_last("rate"), F.asc(r.role), F.asc(r.travel)])


def income_q1(df: DataFrame, r: Roles) -> float | None:
    row = exact_quantiles(df, r.income, [0.25]).first()
    return None if row is None else row.value


def early_career(df: DataFrame, r: Roles) -> DataFrame:
    """Q8: young AND income <= first quartile AND single vs the rest."""
    q1 = income_q1(df, r)
    cond = (F.col(r.age) <= YOUNG_MAX_AGE) & (F.col(r.income) <= F.lit(q1)) & (F.col(r.marital) == r.single)
    g = df.select(F.when(cond, EARLY_RISK).otherwise(EARLY_LOW).alias("profile"), r.label)
    return rates.outcome_rate(g, ["profile"], r.label)


def age_income_quartiles(df: DataFrame, r: Roles) -> DataFrame:
    """Q9: mean outcome for age quartile x income quartile (labels Q1..Qm)."""
    edges = binning.quantile_edges_many(df, [r.age, r.income], 4)
    a_expr, _ = binning.quantile_label_expr(r.age, edges[r.age])
    i_expr, i_labels = binning.quantile_label_expr(r.income, edges[r.income])
    q = df.select(a_expr.alias("age_quartile"), i_expr.alias("income_quartile"), r.label)
    return rates.pivot_mean(q, "age_quartile", "income_quartile", r.label, i_labels)


def tenure_bands(df: DataFrame, r: Roles) -> DataFrame:
    """Q10: outcome by tenure band (0 falls outside the right-closed first bin)."""
    return binning.cut_fixed(df, r.tenure, TENURE_EDGES, TENURE_LABELS, r.label)


def stagnation(df: DataFrame, r: Roles) -> DataFrame:
    """Q11: stagnation index role_years / (tenure + 0.1) in bands."""
    idx = F.col(r.role_years) / (F.col(r.tenure) + F.lit(STAGNATION_GUARD))
    return binning.cut_fixed(df, idx, STAGNATION_EDGES, STAGNATION_LABELS, r.label, with_sum=False)


def equity_within_level(df: DataFrame, r: Roles, min_level_rows: int = 5, min_count: int = 3) -> DataFrame:
    """Q12: within each job level with more than 4 rows, bottom income quartile vs rest.
    Per-level quartiles are one small table (a row per level) joined back by level."""
    sizes = df.groupBy(r.level).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_level_rows)
    q = exact_quantiles(df, r.income, [0.25], [r.level]).select(r.level, F.col("value").alias("_q1"))
    q = temporary(q.join(sizes.select(r.level), r.level), "level_quartiles")
    lab = F.when(F.col(r.income) <= F.col("_q1"), EQUITY_LOW).otherwise(EQUITY_REST)
    g = df.join(q, r.level).select(r.level, lab.alias("income_group"), r.label)
    return rates.outcome_rate(g, [r.level, "income_group"], r.label, with_sum=False, min_count=min_count)


def percentile_groups(df: DataFrame, r: Roles) -> DataFrame:
    """Q13: outcome by income percentile-rank quarter. Ranks are computed per distinct
    income with its positives, so rows are never re-joined."""
    v = value_ranks(df, r.income, weights={"_pos": F.col(r.label)})
    pct = F.col("avg_rank") / F.col("n")
    banded = v.select(cut_expr(pct, PERCENTILE_EDGES, PERCENTILE_LABELS).alias("band"), "cnt", "_pos")
    g = banded.groupBy("band").agg(F.sum("cnt").alias("_cnt"), F.sum("_pos").alias("_pos"))
    spark = df.sparkSession
    frame = spark.createDataFrame(list(enumerate(PERCENTILE_LABELS)), "bin int, band string")
    return (F.broadcast(frame).join(g, "band", "left")
            .select("bin", "band", F.coalesce("_cnt", F.lit(0)).cast("bigint").alias("total"),
                    (F.col("_pos") / F.col("_cnt")).alias("rate")))


def _low_sat(r: Roles):
    return (F.col(r.job_sat) <= LOW_SAT_MAX) | (F.col(r.env_sat) <= LOW_SAT_MAX)


def climate(df: DataFrame, r: Roles) -> DataFrame:
    """Q14: low satisfaction x other risk, four cells (last matching assignment wins)."""
    low = _low_sat(r)
    other = (F.col(r.overtime) == r.yes) | (F.col(r.travel) == r.travel_frequent) | (F.col(r.age) <= YOUNG_MAX_AGE)
    lab = (F.when(other & low, CLIMATE_BOTH).when(~other & low, CLIMATE_LOW_SAT)
           .when(other & ~low, CLIMATE_OTHER).otherwise(CLIMATE_NONE))
    return rates.outcome_rate(df.select(lab.alias("combination"), r.label), ["combination"], r.label,
                              with_sum=False)


def satisfaction_pivot(df: DataFrame, r: Roles, levels=(1, 2, 3, 4)) -> DataFrame:
    """Q15: mean outcome by job satisfaction x environment satisfaction."""
    return rates.pivot_mean(df, r.job_sat, r.env_sat, r.label, list(levels))


def low_satisfaction(df: DataFrame, r: Roles) -> DataFrame:
    """Q16: low (<= 2 on job or environment) vs high satisfaction."""
    lab = F.when(_low_sat(r), SAT_LOW).otherwise(SAT_HIGH)
    return rates.outcome_rate(df.select(lab.alias("satisfaction"), r.label), ["satisfaction"], r.label,
                              with_sum=False)


def age_bands(df: DataFrame, r: Roles) -> DataFrame:
    """Q17: outcome by age band (dense: empty bands kept)."""
    return binning.cut_fixed(df, r.age, AGE_EDGES, AGE_LABELS, r.label)


def income_bands(df: DataFrame, r: Roles, k: int = 5, edges_from: DataFrame | None = None) -> DataFrame:
    """Q18: outcome by equal-width income band with ``$aK-bK`` labels."""
    return binning.cut_equal(df, r.income, k, r.label, edges_from=edges_from)


def dept_overtime(df: DataFrame, r: Roles) -> DataFrame:
    """Q19: mean outcome by department x overtime."""
    return rates.pivot_mean(df, r.dept, r.overtime, r.label, ["No", "Yes"])


def top_combos(df: DataFrame, r: Roles, min_count: int = 5, k: int = 10) -> DataFrame:
    """Q20: department x gender x overtime, n >= min_count, top k by rate."""
    g = rates.outcome_rate(df, [r.dept, r.gender, r.overtime], r.label, with_sum=False, min_count=min_count)
    g = g.withColumn("combination", F.concat_ws(" + ", r.dept, r.gender, r.overtime))
    return rates.top_k(g, k, [F.desc_nulls_last("rate"), F.asc(r.dept), F.asc(r.gender), F.asc(r.overtime)])


def category_detail(df: DataFrame, r: Roles, var: str) -> DataFrame:
    """Q21: one variable: counts, outcome % (of the rows with an outcome) and outcome counts per
    category (one aggregate)."""
    n = F.nullif(F.count(F.col(r.outcome)), F.lit(0))
    yes = F.count_if(F.col(r.outcome) == r.positive)
    no = F.count_if(F.col(r.outcome) == r.negative)
    return (df.where(F.col(var).isNotNull()).groupBy(var)
            .agg(F.count(F.lit(1)).alias("count"), (no * 100.0 / n).alias("no_pct"),
                 (yes * 100.0 / n).alias("yes_pct"),
                 no.alias("no_count"), yes.alias("yes_count")))


def all_variables(df: DataFrame, r: Roles, min_count: int = 5) -> DataFrame:
    """Q22: outcome % of every category of every categorical column, n >= 5."""
    return rates.all_variables(df, r.categoricals, r.outcome, r.positive, min_count)


def top_categories(df: DataFrame, r: Roles, k: int = 10) -> DataFrame:
    """Q22: the k categories with the highest outcome %."""
    return rates.top_k(all_variables(df, r), k, [F.desc_nulls_last("rate_pct"), "variable", "category"])


def final_summary(df: DataFrame, r: Roles) -> DataFrame:
    """Q23: closing summary as (metric, value, text) rows: totals, worst department and
    role, rate with / without overtime, top 5 correlates of the outcome. Each part is a
    one-row (or five-row) aggregate; the parts are unioned, never joined."""
    def row(metric, value, text=None):
        return [F.lit(metric).alias("metric"), value.cast("double").alias("value"),
                (text if text is not None else F.lit(None)).cast("string").alias("text")]
    tot = df.agg(F.array(*[F.struct(*row(metric, value)) for metric, value in (
        ("total", F.count(F.lit(1))), ("positives", F.sum(r.label)), ("rate_pct", F.avg(r.label) * 100))]).alias("s"))
    parts = [tot.select(F.inline("s"))]
    # the rates of all three columns from one pass over the rows, a row a category
    keys = {"top_dept": r.dept, "top_role": r.role, "overtime_rate": r.overtime}
    long = df.select(r.label, *[F.col(c).alias(m) for m, c in keys.items()]).unpivot(
        [r.label], list(keys), "metric", "category").where(F.col("category").isNotNull())
    rated = temporary(long.groupBy("metric", "category").agg(F.avg(r.label).alias("m")), "summary_rates")
    for metric in ("top_dept", "top_role"):
        best = rates.top_k(rated.where(F.col("metric") == metric), 1, [F.desc_nulls_last("m"), F.asc("category")])
        parts.append(best.select(*row(metric, F.col("m"), F.col("category"))))
    parts.append(rated.where(F.col("metric") == "overtime_rate").select(
        *row("overtime_rate", F.col("m"), F.col("category"))))
    nums = [c for c in r.numerics if c != r.label]
    top = stats.outcome_corr(df, r.label, nums, k=5)
    parts.append(top.select(*row("top_correlate", F.col("abs_r"), F.col("variable"))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def kpis(df: DataFrame, r: Roles) -> DataFrame:
    """Q24: headline KPIs of the (filtered) rows."""
    return rates.kpis(df, r.label, {"avg_job_sat": r.job_sat, "avg_income": r.income, "avg_tenure": r.tenure})
