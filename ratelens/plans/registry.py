"""Registry of queries: key -> (Spark callable (spark, sf_dir) -> DataFrame, DuckDB SQL or None).

Every callable reads the driver tables through the fact view (``sources.fact``) and
runs over all rows; the SQL twin recomputes the same result from the raw tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens.functions.scalar import risk_factors, risk_tier, round_even
from ratelens.operators import evaluation as ev
from ratelens.operators import binning, facets, ranks, rates, stats
from ratelens.operators.facet_index import FacetIndex
from ratelens.plans import analyses as A
from ratelens.plans import oracle_sql as O
from ratelens.plans.oracle_sql import q
from ratelens.roles import FACT_ROLES as R
from ratelens.sources import files
from ratelens.sources.tables import fact, materialize, temporary_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# the facet selection used by the filter keys (a dashboard user's choice)
FACETS_ISIN = {"dept": ["F", "O"], "travel": ["1-URGENT", "2-HIGH", "3-MEDIUM"]}
FACETS_RANGES = {"age": (20, 45), "income": (5000.0, 90000.0)}
FACETS_SQL = ("dept IN ('F', 'O') AND travel IN ('1-URGENT', '2-HIGH', '3-MEDIUM') "
              "AND age BETWEEN 20 AND 45 AND income BETWEEN 5000.0 AND 90000.0")
FACET_DOMAIN_COLS = ["dept", "role", "gender", "marital", "education_field", "travel", "overtime",
                     "level", "job_sat", "env_sat", "rel_sat", "balance"]
BOUND_COLS = ["age", "income", "tenure", "experience", "role_years"]
CORR_COLS = ["y", *O.NUMS]
TOP_CORR_FOR = ["age", "income", "experience", "tenure"]
SEED = 42



# band edges, labels and grids as documented, written out here so that the oracles don't share the operators' lists
_AGE = ([0, 30, 40, 50, 100], ["18-30", "31-40", "41-50", "51+"])
_TENURE = ([0, 1, 2, 3, 5, 10, 50], ["0-1", "1-2", "2-3", "3-5", "5-10", "10+"])
_STAGNATION = ([0, 0.4, 0.7, 1.0], ["Bajo (<0.4)", "Medio (0.4-0.7)", "Alto (≥0.7)"])
_PERCENTILE = ([0, 0.25, 0.5, 0.75, 1.0], ["P0-25", "P25-50", "P50-75", "P75-100"])
_SWEEP = ["0.1", "0.15", "0.2", "0.25", "0.3", "0.35", "0.4", "0.45", "0.5", "0.55", "0.6", "0.65", "0.7", "0.75", "0.8",
          "0.85", "0.9", "0.95"]
_F1_GRID = [f"0.{i:02d}" for i in range(10, 90, 2)]


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _f(spark, sf):
    return fact(spark, sf)


def _rounded(fn):
    """``fn`` with its double columns (but those of _RAW) rounded to 6 digits."""
    def run(s, d):
        df = fn(s, d)
        return df.select(*[F.round(c, 6).alias(c) if t == "double" and c not in _RAW else c for c, t in df.dtypes])
    return run


# ---------------------------------------------------------------- sources, projections, filters
register("scan_fact", q("SELECT * FROM fact"))(lambda s, d: _f(s, d))

register("project_xy", q("SELECT row_id, experience, income, level, outcome FROM fact"))(
    lambda s, d: A.project_xy(_f(s, d), R))

register("faceted_filter", q(f"SELECT row_id, dept, travel, age, income, y FROM fact WHERE {FACETS_SQL}"))(
    lambda s, d: facets.faceted_filter(_f(s, d), FACETS_ISIN, FACETS_RANGES)
    .select("row_id", "dept", "travel", "age", "income", "y"))

register("recode_outcome", q(
    "SELECT row_id, outcome, CASE WHEN outcome = 'Yes' THEN 1 WHEN outcome = 'No' THEN 0 END AS y_map, "
    "CASE WHEN outcome = 'Yes' THEN 1 ELSE 0 END AS y_flag FROM fact"))(
    lambda s, d: _f(s, d).select("row_id", "outcome",
                                 facets.recode_outcome("outcome").alias("y_map"),
                                 facets.recode_outcome("outcome", null_as_negative=True).alias("y_flag")))

FORM_FIELDS = ["row_id", "tenure", "income", "age", "overtime", "travel", "level"]
register("fill_defaults", q(
    "SELECT row_id, 'Sales' AS dept, 'Sales Executive' AS role, 'Male' AS gender, 'Married' AS marital, "
    "'Technical Degree' AS education_field, travel, overtime, age, income, level, "
    "greatest(age - 18, tenure) AS experience, tenure, least(tenure, 2) AS role_years, 3 AS job_sat, "
    "3 AS env_sat, 3 AS rel_sat, 3 AS balance, 800 AS rate1 FROM fact"))(
    lambda s, d: facets.fill_defaults(_f(s, d).select(*FORM_FIELDS), R))

register("facet_domains", q(" UNION ".join(
    f"SELECT DISTINCT '{c}' AS facet, CAST({c} AS VARCHAR) AS value FROM fact WHERE {c} IS NOT NULL"
    for c in FACET_DOMAIN_COLS)))(lambda s, d: facets.facet_domains(_f(s, d), FACET_DOMAIN_COLS))

register("facet_bounds", q(" UNION ALL ".join(
    f"SELECT '{c}' AS facet, CAST(trunc(min({c})) AS INT) AS lo, CAST(trunc(max({c})) AS INT) AS hi FROM fact"
    for c in BOUND_COLS)))(lambda s, d: facets.facet_bounds(_f(s, d), BOUND_COLS))

register("filter_share", q(
    f"SELECT count_if({FACETS_SQL})::BIGINT AS filtered, count(*)::BIGINT AS total, "
    f"round(count_if({FACETS_SQL}) * 100.0 / count(*), 6) AS share_pct FROM fact"))(
    lambda s, d: facets.filter_share(_f(s, d), facets.facet_predicate(FACETS_ISIN, FACETS_RANGES)))

register("kpis", q(
    f"SELECT count(*)::BIGINT AS total, sum(y)::BIGINT AS positives, round(avg(y::DOUBLE) * 100, 6) AS rate_pct, "
    f"round(avg(job_sat), 6) AS avg_job_sat, round(avg(income), 6) AS avg_income, "
    f"round(avg(tenure), 6) AS avg_tenure FROM fact WHERE {FACETS_SQL}"))(
    lambda s, d: A.kpis(facets.faceted_filter(_f(s, d), FACETS_ISIN, FACETS_RANGES), R))

_INDEX: dict[tuple[str, str], FacetIndex] = {}


def facet_index(spark, sf) -> FacetIndex:
    """The bitmap index of the fact view, built once per application and folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _INDEX:
        _INDEX[key] = FacetIndex.build(_f(spark, sf), [*FACET_DOMAIN_COLS, "y"], ["age", "income", "tenure"],
                                       keep=lambda df, name: materialize(spark, lambda: df, name, sf))
    return _INDEX[key]


register("facet_index_share", ORACLE["filter_share"])(lambda s, d: facet_index(s, d).share(FACETS_ISIN, FACETS_RANGES))
register("facet_index_rates", q(", sel AS (SELECT * FROM fact WHERE " + FACETS_SQL + ") " + " UNION ALL ".join(
    f"SELECT '{c}' AS facet, CAST({c} AS VARCHAR) AS value, {O.rate_cols()} FROM sel WHERE {c} IS NOT NULL GROUP BY {c}"
    for c in FACET_DOMAIN_COLS)))(
    lambda s, d: facet_index(s, d).rates("y", 1, FACETS_ISIN, FACETS_RANGES))

# ---------------------------------------------------------------- CSV sinks and the checked scan
CSV_COLS = ["row_id", "dept", "role", "travel", "age", "income", "y"]


def _csv_back(s, df):
    path = temporary_path(s, "csv")
    files.write_csv(df, path)
    return files.checked_scan(s, path, df.schema)


register("csv_rows", q(f"SELECT {', '.join(CSV_COLS)} FROM fact WHERE {FACETS_SQL}"))(
    lambda s, d: _csv_back(s, facets.faceted_filter(_f(s, d), FACETS_ISIN, FACETS_RANGES).select(*CSV_COLS))[0])
register("csv_summary", O.describe_sql(O.NUMS))(lambda s, d: _csv_back(s, stats.describe(_f(s, d), O.NUMS))[0])


def _csv_rejects(s, d):
    """Fact rows as CSV with unreadable ages (level 7) and incomes (experience 50), scanned with the declared types."""
    df = _f(s, d).select("row_id", "level", "experience", "age", "income")
    path = temporary_path(s, "csv-marred")
    files.write_csv(df.withColumns({
        "age": F.when(F.col("level") == 7, F.lit("n/a")).otherwise(F.col("age").cast("string")),
        "income": F.when(F.col("experience") == 50, F.lit("unknown")).otherwise(F.col("income").cast("string"))}), path)
    good, rejected = files.checked_scan(s, path, df.schema)
    return good.select(F.lit("").alias("cells")).unionByName(
        rejected.select(F.array_join("cells", ",").alias("cells"))).groupBy("cells").agg(F.count(F.lit(1)).alias("lines"))


register("csv_rejects", q(
    "SELECT concat_ws(',', CASE WHEN level = 7 THEN 'age' END, CASE WHEN experience = 50 THEN 'income' END) AS cells, "
    "count(*)::BIGINT AS lines FROM fact GROUP BY 1"))(_csv_rejects)

# ---------------------------------------------------------------- aggregations
register("outcome_rate", q(f"SELECT role, {O.rate_cols()} FROM fact WHERE role IS NOT NULL GROUP BY role"))(
    lambda s, d: rates.outcome_rate(_f(s, d), ["role"], "y"))

register("outcome_rate_multi", q(
    f"SELECT role, travel, {O.rate_cols(with_sum=False)} FROM fact GROUP BY role, travel"))(
    lambda s, d: rates.outcome_rate(_f(s, d), ["role", "travel"], "y", with_sum=False))

register("mean_by_level", q("SELECT level, round(avg(income), 6) AS mean_income FROM fact GROUP BY level"))(
    lambda s, d: rates.mean_by(_f(s, d), "level", "income"))

register("value_counts", q("SELECT job_sat, count(*)::BIGINT AS count FROM fact GROUP BY job_sat"))(
    lambda s, d: rates.value_counts(_f(s, d), "job_sat"))

register("category_share", q(
    "SELECT gender, count(*)::BIGINT AS count, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS share_pct "
    "FROM fact GROUP BY gender"))(lambda s, d: rates.category_share(_f(s, d), "gender"))

register("class_balance", q("SELECT y, count(*)::BIGINT AS count FROM fact GROUP BY y"))(
    lambda s, d: rates.class_balance(_f(s, d), "y"))

register("crosstab_counts", q(
    "SELECT education_field, count_if(outcome = 'No')::BIGINT AS \"No\", count_if(outcome = 'Yes')::BIGINT AS \"Yes\" "
    "FROM fact GROUP BY education_field"))(
    lambda s, d: rates.crosstab_counts(_f(s, d), "education_field", "outcome", ["No", "Yes"]))

register("crosstab_pct", q(
    "SELECT role, round(count_if(outcome = 'No') * 100.0 / count(*), 6) AS \"No\", "
    "round(count_if(outcome = 'Yes') * 100.0 / count(*), 6) AS \"Yes\" FROM fact GROUP BY role"))(
    lambda s, d: rates.crosstab_pct(_f(s, d), "role", "outcome", ["No", "Yes"]))

register("pivot_mean", q(
    "SELECT job_sat, " + ", ".join(
        f"round(avg(CASE WHEN env_sat = {v} THEN y::DOUBLE END), 6) AS \"{v}\"" for v in (1, 2, 3, 4))
    + " FROM fact GROUP BY job_sat"))(lambda s, d: A.satisfaction_pivot(_f(s, d), R))

register("dept_overtime", q(
    "SELECT dept, " + ", ".join(
        f"round(avg(CASE WHEN overtime = '{v}' THEN y::DOUBLE END), 6) AS \"{v}\"" for v in ("No", "Yes"))
    + " FROM fact GROUP BY dept"))(lambda s, d: A.dept_overtime(_f(s, d), R))

_ALLVARS_SQL = (" UNION ALL ".join(
    f"SELECT '{c}' AS variable, {c} AS category, outcome FROM fact WHERE {c} IS NOT NULL" for c in O.CATS))
register("all_variables", q(
    f", long AS ({_ALLVARS_SQL}) SELECT variable, category, "
    f"round(coalesce(count_if(outcome = 'Yes') * 100.0 / count(outcome), 0.0), 6) AS rate_pct, "
    f"count(*)::BIGINT AS count FROM long GROUP BY variable, category HAVING count(*) >= 5"))(
    lambda s, d: A.all_variables(_f(s, d), R))

register("top_categories", q(
    f", long AS ({_ALLVARS_SQL}), av AS (SELECT variable, category, "
    f"coalesce(count_if(outcome = 'Yes') * 100.0 / count(outcome), 0.0) AS raw_pct, "
    f"count(*)::BIGINT AS count FROM long GROUP BY variable, category HAVING count(*) >= 5) "
    f"SELECT variable, category, round(raw_pct, 6) AS rate_pct, count FROM av "
    f"ORDER BY raw_pct DESC NULLS LAST, variable, category LIMIT 10"))(
    lambda s, d: A.top_categories(_f(s, d), R))

register("profile", q(" UNION ALL ".join(
    f"SELECT '{c}' AS column, '{t}' AS dtype, count({c})::BIGINT AS non_null, "
    f"count_if({c} IS NULL)::BIGINT AS nulls FROM fact"
    for c, t in [("row_id", "string"), ("outcome", "string"), ("y", "int"), ("dept", "string"),
                 ("role", "string"), ("gender", "string"), ("marital", "string"), ("education_field", "string"),
                 ("travel", "string"), ("overtime", "string"), ("age", "int"), ("income", "double"),
                 ("level", "int"), ("experience", "int"), ("tenure", "int"), ("role_years", "int"),
                 ("job_sat", "int"), ("env_sat", "int"), ("rel_sat", "int"), ("balance", "int"),
                 ("rate1", "double"), ("constant_col", "int"), ("score", "double")])))(
    lambda s, d: stats.profile(_f(s, d)))

# ---------------------------------------------------------------- statistics
register("describe", O.describe_sql(O.NUMS))(lambda s, d: stats.describe(_f(s, d), O.NUMS))
register("describe_where", O.describe_sql(O.NUMS, where="dept = 'F'"))(
    lambda s, d: stats.describe(_f(s, d).where(F.col("dept") == "F"), O.NUMS))
register("describe_by", O.describe_sql(O.NUMS, by=["outcome"]))(
    lambda s, d: stats.describe(_f(s, d), O.NUMS, by=["outcome"]))

register("corr_matrix", q(O.corr_sql(CORR_COLS) + "SELECT c1, c2, i, j, round(r, 6) AS r FROM corr"))(
    lambda s, d: stats.corr_long(_f(s, d), CORR_COLS))
register("corr_lower", q(O.corr_sql(CORR_COLS) + "SELECT c1, c2, i, j, round(r, 6) AS r FROM corr WHERE i > j"))(
    lambda s, d: stats.corr_lower(stats.corr_long(_f(s, d), CORR_COLS)))
register("top_corr", q(
    O.corr_sql(CORR_COLS) + ", t AS (SELECT c1, c2, r, abs(r) AS abs_r, row_number() OVER "
    "(PARTITION BY c1 ORDER BY abs(r) DESC NULLS LAST, c2) AS rank FROM corr WHERE c1 IN ("
    + ", ".join(f"'{c}'" for c in TOP_CORR_FOR) + ") AND c1 <> c2) SELECT c1, c2, round(r, 6) AS r, round(abs_r, 6) AS abs_r, rank FROM t WHERE rank <= 5"))(
    lambda s, d: stats.top_corr(stats.corr_long(_f(s, d), CORR_COLS), TOP_CORR_FOR)
    .withColumn("rank", F.col("rank").cast("bigint")))
register("outcome_corr", q(
    f", c AS ({O.corr_with_sql('y', O.NUMS)}) SELECT variable, round(r, 6) AS r, round(abs(r), 6) AS abs_r FROM c "
    f"ORDER BY abs(r) DESC NULLS LAST, variable LIMIT 15"))(
    lambda s, d: stats.outcome_corr(_f(s, d), "y", O.NUMS, k=15))

register("quantile_exact", q(
    ", long AS (" + O.long_values_sql(["income", "age"]) + ") " + " UNION ALL ".join(
        f"SELECT variable, {p}::DOUBLE AS p, round(quantile_cont(value, {p}), 6) AS value FROM long GROUP BY variable"
        for p in (0.25, 0.5, 0.75))))(
    lambda s, d: stats.quantiles(_f(s, d), ["income", "age"], [0.25, 0.5, 0.75]))

register("histogram", q(
    ", b AS (SELECT min(income)::DOUBLE AS lo, max(income)::DOUBLE AS hi FROM fact), "
    "c AS (SELECT CAST(least(floor((income::DOUBLE - lo) * 30.0 / (hi - lo)), 29) AS INT) AS bin, count(*) AS n "
    "FROM fact, b GROUP BY 1) "
    "SELECT g.bin::INT AS bin, round(lo + g.bin * (hi - lo) / 30.0, 6) AS \"left\", "
    "round(lo + (g.bin + 1) * (hi - lo) / 30.0, 6) AS \"right\", coalesce(c.n, 0)::BIGINT AS count "
    "FROM range(30) g(bin) CROSS JOIN b LEFT JOIN c ON c.bin = g.bin"))(
    lambda s, d: stats.histogram(_f(s, d), "income", 30))

BOX_COLS = ["age", "income", "experience", "tenure", "rate1"]
register("box_stats", O.box_sql(BOX_COLS))(lambda s, d: stats.box_stats(_f(s, d), BOX_COLS))
register("box_stats_by", O.box_sql(BOX_COLS, by=["outcome"]))(
    lambda s, d: stats.box_stats(_f(s, d), BOX_COLS, by=["outcome"]))

STD_COLS = ["age", "income", "experience", "tenure", "constant_col"]
register("standardize", q(
    ", st AS (SELECT " + ", ".join(
        f"avg({c}::DOUBLE) AS m_{c}, CASE WHEN stddev_pop({c}::DOUBLE) > 0 THEN stddev_pop({c}::DOUBLE) ELSE 1.0 END "
        f"AS s_{c}" for c in STD_COLS) + " FROM fact) SELECT row_id, " + ", ".join(
        f"round(({c}::DOUBLE - m_{c}) / s_{c}, 6) AS {c}" for c in STD_COLS) + " FROM fact, st"))(
    lambda s, d: stats.standardize(_f(s, d).select("row_id", *STD_COLS), STD_COLS, digits=6))

# ---------------------------------------------------------------- binning
_AGE_SQL = O.dense_cut_sql("age", *_AGE, "band")
register("cut_fixed", q(_AGE_SQL))(lambda s, d: A.age_bands(_f(s, d), R))
register("age_bands", q(_AGE_SQL))(lambda s, d: A.age_bands(_f(s, d), R))
register("tenure_bands", q(O.dense_cut_sql("tenure", *_TENURE, "band")))(
    lambda s, d: A.tenure_bands(_f(s, d), R))
register("stagnation", q(O.dense_cut_sql("(role_years / (tenure + 0.1::DOUBLE))", *_STAGNATION, "band",
                                         with_sum=False)))(lambda s, d: A.stagnation(_f(s, d), R))

# equal-width edges as numpy linspace: lo + i * ((hi - lo) / k), last = hi, first lowered by 0.1 % of the range
_EDGES_SQL = (", mm AS (SELECT min(income)::DOUBLE AS lo, max(income)::DOUBLE AS hi FROM fact), "
              "e AS (SELECT i AS bin, CASE WHEN i = 0 THEN lo - (hi - lo) * 0.001 ELSE lo + i * ((hi - lo) / 5) END AS l, "
              "CASE WHEN i = 4 THEN hi ELSE lo + (i + 1) * ((hi - lo) / 5) END AS r FROM mm, range(5) t(i)), "
              "lab AS (SELECT bin::INT AS bin, round_even(l, 0) AS \"left\", round_even(r, 0) AS \"right\", "
              "'$' || CAST(trunc(round_even(l, 0) / 1000) AS BIGINT) || 'K-' || "
              "CAST(trunc(round_even(r, 0) / 1000) AS BIGINT) || 'K' AS label, l, r FROM e) ")
_INCOME_BANDS_SQL = q(_EDGES_SQL + (
    "SELECT lab.bin, lab.\"left\", lab.\"right\", lab.label, count(f.y)::BIGINT AS total, "
    "coalesce(sum(f.y), 0)::BIGINT AS positives, round(avg(f.y::DOUBLE), 6) AS rate "
    "FROM lab LEFT JOIN fact f ON f.income > lab.l AND f.income <= lab.r "
    "GROUP BY lab.bin, lab.\"left\", lab.\"right\", lab.label"))
register("cut_equal", _INCOME_BANDS_SQL)(lambda s, d: A.income_bands(_f(s, d), R))
register("income_bands", _INCOME_BANDS_SQL)(lambda s, d: A.income_bands(_f(s, d), R))
register("interval_label", q(_EDGES_SQL + "SELECT bin, \"left\", \"right\", label FROM lab"))(
    lambda s, d: binning.interval_frame(_f(s, d), binning.equal_width(_f(s, d), "income", 5)))

_QEDGES = (", qe AS (SELECT quantile_cont(income, 0.25) AS e1, quantile_cont(income, 0.5) AS e2, "
           "quantile_cont(income, 0.75) AS e3 FROM fact) ")
register("cut_quantile", q(_QEDGES + (
    ", b AS (SELECT CASE WHEN income <= e1 THEN 'Q1' WHEN income <= e2 THEN 'Q2' WHEN income <= e3 THEN 'Q3' "
    "ELSE 'Q4' END AS quartile, y FROM fact, qe) "
    "SELECT v.bin, v.quartile, coalesce(a.total, 0)::BIGINT AS total, coalesce(a.positives, 0)::BIGINT AS positives, "
    "a.rate FROM (VALUES (0, 'Q1'), (1, 'Q2'), (2, 'Q3'), (3, 'Q4')) v(bin, quartile) LEFT JOIN "
    f"(SELECT quartile, {O.rate_cols()} FROM b GROUP BY quartile) a USING (quartile)")))(
    lambda s, d: binning.cut_quantile(_f(s, d), "income", 4, "y"))

# ---------------------------------------------------------------- ranks, samples, splits
register("rank_pct", q(
    "SELECT row_id, income, (rank() OVER (ORDER BY income) + (count(*) OVER (PARTITION BY income) - 1) / 2.0) "
    "/ count(*) OVER () AS rank_pct FROM fact"))(
    lambda s, d: ranks.rank_pct(_f(s, d).select("row_id", "income"), "income"))

register("percentile_groups", q(
    ", r AS (SELECT y, (rank() OVER (ORDER BY income) + (count(*) OVER (PARTITION BY income) - 1) / 2.0) "
    "/ count(*) OVER () AS pct FROM fact) "
    + O.dense_cut_sql("pct", *_PERCENTILE, "band", with_sum=False, src="r")))(
    lambda s, d: A.percentile_groups(_f(s, d), R))

register("running_best", q(
    "SELECT row_id, dept, score, max(score) OVER (PARTITION BY dept ORDER BY row_id "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_max FROM fact"))(
    lambda s, d: ranks.running_max(_f(s, d).select("row_id", "dept", "score"), "score", "row_id", ["dept"],
                                   hashed_order=True))

register("sample_k", q(
    f"SELECT row_id, y, score FROM fact ORDER BY md5(concat_ws('|', '{SEED}', row_id)), row_id LIMIT 100"))(
    lambda s, d: ranks.seeded_sample(_f(s, d).select("row_id", "y", "score"), "row_id", 100, SEED))

_CLASS_RANK = (f", cr AS (SELECT row_id, y, row_number() OVER (PARTITION BY y ORDER BY md5(concat_ws('|', '{SEED}', "
               f"row_id))) AS class_rank, count(*) OVER (PARTITION BY y) AS class_n FROM fact) ")
register("stratified_split", q(_CLASS_RANK + (
    "SELECT row_id, y, CASE WHEN (class_rank - 1) * 100 < class_n * 60 THEN 'train' "
    "WHEN (class_rank - 1) * 100 < class_n * 80 THEN 'test' ELSE 'eval' END AS split FROM cr")))(
    lambda s, d: ranks.stratified_split(_f(s, d).select("row_id", "y"), "row_id", "y", seed=SEED)
    .select("row_id", "y", "split"))
register("stratified_folds", q(_CLASS_RANK + "SELECT row_id, y, CAST((class_rank - 1) % 7 AS INT) AS fold FROM cr"))(
    lambda s, d: ranks.stratified_folds(_f(s, d).select("row_id", "y"), "row_id", "y", 7, SEED)
    .select("row_id", "y", "fold"))

# ---------------------------------------------------------------- evaluation on the deterministic score
_SCORED = ", g AS (SELECT score AS s, sum(y)::BIGINT AS pos, (count(*) - sum(y))::BIGINT AS neg FROM fact GROUP BY score), " \
    "c AS (SELECT s, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS np_, " \
    "sum(neg) OVER () AS nn FROM g WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING)) "
register("roc_points", q(_SCORED + "SELECT s AS threshold, round(fp / nn, 6) AS fpr, round(tp / np_, 6) AS tpr FROM c "
                         "UNION ALL SELECT NULL, 0.0, 0.0"))(
    lambda s, d: ev.roc_points(_f(s, d)))
register("roc_corners", q(_SCORED + (
    ", e AS (SELECT s, fp, tp, nn, np_, pos, neg, lead(pos) OVER w AS p2, lead(neg) OVER w AS n2, lag(s) OVER w AS s0 FROM c "
    "WINDOW w AS (ORDER BY s DESC)) SELECT s AS threshold, round(fp / nn, 6) AS fpr, round(tp / np_, 6) AS tpr FROM e "
    "WHERE s0 IS NULL OR p2 IS NULL OR p2 <> pos OR n2 <> neg UNION ALL SELECT NULL, 0.0, 0.0")))(
    lambda s, d: ev.roc_corners(_f(s, d)))
register("pr_points", q(_SCORED + "SELECT s AS threshold, round(tp / (tp + fp), 6) AS precision, "
                        "round(tp / np_, 6) AS recall FROM c UNION ALL SELECT NULL, 1.0, 0.0"))(lambda s, d: ev.pr_points(_f(s, d)))
register("roc_auc", q(_SCORED + "SELECT round(sum((neg * (tp + tp - pos))::DOUBLE) / (2.0 * max(np_) * max(nn)), 6) "
                      "AS roc_auc FROM c"))(lambda s, d: ev.curve_summary(_f(s, d)).select("roc_auc"))
register("avg_precision", q(_SCORED + "SELECT round(sum(pos / np_ * tp / (tp + fp)), 6) AS avg_precision, "
                            "round(max(np_) / (max(np_) + max(nn)), 6) AS base_rate FROM c"))(
    lambda s, d: ev.curve_summary(_f(s, d)).select("avg_precision", "base_rate"))


def _grid_sql(grid) -> str:
    rows = " UNION ALL ".join(
        f"SELECT {t}::DOUBLE AS threshold, count_if(score >= {t} AND y = 1)::BIGINT AS tp, "
        f"count_if(score >= {t} AND y = 0)::BIGINT AS fp, count_if(score < {t} AND y = 0)::BIGINT AS tn, "
        f"count_if(score < {t} AND y = 1)::BIGINT AS fn FROM fact" for t in grid)
    return (f", cnt AS ({rows}), m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, "
            f"CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS rc, "
            f"CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0.0 END AS sp FROM cnt), "
            f"mm AS (SELECT *, CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0.0 END AS f FROM m) ")


register("threshold_sweep", q(_grid_sql(_SWEEP) + (
    "SELECT threshold, tp, fp, tn, fn, round(p, 6) AS precision, round(rc, 6) AS recall, round(f, 6) AS f1, "
    "round(sp, 6) AS specificity FROM mm")))(lambda s, d: ev.threshold_sweep(_f(s, d)))
register("best_threshold", q(_grid_sql(_F1_GRID) + (
    "SELECT threshold, round(f, 6) AS f1 FROM mm ORDER BY f DESC, threshold LIMIT 1")))(
    lambda s, d: ev.best_threshold(_f(s, d)))
_CONF = ", k AS (SELECT count_if(score >= 0.5 AND y = 1) AS tp, count_if(score >= 0.5 AND y = 0) AS fp, " \
    "count_if(score < 0.5 AND y = 0) AS tn, count_if(score < 0.5 AND y = 1) AS fn FROM fact) "
register("confusion", q(_CONF + (
    "SELECT 0 AS actual, 0 AS predicted, tn::BIGINT AS count FROM k UNION ALL SELECT 0, 1, fp::BIGINT FROM k "
    "UNION ALL SELECT 1, 0, fn::BIGINT FROM k UNION ALL SELECT 1, 1, tp::BIGINT FROM k")))(
    lambda s, d: ev.confusion(_f(s, d), 0.5))


def _sd(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) > 0 THEN ({a})::DOUBLE / ({b}) ELSE 0.0 END)"


_P1, _R1 = _sd("tp", "tp + fp"), _sd("tp", "tp + fn")
_P0, _R0 = _sd("tn", "tn + fn"), _sd("tn", "tn + fp")
_F1_1 = _sd(f"2 * {_P1} * {_R1}", f"{_P1} + {_R1}")
_F1_0 = _sd(f"2 * {_P0} * {_R0}", f"{_P0} + {_R0}")
_N = "(tp + fn + tn + fp)"
_ACC = _sd("tp + tn", _N)


def _w(a0: str, a1: str) -> str:
    return _sd(f"{a0} * (tn + fp) + {a1} * (tp + fn)", _N)


register("class_report", q(_CONF + " UNION ALL ".join(
    f"SELECT '{lab}' AS label, round({p}, 6) AS precision, round({r}, 6) AS recall, round({f}, 6) AS f1, "
    f"({sup})::BIGINT AS support FROM k" for lab, p, r, f, sup in [
        ("0", _P0, _R0, _F1_0, "tn + fp"), ("1", _P1, _R1, _F1_1, "tp + fn"),
        ("accuracy", _ACC, _ACC, _ACC, _N),
        ("macro avg", f"({_P0} + {_P1}) / 2", f"({_R0} + {_R1}) / 2", f"({_F1_0} + {_F1_1}) / 2", _N),
        ("weighted avg", _w(_P0, _P1), _w(_R0, _R1), _w(_F1_0, _F1_1), _N)])))(
    lambda s, d: ev.class_report(_f(s, d), 0.5))


def _split_scored(s, d):
    return ranks.stratified_split(_f(s, d).select("row_id", "y", "score"), "row_id", "y", seed=SEED)


register("f1_gap", q(_CLASS_RANK + (
    ", sp AS (SELECT cr.row_id, CASE WHEN (class_rank - 1) * 100 < class_n * 60 THEN 'train' "
    "WHEN (class_rank - 1) * 100 < class_n * 80 THEN 'test' ELSE 'eval' END AS split FROM cr), "
    "k AS (SELECT split, count_if(score >= 0.5 AND y = 1) AS tp, count_if(score >= 0.5 AND y = 0) AS fp, "
    "count_if(score < 0.5 AND y = 0) AS tn, count_if(score < 0.5 AND y = 1) AS fn "
    "FROM fact JOIN sp USING (row_id) WHERE split IN ('train', 'eval') GROUP BY split), "
    f"f AS (SELECT split, {_F1_1} AS f1 FROM k) "
    "SELECT round(max(CASE WHEN split = 'train' THEN f1 END), 6) AS f1_train, "
    "round(max(CASE WHEN split = 'eval' THEN f1 END), 6) AS f1_eval, "
    "round(max(CASE WHEN split = 'train' THEN f1 END) - max(CASE WHEN split = 'eval' THEN f1 END), 6) AS f1_gap FROM f")))(
    lambda s, d: ev.f1_gap(_split_scored(s, d), "split", 0.5))

# ---------------------------------------------------------------- scalar functions
register("round_even", q("SELECT dept, role, round_even(avg(y::DOUBLE), 3) AS rate3, "
                         "round_even(avg(y::DOUBLE) * 100, 2) AS rate_pct2 FROM fact GROUP BY dept, role"))(
    lambda s, d: _f(s, d).groupBy("dept", "role").agg(round_even(F.avg(F.col("y").cast("double")), 3).alias("rate3"),
                                                      round_even(F.avg(F.col("y").cast("double")) * 100, 2)
                                                      .alias("rate_pct2")))
register("risk_tier", q(
    "SELECT row_id, score, CASE WHEN score > 0.7 THEN 'RIESGO CRÍTICO (>70%)' WHEN score > 0.5 THEN "
    "'RIESGO ALTO (50-70%)' WHEN score > 0.3 THEN 'RIESGO MODERADO (30-50%)' ELSE 'RIESGO BAJO (<30%)' END AS tier "
    "FROM fact"))(lambda s, d: _f(s, d).select("row_id", "score", risk_tier("score").alias("tier")))
register("risk_factors", q(
    "SELECT row_id, concat_ws('; ', CASE WHEN overtime = 'Yes' THEN '🔴 Trabajo con horas extra' END, "
    "CASE WHEN travel = '1-URGENT' THEN '🔴 Viajes frecuentes' WHEN travel = '2-HIGH' THEN '🟡 Viajes ocasionales' END, "
    "CASE WHEN tenure < 2 THEN '🟡 Empleado relativamente nuevo' END, "
    "CASE WHEN income < 3000 THEN '🟡 Salario por debajo del promedio' END) AS factors FROM fact"))(
    lambda s, d: _f(s, d).select("row_id", F.concat_ws("; ", risk_factors(R)).alias("factors")))

# ---------------------------------------------------------------- composed analyses
register("rate_by_dept", q(
    f"SELECT dept, {O.rate_cols()}, round(count_if(outcome = 'No') * 100.0 / count(outcome), 6) AS no_pct, "
    f"round(count_if(outcome = 'Yes') * 100.0 / count(outcome), 6) AS yes_pct FROM fact GROUP BY dept"))(
    lambda s, d: A.rate_by_dept(_f(s, d), R))
register("dept_role", q(
    f"SELECT dept, role, {O.rate_cols()} FROM fact GROUP BY dept, role ORDER BY avg(y::DOUBLE) DESC NULLS LAST, dept, role "
    f"LIMIT 15"))(lambda s, d: A.dept_role(_f(s, d), R))
register("satisfaction_rates", q(" UNION ALL ".join(
    f"SELECT '{c}' AS variable, {c} AS level, {O.rate_cols()} FROM fact GROUP BY {c}"
    for c in ("job_sat", "env_sat", "rel_sat", "balance"))))(lambda s, d: A.satisfaction_rates(_f(s, d), R))
register("overtime_share", q(
    "SELECT dept, round(count_if(overtime = 'No') * 100.0 / count(*), 6) AS no_pct, "
    "round(count_if(overtime = 'Yes') * 100.0 / count(*), 6) AS yes_pct FROM fact GROUP BY dept"))(
    lambda s, d: A.overtime_share(_f(s, d), R))
register("fatigue", q(
    f"SELECT CASE WHEN overtime = 'Yes' OR travel = '1-URGENT' THEN 'Alta Fatiga' ELSE 'Normal' END AS factor, "
    f"{O.rate_cols()} FROM fact GROUP BY 1"))(lambda s, d: A.fatigue(_f(s, d), R))
register("high_risk_roles", q(
    f", g AS (SELECT role, overtime, travel, {O.rate_cols(with_sum=False)}, avg(y::DOUBLE) AS raw FROM fact "
    f"GROUP BY role, overtime, travel HAVING count(y) >= 3) SELECT role, overtime, travel, total, rate, "
    f"role || ' (' || travel || ')' AS detail FROM g WHERE overtime = 'Yes' AND "
    f"travel IN ('1-URGENT', '2-HIGH') ORDER BY raw DESC NULLS LAST, role, travel LIMIT 8"))(
    lambda s, d: A.high_risk_roles(_f(s, d), R))
register("early_career", q(
    f", qq AS (SELECT quantile_cont(income, 0.25) AS q1 FROM fact) "
    f"SELECT CASE WHEN age <= 30 AND income <= q1 AND marital = 'BUILDING' THEN 'Alto Riesgo (18-30, Q1, Single)' "
    f"ELSE 'Bajo Riesgo' END AS profile, {O.rate_cols()} FROM fact, qq GROUP BY 1"))(
    lambda s, d: A.early_career(_f(s, d), R))
register("age_income_quartiles", q(
    ", qa AS (SELECT quantile_cont(age, 0.25) a1, quantile_cont(age, 0.5) a2, quantile_cont(age, 0.75) a3, "
    "quantile_cont(income, 0.25) i1, quantile_cont(income, 0.5) i2, quantile_cont(income, 0.75) i3 FROM fact), "
    "b AS (SELECT CASE WHEN age <= a1 THEN 'Q1' WHEN age <= a2 THEN 'Q2' WHEN age <= a3 THEN 'Q3' ELSE 'Q4' END AS aq, "
    "CASE WHEN income <= i1 THEN 'Q1' WHEN income <= i2 THEN 'Q2' WHEN income <= i3 THEN 'Q3' ELSE 'Q4' END AS iq, "
    "y FROM fact, qa) SELECT aq AS age_quartile, " + ", ".join(
        f"round(avg(CASE WHEN iq = '{v}' THEN y::DOUBLE END), 6) AS {v}" for v in ("Q1", "Q2", "Q3", "Q4"))
    + " FROM b GROUP BY aq"))(lambda s, d: A.age_income_quartiles(_f(s, d), R))
register("equity_within_level", q(
    ", lv AS (SELECT level, quantile_cont(income, 0.25) AS q1 FROM fact GROUP BY level HAVING count(*) >= 5) "
    f"SELECT level, CASE WHEN income <= q1 THEN 'Q1 (Inferior)' ELSE 'Q2-Q4' END AS income_group, "
    f"{O.rate_cols(with_sum=False)} FROM fact JOIN lv USING (level) GROUP BY 1, 2 HAVING count(y) >= 3"))(
    lambda s, d: A.equity_within_level(_f(s, d), R))
_LOW = "(job_sat <= 2 OR env_sat <= 2)"
_OTHER = "(overtime = 'Yes' OR travel = '1-URGENT' OR age <= 30)"
register("climate", q(
    f"SELECT CASE WHEN {_OTHER} AND {_LOW} THEN 'Otros Factores + Baja Satisfacción' "
    f"WHEN NOT {_OTHER} AND {_LOW} THEN 'Solo Baja Satisfacción' WHEN {_OTHER} AND NOT {_LOW} THEN "
    f"'Solo Otros Factores' ELSE 'Sin Factores de Riesgo' END AS combination, {O.rate_cols(with_sum=False)} "
    f"FROM fact GROUP BY 1"))(lambda s, d: A.climate(_f(s, d), R))
register("low_satisfaction", q(
    f"SELECT CASE WHEN {_LOW} THEN 'Baja (1-2)' ELSE 'Alta (3-4)' END AS satisfaction, "
    f"{O.rate_cols(with_sum=False)} FROM fact GROUP BY 1"))(lambda s, d: A.low_satisfaction(_f(s, d), R))
register("top_combos", q(
    f"SELECT dept, gender, overtime, {O.rate_cols(with_sum=False)}, concat_ws(' + ', dept, gender, overtime) "
    f"AS combination FROM fact GROUP BY dept, gender, overtime HAVING count(y) >= 5 "
    f"ORDER BY avg(y::DOUBLE) DESC NULLS LAST, dept, gender, overtime LIMIT 10"))(lambda s, d: A.top_combos(_f(s, d), R))
register("category_detail", q(
    "SELECT role, count(*)::BIGINT AS count, round(count_if(outcome = 'No') * 100.0 / count(outcome), 6) AS no_pct, "
    "round(count_if(outcome = 'Yes') * 100.0 / count(outcome), 6) AS yes_pct, count_if(outcome = 'No')::BIGINT AS no_count, "
    "count_if(outcome = 'Yes')::BIGINT AS yes_count FROM fact GROUP BY role"))(
    lambda s, d: A.category_detail(_f(s, d), R, "role"))
_SUMMARY_NUMS = list(R.numerics)
register("final_summary", q(
    f", t AS (SELECT count(*) AS n, sum(y) AS p, avg(y::DOUBLE) AS m FROM fact), "
    f"c AS ({O.corr_with_sql('y', _SUMMARY_NUMS)}) "
    "SELECT 'total' AS metric, n::DOUBLE AS value, NULL::VARCHAR AS text FROM t "
    "UNION ALL SELECT 'positives', p::DOUBLE, NULL FROM t "
    "UNION ALL SELECT 'rate_pct', round(m * 100, 6), NULL FROM t "
    "UNION ALL (SELECT 'top_dept', round(avg(y::DOUBLE), 6), dept FROM fact GROUP BY dept "
    "ORDER BY avg(y::DOUBLE) DESC, dept LIMIT 1) "
    "UNION ALL (SELECT 'top_role', round(avg(y::DOUBLE), 6), role FROM fact GROUP BY role "
    "ORDER BY avg(y::DOUBLE) DESC, role LIMIT 1) "
    "UNION ALL SELECT 'overtime_rate', round(avg(y::DOUBLE), 6), overtime FROM fact GROUP BY overtime "
    "UNION ALL (SELECT 'top_correlate', round(abs(r), 6), variable FROM c ORDER BY abs(r) DESC NULLS LAST, variable LIMIT 5)"))(
    lambda s, d: A.final_summary(_f(s, d), R))

# ---------------------------------------------------------------- model data operators
from ratelens.operators import explain, features, training  # noqa: E402
from ratelens.sources.tables import materialize, packed, packed_id, unpacked  # noqa: E402

register("label_encode", q(
    ", " + ", ".join(f"e_{c} AS (SELECT {c}, (dense_rank() OVER (ORDER BY {c}) - 1)::INT AS {c}_code "
                     f"FROM (SELECT DISTINCT {c} FROM fact))" for c in O.CATS)
    + " SELECT row_id, " + ", ".join(f"{c}_code" for c in O.CATS) + " FROM fact "
    + " ".join(f"JOIN e_{c} USING ({c})" for c in O.CATS)))(
    lambda s, d: features.label_encode(_f(s, d).select("row_id", *O.CATS), O.CATS)
    .select("row_id", *[f"{c}_code" for c in O.CATS]))

register("target_encode", q(
    ", g AS (SELECT avg(y::DOUBLE) AS gm FROM fact), " + ", ".join(
        f"t_{c} AS (SELECT {c}, (count(y) * avg(y::DOUBLE) + 1.0 * gm) / (count(y) + 1.0) AS {c}_te "
        f"FROM fact, g GROUP BY {c}, gm)" for c in O.CATS)
    + " SELECT row_id, " + ", ".join(f"round({c}_te, 6) AS {c}_te" for c in O.CATS) + " FROM fact "
    + " ".join(f"LEFT JOIN t_{c} USING ({c})" for c in O.CATS)))(
    lambda s, d: features.fit_target_encoding(_f(s, d), O.CATS, "y", 1.0, 1)
    .transform(_f(s, d).select("row_id", *O.CATS))
    .select("row_id", *[F.round(f"{c}_te", 6).alias(f"{c}_te") for c in O.CATS]))

register("class_weight", q(
    "SELECT count_if(y = 0)::BIGINT AS n_neg, count_if(y = 1)::BIGINT AS n_pos, "
    "round(count_if(y = 0)::DOUBLE / count_if(y = 1), 6) AS weight FROM fact"))(
    lambda s, d: features.class_weight(_f(s, d), "y"))


def model_data(spark, sf):
    """fact + split (60/20/20) + fold (7) from one rank pass, written once per application."""
    return materialize(spark, lambda: ranks.class_ranks(_f(spark, sf), "row_id", "y", SEED).withColumns(
        {"split": ranks.split_label(), "fold": ranks.fold_label(training.N_FOLDS)}), "model_data", sf)


def split_data(spark, sf):
    """fact + split (60/20/20, the one of ``model_data``), written once per application as packed rows in the view's order: what
    needs no folds doesn't shuffle rows for them."""
    def make():
        placed = _f(spark, sf).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
        return ranks.cut_split(packed(placed), packed_id(), "y", ["_file", "_row"], seed=SEED)
    return unpacked(materialize(spark, make, "split_data", sf))


_MODELS: dict = {}


def trained(spark, sf, encoding: str = "label") -> training.TrainedModel:
    key = (spark.sparkContext.applicationId, sf, encoding)
    if key not in _MODELS:
        _MODELS[key] = training.train(split_data(spark, sf), R, encoding=encoding)
    return _MODELS[key]


def _train_summary(s, d):
    tm = trained(s, d)
    data = split_data(s, d)
    scored = tm.score(data, keep=["y", "split"])
    c = ev.with_metrics(ev.threshold_counts(scored, [tm.threshold], "y", "score", by=["split"]))
    return c.select("split", (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).alias("rows"),
                    "threshold", "precision", "recall", "f1", F.lit(tm.rounds_tried).alias("rounds_tried"),
                    F.lit(tm.rounds_kept).alias("rounds_kept"))


register("train_gbt")(_train_summary)


def _scored(s, d, records):
    tm = trained(s, d)
    scored = tm.score(records, keep=["row_id", *R.categoricals, *R.numerics])
    return scored.select("row_id", "score", "prediction", risk_tier("score").alias("tier"),
                         F.concat_ws("; ", risk_factors(R)).alias("factors"))


# full records, and records of the short form's fields with its defaults
register("score_batch")(lambda s, d: _scored(s, d, _f(s, d)))
register("score_form")(lambda s, d: _scored(s, d, facets.fill_defaults(_f(s, d).select(*FORM_FIELDS), R)))
# what holds for any model: every record is scored once
register("score_counts", q("SELECT dept, count(*)::BIGINT AS records, count(*)::BIGINT AS in_unit_interval, "
                           "count(*)::BIGINT AS tier_agrees FROM fact GROUP BY dept"))(
    lambda s, d: trained(s, d).score(_f(s, d), keep=["dept"]).groupBy("dept").agg(
        F.count("score").alias("records"), F.count_if(F.col("score").between(0, 1)).alias("in_unit_interval"),
        F.count_if((F.col("score") > 0.7) == risk_tier("score").startswith("RIESGO CRÍTICO")).alias("tier_agrees")))
register("split_counts", q(_CLASS_RANK + (
    ", sp AS (SELECT y, CASE WHEN (class_rank - 1) * 100 < class_n * 60 THEN 'train' "
    "WHEN (class_rank - 1) * 100 < class_n * 80 THEN 'test' ELSE 'eval' END AS split, "
    "CAST((class_rank - 1) % 7 AS INT) AS fold FROM cr) "
    "SELECT y, split, fold, count(*)::BIGINT AS records FROM sp GROUP BY y, split, fold")))(
    lambda s, d: model_data(s, d).groupBy("y", "split", "fold").agg(F.count(F.lit(1)).alias("records")))
register("feature_importance")(lambda s, d: explain.feature_importance(trained(s, d), top_n=15))
register("cv_scores")(lambda s, d: training.fold_f1(
    model_data(s, d).where(F.col("split") == "train"), R, training.DEFAULT_PARAMS))
register("corr_numeric", q(O.corr_sql(["y", "age", "income", "level"]) + "SELECT c1, c2, i, j, round(r, 6) AS r FROM corr"))(
    lambda s, d: stats.corr_long(_f(s, d).select("y", "dept", "age", "income", "overtime", "level")))


def _search_log(s, d):
    # all of the library's trials, halved at each rung; the log records their number
    log, _ = training.search(model_data(s, d).where(F.col("split") == "train"), R)
    return ranks.running_max(log, "score", "step", name="best_so_far")


register("search_log")(_search_log)


def _attribution(s, d):
    tm = trained(s, d)
    data = split_data(s, d)
    rows = explain.sample_rows(data.where(F.col("split") == "eval"), "row_id", 100, SEED)
    bg = explain.sample_rows(data.where(F.col("split") == "train"), "row_id", 50, SEED + 1)
    return explain.mean_abs_attribution(explain.shapley(tm, rows, bg, "row_id", n_perm=8, seed=SEED))


register("attribution")(_attribution)


def _attribution_rows(s, d):
    data = split_data(s, d)
    rows = explain.sample_rows(data.where(F.col("split") == "eval"), "row_id", 100, SEED)
    bg = explain.sample_rows(data.where(F.col("split") == "train"), "row_id", 50, SEED + 1)
    return explain.attribution_rows(trained(s, d), rows, bg, "row_id", seed=SEED)


register("attribution_rows")(_attribution_rows)


def _report_part(part):
    return lambda s, d: training.model_report(trained(s, d), split_data(s, d), parts=(part,))[part]


register("permutation_importance")(lambda s, d: explain.permutation_importance(
    trained(s, d), split_data(s, d).where(F.col("split") == "eval"), "row_id", "y", SEED))
register("model_report")(_report_part("summary"))
for _part in ("info", "importance", "attribution", "roc", "pr", "sweep", "confusion", "class_report"):
    register(f"model_report_{_part}")(_report_part(_part))


def _format_kpis(s, d):
    k = A.kpis(facets.faceted_filter(_f(s, d), FACETS_ISIN, FACETS_RANGES), R)
    from ratelens.functions.scalar import count_text, money_text, pct_text
    return k.select(count_text("total").alias("total"), pct_text("rate_pct").alias("rate"),
                    F.format_string("%.1f", "avg_job_sat").alias("avg_job_sat"),
                    money_text("avg_income").alias("avg_income"), F.format_string("%.1f", "avg_tenure").alias("avg_tenure"))


register("format_kpis", q(
    f", k AS (SELECT count(*) AS total, round(avg(y::DOUBLE) * 100, 6) AS rate_pct, round(avg(job_sat), 6) AS js, "
    f"round(avg(income), 6) AS inc, round(avg(tenure), 6) AS ten FROM fact WHERE {FACETS_SQL}) "
    "SELECT format('{:,}', total) AS total, printf('%.1f%%', rate_pct) AS rate, printf('%.1f', js) AS avg_job_sat, "
    "'$' || format('{:,.0f}', inc) AS avg_income, printf('%.1f', ten) AS avg_tenure FROM k"))(_format_kpis)


# results are rounded here, after the order is decided on raw values; curve thresholds and scores stay raw
_RAW = ("threshold", "score", "income")
for _key in ("kpis outcome_rate outcome_rate_multi mean_by_level category_share crosstab_pct pivot_mean dept_overtime "
             "all_variables top_categories describe describe_where describe_by corr_matrix corr_lower corr_numeric top_corr "
             "outcome_corr quantile_exact histogram box_stats box_stats_by cut_fixed age_bands tenure_bands stagnation "
             "cut_equal income_bands cut_quantile percentile_groups roc_points roc_corners pr_points roc_auc avg_precision "
             "threshold_sweep best_threshold class_report f1_gap rate_by_dept dept_role satisfaction_rates overtime_share "
             "fatigue high_risk_roles early_career age_income_quartiles equity_within_level climate low_satisfaction "
             "top_combos category_detail final_summary class_weight attribution permutation_importance train_gbt "
             "cv_scores attribution_rows facet_index_rates csv_summary").split():
    QUERIES[_key] = _rounded(QUERIES[_key])
