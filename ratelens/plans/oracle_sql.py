"""DuckDB twins of the registered queries (the correctness oracle).

``fact`` is the view of the driver tables defined in the fixtures; every query below
starts from it. Counts are cast to BIGINT and rates rounded to 6 places on both sides.
"""

from __future__ import annotations

import itertools

from ratelens.roles import FACT_ROLES as R

FACT_CTE = """WITH fact AS MATERIALIZED (
SELECT
  md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                CAST(round(l_extendedprice*100) AS BIGINT), CAST(CAST(l_shipdate AS DATE) AS VARCHAR))) AS row_id,
  CASE WHEN l_returnflag = 'R' THEN 'Yes' ELSE 'No' END AS outcome,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
  o_orderstatus AS dept, p_type AS role, l_linestatus AS gender, c_mktsegment AS marital,
  n_name AS education_field, o_orderpriority AS travel,
  CASE WHEN l_discount >= 0.055 THEN 'Yes' ELSE 'No' END AS overtime,
  CAST(l_quantity AS INT) AS age, l_extendedprice AS income, l_linenumber AS level,
  p_size AS experience, p_size - 1 AS tenure, least(l_linenumber, p_size - 1) AS role_years,
  CAST(1 + l_partkey % 4 AS INT) AS job_sat, CAST(1 + l_suppkey % 4 AS INT) AS env_sat,
  CAST(1 + l_orderkey % 4 AS INT) AS rel_sat, CAST(1 + o_custkey % 4 AS INT) AS balance,
  c_acctbal AS rate1, 80 AS constant_col, l_extendedprice / 105000.0 AS score
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
     JOIN part ON l_partkey = p_partkey JOIN nation ON c_nationkey = n_nationkey)
"""


def q(body: str) -> str:
    return FACT_CTE + body


def rate_cols(y: str = "y", with_sum: bool = True, total: str = "total", positives: str = "positives",
              rate: str = "rate") -> str:
    s = f"count({y})::BIGINT AS {total}, "
    if with_sum:
        s += f"coalesce(sum({y}), 0)::BIGINT AS {positives}, "
    return s + f"round(avg({y}::DOUBLE), 6) AS {rate}"


def cut_case(x: str, edges, labels, include_lowest: bool = False) -> str:
    parts = []
    for i, lab in enumerate(labels):
        lo_op = ">=" if (i == 0 and include_lowest) else ">"
        lab_sql = lab.replace("'", "''") if isinstance(lab, str) else lab
        val = f"'{lab_sql}'" if isinstance(lab, str) else str(lab)
        parts.append(f"WHEN {x} {lo_op} {edges[i]} AND {x} <= {edges[i + 1]} THEN {val}")
    return "CASE " + " ".join(parts) + " END"


def dense_cut_sql(x: str, edges, labels, label_col: str, with_sum: bool = True, src: str = "fact") -> str:
    vals = ", ".join(f"({i}, '{lab}')" for i, lab in enumerate(labels))
    pos = "coalesce(a.positives, 0)::BIGINT AS positives, " if with_sum else ""
    return (f"SELECT b.bin, b.{label_col}, coalesce(a.total, 0)::BIGINT AS total, {pos}a.rate "
            f"FROM (VALUES {vals}) b(bin, {label_col}) LEFT JOIN "
            f"(SELECT {cut_case(x, edges, labels)} AS {label_col}, {rate_cols('y', with_sum)} FROM {src} "
            f"WHERE {cut_case(x, edges, labels)} IS NOT NULL GROUP BY 1) a USING ({label_col})")


def corr_sql(columns) -> str:
    pairs = list(itertools.combinations_with_replacement(range(len(columns)), 2))
    aggs = []
    for i, j in pairs:
        a, b = f"{columns[i]}::DOUBLE", f"{columns[j]}::DOUBLE"
        den = f"(stddev_samp({a}) * stddev_samp({b}))"
        aggs.append(f"CASE WHEN {den} > 0 THEN covar_samp({a}, {b}) / {den} END AS _{i}_{j}")
    rows = []
    for i, j in pairs:
        rows.append(f"SELECT '{columns[i]}' AS c1, '{columns[j]}' AS c2, {i} AS i, {j} AS j, _{i}_{j} AS r FROM m")
        if i != j:
            rows.append(f"SELECT '{columns[j]}' AS c1, '{columns[i]}' AS c2, {j} AS i, {i} AS j, _{i}_{j} AS r FROM m")
    return f", m AS (SELECT {', '.join(aggs)} FROM fact), corr AS ({' UNION ALL '.join(rows)}) "


def corr_with_sql(y: str, columns) -> str:
    rows = []
    for c in columns:
        a, b = f"{c}::DOUBLE", f"{y}::DOUBLE"
        den = f"(stddev_samp({a}) * stddev_samp({b}))"
        rows.append(f"SELECT '{c}' AS variable, CASE WHEN {den} > 0 THEN covar_samp({a}, {b}) / {den} END "
                    f"AS r FROM fact")
    return " UNION ALL ".join(rows)


def long_values_sql(columns, by=(), where: str = "") -> str:
    bys = "".join(f"{b}, " for b in by)
    w = f" WHERE {where}" if where else ""
    return " UNION ALL ".join(f"SELECT {bys}'{c}' AS variable, {c}::DOUBLE AS value FROM fact{w}" for c in columns)


def describe_sql(columns, by=(), where: str = "") -> str:
    bys = "".join(f"{b}, " for b in by)
    return q(f", long AS ({long_values_sql(columns, by, where)}) "
             f"SELECT {bys}variable, count(value)::BIGINT AS count, round(avg(value), 6) AS mean, "
             f"round(stddev_samp(value), 6) AS std, min(value) AS min, "
             f"round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, "
             f"round(quantile_cont(value, 0.75), 6) AS q75, max(value) AS max "
             f"FROM long WHERE value IS NOT NULL GROUP BY {bys}variable")


def box_sql(columns, by=()) -> str:
    bys = "".join(f"{b}, " for b in by)
    keys = ", ".join([*by, "variable"])
    return q(f", long AS ({long_values_sql(columns, by)}), "
             f"qs AS (SELECT {keys}, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, "
             f"quantile_cont(value, 0.75) AS q3 FROM long GROUP BY {keys}) "
             f"SELECT {bys}variable, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, "
             f"round(q3 - q1, 6) AS iqr, "
             f"least(min(CASE WHEN value >= q1 - 1.5 * (q3 - q1) THEN value END), q1) AS whisker_lo, "
             f"greatest(max(CASE WHEN value <= q3 + 1.5 * (q3 - q1) THEN value END), q3) AS whisker_hi, "
             f"count_if(value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))::BIGINT AS outliers, "
             f"count(value)::BIGINT AS count "
             f"FROM long JOIN qs USING ({keys}) GROUP BY {keys}, q1, median, q3")


from ratelens.roles import FACT_EDA_NUMERICS  # noqa: E402

NUMS = list(FACT_EDA_NUMERICS)
CATS = list(R.categoricals)
