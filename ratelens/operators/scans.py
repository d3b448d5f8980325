"""Running sums, exact quantiles and ranks without a global window.

A window with no partition key (or with one hot key) moves every row of that key into
one task. Here the ordered rows are cut into range buckets, each bucket is summed
independently, the few bucket totals get running offsets, and the running sum inside a
bucket is a window over ``(keys, bucket)`` only. The result is exact whatever the
bucket edges are; edges only decide how evenly the work spreads.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

DEFAULT_BUCKETS = None   # derived from the session's shuffle parallelism (see bucket_count)
MIN_BUCKETS = 64
BROADCAST_ROWS = 200_000   # of a few numbers each
_G = "_rl_group"


def bucket_count(spark) -> int:
    """Range buckets per group: about 4 per shuffle partition the session is configured
    for (so the bucket windows can occupy the whole cluster), a power of two from 64 on."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    b = MIN_BUCKETS
    while b < 4 * parts:
        b *= 2
    return b


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``left`` joined to ``right`` on ``keys``, null keys matching null keys; the keys come from ``left``."""
    r = right.select(*[F.col(k).alias(f"_rk_{i}") for i, k in enumerate(keys)],
                     *[c for c in right.columns if c not in keys])
    cond = None
    for i, k in enumerate(keys):
        c = F.col(k).eqNullSafe(F.col(f"_rk_{i}"))
        cond = c if cond is None else cond & c
    return left.join(r, cond, how).drop(*[f"_rk_{i}" for i in range(len(keys))])


def small_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written, with a broadcast hint if its counted rows are few (``BROADCAST_ROWS``): a join then leaves the other side's
    rows where they are; without one, for a shuffled join, if not."""
    from ratelens.sources.tables import temporary

    own = temporary(df, name)
    return F.broadcast(own) if own.count() <= BROADCAST_ROWS else own


def _keys(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    if by:
        return df, list(by)
    return df.withColumn(_G, F.lit(0)), [_G]


def range_buckets(df: DataFrame, order_col: str, by: Sequence[str] = (),
                  buckets: int | None = DEFAULT_BUCKETS, extra: Sequence[Column] = ()) -> DataFrame:
    """Adds ``_bucket``: one of ``buckets`` value ranges of ``order_col`` per group, cut at
    approximate quantiles, so a long tail or a few outliers cannot crowd most values into
    one bucket (one task). ``extra`` group aggregates come from the same pass.

    The sketch is ten times finer than the cuts asked of it. The edges are fixed once per
    call (in a written table of one row a group, whatever their number; without groups as
    literals), so a recomputed plan (e.g. after an executor loss) assigns exactly the same
    buckets; exactness of the results never depends on the edges, only the balance of the
    work does."""
    from ratelens.sources.tables import temporary

    d, keys = _keys(df, by)
    v = F.col(order_col).cast("double")
    wanted, buckets = buckets or bucket_count(df.sparkSession), 1
    while buckets < wanted:
        buckets *= 2                  # a power of two: the search below takes log2 steps
    probs = [i / buckets for i in range(1, buckets)]
    aggs = [F.percentile_approx(v, probs, 10 * buckets).alias("_edges"), *extra]
    if by:
        d = join_keys(d, temporary(d.groupBy(*keys).agg(*aggs), "bucket_edges"), keys)
    else:
        # one row by definition, of as many numbers as buckets: literals of the plan
        one = d.agg(*aggs)
        row = one.first().asDict()
        cuts = row.pop("_edges") or [float("inf")] * (buckets - 1)
        d = d.withColumns({k: F.lit(x).cast(one.schema[k].dataType) for k, x in row.items()})
        d = d.withColumn("_edges", F.lit(np.array(cuts, float)))
    # bucket = number of edges < value, by an unrolled binary search over the sorted
    # edges (log2(buckets) element_at + compare steps, all code-generated)
    d = d.withColumn("_bucket", F.lit(0))
    step = buckets // 2
    while step >= 1:
        d = d.withColumn("_bucket", F.col("_bucket") + F.when(
            F.element_at(F.col("_edges"), F.col("_bucket") + step) < v, F.lit(step)).otherwise(F.lit(0)))
        step //= 2
    return d.drop("_edges")


def hash_buckets(df: DataFrame, hash_col: str, digits: int | None = None) -> DataFrame:
    """Adds ``_bucket`` from the leading hex digits of a uniform hash (16**digits buckets,
    order-preserving with respect to the hash string). By default the digit count gives at
    least as many buckets as ``bucket_count`` (2 digits locally, up to 4 on a cluster)."""
    if digits is None:
        target, digits = bucket_count(df.sparkSession), 2
        while 16 ** digits < target:
            digits += 1
    return df.withColumn("_bucket", F.conv(F.substring(F.col(hash_col), 1, digits), 16, 10).cast("int"))


def cumulative(df: DataFrame, order: Sequence[str], sums: Sequence[str], by: Sequence[str] = (),
               descending: bool = False, bucketed: DataFrame | None = None,
               buckets: int | None = DEFAULT_BUCKETS, inclusive: bool = True, how: str = "sum",
               write_offsets: bool = False) -> DataFrame:
    """Running sums ``cum_<c>`` of ``sums`` over rows ordered by ``order`` within ``by``.

    Ties in ``order`` are broken by the row order of the remaining ``order`` columns;
    callers aggregate to distinct order values first when ties must share a value.
    ``bucketed`` may hand in a frame that already carries ``_bucket`` (e.g. from
    ``hash_buckets``); otherwise range buckets of ``order[0]`` are made. Bucket numbers
    must be monotone in ``order`` (ascending). ``how="max"`` gives running maxima. ``write_offsets`` is for wide rows: the offsets
    are written first, so that their counted rows tell whether the rows can stay where they are when the two meet.
    """
    agg = {"sum": F.sum, "max": F.max}[how]
    zero = F.lit(0) if how == "sum" else F.lit(None)
    if bucketed is None:
        bucketed = range_buckets(df, order[0], by, buckets)
    keys = list(by) or [_G]
    d = bucketed if (by or _G in bucketed.columns) else bucketed.withColumn(_G, F.lit(0))
    keep = [c for c in df.columns if c != "_bucket"]
    sort = [F.desc(c) if descending else F.asc(c) for c in order]
    bsort = F.desc("_bucket") if descending else F.asc("_bucket")
    totals = d.groupBy(*keys, "_bucket").agg(*[agg(c).alias(f"_t_{c}") for c in sums])
    wb = W.partitionBy(*keys).orderBy(bsort).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_bucket",
                            *[F.coalesce(agg(f"_t_{c}").over(wb), zero).alias(f"_o_{c}") for c in sums])
    end = W.currentRow if inclusive else -1
    wr = W.partitionBy(*keys, "_bucket").orderBy(*sort).rowsBetween(W.unboundedPreceding, end)
    inner = d.select("*", *[F.coalesce(agg(c).over(wr), zero).alias(f"_i_{c}") for c in sums])
    combine = (lambda a, b: a + b) if how == "sum" else (lambda a, b: F.greatest(a, b))
    # the small offsets table (one row per group and bucket) is joined to the rows
    offsets = small_table(offsets, "offsets") if write_offsets else offsets
    out = join_keys(inner, offsets, [*keys, "_bucket"]).select(
        *keep,
        *[combine(F.col(f"_i_{c}"), F.col(f"_o_{c}")).alias(f"cum_{c}") for c in sums])
    return out


def value_counts_cum(df: DataFrame, x: str, by: Sequence[str] = (), weights: dict[str, Column] | None = None,
                     descending: bool = False, buckets: int | None = DEFAULT_BUCKETS) -> DataFrame:
    """Distinct values of ``x`` per group with ``cnt`` (and weighted sums), plus running
    totals ``cum_cnt`` ... in value order. Nulls in ``x`` are dropped."""
    aggs = [F.count(F.lit(1)).alias("cnt")]
    for name, expr in (weights or {}).items():
        aggs.append(F.sum(expr).alias(name))
    distinct = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(*aggs)
    return cumulative(distinct, [x], ["cnt", *(weights or {})], by, descending=descending, buckets=buckets)


#: Size parameter of the quantile sketches, ranks asked of each, and most values a bracket may hold before they are ranked.
SKETCH_K = 4096
SKETCH_RANKS = 2048
BRACKET_ROWS = 200_000


def _rank_margin(k: int) -> float:
    """One and a half times the rank error (99 %) of a sketch of size ``k``, as a share of its values."""
    return 1.5 * 2.296 / k ** 0.9021


def exact_quantiles(df: DataFrame, x: str, probs: Sequence[float], by: Sequence[str] = (),
                    buckets: int | None = None) -> DataFrame:
    """Linear-interpolated quantiles (numpy/pandas default, DuckDB ``quantile_cont``): ``(by..., pi, p, value)``.

    Values are bracketed, not shuffled. A mergeable KLL sketch per group gives two bounds around each wanted rank; a second pass
    counts what lies below and between the bounds and keeps single values only inside them (a few thousandths). Where that
    is still more than ``BRACKET_ROWS``, the inside is sketched again first. The counts prove that a rank is inside its
    bracket; if a sketch was off, the call is repeated with wider bounds, so the result is exact. NaN is the largest value.
    ``buckets`` sets the sketch's size (default ``SKETCH_K``)."""
    d, keys = _keys(df, by)
    d = d.where(F.col(x).isNotNull()).select(*keys, F.col(x).cast("double").alias("_v"))
    k = max(8, min(buckets or SKETCH_K, 65535))
    margin = _rank_margin(k)
    while True:
        res = _ranked_inside(d, keys, probs, _brackets(d, keys, probs, k, margin))
        if res.where("_missing").isEmpty():
            break
        margin *= 4
    return res.select(*[c for c in keys if c != _G], "pi", "p", "value")


def _brackets(d: DataFrame, keys: list[str], probs: Sequence[float], k: int, margin: float) -> DataFrame:
    """One row a group: bounds ``_lo<i>`` and ``_hi<i>`` (-inf and NaN: none) of the ranks around ``(n-1)p``."""
    from ratelens.sources.tables import temporary

    def rank(i: int, up: bool, n: str) -> Column:
        h = (F.col(n) - 1) * F.lit(float(probs[i]))
        return (F.ceil(h) if up else F.floor(h)).cast("double")

    grid = F.lit(np.arange(SKETCH_RANKS + 1) / SKETCH_RANKS)  # ranks must be literals

    def at(grid_col: str, share: Column, up: bool) -> Column:
        place = (F.ceil if up else F.floor)(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * SKETCH_RANKS)
        return F.element_at(F.col(grid_col), (place + 1).cast("int"))

    first = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.kll_sketch_agg_double("_v", F.lit(k)).alias("_s"))
    first = first.withColumn("_m", F.kll_sketch_get_n_double("_s"))  # without NaN
    first = first.withColumn("_g", F.when(F.col("_m") > 0, F.kll_sketch_get_quantile_double("_s", grid)))
    bounds = []
    for i in range(len(probs)):
        low = (rank(i, False, "_n") - 1) / F.col("_m") - margin
        high = (rank(i, True, "_n") + 2) / F.col("_m") + margin
        bounds += [F.when((F.col("_m") == 0) | (low <= 0), F.lit(float("-inf"))).otherwise(at("_g", low, False)).alias(f"_lo{i}"),
                   F.when((F.col("_m") == 0) | (high >= 1), F.lit(float("nan"))).otherwise(at("_g", high, True)).alias(f"_hi{i}")]
    now = temporary(first.select(*keys, "_n", *bounds, (F.col("_n") * F.lit(2 * margin)).alias("_inside")), "brackets")
    while margin < 0.1 and (now.agg(F.max("_inside")).first()[0] or 0) > BRACKET_ROWS:
        own = [f"_{side}{i}" for i in range(len(probs)) for side in ("lo", "hi")]
        v, aggs = F.col("_v"), []
        for i in range(len(probs)):
            lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
            between = (v > lo) & (v < hi)
            aggs += [F.count_if(v < lo).alias(f"_b{i}"), F.count_if(v == lo).alias(f"_a{i}"), F.count_if(between).alias(f"_c{i}"),
                     F.kll_sketch_agg_double(F.when(between, v), F.lit(k)).alias(f"_s{i}")]
        seen = _with_brackets(d, keys, now).groupBy(*keys, "_n", *own).agg(*aggs)
        seen = seen.withColumns({f"_g{i}": F.when(F.col(f"_c{i}") > 0, F.kll_sketch_get_quantile_double(f"_s{i}", grid)) for i in range(len(probs))})
        bounds, inside = [], F.lit(0.0)
        for i in range(len(probs)):
            lo, hi, n = F.col(f"_lo{i}"), F.col(f"_hi{i}"), F.col(f"_c{i}")
            r, r2, under = rank(i, False, "_n"), rank(i, True, "_n"), F.col(f"_b{i}") + F.col(f"_a{i}")
            low, high = (r - under - 1) / n - margin, (r2 - under + 2) / n + margin
            bounds += [F.when(r < under, lo).when(r >= under + n, hi).when(low <= 0, lo).otherwise(at(f"_g{i}", low, False)).alias(f"_lo{i}"),
                       F.when(r2 < under, lo).when(r2 >= under + n, hi).when(high >= 1, hi).otherwise(at(f"_g{i}", high, True)).alias(f"_hi{i}")]
            inside = F.greatest(inside, F.when((r2 < under) | (r >= under + n), F.lit(0.0)).otherwise(n * F.lit(2 * margin)))
        now = temporary(seen.select(*keys, "_n", *bounds, inside.alias("_inside")), "brackets")
    return now


def _with_brackets(d: DataFrame, keys: list[str], brackets: DataFrame) -> DataFrame:
    """Every row with its group's bounds: literals without groups, else a join with the written table, whose size is known."""
    if keys != [_G]:
        return join_keys(d, brackets, keys)
    row = brackets.first()
    bounds = {c: row[c] if row else float("nan") for c in brackets.columns if c != _G}
    return d.withColumns({c: F.lit(b) for c, b in bounds.items()})


def _ranked_inside(d: DataFrame, keys: list[str], probs: Sequence[float], brackets: DataFrame) -> DataFrame:
    """``(keys, pi, p, value, _missing)``: rows are counted by region (the bounds passed), single values only where a region
    lies in a bracket; the running counts tell the values at the wanted ranks."""
    from ratelens.sources.tables import temporary

    v = F.col("_v")
    passed = sum((v >= F.col(f"_lo{i}")).cast("int") for i in range(len(probs)))
    left = sum((v > F.col(f"_hi{i}")).cast("int") for i in range(len(probs)))
    counted = (_with_brackets(d, keys, brackets)
               .select(*keys, (passed + left).alias("_region"), F.when(passed > left, v).alias("_v"))
               .groupBy(*keys, "_region", "_v").agg(F.count(F.lit(1)).alias("cnt")))
    whole = W.partitionBy(*keys)
    upto = whole.orderBy("_region", "_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    counted = counted.select(*keys, "_v", "cnt", F.sum("cnt").over(upto).alias("_cum"), F.sum("cnt").over(whole).alias("_n"))
    targets = F.array(*[F.struct(F.lit(i).alias("pi"), F.lit(float(p)).alias("p"), ((F.col("_n") - 1) * F.lit(float(p))).alias("h"))
                        for i, p in enumerate(probs)])
    here = lambda t: (((F.floor(t["h"]) >= F.col("_cum") - F.col("cnt")) & (F.floor(t["h"]) < F.col("_cum")))
                      | ((F.ceil(t["h"]) >= F.col("_cum") - F.col("cnt")) & (F.ceil(t["h"]) < F.col("_cum"))))
    hits = counted.select(*keys, "_v", F.explode(F.filter(targets, here)).alias("_t"))
    low, high, frac = F.col("_low"), F.col("_high"), F.col("h") - F.floor("h")
    res = (hits.select(*keys, "_v", "_t.pi", "_t.p", "_t.h").groupBy(*keys, "pi", "p", "h")
               .agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.bool_or(F.col("_v").isNull()).alias("_missing")))
    value = F.when((low == high) | (frac == 0), low).otherwise(low + (high - low) * frac)
    return temporary(res.select(*keys, "pi", "p", value.alias("value"), "_missing"), "quantiles")
