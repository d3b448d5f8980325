"""Ranks, running values, hashed splits and seeded samples.

None of these uses a window over a whole table or a whole class: see ``scans``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ratelens.operators.scans import cumulative, hash_buckets, join_keys, range_buckets

DIGITS = 6


def seeded_hash(row_id: str | Column, seed: int = 42) -> Column:
    """Repeatable pseudo-random order of rows: md5 of ``seed|row_id`` (same in DuckDB)."""
    own = F.col(row_id) if isinstance(row_id, str) else row_id
    return F.md5(F.concat_ws("|", F.lit(str(seed)), own.cast("string")))


def value_ranks(df: DataFrame, x: str, by: Sequence[str] = (), weights: dict[str, Column] | None = None) -> DataFrame:
    """Distinct values of ``x`` with ``cnt``, optional weighted sums, the group size ``n``
    and the average (tie-shared) 1-based rank ``avg_rank`` of the value."""
    aggs = [F.count(F.lit(1)).alias("cnt"), *[F.sum(e).alias(k) for k, e in (weights or {}).items()]]
    distinct = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(*aggs)
    bucketed = range_buckets(distinct, x, by, extra=[F.sum("cnt").alias("n")])
    cum = cumulative(bucketed, [x], ["cnt"], by, bucketed=bucketed)
    return cum.withColumn("avg_rank", F.col("cum_cnt") - F.col("cnt") + (F.col("cnt") + 1) / 2.0)


def rank_pct(df: DataFrame, x: str, by: Sequence[str] = (), name: str = "rank_pct") -> DataFrame:
    """Pandas ``rank(pct=True)``: average rank of ties divided by the count of
    non-null values, in (0, 1]. Computed on distinct values, then joined back."""
    ranks = value_ranks(df, x, by).select(*by, x, (F.col("avg_rank") / F.col("n")).alias(name))
    # a null value has no rank; null group keys match each other. One common value is one row of ``ranks``:
    # AQE splits its partition of ``df``
    return join_keys(df, ranks, [*by, x], "left")


def running_max(df: DataFrame, value: str, order: str, by: Sequence[str] = (), hashed_order: bool = False,
                name: str = "running_max") -> DataFrame:
    """Running maximum of ``value`` in ``order`` within ``by`` (rows unique by order).
    ``hashed_order`` marks an md5-hex order column, bucketed by its leading digits."""
    bucketed = hash_buckets(df, order) if hashed_order else None
    out = cumulative(df, [order], [value], by, bucketed=bucketed, how="max")
    return out.withColumnRenamed(f"cum_{value}", name)


def seeded_sample(df: DataFrame, row_id: str, k: int, seed: int = 42) -> DataFrame:
    """K rows without replacement, repeatable: the k smallest seeded hashes
    (a distributed take-ordered; each task keeps at most k rows)."""
    return df.orderBy(seeded_hash(row_id, seed), F.col(row_id)).limit(k)


def class_ranks(df: DataFrame, row_id: str, y: str, seed: int = 42) -> DataFrame:
    """Rank (1-based) of each row inside its class in seeded-hash order, and class size."""
    h = df.withColumn("_h", seeded_hash(row_id, seed)).withColumn("_one", F.lit(1))
    sizes = df.groupBy(y).agg(F.count(F.lit(1)).alias("class_n"))
    cum = cumulative(h, ["_h"], ["_one"], [y], bucketed=hash_buckets(h, "_h"))
    return join_keys(cum, sizes, [y]).withColumnRenamed("cum__one", "class_rank").drop("_h", "_one")


def split_label(fractions: Sequence[float] = (0.6, 0.2, 0.2),
                names: Sequence[str] = ("train", "test", "eval")) -> Column:
    """Split of a row from its ``class_rank`` and ``class_n``. Fractions are taken in hundredths
    so both engines compare integers."""
    pos = (F.col("class_rank") - 1) * 100
    expr, acc = None, 0
    for f, name in zip(fractions[:-1], names):
        acc += int(round(f * 100))
        cond = pos < F.col("class_n") * acc
        expr = F.when(cond, name) if expr is None else expr.when(cond, name)
    return expr.otherwise(names[-1])


def fold_label(k: int = 7) -> Column:
    """Fold of a row: (class rank - 1) mod k."""
    return ((F.col("class_rank") - 1) % k).cast("int")


def stratified_split(df: DataFrame, row_id: str, y: str, fractions: Sequence[float] = (0.6, 0.2, 0.2),
                     names: Sequence[str] = ("train", "test", "eval"), seed: int = 42) -> DataFrame:
    """M3: ``df`` with ``split``; in each class (rows without a label are one) the first 60 % of the
    seeded order is ``train``, the next 20 % ``test``, the rest ``eval`` (exact per class, repeatable)."""
    return class_ranks(df, row_id, y, seed).withColumn("split", split_label(fractions, names))


def cut_split(df: DataFrame, row_id: str | Column, y: str, place: Sequence[str], fractions: Sequence[float] = (0.6, 0.2, 0.2),
              names: Sequence[str] = ("train", "test", "eval"), seed: int = 42) -> DataFrame:
    """M3 without moving rows: the ``split`` of ``stratified_split`` from the last row of each class and split, which is found
    among the rows of its hash bucket alone. ``place`` names columns that tell rows of equal ids apart. For a label: its
    classes are few, and their cuts are literals of the plan."""
    h = hash_buckets(df.withColumn("_h", seeded_hash(row_id, seed)), "_h")
    shares = [sum(int(round(f * 100)) for f in fractions[:i + 1]) for i in range(len(fractions) - 1)]
    upto = W.partitionBy(y).orderBy("_bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    totals = h.groupBy(y, "_bucket").agg(F.count(F.lit(1)).alias("_cnt")).select(
        y, "_bucket", "_cnt", F.sum("_cnt").over(upto).alias("_upto"), F.sum("_cnt").over(W.partitionBy(y)).alias("_n"))
    last = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.expr(f"(_n * {s} + 99) div 100").alias("rank")) for i, s in enumerate(shares)]))
    wanted = totals.withColumn("_last", last).where("_last.rank > _upto - _cnt AND _last.rank <= _upto") \
        .select(F.col(y).alias("_y"), "_bucket", "_last.i", F.expr("_last.rank - _upto + _cnt").alias("rank")).collect()
    here = {(r._y, r._bucket): None for r in wanted}  # one for each class and split at most
    inside = F.lit(False)
    for c, b in here:
        inside = inside | (F.col(y).eqNullSafe(F.lit(c)) & (F.col("_bucket") == b))
    order = W.partitionBy(y, "_bucket").orderBy("_h", *place)
    ranked = h.where(inside).select(F.col(y).alias("_y"), "_bucket", "_h", *place, F.row_number().over(order).alias("_rank"))
    ends = {(r._y, r._bucket, r._rank): r for r in ranked.where(F.col("_rank").isin([r["rank"] for r in wanted])).collect()} if wanted else {}
    split = F.lit(names[-1])
    for r in sorted(wanted, key=lambda r: -r.i):
        end = ends[r._y, r._bucket, r["rank"]]
        tied = F.struct(*place) <= F.struct(*[F.lit(end[p]).alias(p) for p in place])
        before = (F.col("_h") < end._h) | ((F.col("_h") == end._h) & tied)
        split = F.when(F.col(y).eqNullSafe(F.lit(r._y)) & before, names[r.i]).otherwise(split)
    return h.withColumn("split", split).drop("_h", "_bucket", *place)


def stratified_folds(df: DataFrame, row_id: str, y: str, k: int = 7, seed: int = 42) -> DataFrame:
    """M4: ``df`` with ``fold`` = (class rank - 1) mod k in seeded order: class shares equal within 1."""
    return class_ranks(df, row_id, y, seed).withColumn("fold", fold_label(k))
