"""Operator 5: mix sources to target weights by systematic sampling (DataFrame functions only).

Within a source the documents are put in an order, each expects target / source size copies, the prefix sums of
these are shifted by one random offset, and a document is taken once for each integer its interval crosses. The
order runs by size class first, so the words taken follow the target closely, then by a hash of the id. A document's place
in that order is its rank in a (source, size class, hash bucket) plus the counts of the buckets before: no window holds more
than a bucket, however large a source is.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratelens.llm.common import small, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST = 2


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def size_class(size: Column) -> Column:
    """Sizes to three leading bits after the first: classes at most an eighth wide, in order."""
    bits = F.length(F.bin(size))
    low = F.greatest(bits - 4, F.lit(0))
    return bits * 8 + F.call_function("shiftright", size, low).cast("int").bitwiseAND(F.lit(7))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """``(source, source_size, target)`` from one row ``(source, source_size)`` for each source.

    The k-th source in code point order (null last) weighs ``weights[k % len(weights)]``. All share
    ``budget`` times all sizes by weight; none gets more than ``most`` times its size, and the excess goes to the others
    by weight, until none is above: a common level times the weight, cut at the cap. The windows run over
    one row a source."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    place = (F.row_number().over(order) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), place + 1).cast("long")
    s = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * most)
    by_need = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    s = (s.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0)))
          .withColumn("lighter", F.coalesce(F.sum("weight").over(before), F.lit(0)))
          .withColumn("total", F.sum("source_size").over(whole)).withColumn("all_weight", F.sum("weight").over(whole)))
    level = (F.lit(float(budget)) * F.col("total") - F.col("capped")) / (F.col("all_weight") - F.col("lighter"))
    s = s.withColumn("level", level)
    # the first source in order of need whose cap is not under the level sets it
    s = s.withColumn("found", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"),
                                           F.struct("capped", "level"))).over(whole))
    target = F.when(F.col("found").isNull(), F.col("cap").cast("double")).otherwise(
        F.least(F.col("cap").cast("double"), F.col("found.level") * F.col("weight")))
    return s.select("source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, most: int = MOST, seed: int = 7) -> DataFrame:
    """``docs`` with ``size`` (words of the text), ``source_size``, ``target`` (of the row's source) and ``copies``:
    how often the mix takes the row (0 to ``most``).

    Null or wordless text has size 0 and may be taken at no cost; a source without words has target 0 and is not taken.
    Null sources are one source, last in order. Rows that repeat an id are documents of their own; equal ones are
    interchangeable. The same rows and seed give the same mix, however they are partitioned. Other columns pass through;
    those of the four new names are replaced. No rows, no rows."""
    names = ("size", "source_size", "target", "copies")
    own = [c for c in docs.columns if c not in names]
    text, source = docs[text_col], docs[source_col]
    d = docs.select(*[docs[c] for c in own], source.alias("_mix_source"), word_count(text).alias("size"),
                    F.md5(F.coalesce(docs[id_col].cast("string"), F.lit(""))).alias("_mix_h"))
    d = d.withColumns({"_mix_key": _key("_mix_source"), "_mix_class": size_class(F.col("size")),
                       "_mix_bucket": F.substring("_mix_h", 1, 3)})
    place = ["_mix_key", "_mix_class", "_mix_bucket"]
    counts = written(d.groupBy("_mix_source", *place).agg(
        F.count(F.lit(1)).alias("_mix_n"), F.sum("size").alias("_mix_words")), "mix-buckets")
    targets = written(source_targets(counts.groupBy(F.col("_mix_source").alias("source")).agg(
        F.sum("_mix_words").alias("source_size")), weights, budget, most), "mix-targets")
    targets = targets.select(_key("source").alias("_mix_key"), "source_size", "target")
    run = Window.partitionBy("_mix_key").orderBy("_mix_class", "_mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*place, F.coalesce(F.sum("_mix_n").over(run), F.lit(0)).alias("_mix_before"))
    offsets = written(offsets.join(small(targets, 64), "_mix_key"), "mix-offsets")
    u = random.Random(seed).random()
    in_bucket = Window.partitionBy(*place).orderBy("_mix_h", "size")
    placed = d.join(small(offsets, 64), place).withColumn(
        "_mix_place", F.row_number().over(in_bucket) + F.col("_mix_before"))
    rate = F.col("target") / F.nullif(F.col("source_size"), F.lit(0))
    crossed = lambda n: F.floor(n * rate + F.lit(u))
    copies = F.coalesce(crossed(F.col("_mix_place")) - crossed(F.col("_mix_place") - 1), F.lit(0)).cast("int")
    return placed.select(*own, "size", "source_size", "target", F.least(copies, F.lit(most)).alias("copies"))


def _key(column: str) -> Column:
    """Sources as keys that are never null."""
    return F.coalesce(F.concat(F.lit("s"), F.col(column)), F.lit(""))


ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
c AS (SELECT *, length(bin(size)) AS bits FROM d),
k AS (SELECT *, bits * 8 + ((size >> greatest(bits - 4, 0)) & 7) AS class FROM c),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3, 1, 2][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS weight
  FROM k GROUP BY source),
n AS (
  SELECT *, 2 * source_size AS cap,
         coalesce(sum(2 * source_size) OVER need, 0) AS capped, coalesce(sum(weight) OVER need, 0) AS lighter,
         sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight
  FROM s
  WINDOW need AS (ORDER BY (2 * source_size) / CAST(weight AS DOUBLE), source IS NULL, source
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT *, (CAST(1.5 AS DOUBLE) * CAST(total AS DOUBLE) - CAST(capped AS DOUBLE))
                 / CAST(all_weight - lighter AS DOUBLE) AS level FROM n),
f AS (SELECT arg_min(level, capped) AS level FROM lv WHERE level * weight <= cap),
t AS (SELECT source, source_size,
             coalesce(least(CAST(cap AS DOUBLE), (SELECT level FROM f) * weight), CAST(cap AS DOUBLE)) AS target
      FROM lv),
p AS (
  SELECT doc_id, size, source_size, target,
         row_number() OVER (PARTITION BY k.source ORDER BY class, h, size) AS place
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * least(2, coalesce(floor(place * (target / nullif(source_size, 0)) + {random.Random(7).random()!r})
                - floor((place - 1) * (target / nullif(source_size, 0)) + {random.Random(7).random()!r}), 0)) AS BIGINT)
       AS taken
FROM p
"""
