"""Bitmap facet index (P3, P12, A7 without a rescan).

Rows are numbered once. Each facet value, and each quantile bin of a range column, has a bitmap of its rows for every bucket of
32,768 row numbers. A selection is then the AND over facets of the OR over chosen values: a change of facets reads
bitmaps, never the wide table. Of a range column, bins wholly inside the range are taken as bitmaps; only the values in the bins
on its two borders are looked at singly, in a table that is sorted by value.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelens.sources.tables import temporary

BINS = 64
BUCKET_ROWS = 32768      # of Spark's bitmap functions
SORTED_ROWS = 1_000_000  # single values that one task sorts


def _partial_bitmaps(facets: Sequence[str], edges: Mapping[str, Sequence[float]]):
    """Arrow task of ``build``: the bitmaps ``(facet, value, bucket, bits)`` of the rows of each bucket as they come, a row's place in
    them from its ``_bucket`` and ``_position``. Neither sorts nor holds rows of more than one bucket; a bucket that comes back
    later, or in another task, has one more partial bitmap."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def coded(name: str, column: pa.Array) -> tuple[list[str | None], np.ndarray]:
        """Values and each row's index in them; of a range column, values are bins: the number of edges at or below."""
        if name in edges:
            bins = np.searchsorted(np.array(edges[name], float), column.fill_null(0.0).to_numpy(zero_copy_only=False), side="right")
            column = pa.array(bins.astype(str), pa.string(), mask=column.is_null().to_numpy(zero_copy_only=False))
        found = pc.dictionary_encode(column, null_encoding="encode")
        return found.dictionary.to_pylist(), found.indices.to_numpy(zero_copy_only=False)

    def flushed(bucket: int, bits: dict[tuple[str, str | None], np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([f for f, _ in bits], pa.string()), pa.array([v for _, v in bits], pa.string()),
             pa.array([bucket] * len(bits), pa.int64()),
             pa.array([np.packbits(b, bitorder="little").tobytes() for b in bits.values()], pa.binary())],
            names=["facet", "value", "bucket", "bits"])

    def run(batches):
        now, bits = None, {}
        for batch in batches:
            buckets = batch.column("_bucket").to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.diff(buckets, prepend=buckets[:1] - 1)) if len(buckets) else []
            for start, end in zip(starts, [*starts[1:], len(buckets)]):
                if buckets[start] != now:
                    if bits:
                        yield flushed(now, bits)
                    now, bits = int(buckets[start]), {}
                own = batch.slice(start, end - start)
                position = own.column("_position").to_numpy(zero_copy_only=False)
                for name in [*facets, *edges]:
                    values, codes = coded(name, own.column(name))
                    for i, value in enumerate(values):
                        bits.setdefault((name, value), np.zeros(BUCKET_ROWS, bool))[position[codes == i]] = True
        if bits:
            yield flushed(now, bits)

    return run


def _bits(position: str = "position") -> Column:
    return F.bitmap_construct_agg(F.col(position)).alias("bits")


@dataclass(frozen=True)
class FacetIndex:
    """``bitmaps(facet, value, bucket, bits)`` (value null: rows without one) and ``values(facet, bin, value, bucket, position)``."""
    bitmaps: DataFrame
    values: DataFrame
    facets: tuple[str, ...]
    edges: dict[str, list[float]]

    @staticmethod
    def build(df: DataFrame, facets: Sequence[str], ranges: Sequence[str] = (), bins: int = BINS,
              keep: Callable[[DataFrame, str], DataFrame] = temporary) -> FacetIndex:
        """Index of string or integer columns ``facets`` (names of other columns than ``ranges``) and numeric columns ``ranges``
        (NaN as null). ``keep`` writes a frame under a name and reads it back."""
        numbered = keep(df.select(
            *[F.col(c).cast("string").alias(c) for c in facets],
            *[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in ranges])
            .withColumn("_row", F.monotonically_increasing_id()), "facet-rows")
        place = [F.bitmap_bucket_number("_row").alias("bucket"), F.bitmap_bit_position("_row").alias("position")]
        cuts = numbered.approxQuantile(list(ranges), [i / bins for i in range(1, bins)], 0.1 / bins) if ranges else []
        edges = {c: sorted(set(e)) for c, e in zip(ranges, cuts)}
        partial = numbered.select(place[0].alias("_bucket"), place[1].alias("_position"), *facets, *ranges).mapInArrow(
            _partial_bitmaps(tuple(facets), edges), "facet string, value string, bucket bigint, bits binary")
        bitmaps = partial.groupBy("facet", "value", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        single = numbered.select(*place, *ranges).unpivot(["bucket", "position"], list(ranges), "facet", "value") if ranges \
            else numbered.select(*place, F.lit("").alias("facet"), F.lit(0.0).alias("value")).limit(0)
        # the sort of a task stays as small whatever the rows; bucket too: rows of one common value are not one task
        parts = max(1, math.ceil(numbered.count() * len(ranges) / SORTED_ROWS))
        single = single.where(F.col("value").isNotNull()).repartitionByRange(parts, "facet", "value", "bucket") \
            .sortWithinPartitions("facet", "value", "bucket")
        return FacetIndex(keep(bitmaps, "facet-bitmaps"), keep(single, "facet-values"), tuple(facets), edges)

    def _of_range(self, c: str, lo: float, hi: float) -> tuple[list[str], Column]:
        """Bins of ``c`` wholly inside [lo, hi], and which single values of its other bins are inside."""
        cuts = [-math.inf, *self.edges[c], math.inf]
        whole = [b for b in range(len(cuts) - 1) if lo <= cuts[b] and cuts[b + 1] <= hi]
        inside = (F.col("facet") == c) & F.col("value").between(float(lo), float(hi))
        if whole:  # bin b holds [cuts[b], cuts[b + 1])
            inside &= (F.col("value") < cuts[whole[0]]) | (F.col("value") >= cuts[whole[-1] + 1])
        return [str(b) for b in whole], inside

    def selection(self, isin: Mapping[str, Sequence] | None = None, ranges: Mapping[str, tuple] | None = None) -> DataFrame:
        """(bucket, bits) of the rows that ``facets.facet_predicate`` keeps; buckets without any may be missing."""
        isin, ranges = dict(isin or {}), dict(ranges or {})
        if not isin and not ranges:  # every row has one value (or null) of any facet
            one = next(iter([*self.facets, *self.edges]))
            return self.bitmaps.where(F.col("facet") == one).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        chosen, single = F.lit(False), F.lit(False)
        for c, values in isin.items():
            if len(values):
                chosen |= (F.col("facet") == c) & F.col("value").isin([str(v) for v in values])
        for c, (lo, hi) in ranges.items():
            whole, inside = self._of_range(c, lo, hi)
            single |= inside
            if whole:
                chosen |= (F.col("facet") == c) & F.col("value").isin(whole)
        parts = self.bitmaps.where(chosen).select("facet", "bucket", "bits").unionByName(
            self.values.where(single).groupBy("facet", "bucket").agg(_bits()))
        by_facet = parts.groupBy("bucket", "facet").agg(F.bitmap_or_agg("bits").alias("bits"))
        return (by_facet.groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("n"))
                .where(F.col("n") == len(isin) + len(ranges)).select("bucket", "bits"))

    def share(self, isin=None, ranges=None) -> DataFrame:
        """A7 from bitmaps: (filtered, total, share_pct)."""
        rows = self.selection(isin, ranges).select(F.bitmap_count("bits").alias("kept"), F.lit(0).cast("long").alias("all"))
        rows = rows.unionByName(self.selection().select(F.lit(0).cast("long").alias("kept"), F.bitmap_count("bits").alias("all")))
        kept, n = F.coalesce(F.sum("kept"), F.lit(0)), F.coalesce(F.sum("all"), F.lit(0))
        return rows.agg(kept.alias("filtered"), n.alias("total"), F.round(F.try_divide(kept * 100.0, n), 6).alias("share_pct"))

    def rates(self, outcome: str, positive, isin=None, ranges=None) -> DataFrame:
        """(facet, value, total, positives, rate) of every facet value among the selected rows, from bitmaps alone: the domains
        and outcome rates that all facets show after a change of the selection. ``outcome`` is an indexed facet."""
        chosen = self.selection(isin, ranges)
        yes = self.bitmaps.where((F.col("facet") == outcome) & (F.col("value") == str(positive))).select(
            "bucket", F.col("bits").alias("yes"))
        rows = self.bitmaps.where(F.col("facet").isin([f for f in self.facets if f != outcome]) & F.col("value").isNotNull())
        rows = rows.join(chosen.withColumnRenamed("bits", "chosen"), "bucket").join(yes, "bucket", "left")
        # an AND of two bitmaps is an aggregate of a pair of rows, which their own task puts together
        pairs = rows.select("facet", "value", "bucket", F.explode(F.array(
            F.struct(F.col("bits").alias("a"), F.col("bits").alias("b")),
            F.struct(F.col("chosen").alias("a"), F.col("chosen").alias("b")),
            F.struct(F.col("bits").alias("a"), F.col("yes").alias("b")))).alias("p"))
        both = pairs.groupBy("facet", "value", "bucket").agg(
            F.bitmap_count(F.bitmap_and_agg("p.a")).alias("total"),
            F.when(F.count_if(F.col("p.b").isNull()) == 0, F.bitmap_count(F.bitmap_and_agg("p.b"))).otherwise(0).alias("positives"))
        out = both.groupBy("facet", "value").agg(F.sum("total").alias("total"), F.sum("positives").alias("positives"))
        return out.where(F.col("total") > 0).select("facet", "value", "total", "positives",
                                                    (F.col("positives") / F.col("total")).alias("rate"))
