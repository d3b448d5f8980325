"""Operator 6: near-duplicate vectors by spherical-cap filters.

Filter directions are the words of random product codes: a randomly rotated vector is cut in blocks, each block has its own
random unit vectors, and a direction joins one of each. A vector passes the filters whose direction it exceeds the cap's
height with; list decoding finds them block by block, dropping beginnings that can't reach the height any more.
Vectors meet in the filters they share and are compared there in double precision. The number of vectors sets the height, so
that a filter holds about as many at every scale; codes are added until random pairs at the threshold share a
filter as often as RECALL. Filters that hold more than BLOCK vectors are dealt out as pairs of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelens.llm.common import components, small, written

RECALL = 0.9995
#: Filters of one code that a vector passes, and vectors in a filter, on average; vectors in one block at most.
PASSED, HELD, BLOCK = 6, 64, 1024
#: Random pairs that measure the recall, and the most codes.
TRIALS, MOST_CODES = 4000, 64
_CODE_BITS = 50


def cap_height(dim: int, share: float) -> float:
    """Height that a random unit vector's first component exceeds with probability ``share``."""
    if dim < 2:
        return 0.0
    if dim == 2:
        return math.cos(math.pi * share)
    x = np.linspace(0, 1, 200_001)
    tail = np.cumsum(((1 - x * x) ** ((dim - 3) / 2))[::-1])[::-1]
    return float(x[np.searchsorted(-tail, -2 * share * tail[0])])


@dataclass(frozen=True)
class Code:
    rotation: np.ndarray
    blocks: tuple[np.ndarray, ...]  # for each block of dimensions: its unit vectors in rows
    height: float

    @staticmethod
    def of(dim: int, share: float, seed: int) -> Code:
        rng = np.random.default_rng([seed, dim])
        words = max(2.0, PASSED / share)
        count = 1 if dim < 8 else 2 if words < 1 << 20 else 3 if words < 1 << 29 else 4
        cuts = np.linspace(0, dim, count + 1).astype(int)
        parts = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            c = rng.standard_normal((max(2, math.ceil(words ** (1 / count))), b - a))
            parts.append(c / np.linalg.norm(c, axis=1, keepdims=True) / math.sqrt(count))
        return Code(np.linalg.qr(rng.standard_normal((dim, dim)))[0], tuple(parts), cap_height(dim, share))

    def decode(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and number of every filter that unit vectors ``v`` pass, by row and number."""
        v = v @ self.rotation
        at = np.cumsum([0] + [c.shape[1] for c in self.blocks])
        products = [v[:, a:b] @ c.T for c, a, b in zip(self.blocks, at[:-1], at[1:])]
        best = [p.max(1) for p in products]
        row, word, total = np.arange(len(v)), np.zeros(len(v), np.int64), np.zeros(len(v))
        for k, p in enumerate(products):
            reach = sum(best[k + 1:], np.zeros(len(v)))
            sums = total[:, None] + p[row]
            i, j = np.nonzero(sums + reach[row][:, None] >= self.height)
            row, word, total = row[i], word[i] * p.shape[1] + j, sums[i, j]
        return row, word


@dataclass(frozen=True)
class Filters:
    codes: tuple[Code, ...]
    recall: float

    @staticmethod
    def of(dim: int, vectors: int, threshold: float) -> Filters:
        """Codes for ``vectors`` unit vectors, as many as random pairs at the threshold need. Caps are low enough that such a pair
        can lie in one (in few dimensions filters then hold more than HELD vectors, as there are more links, too), and are lowered
        further while MOST_CODES don't reach RECALL."""
        share, widest = min(0.2, HELD / max(vectors, 1)), math.sqrt((1 + threshold) / 2)
        while cap_height(dim, share) > 0.99 * widest and share < 0.5:
            share = min(0.5, 1.5 * share)
        rng = np.random.default_rng([3, dim])
        v, z = rng.standard_normal((2, TRIALS, dim))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        z -= (z * v).sum(1, keepdims=True) * v
        z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300)
        w = threshold * v + math.sqrt(max(0.0, 1 - threshold ** 2)) * z
        while True:
            codes, found = [], np.zeros(TRIALS, bool)
            while found.mean() < RECALL and len(codes) < MOST_CODES:
                codes.append(Code.of(dim, share, len(codes)))
                for i in range(0, TRIALS, 200):
                    row, word = codes[-1].decode(np.concatenate([v[i:i + 200], w[i:i + 200]]))
                    first = row < 200
                    shared = np.intersect1d(row[first] << _CODE_BITS | word[first], row[~first] - 200 << _CODE_BITS | word[~first])
                    found[i + np.unique(shared >> _CODE_BITS)] = True
            if found.mean() >= RECALL:
                return Filters(tuple(codes), float(found.mean()))
            if share >= 0.5:
                raise ValueError(f"{MOST_CODES} codes reach a recall of {found.mean():.4f} in {dim} dimensions")
            share = min(0.5, 2 * share)

    def decode(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        got = [(row, word | k << _CODE_BITS) for k, c in enumerate(self.codes) for row, word in [c.decode(v)]]
        row, number = np.concatenate([x for x, _ in got]), np.concatenate([x for _, x in got])
        order = np.argsort(row, kind="stable")
        return row[order], number[order]


def unit(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths as unit vectors in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    v = flat.reshape(len(column), -1)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _passed(code: Filters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                row, word = code.decode(unit(part.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(word), part.column(0).take(pa.array(row)),
                                                  part.column(1).take(pa.array(row))], ["filter", "rep", "v"])
    return run


def _compared(code: Filters, threshold: float):
    """Links in a filter's block or pair of blocks, each given by the first filter that both vectors pass."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        number, x, y = (k.as_py() for k in key)
        rep, block = table["rep"].to_numpy(), table["block"].to_numpy()
        v = unit(table["v"].combine_chunks())
        left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
        i, j = np.nonzero(v[left] @ v[right].T >= threshold)
        i, j = left[i], right[j]
        keep = (rep[i] < rep[j]) if x == y else rep[i] != rep[j]
        i, j = i[keep], j[keep]
        if len(i):
            used, place = np.unique(np.concatenate([i, j]), return_inverse=True)
            row, word = code.decode(v[used])
            lists = np.split(word, np.searchsorted(row, np.arange(1, len(used))))
            earlier = [set(w[w < number].tolist()) for w in lists]
            first = np.array([earlier[a].isdisjoint(earlier[b]) for a, b in zip(place[:len(i)], place[len(i):])], bool)
            i, j = i[first], j[first]
        return pa.table({"a": np.minimum(rep[i], rep[j]), "b": np.maximum(rep[i], rep[j])})
    return run


def cosine_links(vectors: DataFrame, threshold: float) -> DataFrame:
    """Links ``(a, b)``, a < b, of ``vectors(rep, v, dim)``: unique numbers of different valid vectors."""
    found = None
    for dim in sorted(r["dim"] for r in vectors.select("dim").distinct().collect()):  # lengths, few in any table of embeddings
        same = vectors.where(F.col("dim") == dim).select("rep", "v")
        code = Filters.of(dim, same.count(), threshold)
        passed = written(same.mapInArrow(_passed(code), "filter long, rep long, v " + dict(same.dtypes)["v"]), "passed")
        crowded = passed.groupBy("filter").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
        crowded = written(crowded.select("filter", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "crowded")
        dealt = passed.join(small(crowded, 16), "filter", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select("filter", "rep", "v", "block", F.least("block", "other").alias("x"),
                             F.greatest("block", "other").alias("y"))
        links = dealt.groupBy("filter", "x", "y").applyInArrow(_compared(code, threshold), "a long, b long")
        found = links if found is None else found.union(links)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "a long, b long")
    return written(found, "cosine-links")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    threshold: float = 0.9) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for each row: other rows linked with it (cosine >= ``threshold``), the
    smallest id reachable by links, itself included, and whether that is its own.

    Null, empty and zero vectors and those with a null or non-finite component link with nothing; so do rows with a null
    id, whose component is null and which are not kept. Vectors of different lengths don't link. Equal vectors link without
    being compared and are one vector in the comparison. Rows that repeat an id are one node and count as links of each
    other where their vectors are linked. Other columns are ignored. No rows, no rows."""
    fine = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists(vector_col, lambda x: x != 0)
    d = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"),
                       F.coalesce(fine & some, F.lit(False)).alias("valid"))
    d = d.withColumn("valid", F.col("valid") & F.col("id").isNotNull())
    d = d.select("id", "valid", "v", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("g"))
    good = d.where("valid")
    classes = written(good.groupBy("h", "g").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
                          .withColumn("rep", F.monotonically_increasing_id()), "vector-classes")
    placed = written(good.join(classes.select("h", "g", "rep"), ["h", "g"]).select("id", "rep").distinct(), "vector-rows")
    several = placed.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z").select("id", "a")
    ties = placed.join(several, "id").where("a <> rep").select("a", F.col("rep").alias("b"))
    one = good.groupBy("h", "g").agg(F.first("v").alias("v")).join(classes, ["h", "g"])
    links = cosine_links(written(one.select("rep", "v", F.size("v").alias("dim")), "vectors"), threshold)
    both = links.union(links.select("b", "a"))
    others = (both.join(classes.select(F.col("rep").alias("b"), "copies"), "b")
                  .groupBy(F.col("a").alias("rep")).agg(F.sum("copies").alias("others")))
    roots = components(links.union(ties)).select(F.col("node").alias("rep"), "root")
    known = classes.join(others, "rep", "left").join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = known.join(least, "root").select(
        "h", "g", "component_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    linked = good.select("id", "h", "g").join(known, ["h", "g"]).select("id", "n_links", "component_id")
    alone = d.where("not valid").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias("vec_id"), "n_links", "component_id",
                                      F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id
  WHERE list_cosine_similarity(x.e, y.e) >= 0.9),
reach AS (SELECT vec_id AS node, vec_id AS root FROM v UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.node)
SELECT v.vec_id, CAST((SELECT count(*) FROM links WHERE links.a = v.vec_id) AS BIGINT) AS n_links, r.component_id,
       r.component_id = v.vec_id AS kept
FROM v JOIN (SELECT node, min(root) AS component_id FROM reach GROUP BY node) r ON r.node = v.vec_id
"""
