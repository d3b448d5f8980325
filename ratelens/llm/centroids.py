"""Operator 12: integer k-means in JVM expressions.

Vectors are arrays of scaled integers. ``zip_with`` and ``aggregate`` give the squared distance to each centroid, which stands in the plan
as a literal array; ``array_min`` over structs of distance and number chooses the cluster, ties to the smaller number. New
centroids are column sums of a hash aggregate, combined before the shuffle: the driver receives k rows a round, so a cluster that
holds a third of all vectors costs as much as any other.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelens.llm.common import drop_written, written

#: Scaled components are held within +-2^26, so that neither distances nor sums over 2^36 vectors exceed 64 bits.
COMPONENT_LIMIT = 1 << 26


def scaled_vectors(vectors: DataFrame, dim: int, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """``(vec_id, v)``: the vectors of exactly ``dim`` components that are neither null nor NaN nor infinite, as floor(scale x)."""
    x = F.col(vec_col).cast("array<double>")
    fit = vectors.where((F.size(x) == dim) & F.forall(x, lambda y: y.isNotNull() & (F.abs(y) < float("inf")) & ~F.isnan(y)))
    edge = float(COMPONENT_LIMIT)
    whole = F.transform(x, lambda y: F.floor(F.greatest(F.least(y * float(scale), F.lit(edge)), F.lit(-edge))).cast("int"))
    return fit.select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))


def first_centroids(kept: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors of least seeded sha256 of the id, in ascending order: k rows come to the driver."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [r.v for r in kept.select(order.alias("h"), "v").orderBy("h", "v").limit(k).collect()]


def nearest(v: str, centroids: list[list[int]]) -> Column:
    """``struct(distance, cluster)`` of the nearest centroid."""
    def to(number: int, centre: list[int]) -> Column:
        literal = F.expr(f"array({','.join(f'{c}L' for c in centre)})")
        squares = F.zip_with(F.col(v), literal, lambda a, b: (a - b) * (a - b))
        distance = F.aggregate(squares, F.lit(0).cast("long"), lambda total, square: total + square)
        return F.struct(distance.alias("distance"), F.lit(number).alias("cluster"))

    return F.array_min(F.array(*[to(i, c) for i, c in enumerate(centroids)]))


def _moved(kept: DataFrame, centroids: list[list[int]], dim: int) -> list[list[int]]:
    """The centroids after one round: exact floors of the means; an empty cluster's centroid stays."""
    assigned = kept.select(nearest("v", centroids).getField("cluster").alias("cluster"), *[F.col("v")[i].alias(f"c{i}") for i in range(dim)])
    sums = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"c{i}").alias(f"c{i}") for i in range(dim)])
    out = list(centroids)
    for r in sums.collect():  # at most k rows
        out[r.cluster] = [r[f"c{i}"] // r.n for i in range(dim)]
    return out


def centroid_clusters(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = 64, scale: int = 64,
                      k: int = 16, rounds: int = 3, seed: int = 1) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` for every vector kept: its cluster after
    ``rounds`` rounds, the squared distance to that centroid, their sums, and the sha256 of the centroid's components.

    Not kept, so without a row: null vectors, other numbers of components, null or non-finite components. Fewer kept vectors than ``k``
    give as many centroids; none, no rows. Equal first centroids are allowed: the later ones stay empty. Rows that repeat an id are
    vectors of their own (among first centroids in order of their components); a null id is hashed as empty text. Components
    beyond +-2^26 after scaling count as that. Other columns are ignored."""
    kept = written(scaled_vectors(vectors, dim, scale, id_col, vec_col), "scaled")
    centroids = first_centroids(kept, k, seed)
    if not centroids:
        return kept.selectExpr("vec_id", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256")
    for _ in range(rounds):
        centroids = _moved(kept, centroids, dim)
    best = kept.select("vec_id", nearest("v", centroids).alias("best")).select("vec_id", "best.cluster", "best.distance")
    best = written(best, "clusters")
    drop_written(kept)
    inertia = {r.cluster: r.d for r in best.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # at most k rows
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    each = F.array(*[F.lit(inertia.get(i, 0)).cast("long") for i in range(len(centroids))])
    return best.select("vec_id", "cluster", "distance", each[F.col("cluster")].alias("cluster_inertia"),
                       F.lit(sum(inertia.values())).cast("long").alias("inertia"),
                       F.array(*[F.lit(n) for n in names])[F.col("cluster")].alias("centroid_sha256"))


def _oracle(dim: int = 64, scale: int = 64, k: int = 16, rounds: int = 3, seed: int = 1) -> str:
    steps = [f"""kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (
  SELECT row_number() OVER (ORDER BY h) - 1 AS cluster, v AS c
  FROM (SELECT v, sha256('{seed}:' || vec_id) AS h FROM kept ORDER BY h LIMIT {k}))"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS (
  SELECT vec_id, any_value(v) AS v, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d
  FROM (SELECT vec_id, v, cluster, list_sum(list_transform(range(1, {dim + 1}), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT AS d FROM kept, c{r})
  GROUP BY vec_id)""")
        if r < rounds:
            steps.append(f"""m{r} AS (
  SELECT cluster, i, CAST(floor((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) / count(*)) AS BIGINT) AS x
  FROM (SELECT cluster, unnest(range({dim})) AS i, unnest(v) AS x FROM a{r}) GROUP BY cluster, i),
c{r + 1} AS (
  SELECT cluster, coalesce(l, c) AS c FROM c{r} LEFT JOIN (SELECT cluster, list(x ORDER BY i) AS l FROM m{r} GROUP BY cluster) USING (cluster))""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)
"""


ORACLE_SQL = _oracle()
