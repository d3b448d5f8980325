import hashlib
import math
import random

from ratelens.llm import centroids as C


def expected(rows, dim, k, rounds=3, scale=64, seed=1):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    centre = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centre))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(centre)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                centre[j] = [sum(x) // len(mine) for x in zip(*mine)]
    best = [nearest(v) for _, v in kept]
    return sorted(((i, j, d, sum(e for e, m in best if m == j), sum(e for e, _ in best),
                    hashlib.sha256(",".join(map(str, centre[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, best)), key=str)


def found(spark, rows, schema="vec_id long, embedding array<double>", **options):
    return sorted((tuple(r) for r in C.centroid_clusters(spark.createDataFrame(rows, schema), **options).collect()), key=str)


def test_clusters_with_ties_repeats_and_negative_sums(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(3 * (i % 4), 1) - 4 for _ in range(6)]) for i in range(300)]
    rows += [(7, [0.0] * 6)] * 3 + [(400 + i, rows[0][1]) for i in range(200)] + [(None, [1.0] * 6)]
    assert found(spark, rows, dim=6, k=9) == expected(rows, 6, 9)


def test_odd_vectors_fewer_than_centroids_and_none(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, nan]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0, 2.0, 3.0]), (7, [-inf, 0.0]),
            (8, [0.5, -0.001]), (9, [0.5, -0.001]), (10, [1.0, 1.0])]
    assert found(spark, rows, dim=2) == expected(rows, 2, 16) != []
    assert found(spark, rows[:7], dim=2) == [] == found(spark, [], dim=2)


def test_huge_components_are_held_at_the_limit(spark):
    rows = [(1, [1e300, -1e300]), (2, [2.0 ** 20, -2.0 ** 20]), (3, [0.0, 0.0])]
    got = {r[0]: r[1:3] for r in found(spark, rows, dim=2, k=2)}
    assert got[1] == got[2]


def test_extra_columns_of_clashing_names(spark):
    rows = [(i, [float(i % 5), 1.0], 1, 2, 3) for i in range(50)]
    got = found(spark, rows, "vec_id long, embedding array<double>, v int, cluster int, c0 int", dim=2, k=3)
    assert got == expected([r[:2] for r in rows], 2, 3)
