import numpy as np
import pytest

import brute
from ratelens.llm import embedding_dedup as E


def expected(rows, threshold=0.9):
    good = [(k, i, np.array(v, float) / np.linalg.norm(np.array(v, float) / np.abs(v).max()) / np.abs(v).max())
            for k, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and np.isfinite(x) for x in v)
            and any(x != 0 for x in v)]
    n, links = [0] * len(rows), []
    for x, (k, i, v) in enumerate(good):
        for m, j, w in good[:x]:
            if len(v) == len(w) and v @ w >= threshold - 1e-12:
                n[k] += 1
                n[m] += 1
                links.append((i, j))
    root = brute.roots({i for i, _ in rows if i is not None}, links)
    return sorted(((i, n[k], root.get(i), i is not None and root[i] == i) for k, (i, _) in enumerate(rows)), key=str)


def found(spark, rows):
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in E.near_duplicates(d).collect()), key=str)


def near(rng, v, cosine):
    z = rng.standard_normal(len(v))
    z -= (z @ v) * v / (v @ v)
    return cosine * v / np.linalg.norm(v) + np.sqrt(1 - cosine ** 2) * z / np.linalg.norm(z)


def test_copies_near_copies_and_a_crowded_filter(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 40)
    rng = np.random.default_rng(1)
    v = list(rng.standard_normal((500, 64)))
    v += [near(rng, v[0], 0.97) for _ in range(120)] + [v[1]] * 60 + [near(rng, x, 0.95) for x in v[2:100]]
    v += [near(rng, x, 0.85) for x in v[100:200]]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    got, want = found(spark, rows), expected(rows)
    assert sum(a != b for a, b in zip(got, want)) <= 4  # a pair at 0.95 may share no filter, rarely
    assert sum(r[1] for r in got) >= 0.999 * sum(r[1] for r in want)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 0.0]),
            (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1e300, 1e200]), (10, [1e-300, 0.0]), (11, [1.0, 0.0, 0.0]), (12, [0.0, 1.0]),
            (13, [5.0]), (14, [-5.0]), (12, [0.0, 1.0])]
    assert found(spark, rows) == expected(rows)
    assert found(spark, []) == []


def test_an_id_with_two_vectors_ties_their_components(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (2, [0.0, 1.0]), (3, [0.01, 1.0]), (4, [-1.0, 0.0])]
    assert {(r[0], r[2]) for r in found(spark, rows)} == {(1, 1), (2, 1), (3, 1), (4, 4)}


@pytest.mark.parametrize("dim, vectors", [(64, 500), (64, 60_000), (64, 2_000_000), (16, 5000), (384, 100_000)])
def test_recall_of_random_pairs_at_the_threshold(dim, vectors):
    filters = E.Filters.of(dim, vectors, 0.9)
    rng = np.random.default_rng(9)
    v = rng.standard_normal((1000, dim))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    w = np.array([near(rng, x, 0.9) for x in v])
    lists = [np.split(number, np.searchsorted(row, np.arange(1, 1000))) for row, number in (filters.decode(v), filters.decode(w))]
    assert np.mean([not set(a.tolist()).isdisjoint(b.tolist()) for a, b in zip(*lists)]) > 0.98


@pytest.mark.parametrize("dim, vectors", [(1, 1000), (2, 10_000), (3, 1000), (4, 100_000), (8, 10_000_000)])
def test_recall_is_reached_in_few_dimensions(dim, vectors):
    assert E.Filters.of(dim, vectors, 0.9).recall >= E.RECALL


@pytest.mark.parametrize("dim", [2, 4])
def test_few_dimensions_against_brute_force(spark, dim):
    rng = np.random.default_rng(dim)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.standard_normal((400, dim)))]
    got, want = found(spark, rows), expected(rows)
    assert sum(r[1] for r in got) >= 0.999 * sum(r[1] for r in want) and [r[2] for r in got] == [r[2] for r in want]


def test_table(spark):
    d = spark.read.parquet(f"{brute.SF_SMALL}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in d.collect()]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in E.near_duplicates(d).collect()), key=str)
    assert got == expected(rows)
