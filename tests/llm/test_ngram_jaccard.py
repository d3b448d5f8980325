import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratelens.llm import common, ngram_jaccard as N, text
import brute

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{brute.SF_SMALL}/documents.parquet")


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in N.jaccard_components(df).collect()),
                  key=lambda x: (x[0] is None, str(x) if x[0] is None else "", x[0] or 0, x[1]))


def near_copies(rng, base, copies, edits):
    out = []
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_table_matches_brute_force(documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert got(documents) == brute.jaccard_components(rows)


def test_groups_of_near_copies_and_shared_passages(spark):
    rng = random.Random(1)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = near_copies(rng, new(150), 60, 8) + near_copies(rng, new(40), 20, 2) + near_copies(rng, new(9), 12, 1)
    passage = new(60)
    texts += [" ".join(new(rng.randint(5, 60)) + passage + new(rng.randint(5, 60))) for _ in range(60)]
    texts += [" ".join(new(rng.randint(1, 6))) for _ in range(10)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute.jaccard_components(rows)


def test_nulls_empty_short_repeated_and_long(spark):
    long = " ".join(f"x{i}" for i in range(30000))
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "A b"), (5, "a  B"), (6, "a b c d e f g"), (7, "A B C D E F G"),
            (8, "other words that stand alone here now"), (8, "a b c d e f g"), (9, long), (10, long + " tail")]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute.jaccard_components(rows)
    nulls = spark.createDataFrame([(None, "a b c d e f"), (None, None), (3, "a b c d e f")], SCHEMA)
    assert {str(x) for x in got(nulls)} == {"(None, 2, None)", "(None, 0, None)", "(3, 2, 3)"}


def test_empty_table_and_clashing_columns(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    rows = [(1, "a b c d e f"), (2, "A B C D E F")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("id", "n", "v", "w", "s", "rep", "sig")})
    assert got(df) == [(1, 2, 1), (2, 2, 1)]


@pytest.mark.parametrize("t", [0.6, 0.8, 0.9])
def test_similar_sets_share_a_signature(t):
    rng = np.random.default_rng(2)
    for n in [1, 2, 3, 4, 5, 8, 11, 12, 13, 30, 47, 48, 49, 191, 192, 193, 1000]:
        for _ in range(20):
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            d = int((1 - t) / (1 + t) * 2 * n + 1e-9)
            out, add = int(rng.integers(0, d + 1)), 0
            add = int(rng.integers(0, d - out + 1))
            b = np.concatenate([a[out:], rng.integers(0, 1 << 63, add, dtype=np.uint64)])
            a, b = np.unique(a), np.unique(b)
            inter = len(np.intersect1d(a, b))
            if not len(b) or inter < t * (len(a) + len(b) - inter):
                continue
            sigs = [set(N.signatures(s, np.zeros(len(s), np.int64), np.array([len(s)]), t)[0].tolist()) for s in (a, b)]
            assert sigs[0] & sigs[1], (n, len(a), len(b), inter)


def test_hashes_follow_the_words(spark):
    import pyarrow as pa
    texts = ["One two\tTHREE  four five six", None, "", "one TWO three four five six", "x"]
    sets = [set() for _ in texts]
    for i, j, s, r, n in text.text_sets(pa.array(texts)):
        for k in range(j - i):
            sets[i + k] = set(s[r == k].tolist())
            assert len(sets[i + k]) == n[k] == len(brute.shingles(texts[i + k]))
    assert sets[0] == sets[3] and not sets[1] and len(sets[4]) == 1


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(200, 200), (301, 300), (300, 301)]
    rng.shuffle(edges)
    out = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == brute.roots({x for e in edges for x in e}, edges)
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0
