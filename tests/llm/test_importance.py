import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

import brute
from ratelens.llm import importance as I

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, most=1):
    w = WORDS.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))
    return [b" ".join(w[i:i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1)], len(w)


def expected(rows, target, most=1, buckets=10_000, min_words=20, percent=10, seed=2024):
    """Rows (id, text) with ids of their own: {id: (n, weight, score, rank)}."""
    s, t = [0] * buckets, [0] * buckets
    for _, x in rows:
        for f in features(x, most)[0]:
            s[zlib.crc32(f) % buckets] += 1
    for x in target:
        for f in features(x, most)[0]:
            t[zlib.crc32(f) % buckets] += 1
    g = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    out, long_enough = {}, []
    for i, x in rows:
        f, words = features(x, most)
        weight = sum(g[zlib.crc32(y) % buckets] for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out[i] = [len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
        if words >= min_words:
            long_enough.append(i)
    long_enough.sort(key=lambda i: (-out[i][2], i is None, i or 0))
    for k, i in enumerate(long_enough[:percent * len(long_enough) // 100]):
        out[i][3] = k + 1
    return {i: tuple(v) for i, v in out.items()}


def found(spark, rows, target, **options):
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame([(x,) for x in target], "text string")
    got = I.importance_resample(d, b, **options).collect()
    return {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in got}


def made(rng, n):
    return " ".join(rng.choice(["the", "Cat", "é1", "x-y", "zebra", "q" * 60, "DOG", "日本", "a.b"]) for _ in range(n))


@pytest.mark.parametrize("most", [1, 3])
def test_odd_texts_and_runs_of_words(spark, most):
    rng = random.Random(3)
    rows = [(i, made(rng, rng.randint(0, 60))) for i in range(-40, 160)]
    rows += [(200, None), (201, ""), (202, " .,\n"), (None, made(rng, 30)), (1 << 62, made(rng, 40)), (203, made(rng, 30_000)), (204, "a\x00b c\x7fd É")]
    target = [made(rng, 50), None, "", "zebra zebra dog"]
    assert found(spark, rows, target, most_words=most) == expected(rows, target, most)


def test_ids_over_the_whole_range_and_many_ranks(spark, monkeypatch):
    monkeypatch.setattr(I, "BLOCK_ROWS", 5)
    rng = random.Random(4)
    ids = [-(1 << 63), (1 << 63) - 1, 0, -1, None, *{rng.randrange(-(1 << 62), 1 << 62) for _ in range(60)}]
    rows = [(i, made(rng, 22)) for i in ids]
    assert found(spark, rows, ["cat"], percent=100) == expected(rows, ["cat"], percent=100)


def test_ties_go_to_the_smaller_id_and_repeated_ids_are_rows(spark, monkeypatch):
    monkeypatch.setattr(I, "BLOCK_ROWS", 7)
    rows = [(i // 2, 5 if i % 3 else -70_000, i) for i in range(200)] + [(None, 5, 1)]
    d = spark.createDataFrame(rows, "doc_id long, score long, text_hash long").repartition(9)
    got = [tuple(r)[:2] for r in I.ranks(d, ["doc_id", "score"]).orderBy("place").collect()]
    assert got == sorted([r[:2] for r in rows], key=lambda r: (-r[1], r[0] is None, r[0] or 0))
    places = [r.place for r in I.ranks(d, ["doc_id", "score"]).collect()]
    assert sorted(places) == list(range(201))


def test_empty_tables_and_clashing_names(spark):
    assert found(spark, [], ["cat"]) == {}
    rows = [(1, "cat " * 30), (2, "dog " * 30)]
    assert found(spark, rows, []) == expected(rows, [])
    d = spark.createDataFrame([(i, t, 1, 2, 3, 4, 5) for i, t in rows],
                              "doc_id long, text string, score int, rank int, place int, text_hash int, weight int")
    b = spark.createDataFrame([("cat", 1)], "text string, bucket int")
    got = {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in I.importance_resample(d, b, percent=50).collect()}
    assert got == expected(rows, ["cat"], percent=50)


def test_crc_of_spans():
    data = np.frombuffer(bytes(range(256)) * 3, np.uint8)
    spans = [(0, 1), (5, 5), (7, 55), (3, 700), (100, 148)]
    first, end = np.array(spans).T
    assert I.crc32_spans(data, first, end).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in spans]


def test_table(spark):
    d = spark.read.parquet(f"{brute.SF_SMALL}/documents.parquet")
    b = spark.read.parquet(f"{brute.SF_SMALL}/benchmark.parquet")
    rows, target = [(r.doc_id, r.text) for r in d.collect()], [r.text for r in b.collect()]
    got = {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in I.importance_resample(d, b).collect()}
    assert got == expected(rows, target)
