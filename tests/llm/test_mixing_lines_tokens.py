import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
from ratelens.llm import line_dedup, mixing, token_output
from ratelens.llm.common import scratch

WORDS = public_tokenizers.path("word_bpe_49k.json")


# ------------------------------------------------------------------ mixing
def filled(sizes, weights=(3, 1, 2), budget=1.5, most=2):
    """Targets by sharing out the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, left = {}, set(order), budget * sum(sizes.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] > most * sizes[s]}
        if not above:
            return target | share
        for s in above:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= above
    return target


def mix_frame(spark, n=3000, seed=5):
    rng = random.Random(seed)
    source = lambda: rng.choice(["hot"] * 10 + ["b", "c", "é", "Z", None])
    return spark.createDataFrame([(i, " ".join("w" * rng.randint(1, 3) for _ in range(int(rng.expovariate(1 / 40)))), source())
                                  for i in range(n)], "doc_id long, text string, source string")


def test_mix_meets_targets_and_repeats(spark):
    d = mix_frame(spark)
    rows = mixing.mix_sources(d).collect()
    sizes = {}
    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) and 0 <= r.copies <= 2
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    expected = filled(sizes)
    for s, target in expected.items():
        mine = [r for r in rows if r.source == s]
        assert all(r.source_size == sizes[s] and r.target == pytest.approx(target) for r in mine)
        assert abs(sum(r.size * r.copies for r in mine) - target) <= max(0.03 * target, 2 * max(r.size for r in mine))
    again = mixing.mix_sources(d.repartition(7)).collect()
    assert sorted((r.doc_id, r.copies) for r in rows) == sorted((r.doc_id, r.copies) for r in again)
    other = mixing.mix_sources(d, seed=8).collect()
    assert sorted((r.doc_id, r.copies) for r in rows) != sorted((r.doc_id, r.copies) for r in other)


def test_mix_edge_cases(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix_sources(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, None, "a"), (2, "", "a"), (None, "x y", None), (3, "x", "b"), (3, "x", "b"), (4, "z " * 50000, "b")]
    d = spark.createDataFrame(rows, schema).withColumns({c: F.lit("q") for c in ("class", "bucket", "h", "size", "target")})
    out = mixing.mix_sources(d).collect()
    assert len(out) == 6 and all(r.copies is not None for r in out)
    assert {r.size for r in out if r.source == "a"} == {0} and all(r.target == 0 for r in out if r.source == "a")


# ------------------------------------------------------------------ lines
def lines_of(rows, min_docs=10, min_chars=1):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            held.setdefault(key(x), set()).add(i)
    common = {k for k, v in held.items() if len(k) >= min_chars and len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in common]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_lines_match_brute_force(spark):
    rng = random.Random(6)
    common = ["Terms of Use", "  terms of use\t", "É accents", "é accents", "", "  ", " x"]
    rows = [(i % 400, "\n".join(rng.choice(common + [f"own {rng.randrange(200)}"]) for _ in range(rng.randint(1, 6))))
            for i in range(420)]
    rows += [(500, None), (501, ""), (502, "\n\n"), (503, "Terms of use\n" * 3000 + "end"), (None, "terms of use"), (None, "a\nb")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {c: F.lit(1) for c in ("id", "pos", "key", "h1", "gone_at", "n_lines")})
    for least in (10, 300):
        out = [(r.doc_id, r.n_lines, r.n_dropped, r.line_text)
               for r in line_dedup.drop_common_lines(d, min_docs=least).collect()]
        assert sorted(out, key=str) == lines_of(rows, least)
    assert line_dedup.drop_common_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_large_side_is_joined_without_broadcast(spark, monkeypatch):
    from ratelens.llm import common as C
    monkeypatch.setattr(C, "BROADCAST_BYTES", 0)
    rows = [(i, f"shared\nown {i}") for i in range(30)]
    out = line_dedup.drop_common_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.line_text for r in out) == sorted(f"own {i}" for i in range(30))


# ------------------------------------------------------------------ tokens
def expected_tokens(rows, end=2):
    tok, out, at = Tokenizer.from_file(WORDS), [], 0
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, end], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes()), ids.tolist()))
        at += len(ids)
    return out


def test_tokens_round_trip(spark):
    docs = spark.read.parquet(f"{brute.SF_SMALL}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    odd = [(1000, None), (1001, ""), (1002, "<|endoftext|> é ́x y z \x1c! ΑΣ Σ"), (1003, "ok " * 50000),
           (1004, "it's 12 we'll\r\n\tgo"), (1005, "x" * 3000)]
    rows += odd
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("id", F.lit("clash"))
    folder = scratch(spark, "t")
    token_output.write_tokens(d, folder, WORDS, by_word=True)
    out = token_output.read_tokens(spark, folder, with_ids=True).orderBy("doc_id").collect()
    assert [tuple(r) for r in out] == expected_tokens(rows)
    manifest = spark.read.parquet(f"{folder}/manifest").orderBy("part").collect()
    assert [r.base for r in manifest] == list(np.cumsum([0] + [r.ids for r in manifest])[:-1])
    assert {r.dtype for r in manifest} == {"<u2"}


def test_tokens_nulls_repeats_and_empty(spark):
    rows = [(None, "b"), (None, "a"), (3, "same"), (3, "same"), (3, "other"), (1, "x y")]
    folder = scratch(spark, "t")
    token_output.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), folder, WORDS, by_word=True)
    out = token_output.read_tokens(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in out] == [None, None, 1, 3, 3, 3]
    assert [r.start for r in out] == list(np.cumsum([0] + [r.n_tokens for r in out])[:-1])
    folder = scratch(spark, "t")
    token_output.write_tokens(spark.createDataFrame([], "doc_id long, text string"), folder, WORDS)
    assert token_output.read_tokens(spark, folder).count() == 0


def test_other_tokenizers_are_encoded_whole(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(1, "Hello  world\n x"), (2, " a b")]
    folder = scratch(spark, "t")
    token_output.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), folder, path, end_id=50256)
    out = token_output.read_tokens(spark, folder, with_ids=True).orderBy("doc_id").collect()
    tok = Tokenizer.from_file(path)
    assert [r.ids for r in out] == [[*tok.encode(t).ids, 50256] for _, t in rows]


def test_sha_of_kept_lines(spark):
    d = spark.createDataFrame([(1, "é\nb")], "doc_id long, text string")
    r = line_dedup.drop_common_lines(d).select(F.sha2("line_text", 256).alias("s")).first()
    assert r.s == hashlib.sha256("é\nb".encode()).hexdigest()
