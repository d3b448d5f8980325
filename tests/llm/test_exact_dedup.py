import hashlib
import random
import re

import pytest

import brute
from ratelens.llm import exact_dedup as X


def expected(rows):
    """(id, text): sorted result rows; of repeated rows one is kept."""
    normal = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    groups, seen, out = {}, set(), []
    for i, t in normal:
        groups.setdefault(t, []).append(i)
    for i, t in normal:
        ids = [x for x in groups[t] if x is not None]
        keep = min(ids) if ids else None
        stays = i == keep and t not in seen
        if stays:
            seen.add(t)
        out.append((i, keep, len(groups[t]), stays, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def found(d):
    return sorted((tuple(r) for r in X.exact_duplicates(d).collect()), key=str)


ROWS = [(1, "a b"), (2, "a \t\n b"), (3, " a b"), (0, "a\x0bb"), (4, None), (5, ""), (6, " "), (7, "\n\n"), (None, "a b"), (None, "z"), (None, "z"),
        (8, "a b"), (9, "A b"), (10, "é" * 5000), (11, "é" * 5000), (12, "é" * 4999 + "e"), (13, "q"), (13, "q"), (13, "q"), (13, "r"),
        (-5, "r"), (14, "long " * 60_000), (15, "long\n" * 60_000), (16, "long " * 59_999 + "Long ")]


def test_odd_rows(spark):
    assert found(spark.createDataFrame(ROWS, "doc_id long, text string").repartition(5)) == expected(ROWS)
    assert found(spark.createDataFrame([], "doc_id long, text string")) == []


@pytest.mark.parametrize("limit", [40_000, 70_000])
def test_spilled_subtrees_are_resolved_in_later_rounds(spark, monkeypatch, limit):
    # the limit is read in the tasks: hand over patched functions
    rng = random.Random(6)
    start = "common beginning of all " * 3
    texts = [start * (k % 3) + "".join(rng.choice("ab") for _ in range(8 + k % 5)) for k in range(150)]
    rows = [(i, rng.choice(texts[:3]) if i % 3 == 0 else rng.choice(texts)) for i in range(500)]
    for f in ("_owned", "_combined"):
        monkeypatch.setattr(X, f, limited(getattr(X, f), limit))
    monkeypatch.setattr(X, "TRIE_BYTES", limit)
    names, real = [], X.written
    monkeypatch.setattr(X, "written", lambda df, name: names.append(name) or real(df, name))
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == expected(rows)
    assert "exact-spilled" in names


def limited(f, limit):
    def run(batches):
        from ratelens.llm import exact_dedup

        before, exact_dedup.TRIE_BYTES = exact_dedup.TRIE_BYTES, limit
        try:
            yield from f(batches)
        finally:
            exact_dedup.TRIE_BYTES = before
    return run


def test_trie_holds_owners_and_spills_by_subtree():
    rng = random.Random(7)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(2000)]
    trie, want = X.Trie(), {}
    for i, s in enumerate(strings):
        assert trie.add(s, i if i % 7 else None, 1)
        own, c = want.get(s, (None, 0))
        want[s] = (X.least(own, i if i % 7 else None), c + 1)
    held = {s: (o, c) for s, o, c in trie.strings_below(trie.root, b"")}
    assert held == want and trie.strings == len(want)
    gone = {s: (o, c) for s, o, c in trie.spill()}
    held = {s: (o, c) for s, o, c in trie.strings_below(trie.root, b"")}
    assert gone and held and gone | held == want and not gone.keys() & held.keys()
    assert not any(trie.add(s, 1, 1) for s in gone) and all(trie.add(s, 1, 1) for s in held)


def test_extra_columns_of_clashing_names(spark):
    rows = [(i, f"t{i % 3}", 1, 2, "x", True) for i in range(20)]
    d = spark.createDataFrame(rows, "doc_id long, text string, n int, h int, sha string, kept boolean")
    assert found(d) == expected([r[:2] for r in rows])


def test_table(spark):
    d = spark.read.parquet(f"{brute.SF_SMALL}/documents.parquet")
    assert found(d) == expected([(r.doc_id, r.text) for r in d.collect()])
