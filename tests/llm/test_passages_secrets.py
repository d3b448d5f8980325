"""Benchmark decontamination, substring dedup and secret scan."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from ratelens.llm import decontamination as D, secrets as S, substring_dedup as P

SCHEMA = "doc_id long, text string"


def made(rng, n):
    return [f"w{rng.randrange(10**5)}" for _ in range(n)]


# ------------------------------------------------------------------ decontamination
def edited(rng, w, share):
    out = []
    for x in w:
        r = rng.random()
        out += [] if r < share / 3 else [f"e{rng.randrange(10**5)}"] if r < 2 * share / 3 else [x, "extra"] if r < share else [x]
    return out


def test_exact_edited_and_clean(spark):
    rng = random.Random(1)
    items = [(i, " ".join(made(rng, rng.randint(15, 60)))) for i in range(30)]
    docs, leaks = [], set()
    for i in range(200):
        w = made(rng, rng.randint(10, 300))
        if i % 3 == 0:
            item = i % 30
            at = rng.randrange(len(w))
            part = items[item][1].split() if i % 2 else edited(rng, items[item][1].split(), 0.15)
            w[at:at] = [x.upper() + "," if rng.random() < 0.2 else x for x in part]
            leaks.add((i, item))
        docs.append((i, " ".join(w)))
    d, b = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    out = D.benchmark_matches(d, b).collect()
    assert {(r.doc_id, r.item_id) for r in out} == leaks
    for r in out:
        item, text = brute.words(dict(items)[r.item_id]), dict(docs)[r.doc_id]
        best = brute.align(item, [x.strip(b",") for x in brute.words(text)])
        assert r.score == pytest.approx(best / (2 * len(item))) and r.passage in text
    kept = {r.doc_id for r in D.drop_contaminated(d, b).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in leaks}


def test_an_item_in_a_third_of_all_documents_keeps_its_seeds(spark):
    rng = random.Random(2)
    item = " ".join(made(rng, 25))
    docs = [(i, " ".join(made(rng, 20)) + (" " + item if i % 3 == 0 else "")) for i in range(300)]
    out = D.benchmark_matches(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(1, item)], "item_id int, text string"))
    assert {r.doc_id for r in out.collect()} == set(range(0, 300, 3))


def test_decontamination_edge_cases(spark, monkeypatch):
    item = "alpha beta gamma delta epsilon zeta"
    b = spark.createDataFrame([("a", item), ("b", item), ("c", None), ("d", ""), ("e", "two words")], "item_id string, text string")
    rows = [(1, None), (2, ""), (None, item), (4, item + " x " + item), (4, item), (5, "alpha beta"), (6, "y " * 50000 + item)]
    d = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(0) for c in ("item_id", "score", "gram", "n")})
    monkeypatch.setattr(D, "BLOCK_CHARS", 40)  # each item a block of its own
    out = sorted(((r.doc_id, r.item_id, r.score, r.first_word) for r in D.benchmark_matches(d, b).collect()), key=str)
    assert out == sorted([(i, x, 1.0, 50000 if i == 6 else 0) for i in (None, 4, 4, 6) for x in "ab"], key=str)
    assert sorted([r.doc_id for r in D.drop_contaminated(d, b).collect()], key=str) == [1, 2, 5]
    more = d.unionByName(spark.createDataFrame([(None, "clean words here"), (4, "clean words, too")], "doc_id long, text string"), allowMissingColumns=True)
    assert sorted([str(r.text) for r in D.drop_contaminated(more, b).collect()]) == sorted(["None", "", "alpha beta", "clean words here", "clean words, too"])


@pytest.mark.parametrize("share, least", [("third", 1.0), (0.1, 1.0), (0.2, 1.0), (0.25, 0.9)])
def test_recall_of_replaced_words_against_alignment(spark, share, least):
    """Of the edited copies whose brute-force alignment reaches the threshold, at least ``least`` are found."""
    rng = random.Random(12)
    items = [made(rng, 60) for _ in range(20)]
    docs, due = [], set()
    for k, item in enumerate(items):
        copy = [f"new{k}x{x}" if (x % 3 == 2 if share == "third" else rng.random() < share) else w for x, w in enumerate(item)]
        docs.append((k, " ".join(made(rng, 80) + copy + made(rng, 80))))
        if brute.align(item, copy) >= 0.5 * 2 * 60:
            due.add(k)
    assert len(due) >= 15
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {r.doc_id for r in D.benchmark_matches(d, b).collect() if r.doc_id == r.item_id}
    assert len(got & due) >= least * len(due)
    empty = spark.createDataFrame([], SCHEMA)
    assert D.benchmark_matches(empty, b).count() == 0
    assert D.benchmark_matches(d, b.limit(0)).count() == 0


def test_alignment_matches_plain_smith_waterman():
    rng = np.random.default_rng(3)
    for _ in range(60):
        a, w = rng.integers(0, 6, rng.integers(1, 15)).astype(np.uint64), rng.integers(0, 6, rng.integers(1, 40)).astype(np.uint64)
        assert D.align(a, w)[0] == brute.align(a.tolist(), w.tolist())


# ------------------------------------------------------------------ substring dedup
def places(out):
    got = {}
    for r in out:
        got.setdefault(r.doc_id, set()).update(range(r.first_word, r.first_word + r.n_words))
    return got


def passages(spark, rows, **kwargs):
    return P.repeated_passages(spark.createDataFrame(rows, SCHEMA), **kwargs).collect()


def test_repeated_passages_match_brute_force(spark):
    rng = random.Random(4)
    shared = [made(rng, n) for n in (49, 50, 51, 80, 300)]
    rows = []
    for i in range(120):
        w = made(rng, rng.randint(1, 150))
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(w))
            w[at:at] = shared[rng.randrange(len(shared))] if i % 2 else shared[1]
        rows.append((i, " ".join(w)))
    rows += [(200, rows[0][1]), (201, rows[3][1].upper())]
    exact = places(r for r in passages(spark, rows) if r.exact)
    want = brute.repeated_places(rows)
    assert set(exact) == set(want) and all(want[i] <= exact[i] for i in want)


def test_edited_passages_are_found_and_clean_text_is_not(spark):
    rng = random.Random(5)
    rows, base = [], [made(rng, 120) for _ in range(20)]
    for i in range(40):
        w = list(base[i % 20])
        for k in rng.sample(range(len(w)), 2):
            w[k] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(made(rng, 30) + w + made(rng, 30))))
    rows += [(100 + i, " ".join(made(rng, 200))) for i in range(40)]
    out = passages(spark, rows)
    found = {r.doc_id: r.same_as for r in out}
    assert set(found) <= set(range(40)) and len(found) >= 36
    assert all(abs(a - b) == 20 for a, b in found.items())


def test_passage_edge_cases(spark):
    rng = random.Random(6)
    t = " ".join(made(rng, 60))
    rows = [(1, None), (2, ""), (3, "short"), (4, t), (4, t), (5, t + " " + t), (None, t), (6, "same " * 200), (7, "same " * 300)]
    got = {r.doc_id: (r.same_as, r.exact) for r in passages(spark, rows)}
    assert got == {4: (5, True), 5: (4, True), 6: (7, True), 7: (6, True)}
    assert passages(spark, [(1, t + " x"), (1, t + " y")]) == []  # one document's own texts
    assert passages(spark, []) == []


def test_compact_windows_hold_every_long_subsequence_once():
    rng = np.random.default_rng(7)
    for _ in range(60):
        parts = [rng.integers(1, rng.choice([2, 30]), rng.integers(0, 90)).astype(np.uint64) for _ in range(3)]
        h = np.concatenate([x for part in parts for x in (np.zeros(1, np.uint64), part)] + [np.zeros(1, np.uint64)])
        least = int(rng.integers(1, 20))
        got = list(zip(*P.compact_windows(h, least)))
        for i in range(len(h)):
            for j in range(i + least - 1, len(h)):
                held = [(l, c, r) for l, c, r in got if l <= i and j <= r and i <= c <= j]
                assert len(held) == (1 if h[i:j + 1].min() else 0)
                assert not held or h[held[0][1]] == h[i:j + 1].min()


def test_very_long_and_repetitive_texts_with_clashing_columns(spark):
    rng = random.Random(31)
    shared = made(rng, 70)
    texts = {1: made(rng, 30_000) + shared, 2: ["again"] * 30_000, 3: shared + made(rng, 200), 4: ["again"] * 55 + made(rng, 10)}
    columns = "doc_id long, text string, v long, id long, key string, first long, words int, exact boolean"
    df = spark.createDataFrame([(i, " ".join(w), 1, 2, "k", 3, 4, None) for i, w in texts.items()], columns)
    got = {(r.doc_id, r.first_word, r.n_words, r.same_as) for r in P.repeated_passages(df).where("exact").collect()}
    assert got == {(1, 30_000, 70, 3), (3, 0, 70, 1), (2, 0, 30_000, 4), (4, 0, 55, 2)}


def test_pair_sweep_matches_the_definition():
    import pyarrow as pa
    rng = np.random.default_rng(9)
    w, keys = [], []
    for _ in range(20):
        lcr = np.sort(rng.integers(0, 60, (rng.integers(1, 40), 3)), 1)
        w.append([{"fn": int(rng.integers(0, 6)), "key": int(rng.integers(0, 50)), "l": int(l), "c": int(c), "r": int(r)}
                  for l, c, r in lcr])
        keys.append(rng.integers(0, 50, 20).tolist())
    kind = pa.list_(pa.struct([("fn", pa.int32()), ("key", pa.int64()), ("l", pa.int32()), ("c", pa.int32()), ("r", pa.int32())]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(20), pa.int64()), pa.array(w, kind), pa.array(keys, pa.list_(pa.int64()))],
                                       ["v", "w", "crowded"])
    want: dict = {}
    for v, ws in enumerate(w):
        for a in ws:
            for b in ws:
                if a["key"] in keys[v] and a["fn"] != b["fn"] and max(a["l"], b["l"]) <= min(a["c"], b["c"]) and max(a["c"], b["c"]) <= min(
                        a["r"], b["r"]) and min(a["r"], b["r"]) - max(a["l"], b["l"]) + 1 >= 10:
                    pair = v, min(a["key"], b["key"]), max(a["key"], b["key"])
                    want[pair] = min(want.get(pair, 99), a["c"], b["c"])
    for most in (1, 7, 1 << 20):
        out = pa.Table.from_batches(P._beside(10, most)(iter([batch])))
        assert sorted(zip(out["v"].to_pylist(), out["c"].to_pylist())) == sorted((k[0], c) for k, c in want.items())
        assert len(set(zip(out["v"].to_pylist(), out["sig"].to_pylist()))) == len(want)


def test_touching_passages_keep_their_own_holders(spark):
    rng = random.Random(21)
    p1, p2 = made(rng, 50), made(rng, 50)
    rows = [(5, " ".join(p1 + p2)), (1, " ".join(p1)), (3, " ".join(p2)), (10, " ".join(p2))]
    got = {(r.doc_id, r.first_word, r.n_words, r.same_as, r.exact) for r in passages(spark, rows)}
    assert got == {(5, 0, 50, 1, True), (5, 50, 50, 3, True), (1, 0, 50, 5, True), (3, 0, 50, 10, True), (10, 0, 50, 3, True)}


def test_same_as_holds_every_passage_of_an_exact_range(spark):
    rng = random.Random(22)
    p, q = made(rng, 60), made(rng, 100)
    texts = {1: p, 2: p + q, 3: [*q[:45], "changed", *q[46:]], 4: q[20:80] + p[:55], 5: p[5:] + q[:60]}
    got = passages(spark, [(i, " ".join(w)) for i, w in texts.items()])
    assert any(not r.exact for r in got)
    for r in got:
        held = {tuple(texts[r.same_as][k:k + 50]) for k in range(len(texts[r.same_as]) - 49)}
        own = texts[r.doc_id][r.first_word:r.first_word + r.n_words]
        assert not r.exact or all(tuple(own[k:k + 50]) in held for k in range(len(own) - 49))


def test_all_edited_passages_of_a_pair_and_diagonal_are_found(spark):
    rng = random.Random(23)
    rows, parts = [], [(20, 120), (440, 80)]
    for i in range(10):
        base = made(rng, 540)
        other = made(rng, 540)
        for at, n in parts:
            other[at:at + n] = base[at:at + n]
            for k in range(at + 35, at + n, 45):
                other[k] = "changed"
        rows += [(i, " ".join(base)), (100 + i, " ".join(other))]
    out = passages(spark, rows)
    assert all(abs(r.doc_id - r.same_as) == 100 for r in out)
    got = places(out)
    assert all(set(range(at + 10, at + n - 10)) <= got[i] for i, _ in rows for at, n in parts)


def test_edited_copies_link_two_groups_of_exact_copies(spark):
    rng = random.Random(24)
    rows = []
    for i in range(6):
        p = made(rng, 300)
        changed = [f"e{i}x{k}" if k % 48 == 47 else x for k, x in enumerate(p)]
        rows += [(10 * i + k, " ".join(made(rng, 80) + w + made(rng, 80))) for k, w in enumerate((p, p, changed, changed))]
    out = passages(spark, rows)
    root = brute.roots([i for i, _ in rows], [(r.doc_id, r.same_as) for r in out])
    assert root == {i: i // 10 * 10 for i, _ in rows}


def test_edited_copies_in_groups_of_hundreds_match_brute_force(spark):
    rng = random.Random(25)
    common = made(rng, 30)  # in every document, too short for a passage
    rows = []
    for i in range(150):
        w = made(rng, 15) + common + made(rng, 15)
        changed = list(w)
        changed[rng.choice([14, 45])] = f"e{i}"
        rows += [(k, " ".join(made(rng, 40) + x + made(rng, 40))) for k, x in ((i, w), (1000 + i, changed))]
    sets = {i: brute.shingles(" ".join(t.split()[40:100])) for i, t in rows}
    want = {(i, 1000 + i) for i in range(150) if len(sets[i] & sets[1000 + i]) >= 0.8 * len(sets[i] | sets[1000 + i])}
    got = {tuple(sorted((r.doc_id, r.same_as))) for r in passages(spark, rows)}
    assert len(want) == 150 and got == want


def test_pairs_compared_in_turns_give_the_same_rows(spark, monkeypatch):
    rng = random.Random(77)
    base = [made(rng, 120) for _ in range(3)]
    rows = [(i, " ".join(made(rng, 40) + edited(rng, base[i % 3], 0.03) + made(rng, 20))) for i in range(24)]
    once = sorted(map(tuple, passages(spark, rows)))
    tables, write = [], P.written
    monkeypatch.setattr(P, "written", lambda df, name: (tables.append(name), write(df, name))[1])
    monkeypatch.setattr(P, "TURN_BYTES", 20_000)
    monkeypatch.setattr(P, "CARRIED", 0)
    assert sorted(map(tuple, passages(spark, rows))) == once and any(not r[4] for r in once)
    assert tables.count("similar") > 2


def test_the_last_plan_is_as_small_however_many_turns_there_were(spark, monkeypatch):
    rng = random.Random(78)
    base = [made(rng, 120) for _ in range(3)]
    df = spark.createDataFrame([(i, " ".join(made(rng, 40) + edited(rng, base[i % 3], 0.03) + made(rng, 20))) for i in range(24)], SCHEMA)
    tables, write = [], P.written
    monkeypatch.setattr(P, "written", lambda df, name: (tables.append(name), write(df, name))[1])

    def scans():
        tables.clear()
        plan = P.repeated_passages(df)._jdf.queryExecution().optimizedPlan().toString()
        return tables.count("similar"), plan.count("Relation ["), plan.count("Join ")

    once = scans()
    monkeypatch.setattr(P, "TURN_BYTES", 20_000)
    monkeypatch.setattr(P, "CARRIED", 0)
    turns = scans()
    assert turns[0] > once[0] and turns[1:] == once[1:] and turns[1] <= 20


def test_collisions_are_shuffled_once_and_by_pair(spark):
    rows = [(1, 2, 1, 0, 5, 70), (1, 2, 2, 0, 6, 75), (1, 2, 4, 40, 5, 70), (1, 3, 1, 0, 5, 70), (1, 3, 1, 0, 5, 70)]
    out = P._regions(spark.createDataFrame(rows, "x long, y long, fns int, d int, low int, high int"))
    assert out.collect() == [(1, 2, 5, 75, 0)]
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1


@pytest.mark.parametrize("members", [1, 3, 128])
def test_groups_meet_in_blocks_of_their_size(spark, monkeypatch, members):
    monkeypatch.setattr(P, "BLOCK_ROWS", members)
    at = [(7, 0, 99, True, 0)]
    rows = [(sig, v, 3, at, 0 if v % 3 == 0 else v) for sig, n in ((1, 9), (2, 20)) for v in range(n)]
    groups = spark.createDataFrame(rows, "sig long, v long, fns int, at array<struct<c: int, l: int, r: int, head: boolean, more: int>>, "
                                   "label long")
    out = P._meet(groups, "sig", "label", 46)
    want = sorted((x, y) for n in (9, 20) for y in range(n) for x in range(y) if x % 3 or y % 3)
    assert sorted((r.x, r.y) for r in out.collect()) == want
    monkeypatch.setattr(P, "_placed", lambda pairs, least: pairs)
    blocks = {r.sig: r.n for r in P._meet(groups, "sig", "label", 46).groupBy("sig").agg(F.max("block").alias("n")).collect()}
    assert members < 128 or blocks == {1: 0, 2: 0}  # a copy of each member, not BLOCKS


def test_longest_stretch_is_the_first_of_most_places():
    def plain(hit, need):
        best = (0, 0)
        for i in range(len(hit) + 1):
            for j in range(i + 1, len(hit) + 1):
                if sum(hit[i:j]) >= need * (j - i) - 1e-9 and j - i > best[1] - best[0]:
                    best = (i, j)
        return best

    rng = np.random.default_rng(8)
    for n in [0, 1, 2, *rng.integers(3, 40, 200)]:
        hit = rng.random(n) < rng.random()
        i, j = P._longest(hit, 8 / 9)
        assert (i, j) == plain(hit, 8 / 9) or i == j and plain(hit, 8 / 9) == (0, 0)


def test_a_written_table_leaves_no_shuffle_files(spark):
    import time
    from ratelens.llm.common import written
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    disk, was = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager(), spark.conf.get(key, None)
    shuffled = lambda: {x for x in disk.getAllBlocks().mkString(" ").split() if x.startswith("shuffle_")}
    before = shuffled()
    table = written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    end = time.time() + 20
    while shuffled() - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffled() - before and table.count() == 7 and spark.conf.get(key, None) == was


# ------------------------------------------------------------------ secrets
def secret_docs(n=120):
    rng = random.Random(8)
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    rows = []
    for i in range(n):
        w = [rng.choice(["thing", "other", "river", "understanding", "internationalization"]) for _ in range(40)]
        if i % 3 == 0:
            w.insert(20, f'token = "{hexes(40)}"')
        if i % 3 == 1:
            w.insert(10, "".join(rng.choice("0123456789") for _ in range(16)))
        rows.append((i, " ".join(w)))
    return rows


def test_forest_keeps_secrets_and_drops_false_findings(spark):
    rows = secret_docs()
    out = S.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id for r in out if r.secret} == set(range(0, 120, 3))
    assert all(dict(rows)[r.doc_id][r.start:r.start + len(r.token)] == r.token for r in out)
    assert any(not r.secret for r in out) and all(0 <= r.score <= 1 for r in out)


def test_forest_learns_given_labels(spark):
    rows = secret_docs(60)
    d = spark.createDataFrame(rows, SCHEMA)
    labels = [(i, rows[i][1].index(t), int(t.isdigit())) for i in range(0, 60) for t in rows[i][1].replace('"', " ").split()
              if len(t) in (16, 40) and any(c.isdigit() for c in t)]
    out = S.scan(d, spark.createDataFrame(labels, "doc_id long, start long, label int")).collect()
    assert {r.token.isdigit() for r in out if r.secret and any(c.isdigit() for c in r.token)} == {True}
    assert all(r.secret for r in out if r.token.isdigit())


def test_secret_edge_cases(spark):
    assert S.scan(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, None), (2, ""), (None, "é key: abcdefghijklmnop0123"), (3, "x" * 20), (3, "x" * 20), (4, "é " * 20000 + "A" * 17)]
    d = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("token", "start", "label", "key")})
    out = S.scan(d).collect()
    assert sorted((str(r.doc_id), r.start) for r in out) == [("3", 0), ("3", 0), ("4", 40000), ("None", 7)]


def test_short_and_split_values_are_candidates(spark):
    rng = random.Random(26)
    rows = [(i, f'{t} password: string thing token = "{rng.getrandbits(160):040x}"') for i, (_, t) in enumerate(secret_docs(90))]
    values = {500: ('password = "hunter2secret"', "hunter2secret"), 501: ("pwd: 'P@ssw0rd!2024#Prod'", "P@ssw0rd!2024#Prod"),
              502: ("postgres://bob:s3cr3t!pw@db.local/x", "s3cr3t!pw"), 503: ('{"api": {"db_password":"é7!x"}}', "é7!x"),
              504: ("use bob:q9#Zk@host now", "q9#Zk"), 505: ("key: password: a7", "a7"), 506: ("redis://:p4ss@h", "p4ss")}
    rows += [(i, "é thing " + t) for i, (t, _) in values.items()]
    out = S.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(dict(rows)[r.doc_id][r.start:r.start + len(r.token)] == r.token for r in out)
    found = {(r.doc_id, r.token): r.secret for r in out}
    assert {(i, v) for i, (_, v) in values.items()} <= set(found)
    assert found[500, "hunter2secret"] and found[501, "P@ssw0rd!2024#Prod"] and found[502, "s3cr3t!pw"]
    assert not any(s for (_, t), s in found.items() if t == "string")


# ------------------------------------------------------------------ runs of a short period
def test_chains_match_the_definition():
    rng = np.random.default_rng(10)
    for _ in range(200):
        of = np.sort(rng.integers(0, 3, rng.integers(0, 25)))
        place = np.concatenate([np.cumsum(rng.choice([1, 1, 1, 2, 5, 9], (of == k).sum())) for k in range(3)]).astype(np.int64)
        head, more = P._chains(of, place)
        gap = [int(place[i + 1] - place[i]) if of[i + 1] == of[i] and place[i + 1] - place[i] <= P.SHINGLE else 0 for i in range(len(of) - 1)]
        for i in range(len(of)):
            after = gap[i] if i < len(gap) else 0
            before = gap[i - 1] if i else 0
            n = 0
            while after and i + n < len(gap) and gap[i + n] == after:
                n += 1
            assert more[i] == n and head[i] == (not before or bool(after) and after != before)


def test_edited_copies_beside_long_runs_are_found(spark):
    rng = random.Random(33)
    rows = []
    for i in range(4):
        p = made(rng, 40)
        changed = [*p[:20], "changed", *p[21:]]
        # the passages end in a run of 20 to 600 equal words; no 50 words are equal in two documents
        rows += [(10 * i + k, " ".join(made(rng, 60) + w + [f"run{i}"] * n + made(rng, 60)))
                 for k, (w, n) in enumerate(((p, 20 if i < 2 else 600), (changed, 22 if i < 2 else 28)))]
    got = {(r.doc_id, r.same_as) for r in passages(spark, rows)}
    assert got == {(10 * i + k, 10 * i + 1 - k) for i in range(4) for k in (0, 1)}
