"""Operator 1: exact Jaccard self-join of word-shingle sets with PartEnum signatures.

Two sets A, B with Jaccard >= t differ in at most c(|A|+|B|) features, c = (1-t)/(1+t). Summed over any partition of the
feature domain this holds on average, so some part that is not empty has local Jaccard >= t as well. The first level
deals a set's features to n1 parts; n1 follows from the set's size band (sets just below a band's lower end also
sign in the band above, so similar sets always share a band). The second level deals a part's features to n2 cells
and enumerates the subsets that leave out the k cells in which similar parts of that local size band may differ: the
features in some subset are then equal, and its hash is the signature. A subset without features gives
the part's k+1 smallest features instead, of which similar parts share one.

Before, sets that hardly share features with any other are left out: those of whose sample (features in a fixed part of the
hash space, all features of small sets) less than a quarter occurs in another set. Sets meet on signatures in a star (each
with one pivot of the bucket), never in all pairs of a bucket. Of buckets that still hold several components, those of a
few sets have their other pairs verified. In crowded ones (a passage that many documents share) sets meet again on
their rarest features: similar sets share one of the n - ceil(t n) + 1 rarest of either, and enough features from the first shared one on. These
get more pivots, and the pairs then left between components are verified, so no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratelens.llm import text
from ratelens.llm.common import components, drop_written, small, written

#: Mean features of a part at a band's lower end; bands and numbers of parts grow by 4.
MEAN = 3
#: Mean features of a set's sample at least (sets of fewer than twice as many show all). Two sets of Jaccard 0.8 share four
#: fifths of either at least; that they share under a quarter of a sample has a chance of 6.5e-9 a set at a mean of 32.
SAMPLE = 32
#: Least bits of a set's bitmap.
LEAST_BITS = 512
#: Sets in a bucket whose pairs are verified at once (each set meets at most so many others there).
FEW = 32
#: Pivots tried for each crowded bucket before the remaining pairs are verified.
PIVOT_ROUNDS = 2


def local_classes(a: int, t: float) -> list[int]:
    """Most differing features of a part of ``a`` or fewer features, as few as a similar part has, and a similar one that
    is larger: a signature class for each. Of two similar parts both have the smaller one's class."""
    worst = lambda n: int((1 - t) / (1 + t) * (n + int(n / t + 1e-9)) + 1e-9)
    return sorted({worst(n) for n in range(ceil(t * a - 1e-9), a + 1)})


def signatures(s: np.ndarray, row: np.ndarray, size: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """PartEnum signatures of the sets ``s`` (sorted within ``row``, ``size`` features each): signature and row."""
    low = [0] + [MEAN << 2 * (i + 1) for i in range(20)]
    band = np.searchsorted(low, size, "right") - 1
    upper = np.searchsorted(low, np.floor(size / t + 1e-9), "right") - 1
    out_sig, out_row = [], []
    for b in np.unique(np.concatenate([band, upper])):
        mine = ((band == b) | (upper == b)) & (size > 0)
        keep = mine[row]
        u, r = s[keep], row[keep]
        if not len(u):
            continue
        bits = 2 * int(b)
        part = (u >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(u), np.int64)
        # features are sorted within a row and parts are leading bits: parts are runs
        new = np.ones(len(u), bool)
        new[1:] = (part[1:] != part[:-1]) | (r[1:] != r[:-1])
        first = np.flatnonzero(new)
        local = np.diff(np.append(first, len(u)))
        group = np.cumsum(new) - 1
        name = text.mix(part[first].astype(np.uint64), int(b))
        value = text.mix(u, 5)
        by_class: dict[int, list[int]] = {}
        for a in np.unique(local):
            for k in local_classes(int(a), t):
                by_class.setdefault(k, []).append(int(a))
        for k, sizes in by_class.items():
            chosen = np.isin(local, sizes)
            index = np.cumsum(chosen) - 1
            mask = chosen[group]
            g = index[group[mask]]
            n2 = k + 1
            cell = g * n2 + (text.mix(u[mask], 77 + k) % np.uint64(n2)).astype(np.int64)
            total = np.zeros(chosen.sum() * n2, np.uint64)
            np.add.at(total, cell, value[mask])
            count = np.bincount(cell, minlength=len(total))
            total, count = total.reshape(-1, n2), count.reshape(-1, n2)
            own, own_row = name[chosen], r[first[chosen]]
            empty = np.zeros(len(own), bool)
            for x, cells in enumerate(combinations(range(n2), n2 - k)):
                held = count[:, cells].sum(1) > 0
                empty |= ~held
                sig = text.mix(total[:, cells].sum(1, dtype=np.uint64) + own, 1000 + 100 * k + x)
                out_sig.append(sig[held])
                out_row.append(own_row[held])
            at = first[chosen][empty]
            for x in range(k + 1):  # the least features of parts with an empty subset
                there = x < local[chosen][empty]
                out_sig.append(text.mix(value[at[there] + x] + own[empty][there], 999 + 100 * k))
                out_row.append(own_row[empty][there])
    if not out_sig:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out_sig), np.concatenate(out_row)


def _prints(s: np.ndarray, row: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit prints of each row's set."""
    out = []
    for seed in (11, 12):
        total = np.zeros(len(size), np.uint64)
        np.add.at(total, row, text.mix(s, seed))
        out.append(text.mix(total + size.astype(np.uint64), seed + 2).view(np.int64))
    return out[0], out[1]


def _level(size: np.ndarray) -> np.ndarray:
    """Sets of ``size`` features sample a 2^-level part of the hash space: SAMPLE to twice as many features, or all."""
    return np.maximum(np.floor(np.log2(np.maximum(size, 1) / SAMPLE)), 0).astype(np.uint64)


def _sample(s: np.ndarray, row: np.ndarray, size: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and whether it is in the set's own sample, of the features that the set shows to the samples of sets of at
    most 1/t times fewer or more features."""
    x = text.mix(s, 9)
    shown = _level(np.floor(size * t))[row]
    keep = (x >> (np.uint64(63) - shown)) <= 1
    x, row = x[keep], row[keep]
    return x, row, (x >> (np.uint64(63) - _level(size)[row])) <= 1


def _lists(value: np.ndarray, row: np.ndarray, rows: int) -> pa.Array:
    at = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(value))


def _bitmaps(s: np.ndarray, row: np.ndarray, size: np.ndarray) -> pa.Array:
    """Parity bitmaps of the sets, of a power of two of bits (LEAST_BITS, or as many as features): bit p tells whether an odd
    number of features falls on p. Two sets' bitmaps differ in no more bits than the sets in features; halves of a larger
    bitmap give the smaller one by exclusive or."""
    bits = 1 << np.ceil(np.log2(np.maximum(size, LEAST_BITS))).astype(np.int64)
    first = np.cumsum(bits) - bits
    at = first[row] + (s & (bits[row] - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(at, minlength=int(bits.sum())) & 1).astype(np.uint8)
    longs = np.packbits(odd, bitorder="little").view("<i8")
    edges = np.concatenate([[0], np.cumsum(bits // 64)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(longs))


def _classes(k: int, t: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text.returned(batches):
            for i, j, s, row, size in text.text_sets(batch.column(1), k):
                v, w = _prints(s, row, size)
                x, r, own = _sample(s, row, size, t)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(size), pa.array(v), pa.array(w),
                     _lists(x[own].view(np.int64), r[own], j - i), _lists(x[~own].view(np.int64), r[~own], j - i)],
                    ["id", "n", "v", "w", "own", "more"])
    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text.returned(batches):
            for i, j, s, row, size in text.text_sets(batch.column(1), k):
                v, w = _prints(s, row, size)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(size), pa.array(v), pa.array(w),
                     _bitmaps(s, row, size), _lists(s.view(np.int64), row, j - i)],
                    ["rep", "n", "v", "w", "bits", "s"])
    return run


def _signed(t: float):
    """Signatures of sets ``(rep, n, s)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text.returned(batches):
            at = batch.column(2).offsets.to_numpy().astype(np.int64)
            for i, j in text.chunks(at * 8):
                s = batch.column(2).slice(i, j - i).flatten().to_numpy().view(np.uint64)
                size = np.diff(at[i:j + 1])
                sig, r = signatures(s, np.repeat(np.arange(j - i), size), size, t)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sig.view(np.int64)), batch.column(0).slice(i, j - i).take(pa.array(r))], ["sig", "rep"])
    return run


def _verified(pairs: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    """Of ``pairs(a, b)`` of set representatives, those whose sets have Jaccard >= t (exactly, in integers). Sizes and bitmaps, which
    may not differ by more than the sets, go first; whole sets are shipped only for the pairs then left."""
    per_mille = round(t * 1000)

    def sided(table: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
        return tuple(table.select(F.col("rep").alias(x), F.col("v").alias("v" + x), F.col("n").alias("n" + x),
                                  F.col(column).alias("s" + x)) for x in "ab")

    def folded(x: str, y: str) -> Column:
        half = F.size(y)
        larger = F.zip_with(F.slice(x, 1, half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(x) > half, larger).otherwise(F.col(x))

    differ = F.aggregate(F.zip_with(folded("sa", "sb"), folded("sb", "sa"), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0),
                         lambda total, n: total + n)
    left, right = sided(sets, "bits")
    fit = (pairs.join(left, "a").join(right, "b").where(f"1000 * least(na, nb) >= {per_mille} * greatest(na, nb)")
                .where((1000 + per_mille) * differ <= (1000 - per_mille) * (F.col("na") + F.col("nb")))
                .select("a", "b", "va", "vb"))
    fit = written(fit, "fit")
    left, right = sided(sets, "s")
    left = left.drop("na").join(small(written(fit.select("a", "va").distinct(), "fit"), 16), ["a", "va"], "left_semi")
    right = right.drop("nb").join(small(written(fit.select("b", "vb").distinct(), "fit"), 16), ["b", "vb"], "left_semi")
    both = fit.join(left, ["a", "va"]).join(right, ["b", "vb"])
    return both.where(f"{1000 + per_mille} * size(array_intersect(sa, sb)) >= {per_mille} * (size(sa) + size(sb))").select(
        "a", "b").distinct()


def _merged(root: DataFrame, links: DataFrame) -> DataFrame:
    """``root(node, root)`` after more links: these run between the roots known, so only they are contracted."""
    at = [root.select(F.col("node").alias(x), F.col("root").alias("r" + x)) for x in "ab"]
    between = links.join(at[0], "a", "left").join(at[1], "b", "left").select(
        F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    more = components(between.where("a <> b"))
    old = root.join(more.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select(
        "node", F.coalesce("top", "root").alias("root"))
    fresh = more.join(root.select("node"), "node", "left_anti").select("node", "root")
    return written(old.union(fresh), "roots")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
                       threshold: float = 0.8) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs``: its number of distinct ``words``-word
    shingles and the smallest id reachable by links (pairs of Jaccard >= ``threshold``), its own included.

    Null, empty or wordless text: no shingles, linked with nothing. Texts of fewer words: one shingle, linked with
    equal texts. Rows that repeat an id are one document with several texts, each row returned. A null id is linked with
    nothing and has a null component. Equal texts are one set before any join. Texts are read whole (a task holds one
    text of over 1 MB at a time); other columns are ignored. No rows, no rows."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    samples = written(docs.mapInArrow(_classes(words, threshold),
                                      "id long, n long, v long, w long, own array<long>, more array<long>"), "samples")
    rows = written(samples.select("id", "n", "v", "w"), "classes")
    chosen = _sampled(samples.where("id is not null and n > 0"), threshold)
    drop_written(samples)
    full = rows.where("id is not null and n > 0")
    # one id for each set that may have a link
    wanted = written(full.join(chosen, "v", "left_semi").groupBy("v", "w").agg(F.min("id").alias("id"))
                         .groupBy("id").agg(F.collect_set(F.struct("v", "w")).alias("is")), "wanted")
    texts = docs.join(small(wanted.select("id"), 8), "id", "left_semi").select("id", "text")
    sets = texts.mapInArrow(_sets(words), "rep long, n long, v long, w long, bits array<long>, s array<long>")
    sets = written(sets.join(small(wanted, 64).withColumnRenamed("id", "rep"), "rep")
                       .where("array_contains(is, struct(v, w))").select("rep", "n", "v", "w", "bits", "s")
                       .dropDuplicates(["rep", "v", "w"]), "sets")
    # buckets: signatures of at least two different sets
    signed = sets.select("rep", "n", "s").mapInArrow(_signed(threshold), "sig long, rep long")
    shared = written(signed.groupBy("sig").agg(F.min("rep").alias("pivot"), F.max("rep").alias("top"))
                           .where("pivot <> top").select("sig", "pivot"), "shared")
    member = written(signed.join(small(shared, 16), "sig").select("sig", "rep", "pivot").distinct(), "member")
    drop_written(wanted, shared)
    star = member.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    links = written(_verified(star, sets, threshold), "links")
    root = components(links.union(_ties(rows)))
    # buckets that still hold several components: of a few sets, their other pairs; of many, the refined buckets
    left = written(_open(member.select("sig", "rep"), root, 3), "left")
    drop_written(links, member)
    many = left.where(f"members > {FEW}").select("rep").distinct()
    again = written(_rare(sets.join(small(written(many, "many"), 8), "rep", "left_semi"), threshold), "again")
    pairs = _cross(left.where(f"members <= {FEW}"), sets, threshold)
    for turn in range(PIVOT_ROUNDS):
        hot = written(_open(again, root, 2), "hot")
        pivots = hot.groupBy("sig").agg(
            F.min_by(F.struct("rep", "root"), F.xxhash64(F.lit(turn), "rep")).alias("p"))
        pairs = pairs.union(hot.join(pivots, "sig").where("root <> p.root")
                               .select(F.least("rep", "p.rep").alias("a"), F.greatest("rep", "p.rep").alias("b")))
        pairs = written(pairs.distinct(), "pairs")
        found = written(_verified(pairs, sets, threshold), "links")
        drop_written(hot, pairs)
        if found.isEmpty():
            break
        root = _merged(root, found)
        pairs = star.sparkSession.createDataFrame([], "a long, b long")
    rest = written(_cross(_open(again, root, 3), sets, threshold), "pairs")
    if not rest.isEmpty():
        found = written(_verified(rest, sets, threshold), "links")
        if not found.isEmpty():
            root = _merged(root, found)
    drop_written(sets, left, again, rest)
    return _named(rows, root)


def _sampled(full: DataFrame, t: float) -> DataFrame:
    """``(v)`` of the sets of whose own sample other sets show a share of t - 0.55 at least."""
    shown = full.select("v", F.explode(F.concat("own", "more")).alias("x"))
    common = written(shown.groupBy("x").agg(F.min("v").alias("p"), F.max("v").alias("q")).where("p <> q").select("x"),
                     "common")
    hit = (full.select("v", F.size("own").alias("k"), F.explode("own").alias("x"))
               .join(small(common, 8), "x", "left_semi").distinct())
    return written(hit.groupBy("v", "k").agg(F.count(F.lit(1)).alias("hits")).where(F.col("hits") >= (t - 0.55) * F.col("k")).select("v").distinct(),
                   "sampled")


def _rare(sets: DataFrame, t: float) -> DataFrame:
    """Buckets ``(sig, rep)`` of the features that similar sets must share one of: each set's rarest, as many as it can
    differ in and one more."""
    f = sets.select("rep", "v", "n", F.explode("s").alias("sig"))
    f = f.join(f.groupBy("sig").agg(F.count(F.lit(1)).alias("held")), "sig")
    order = Window.partitionBy("rep", "v").orderBy("held", "sig")
    most = F.col("n") - F.expr(f"({round(t * 1000)} * n + 999) div 1000") + 1
    return (f.withColumn("place", F.row_number().over(order)).where((F.col("place") <= most) & (F.col("held") > 1))
             .select("sig", "rep", "n", "place"))


def _ties(rows: DataFrame) -> DataFrame:
    """Edges between the sets of rows that repeat an id with different texts."""
    full = rows.where("id is not null and n > 0")
    several = full.groupBy("id").agg(F.min("v").alias("p"), F.max("v").alias("q")).where("p <> q").select("id")
    rep = full.groupBy("v", "w").agg(F.min("id").alias("rep"))
    return (full.select("id", "v", "w").distinct().join(several, "id", "left_semi").join(rep, ["v", "w"])
                .select(F.col("id").alias("a"), F.col("rep").alias("b")).where("a <> b"))


def _cross(buckets: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    """Pairs ``(a, b)`` of members of different components in a bucket ``(sig, rep, root)`` whose sizes, and places of the
    shared feature if there are any, allow a link: the overlap is at most what follows the first shared feature."""
    per_mille = round(t * 1000)
    allowed = f"least(xn, yn) * 1000 >= {per_mille} * greatest(xn, yn)"
    if "place" in buckets.columns:
        sized = buckets
        allowed += (f" and (1 + least(xn - xplace, yn - yplace)) * {1000 + per_mille} >= {per_mille} * (xn + yn)")
    else:
        sized = buckets.join(sets.select("rep", "n"), "rep").withColumn("place", F.lit(1))
    x, y = (sized.select("sig", *[F.col(c).alias(side + c) for c in ("rep", "root", "n", "place")]) for side in "xy")
    return (x.join(y, "sig").where("xrep < yrep and xroot <> yroot").where(allowed)
             .select(F.col("xrep").alias("a"), F.col("yrep").alias("b")).distinct())


def _open(buckets: DataFrame, root: DataFrame, least: int) -> DataFrame:
    """The rows of the buckets ``(sig, rep, ...)`` of at least ``least`` members in more than one component, with
    ``root`` and ``members``."""
    at = buckets.join(root.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn(
        "root", F.coalesce("root", "rep"))
    several = at.groupBy("sig").agg(F.min("root").alias("p"), F.max("root").alias("q"),
                                    F.count(F.lit(1)).alias("members"))
    return at.join(several.where(f"p <> q and members >= {least}").select("sig", "members"), "sig")


def _named(rows: DataFrame, root: DataFrame) -> DataFrame:
    """Every row with the smallest id of its component: of its set's representative, or its own."""
    full = rows.where("id is not null and n > 0")
    rep = full.groupBy("v", "w").agg(F.min("id").alias("rep"))
    rep = rep.join(root.withColumnRenamed("node", "rep"), "rep", "left").select(
        "v", "w", F.coalesce("root", "rep").alias("root"))
    linked = full.join(rep, ["v", "w"]).select("id", "n", "root")
    rest = rows.where("id is null or n = 0").select("id", "n", F.col("id").alias("root"))
    return linked.union(rest).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
                                     F.col("root").alias("component_id"))


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                 ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT edges.b, reach.root FROM reach JOIN edges ON edges.a = reach.node)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, r.component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
     JOIN (SELECT node, min(root) AS component_id FROM reach GROUP BY node) r ON r.node = d.doc_id
"""
