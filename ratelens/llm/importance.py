"""Operator 11: importance resampling towards a target corpus, ranked by a distributed LSD radix sort.

Features are runs of words, hashed to buckets. The counts of all documents and of all target texts give one array of gains,
by which every document is scored; seeded Gumbel noise makes the highest scores a draw without replacement.

The ranks come from stable counting-sort passes. A row's composite key (score downwards, then id) is read as digits of
DIGIT_BITS bits, the last digit first. Rows lie in blocks of equal size. A pass counts the rows of each block and digit; prefix
sums over digits, then blocks, give the place of each such run's first row; a row's destination is that place and its number
within the run, and destinations make the next blocks. Each pass is written, so a lost executor costs part of one pass. As blocks
are equal and runs are split by block, no value of a digit, however frequent, gathers in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratelens.llm import text
from ratelens.llm.common import drop_written, written

#: Bits of a digit: a pass has 2^DIGIT_BITS counters.
DIGIT_BITS = 11
#: Least rows of a block, and most blocks (blocks grow beyond).
BLOCK_ROWS = 64
MOST_BLOCKS = 16384
#: Words hashed byte by byte for all words at once; longer ones come one by one.
SHORT = 48

#: ASCII letters and digits, and all bytes of other characters, belong to words.
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _crc_table() -> np.ndarray:
    """The table of the reflected CRC-32 with polynomial 0xEDB88320, by its rule."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_CRC = _crc_table()


def crc32_spans(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of each span ``data[first:end]``."""
    crc = np.full(len(first), 0xFFFFFFFF, np.uint32)
    size = end - first
    for x in range(min(SHORT, int(size.max(initial=0)))):
        at = np.flatnonzero((size > x) & (size <= SHORT))
        c = crc[at]
        crc[at] = _CRC[(c ^ data[first[at] + x]) & 0xFF] ^ (c >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    for k in np.flatnonzero(size > SHORT):
        crc[k] = zlib.crc32(data[first[k]:end[k]].tobytes())
    return crc


def feature_buckets(data: np.ndarray, at: np.ndarray, i: int, j: int, most_words: int,
                    buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts in rows i..j: bucket and row (from 0) of every feature, runs of 1 to ``most_words`` words joined by one
    space; and the words of each row."""
    base = int(at[i])
    b = data[base:int(at[j])]
    edge = (at[i:j + 1] - base).astype(np.int64)
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(j - i, np.int64)
    solid = _WORD[b]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    inner = edge[(edge > 0) & (edge < len(b))]
    begins[inner] = solid[inner]
    ends[inner - 1] = solid[inner - 1]
    first, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    row = np.searchsorted(edge, first, "right") - 1
    number = np.bincount(row, minlength=j - i)
    # the words one after the other with one space between, so that a run of words is one span
    size = end - first
    packed_end = np.cumsum(size + 1) - 1
    packed_first = packed_end - size
    packed = np.full(int(packed_end[-1]) + 1 if len(size) else 0, 32, np.uint8)
    packed[np.repeat(packed_first - first, size) + np.flatnonzero(solid)] = _LOWER[b[solid]]
    got, rows = [], []
    for k in range(1, most_words + 1):
        left = np.arange(max(len(row) - k + 1, 0))
        left = left[row[left] == row[left + k - 1]]
        got.append((crc32_spans(packed, packed_first[left], packed_end[left + k - 1]) % np.uint32(buckets)).astype(np.int64))
        rows.append(row[left])
    return np.concatenate(got), np.concatenate(rows), number


def bucket_counts(texts: DataFrame, text_col: str = "text", most_words: int = 1, buckets: int = 10_000) -> np.ndarray:
    """Features of all whole texts by bucket: an array of ``buckets`` numbers, the one bounded thing the driver receives."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            data, at = text.utf8(batch.column(0))
            for i, j in text.chunks(at):
                got, _, _ = feature_buckets(data, at, i, j, most_words, buckets)
                total += np.bincount(got, minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["bucket", "n"])

    found = texts.select(text_col).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in found.collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket: floor(1000 ln of the smoothed target share over the smoothed source share), an integer."""
    n = len(source)
    ratio = (target + 1).astype(float) * float(source.sum() + n) / ((source + 1).astype(float) * float(target.sum() + n))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def _scored(gain: np.ndarray, most_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text.utf8(batch.column(1))
            for i, j in text.chunks(at):
                got, row, words = feature_buckets(data, at, i, j, most_words, len(gain))
                n = np.bincount(row, minlength=j - i)
                total = np.zeros(j - i, np.int64)
                np.add.at(total, row, gain[got])
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(n), pa.array(words), pa.array(weight),
                     batch.column(2).slice(i, j - i)], ["doc_id", "n_features", "n_words", "weight", "text_hash"])
    return run


def importance_resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        target_text_col: str = "text", most_words: int = 1, buckets: int = 10_000, min_words: int = 20,
                        percent: int = 10, seed: int = 2024) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` for every row of ``docs``; ``rank`` (from 1) is set for the
    floor(``percent`` N / 100) highest scores of the N rows of at least ``min_words`` words, ties to the smaller id.

    Null or empty texts have no features, weight 0 and are never drawn (unless ``min_words`` is 0); null or empty target
    texts add nothing. A null id is hashed as empty text and comes after all ids of its score. Rows that repeat an id
    are rows of their own with one noise, ordered by a hash of the text. No target features: smoothing alone. Texts
    are read whole, twice (counts, then scores), half a MB or one longer text at a time; other columns are ignored. No
    rows, no rows."""
    source = bucket_counts(docs, text_col, most_words, buckets)
    gain = gains(source, bucket_counts(target, target_text_col, most_words, buckets))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       F.xxhash64(text_col).alias("text_hash"))
    rows = rows.mapInArrow(_scored(gain, most_words),
                           "doc_id long, n_features long, n_words long, weight long, text_hash long")
    noise = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(noise, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    score = F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long")
    scored = written(rows.withColumn("score", score), "scored")
    long_enough = F.col("n_words") >= min_words
    ranked = ranks(scored.where(long_enough), ["doc_id", "n_features", "weight", "score"])
    drawn = percent * ranked.count() // 100
    out = ["doc_id", "n_features", "weight", "score"]
    rank = F.when(F.col("place") < drawn, F.col("place") + 1).cast("long").alias("rank")
    rest = scored.where(~long_enough).select(*out, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*out, rank).unionByName(rest)


def _digits(top: int, key: str) -> list[F.Column]:
    """The digits of a key of 0 to ``top``, last first."""
    n = max(-(-top.bit_length() // DIGIT_BITS), 0)
    return [F.shiftrightunsigned(key, DIGIT_BITS * k).bitwiseAND((1 << DIGIT_BITS) - 1).cast("int") for k in range(n)]


def ranks(scored: DataFrame, columns: list[str]) -> DataFrame:
    """``scored(doc_id, score, text_hash, ...)`` with ``place``, its rank from 0 by score downwards, then id (nulls last), then
    ``text_hash``, found by LSD radix sort."""
    ends = scored.agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s0"), F.max("score").alias("s1"), F.min("doc_id").alias("i0"),
                      F.max("doc_id").alias("i1")).first()
    if not ends.n:
        return scored.select(*columns, F.lit(0).cast("long").alias("place"))
    i0, i1 = (ends.i0, ends.i1) if ends.i0 is not None else (0, 0)
    by_id: list[F.Column] = []
    if i1 - i0 < (1 << 62):
        id_key, id_top = F.coalesce(F.col("doc_id") - F.lit(i0), F.lit(i1 - i0 + 1)), i1 - i0 + 1
    else:  # as unsigned numbers; a null comes after all by a digit of its own
        id_key, id_top = F.coalesce(F.col("doc_id"), F.lit(0)).bitwiseXOR(F.lit(-(1 << 63))), (1 << 64) - 1
        by_id = [F.col("doc_id").isNull().cast("int")]
    by_id = _digits(id_top, "id_key") + by_id
    keys = by_id + _digits(ends.s1 - ends.s0, "score_key")
    block = max(BLOCK_ROWS, -(-ends.n // MOST_BLOCKS))
    # rows that repeat an id start in one partition, in order of text, and every pass is stable
    start = Window.partitionBy("part").orderBy("in_part")
    at = (scored.select(*columns, "text_hash", id_key.alias("id_key"), (F.lit(ends.s1) - F.col("score")).alias("score_key"))
                .repartition("id_key").sortWithinPartitions("id_key", "text_hash").drop("text_hash")
                .withColumn("part", F.spark_partition_id().cast("long"))
                .withColumn("in_part", F.monotonically_increasing_id()))
    at = written(at, "radix")
    sizes = at.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.min("in_part").alias("from"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    sizes = sizes.withColumn("base", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    placed = at.join(F.broadcast(sizes.select("part", "from", "base")), "part").withColumn(
        "place", F.col("base") + F.col("in_part") - F.col("from"))
    own = [*columns, "id_key", "score_key"]
    now = written(placed.select(*own, "place"), "radix")
    drop_written(at)
    for digit in keys:
        after = written(_pass(now, own, digit, block), "radix")
        drop_written(now)
        now = after
    return now.select(*columns, "place")


def _pass(now: DataFrame, own: list[str], digit: F.Column, block: int) -> DataFrame:
    """One stable counting sort of the rows in ``place`` order by ``digit``."""
    rows = now.select(*own, "place", F.floor(F.col("place") / F.lit(block)).cast("long").alias("block"), digit.alias("digit"))
    runs = rows.groupBy("digit", "block").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    by_digit = runs.groupBy("digit").agg(F.sum("n").alias("total"))
    smaller = Window.orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)  # at most 2^DIGIT_BITS rows
    by_digit = by_digit.select("digit", F.coalesce(F.sum("total").over(smaller), F.lit(0)).alias("digit_base"))
    first = (runs.withColumn("in_digit", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
                 .join(F.broadcast(by_digit), "digit")
                 .select("block", "digit", (F.col("digit_base") + F.col("in_digit")).alias("base")))
    # the base row goes before its run, so both meet by one exchange of equal blocks
    kinds = dict(rows.dtypes)
    heads = first.select(*[F.lit(None).cast(kinds[c]).alias(c) for c in own], F.lit(-1).cast("long").alias("place"), "block", "digit", "base")
    both = rows.withColumn("base", F.lit(None).cast("long")).unionByName(heads).repartition("block")
    run = Window.partitionBy("block", "digit").orderBy("place")
    both = both.withColumn("to", F.first("base").over(run.rowsBetween(Window.unboundedPreceding, 0)) + F.row_number().over(run) - 2)
    return both.where("place >= 0").select(*own, F.col("to").cast("long").alias("place"))


ORACLE_SQL = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n::UBIGINT, range(8)::UBIGINT[]),
           lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END)) AS t),
words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents),
aims AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
named AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::UBIGINT,
             list_transform(range(octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::UBIGINT)),
             lambda a, b: xor(a >> 8, t[(xor(a, b) & 255)::INT + 1])), 4294967295::UBIGINT) % 10000 AS bucket
  FROM (SELECT w FROM words UNION SELECT w FROM aims), crc),
source AS (SELECT bucket, count(*) AS s FROM words JOIN named USING (w) GROUP BY bucket),
target AS (SELECT bucket, count(*) AS t FROM aims JOIN named USING (w) GROUP BY bucket),
gain AS (
  SELECT b.bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM words) + 10000)::DOUBLE
                                        / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM aims) + 10000)::DOUBLE))) AS BIGINT) AS g
  FROM (SELECT DISTINCT bucket FROM named) b LEFT JOIN source USING (bucket) LEFT JOIN target USING (bucket)),
sums AS (
  SELECT doc_id, count(*) AS n, sum(g) AS total FROM words JOIN named USING (w) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features,
         CAST(coalesce(floor((total - ((total % n) + n) % n) / n), 0) AS BIGINT) AS weight,
         CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::UBIGINT + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS noise
  FROM documents d LEFT JOIN sums USING (doc_id)),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS place, count(*) OVER () AS n
  FROM scored WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, weight + noise AS score,
       CAST(CASE WHEN place <= floor(10 * n / 100) THEN place END AS BIGINT) AS rank
FROM scored s LEFT JOIN ranked r ON r.doc_id = s.doc_id
"""
