"""Operator 7: drop lines that many documents share (DataFrame functions only).

Lines are exploded with their positions and keyed; the distinct documents of each key's hash are counted in
two steps (document and hash, then hash), so a line that a third of all documents hold is a few partial counts.
The positions to drop are gathered by document, and the other lines are joined again in order of position.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelens.llm import common as common_settings
from ratelens.llm.common import small, written

SPACES = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without space and 0x09-0x0D at both ends, A-Z lower-cased (``lower`` would change other letters)."""
    trimmed = F.btrim(line, F.lit(SPACES))
    plain = F.length(trimmed) == F.octet_length(trimmed)
    return F.when(plain, F.lower(trimmed)).otherwise(
        F.translate(trimmed, string.ascii_uppercase, string.ascii_lowercase))


def drop_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10,
                      min_chars: int = 1) -> DataFrame:
    """``docs`` with ``line_text`` (the text without lines whose key, of at least ``min_chars`` code points, at least
    ``min_docs`` distinct ids hold), ``n_lines`` (before) and ``n_dropped``.

    Null or empty text is one empty line; a text that loses all its lines is empty. Rows that repeat an id count
    as one document, and each loses its own lines; all rows with a null id count as one document. Other columns pass
    through whatever their names; those of the three new names are replaced. No rows, no rows."""
    clean = F.coalesce(docs[text_col], F.lit(""))
    lines = docs.select(docs[id_col].alias("id"), F.xxhash64(clean).alias("text_hash"),
                        F.posexplode(F.split(clean, "\n", -1)).alias("pos", "line"))
    keyed = lines.select("id", "text_hash", "pos", line_key(F.col("line")).alias("key")).where(
        F.length("key") >= min_chars)
    keyed = keyed.select("id", "text_hash", "pos", F.xxhash64("key").alias("h1"),
                         F.xxhash64(F.lit(1), "key").alias("h2"))
    common = (keyed.groupBy("h1", "h2", "id").agg(F.lit(1).alias("x")).groupBy("h1", "h2")
                   .agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= min_docs).select("h1", "h2"))
    common = written(common, "common-lines")
    gone = (keyed.join(small(common, 16), ["h1", "h2"], "left_semi").groupBy("id", "text_hash")
                 .agg(F.collect_set("pos").alias("gone_at")))
    gone = written(gone.select(F.col("id").alias("gone_id"), F.col("text_hash").alias("gone_hash"), "gone_at",
                               F.size("gone_at").cast("long").alias("gone_n")), "gone-lines")
    size = gone.agg(F.coalesce(F.sum(8 * F.col("gone_n") + 48), F.lit(0)).alias("bytes")).first()["bytes"]
    side = F.broadcast(gone) if size <= common_settings.BROADCAST_BYTES else gone
    kept_cols = [c for c in docs.columns if c not in ("line_text", "n_lines", "n_dropped")]
    out = docs.join(side, docs[id_col].eqNullSafe(side["gone_id"]) & (F.xxhash64(clean) == side["gone_hash"]), "left")
    split = F.split(clean, "\n", -1)
    here = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), side["gone_at"])
    rest = F.array_join(F.transform(here, lambda i: F.element_at(split, i + 1)), "\n")
    return out.select(*[docs[c] for c in kept_cols],
                      F.when(side["gone_at"].isNull(), clean).otherwise(rest).alias("line_text"),
                      F.size(split).cast("long").alias("n_lines"),
                      F.coalesce(side["gone_n"], F.lit(0)).cast("long").alias("n_dropped"))


ORACLE_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos,
         unnest(string_split(coalesce(text, ''), chr(10))) AS line
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
common AS (SELECT key AS common_key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (WHERE common_key IS NOT NULL) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE common_key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common ON key = common_key
GROUP BY doc_id
"""
