"""Helpers the operators of this package share: written intermediates, checked broadcasts,
connected components by contraction."""

from __future__ import annotations

import contextlib
import os
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens.session import checkpoint_dir

#: Largest side, in rows times bytes a row, that a join may broadcast; larger sides are shuffled.
BROADCAST_BYTES = 16 << 20


#: Rows of whole texts in an Arrow batch (Spark's own number suits short rows).
BATCH_ROWS = 1000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), "llm", f"{name}-{uuid.uuid4().hex}")


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """``key`` set for the jobs inside, and put back."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: later jobs read files, whatever executors are lost. The job's shuffle files are
    deleted as it ends, not when the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(*frames: DataFrame) -> None:
    """Delete tables made by ``written`` that no later job reads."""
    for df in frames:
        jvm = df.sparkSession.sparkContext._jvm
        conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for folder in {os.path.dirname(f) for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` (a written table) with a broadcast hint if its counted rows fit BROADCAST_BYTES;
    without one, for a shuffled join, if not."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a long, b long)``: one row ``(node, root)`` for each node of an edge;
    ``root`` is the smallest node of the component. Self-loops and repeats are allowed; no edges, no rows.

    Each round every node points at the neighbour (or itself) of least hash, and edges are rewritten to the
    pointed-at nodes. The random order shrinks paths and stars alike, so the rounds are about the logarithm of the
    diameter. A hub's edges meet in a partial aggregate and in joins that AQE can split."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
                   "edges")
    parents = []
    while True:
        live = both.where("a <> b")
        if live.isEmpty():
            break
        order = F.xxhash64("b")
        known = live if parents else both  # nodes of loops alone, too
        to = known.union(known.select("a", F.col("a").alias("b"))).groupBy("a").agg(F.min_by("b", order).alias("to"))
        to = written(to, "parents")
        parents.append(to)
        moved = (live.join(to, "a").select(F.col("to").alias("x"), F.col("b").alias("y"))
                     .join(to.select(F.col("a").alias("y"), F.col("to").alias("z")), "y")
                     .where("x <> z").select(F.col("x").alias("a"), F.col("z").alias("b")).distinct())
        after = written(moved, "edges")
        drop_written(both)
        both = after
    if not parents:
        loops = edges.select(F.col("a").alias("node"), F.col("a").alias("root"))
        return written(loops.distinct(), "roots")
    at = parents[0].select(F.col("a").alias("node"), F.col("to").alias("at"))
    for to in parents[1:]:
        at = at.join(to.select(F.col("a").alias("at"), "to"), "at", "left").select(
            "node", F.coalesce("to", "at").alias("at"))
    at = written(at, "at")
    least = at.groupBy("at").agg(F.min("node").alias("root"))
    roots = written(at.join(least, "at").select("node", "root"), "roots")
    drop_written(at, both, *parents)
    return roots
