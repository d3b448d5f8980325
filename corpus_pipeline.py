"""The corpus pipeline: stages over ``documents``, each of which calls one operator of ``ratelens.llm``.

Rows with a null id pass the filters on their own text's account: they have a quality score and go when they hold a benchmark
passage, but no near-duplicate group can be told by id, so that stage keeps them. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens.llm import decontamination, mixing, ngram_jaccard, quality, token_output
from ratelens.llm.common import read_table, scratch, small, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. It is trained on labelled documents of the stage's input."""
    model = quality.train(docs, read_table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where("predicted = 1").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of least id."""
    groups = ngram_jaccard.jaccard_components(docs)
    gone = written(groups.where("doc_id <> component_id").select("doc_id").distinct(), "near-duplicates")
    return docs.join(small(gone, 8), "doc_id", "left_anti").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontamination.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = mixing.mix_sources(docs).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files of all documents, described a row a document as they are read back."""
    import public_tokenizers

    out_dir = scratch(spark, "pipeline-tokens")
    token_output.write_tokens(docs, out_dir, public_tokenizers.path("word_bpe_49k.json"), by_word=True)
    return token_output.read_tokens(spark, out_dir)


STAGES = [("quality_classifier", quality_classifier), ("near_duplicates", near_duplicates),
          ("decontaminate", decontaminate), ("mix", mix), ("tokens", tokens)]

#: Trained scores, alignments and tokenizers can't be expressed in SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what each returns is written as Parquet and read by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
