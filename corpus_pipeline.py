"""From raw documents to training tokens: stages over whole tables, each written before the next one reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from parapet.llm import mixing, pieces, simhash, suffixes, toxicity
from parapet.llm.common import written
from parapet.llm.queries import piece_model


def _same(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``n_chars`` follows the text where there is such a column."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in columns else docs


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents that the classifier chain finds toxic; it is fitted on the labelled ones among them."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.rejected(docs, toxicity.fit(docs, labels, toxicity.categories()))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group that the SimHash operator links: 3-word shingles, at most 3 differing bits."""
    return simhash.one_of_each(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 50 bytes and more that an earlier document holds; the documents stay."""
    return _same(_counted(suffixes.remove(docs), docs.columns), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources get their target weights, in random order."""
    return _same(mixing.mix(docs), docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document (once per copy), checked by decoding them."""
    return pieces.encode_decode(docs, piece_model()).select("doc_id", "n_tokens", "ids", "exact")


STAGES = [("toxicity", reject_toxic), ("simhash", drop_near_duplicates), ("suffix_array", drop_repeated_passages),
          ("mixing", mix_sources), ("sentencepiece", encode)]
#: Fitted models, connected components and the tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
