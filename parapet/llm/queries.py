"""The registered queries of the training-data operators, over whole tables with the parameters used in production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from parapet.llm import (collocations, cosine, htmltext, knn, mixing, packed, pieces, quality, sharding, simhash, suffixes, toxicity,
                         whitening)


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _word_bpe() -> str:
    return _vocabulary("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> bytes:
    """The SentencePiece model's bytes (half a megabyte); tasks get it with their code."""
    with open(_vocabulary("piece_bpe_32k.model"), "rb") as file:
        return file.read()


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether decoding them gives the text back."""
    return pieces.encode_decode(_table(spark, sf_dir, "documents"), piece_model()).select(
        "doc_id", "n_tokens", "ids", "exact")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior quality of every document; its source is the site, its language the path below it."""
    docs = _table(spark, sf_dir, "documents")
    evidence = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.posterior(docs, evidence, F.col("source"), F.concat_ws("/", "source", "lang"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed corpus, texts included."""
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "source", "text", "mix_copy", "mix_order")


def op4_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the shards written for all documents, from reading them back."""
    return packed.write_and_read(_table(spark, sf_dir, "documents"), _word_bpe, end_id=2, words=True)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth id."""
    return knn.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document without the bytes that earlier documents hold."""
    return suffixes.digest(_table(spark, sf_dir, "documents"))


def op8_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors within their labels."""
    return cosine.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of the labelled categories for every document, and whether it counts as toxic."""
    docs = _table(spark, sf_dir, "documents")
    chain = toxicity.fit(docs, _table(spark, sf_dir, "labels"), toxicity.categories())
    return toxicity.score(docs.select("doc_id", "text"), chain).select(
        "doc_id", "toxicity.p_low_quality", "toxicity.p_toxic", F.col("toxicity.is_toxic").alias("toxic"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = _table(spark, sf_dir, "pages")
    return htmltext.main_text(pages, htmltext.fit(pages)).select("page_id", "url", "text", "n_chars")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's best phrases of two and three words."""
    return collocations.phrases(_table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the four widest components, each scaled to unit variance."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 16, its slot there, and its shard among 17."""
    return sharding.digest(_table(spark, sf_dir, "documents"), sharding.even(16))


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def statements() -> dict[str, str]:
    """DuckDB twins of the queries that SQL can express."""
    return {"op3_mixing": mixing.SQL.format(docs="documents") + mixing.COPIES.format(
        columns="doc_id, source, text, mix_copy, mix_order"),
            "op11_collocations": collocations.SQL.format(docs="documents"),
            "op13_sharding": sharding.statement(sharding.even(16))}
