"""Requests, replies and chat bodies derived from the given tables, row by row."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from parapet.operators.chain import spread
from parapet.plans.samples import PROMPT_SAMPLES, REPLY_SAMPLES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_sample(text: Column, number: Column, samples: Sequence[str]) -> Column:
    """The text followed by one of the samples on a line of its own."""
    chosen = F.get(F.array(*[F.lit(s) for s in samples]), (number % len(samples)).cast("int"))
    return F.concat(text, F.lit("\n"), chosen)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(
        "doc_id", with_sample(F.col("text"), F.col("doc_id"), PROMPT_SAMPLES).alias("prompt"), "lang", "source",
        "n_chars")


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a blocklist: stretches of documents, of 4 to 23 characters, in upper case."""
    return documents(spark, sf_dir).filter("doc_id % 5 = 0").select(
        F.expr("upper(substring(text, CAST(20 + doc_id % 50 AS INT), CAST(4 + doc_id % 20 AS INT)))").alias("entry"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("conv_id") * 7 + F.col("turn")
    return spread(table(spark, sf_dir, "conversations")).select(
        "conv_id", "turn", "role", with_sample(F.col("text"), at, PROMPT_SAMPLES).alias("text"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as responses."""
    at = F.col("conv_id") * 7 + F.col("turn")
    return spread(table(spark, sf_dir, "conversations")).filter("role = 'assistant'").select(
        "conv_id", "turn", with_sample(F.col("text"), at, REPLY_SAMPLES).alias("content"))


_TS = "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, CAST(doc_id * 7 AS DECIMAL(18,6)))"


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = prompts(spark, sf_dir)
    return d.selectExpr(
        "doc_id AS request_id", f"{_TS} AS ts", "prompt",
        "CASE WHEN doc_id % 4 = 1 THEN ' ' WHEN doc_id % 4 = 2 THEN 'Answer in ' || lang END AS system_prompt",
        "CASE WHEN doc_id % 11 <> 0 THEN 'u' || (doc_id % 37) END AS user_id",
        "CASE WHEN doc_id % 13 <> 0 THEN source END AS tenant_id",
        "'app-' || lang AS application_id",
        "CASE WHEN doc_id % 6 = 0 THEN 'summarize' ELSE 'chat' END AS operation",
        "CASE doc_id % 10 WHEN 0 THEN 'azure' WHEN 1 THEN 'nobody' WHEN 2 THEN 'azure' END AS requested_provider",
        "CASE doc_id % 10 WHEN 0 THEN 'gpt-large' WHEN 1 THEN 'gpt-large' WHEN 2 THEN '  ' END AS requested_model",
        "CAST(CASE WHEN doc_id % 3 <> 0 THEN (doc_id % 5) * 100 + 56 END AS INT) AS max_tokens",
        "CAST(CASE WHEN doc_id % 4 <> 0 THEN (doc_id % 8) / 4 END AS DOUBLE) AS temperature",
        "map('priority', CASE WHEN doc_id % 5 = 0 THEN 'High' ELSE 'low' END, 'size', CAST(n_chars AS STRING))"
        " AS metadata")


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    return d.select(
        F.col("doc_id").alias("request_id"), with_sample(F.col("text"), F.col("doc_id"), REPLY_SAMPLES).alias("content"),
        F.floor(F.col("n_chars") / 4).cast("int").alias("prompt_tokens"),
        (F.col("doc_id") % 97).cast("int").alias("completion_tokens"),
        F.expr("CASE WHEN doc_id % 9 = 0 THEN 'upstream timeout' END").alias("error"),
        F.expr(f"{_TS} + make_dt_interval(0, 0, 0, CAST((doc_id % 1000) * 0.0015 + 0.00025 AS DECIMAL(18,6)))")
        .alias("finished_at"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls to providers, a row each: some fail, some fallbacks fail too, some requests got no answer at all."""
    d = documents(spark, sf_dir).filter("doc_id % 29 <> 5")
    calls = d.select("*", F.explode(F.expr("CASE WHEN doc_id % 4 = 0 THEN array(1, 2) ELSE array(1) END")).alias("attempt"))
    return calls.select(
        F.col("doc_id").alias("request_id"), "attempt",
        F.when(F.expr("NOT (attempt = 1 AND doc_id % 4 = 0) AND NOT (attempt = 2 AND doc_id % 12 = 0)"),
               with_sample(F.col("text"), F.col("doc_id") + F.col("attempt"), REPLY_SAMPLES)).alias("content"),
        (F.floor(F.col("n_chars") / 4) + F.col("attempt")).cast("int").alias("prompt_tokens"),
        (F.col("doc_id") % 97).cast("int").alias("completion_tokens"),
        F.expr("CASE WHEN attempt = 1 AND doc_id % 4 = 0 THEN 'upstream timeout' "
               "WHEN attempt = 2 AND doc_id % 12 = 0 THEN 'backup overloaded' END").alias("error"),
        F.expr(f"{_TS} + make_dt_interval(0, 0, 0, CAST((doc_id % 1000) * 0.0015 + attempt * 0.00025 AS DECIMAL(18,6)))")
        .alias("finished_at"))


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat bodies of four kinds: several messages, a single prompt, a prompt beside unscreened messages, no JSON."""
    d = prompts(spark, sf_dir)

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"), F.col("lang").alias("name"))

    text = F.col("prompt")
    chat = F.to_json(F.struct(
        F.lit("gpt-small").alias("model"),
        F.array(message("system", F.concat(F.lit("Answer in "), F.col("lang"))), message("user", text),
                message("assistant", F.lit("write to me@example.com")),
                message("user", F.concat(F.col("source"), F.lit(' says "call 555-123-4567"\n')))).alias("messages"),
        F.col("n_chars").alias("max_tokens")))
    both = F.to_json(F.struct(F.array(message("assistant", text)).alias("messages"), text.alias("prompt")))
    kind = F.col("doc_id") % 4
    return d.select("doc_id", F.when(kind == 0, chat).when(kind == 1, F.to_json(F.struct(text.alias("prompt"))))
                    .when(kind == 2, both).otherwise(text).alias("body"))


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completion bodies; some without choices, some without usage, some that are no JSON."""
    d = documents(spark, sf_dir)
    content = with_sample(F.col("text"), F.col("doc_id"), REPLY_SAMPLES)
    choices = F.array(F.struct(F.struct(F.lit("assistant").alias("role"), content.alias("content")).alias("message")))
    usage = F.struct(F.floor(F.col("n_chars") / 4).alias("prompt_tokens"),
                     (F.col("doc_id") % 97).alias("completion_tokens"))
    full = F.to_json(F.struct(choices.alias("choices"), usage.alias("usage")))
    kind = F.col("doc_id") % 5
    return d.select("doc_id", F.when(kind == 0, F.to_json(F.struct(usage.alias("usage"))))
                    .when(kind == 1, F.to_json(F.struct(choices.alias("choices"))))
                    .when(kind == 2, content).otherwise(full).alias("reply"))


def quota_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"), "ts", F.col("user_id").cast("string").alias("user_id"),
        F.col("event_type").alias("tenant_id"), F.lit(None).cast("string").alias("application_id"), "value", "props")
