"""Ordered chains of screens over texts, over the messages of chat bodies, and folded per conversation."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from parapet.operators.binding import Parts, Rows
from parapet.operators.screens import Screen


def start_rows(df: DataFrame, text: str, prior_reason: Column | None = None) -> Rows:
    """Rows ready for screening: null text counts as empty; a row with a prior reason is left alone."""
    none = F.lit(None).cast("string")
    env = Rows(df, text=F.coalesce(F.col(text), F.lit("")), screen=none,
               reason=none if prior_reason is None else prior_reason)
    env.bind(lower=lambda ref: f"lower({ref('text')})")
    return env


def in_order(screens: Sequence[Screen]) -> list[Screen]:
    return sorted(screens, key=lambda s: s.order)  # stable: equal orders keep their given order


def run_chain(df: DataFrame, screens: Sequence[Screen], text: str = "text",
              prior_reason: Column | None = None) -> DataFrame:
    """Run the screens in order. Adds ``blocked``, ``screen``, ``reason``; ``text`` is the last rewritten form.

    The first block stops the chain for its row. Everything is a narrow projection: no shuffle, no Python.
    """
    env = start_rows(df, text, prior_reason)
    extra: dict[str, str] = {}
    for one in in_order(screens):
        one.apply(env)
        extra |= one.outputs()
    env.bind(blocked=lambda ref: f"{ref('reason')} IS NOT NULL")
    return env.result(**{text: "text", "blocked": "blocked", "screen": "screen", "reason": "reason"}, **extra)


def run_parts(df: DataFrame, items: str, fields: Sequence[str], screens: Sequence[Screen]) -> DataFrame:
    """The same chain over an array column of structs (``fields``, among them ``text``): every struct gets ``reason``
    and ``screen`` and the rewritten ``text``; their order stays."""
    env = Parts(df, items, list(fields))
    env.bind(reason=lambda ref: "CAST(NULL AS STRING)", screen=lambda ref: "CAST(NULL AS STRING)",
             lower=lambda ref: f"lower({ref('text')})")
    for one in in_order(screens):
        one.apply(env)
    return env.df


def fold_parts(verdicts: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """One verdict per request from its parts: the first blocked part decides.

    ``min_by`` keeps one candidate per group and is combined before the shuffle, so a request with very many parts (or
    a third of all rows) costs no more than one with two.
    """
    at = F.when(F.col("blocked"), F.col(position))
    return verdicts.groupBy(*keys).agg(
        F.count("*").alias("parts"),
        F.coalesce(F.bool_or("blocked"), F.lit(False)).alias("blocked"),
        F.min(at).alias("blocked_part"),
        F.min_by("reason", at).alias("reason"))


def spread(df: DataFrame) -> DataFrame:
    """Give text-heavy work enough tasks: redistribute only when the scan has fewer partitions than there are cores.

    Large inputs already have many splits and pass through untouched.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
