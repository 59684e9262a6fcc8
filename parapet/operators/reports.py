"""Reports over screened texts."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, functions as F


def screen_report(screened: DataFrame, original: str, text: str, dims: Sequence[str]) -> DataFrame:
    """Texts, blocked and rewritten counts per combination of ``dims``, with subtotals (null = all).

    Rows are summed per full combination first; only those sums go through the rollup.
    """
    changed = (~F.col("blocked")) & (F.col(original) != F.col(text))
    base = screened.groupBy(*dims).agg(
        F.count("*").alias("n"), F.sum(F.col("blocked").cast("bigint")).alias("b"),
        F.sum(changed.cast("bigint")).alias("r"))
    return base.rollup(*dims).agg(F.sum("n").alias("texts"), F.sum("b").alias("blocked"), F.sum("r").alias("redacted"))


def block_reasons(screened: DataFrame, top: int | None = None) -> DataFrame:
    """Blocked texts per screen and reason, most frequent first when ``top`` asks for the leading ones."""
    counts = screened.filter("blocked").groupBy("screen", "reason").agg(F.count("*").alias("texts"))
    return counts if top is None else counts.orderBy(F.desc("texts"), "screen", "reason").limit(top)
