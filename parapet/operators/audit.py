"""Outcome and audit rows, the audit line, and usage rollups."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from parapet.functions import fixed

COST = "decimal(18,6)"


def correlation_id(request_id: Column | None = None) -> Column:
    """32 hex digits: fresh without a request id, reproducible (the same in every run and retry) with one."""
    if request_id is None:
        return F.replace(F.uuid(), F.lit("-"), F.lit(""))
    return F.md5(request_id.cast("string"))


def latency_ms(started: Column, finished: Column) -> Column:
    """Milliseconds with fraction between two timestamps, with or without zone."""
    return ((finished - started).cast("interval second").cast("decimal(18,6)") * 1000).cast("double")


def outcome(df: DataFrame) -> DataFrame:
    """Blank the reply of blocked requests and give the status: 422 with empty fields and no tokens, else 200."""
    blocked = F.col("blocked")

    def unless(name: str, empty: Column) -> Column:
        return F.when(blocked, empty).otherwise(F.coalesce(F.col(name), empty))

    return df.withColumns({
        "status": F.when(blocked, fixed.STATUS_BLOCKED).otherwise(fixed.STATUS_OK),
        "provider": unless("provider", F.lit("")), "model": unless("model", F.lit("")),
        "content": unless("content", F.lit("")),
        "prompt_tokens": unless("prompt_tokens", F.lit(0)), "completion_tokens": unless("completion_tokens", F.lit(0)),
        "estimated_cost": unless("estimated_cost", F.lit(0)).cast(COST),
    })


def audit_rows(df: DataFrame, request_id: str = "request_id", prompt: str | None = None) -> DataFrame:
    """One audit event per request from outcome rows (``started_at``, ``finished_at``, ids, reply, flags).

    ``prompt`` names a column of screened prompts to keep with the event, if the policy asks for it.
    """
    none = F.lit(None).cast("string")
    return df.select(
        F.col(request_id), correlation_id(F.col(request_id)).alias("correlation_id"),
        "user_id", "tenant_id", "application_id", "provider", "model", "prompt_tokens", "completion_tokens",
        "estimated_cost", "blocked", F.col("reason").alias("block_reason"), "flags", none.alias("error"),
        "started_at", "finished_at", latency_ms(F.col("started_at"), F.col("finished_at")).alias("latency_ms"),
        *([F.col(prompt).alias("prompt")] if prompt else []))


def audit_line(df: DataFrame) -> DataFrame:
    """Adds ``line``: the event as one line of text. Missing ids print as ``(null)``, an absent id's log form."""
    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("(null)"))

    cost = F.regexp_replace(F.col("estimated_cost").cast("string"), r"\.?0+$", "")
    cost = F.when(cost == "", "0").otherwise(cost)
    latency = F.regexp_replace(F.col("latency_ms").cast("string"), r"\.0$", "")
    blocked = F.initcap(F.col("blocked").cast("string"))
    return df.withColumn("line", F.format_string(
        fixed.AUDIT_LINE, text("correlation_id"), text("user_id"), text("tenant_id"), text("provider"), text("model"),
        blocked, text("prompt_tokens"), text("completion_tokens"), cost, latency, F.array_join("flags", ",")))


def usage_rollup(audit: DataFrame, keys: Sequence[str], quantiles: Sequence[float] = (0.5, 0.95)) -> DataFrame:
    """Requests, blocks, tokens and latency quantiles (whole milliseconds, nearest rank) per ``keys``.

    Rows are first summed per key and millisecond. A key then has at most as many rows as there are different
    latencies, however many requests it had, and the quantiles are exact.
    """
    return _quantiles(_latencies(audit, keys), list(keys), quantiles)


def usage_subtotals(audit: DataFrame, keys: Sequence[str], quantiles: Sequence[float] = (0.5, 0.95)) -> DataFrame:
    """``usage_rollup`` for ``keys`` and every shorter head of them down to the grand total, from one scan of the events.

    Quantiles of a subtotal do not follow from those of its parts, but counts per millisecond add up. So events are
    counted per key and millisecond once, and only those counts are added up for the shorter heads. ``level`` says how many
    keys a row is for; a null key within the level is a key of its own.
    """
    summed = _latencies(audit, keys)
    heads = [[F.col(k) for k in keys[:n]] + [F.col("ms")] for n in range(len(keys), -1, -1)]
    totals = ("n", "blocked", "prompt_tokens", "completion_tokens")
    sets = summed.groupingSets(heads, *keys, "ms").agg(
        F.grouping_id().alias("__set"), *[F.sum(t).cast("bigint").alias(t) for t in totals])
    # of the grouping id's bits the lowest is that of ms, which is in every set
    level = F.lit(len(keys)) - F.bit_count(F.col("__set"))
    done = _quantiles(sets.withColumn("level", level.cast("bigint")), ["level", *keys], quantiles)
    return done.select(*keys, "level", *[c for c in done.columns if c not in (*keys, "level")])


def _latencies(audit: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Requests, blocks and tokens per key and whole millisecond."""
    return (audit.withColumn("ms", F.floor("latency_ms").cast("bigint"))
              .groupBy(*keys, "ms").agg(
                  F.count("*").alias("n"), F.sum(F.col("blocked").cast("bigint")).alias("blocked"),
                  F.sum("prompt_tokens").cast("bigint").alias("prompt_tokens"),
                  F.sum("completion_tokens").cast("bigint").alias("completion_tokens")))


def _quantiles(summed: DataFrame, keys: list[str], quantiles: Sequence[float]) -> DataFrame:
    group = Window.partitionBy(*keys)
    ranked = summed.withColumns({
        "upto": F.sum("n").over(group.orderBy("ms").rowsBetween(Window.unboundedPreceding, 0)),
        "total": F.sum("n").over(group)})
    return ranked.groupBy(*keys).agg(
        F.sum("n").alias("requests"), F.sum("blocked").alias("blocked"),
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
        *[F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * F.lit(q)), F.col("ms"))).alias(f"p{round(q * 100)}_ms")
          for q in quantiles]).withColumn("block_rate", F.round(F.col("blocked") / F.col("requests"), 6))
