"""Audit events on a stream: requests met with their replies, the sink, and block rates per minute."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from parapet.functions.clock import epoch_micros, from_micros
from parapet.operators.audit import audit_rows
from parapet.plans import flows
from parapet.policy import Policy


def block_rate_by_minute(audit: DataFrame, ts: str = "started_at", late: str = "10 minutes") -> DataFrame:
    """Requests and blocks per tumbling minute, emitted once the watermark has passed the minute. Times without zone are
    taken as UTC."""
    return (audit.withColumn("at", from_micros(epoch_micros(audit, ts))).withWatermark("at", late)
            .groupBy(F.window("at", "1 minute"))
            .agg(F.count("*").alias("requests"), F.sum(F.col("blocked").cast("bigint")).alias("blocked"))
            .select(F.col("window.start").alias("minute"), "requests", "blocked",
                    (F.col("blocked") / F.col("requests")).alias("block_rate")))


def audit_stream(requests: DataFrame, replies: DataFrame, policy: Policy, ts: str = "ts", request_id: str = "request_id",
                 late: str = "10 minutes", patience: str = "1 hour") -> DataFrame:
    """One audit event per request from a stream of requests and one of replies (a row per request; see ``flows.answer``).

    A reply counts if it finished at or after its request and at most ``patience`` later; the event then leaves at once.
    A request without one leaves as a gateway error, as in ``flows.audit``, when the watermark (``late`` behind the slower
    of both streams) has passed its patience, so state holds what the two spans cover and no more. A stream that went quiet
    keeps its watermark: send a request with a null id and a reply with an id of no request now and then (replies with a null
    id are left out before the watermark sees them). Such a request ends in an event with a null id, once others have passed
    it. Several replies to one request give an event each. Screens and routes need no state. Quotas do (``streaming.quota``), so a policy
    that has them is refused here.
    """
    if policy.quotas_enabled and policy.quota_rules:
        raise ValueError("audit_stream does not count quotas: run stream_quota before it and turn quotas off in the policy")
    decided = flows.decide(requests, policy, ts, request_id)
    asked = decided.withColumns({"started_at": F.col(ts), "__asked": from_micros(epoch_micros(decided, ts))})
    screened = flows.screened_replies(replies, policy).withColumnRenamed(request_id, "__of")
    answered = screened.withColumn("__answered", from_micros(epoch_micros(screened, "finished_at")))
    joined = asked.withWatermark("__asked", late).join(
        answered.withWatermark("__answered", late),
        (F.col(request_id) == F.col("__of")) & (F.col("__answered") >= F.col("__asked"))
        & (F.col("__answered") <= F.col("__asked") + F.expr(f"INTERVAL {patience}")), "left_outer")
    prompt = "prompt" if policy.include_prompt_in_audit else None
    return audit_rows(flows.settle(joined.drop("__of", "__asked", "__answered"), policy), request_id, prompt)


def append_stream(audit: DataFrame, path: str, checkpoint: str, **trigger):
    """Start appending events under ``path``, partitioned by day; exactly once through the file sink's log."""
    dated = audit.withColumn("dt", F.to_date("started_at"))
    return (dated.writeStream.format("parquet").outputMode("append").partitionBy("dt")
            .option("path", path).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
