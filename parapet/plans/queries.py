"""The registered queries: one per operator, all over the given tables."""

from __future__ import annotations

from dataclasses import replace
from functools import lru_cache
from typing import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from parapet.functions.clock import epoch_micros
from parapet.operators import audit as audits, blocktable, chain, pii, quota, reports, risk, routing, screens, spans
from parapet.plans import flows, inputs
from parapet.plans.samples import (CUSTOM_NAME, CUSTOM_PATTERN, CUSTOM_TAG, FLOW_LIMITS, MARKUP_PATTERNS, POLICY,
                                   PATIENCE, QUOTA_LIMIT, QUOTA_SECONDS, SHARED_LIMITS, TENANT_LIMIT)
from parapet.policy import Condition, Policy, QuotaRule, RouteRule
from parapet.sources import audit_table as audit_files, chat, requests as bodies_io
from parapet.sources.session import new_folder
from parapet.streaming import audit as stream_audit, quota as stream_quota

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}
#: Rows of a file of events that arrive, at least, where a part of them is written as several.
ARRIVAL_ROWS = 100_000


def query(build: Query) -> Query:
    _REGISTRY[build.__name__] = build
    return build


def registered() -> dict[str, Query]:
    return dict(_REGISTRY)


@lru_cache
def policy() -> Policy:
    return Policy.from_json(POLICY)


def _verdict(df: DataFrame, *keys: str, text: str | None = None) -> DataFrame:
    shown = [F.md5(F.col(text)).alias("text_md5")] if text else []
    return df.select(*keys, "blocked", "screen", "reason", *shown)


def _us(name: str, out: str | None = None):
    return F.unix_micros(F.col(name).cast("timestamp")).alias(out or f"{name}_us")


# --- sources -------------------------------------------------------------------------------------------------------

@query
def chat_explode(spark, sf):
    return chat.explode_chat(inputs.bodies(spark, sf), "body", ["doc_id"])


@query
def chat_rebuild(spark, sf):
    """Bodies with personal data redacted in place, read back message by message with their untouched fields."""
    done = chat.screen_bodies(inputs.bodies(spark, sf), "body", [pii.Pii()])
    shape = "model string, max_tokens bigint, prompt string, messages array<struct<role:string,content:string,name:string>>"
    opened = done.select("doc_id", "parts", F.from_json("screened_body", shape).alias("b"),
                         F.md5(F.when(F.col("parts") == 0, F.col("screened_body"))).alias("whole_md5"))
    return opened.select(
        "doc_id", F.col("parts").cast("bigint").alias("parts"), "b.model", "b.max_tokens",
        F.md5("b.prompt").alias("prompt_md5"), "whole_md5",
        F.array_join(F.transform("b.messages", lambda m: F.concat_ws("|", m["role"], F.md5(m["content"]), m["name"])),
                     ",").alias("messages"))


@query
def body_screen(spark, sf):
    out = flows.pass_on(inputs.bodies(spark, sf), policy())
    return out.select("doc_id", F.col("parts").cast("bigint").alias("parts"), "blocked", "reason")


@query
def parts_rebuild(spark, sf):
    parts = chat.explode_chat(inputs.bodies(spark, sf), "body", ["doc_id"])
    out = chat.rebuild_chat(pii.redact(parts, "text"), ["doc_id"])
    messages = F.from_json("body", "messages array<struct<role:string,content:string>>")["messages"]
    return out.select("doc_id", F.array_join(F.transform(
        messages, lambda m: F.concat_ws("|", m["role"], F.md5(m["content"]))), ",").alias("messages"))


@query
def completion_extract(spark, sf):
    return chat.extract_completion(inputs.completions(spark, sf), "reply").select("doc_id", "content")


@query
def usage_extract(spark, sf):
    return chat.extract_usage(inputs.completions(spark, sf), "reply").select(
        "doc_id", "prompt_tokens", "completion_tokens")


@query
def request_normalize(spark, sf):
    made = inputs.requests(spark, sf).select("request_id", F.to_json(F.struct(
        F.col("prompt").alias("Prompt"), F.col("user_id").alias("userId"), F.col("tenant_id").alias("TENANTID"),
        F.col("max_tokens").alias("maxTokens"), F.col("temperature").alias("Temperature"),
        F.col("metadata").alias("metadata"))).alias("body"))
    return bodies_io.read_requests(made, "body").select(
        "request_id", "valid", "operation", F.md5("prompt").alias("prompt_md5"), "system_prompt", "user_id",
        "tenant_id", "max_tokens", "temperature", F.col("metadata")["priority"].alias("priority"))


@query
def payload_build(spark, sf):
    df = routing.route(inputs.requests(spark, sf), policy())
    made = [F.struct(F.lit(flavor).alias("flavor"), F.md5(bodies_io.payload(flavor)).alias("payload_md5"))
            for flavor in ("openai", "azure-openai", "ollama")]
    return df.select("request_id", F.inline(F.array(*made)))


# --- screens -------------------------------------------------------------------------------------------------------

@query
def screen_max_length(spark, sf):
    return _verdict(screens.screen(inputs.prompts(spark, sf), screens.MaxLength(4000), "prompt"), "doc_id")


@query
def screen_injection(spark, sf):
    return _verdict(screens.screen(inputs.prompts(spark, sf), screens.Injection(), "prompt"), "doc_id")


@query
def screen_blocklist(spark, sf):
    pages = chain.spread(inputs.table(spark, sf, "pages"))
    return _verdict(screens.screen(pages, screens.Blocklist(MARKUP_PATTERNS), "html"), "page_id")


@query
def screen_blocklist_table(spark, sf):
    """A blocklist that grows with the data: stretches of every fifth document, and short entries."""
    return _verdict(blocktable.screen_by_table(inputs.prompts(spark, sf), ["doc_id"], "prompt", inputs.listed(spark, sf), "entry"),
                    "doc_id")


@query
def risk_scores(spark, sf):
    return risk.risk_scores(inputs.prompts(spark, sf), "prompt", ["doc_id"])


@query
def risk_block(spark, sf):
    return _verdict(screens.screen(inputs.prompts(spark, sf), risk.Risk(thresholds={"hate": 0.6}), "prompt"), "doc_id")


@query
def risk_flags(spark, sf):
    out = screens.screen(inputs.prompts(spark, sf), risk.Risk("flag", 0.3), "prompt")
    return out.select("doc_id", "blocked", F.array_join("semantic_flags", ",").alias("flags"),
                      F.size("semantic_scores").cast("bigint").alias("scored"),
                      F.col("semantic_scores")["violence"].alias("violence"))


@query
def pii_redact(spark, sf):
    return pii.redact(inputs.prompts(spark, sf), "prompt").select("doc_id", "prompt")


@query
def pii_redact_all(spark, sf):
    return pii.redact(inputs.prompts(spark, sf), "prompt", pii.ALL_OPTIONS).select("doc_id", "prompt")


@query
def pii_specific(spark, sf):
    """All detectors on the original text, specific ones first."""
    return spans.redact_specific(inputs.prompts(spark, sf), "prompt", pii.ALL_OPTIONS).select("doc_id", "prompt")


@query
def pii_spans(spark, sf):
    return spans.find_spans(inputs.prompts(spark, sf), "prompt", ["doc_id"], pii.ALL_OPTIONS).select(
        "doc_id", "type", F.col("start").cast("bigint").alias("start"), F.col("stop").cast("bigint").alias("stop"))


@query
def pii_findings(spark, sf):
    return pii.findings(inputs.prompts(spark, sf), "prompt", ["doc_id"], pii.ALL_OPTIONS).select(
        "doc_id", "type", F.col("n").cast("bigint").alias("n"))


@query
def pii_report(spark, sf):
    return pii.findings_report(pii.findings(inputs.prompts(spark, sf), "prompt", ["doc_id"]))


@query
def pii_block(spark, sf):
    return _verdict(screens.screen(inputs.prompts(spark, sf), pii.Pii("block"), "prompt"), "doc_id", text="prompt")


@query
def pii_custom(spark, sf):
    custom = [pii.CustomPattern(CUSTOM_NAME, CUSTOM_PATTERN, CUSTOM_TAG)]
    return pii.redact(inputs.prompts(spark, sf), "prompt", {"detectPhones": False}, custom).select(
        "doc_id", F.md5("prompt").alias("text_md5"))


@query
def secret_scan(spark, sf):
    return screens.secret_findings(inputs.prompts(spark, sf), "prompt", ["doc_id"]).select(
        "doc_id", "kind", F.col("n").cast("bigint").alias("n"))


@query
def custom_screen(spark, sf):
    """A user's own screen after the built-in ones: no license talk, and tabs become blanks."""
    own = screens.CustomScreen("license-talk", 260,
                               lambda text: screens.blocked_if(F.contains(F.lower(text), F.lit("licen"))),
                               lambda text: F.replace(text, F.lit("\n"), F.lit(" ")))
    out = chain.run_chain(inputs.prompts(spark, sf), [own, screens.Injection()], "prompt")
    return _verdict(out, "doc_id", text="prompt")


def _rich_in_e(texts: pd.Series) -> pd.Series:
    """Block texts that are rich in the letter e: a stand-in for a user's model, scored in batches."""
    share = 100 * texts.str.count("e") / texts.str.len().clip(lower=1)
    return pd.Series([f"score {s // 1:.0f}" if s >= 14 else None for s in share], dtype=object)


@query
def custom_scorer(spark, sf):
    """A user's scorer, a Pandas UDF, over the messages of chat bodies after the policy's own screens."""
    score = F.pandas_udf(_rich_in_e, "string")
    scorer = screens.CustomScreen("scorer", 400, lambda text: score(text))
    out = flows.pass_on(inputs.bodies(spark, sf), policy(), own=[scorer], keys=["doc_id"])
    return out.select("doc_id", F.col("parts").cast("bigint").alias("parts"), "blocked", "reason")


# --- chains --------------------------------------------------------------------------------------------------------

@query
def screen_chain(spark, sf):
    out = chain.run_chain(inputs.prompts(spark, sf), policy().input_screens(), "prompt")
    return _verdict(out, "doc_id", text="prompt")


@query
def conversation_verdict(spark, sf):
    parts = inputs.turns(spark, sf).filter(F.col("role").isin(*chat.SCREENED_ROLES))
    out = chain.run_chain(parts, policy().input_screens(), "text")
    return chain.fold_parts(out, ["conv_id"], "turn")


@query
def screen_response_blocklist(spark, sf):
    blocklist = [s for s in policy().output_screens() if isinstance(s, screens.Blocklist)][0]
    return _verdict(screens.screen(inputs.answers(spark, sf), blocklist, "content"), "conv_id", "turn")


@query
def response_redact(spark, sf):
    return screens.screen(inputs.answers(spark, sf), pii.ResponsePii(), "content").select("conv_id", "turn", "content")


@query
def response_chain(spark, sf):
    out = chain.run_chain(inputs.answers(spark, sf), policy().output_screens(), "content")
    return _verdict(out, "conv_id", "turn", text="content")


@query
def reply_screen(spark, sf):
    return _verdict(flows.pass_back(inputs.completions(spark, sf), policy()), "doc_id", text="content")


@query
def reply_rebuild(spark, sf):
    """Completion bodies as they go back: notices, redacted texts in place, and bodies left alone."""
    done = flows.return_bodies(inputs.completions(spark, sf), policy()).withColumn(
        "same", F.col("returned_body") == F.col("reply"))
    inside = F.when(~F.col("same"), F.col("returned_body"))
    return done.select(
        "doc_id", F.col("status").cast("bigint").alias("status"), "blocked", "same",
        F.get_json_object(inside, "$.blockReason").alias("block_reason"),
        F.get_json_object(inside, "$.choices[0].message.role").alias("role"),
        F.md5(F.get_json_object(inside, "$.choices[0].message.content")).alias("content_md5"),
        F.get_json_object(inside, "$.usage.prompt_tokens").alias("prompt_tokens"))


def _screened(spark, sf):
    d = inputs.prompts(spark, sf).withColumn("original", F.col("prompt"))
    return chain.run_chain(d, policy().input_screens(), "prompt")


@query
def screen_report(spark, sf):
    return reports.screen_report(_screened(spark, sf), "original", "prompt", ["source", "lang"])


@query
def block_reasons(spark, sf):
    return reports.block_reasons(_screened(spark, sf))


# --- routing -------------------------------------------------------------------------------------------------------

CONDITIONS = {
    "eq_text": Condition("tenantId", "eq", "SRC1"), "eq_number": Condition("maxTokens", "eq", 156),
    "eq_null": Condition("userId", "eq", ""), "neq_null": Condition("requestedModel", "neq", "gpt-large"),
    "neq_double": Condition("temperature", "neq", 1), "gt_length": Condition("prompt.length", "gt", 1000),
    "gte_meta": Condition("metadata.size", "gte", 500.5), "lt_null": Condition("maxTokens", "lt", 100),
    "lte_double": Condition("Temperature", "lte", 0.5), "contains": Condition("applicationId", "contains", "P-E"),
    "startswith": Condition("userId", "startsWith", "U1"), "exists": Condition("metadata.priority", "exists", True),
    "exists_case": Condition("metadata.Priority", "exists", True), "unknown_op": Condition("tenantId", "regex", ".*"),
    "unknown_field": Condition("systemPrompt", "exists", True), "operation": Condition("OPERATION", "eq", "Summarize"),
}


@query
def route_conditions(spark, sf):
    r = inputs.requests(spark, sf)
    return r.select("request_id", *[routing.matches(r, c).alias(name) for name, c in CONDITIONS.items()])


@query
def route_requests(spark, sf):
    return routing.route(inputs.requests(spark, sf), policy()).select("request_id", "provider", "model", "route_rule")


def _called(spark, sf):
    r = routing.route(inputs.requests(spark, sf), policy())
    return routing.apply_fallback(r.withColumn("failed", F.col("request_id") % 9 == 0), policy())


@query
def route_fallback(spark, sf):
    return _called(spark, sf).select("request_id", "provider", "model", "used_fallback", "unresolved",
                                     F.array_join("flags", ",").alias("flags"))


@query
def route_deployment(spark, sf):
    r = _called(spark, sf)
    return r.select("request_id", "provider", routing.deployment(F.col("provider"), F.col("model"), policy())
                    .alias("deployment"))


@query
def route_flags(spark, sf):
    """Rules on what the risk screen flagged, before those of the policy."""
    flagged = screens.screen(inputs.requests(spark, sf), risk.Risk("flag", 0.3), "prompt")
    own = (RouteRule("violent", "azure", "gpt-large", (Condition("metadata.semantic_flags", "contains", "VIOLENCE:"),)),
           RouteRule("flagged", "local", "tiny", (Condition("metadata.semantic_flags", "exists", True),)))
    routed = routing.route(flagged, replace(policy(), rules=(*own, *policy().rules)))
    return routed.select("request_id", "provider", "model", "route_rule")


@query
def route_report(spark, sf):
    return routing.route_report(routing.route(inputs.requests(spark, sf), policy()))


# --- quotas --------------------------------------------------------------------------------------------------------

@query
def quota_keys(spark, sf):
    return inputs.requests(spark, sf).select("request_id", *[
        quota.scope_key(s).alias(f"{s}_key") for s in ("user", "tenant", "application", "other")])


@query
def quota_replay(spark, sf):
    out = quota.replay(inputs.quota_events(spark, sf), quota.scope_key("user"), "ts", "request_id", QUOTA_LIMIT,
                       QUOTA_SECONDS)
    return out.select("request_id", "quota_key", _us("window_start"), "n", "denied")


@query
def quota_global(spark, sf):
    """One counter for all events: the hottest key there can be, and a run that hardly pauses."""
    out = quota.replay(inputs.quota_events(spark, sf), quota.scope_key("other"), "ts", "request_id", QUOTA_LIMIT,
                       QUOTA_SECONDS)
    return out.select("request_id", "quota_key", _us("window_start"), "n", "denied")


@query
def quota_multi(spark, sf):
    rules = [QuotaRule("user", QUOTA_LIMIT), QuotaRule("user", None), QuotaRule("tenant", TENANT_LIMIT)]
    return quota.replay_rules(inputs.quota_events(spark, sf), rules, "ts", "request_id", QUOTA_SECONDS).select(
        "request_id", "denied", "denied_by", "deny_reason")


@query
def quota_shared(spark, sf):
    """Limits that share counters: two on users, the tighter one behind, and three on tenants."""
    rules = [QuotaRule(scope, limit) for scope, limit in SHARED_LIMITS]
    return quota.replay_rules(inputs.quota_events(spark, sf), rules, "ts", "request_id", QUOTA_SECONDS).select(
        "request_id", "denied", "denied_by", "deny_reason")


@query
def usage_budget(spark, sf):
    cost, tokens = F.col("value").cast("decimal(18,6)"), F.length("props").cast("bigint")
    out = quota.usage_budget(inputs.quota_events(spark, sf), quota.scope_key("tenant"), "ts", "request_id", cost,
                             tokens, 5000)
    return out.select("request_id", "quota_key", "month", F.col("spent").cast("double").alias("spent"), "tokens_used",
                      "over_budget")


@query
def quota_stream(spark, sf):
    """The streaming counter over the events file, run to its end; results go through a file sink."""
    events = inputs.table(spark, sf, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    counted = stream_quota.stream_quota(stream, quota.scope_key("user"), "ts", "event_id", QUOTA_LIMIT, QUOTA_SECONDS)
    return _run_once(spark, counted.select("request_id", "quota_key", _us("window_start"), "n", "denied"))


@query
def quota_stream_ordered(spark, sf):
    """The streaming counter that waits for the watermark, over events that arrive in eight parts, two a trigger."""
    events, folder = inputs.table(spark, sf, "events"), new_folder(spark, "arrivals")
    us = epoch_micros(events, "ts")
    first, last = events.agg(F.min(us), F.max(us)).first()
    step = (last - first) // 8 + 1
    sizes = {r["part"]: r["count"] for r in events.groupBy(F.floor((us - first) / step).alias("part")).count().collect()}
    # every part has as many files, none of them empty: a trigger then takes whole parts
    files = max(1, min(sizes.get(i, 0) for i in range(8)) // ARRIVAL_ROWS)
    for i in range(8):  # one after the other: a file source takes files by age
        own = events.filter((us >= first + i * step) & (us < first + (i + 1) * step))
        own.repartition(files).write.mode("append").parquet(folder)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2 * files).parquet(folder)
        counted = stream_quota.stream_quota_in_order(stream, quota.scope_key("user"), "ts", "event_id", QUOTA_LIMIT, QUOTA_SECONDS,
                                                     slice_seconds=QUOTA_SECONDS)
        return _run_once(spark, counted.select("request_id", "quota_key", _us("window_start"), "n", "denied"))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def _run_once(spark: SparkSession, stream: DataFrame, folder: str | None = None) -> DataFrame:
    folder = folder or new_folder(spark, "stream")
    running = (stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out")
               .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


# --- audit ---------------------------------------------------------------------------------------------------------

def _audit(spark, sf):
    return flows.audit(inputs.requests(spark, sf), inputs.replies(spark, sf), policy())


@query
def audit_build(spark, sf):
    a = _audit(spark, sf)
    return a.select("request_id", "correlation_id", "user_id", "tenant_id", "application_id", "provider", "model",
                    "prompt_tokens", "completion_tokens", F.col("estimated_cost").cast("double").alias("cost"),
                    "blocked", "block_reason", F.array_join("flags", ",").alias("flags"), "error",
                    epoch_micros(a, "started_at").alias("started_at_us"),
                    epoch_micros(a, "finished_at").alias("finished_at_us"), "latency_ms")


@query
def route_attempts(spark, sf):
    """First calls, fallbacks, and both failing: where each request ended."""
    done = flows.answer(flows.decide(inputs.requests(spark, sf), policy()), inputs.attempts(spark, sf), policy())
    return done.select("request_id", "provider", "model", "used_fallback", "blocked", "reason", "prompt_tokens",
                       F.array_join("flags", ",").alias("flags"), F.md5("content").alias("content_md5"))


@query
def audit_full(spark, sf):
    """Quotas, screens, routes, calls with failing fallbacks, reply screens and audit in one flow."""
    strict = replace(policy(), quotas_enabled=True, quota_rules=tuple(QuotaRule(s, n) for s, n in FLOW_LIMITS))
    a = flows.audit(inputs.requests(spark, sf), inputs.attempts(spark, sf), strict)
    return a.select("request_id", "correlation_id", "user_id", "provider", "model", "prompt_tokens", "completion_tokens",
                    "blocked", "block_reason", F.array_join("flags", ",").alias("flags"),
                    epoch_micros(a, "finished_at").alias("finished_at_us"), "latency_ms")


@query
def audit_table(spark, sf):
    """The audit events written to a new table, read back and counted by its days."""
    folder = new_folder(spark, "audit")
    audit_files.write_audit(_audit(spark, sf), folder, policy())
    return audit_files.read_audit(spark, folder).groupBy(F.date_format("dt", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("requests"), F.count_if("blocked").alias("blocked"),
        F.sum("prompt_tokens").alias("prompt_tokens"))


@query
def outcome_rows(spark, sf):
    done = flows.answer(flows.decide(inputs.requests(spark, sf), policy()), inputs.replies(spark, sf), policy())
    return done.select("request_id", "status", "blocked", "screen", F.md5("content").alias("content_md5"))


@query
def audit_lines(spark, sf):
    return audits.audit_line(_audit(spark, sf)).select("request_id", "line")


@query
def usage_rollup(spark, sf):
    return audits.usage_rollup(_audit(spark, sf).withColumn("day", F.date_format("started_at", "yyyy-MM-dd")),
                               ["tenant_id", "provider", "model", "day"])


@query
def usage_subtotals(spark, sf):
    done = _audit(spark, sf).withColumn("day", F.date_format("started_at", "yyyy-MM-dd"))
    return audits.usage_subtotals(done, ["tenant_id", "provider", "day"])


@query
def audit_rerun(spark, sf):
    """Two runs written to a new table, the first of them twice; counted by run and day."""
    folder, done = new_folder(spark, "audit"), _audit(spark, sf)
    for run, half in (("even", 0), ("odd", 1), ("even", 0)):
        audit_files.write_run(done.filter(F.col("request_id") % 2 == half), folder, run, policy())
    return audit_files.read_audit(spark, folder).groupBy("run", F.date_format("dt", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("requests"), F.sum("completion_tokens").alias("completion_tokens"))


@query
def audit_stream(spark, sf):
    """Audit events on a stream that is stopped and started again. Replies arrive after their requests, some too late, and
    some requests get none. Rows of no request, a day later, move the watermark on at the end."""
    folder = new_folder(spark, "arrivals")
    requests, replies = inputs.requests(spark, sf), inputs.replies(spark, sf)
    last = requests.agg(F.max("request_id")).first()[0] or 0
    marks = {name: rows.filter(F.col("request_id") == last).withColumns(
        {"request_id": F.lit(number).cast("bigint"), at: F.col(at) + F.expr("INTERVAL 1 DAY")})
        for name, rows, at, number in (("requests", requests, "ts", None), ("replies", replies, "finished_at", -1))}
    replies = replies.filter("request_id % 29 <> 5")
    for start in (True, False):
        for name, rows, cut in (("requests", requests, last // 2), ("replies", replies, last // 2 - 5)):
            own = rows.filter(F.col("request_id") <= cut) if start else rows.filter(F.col("request_id") > cut).unionByName(marks[name])
            own.write.mode("append").parquet(f"{folder}/{name}")
        arriving = [spark.readStream.schema(rows.schema).parquet(f"{folder}/{name}")
                    for name, rows in (("requests", requests), ("replies", replies))]
        events = stream_audit.audit_stream(*arriving, policy(), patience=PATIENCE)
        out = _run_once(spark, events.select(
            "request_id", "correlation_id", "user_id", "provider", "model", "prompt_tokens", "completion_tokens", "blocked",
            "block_reason", F.array_join("flags", ",").alias("flags"), epoch_micros(events, "finished_at").alias("finished_at_us"),
            "latency_ms"), folder)
    return out


@query
def audit_minutes(spark, sf):
    """Block rate per minute on a stream: an event counts as blocked where it is an error."""
    events = inputs.table(spark, sf, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    rates = stream_audit.block_rate_by_minute(stream.withColumn("blocked", F.col("event_type") == "error"), "ts")
    return _run_once(spark, rates.select(_us("minute"), "requests", "blocked", "block_rate"))
