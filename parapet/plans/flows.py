"""The two request flows as jobs: normalized requests with routing and audit, and chat bodies passed on.

A flow is one lazy DataFrame. Screening and routing are projections; only quotas and the join with the replies shuffle.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, functions as F

from parapet.functions import fixed
from parapet.operators import quota, routing
from parapet.operators.audit import audit_rows, outcome
from parapet.operators.chain import run_chain
from parapet.operators.screens import Screen
from parapet.policy import Policy
from parapet.sources.chat import completion_content, completion_rebuilt, screen_bodies, screen_bodies_apart


def decide(requests: DataFrame, policy: Policy, ts: str = "ts", request_id: str = "request_id",
           own: Sequence[Screen] = ()) -> DataFrame:
    """Quota, input chain (with a user's ``own`` screens) and route.

    Adds ``blocked``, ``screen``, ``reason``, ``provider``, ``model``, ``route_rule``; ``prompt`` is the screened prompt. A
    request denied by a quota is not screened.
    """
    prior = None
    if policy.quotas_enabled and policy.quota_rules:
        requests = quota.replay_rules(requests, policy.quota_rules, ts, request_id)
        prior = F.col("deny_reason")
    screened = run_chain(requests, [*policy.input_screens(), *own], text="prompt", prior_reason=prior)
    return routing.route(screened, policy)


_REPLY = ("content", "prompt_tokens", "completion_tokens", "error", "finished_at", "__reply_screen", "__reply_reason",
          "__replied")


def fold_attempts(attempts: DataFrame, request_id: str = "request_id") -> DataFrame:
    """One row per request from a table of calls: the first call's columns, and those of the second named ``__next_*``.

    ``attempt`` is 1 for the call to the routed provider and 2 for the call to its fallback; the gateway makes no others, so
    other numbers are left out. Of several rows for one call the first to finish counts (ties: by error, tokens and
    text). Every column is folded by itself, so a column nobody reads, such as a long text, is not shuffled.
    """
    order = F.struct("finished_at", "error", "prompt_tokens", "completion_tokens", F.xxhash64("content"))
    return attempts.filter("attempt IN (1, 2)").groupBy(request_id).agg(*[
        F.min_by(name, F.when(F.col("attempt") == k, order)).alias(prefix + name)
        for k, prefix in ((1, ""), (2, "__next_")) for name in _REPLY])


def screened_replies(replies: DataFrame, policy: Policy, own: Sequence[Screen] = ()) -> DataFrame:
    """Replies after the output chain, ready to be joined with their requests and settled."""
    return run_chain(replies, [*policy.output_screens(), *own], text="content").withColumnsRenamed(
        {"screen": "__reply_screen", "reason": "__reply_reason"}).drop("blocked").withColumn("__replied", F.lit(True))


def answer(decided: DataFrame, replies: DataFrame, policy: Policy, request_id: str = "request_id",
           own: Sequence[Screen] = ()) -> DataFrame:
    """Join the providers' replies, take fallbacks, apply the output chain, and give one outcome per request.

    ``replies``: request id, ``content``, ``prompt_tokens``, ``completion_tokens``, ``error`` (null if the first call
    went well), ``finished_at``. With a column ``attempt`` the table has a row per call instead (see ``fold_attempts``),
    each with its own error: a fallback's call can then fail too, and its error ends the request. Without it a reply
    beside an error is the fallback's. Ids are unique on both sides, so the join has no hot key. Replies are screened
    before the join: where only verdicts and counts are asked for, no text is shuffled.
    """
    screened = screened_replies(replies, policy, own)
    calls = "attempt" in replies.columns
    return settle(decided.join(fold_attempts(screened, request_id) if calls else screened, request_id, "left"), policy, calls)


def settle(joined: DataFrame, policy: Policy, calls: bool = False) -> DataFrame:
    """The outcome of decided requests beside their replies (null columns where there is none); see ``answer``."""
    none, silent = F.lit(None).cast("string"), F.lit("no reply")
    next_replied, next_error = (F.col("__next___replied"), F.col("__next_error")) if calls else (F.col("__replied"), none)
    # a disabled provider cannot be called: that is a failed call, of the fallback's too
    off = routing.is_disabled(F.col("provider"), policy)
    unknown = F.concat(F.lit("AI provider '"), F.col("provider"), F.lit("' is not registered."))
    skipped = F.col("__replied").isNull() & next_replied.isNotNull()
    called = joined.withColumn("error", F.when(off, unknown).when(skipped, silent).otherwise(F.col("error")))
    failed = called.withColumn("failed", (~F.col("blocked")) & F.col("error").isNotNull())
    routed = routing.apply_fallback(failed, policy)
    fell = F.col("used_fallback")
    # what ends the request: the fallback's failure, a failure without a fallback, or no reply to a request that went out
    last = F.when(fell & off, unknown).when(fell & next_replied.isNull(), silent).when(fell, next_error).when(
        F.col("unresolved"), F.col("error")).when(F.col("__replied").isNull() & F.col("reason").isNull(), silent)
    routed = routed.withColumn("__last", last)
    out = routed.withColumns({"__prior": F.coalesce(F.col("reason"), F.concat(F.lit(fixed.REASON_ERROR), F.col("__last"))),
                              "error": F.coalesce("__last", "error")})
    if calls:
        out = out.withColumns({name: F.when(fell, F.col(f"__next_{name}")).otherwise(F.col(name)) for name in _REPLY if name != "error"})
    out = out.withColumns({
        "screen": F.when(F.col("__prior").isNull(), F.col("__reply_screen")).otherwise(F.col("screen")),
        "reason": F.coalesce("__prior", "__reply_reason"), "estimated_cost": F.lit(0)})
    out = out.withColumn("blocked", F.col("reason").isNotNull())
    hidden = ("__prior", "__last", "__reply_screen", "__reply_reason", "__replied", "failed", "unresolved",
              *(f"__next_{name}" for name in _REPLY if calls))
    return outcome(out.drop(*hidden))


def audit(requests: DataFrame, replies: DataFrame, policy: Policy, request_id: str = "request_id") -> DataFrame:
    """The audit table of a set of requests and replies."""
    done = answer(decide(requests, policy, request_id=request_id), replies, policy, request_id)
    prompt = "prompt" if policy.include_prompt_in_audit else None
    return audit_rows(done.withColumn("started_at", F.col("ts")), request_id, prompt)


def pass_on(bodies: DataFrame, policy: Policy, body: str = "body", own: Sequence[Screen] = (),
            keys: Sequence[str] = ()) -> DataFrame:
    """Screen chat bodies on their way to a provider: ``blocked``, ``reason``, ``screened_body``.

    With ``keys`` (columns that name a row) the parts are screened as rows of their own, which ``own`` screens made of
    Pandas UDFs need; without, bodies stay whole.
    """
    screens = [*policy.input_screens(), *own]
    return screen_bodies_apart(bodies, body, keys, screens) if keys else screen_bodies(bodies, body, screens)


def pass_back(replies: DataFrame, policy: Policy, body: str = "reply", own: Sequence[Screen] = ()) -> DataFrame:
    """Screen completion bodies on their way back: ``content`` (rewritten where needed), ``blocked``, ``reason``."""
    opened = replies.withColumn("content", completion_content(F.col(body)))
    return run_chain(opened, [*policy.output_screens(), *own], "content")


def return_bodies(replies: DataFrame, policy: Policy, body: str = "reply", own: Sequence[Screen] = (),
                  rewrite: bool = True) -> DataFrame:
    """Completion bodies as a caller gets them: adds ``status``, ``blocked``, ``reason`` and ``returned_body``.

    A blocked reply becomes a short JSON notice with status 422. A body whose text a screen rewrote gets that text in its
    place, everything else as it was; without ``rewrite`` screens only block and bodies pass as they are. Bodies without
    text (or that are no JSON) pass untouched. One narrow projection; the values leave through a generator, so that a
    filter on them does not repeat the screens.
    """
    added = ["status", "blocked", "reason", "returned_body"]
    opened = replies.withColumn("__said", completion_content(F.col(body)))
    done = run_chain(opened.withColumn("__content", F.col("__said")), [*policy.output_screens(), *own], "__content")
    notice = F.to_json(F.struct(F.lit(True).alias("blocked"), F.coalesce("reason", F.lit(fixed.REASON_OUTPUT)).alias("blockReason")))
    changed = F.coalesce(F.col("__said") != F.col("__content"), F.lit(False)) if rewrite else F.lit(False)
    done = done.withColumns({
        "status": F.when(F.col("blocked"), fixed.STATUS_BLOCKED).otherwise(fixed.STATUS_OK),
        "returned_body": F.when(F.col("blocked"), notice).when(changed, completion_rebuilt(F.col(body), F.col("__content")))
        .otherwise(F.col(body))})
    kept = [c for c in replies.columns if c not in added]
    return done.select(*kept, F.inline(F.array(F.struct(*added))))
