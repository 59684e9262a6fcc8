import math
import random
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from parapet.operators import audit
from parapet.plans import flows
from parapet.plans.samples import POLICY
from parapet.policy import Policy, QuotaRule
from parapet.streaming import audit as stream_audit

REQUEST = ("request_id long, ts timestamp, prompt string, system_prompt string, user_id string, tenant_id string, "
           "application_id string, operation string, requested_provider string, requested_model string, max_tokens int, "
           "temperature double, metadata map<string,string>")
REPLY = ("request_id long, content string, prompt_tokens int, completion_tokens int, error string, "
         "finished_at timestamp")


@pytest.fixture(scope="module")
def tables(spark):
    t0 = datetime(2024, 1, 1)

    def request(i, prompt, provider=None, model=None):
        return (i, t0, prompt, None, "u", "t", "app-x", "chat", provider, model, 256, 0.0, {})

    asked = [request(1, "hello"), request(2, "jailbreak"), request(3, "hello", "azure", "gpt-large"),
             request(4, "hello", "openai", "m"), request(5, "mail a@b.org"), request(6, "hello"), request(7, "no reply")]
    replies = [(1, "hi a@b.org", 5, 6, None), (3, "from the fallback", 7, 8, "timeout"), (4, None, None, None, "timeout"),
               (5, "ok", 1, 1, None), (6, "here is the API_KEY", 1, 1, None), (2, "never", 9, 9, None)]
    finished = t0 + timedelta(microseconds=1_234_500)
    return (spark.createDataFrame(asked, REQUEST),
            spark.createDataFrame([(*r, finished) for r in replies], REPLY))


def test_flow(tables):
    requests, replies = tables
    policy = Policy.from_json(POLICY)
    rows = {r["request_id"]: r for r in flows.answer(flows.decide(requests, policy), replies, policy).collect()}
    assert (rows[1]["status"], rows[1]["content"], rows[1]["provider"]) == (200, "hi [REDACTED_EMAIL]", "openai")
    assert (rows[2]["status"], rows[2]["content"], rows[2]["provider"], rows[2]["prompt_tokens"]) == (422, "", "", 0)
    assert rows[2]["screen"] == "prompt-injection" and rows[2]["flags"] == []
    assert (rows[3]["provider"], rows[3]["model"], rows[3]["flags"]) == ("openai", "gpt-backup", ["fallback:azure->openai"])
    assert (rows[4]["status"], rows[4]["reason"]) == (422, "Gateway error: timeout")
    assert rows[5]["prompt"] == "mail [REDACTED_EMAIL]"
    assert rows[6]["reason"] == "Response blocked: contains forbidden content."
    assert (rows[7]["status"], rows[7]["reason"], rows[7]["content"]) == (422, "Gateway error: no reply", "")


def test_audit_rows(tables):
    requests, replies = tables
    rows = {r["request_id"]: r for r in flows.audit(requests, replies, Policy.from_json(POLICY)).collect()}
    assert len(rows) == 7 and rows[1]["latency_ms"] == 1234.5 and rows[1]["user_id"] == "u"
    assert all(len(r["correlation_id"]) == 32 for r in rows.values())
    assert rows[2]["blocked"] and rows[2]["block_reason"] == "Prompt injection attempt detected." and rows[2]["model"] == ""
    assert str(rows[1]["estimated_cost"]) == "0.000000" and rows[1]["error"] is None
    assert "prompt" not in rows[1].asDict()
    loud = Policy.from_json(POLICY.replace('"timeoutSeconds"', '"includePromptInAudit": true, "timeoutSeconds"'))
    kept = {r["request_id"]: r["prompt"] for r in flows.audit(requests, replies, loud).collect()}
    assert kept[5] == "mail [REDACTED_EMAIL]"  # the screened text, never the raw one


def test_calls_in_order(spark, tables):
    """First call, fallback, both failing, a disabled or silent fallback, no call at all."""
    requests, _ = tables
    policy = Policy.from_json(POLICY)
    ids = [r["request_id"] for r in flows.decide(requests, policy).filter("NOT blocked AND provider = 'azure'").collect()]
    others = [r["request_id"] for r in flows.decide(requests, policy).filter("NOT blocked AND provider = 'openai'").collect()]
    assert ids and others
    at = "2024-01-01 00:00:0%d"
    shape = "request_id long, attempt int, content string, prompt_tokens int, completion_tokens int, error string, finished_at string"

    def ended(*calls, own=ids[0]):
        rows = spark.createDataFrame([(own, *c) for c in calls], shape).withColumn("finished_at", F.to_timestamp_ntz("finished_at"))
        done = flows.answer(flows.decide(requests, policy), rows, policy).filter(F.col("request_id") == own).first()
        return done["reason"], done["provider"], done["content"], list(done["flags"]), done["prompt_tokens"]

    ok, bad = (1, "first", 3, 4, None, at % 1), (1, None, 0, 0, "down", at % 1)
    flag = ["fallback:azure->openai"]
    assert ended(ok) == (None, "azure", "first", [], 3)
    assert ended(bad, (2, "second", 5, 6, None, at % 2)) == (None, "openai", "second", flag, 5)
    assert ended(bad, (2, None, 0, 0, "also down", at % 2)) == ("Gateway error: also down", "", "", flag, 0)
    assert ended(bad) == ("Gateway error: no reply", "", "", flag, 0)
    assert ended((2, "second", 5, 6, None, at % 2)) == (None, "openai", "second", flag, 5)
    assert ended(bad, own=others[0]) == ("Gateway error: down", "", "", [], 0)
    assert ended((7, "stray", 1, 1, None, at % 1)) == ("Gateway error: no reply", "", "", [], 0)
    assert ended(bad, ok[:5] + (at % 0,)) == (None, "azure", "first", [], 3)  # of two rows for a call the first to finish


def test_calls_shuffle_no_texts(spark, tables):
    requests, replies = tables
    calls = replies.withColumn("attempt", F.lit(1))
    done = flows.answer(flows.decide(requests, Policy.from_json(POLICY)), calls, Policy.from_json(POLICY))

    def folded(df):
        return "min_by(content#" in df._jdf.queryExecution().executedPlan().toString()

    assert folded(done.select("content")) and not folded(flows.audit(requests, calls, Policy.from_json(POLICY)))


def test_quota_comes_first(tables):
    requests, replies = tables
    policy = Policy.from_json(POLICY.replace('"enabled": false, "rules": []',
                                             '"enabled": true, "rules": [{"scope": "user", "requestsPerMinute": 3}]'))
    rows = {r["request_id"]: r for r in flows.decide(requests, policy).collect()}
    assert [rows[i]["blocked"] for i in range(1, 8)] == [False, True, False, True, True, True, True]
    assert rows[5]["reason"] == "Gateway error: Rate limit exceeded for user: 3 requests/min"
    assert rows[5]["prompt"] == "mail a@b.org"  # not screened


def test_own_screens_join_the_chains(tables):
    from parapet.operators.screens import CustomScreen, blocked_if
    requests, replies = tables
    policy = Policy.from_json(POLICY)
    hello = CustomScreen("hello", 10, lambda t: blocked_if(t == "hello", "no hello"))
    ok = CustomScreen("ok", 10, lambda t: blocked_if(t == "ok", "no ok"))
    out = flows.answer(flows.decide(requests, policy, own=[hello]), replies, policy, own=[ok]).collect()
    assert {r["request_id"]: r["reason"] for r in out if r["request_id"] in (1, 2, 5)} == {
        1: "no hello", 2: "Prompt injection attempt detected.", 5: "no ok"}


def test_audit_shuffles_no_texts(spark, tables):
    requests, replies = tables
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = flows.audit(requests, replies, Policy.from_json(POLICY))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.split("\n")
    moved = [lines[i + 1] for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]
    assert len(moved) == 2 and not any("prompt#" in m or "content#" in m for m in moved)


def test_line(tables):
    requests, replies = tables
    events = flows.audit(requests.withColumn("tenant_id", F.lit(None).cast("string")), replies, Policy.from_json(POLICY))
    lines = {r["request_id"]: r["line"] for r in audit.audit_line(events).collect()}
    assert lines[3].startswith("AI_GATEWAY correlation=")
    assert lines[3].endswith(" user=u tenant=(null) provider=openai model=gpt-backup blocked=False promptTokens=7 "
                             "completionTokens=8 cost=0 latencyMs=1234.5 flags=fallback:azure->openai")


def test_correlation_ids(spark):
    df = spark.range(50)
    fresh = df.select(audit.correlation_id().alias("c"))
    assert {len(r["c"]) for r in fresh.collect()} == {32} and fresh.distinct().count() == 50
    same = df.select(audit.correlation_id(F.col("id")).alias("c"))
    assert same.collect() == same.collect()


def test_usage_rollup_is_exact(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.random() < 0.3, 10, 20, rng.random() * 500) for _ in range(999)]
    df = spark.createDataFrame(rows, "k string, blocked boolean, prompt_tokens int, completion_tokens int, latency_ms double")
    for r in audit.usage_rollup(df, ["k"]).collect():
        mine = sorted(int(x[4]) for x in rows if x[0] == r["k"])
        blocked = sum(x[1] for x in rows if x[0] == r["k"])
        assert (r["requests"], r["blocked"], r["prompt_tokens"]) == (len(mine), blocked, 10 * len(mine))
        assert r["p50_ms"] == mine[math.ceil(len(mine) * 0.5) - 1]
        assert r["p95_ms"] == mine[math.ceil(len(mine) * 0.95) - 1]
        assert r["block_rate"] == round(blocked / len(mine), 6)


def test_rates_per_minute_on_a_stream(spark, tmp_path):
    from parapet.streaming.audit import append_stream, block_rate_by_minute

    spark.sql("SELECT timestamp_seconds(1704067200 + id * 15) AS started_at, id % 4 = 0 AS blocked FROM range(200)") \
        .coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("started_at timestamp, blocked boolean").parquet(str(tmp_path / "in"))
    rates = block_rate_by_minute(stream)
    run = (rates.writeStream.format("parquet").option("path", str(tmp_path / "rates"))
           .option("checkpointLocation", str(tmp_path / "s1")).trigger(availableNow=True).start())
    run.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "rates")).collect()
    assert len(out) == 39 and {(r["requests"], r["blocked"], r["block_rate"]) for r in out} == {(4, 1, 0.25)}
    append_stream(stream, str(tmp_path / "audit"), str(tmp_path / "s2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "audit")).filter("dt = '2024-01-01'").count() == 200


def test_subtotals_are_exact(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), rng.choice(["x", None]), rng.random() < 0.3, 10, 20, rng.random() * 50) for _ in range(700)]
    df = spark.createDataFrame(rows, "k string, m string, blocked boolean, prompt_tokens int, completion_tokens int, latency_ms double")
    got = audit.usage_subtotals(df, ["k", "m"]).collect()
    want = {(level, *key) for level in range(3) for key in {(r[0] if level > 0 else None, r[1] if level > 1 else None) for r in rows}}
    assert {(r["level"], r["k"], r["m"]) for r in got} == want and len(got) == len(want)
    for r in got:
        mine = sorted(int(x[5]) for x in rows if (x[0], x[1])[:r["level"]] == (r["k"], r["m"])[:r["level"]])
        assert r["requests"] == len(mine) and r["prompt_tokens"] == 10 * len(mine)
        assert (r["p50_ms"], r["p95_ms"]) == tuple(mine[math.ceil(len(mine) * p) - 1] for p in (0.5, 0.95))


def test_reruns_add_nothing(spark, tmp_path):
    from parapet.sources.audit_table import append_once, read_audit, write_run

    def events(n, days):
        return spark.sql(f"SELECT id, timestamp_seconds(1704067200 + id % {days} * 86400) AS started_at, 'x' AS run FROM range({n})")

    path = str(tmp_path / "audit")
    write_run(events(30, 3), path, "a")
    write_run(events(10, 1), path, "b")
    for _ in range(2):
        write_run(events(20, 2), path, "a")  # the rerun has a day less: the old one goes
    assert sorted((r["run"], str(r["dt"]), r["n"]) for r in read_audit(spark, path).groupBy("run", "dt").agg(F.count("*").alias("n")).collect()) \
        == [("a", "2024-01-01", 10), ("a", "2024-01-02", 10), ("b", "2024-01-01", 10)]
    for bad in ("", "a/b", "..", "x=y"):
        with pytest.raises(ValueError):
            write_run(events(1, 1), path, bad)
    events(40, 2).drop("run").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, started_at timestamp").parquet(str(tmp_path / "in"))
    for checkpoint in ("c1", "c2"):  # the second starts over and repeats the batch
        append_once(stream, str(tmp_path / "once"), str(tmp_path / checkpoint)).awaitTermination()
    assert read_audit(spark, str(tmp_path / "once")).count() == 40


def test_audit_stream_meets_replies_across_runs(spark, tmp_path):
    policy = Policy.from_json(POLICY)
    at = lambda minute: datetime(2024, 1, 1) + timedelta(minutes=minute)
    asked = lambda i, minute, prompt="hi": (i, at(minute), prompt, None, "u", "t", "a", "chat", None, None, 9, 0.0, {})
    said = lambda i, minute: (i, "fine", 1, 2, None, at(minute))
    rounds = [([asked(1, 0), asked(2, 1), asked(3, 2), asked(4, 3, None), asked(None, 3)], [said(1, 1), said(9, 2), said(None, 2)]),
              ([asked(None, 500)], [said(2, 31), said(3, 33), said(4, 3), said(-1, 500)])]
    got = []
    for requests, replies in rounds:
        spark.createDataFrame(requests, REQUEST).write.mode("append").parquet(f"{tmp_path}/requests")
        spark.createDataFrame(replies, REPLY).write.mode("append").parquet(f"{tmp_path}/replies")
        events = stream_audit.audit_stream(
            spark.readStream.schema(REQUEST).parquet(f"{tmp_path}/requests"),
            spark.readStream.schema(REPLY).parquet(f"{tmp_path}/replies"), policy, patience="30 minutes")
        stream_audit.append_stream(events, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        rows = spark.read.parquet(f"{tmp_path}/out").collect()
        got.append({r["request_id"]: (r["blocked"], r["latency_ms"]) for r in rows})
        assert len(rows) == len(got[-1])
    assert got[0] == {1: (False, 60_000.0)}  # the others may still be answered
    assert got[1] == {1: (False, 60_000.0), 2: (False, 1_800_000.0), 3: (True, None), 4: (False, 0.0), None: (True, None)}


def test_audit_stream_refuses_quotas(spark):
    policy = replace(Policy.from_json(POLICY), quotas_enabled=True, quota_rules=(QuotaRule("user", 5),))
    with pytest.raises(ValueError, match="quotas"):
        stream_audit.audit_stream(spark.range(1), spark.range(1), policy)
