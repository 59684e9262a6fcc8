import json

import pytest
from pyspark.sql import functions as F

from parapet.operators import routing
from parapet.policy import Condition, Fallback, Policy, PolicyError, Provider, RouteRule

SCHEMA = ("request_id long, prompt string, tenant_id string, user_id string, application_id string, "
          "requested_provider string, requested_model string, operation string, max_tokens int, temperature double, "
          "metadata map<string,string>")


@pytest.fixture
def request_rows(spark):
    def make(**fields):
        base = dict(request_id=1, prompt="test", tenant_id=None, user_id=None, application_id=None,
                    requested_provider=None, requested_model=None, operation="chat", max_tokens=None, temperature=None,
                    metadata={})
        return spark.createDataFrame([{**base, **fields}], SCHEMA)
    return make


def holds(df, *conditions):
    return df.select(routing.all_match(df, [Condition(*c) for c in conditions]).alias("x")).first()["x"]


@pytest.mark.parametrize("fields, conditions, wanted", [
    ({}, [], True),
    ({"tenant_id": "acme"}, [("tenantId", "eq", "acme")], True),
    ({"tenant_id": "acme"}, [("TENANTID", "EQ", "ACME")], True),
    ({"tenant_id": "acme"}, [("tenantId", "eq", "other")], False),
    ({"tenant_id": "acme"}, [("tenantId", "neq", "other")], True),
    ({}, [("tenantId", "eq", "x")], False),
    ({}, [("tenantId", "eq", None)], False),
    ({}, [("tenantId", "neq", "x")], True),
    ({"prompt": "Hello"}, [("prompt.length", "gt", 3)], True),
    ({"prompt": "Hello"}, [("prompt.length", "gt", 100)], False),
    ({"prompt": "Hello"}, [("prompt.length", "gte", 5)], True),
    ({"prompt": "Hello"}, [("prompt.length", "lt", 100)], True),
    ({"prompt": "Hello"}, [("prompt.length", "lte", 5)], True),
    ({"prompt": "Hello"}, [("prompt.length", "lte", 4.9)], False),
    ({"tenant_id": "acme"}, [("tenantId", "contains", "CM")], True),
    ({"tenant_id": "acme"}, [("tenantId", "startswith", "Ac")], True),
    ({"tenant_id": "acme"}, [("tenantId", "startswith", "cm")], False),
    ({}, [("tenantId", "contains", "a")], False),
    ({"tenant_id": "acme"}, [("tenantId", "exists", True)], True),
    ({"tenant_id": "acme"}, [("tenantId", "exists", False)], True),  # the value is not looked at
    ({}, [("tenantId", "exists", True)], False),
    ({"metadata": {"priority": "high"}}, [("metadata.priority", "eq", "high")], True),
    ({"metadata": {"priority": "high"}}, [("METADATA.priority", "eq", "high")], True),
    ({"metadata": {"priority": "high"}}, [("metadata.Priority", "exists", True)], False),
    ({"metadata": {"n": "12.5"}}, [("metadata.n", "gt", 12)], True),
    ({"metadata": {"n": "many"}}, [("metadata.n", "lt", 1)], True),  # no number counts as 0
    ({"prompt": "Hello", "tenant_id": "acme"}, [("tenantId", "eq", "acme"), ("prompt.length", "gt", 2)], True),
    ({"prompt": "Hello", "tenant_id": "acme"}, [("tenantId", "eq", "acme"), ("prompt.length", "gt", 100)], False),
    ({"tenant_id": "acme"}, [("tenantId", "match_regex", ".*")], False),
    ({}, [("nonexistent", "exists", True)], False),
    ({}, [("systemPrompt", "exists", True)], False),
    ({}, [("maxTokens", "lt", 100)], True),  # null counts as 0
    ({}, [("maxTokens", "gte", 0)], True),
    ({"max_tokens": 5}, [("maxTokens", "eq", 5)], True),
    ({"temperature": 1.0}, [("temperature", "eq", 1)], True),
    ({"temperature": 0.25}, [("temperature", "eq", 0.25)], True),
    ({"temperature": 0.25}, [("temperature", "lte", 0.25)], True),
    ({"temperature": 1e-5}, [("temperature", "eq", "1E-05")], True),
    ({"temperature": 1e20}, [("temperature", "eq", "1E+20")], True),
    ({"metadata": {"on": "true"}}, [("metadata.on", "eq", True)], True),
])
def test_conditions(request_rows, fields, conditions, wanted):
    assert holds(request_rows(**fields), *conditions) is wanted


def test_numbers_compare_as_written(request_rows):
    text = json.dumps({"providers": {"a": {"type": "x"}}, "routing": {"defaultProvider": "a", "defaultModel": "m", "rules": [
        {"name": "r", "provider": "a", "model": "m", "conditions": [{"field": "maxTokens", "operator": "eq", "value": 1}]}]}})
    whole, fraction = (Policy.from_json(text.replace('"value": 1', f'"value": {v}')).rules[0].conditions for v in ("5", "5.0"))
    df = request_rows(max_tokens=5)
    assert df.select(routing.all_match(df, whole)).first()[0] is True
    assert df.select(routing.all_match(df, fraction)).first()[0] is False


@pytest.mark.parametrize("condition", [("maxTokens", "gt", "many"), ("maxTokens", "lte", True),
                                       ("tenantId", "contains", 5), ("tenantId", "startswith", None)])
def test_conditions_that_cannot_work_are_refused(condition):
    with pytest.raises(PolicyError):
        Condition(*condition)


POLICY = Policy(
    providers={"azure": Provider("azure-openai", deployment_map={"big": "big-eu"}), "openai": Provider("openai")},
    default_provider="openai", default_model="small",
    rules=(RouteRule("vip", "azure", "big", (Condition("tenantId", "eq", "vip"),)),
           RouteRule("any-user", "openai", "mid", (Condition("userId", "exists", True),))),
    fallbacks=(Fallback("AZURE", "openai", "backup"), Fallback("azure", "azure", "never")))


@pytest.mark.parametrize("fields, provider, model, rule", [
    ({}, "openai", "small", "default"),
    ({"tenant_id": "VIP", "user_id": "u"}, "azure", "big", "vip"),
    ({"user_id": "u"}, "openai", "mid", "any-user"),
    ({"requested_provider": "azure", "requested_model": "x", "tenant_id": "vip"}, "azure", "x", "requested"),
    ({"requested_provider": "AZURE", "requested_model": "x"}, "openai", "small", "default"),
    ({"requested_provider": "azure", "requested_model": "  "}, "openai", "small", "default"),
    ({"requested_provider": "azure"}, "openai", "small", "default"),
])
def test_route(request_rows, fields, provider, model, rule):
    out = routing.route(request_rows(**fields), POLICY).first()
    assert (out["provider"], out["model"], out["route_rule"]) == (provider, model, rule)


def test_fallback_is_one_hop_and_first_rule_wins(spark):
    df = spark.createDataFrame([(1, "azure", "big", True), (2, "azure", "big", False), (3, "openai", "s", True)],
                               "id long, provider string, model string, failed boolean")
    rows = routing.apply_fallback(df, POLICY).orderBy("id").collect()
    assert [(r["provider"], r["model"], r["used_fallback"], r["unresolved"], r["flags"]) for r in rows] == [
        ("openai", "backup", True, False, ["fallback:azure->openai"]), ("azure", "big", False, False, []),
        ("openai", "s", False, True, [])]


def test_deployment(spark):
    df = spark.createDataFrame([("azure", "big"), ("azure", "other"), ("openai", "big")], "provider string, model string")
    out = [r[0] for r in df.select(routing.deployment(F.col("provider"), F.col("model"), POLICY)).collect()]
    assert out == ["big-eu", "other", "big"]


def test_flags_of_the_risk_screen_count_as_metadata(spark, request_rows):
    df = request_rows(metadata={"semantic_scores": "given"}).withColumns(
        {"semantic_flags": F.array(F.lit("hate:0.90")), "semantic_scores": F.lit(None).cast("map<string,double>")})
    assert holds(df, ("metadata.semantic_flags", "exists", None), ("metadata.semantic_flags", "contains", "hate"))
    assert holds(df, ("metadata.semantic_scores", "eq", "given"))
    assert not holds(request_rows(), ("metadata.semantic_flags", "exists", None))


def test_disabled_providers_cannot_answer(spark):
    from parapet.plans import flows

    rows = [(1, "off"), (2, "on"), (3, "lone"), (4, "OFF")]
    decided = spark.createDataFrame(rows, "request_id long, provider string").selectExpr(
        "*", "'m' AS model", "false AS blocked", "string(null) AS screen", "string(null) AS reason", "'hi' AS prompt")
    replies = spark.createDataFrame([(i, "fine", 1, 1, "boom" if i == 2 else None) for i, _ in rows],
                                    "request_id long, content string, prompt_tokens int, completion_tokens int, error string")
    policy = Policy({"off": Provider("t", False), "on": Provider("t"), "lone": Provider("t", False)}, "on", "m",
                    fallbacks=[Fallback("off", "on", "x"), Fallback("on", "lone", "y")])
    got = {r["request_id"]: r["reason"] for r in flows.answer(decided, replies, policy).collect()}
    gone = "Gateway error: AI provider 'lone' is not registered."
    assert got == {1: None, 2: gone, 3: gone, 4: None}


def test_left_values_far_out(spark):
    df = spark.createDataFrame([(i, {"n": t}) for i, t in enumerate(["1e25", "-1e25", "79228162514264337593543950335", "8e28", "12.5", "x", None])],
                               "id int, metadata map<string,string>")
    def hits(op, value):
        return [r["id"] for r in df.filter(routing.matches(df, Condition("metadata.n", op, value))).orderBy("id").collect()]

    assert hits("gt", 5) == [0, 2, 4] and hits("lt", -5) == [1] and hits("gte", 12.5) == [0, 2, 4] and hits("lte", 0) == [1, 3, 5, 6]
