import json

import pytest

from parapet.operators import pii, risk, screens
from parapet.plans.samples import POLICY
from parapet.policy import Condition, NumberText, Policy, PolicyError


def test_comments_commas_case_and_environment(tmp_path):
    file = tmp_path / "policy.json"
    file.write_text("""{ /* a comment */ "PROVIDERS": {"a": {"Type": "env:KIND", "enabled": false,}}, // "quoted"
      "routing": {"DefaultProvider": "a", "defaultmodel": "http://not-a-comment, ]",}, }""")
    policy = Policy.load(file, {"KIND": "openai"})
    assert policy.providers["a"].type == "openai" and policy.providers["a"].enabled is False
    assert policy.default_model == "http://not-a-comment, ]"
    with pytest.raises(PolicyError):  # a missing variable is empty text
        Policy.load(file, {})


def test_missing_file():
    with pytest.raises(FileNotFoundError):
        Policy.load("/no/such/policy.json")


@pytest.mark.parametrize("change", [
    {"providers": {}}, {"default_provider": ""}, {"default_model": None}, {"default_provider": "nobody"},
])
def test_validation(change):
    base = Policy.from_json(POLICY)
    fields = {"providers": base.providers, "default_provider": base.default_provider,
              "default_model": base.default_model, **change}
    with pytest.raises(PolicyError):
        Policy(**fields)


def test_rules_and_fallbacks_name_known_providers():
    for broken in (POLICY.replace('"name": "long", "provider": "azure"', '"name": "long", "provider": "x"'),
                   POLICY.replace('"fallbackProvider": "local"', '"fallbackProvider": "x"')):
        assert broken != POLICY
        with pytest.raises(PolicyError):
            Policy.from_json(broken)


def test_screens_of_a_policy():
    made = Policy.from_json(POLICY).input_screens()
    assert isinstance(made[0], screens.Injection)
    assert [type(s) for s in made[1:]] == [screens.MaxLength, pii.Pii, screens.Secrets, risk.Risk, screens.Blocklist]
    assert made[1].limit == 8000 and made[2].mode == "sanitize" and made[4].thresholds["hate"] == 0.6
    assert [type(s) for s in Policy.from_json(POLICY).output_screens()] == [screens.Blocklist, pii.ResponsePii]


def test_screen_parameters_fall_back_to_defaults():
    text = """{"providers": {"a": {"type": "x"}}, "routing": {"defaultProvider": "a", "defaultModel": "m"},
      "guardrails": {"input": [{"type": "MAX-LENGTH", "parameters": {"maxLength": 1.5}}, {"type": "unheard-of"},
        {"type": "pii", "parameters": {"detectEmails": false, "customPatterns": ["X\\\\d", {"name": "N", "pattern": "p"}]}},
        {"type": "pii-redaction", "mode": "Sanitize"}, {"type": "semantic", "mode": "FLAG"}]}}"""
    made = Policy.from_json(text).input_screens()
    assert made[1].limit == 20000 and made[2].mode == "block" and made[3].mode == "sanitize"  # each keeps its own
    assert made[2].options["detectEmails"] is False and made[3].options["detectEmails"] is True
    assert [c.name for c in made[2].custom] == ["CUSTOM", "N"] and made[2].custom[0].pattern == r"X\d"
    assert made[4].mode == "flag" and made[4].default_threshold == 0.4


def test_quota_rules():
    text = POLICY.replace('"quotas": {"enabled": false, "rules": []}', '"quotas": {"enabled": true, "rules": '
                          '[{"scope": "user", "requestsPerMinute": 60, "monthlyBudgetUsd": 10.5}, {"scope": "tenant"}]}')
    policy = Policy.from_json(text)
    assert policy.quotas_enabled and policy.quota_rules[0].requests_per_minute == 60
    assert str(policy.quota_rules[0].monthly_budget_usd) == "10.5" and policy.quota_rules[1].requests_per_minute is None


@pytest.mark.parametrize("value", ["100000000000000000000", "-1e30"])
def test_numbers_out_of_range_are_refused(value):
    with pytest.raises(PolicyError):
        Condition("maxTokens", "lt", NumberText(value))


def test_empty_custom_patterns_are_refused():
    from parapet.policy import _custom

    for given in ("", {"name": "x"}):
        with pytest.raises(PolicyError):
            _custom(given)


def test_broken_patterns_are_refused_at_load(spark):
    from parapet.operators import pii
    from parapet.plans.samples import POLICY

    def load(pattern):
        text = POLICY.replace('"mode": "sanitize", "parameters": {}', '"mode": "sanitize", "parameters": {"customPatterns": [%s]}' % json.dumps(pattern))
        assert text != POLICY
        return Policy.from_json(text).input_screens()

    assert load(r"\bID-\d+(?<![0-9]x)") and load({"name": "A", "pattern": r"\p{Lu}++"})
    for broken in ("(", "[a-", "a{2,1}", {"name": "B", "pattern": "*x"}):
        with pytest.raises(PolicyError):
            load(broken)
    with pytest.raises(ValueError):
        pii.chosen_detectors(None, [pii.CustomPattern("X", "(?<n")])
