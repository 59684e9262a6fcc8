"""Policies: small JSON documents read on the driver and turned into screens, route rules and quota rules."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field
from decimal import Decimal, InvalidOperation
from pathlib import Path
from typing import Any, Mapping

from parapet.functions import fixed


class PolicyError(ValueError):
    """A policy that cannot be used."""


class NumberText(str):
    """A JSON number kept as it was written: ``5`` and ``5.0`` differ when compared as text."""


@dataclass(frozen=True)
class Provider:
    type: str = ""
    enabled: bool = True
    deployment_map: Mapping[str, str] = field(default_factory=dict)


NUMERIC = ("gt", "gte", "lt", "lte")
TEXTUAL = ("contains", "startswith")
#: Numbers are compared as decimal(38,18).
LARGEST = Decimal(10) ** 20


@dataclass(frozen=True)
class Condition:
    field: str
    operator: str
    value: Any = None

    def __post_init__(self):
        op = self.operator.lower()
        if op in NUMERIC and self.number is None:
            raise PolicyError(f"condition on {self.field!r}: {op} needs a number")
        if op in NUMERIC and not abs(self.number) < LARGEST:
            raise PolicyError(f"condition on {self.field!r}: {self.value} is out of range")
        if op in TEXTUAL and (not isinstance(self.value, str) or isinstance(self.value, NumberText)):
            raise PolicyError(f"condition on {self.field!r}: {op} needs a string")

    @property
    def number(self) -> Decimal | None:
        written = isinstance(self.value, NumberText) or (
            isinstance(self.value, (int, float, Decimal)) and not isinstance(self.value, bool))
        try:
            return Decimal(str(self.value)) if written else None
        except InvalidOperation:
            return None

    @property
    def text(self) -> str:
        """The value as compared by ``eq`` and ``neq``."""
        if self.value is None:
            return ""
        if isinstance(self.value, bool):
            return "True" if self.value else "False"
        return self.value if isinstance(self.value, str) else json.dumps(self.value)


@dataclass(frozen=True)
class RouteRule:
    name: str
    provider: str
    model: str
    conditions: tuple[Condition, ...] = ()


@dataclass(frozen=True)
class Fallback:
    for_provider: str
    provider: str
    model: str


@dataclass(frozen=True)
class QuotaRule:
    scope: str
    requests_per_minute: int | None = None
    monthly_budget_usd: Decimal | None = None


@dataclass(frozen=True)
class ScreenSpec:
    type: str
    mode: str = "block"
    parameters: Mapping[str, Any] = field(default_factory=dict)

    def _get(self, name: str, kind: type, default):
        value = self.parameters.get(name)
        return value if isinstance(value, kind) else default

    def whole(self, name: str, default: int) -> int:
        value = self.parameters.get(name)
        return int(value) if isinstance(value, (int, NumberText)) and re.fullmatch(r"-?\d+", str(value)) else default

    def real(self, name: str, default: float) -> float:
        value = self.parameters.get(name)
        return float(value) if isinstance(value, (int, float, NumberText)) else default

    def flag(self, name: str, default: bool) -> bool:
        return self._get(name, bool, default)

    def texts(self, name: str) -> tuple[str, ...]:
        return tuple(self._get(name, list, []))


@dataclass(frozen=True)
class Policy:
    providers: Mapping[str, Provider]
    default_provider: str
    default_model: str
    rules: tuple[RouteRule, ...] = ()
    fallbacks: tuple[Fallback, ...] = ()
    input: tuple[ScreenSpec, ...] = ()
    output: tuple[ScreenSpec, ...] = ()
    quotas_enabled: bool = False
    quota_rules: tuple[QuotaRule, ...] = ()
    emit_audit: bool = True
    include_prompt_in_audit: bool = False

    def __post_init__(self):
        if not self.providers:
            raise PolicyError("at least one provider is needed")
        for name, provider in self.providers.items():
            if not provider.type.strip():
                raise PolicyError(f"provider {name!r} has no type")
        if not (self.default_provider or "").strip() or not (self.default_model or "").strip():
            raise PolicyError("routing needs defaultProvider and defaultModel")
        named = [("default", self.default_provider), *((r.name, r.provider) for r in self.rules),
                 *((f"fallback for {f.for_provider}", f.provider) for f in self.fallbacks)]
        for where, provider in named:
            if provider not in self.providers:
                raise PolicyError(f"{where}: unknown provider {provider!r}")

    @classmethod
    def load(cls, path: str | os.PathLike, env: Mapping[str, str] | None = None) -> "Policy":
        file = Path(path)
        if not file.is_file():
            raise FileNotFoundError(f"policy file not found: {file}")
        return cls.from_json(file.read_text(encoding="utf-8"), env)

    @classmethod
    def from_json(cls, text: str, env: Mapping[str, str] | None = None) -> "Policy":
        """Comments and trailing commas are allowed; ``"env:NAME"`` stands for an environment value (missing: empty)."""
        env = os.environ if env is None else env
        root = json.loads(_plain(text), parse_int=NumberText, parse_float=NumberText)
        routing, guardrails, quotas = (_get(root, k, {}) for k in ("routing", "guardrails", "quotas"))
        gateway, telemetry = _get(root, "gateway", {}), _get(root, "telemetry", {})
        resolved = lambda v: env.get(v[4:], "") if isinstance(v, str) and v.startswith("env:") else v
        root = _each(root, resolved)
        return cls(
            providers={name: Provider(_get(p, "type", ""), _get(p, "enabled", True),
                                      _get(p, "deploymentMap", None) or {})
                       for name, p in _get(root, "providers", {}).items()},
            default_provider=resolved(_get(routing, "defaultProvider", "")),
            default_model=resolved(_get(routing, "defaultModel", "")),
            rules=tuple(RouteRule(_get(r, "name", ""), _get(r, "provider", ""), _get(r, "model", ""), tuple(
                Condition(_get(c, "field", ""), _get(c, "operator", ""), _get(c, "value", None))
                for c in _get(r, "conditions", []))) for r in _each(_get(routing, "rules", []), resolved)),
            fallbacks=tuple(Fallback(_get(f, "forProvider", ""), _get(f, "fallbackProvider", ""),
                                     _get(f, "fallbackModel", ""))
                            for f in _each(_get(routing, "fallbacks", []), resolved)),
            input=_specs(_each(_get(guardrails, "input", []), resolved)),
            output=_specs(_each(_get(guardrails, "output", []), resolved)),
            quotas_enabled=_get(quotas, "enabled", False),
            quota_rules=tuple(_quota(r) for r in _get(quotas, "rules", [])),
            emit_audit=_get(telemetry, "emitAuditEvents", True),
            include_prompt_in_audit=_get(gateway, "includePromptInAudit", False))

    def input_screens(self) -> list:
        """Screens of the request side. The injection screen is always on and comes first among equals."""
        from parapet.operators import pii, risk, screens

        made: list = [screens.Injection()]
        for spec in self.input:
            kind = spec.type.lower()
            if kind == "max-length":
                made.append(screens.MaxLength(spec.whole("maxLength", fixed.DEFAULT_MAX_LENGTH)))
            elif kind == "blocked-patterns":
                made.append(screens.Blocklist(spec.texts("patterns")))
            elif kind in ("pii", "pii-detection", "pii-redaction"):
                made.append(pii.Pii(
                    "block" if spec.mode.lower() == "block" else "sanitize",
                    {option: spec.flag(option, default) for option, (_, default) in pii.OPTIONS.items()},
                    tuple(_custom(c) for c in spec.texts("customPatterns"))))
            elif kind == "secret-detection":
                made.append(screens.Secrets())
            elif kind == "semantic":
                limits = spec.parameters.get("thresholds", spec.parameters.get("categoryThresholds", {}))
                limits = limits if isinstance(limits, dict) else {}
                made.append(risk.Risk(
                    "flag" if spec.mode.lower() == "flag" else "block",
                    spec.real("defaultThreshold", fixed.RISK_DEFAULT_THRESHOLD),
                    {k: float(v) for k, v in limits.items() if isinstance(v, (int, float, NumberText))}))
        return made

    def output_screens(self) -> list:
        from parapet.operators import pii, screens

        made: list = []
        for spec in self.output:
            kind = spec.type.lower()
            if kind == "blocked-patterns":
                made.append(screens.response_blocklist(spec.texts("patterns")))
            elif kind in ("pii", "pii-redaction"):
                made.append(pii.ResponsePii())
        return made


def _custom(given):
    from parapet.functions.text import check_pattern
    from parapet.operators.pii import CustomPattern

    if not (given if isinstance(given, str) else _get(given, "pattern", "")):
        raise PolicyError("a custom pattern is empty")
    try:
        check_pattern(given if isinstance(given, str) else _get(given, "pattern", ""))
    except ValueError as error:
        raise PolicyError(str(error)) from None
    if isinstance(given, str):
        return CustomPattern("CUSTOM", given)
    return CustomPattern(_get(given, "name", ""), _get(given, "pattern", ""),
                         _get(given, "replacement", fixed.CUSTOM_PII_TAG))


def _quota(rule: dict) -> QuotaRule:
    limit, budget = _get(rule, "requestsPerMinute", None), _get(rule, "monthlyBudgetUsd", None)
    return QuotaRule(_get(rule, "scope", ""), None if limit is None else int(limit),
                     None if budget is None else Decimal(str(budget)))


def _specs(found: list) -> tuple[ScreenSpec, ...]:
    return tuple(ScreenSpec(_get(s, "type", ""), _get(s, "mode", "block"), _get(s, "parameters", {})) for s in found)


def _get(section: Mapping, name: str, default):
    """Property by name without regard to case; the last spelling wins."""
    hits = [v for k, v in section.items() if k.lower() == name.lower()]
    return hits[-1] if hits and hits[-1] is not None else default


def _each(value, change):
    if isinstance(value, dict):
        return {k: _each(v, change) for k, v in value.items()}
    if isinstance(value, list):
        return [_each(v, change) for v in value]
    return change(value)


_STRING = r'"(?:\\.|[^"\\])*"'


def _plain(text: str) -> str:
    """JSON without comments and trailing commas."""
    text = re.sub(rf"({_STRING})|//[^\n]*|/\*.*?\*/", lambda m: m.group(1) or "", text, flags=re.S)
    return re.sub(rf"({_STRING})|,(?=\s*[}}\]])", lambda m: m.group(1) or "", text)
