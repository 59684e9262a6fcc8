"""Personal and health data: ordered redaction, findings, block mode, custom patterns, response redaction.

Detectors run one after the other, each on the text the previous ones left behind. The order is part of the result: a
phone number match takes digits a later detector would have claimed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from parapet.functions import fixed
from parapet.functions.text import check_pattern, quoted, utf16_length
from parapet.operators.binding import long_table
from parapet.operators.screens import Screen


@dataclass(frozen=True)
class Detector:
    kind: str
    pattern: str
    tag: str
    needs: str = ""  # cheap condition every matching text fulfils: "@", "digit", "patient" or none
    custom: bool = False

    @property
    def replacement(self) -> str:
        return java_replacement(self.tag) if self.custom else self.tag


@dataclass(frozen=True)
class CustomPattern:
    name: str
    pattern: str
    replacement: str = fixed.CUSTOM_PII_TAG


def java_replacement(text: str) -> str:
    """Write a replacement for Spark's regex engine: ``$1``, ``${name}``, ``$&`` and ``$$`` keep their meaning."""
    def one(m: re.Match) -> str:
        token = m.group(0)
        if token == "$$":
            return r"\$"
        if token == "$&":
            return "$0"
        return token if len(token) > 1 and token[0] == "$" else "\\" + token

    return re.sub(r"\$\$|\$&|\$\d|\$\{\w+\}|[\\$]", one, text)


def _needs(kind: str) -> str:
    return {"EMAIL": "@", "PATIENT_NAME": "patient"}.get(kind, "digit")


# "(?U)": digits, white space and word borders by Unicode classes; "(?i)" then folds case by Unicode as well.
DETECTORS = {
    kind: Detector(kind, ("(?iU)" if ignore_case else "(?U)") + pattern, tag, _needs(kind))
    for kind, _, _, ignore_case, pattern, tag in fixed.PII_DETECTORS
}
OPTIONS = {option: (kind, default) for kind, option, default, _, _, _ in fixed.PII_DETECTORS}


def chosen_detectors(options: Mapping[str, bool] | None = None, custom: Sequence[CustomPattern] = ()) -> list[Detector]:
    """Enabled detectors in step order, custom ones last."""
    options = options or {}
    unknown = set(options) - set(OPTIONS)
    if unknown:
        raise ValueError(f"unknown detector options: {sorted(unknown)}")
    for one in custom:
        check_pattern(one.pattern)
    built_in = [DETECTORS[kind] for option, (kind, default) in OPTIONS.items() if options.get(option, default)]
    return built_in + [Detector(c.name, "(?iU)" + c.pattern, c.replacement, custom=True) for c in custom]


ALL_OPTIONS = {option: True for option in OPTIONS}


# cheap condition -> what it looks at
_GATES = {
    "@": ("has_at", lambda text: f"contains({text}, '@')"),
    "digit": ("has_digit", lambda text: f"{text} RLIKE {quoted('(?U)' + chr(92) + 'd')}"),
    "patient": ("has_patient", lambda text: f"(contains({text}, 'atient') OR contains({text}, 'aciente'))"),
}


def redact_steps(env, detectors: Sequence[Detector], target: str = "text", count: bool = False) -> None:
    """Rewrite ``target`` by each detector in turn; with ``count``, leave the matches of step i in ``n_i``.

    The regexes only run on texts that can match (most texts hold no digit and no ``@``). Tags hold neither, so the
    conditions, taken on the first text, stay valid for all built-in steps.
    """
    gates = [_GATES[need] for need in sorted({d.needs for d in detectors if d.needs})]
    env.bind(**{name: (lambda ref, test=test: f"({ref('reason')} IS NULL AND {test(ref('text'))})")
                for name, test in gates})
    for i, d in enumerate(detectors):
        def open_to(ref, d=d) -> str:
            return ref(_GATES[d.needs][0]) if d.needs else f"{ref('reason')} IS NULL"

        def rewritten(ref, d=d, open_to=open_to) -> str:
            return (f"IF({open_to(ref)}, regexp_replace({ref(target)}, {quoted(d.pattern)}, {quoted(d.replacement)}), "
                    f"{ref(target)})")

        if not count:
            env.bind(**{target: rewritten})
            continue
        env.bind(after=rewritten)

        def matches(ref, d=d, open_to=open_to) -> str:
            # A tag never equals what it replaces, so an unchanged text had no match; custom tags may.
            worth = open_to(ref) if d.custom else f"{ref('after')} <> {ref(target)}"
            return f"IF({worth}, regexp_count({ref(target)}, {quoted(d.pattern)}), 0)"

        env.bind(**{f"n_{i}": matches, target: lambda ref: ref("after")})


def _found_kinds(ref, detectors: Sequence[Detector]) -> str:
    kinds = ", ".join(f"IF({ref(f'n_{i}')} > 0, {quoted(d.kind)}, NULL)" for i, d in enumerate(detectors))
    return f"array_distinct(array_compact(array({kinds})))"


def _relower(env) -> None:
    """Bring ``lower`` up to date where ``text`` is no longer what it was ``before``."""
    env.bind(lower=lambda ref: f"IF({ref('before')} = {ref('text')}, {ref('lower')}, lower({ref('text')}))")


@dataclass(frozen=True)
class Pii(Screen):
    mode: str = "sanitize"
    options: Mapping[str, bool] = field(default_factory=dict)
    custom: Sequence[CustomPattern] = ()
    name: str = "pii-detection"
    order: int = fixed.ORDER["pii-detection"]

    def detectors(self) -> list[Detector]:
        return chosen_detectors(self.options, self.custom)

    def apply(self, env) -> None:
        steps = self.detectors()
        if self.mode != "block":
            env.bind(before=lambda ref: ref("text"))
            redact_steps(env, steps)
            _relower(env)
            return
        if not steps:
            return
        env.bind(probe=lambda ref: ref("text"))
        redact_steps(env, steps, target="probe", count=True)
        env.bind(kinds=lambda ref: _found_kinds(ref, steps))
        env.bind(found=lambda ref: f"CASE WHEN {ref('reason')} IS NULL AND size({ref('kinds')}) > 0 THEN "
                                   f"concat({quoted(fixed.REASON_PII)}, array_join({ref('kinds')}, ', '), "
                                   f"{quoted(fixed.REASON_PII_TAIL)}) END")
        self.settle(env)


def redact(df: DataFrame, text: str = "text", options: Mapping[str, bool] | None = None,
           custom: Sequence[CustomPattern] = ()) -> DataFrame:
    """Replace the text column by its redacted form; no shuffle, no Python."""
    from parapet.operators.chain import start_rows

    env = start_rows(df, text)
    redact_steps(env, chosen_detectors(options, custom))
    return env.result(**{text: "text"})


def findings(df: DataFrame, text: str, keys: Sequence[str], options: Mapping[str, bool] | None = None,
             custom: Sequence[CustomPattern] = ()) -> DataFrame:
    """Long table ``keys, type, n``: matches each detector made at its step, only where there are any."""
    from parapet.operators.chain import start_rows

    steps = chosen_detectors(options, custom)
    env = start_rows(df.select(*keys, text), text)
    redact_steps(env, steps, count=True)
    env.bind(findings=lambda ref: "filter(array(" + ", ".join(
        f"named_struct('type', {quoted(d.kind)}, 'n', {ref(f'n_{i}')})" for i, d in enumerate(steps))
        + "), e -> e.n > 0)")
    return long_table(env.df, keys, env.ref("findings"), "type")


def findings_report(found: DataFrame) -> DataFrame:
    """Matches and texts per type. Partial sums are made before the shuffle, whose keys are the few types."""
    return found.groupBy("type").agg(F.sum("n").cast("bigint").alias("matches"), F.count("*").alias("texts"))


@dataclass(frozen=True)
class ResponsePii(Screen):
    """The five response detectors. The result is kept only if it has another length than the text."""

    name: str = "output-pii-redaction"
    order: int = fixed.ORDER["output-pii-redaction"]

    def apply(self, env) -> None:
        env.bind(before=lambda ref: ref("text"), probe=lambda ref: ref("text"))
        redact_steps(env, [DETECTORS[kind] for kind in fixed.RESPONSE_PII_TYPES], target="probe")
        env.bind(text=lambda ref: f"IF({ref('probe')} <> {ref('text')} AND {utf16_length(ref('probe'))} <> "
                                  f"{utf16_length(ref('text'))}, {ref('probe')}, {ref('text')})")
        _relower(env)
