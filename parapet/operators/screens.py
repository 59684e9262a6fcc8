"""Screens that only look at a text: length, injection, blocklists, secrets, and the interface for custom ones.

``reason(text, lower)`` gives the SQL of the block reason, null where the text passes.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from parapet.functions import fixed
from parapet.functions.text import contains_any, count_contained, quoted, utf16_length
from parapet.operators.binding import long_table


class Screen:
    """One step of a chain. Subclasses give ``name``, ``order`` and ``reason`` or override ``apply``."""

    name: str
    order: int

    def reason(self, text: str, lower: str) -> str:
        raise NotImplementedError

    def apply(self, env) -> None:
        """Block texts that still pass; the work is skipped for those already blocked."""
        env.bind(found=lambda ref: f"CASE WHEN {ref('reason')} IS NULL THEN "
                                   f"{self.reason(ref('text'), ref('lower'))} END")
        self.settle(env)

    def settle(self, env) -> None:
        env.bind(screen=lambda ref: f"IF({ref('found')} IS NOT NULL, {quoted(self.name)}, {ref('screen')})",
                 reason=lambda ref: f"coalesce({ref('found')}, {ref('reason')})")

    def outputs(self) -> dict[str, str]:
        """Extra columns the screen leaves on a row chain."""
        return {}


@dataclass(frozen=True)
class MaxLength(Screen):
    limit: int = fixed.DEFAULT_MAX_LENGTH
    name: str = "max-length"
    order: int = fixed.ORDER["max-length"]

    def reason(self, text: str, lower: str) -> str:
        # A text of n bytes has at most n UTF-16 units: most rows need no transcoding.
        size = utf16_length(text)
        return (f"CASE WHEN octet_length({text}) > {self.limit} AND {size} > {self.limit} "
                f"THEN format_string({quoted(fixed.REASON_LENGTH)}, {self.limit}, {size}) END")


@dataclass(frozen=True)
class Injection(Screen):
    name: str = "prompt-injection"
    order: int = fixed.ORDER["prompt-injection"]

    def reason(self, text: str, lower: str) -> str:
        return (f"CASE WHEN {contains_any(lower, fixed.INJECTION_PHRASES)} THEN {quoted(fixed.REASON_INJECTION)} "
                f"WHEN {contains_any(lower, fixed.STRUCTURAL_MARKERS)} THEN {quoted(fixed.REASON_STRUCTURAL)} "
                f"WHEN {count_contained(lower, fixed.ROLE_KEYWORDS)} >= {fixed.ROLE_KEYWORD_LIMIT} "
                f"THEN {quoted(fixed.REASON_ROLES)} END")


@dataclass(frozen=True)
class Blocklist(Screen):
    patterns: Sequence[str] = ()
    message: str = fixed.REASON_BLOCKLIST
    name: str = "blocked-patterns"
    order: int = fixed.ORDER["blocked-patterns"]

    def reason(self, text: str, lower: str) -> str:
        return f"CASE WHEN {contains_any(lower, self.patterns)} THEN {quoted(self.message)} END"


def response_blocklist(patterns: Sequence[str]) -> Blocklist:
    return Blocklist(patterns, fixed.REASON_RESPONSE_BLOCKLIST, "output-blocked-patterns",
                     fixed.ORDER["output-blocked-patterns"])


def _worth(text: str, lower: str, needs: Sequence[str], any_case: bool) -> str:
    """Cheap condition every text with such a secret fulfils; the regex runs only where it holds."""
    place = lower if any_case else text
    return "(" + " OR ".join(f"contains({place}, {quoted(n)})" for n in needs) + ")"


@dataclass(frozen=True)
class Secrets(Screen):
    """Blocks on the first secret kind found."""

    name: str = "secret-detection"
    order: int = fixed.ORDER["secret-detection"]

    def reason(self, text: str, lower: str) -> str:
        kinds = " ".join(f"WHEN {_worth(text, lower, needs, any_case)} AND {text} RLIKE {quoted(pattern)} "
                         f"THEN {quoted(fixed.REASON_SECRET + kind)}"
                         for kind, pattern, needs, any_case in fixed.SECRET_KINDS)
        return f"CASE {kinds} END"


def secret_findings(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """Long table ``keys, kind, n``: matches of every secret kind, only where there are any."""
    from parapet.operators.chain import start_rows

    def found(ref) -> str:
        counts = ", ".join(
            f"named_struct('kind', {quoted(kind)}, 'n', IF({_worth(ref('text'), ref('lower'), needs, any_case)}, "
            f"regexp_count({ref('text')}, {quoted(pattern)}), 0))" for kind, pattern, needs, any_case in fixed.SECRET_KINDS)
        return f"filter(array({counts}), c -> c.n > 0)"

    env = start_rows(df.select(*keys, text), text)
    env.bind(found=found)
    return long_table(env.df, keys, env.ref("found"), "kind")


@dataclass(frozen=True)
class CustomScreen(Screen):
    """A user's own check: a function from the text column to a reason column (a Pandas UDF included), and optionally
    one that rewrites the text."""

    name: str
    order: int
    check: Callable[[Column], Column]
    rewrite: Callable[[Column], Column] | None = None

    def apply(self, env) -> None:
        env.bind_column("found", self.check, "text")
        self.settle(env)
        if self.rewrite is not None:
            env.bind_column("text", self.rewrite, "text", otherwise="text")
            env.bind(lower=lambda ref: f"lower({ref('text')})")


def blocked_if(condition: Column, reason: str = fixed.REASON_INPUT) -> Column:
    """Reason column for a custom check that only says yes or no."""
    return F.when(condition, F.lit(reason))


def screen(df: DataFrame, one: Screen, text: str = "text") -> DataFrame:
    """Run a single screen over a text column: adds ``blocked``, ``screen``, ``reason``; the text may be rewritten."""
    from parapet.operators.chain import run_chain

    return run_chain(df, [one], text=text)
