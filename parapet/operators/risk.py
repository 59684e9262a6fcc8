"""Weighted risk scores per category, in block and flag mode."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Mapping, Sequence

from pyspark.sql import DataFrame

from parapet.functions import fixed
from parapet.functions.text import count_contained, quoted, two_decimals
from parapet.operators.binding import long_table
from parapet.operators.screens import Screen

CATEGORIES = tuple(enumerate(fixed.RISK_LEXICON))


def weight_sum(lower: str, category: str) -> str:
    """Sum of the weights of the keywords found, each counted once, added in list order."""
    return "(" + " + ".join(f"IF(contains({lower}, {quoted(word)}), {weight}D, 0.0D)"
                            for word, weight in fixed.RISK_LEXICON[category]) + ")"


def _clustered(total: str, hits: str) -> str:
    """Raise the sum when several keywords occur together, and cap it."""
    raised = total
    for least, factor in fixed.RISK_CLUSTERS:
        raised += f" * IF({hits} >= {least}, {factor}D, 1.0D)"
    return f"least({raised}, {fixed.RISK_CAP}D)"


@dataclass(frozen=True)
class Risk(Screen):
    mode: str = "block"
    default_threshold: float = fixed.RISK_DEFAULT_THRESHOLD
    thresholds: Mapping[str, float] = field(default_factory=dict)
    name: str = "semantic"
    order: int = fixed.ORDER["semantic"]

    def score(self, env) -> None:
        """Bind ``score_i`` for every category, only for rows not blocked yet.

        Keywords are counted only where the sum says there are any, which most texts have not.
        """
        env.bind(**{f"sum_{i}": (lambda ref, c=c: f"CASE WHEN {ref('reason')} IS NULL THEN "
                                                  f"{weight_sum(ref('lower'), c)} END") for i, c in CATEGORIES})
        env.bind(**{f"hits_{i}": (lambda ref, i=i, words=[w for w, _ in fixed.RISK_LEXICON[c]]:
                                  f"IF({ref(f'sum_{i}')} > 0, {count_contained(ref('lower'), words)}, 0)")
                    for i, c in CATEGORIES})
        env.bind(**{f"score_{i}": (lambda ref, i=i: _clustered(ref(f"sum_{i}"), ref(f"hits_{i}")))
                    for i, _ in CATEGORIES})

    def _flagged(self, ref, shown) -> str:
        """Array of the categories at or above their threshold, in category order."""
        hits = [f"IF({ref(f'score_{i}')} >= {float(self.thresholds.get(c, self.default_threshold))!r}D, {shown(i, c)}, NULL)"
                for i, c in CATEGORIES]
        return f"array_compact(array({', '.join(hits)}))"

    def apply(self, env) -> None:
        self.score(env)
        if self.mode == "block":
            env.bind(over=lambda ref: self._flagged(ref, lambda i, c: quoted(c)))
            env.bind(found=lambda ref: f"CASE WHEN {ref('reason')} IS NULL AND size({ref('over')}) > 0 THEN "
                                       f"concat({quoted(fixed.REASON_RISK)}, array_join({ref('over')}, ', ')) END")
            self.settle(env)
            return
        env.bind(over=lambda ref: self._flagged(
            ref, lambda i, c: f"concat({quoted(c + ':')}, {two_decimals(ref(f'score_{i}'))})"))
        env.bind(semantic_flags=lambda ref: f"CASE WHEN size({ref('over')}) > 0 THEN {ref('over')} END",
                 semantic_scores=lambda ref: f"CASE WHEN size({ref('over')}) > 0 THEN "
                                             f"map_from_entries({_above_zero(ref)}) END")

    def outputs(self) -> dict[str, str]:
        return {} if self.mode == "block" else {"semantic_flags": "semantic_flags",
                                                "semantic_scores": "semantic_scores"}


def _above_zero(ref) -> str:
    entries = ", ".join(f"named_struct('category', {quoted(c)}, 'score', {ref(f'score_{i}')})" for i, c in CATEGORIES)
    return f"filter(array({entries}), e -> e.score > 0)"


def risk_scores(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """Long table ``keys, category, score`` of all scores above zero."""
    from parapet.operators.chain import start_rows

    env = start_rows(df.select(*keys, text), text)
    Risk().score(env)
    env.bind(scores=_above_zero)
    return long_table(env.df, keys, env.ref("scores"), "category")
