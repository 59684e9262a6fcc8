"""Routing: conditions, first-match rules, explicit overrides, fallbacks and deployment names."""

from __future__ import annotations

from functools import reduce
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from parapet.functions.text import is_blank, number_text, utf16_length
from parapet.policy import NUMERIC, Condition, Policy

_DECIMAL = "decimal(38,18)"
_WIDE = "decimal(38,8)"
#: The largest number a left value may be; text beyond it is no number (fixed value).
_FURTHEST = "79228162514264337593543950335"
# field name (any case) -> request column; "prompt.length" and "metadata.<key>" are computed
_COLUMNS = {"tenantid": "tenant_id", "userid": "user_id", "applicationid": "application_id",
            "requestedprovider": "requested_provider", "requestedmodel": "requested_model", "operation": "operation",
            "maxtokens": "max_tokens", "temperature": "temperature"}
_METADATA = "metadata."


def field_value(df: DataFrame, field: str) -> Column | None:
    """The request value a condition names, None for a name that does not exist."""
    name = field.lower()
    if name == "prompt.length":
        return F.expr(utf16_length("coalesce(prompt, '')"))
    if name in _COLUMNS:
        return F.col(_COLUMNS[name])
    if name.startswith(_METADATA):
        key = field[len(_METADATA):]  # it keeps its case
        given = F.try_element_at(F.col("metadata"), F.lit(key))
        flagged = {"semantic_flags": lambda c: F.array_join(c, ","), "semantic_scores": F.to_json}
        if key in flagged and key in df.columns:  # what the risk screen found in flag mode counts as metadata
            return F.coalesce(flagged[key](F.col(key)), given)
        return given
    return None


def _kind(df: DataFrame, field: str) -> T.DataType:
    column = _COLUMNS.get(field.lower())
    return df.schema[column].dataType if column else T.StringType()


def matches(df: DataFrame, condition: Condition) -> Column:
    """One condition as a boolean column, never null."""
    value, op = field_value(df, condition.field), condition.operator.lower()
    if value is None:
        value = F.lit(None).cast("string")
    text = number_text(value) if isinstance(_kind(df, condition.field), T.DoubleType) else value.cast("string")
    if op in ("eq", "neq"):
        same = F.coalesce(F.lower(text) == F.lit(condition.text.lower()), F.lit(False))
        return same if op == "eq" else ~same
    if op in NUMERIC:
        # beyond the digits kept here any number is further out than the policy's, which is checked when it is loaded
        wide, edge = text.try_cast(_WIDE), F.lit("9" * 20).cast(_DECIMAL)
        far = F.when(F.abs(wide) <= F.lit(_FURTHEST).cast(_WIDE), F.when(wide > 0, edge).otherwise(-edge))
        left = F.coalesce(text.try_cast(_DECIMAL), far, F.lit(0).cast(_DECIMAL))
        right = F.lit(str(condition.number)).cast(_DECIMAL)
        return {"gt": left > right, "gte": left >= right, "lt": left < right, "lte": left <= right}[op]
    if op == "contains":
        return F.coalesce(F.contains(F.lower(text), F.lit(condition.value.lower())), F.lit(False))
    if op == "startswith":
        return F.coalesce(F.startswith(F.lower(text), F.lit(condition.value.lower())), F.lit(False))
    if op == "exists":
        return value.isNotNull()
    return F.lit(False)


def all_match(df: DataFrame, conditions: Sequence[Condition]) -> Column:
    return reduce(lambda a, b: a & b, [matches(df, c) for c in conditions], F.lit(True))


def route(df: DataFrame, policy: Policy) -> DataFrame:
    """Adds ``provider``, ``model`` and ``route_rule`` (``requested``, the rule's name, or ``default``).

    A request that names a configured provider and a model keeps them; else the first rule that matches decides. The
    policy becomes one CASE expression, so routing is a projection.
    """
    explicit = (F.expr(f"NOT {is_blank('requested_provider')} AND NOT {is_blank('requested_model')}")
                & F.col("requested_provider").isin(*policy.providers))
    pick = F.when(explicit, F.lit(-1))
    for i, rule in enumerate(policy.rules):
        pick = pick.when(all_match(df, rule.conditions), F.lit(i))
    out = df.withColumn("__pick", pick.otherwise(F.lit(len(policy.rules))))

    def chosen(requested: Column, values: Sequence[str]) -> Column:
        return F.when(F.col("__pick") == -1, requested).otherwise(
            F.get(F.array(*[F.lit(v) for v in values]), F.col("__pick")))

    return out.withColumns({
        "provider": chosen(F.col("requested_provider"), [*(r.provider for r in policy.rules), policy.default_provider]),
        "model": chosen(F.col("requested_model"), [*(r.model for r in policy.rules), policy.default_model]),
        "route_rule": chosen(F.lit("requested"), [*(r.name for r in policy.rules), "default"]),
    }).drop("__pick")


def is_disabled(provider: Column, policy: Policy) -> Column:
    """Whether the policy names this provider (in any case) and has it disabled; never null."""
    names = [name.lower() for name, p in policy.providers.items() if not p.enabled]
    return F.coalesce(F.lower(provider).isin(*names), F.lit(False)) if names else F.lit(False)


def apply_fallback(df: DataFrame, policy: Policy, failed: str = "failed") -> DataFrame:
    """Where the call failed and a fallback is set for the provider: go to it once.

    Changes ``provider`` and ``model``; adds ``used_fallback``, ``flags`` and ``unresolved`` (failed without a
    fallback). Of several fallbacks for one provider the first counts. The rules come from the policy, a file the driver
    has read, so they are literals in the plan rather than a table to join.
    """
    targets: dict[str, tuple[str, str]] = {}
    for f in policy.fallbacks:
        targets.setdefault(f.for_provider.lower(), (f.provider, f.model))
    old, to = F.col("provider"), F.lit(None).cast("struct<provider:string,model:string>")
    if targets:
        to = F.try_element_at(F.create_map(*[x for k, (p, m) in targets.items() for x in (
            F.lit(k), F.struct(F.lit(p).alias("provider"), F.lit(m).alias("model")))]), F.lower(old))
    out = df.withColumn("__to", F.when(F.col(failed), to)).withColumn("__from", old)
    hit = F.col("__to").isNotNull()
    return out.withColumns({
        "provider": F.coalesce(F.col("__to.provider"), F.col("provider")),
        "model": F.coalesce(F.col("__to.model"), F.col("model")),
        "used_fallback": hit,
        "flags": F.when(hit, F.array(F.concat(F.lit("fallback:"), F.col("__from"), F.lit("->"), F.col("__to.provider"))))
                  .otherwise(F.array().cast("array<string>")),
        "unresolved": F.coalesce(F.col(failed), F.lit(False)) & ~hit,
    }).drop("__to", "__from")


def deployment(provider: Column, model: Column, policy: Policy) -> Column:
    """The provider's own name for a model, the model itself where its deployment map has none."""
    name = F.when(F.lit(False), model)
    for key, p in policy.providers.items():
        if p.deployment_map:
            known: Mapping[str, str] = p.deployment_map
            table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
            name = name.when(provider == key, F.coalesce(F.try_element_at(table, model), model))
    return name.otherwise(model)


def route_report(routed: DataFrame) -> DataFrame:
    """Requests per provider, model and rule. Counts are partial before the shuffle, so a hot route costs nothing."""
    return routed.groupBy("provider", "model", "route_rule").agg(F.count("*").alias("requests"))
