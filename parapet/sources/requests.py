"""Normalized requests from JSON bodies, and provider payloads from requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parapet.functions import fixed
from parapet.functions.text import is_blank
from parapet.policy import Policy

# camelCase name in the body -> (column, type, default)
FIELDS = {
    "operation": ("operation", "string", fixed.DEFAULT_OPERATION),
    "prompt": ("prompt", "string", ""),
    "systemPrompt": ("system_prompt", "string", None),
    "userId": ("user_id", "string", None),
    "tenantId": ("tenant_id", "string", None),
    "applicationId": ("application_id", "string", None),
    "conversationId": ("conversation_id", "string", None),
    "requestedProvider": ("requested_provider", "string", None),
    "requestedModel": ("requested_model", "string", None),
    "maxTokens": ("max_tokens", "int", None),
    "temperature": ("temperature", "double", None),
}
_TEXT_MAP = "map<string,string>"
# JSON kinds a field of each type may have, as a pattern; null is always allowed
_KINDS = {"string": "STRING", "int": "BIGINT", "double": "BIGINT|DECIMAL.*|DOUBLE|FLOAT"}


def _folded(pairs: Column) -> Column:
    """Map with lower-cased names; of several spellings of one name the last wins."""
    entries = F.transform(F.map_entries(pairs), lambda e: F.struct(F.lower(e["key"]).alias("k"), e["value"].alias("v")))
    names = F.transform(entries, lambda e: e["k"])
    last = F.filter(entries, lambda e, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), e["k"]))
    return F.map_from_entries(last)


def _well_typed(kinds: Column) -> Column:
    """Whether every known field that is there has a kind its type can be read from."""
    ok = F.lit(True)
    for name, pattern in [*((n, _KINDS[kind]) for n, (_, kind, _) in FIELDS.items()), ("metadata", "OBJECT.*")]:
        kind = F.try_element_at(kinds, F.lit(name.lower()))
        ok = ok & F.coalesce(F.rlike(kind, F.lit(f"^({pattern}|VOID)$")), F.lit(True))
    return ok


def read_requests(df: DataFrame, body: str) -> DataFrame:
    """Adds the request columns read from a JSON body, names matched without regard to case.

    ``valid`` is false where the body is no JSON object or a field has the wrong type (a number as prompt, text or a
    fraction as ``maxTokens``); its columns are then null.
    """
    out = (df.withColumn("__raw", F.from_json(F.col(body), _TEXT_MAP))
           .withColumn("__kinds", _folded(F.transform_values(
               F.from_json(F.col(body), "map<string,variant>"), lambda k, v: F.schema_of_variant(v))))
           .withColumn("valid", F.col("__raw").isNotNull() & _well_typed(F.col("__kinds")))
           .withColumn("__fields", F.when(F.col("valid"), _folded(F.col("__raw")))))

    def field(name: str, kind: str, default) -> Column:
        value = F.try_element_at(F.col("__fields"), F.lit(name.lower())).try_cast(kind)
        return value if default is None else F.when(F.col("valid"), F.coalesce(value, F.lit(default)))

    columns = {column: field(name, kind, default) for name, (column, kind, default) in FIELDS.items()}
    columns["metadata"] = F.when(F.col("valid"), F.coalesce(
        F.from_json(F.try_element_at(F.col("__fields"), F.lit("metadata")), _TEXT_MAP),
        F.create_map().cast(_TEXT_MAP)))
    return out.withColumns(columns).drop("__raw", "__kinds", "__fields")


def payload(flavor: str, model: str = "model") -> Column:
    """The chat request a provider of this flavor expects, as JSON text.

    Flavors: ``openai`` and ``mistral`` name the model, ``azure-openai`` does not, ``ollama`` also turns streaming off.
    """
    message = F.struct(F.lit("user").alias("role"), F.coalesce(F.col("prompt"), F.lit("")).alias("content"))
    system = F.struct(F.lit("system").alias("role"), F.col("system_prompt").alias("content"))
    fields = [] if flavor == "azure-openai" else [F.col(model).alias("model")]
    fields += [F.when(F.expr(is_blank("system_prompt")), F.array(message)).otherwise(F.array(system, message))
               .alias("messages"),
               F.coalesce(F.col("max_tokens"), F.lit(fixed.DEFAULT_MAX_TOKENS)).alias("max_tokens"),
               F.coalesce(F.col("temperature"), F.lit(fixed.DEFAULT_TEMPERATURE)).alias("temperature")]
    if flavor == "ollama":
        fields.append(F.lit(False).alias("stream"))
    return F.to_json(F.struct(*fields))


def to_payloads(df: DataFrame, policy: Policy) -> DataFrame:
    """Adds ``payload`` to routed requests, each in the flavor of its provider's type, for writing out as JSON lines."""
    made = F.lit(None).cast("string")
    for name, provider in policy.providers.items():
        made = F.when(F.col("provider") == name, payload(provider.type.lower())).otherwise(made)
    return df.withColumn("payload", made)
