"""Chat bodies and completion bodies held as JSON text in a column."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from parapet.functions import fixed
from parapet.operators.chain import run_chain, run_parts
from parapet.operators.screens import Screen

SCREENED_ROLES = ("user", "system")
_MESSAGE = "role string, content string"


def _parsed(body: Column) -> Column:
    # Messages are read as raw JSON texts first, so one odd element does not void the whole array.
    return F.from_json(body, "messages array<string>, prompt string", {"allowSingleQuotes": "false"})


def _messages(parsed: Column) -> Column:
    return F.transform(parsed["messages"], lambda m, i: F.struct(
        F.from_json(m, _MESSAGE).alias("m"), i.alias("idx")))


def parts_of(parsed: Column) -> Column:
    """Array of the parts to screen, each ``(idx, role, text)``; ``idx`` is the place in ``messages``.

    A body with a ``messages`` array never falls back to ``prompt``, even when no message qualifies.
    """
    kept = F.transform(
        F.filter(_messages(parsed), lambda p: p["m"]["role"].isin(*SCREENED_ROLES) & p["m"]["content"].isNotNull()),
        lambda p: F.struct(p["idx"].alias("idx"), p["m"]["role"].alias("role"), p["m"]["content"].alias("text")))
    single = F.array(F.struct(F.lit(0).alias("idx"), F.lit("user").alias("role"), parsed["prompt"].alias("text")))
    none = F.filter(single, lambda p: F.lit(False))
    return (F.when(parsed["messages"].isNotNull(), kept)
            .when(parsed["prompt"].isNotNull(), single)
            .otherwise(none))


def explode_chat(df: DataFrame, body: str, keys: Sequence[str]) -> DataFrame:
    """One row per part: ``keys, part_idx, role, text`` with ``part_idx`` counting the kept parts from 0."""
    return (df.select(*keys, _parsed(F.col(body)).alias("__parsed"))
            .select(*keys, F.posexplode_outer(parts_of(F.col("__parsed"))).alias("part_idx", "__part"))
            .filter(F.col("part_idx").isNotNull())  # outer and filter: see long_table
            .select(*keys, "part_idx", F.col("__part.role").alias("role"), F.col("__part.text").alias("text")))


def screen_bodies(df: DataFrame, body: str, screens: Sequence[Screen]) -> DataFrame:
    """Screen every part of every body and put the rewritten texts back in place.

    Adds ``parts`` (number screened), ``blocked``, ``reason`` (of the first blocked part) and ``screened_body`` (null
    if blocked). All other fields of the body are carried over as they are. One narrow projection: bodies are neither
    exploded nor shuffled. The values leave through a generator, as in ``Rows.result``: a later filter on them must not
    repeat the screens below it.
    """
    added = ["parts", "blocked", "reason", "screened_body"]
    staged = (df.withColumn("__parsed", _parsed(F.col(body)))
              .withColumn("__before", parts_of(F.col("__parsed")))
              .withColumn("__after", F.col("__before")))
    staged = (run_parts(staged, "__after", ["idx", "role", "text"], screens)
              .withColumn("__stop", F.get(F.filter("__after", lambda p: p["reason"].isNotNull()), F.lit(0)))
              .withColumn("__changed", F.transform("__after", lambda p: p["text"])
                          != F.transform("__before", lambda p: p["text"])))
    done = (staged
            .withColumn("parts", F.size("__before"))
            .withColumn("blocked", F.col("__stop").isNotNull())
            .withColumn("reason", F.when(F.col("__stop").isNotNull(),
                                         F.coalesce(F.col("__stop.reason"), F.lit(fixed.REASON_INPUT))))
            .withColumn("screened_body", F.when(~F.col("blocked"), F.when(
                F.coalesce(F.col("__changed"), F.lit(False)),
                rebuilt(F.col(body), F.col("__parsed"), F.col("__after"))).otherwise(F.col(body)))))
    kept = [c for c in df.columns if c not in added]
    return done.select(*kept, F.inline(F.array(F.struct(*added))))


def screen_bodies_apart(df: DataFrame, body: str, keys: Sequence[str], screens: Sequence[Screen]) -> DataFrame:
    """``screen_bodies`` for screens that need rows, such as a scorer written as a Pandas UDF.

    The parts leave their bodies with their positions, are screened in Arrow batches, and come back by ``keys``, which name a
    row. A group is the parts of one body, which fitted in one row. Bodies are joined to what came back and not carried
    through the screens; those without parts pass as they are. Columns that are not in ``keys`` stay with the bodies.
    """
    added = ["parts", "blocked", "reason", "screened_body"]
    kept = [c for c in df.columns if c not in added]
    named = [F.col(f"`{k}`") for k in keys]
    opened = df.select(*named, F.inline_outer(parts_of(_parsed(F.col(body))))).filter(F.col("idx").isNotNull())
    screened = run_chain(opened.withColumn("__was", F.col("text")), screens, "text")
    stop = F.when(F.col("blocked"), F.struct("idx", F.coalesce("reason", F.lit(fixed.REASON_INPUT)).alias("reason")))
    entry = F.struct("idx", "role", "text")
    folded = screened.groupBy(*named).agg(
        F.count(F.lit(1)).cast("int").alias("__parts"), F.min(stop).alias("__stop"), F.bool_or(F.col("text") != F.col("__was")).alias("__changed"),
        F.array_sort(F.collect_list(entry)).alias("__after"))
    joined = df.select(*[F.col(f"`{c}`") for c in kept]).join(folded, list(keys), "left").withColumn("__parsed", _parsed(F.col(body)))
    blocked = F.col("__stop.reason").isNotNull()
    done = joined.withColumns({
        "parts": F.coalesce("__parts", F.lit(0)), "blocked": blocked, "reason": F.col("__stop.reason"),
        "screened_body": F.when(~blocked, F.when(F.coalesce("__changed", F.lit(False)), rebuilt(
            F.col(body), F.col("__parsed"), F.col("__after"))).otherwise(F.col(body)))})
    return done.select(*[F.col(f"`{c}`") for c in kept], F.inline(F.array(F.struct(*added))))


def rebuilt(body: Column, parsed: Column, after: Column) -> Column:
    """The body with the parts' texts exchanged by position; every other field keeps its JSON value."""
    text_at = F.map_from_entries(F.transform(after, lambda p: F.struct(p["idx"], p["text"])))
    as_fields = "map<string,variant>"

    def exchanged(message: Column, i: Column) -> Column:
        fields = F.from_json(message, as_fields)
        new = F.try_element_at(text_at, i)
        return F.when(new.isNull(), message).otherwise(F.to_json(_with_field(fields, "content", _quoted(new))))

    messages = F.concat(F.lit("["), F.array_join(F.transform(parsed["messages"], exchanged), ","), F.lit("]"))
    root = F.from_json(body, as_fields)
    return F.to_json(F.when(parsed["messages"].isNotNull(), _with_field(root, "messages", F.parse_json(messages)))
                     .otherwise(_with_field(root, "prompt", _quoted(F.get(after, F.lit(0))["text"]))))


def _quoted(text: Column) -> Column:
    """A text as a JSON string value."""
    return F.variant_get(F.parse_json(F.to_json(F.struct(text.alias("v")))), "$.v", "variant")


def _with_field(fields: Column, name: str, value: Column) -> Column:
    return F.map_concat(F.map_filter(fields, lambda k, v: k != name), F.create_map(F.lit(name), value))


def rebuild_chat(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``messages`` JSON from a parts table (``keys, part_idx, role, text``), in part order.

    For parts that already live in a table of their own; a group is the parts of one body, which fitted in one row.
    """
    entry = F.struct("part_idx", "role", F.col("text").alias("content"))
    ordered = F.transform(F.array_sort(F.collect_list(entry)),
                          lambda p: F.struct(p["role"].alias("role"), p["content"].alias("content")))
    return parts.groupBy(*keys).agg(F.to_json(F.struct(ordered.alias("messages"))).alias("body"))


def completion_content(body: Column) -> Column:
    """``choices[0].message.content``; null if absent or not JSON."""
    return F.get_json_object(body, "$.choices[0].message.content")


def set_path(body: Column, path: Sequence[str | int], value: Column) -> Column:
    """JSON text with the value at a path of names and positions exchanged for a string; all other fields keep theirs.

    Only the objects and arrays on the path are opened, the rest stays a value as it is. Names on the path come last in
    their objects. Null where the path does not lead through objects and arrays as it says.
    """
    if not path:
        return F.to_json(_quoted(value))
    step, rest = path[0], path[1:]
    if isinstance(step, int):
        items = F.from_json(body, "array<variant>")
        new = F.parse_json(set_path(F.to_json(F.get(items, F.lit(step))), rest, value))
        return F.to_json(F.when((F.size(items) > step) & new.isNotNull(), F.transform(
            items, lambda item, i: F.when(i == step, new).otherwise(item))))
    fields = F.from_json(body, "map<string,variant>")
    new = _quoted(value) if not rest else F.parse_json(set_path(F.to_json(F.try_element_at(fields, F.lit(step))), rest, value))
    return F.to_json(F.when(F.map_contains_key(fields, F.lit(step)) & new.isNotNull(), _with_field(fields, step, new)))


def completion_rebuilt(body: Column, content: Column) -> Column:
    """The completion body with another text as ``choices[0].message.content``."""
    return set_path(body, ("choices", 0, "message", "content"), content)


def extract_completion(df: DataFrame, body: str) -> DataFrame:
    return df.withColumn("content", completion_content(F.col(body)))


def extract_usage(df: DataFrame, body: str) -> DataFrame:
    """Adds ``prompt_tokens`` and ``completion_tokens``, 0 where the reply does not say.

    The body is parsed once, for its short ``usage`` object; both counts are read from that.
    """
    def tokens(name: str) -> Column:
        return F.coalesce(F.get_json_object("__usage", f"$.{name}").try_cast("int"), F.lit(0))

    opened = df.withColumn("__usage", F.get_json_object(body, "$.usage"))
    return opened.withColumns(
        {"prompt_tokens": tokens("prompt_tokens"), "completion_tokens": tokens("completion_tokens")}).drop("__usage")
