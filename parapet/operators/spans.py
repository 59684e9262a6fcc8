"""Personal data by place: all detectors on the original text, overlaps settled by how specific a detector is.

The chain in ``pii`` runs each detector on what the ones before it left, so a phone pattern may eat the head of a card
number. Here every detector sees the text as it came. Its matches and the pieces between them give places; a match that
overlaps one of a more specific detector is dropped; what is left is rewritten at once. Places stay valid in the original.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from parapet.operators.binding import long_table
from parapet.operators.pii import _GATES, CustomPattern, Detector, chosen_detectors

#: From the most to the least specific; custom patterns come before all.
SPECIFIC_FIRST = ("EMAIL", "IBAN", "MRN", "CREDIT_CARD", "DNI_NIE", "SSN", "IP_ADDRESS", "DOB", "PASSPORT", "PATIENT_NAME", "PHONE")
_SPAN = "array<struct<start:int,stop:int,kind:string,tag:string>>"


def ordered(options: Mapping[str, bool] | None, custom: Sequence[CustomPattern]) -> list[Detector]:
    chosen = chosen_detectors(options, custom)
    return sorted(chosen, key=lambda d: -1 if d.custom else SPECIFIC_FIRST.index(d.kind))


def _matches(text: Column, d: Detector) -> Column:
    """Places of all matches: the pieces between them say where they are. No pattern of ours matches nothing."""
    pattern = F.lit(d.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    both = F.zip_with(F.slice(F.split(text, d.pattern, -1), F.lit(1), F.size(found)), found,
                      lambda piece, match: F.struct(F.length(piece).alias("gap"), F.length(match).alias("size"), match.alias("match")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("spans"))

    def place(state: Column, one: Column) -> Column:
        first = state["at"] + one["gap"]
        tag = F.regexp_replace(one["match"], pattern, F.lit(d.replacement)) if d.custom else F.lit(d.tag)
        span = F.struct(first.alias("start"), (first + one["size"]).alias("stop"), F.lit(d.kind).alias("kind"), tag.alias("tag"))
        return F.struct((first + one["size"]).alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    return F.aggregate(both, start, place, lambda state: state["spans"])


def _with_spans(df: DataFrame, text: str, detectors: Sequence[Detector]) -> DataFrame:
    """Adds ``__spans``, in text order. A detector only runs on texts that can match."""
    nothing = F.array().cast(_SPAN)
    gates = sorted({d.needs for d in detectors if d.needs})
    out = df.withColumn("__text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    out = out.withColumns({f"__{_GATES[g][0]}": F.expr(_GATES[g][1]("__text")) for g in gates})
    out = out.withColumn("__spans", nothing)
    for d in detectors:
        found = _matches(F.col("__text"), d)
        out = out.withColumn("__found", F.when(F.col(f"__{_GATES[d.needs][0]}"), found).otherwise(nothing) if d.needs else found)
        free = F.filter("__found", lambda s: ~F.exists("__spans", lambda k: (k["start"] < s["stop"]) & (s["start"] < k["stop"])))
        out = out.withColumn("__spans", F.when(F.size("__found") > 0, F.concat("__spans", free)).otherwise(F.col("__spans")))
    return out.withColumn("__spans", F.array_sort("__spans"))


def find_spans(df: DataFrame, text: str, keys: Sequence[str], options: Mapping[str, bool] | None = None,
               custom: Sequence[CustomPattern] = ()) -> DataFrame:
    """``keys, type, start, stop``: places (characters of the original text, from 0, ``stop`` excluded) of what is found."""
    out = _with_spans(df.select(*keys, text), text, ordered(options, custom)).withColumn("__spans", F.transform(
        "__spans", lambda s: F.struct(s["kind"].alias("type"), s["start"].alias("start"), s["stop"].alias("stop"))))
    return long_table(out, keys, "__spans", "type")


def redact_specific(df: DataFrame, text: str = "text", options: Mapping[str, bool] | None = None,
                    custom: Sequence[CustomPattern] = ()) -> DataFrame:
    """Replace the text column by its redacted form, specific detectors first; no shuffle, no Python.

    Null texts count as empty, as in ``pii.redact``. A custom tag's references are filled in from its own match, so a
    custom pattern that looks around itself loses them. Work grows with a text's length times its matches.
    """
    out = _with_spans(df, text, ordered(options, custom))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def between(state: Column, stop: Column) -> Column:
        return F.substring(F.col("__text"), state["at"] + 1, stop - state["at"])

    clean = F.when(F.size("__spans") == 0, F.col("__text")).otherwise(F.aggregate(
        "__spans", start, lambda state, s: F.struct(s["stop"].alias("at"), F.concat(
            state["out"], between(state, s["start"]), s["tag"]).alias("out")),
        lambda state: F.concat(state["out"], between(state, F.length("__text")))))
    kept = [F.col(f"`{c}`") for c in df.columns if c != text]
    return out.select(*kept, F.inline(F.array(F.struct(clean.alias(text))))).select(*[F.col(f"`{c}`") for c in df.columns])
