
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilake.functions.text import strip


def parse_cascade(raw: Column) -> Column:
    """JSN-01: as it is, else without code fences, else from the first { to the last }, else {"texto_libre": raw}; a VARIANT."""
    bare = strip(F.regexp_replace(F.regexp_replace(raw, r"(?m)^\s*```(?:json)?\s*", ""), r"(?m)\s*```\s*$", ""))
    inner = F.regexp_extract(bare, r"\{[\s\S]*\}", 0)
    free = F.parse_json(F.to_json(F.struct(raw.alias("texto_libre"))))
    return F.coalesce(F.try_parse_json(raw), F.try_parse_json(bare), F.try_parse_json(F.nullif(inner, F.lit(""))), free)


def verdict(raw: Column) -> Column:
    """JSN-02: struct(present, fragment) of a judge's answer; absent by default."""
    value = parse_cascade(raw)
    present = F.coalesce(F.try_variant_get(value, "$.ram_presente", "boolean"), F.lit(False))
    return F.struct(present.alias("present"), F.coalesce(F.try_variant_get(value, "$.fragmento", "string"), F.lit("")).alias("fragment"))


def report_object(raw: Column) -> Column:
    """JSN-03: the object between the first { and the last }, else {"resumen": raw}."""
    inner = F.nullif(F.regexp_extract(raw, r"\{[\s\S]*\}", 0), F.lit(""))
    return F.coalesce(F.try_parse_json(inner), F.parse_json(F.to_json(F.struct(raw.alias("resumen")))))


def or_unavailable(value: Column, structured: bool = False) -> Column:
    """JSN-04: trimmed text, or the indented JSON of a structured value; a fixed sentence for nothing."""
    text = F.when(value.isNotNull(), F.to_json(value, {"pretty": "true", "ignoreNullFields": "false"})) if structured else F.nullif(strip(value), F.lit(""))
    return F.coalesce(text, F.lit("No disponible"))


def compact(value: Column) -> Column:
    """JSN-05: JSON with null fields kept."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def token_usage(usage: Column, header: Column) -> Column:
    """AGG-12: tokens used by the body, else by the response header."""
    return F.coalesce(usage.cast("long"), header.try_cast("long"))
