"""Dotted paths into JSON, templates, and lenient reading of a model's JSON answers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from listwright.functions import text as T

# fixed values
SENIORITIES = ("junior", "mid", "senior", "lead", "any")
REMOTE_PREFERENCES = ("onsite", "hybrid", "remote", "any")
MAX_YEARS = 60


def walk(value: Column, path: str | None) -> Column:
    """The variant at a dotted path. A numeric segment indexes an array, or names a key of an object; a miss is null."""
    found = value
    for part in [p for p in (path or "").split(".") if p]:
        key = F.try_variant_get(found, "$['" + part.replace("'", "\\'") + "']", "variant")
        if part.isdigit():
            key = F.coalesce(F.try_variant_get(found, f"$[{part}]", "variant"), key)
        found = key
    return found


def scalar(value: Column) -> Column:
    """Strings, numbers and booleans as text; null for objects, arrays and null. Booleans read True and False."""
    kind = F.schema_of_variant(value)
    plain = F.try_variant_get(value, "$", "string")
    return (
        F.when(value.isNull() | (kind == "VOID") | F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY")), F.lit(None).cast("string"))
        .when(kind == "BOOLEAN", F.initcap(plain))
        .otherwise(plain)
    )


def read(value: Column, path: str | None) -> Column:
    return scalar(walk(value, path))


def render(template: str, value: Column) -> Column:
    """``{path}`` replaced by what the path holds; empty where it holds nothing."""
    parts = []
    for literal, path in re.findall(r"([^{}]*)(?:\{([^{}]*)\})?", template):
        if literal:
            parts.append(F.lit(literal))
        if path:
            parts.append(F.coalesce(read(value, path), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def verdict(raw: Column) -> tuple[Column, Column]:
    """(score within 0 to 1, reason) of a judge's answer: strict JSON, perhaps fenced, else the first object that looks
    like one; null without."""
    body = T.fenced(F.trim(raw))
    doc = F.try_parse_json(body)
    score = F.try_variant_get(doc, "$.score", "double")
    strict_reason = F.when(F.schema_of_variant(F.try_variant_get(doc, "$.reason", "variant")) == "STRING", F.try_variant_get(doc, "$.reason", "string"))
    loose = r'(?s)\{[^}]*"score"\s*:\s*([0-9.]+)[^}]*"reason"\s*:\s*"([^"]*)"[^}]*\}'
    loose_score = F.regexp_extract(body, loose, 1).try_cast("double")
    number = F.coalesce(score, loose_score)
    said = F.when(score.isNotNull(), F.coalesce(strict_reason, F.lit(""))).when(loose_score.isNotNull(), F.regexp_extract(body, loose, 2))
    return F.when(number < 0, 0.0).when(number > 1, 1.0).otherwise(number), said


def profile_answer(raw: Column) -> Column:
    """A struct of an extracted profile; each field is read by itself, and one that doesn't fit is null (a list empty)."""
    body = T.fenced(F.trim(raw))
    doc = F.coalesce(F.try_parse_json(body), F.try_parse_json(T.braces(body)))
    doc = F.when(F.startswith(F.schema_of_variant(doc), F.lit("OBJECT")), doc)
    at = lambda name: F.try_variant_get(doc, f"$.{name}", "variant")
    kind = lambda v: F.schema_of_variant(v)

    def string(name):
        return F.nullif(F.trim(F.when(kind(at(name)) == "STRING", F.try_variant_get(doc, f"$.{name}", "string"))), F.lit(""))

    def choice(name, allowed):
        low = F.lower(string(name))
        return F.when(low.isin(*allowed), low)

    def many(name):
        one = F.array(string(name))
        items = F.transform(F.try_variant_get(doc, f"$.{name}", "array<variant>"), lambda v: F.when(kind(v) == "STRING", F.trim(F.try_variant_get(v, "$", "string"))))
        listed = F.when(F.startswith(kind(at(name)), F.lit("ARRAY")), items).when(kind(at(name)) == "STRING", one)
        return F.coalesce(F.filter(listed, lambda s: s.isNotNull() & (s != "")), F.array().cast("array<string>"))

    years = F.try_variant_get(doc, "$.experienceYears", "double")
    numeric = ~kind(at("experienceYears")).isin("STRING", "BOOLEAN")
    fields = [string(n).alias(n) for n in ("name", "location", "country", "region")]
    fields += [many("metro").alias("metro"), F.when(numeric & years.between(0, MAX_YEARS), F.rint(years).cast("int")).alias("experienceYears")]
    fields += [choice("seniority", SENIORITIES).alias("seniority"), choice("remotePreference", REMOTE_PREFERENCES).alias("remotePreference")]
    fields += [many(n).alias(n) for n in ("targetRoles", "primaryStack", "secondaryStack", "domains", "languages", "employmentTypes")]
    return F.when(doc.isNotNull(), F.struct(*fields))
