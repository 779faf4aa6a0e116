"""Profile, ranking and catalogue files. They are small and read on the driver when a plan is built."""

from __future__ import annotations

import re

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listwright.operators.profile import REMOTE_PREFERENCES, SENIORITIES, JudgeSettings, Profile, Ranking, TierWeights, Weights

SECTIONS = {
    "primary stack": "primary_stack",
    "secondary stack": "secondary_stack",
    "domains": "domains",
    "disqualifiers": "disqualifiers",
    "preferred companies": "preferred_companies",
}


class SettingsError(ValueError):
    """A settings file lacks a field or holds one of the wrong kind."""


def front_matter(text: str) -> tuple[dict, str]:
    """(fields between the dashes, what follows)."""
    m = re.match(r"﻿?\s*---\s*\n(.*?)\n---\s*(?:\n|$)(.*)", text, re.S)
    if not m:
        return {}, text
    fields = yaml.safe_load(m[1])
    if not isinstance(fields, dict):
        raise SettingsError("the front matter must be a mapping")
    return fields, m[2]


def bullet_sections(body: str) -> dict[str, list[str]]:
    """Lists of the items (``-`` or ``*``) under each second-level heading, names lower-case."""
    out: dict[str, list[str]] = {}
    current = None
    for line in body.splitlines():
        if line.startswith("## "):
            current = out.setdefault(line[3:].strip().lower(), [])
        elif current is not None and (m := re.match(r"\s*[-*] (.*)", line)) and m[1].strip():
            current.append(m[1].strip())
    return out


def parse_profile(text: str) -> Profile:
    fields, body = front_matter(text)

    def need(key: str, kind=str):
        value = fields.get(key)
        if value is None or (kind is str and not str(value).strip()):
            raise SettingsError(f"profile: '{key}' is missing")
        try:
            return kind(str(value).strip())
        except ValueError as e:
            raise SettingsError(f"profile: '{key}' must be {kind.__name__}") from e

    def choice(key: str, allowed):
        value = need(key).lower()
        if value not in allowed:
            raise SettingsError(f"profile: '{key}' must be one of {', '.join(allowed)}")
        return value

    listed = lambda key, default=(): tuple(str(x).strip() for x in fields.get(key) or default if str(x).strip())
    optional = lambda key: str(fields[key]).strip() or None if fields.get(key) is not None else None
    sections = bullet_sections(body)
    return Profile(
        name=need("name"),
        location=need("location"),
        experience_years=need("experience_years", int),
        target_roles=listed("target_roles"),
        remote_preference=choice("remote_preference", REMOTE_PREFERENCES),
        seniority=choice("seniority", SENIORITIES),
        languages=listed("languages"),
        employment_types=listed("employment_types", ("full-time",)),
        country=optional("country"),
        region=optional("region"),
        metro=listed("metro"),
        **{name: tuple(sections.get(title, ())) for title, name in SECTIONS.items()},
    )


def parse_ranking(text: str) -> Ranking:
    raw = yaml.safe_load(text) or {}
    if not isinstance(raw, dict) or not isinstance(raw.get("weights"), dict):
        raise SettingsError("ranking: 'weights' is missing")
    base = Ranking()

    def number(source: dict, key: str, default, kind=float):
        value = source.get(key)
        if value is None:
            return default
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            raise SettingsError(f"ranking: '{key}' must be a number")
        return kind(value)

    weights = Weights(**{k: number(raw["weights"], k, 0.0) for k in Weights.__dataclass_fields__})
    tiers = raw.get("location_tier_weights") or {}
    judge = raw.get("llm") or {}
    return Ranking(
        weights=weights,
        disqualifier_penalty=number(raw, "disqualifier_penalty", base.disqualifier_penalty),
        top_n=number(raw, "top_n", base.top_n, int),
        freshness_days=number(raw, "freshness_half_life_days", base.freshness_days),
        min_score=number(raw, "min_score_to_include", base.min_score),
        max_age_days=number(raw, "max_age_days", None, int),
        require_primary_hit=bool(raw.get("require_primary_stack_hit", False)),
        adjacency_credit=number(raw, "seniority_adjacency_credit", base.adjacency_credit),
        non_engineering_multiplier=number(raw, "non_engineering_title_multiplier", base.non_engineering_multiplier),
        preferred_boost=number(raw, "preferred_company_boost", base.preferred_boost),
        tiers=TierWeights(**{k: number(tiers, "else" if k == "other" else k, getattr(base.tiers, k)) for k in TierWeights.__dataclass_fields__}),
        judge=JudgeSettings(bool(judge.get("enabled", False)), number(judge, "top_n", 50, int), number(judge, "weight", 0.5)),
    )


#: A JSON string, which stays, or what may stand beside it: a comment, a comma before a closing bracket.
_COMMENT = r'(?s)("[^"\\]*+(?:\\.[^"\\]*+)*+")|//[^\n]*|/\*.*?\*/'
_LAST_COMMA = r'(?s)("[^"\\]*+(?:\\.[^"\\]*+)*+")|,(\s*[\]}])'


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Sources of JSON catalogues, with ``ord``: the array ``providers`` of a root object, or a root array. Comments and
    trailing commas are allowed. A repeated id, or a document without sources, fails the job."""
    plain = F.regexp_replace(F.regexp_replace("value", _COMMENT, "$1"), _LAST_COMMA, "$1$2")
    docs = spark.read.text(path, wholetext=True).select(F.monotonically_increasing_id().alias("page"), plain.alias("doc"))
    doc = F.try_parse_json("doc")
    found = F.coalesce(F.try_variant_get(doc, "$.providers", "array<variant>"), F.try_variant_get(doc, "$", "array<variant>"))
    wrong = F.raise_error(F.lit("a catalogue needs a top-level 'providers' array")).cast("array<variant>")
    items = docs.select("page", F.posexplode(F.coalesce(found, wrong)).alias("at", "item"))
    # the columns are those that any source has; their types the ones that hold all values
    kind = items.agg(F.schema_of_variant_agg("item")).first()[0].replace("OBJECT<", "STRUCT<")
    rows = items.select(F.try_variant_get("item", "$", kind).alias("s"), F.monotonically_increasing_id().alias("ord")).select("s.*", "ord")
    n = F.count("*").over(Window.partitionBy("id"))
    return rows.withColumn("id", F.when((n > 1) & F.col("id").isNotNull(), F.raise_error(F.concat(F.lit("duplicate source id "), F.col("id").cast("string"))).cast(rows.schema["id"].dataType)).otherwise(F.col("id")))


def with_ids(rows: DataFrame, order: str = "ord") -> DataFrame:
    """Rows without an id get the next numbers after the largest one, in order."""
    top = rows.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top_"))
    # one row
    numbered = rows.withColumn("n_", F.row_number().over(Window.partitionBy(F.col("id").isNull()).orderBy(order))).join(F.broadcast(top))
    return numbered.withColumn("id", F.coalesce("id", F.col("top_") + F.col("n_"))).drop("top_", "n_")


def read_examples(spark: SparkSession, path: str, note_chars: int = 240) -> DataFrame:
    """Curated examples: YAML front matter and prose, which is collapsed and cut to a note."""
    schema = "polarity string, title string, company string, location string, seniority string, primary_stack array<string>, domains array<string>, employer_type string, note string"

    @F.pandas_udf(schema)
    def parse(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            fields, body = front_matter(text)
            note = " ".join(body.split())
            word = lambda k: (str(fields[k]).strip() or None) if fields.get(k) is not None else None
            many = lambda k: [str(x).strip() for x in fields.get(k) or [] if str(x).strip()]
            rows.append((word("polarity"), word("title"), word("company"), word("location"), word("seniority"), many("primary_stack"), many("domains"), word("employer_type"), (note[:note_chars] + "…" if len(note) > note_chars else note) or None))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])

    files = spark.read.text(path, wholetext=True)
    return files.select(parse("value").alias("e")).select("e.*").where("polarity is not null and title is not null")
