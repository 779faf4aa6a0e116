"""Sources and their settings: overrides, health, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.sources.detect import endpoint_key

LIMITS = {"max_pages": 50, "page_size": 200, "rate_limit": 10.0}
STALE_DAYS = 14


def merge_overrides(catalogue: DataFrame, state: DataFrame) -> DataFrame:
    """The catalogue (id, enabled, requires_secret, max_pages, page_size, rate_limit, enrich_body) with the user's state
    (id, opted_in, opted_out, has_secret, and the same four settings) laid over it. Opting in beats the catalogue's
    default; a source that needs a secret needs its value; page settings apply only to sources that page."""
    s = state.select("id", *[F.col(c).alias(f"s_{c}") for c in state.columns if c != "id"])
    both = catalogue.join(s, "id", "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    enabled = flag("s_opted_in") | (flag("enabled") & ~flag("s_opted_out"))
    secret = ~flag("requires_secret") | flag("s_has_secret")
    pages = F.col("max_pages").isNotNull()
    over = lambda c, only=None: F.when(only, F.coalesce(f"s_{c}", c)).otherwise(F.col(c)) if only is not None else F.coalesce(f"s_{c}", c)
    return both.select(
        *[c for c in catalogue.columns if c not in ("enabled", "max_pages", "page_size", "rate_limit", "enrich_body")],
        (enabled & secret).alias("enabled"),
        over("max_pages", pages).alias("max_pages"),
        over("page_size", pages).alias("page_size"),
        over("rate_limit").alias("rate_limit"),
        over("enrich_body").alias("enrich_body"),
    )


def checked_overrides(overrides: DataFrame) -> DataFrame:
    """Overrides out of range fail the job."""
    out = overrides
    for c, most in LIMITS.items():
        bad = (F.col(c) <= 0) | (F.col(c) > most)
        out = out.withColumn(c, F.when(bad, F.raise_error(F.lit(f"{c} must be over 0 and at most {most}")).cast(overrides.schema[c].dataType)).otherwise(F.col(c)))
    return out


def upsert_state(state: DataFrame, changes: DataFrame) -> DataFrame:
    """State rows (id, opted_in, opted_out) after toggles (id, enabled): one list gains what the other loses."""
    both = state.join(changes.select("id", F.col("enabled").alias("to_")), "id", "full_outer")
    return both.select(
        "id",
        F.coalesce(F.col("to_"), F.col("opted_in"), F.lit(False)).alias("opted_in"),
        F.coalesce(~F.col("to_"), F.col("opted_out"), F.lit(False)).alias("opted_out"),
    ).where("opted_in or opted_out")


def health(tested_ok: Column, enabled: Column, requires_secret: Column, has_secret: Column, last_run: Column, last_count: Column, now: Column) -> Column:
    """working, failing, blocked, untested or stale; a test in this session counts first."""
    age = (F.unix_micros(now) - F.unix_micros(last_run)) / 864e8
    return (
        F.when(tested_ok, "working")
        .when(~tested_ok, "failing")
        .when(requires_secret & ~F.coalesce(has_secret, F.lit(False)), "blocked")
        .when(last_run.isNull(), "untested")
        .when(age > STALE_DAYS, "stale")
        .when(F.coalesce(last_count, F.lit(0)) > 0, "working")
        .otherwise("failing")
    )


def runnable(enabled: Column, requires_secret: Column, has_secret: Column) -> Column:
    return enabled & (~requires_secret | has_secret)


def hard_ceiling(max_pages: Column, page_size: Column) -> Column:
    """Most rows that a paging source can yield."""
    return max_pages * page_size


def filter_providers(providers: DataFrame, show: str = "all", q: str = "") -> DataFrame:
    """On, off or failing sources whose id, name or display name holds the text."""
    out = providers
    if show == "on":
        out = out.where("enabled")
    elif show == "off":
        out = out.where("not enabled")
    elif show == "failing":
        out = out.where("health = 'failing'")
    if q.strip():
        low = F.lower(F.concat_ws("\n", "id", "name", "display_name"))
        out = out.where(F.contains(low, F.lit(q.strip().lower())))
    return out


def provider_counts(providers: DataFrame) -> DataFrame:
    return providers.agg(
        F.count("*").alias("total"),
        F.count_if("enabled").alias("on"),
        F.count_if(~F.col("enabled")).alias("off"),
        F.count_if(F.col("health") == "failing").alias("failing"),
    )


def duplicate_sources(sources: DataFrame) -> DataFrame:
    """(``type``, ``endpoint_key``, ``n``, ``names``) of endpoints that several sources pull from."""
    keyed = sources.withColumn("endpoint_key", endpoint_key(F.col("endpoint")))
    return keyed.groupBy("type", "endpoint_key").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("name")).alias("names")).where("n > 1")


def field_changes(current: DataFrame, suggested: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """(``key``, ``field``, ``current``, ``suggested``) where a suggestion isn't empty and differs."""
    tall = lambda df, name: df.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(name)) for f in fields])).alias("e")).select(key, "e.*")
    both = tall(suggested, "suggested").where("trim(suggested) <> ''").join(tall(current, "current"), [key, "field"], "left")
    return both.where("current is null or current <> suggested").select(key, "field", "current", "suggested")
