"""Scoring of listings against a profile, as one projection: no join, no shuffle, no Python.

The profile is compiled to literals when the plan is built, so every pattern is constant for the optimizer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.functions import dates, text
from listwright.operators.profile import Profile, Ranking, TierWeights

COMPONENTS = (
    "primary_stack",
    "secondary_stack",
    "seniority",
    "location_remote",
    "domain",
    "freshness",
    "disqualifier_penalty",
    "non_engineering_title_penalty",
    "preferred_company_bonus",
)
LEVELS = ("junior", "mid", "senior", "lead")

# --- fixed values -------------------------------------------------------------------------------------------------
WORLDWIDE = ("worldwide", "anywhere", "global")
EUROPE_REGIONS = ("eu", "europe", "emea", "eea")
EUROPE_WORDS = ("europe", "european", "emea", "eea", "nordic", "scandinavia")
EUROPE_STATES = (
    "austria", "belgium", "bulgaria", "croatia", "cyprus", "czech republic", "czechia", "denmark", "estonia", "finland",
    "france", "germany", "greece", "hungary", "iceland", "ireland", "italy", "latvia", "liechtenstein", "lithuania",
    "luxembourg", "malta", "netherlands", "norway", "poland", "portugal", "romania", "slovakia", "slovenia", "spain",
    "sweden", "switzerland",
)
CAPITAL_SUBURBS = (
    "brøndby", "albertslund", "ballerup", "dragør", "farum", "gentofte", "gladsaxe", "glostrup", "herlev", "hvidovre",
    "høje-taastrup", "ishøj", "lyngby-taarbæk", "rødovre", "tårnby", "vallensbæk",
)
# names of one place stand for each other
SAME_PLACE = (("copenhagen", "københavn", "kbh", "cph"), ("aarhus", "århus"), ("aalborg", "ålborg"), ("helsingør", "elsinore"))
# an area stands for its own other names and the places in it
AREAS = {
    "greater copenhagen": ("storkøbenhavn", "københavn", "copenhagen", *CAPITAL_SUBURBS),
    "storkøbenhavn": ("greater copenhagen", "københavn", "copenhagen", *CAPITAL_SUBURBS),
    "hovedstaden": ("capital region", "københavn", "copenhagen", *CAPITAL_SUBURBS),
}
# ------------------------------------------------------------------------------------------------------------------


def place_names(place: str) -> list[str]:
    """A place and what else it is called, lower-case."""
    low = place.strip().lower()
    same = next((names for names in SAME_PLACE if low in names), ())
    return list(dict.fromkeys([low, *same, *AREAS.get(low, ())]))


def _any_token(place: Column, names) -> Column:
    found = F.lit(False)
    for n in names:
        found = found | text.contains_token(place, n)
    return found


def location_tier(location: Column, profile: Profile, tiers: TierWeights) -> tuple[Column, Column]:
    """(weight, whether city or metro matched); both null without a location."""
    low = F.lower(location)
    city, last_part = profile.city_and_country()
    rules = [(text.contains_any(low, WORLDWIDE), tiers.city, True)]
    if city:
        rules.append((_any_token(low, place_names(city)), tiers.city, True))
    for m in profile.metro:
        if m and m.strip():
            rules.append((_any_token(low, place_names(m)), tiers.metro, True))
    country = profile.country if profile.country and profile.country.strip() else last_part
    if country:
        rules.append((text.contains_token(low, country.lower()), tiers.country, False))
    if profile.region and profile.region.strip():
        region = profile.region.lower()
        inside = text.contains_token(low, region)
        if region in EUROPE_REGIONS:
            inside = inside | text.contains_any(low, EUROPE_WORDS) | _any_token(low, ("eu", *EUROPE_STATES))
        rules.append((inside, tiers.region, False))
    weight, match = F, F
    for rule, w, m in rules:
        weight, match = weight.when(rule, F.lit(float(w))), match.when(rule, F.lit(m))
    known = ~text.blank(location)
    return F.when(known, weight.otherwise(F.lit(float(tiers.other)))), F.when(known, match.otherwise(F.lit(False)))


def remote_fit(mode: Column, preference: str) -> Column:
    """1 for the same mode, a half for those next to each other, else 0."""
    half = {"hybrid": ("remote",), "remote": ("hybrid",), "onsite": ("hybrid",)}.get(preference, ())
    return F.when(mode == preference, 1.0).when(mode.isin(*half) if half else F.lit(False), 0.5).otherwise(0.0)


def remote_match(mode: Column, preference: str) -> Column:
    """Null where the mode is unknown."""
    return F.when(mode != "unknown", F.lit(True) if preference == "any" else mode == preference)


def location_remote(location: Column, mode: Column, profile: Profile, tiers: TierWeights) -> tuple[Column, Column]:
    """(score, location match) from tier and remote fit together."""
    if profile.remote_preference == "any":
        return F.lit(1.0), F.lit(None).cast("boolean")
    tier, match = location_tier(location, profile, tiers)
    fit = remote_fit(mode, profile.remote_preference)
    score = (
        F.when(tier.isNull(), fit)
        .when(mode == "unknown", tier)
        .when(mode == "remote", fit * F.when(tier >= tiers.region, 1.0).otherwise(tier))
        .otherwise(fit * tier)
    )
    return score, match


def seniority_fit(level: Column, wanted: str, credit: float) -> tuple[Column, Column, Column]:
    """(score, match, whether only adjacent)."""
    if wanted == "any":
        return F.lit(1.0), F.lit(True), F.lit(False)
    at = LEVELS.index(wanted)
    near = [LEVELS[i] for i in (at - 1, at + 1) if 0 <= i < len(LEVELS)]
    adjacent = F.coalesce(level.isin(*near), F.lit(False))
    score = F.when(level.isNull(), 0.5).when(level == wanted, 1.0).when(adjacent, float(credit)).otherwise(0.0)
    return score, F.when(level.isNotNull(), (level == wanted) | adjacent), adjacent


def _share(hits: Column, declared: int) -> Column:
    """Hits by keywords declared, repeated ones included."""
    return F.size(hits) / F.lit(float(declared)) if declared else F.lit(0.0)


def score_listings(listings: DataFrame, profile: Profile, ranking: Ranking, now) -> DataFrame:
    """``listings`` (title, company, location, remote_mode, description, posted_at, ...) with ``score``, ``breakdown``
    (a struct of ``COMPONENTS``, which add up to the score before clamping) and ``reasoning``."""
    c, now = F.col, F.lit(now).cast("timestamp") if not isinstance(now, Column) else now
    corpus = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("description", F.lit("")))
    head = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("company", F.lit("")))
    score_level, level_match, adjacent = seniority_fit(c("level_"), profile.seniority, ranking.adjacency_credit)
    place, place_match = location_remote(c("location"), c("remote_mode"), profile, ranking.tiers)
    w = ranking.weights
    # the text is cut into words once, for all lists of keywords
    found = text.found_terms([*profile.primary_stack, *profile.secondary_stack, *profile.domains], corpus)
    seen = {
        "found_": found,
        "barred_": text.keyword_hits(profile.disqualifiers, head),
        "preferred_": text.keyword_hits(profile.preferred_companies, c("company")),
        "level_": text.seniority(c("title"), c("description")),
        "off_title_": text.non_engineering_title(c("title")),
        "place_": place,
        "place_match_": place_match,
    }
    # columns of a generator aren't copied into what reads them, so every listing is looked at once, whatever comes after
    out = listings.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in seen.items()]))))
    out = out.withColumns(
        {
            "primary_": text.spelled(profile.primary_stack, c("found_")),
            "secondary_": text.spelled(profile.secondary_stack, c("found_")),
            "domain_": text.spelled(profile.domains, c("found_")),
        }
    )
    parts = {
        "primary_stack": _share(c("primary_"), len(profile.primary_stack)) * w.primary_stack,
        "secondary_stack": _share(c("secondary_"), len(profile.secondary_stack)) * w.secondary_stack,
        "seniority": score_level * w.seniority,
        "location_remote": c("place_") * w.location_remote,
        "domain": _share(c("domain_"), len(profile.domains)) * w.domain,
        "freshness": dates.freshness(c("posted_at"), now, ranking.freshness_days) * w.freshness,
    }
    out = out.withColumns({f"p_{k}": v for k, v in parts.items()} | {"level_match_": level_match, "adjacent_": adjacent, "remote_match_": remote_match(c("remote_mode"), profile.remote_preference)})
    total = None
    for k in parts:
        total = c(f"p_{k}") if total is None else total + c(f"p_{k}")
    out = out.withColumn("sum_", total)
    out = out.withColumn("barred_sum_", F.when(F.size("barred_") > 0, c("sum_") * ranking.disqualifier_penalty).otherwise(c("sum_")))
    out = out.withColumn("titled_", F.when(c("off_title_"), c("barred_sum_") * ranking.non_engineering_multiplier).otherwise(c("barred_sum_")))
    out = out.withColumn("boosted_", F.when(F.size("preferred_") > 0, F.least(c("titled_") * ranking.preferred_boost, F.lit(1.0))).otherwise(c("titled_")))
    breakdown = F.struct(
        *[c(f"p_{k}").alias(k) for k in parts],
        (c("barred_sum_") - c("sum_")).alias("disqualifier_penalty"),
        (c("titled_") - c("barred_sum_")).alias("non_engineering_title_penalty"),
        (c("boosted_") - c("titled_")).alias("preferred_company_bonus"),
    )
    reasoning = F.struct(
        c("primary_").alias("primary_stack_hits"),
        c("secondary_").alias("secondary_stack_hits"),
        c("domain_").alias("domain_hits"),
        c("level_match_").alias("seniority_match"),
        c("place_match_").alias("location_match"),
        c("remote_match_").alias("remote_match"),
        c("barred_").alias("disqualifier_hits"),
        notes(ranking, now).alias("notes"),
    )
    return out.select(*[F.col(f"`{x}`") for x in listings.columns], F.least(F.greatest("boosted_", F.lit(0.0)), F.lit(1.0)).alias("score"), breakdown.alias("breakdown"), reasoning.alias("reasoning"))


def notes(ranking: Ranking, now: Column) -> Column:
    """The sentences that explain a score, from the intermediate columns of ``score_listings``."""
    c = F.col
    listed = lambda head, hits: F.concat(F.lit(head), F.array_join(hits, ", "), F.lit("."))
    age = F.greatest(dates.age_days(c("posted_at"), now), F.lit(0.0))
    place, remote = c("place_match_"), c("remote_match_")
    where = (
        F.when(place, F.concat(F.lit("Location: "), c("location"), F.lit(".")))
        .when(remote, F.concat(F.lit("Remote work OK ("), c("remote_mode"), F.lit(").")))
        .when(place.isNull() & remote.isNull(), "Location and remote setup not stated.")
        .when(remote.isNull(), "Location doesn't match; remote setup not stated.")
        .when(place.isNull(), "Location not stated; remote setup doesn't match.")
        .otherwise("Neither location nor remote setup matches.")
    )
    level = (
        F.when(c("level_match_").isNull(), "Experience level not stated.")
        .when(~c("level_match_"), "Experience level doesn't match.")
        .when(c("adjacent_"), "Experience level close fit.")
        .otherwise("Experience level matches.")
    )
    off_title = c("off_title_") & F.lit(ranking.non_engineering_multiplier < 1.0)
    sentences = F.concat_ws(
        " ",
        F.when(F.size("primary_") > 0, listed("Must-have skill match: ", c("primary_"))).otherwise("None of your must-have skills mentioned."),
        F.when(F.size("secondary_") > 0, listed("Also matches: ", c("secondary_"))),
        F.when(F.size("domain_") > 0, listed("Industry: ", c("domain_"))),
        level,
        F.when(off_title, "Title doesn't look like a developer role — rating reduced."),
        where,
        F.when(age > 2 * ranking.freshness_days, F.concat(F.lit("Posted "), dates.rounded(age).cast("string"), F.lit(" days ago — rating reduced for age."))),
    )
    return F.when(F.size("barred_") > 0, listed("Removed because of: ", c("barred_"))).otherwise(sentences)


def unpivot_breakdown(scored: DataFrame, *keys: str) -> DataFrame:
    """(keys..., ``position``, ``component``, ``value``): a row for each component, in order."""
    pairs = F.array(*[F.struct(F.lit(k).alias("component"), F.col(f"breakdown.{k}").alias("value")) for k in COMPONENTS])
    return scored.select(*keys, F.posexplode(pairs).alias("position", "pair")).select(*keys, "position", "pair.*")


def component_shares(scored: DataFrame, *keys: str) -> DataFrame:
    """Positive components in percent of their sum, which counts as 0.001 at least."""
    positive = [F.greatest(F.col(f"breakdown.{k}"), F.lit(0.0)) for k in COMPONENTS]
    total = F.greatest(sum(positive[1:], positive[0]), F.lit(0.001))
    pairs = F.array(*[F.struct(F.lit(k).alias("component"), (p / total * 100).alias("percent")) for k, p in zip(COMPONENTS, positive)])
    return scored.select(*keys, F.explode(pairs).alias("pair")).select(*keys, "pair.*")
