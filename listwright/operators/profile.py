"""What a search is scored against: a person's profile and the ranking's settings."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

SENIORITIES = ("junior", "mid", "senior", "lead", "any")
REMOTE_PREFERENCES = ("onsite", "hybrid", "remote", "any")


@dataclass(frozen=True)
class Profile:
    name: str = ""
    location: str = ""
    experience_years: int = 0
    target_roles: tuple[str, ...] = ()
    remote_preference: str = "any"
    seniority: str = "any"
    primary_stack: tuple[str, ...] = ()
    secondary_stack: tuple[str, ...] = ()
    domains: tuple[str, ...] = ()
    disqualifiers: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    employment_types: tuple[str, ...] = ()
    country: str | None = None
    region: str | None = None
    metro: tuple[str, ...] = ()
    preferred_companies: tuple[str, ...] = ()

    def city_and_country(self) -> tuple[str | None, str | None]:
        """First and last of the location's comma-separated parts."""
        parts = [p.strip() for p in self.location.split(",") if p.strip()]
        return (parts[0] if parts else None, parts[-1] if len(parts) > 1 else None)


@dataclass(frozen=True)
class Weights:
    primary_stack: float = 0.35
    secondary_stack: float = 0.10
    seniority: float = 0.15
    location_remote: float = 0.25
    domain: float = 0.10
    freshness: float = 0.05

    def total(self) -> float:
        return self.primary_stack + self.secondary_stack + self.seniority + self.location_remote + self.domain + self.freshness


@dataclass(frozen=True)
class TierWeights:
    city: float = 1.0
    metro: float = 0.85
    country: float = 0.6
    region: float = 0.3
    other: float = 0.1


@dataclass(frozen=True)
class JudgeSettings:
    enabled: bool = False
    top_n: int = 50
    weight: float = 0.5


@dataclass(frozen=True)
class Ranking:
    """``freshness_days`` is an e-folding time, though settings call it a half-life."""

    weights: Weights = field(default_factory=Weights)
    disqualifier_penalty: float = 0.0
    top_n: int = 10
    freshness_days: float = 14.0
    min_score: float = 0.0
    max_age_days: int | None = None
    require_primary_hit: bool = False
    adjacency_credit: float = 1.0
    non_engineering_multiplier: float = 0.2
    preferred_boost: float = 1.25
    tiers: TierWeights = field(default_factory=TierWeights)
    judge: JudgeSettings = field(default_factory=JudgeSettings)

    def problems(self) -> list[str]:
        """What a checker would warn of."""
        found = []
        if abs(self.weights.total() - 1) > 0.01:
            found.append(f"weights sum to {self.weights.total():.3f}, not 1")
        if self.top_n <= 0:
            found.append("top_n must be positive")
        if self.freshness_days <= 0:
            found.append("freshness days must be positive")
        if not 0 <= self.min_score <= 1:
            found.append("min score must lie between 0 and 1")
        return found


def upsert_profile(old: Profile, **given) -> Profile:
    """``given`` over ``old``: lists are trimmed and lose blanks, None keeps the old value, but country and region are
    replaced, None clearing them. Name, location and the two choices must not end up blank or unknown."""
    changed = {}
    for k, v in given.items():
        if k in ("country", "region"):
            changed[k] = v.strip() if v and v.strip() else None
        elif v is not None:
            changed[k] = tuple(x.strip() for x in v if x and x.strip()) if isinstance(v, (list, tuple)) else v
    changed.setdefault("country", None)
    changed.setdefault("region", None)
    new = replace(old, **changed)
    if not new.name.strip() or not new.location.strip():
        raise ValueError("a profile needs a name and a location")
    if new.seniority not in SENIORITIES or new.remote_preference not in REMOTE_PREFERENCES:
        raise ValueError("unknown seniority or remote preference")
    return new
