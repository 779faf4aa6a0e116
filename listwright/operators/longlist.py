"""Queries over all scored rows of a run: filters, sorting and facets."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import parse_qs, urlencode

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.functions import dates

SORT_KEYS = ("title", "company", "portal", "location", "posted", "score")
POSTED_DAYS = {"24h": 1, "7d": 7, "14d": 14, "30d": 30}
MARK_CHOICES = ("all", "good", "bad", "unmarked")


def clamp01(value: float) -> float:
    return max(0.0, min(1.0, value))


@dataclass(frozen=True)
class LonglistFilter:
    q: str = ""
    portals: tuple[str, ...] = ()
    stack_hits: tuple[str, ...] = ()
    posted: str = "any"
    score_min: float = 0.0
    score_max: float = 1.0
    mark: str = "all"
    shortlist_only: bool = False
    sort: str = "score"
    descending: bool = True

    def to_query(self) -> str:
        """Only what differs from the default."""
        base, items = LonglistFilter(), []
        for key in ("q", "posted", "mark", "sort"):
            if getattr(self, key) != getattr(base, key):
                items.append((key, getattr(self, key)))
        items += [(k, ",".join(v)) for k, v in (("portals", self.portals), ("stack", self.stack_hits)) if v]
        items += [(k, f"{v:g}") for k, v, d in (("min", self.score_min, 0.0), ("max", self.score_max, 1.0)) if v != d]
        if self.shortlist_only:
            items.append(("shortlist", "1"))
        if not self.descending:
            items.append(("dir", "asc"))
        return urlencode(items)

    @classmethod
    def from_query(cls, query: str) -> LonglistFilter:
        """Unknown choices and malformed numbers fall back to the default; scores are clamped."""
        given = {k: v[-1] for k, v in parse_qs(query.lstrip("?")).items()}

        def number(key: str, default: float) -> float:
            try:
                return clamp01(float(given[key]))
            except (KeyError, ValueError):
                return default

        choice = lambda key, allowed, default: given.get(key) if given.get(key) in allowed else default
        many = lambda key: tuple(x for x in given.get(key, "").split(",") if x)
        return cls(
            q=given.get("q", ""),
            portals=many("portals"),
            stack_hits=many("stack"),
            posted=choice("posted", POSTED_DAYS, "any"),
            score_min=number("min", 0.0),
            score_max=number("max", 1.0),
            mark=choice("mark", MARK_CHOICES, "all"),
            shortlist_only=given.get("shortlist") == "1",
            sort=choice("sort", SORT_KEYS, "score"),
            descending=given.get("dir") != "asc",
        )


def longlist(scored: DataFrame, f: LonglistFilter, now, marks: DataFrame | None = None, shortlist: DataFrame | None = None, key: str = "listing_id") -> DataFrame:
    """Scored rows that pass every filter. ``marks`` (key, mark) and ``shortlist`` (key) are joined only if asked for."""
    now = now if isinstance(now, Column) else F.lit(now).cast("timestamp")
    out = scored.where(F.col("score").between(f.score_min, f.score_max))
    if f.q.strip():
        text = F.lower(F.concat(F.col("title"), F.lit(" "), F.coalesce("company", F.lit(""))))
        out = out.where(F.contains(text, F.lit(f.q.strip().lower())))
    if f.portals:
        out = out.where(F.col("portal").isin(*f.portals))
    if f.posted in POSTED_DAYS:
        out = out.where(dates.posted_since(F.col("posted_at"), now, POSTED_DAYS[f.posted]))
    if f.stack_hits:
        hits = F.transform(F.concat("primary_stack_hits", "secondary_stack_hits"), F.lower)
        out = out.where(F.arrays_overlap(hits, F.array(*[F.lit(s.lower()) for s in f.stack_hits])))
    if f.mark == "unmarked":
        out = out.join(marks.where("mark is not null").select(key), key, "left_anti")
    elif f.mark != "all":
        out = out.join(marks.where(F.col("mark") == f.mark).select(key), key, "left_semi")
    if f.shortlist_only:
        out = out.join(shortlist.select(key), key, "left_semi")
    return out


def sorted_longlist(rows: DataFrame, f: LonglistFilter, key: str = "listing_id") -> DataFrame:
    """By one of six keys, words by locale, null as empty; ties by key."""
    columns = {"posted": F.coalesce(F.col("posted_at").cast("string"), F.lit("")), "score": F.col("score")}
    column = columns.get(f.sort)
    if column is None:
        column = F.collate(F.coalesce(F.col(f.sort), F.lit("")), "UNICODE")
    return rows.orderBy(column.desc() if f.descending else column.asc(), key)


def portal_facet(scored: DataFrame) -> DataFrame:
    """(``portal``, ``n``) over all scored rows."""
    return scored.groupBy("portal").agg(F.count("*").alias("n")).orderBy("portal")


def stack_facet(scored: DataFrame) -> DataFrame:
    """(``hit``, ``n``) over all scored rows, commonest first."""
    hits = scored.select(F.explode(F.concat("primary_stack_hits", "secondary_stack_hits")).alias("hit"))
    return hits.groupBy("hit").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "hit")


def drop_reason_facet(dropped: DataFrame) -> DataFrame:
    return dropped.groupBy("drop_reason").agg(F.count("*").alias("n")).orderBy("drop_reason")
