"""A search, end to end: gather, dedupe, score, judge, drop, shortlist, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.functions import text as T
from listwright.operators.dedupe import first_wins, merge_groups
from listwright.operators.profile import Profile, Ranking
from listwright.operators.rank import blend, classify_drops, dropped, shortlist
from listwright.operators.score import COMPONENTS, score_listings
from listwright.plans.storage import written


@dataclass
class SearchResult:
    deduped: DataFrame
    merges: DataFrame
    scored: DataFrame
    shortlist: DataFrame
    dropped: DataFrame


def dedupe_listings(listings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(listings that stay, (seq, canonical) of all): by URL, else by title, company and place."""
    keyed = listings.withColumn("url_key_", T.normalise_url(F.col("url"))).withColumn("place_key_", T.listing_key(F.col("title"), F.col("company"), F.col("location")))
    canonical = first_wins(keyed.select("seq", "url_key_", "place_key_"), "seq", "url_key_", "place_key_")
    kept = canonical.where("seq = canonical").select("seq")
    return listings.join(kept, "seq", "left_semi"), canonical


def search(listings: DataFrame, profile: Profile, ranking: Ranking, now, verdicts: DataFrame | None = None, top_n: int | None = None, min_score: float | None = None) -> SearchResult:
    """``listings`` need ``seq``, their order over all sources. Scores are written once, as both the shortlist and the
    dropped rows read them; descriptions, the bulk of the rows, aren't carried past scoring."""
    deduped, canonical = dedupe_listings(listings)
    scored = score_listings(deduped, profile, ranking, now).drop("description")
    scored = written(scored, "scored")
    if verdicts is not None:
        scored = blend(scored, verdicts, ranking.judge.weight)
    classified = classify_drops(scored, ranking, now, min_score)
    n = ranking.top_n if top_n is None else top_n
    return SearchResult(deduped, merge_groups(canonical), scored, shortlist(classified, n), dropped(classified, n))


def markdown_report(best: DataFrame, title: str) -> str:
    """The shortlist as text; it is as short as ``top_n``."""
    parts = F.array(*[F.struct(F.col(f"breakdown.{k}").alias("value"), F.lit(k).alias("component")) for k in COMPONENTS])
    ordered = F.reverse(F.array_sort(parts))
    rows = best.select("title", "company", "location", "url", "score", "reasoning.notes", ordered.alias("parts")).collect()
    top = max((r["score"] for r in rows), default=0.0)
    lines = [f"# {title}", "", f"{len(rows)} listings, top score {top:.2f}", ""]
    for i, r in enumerate(rows, 1):
        lines += [f"## {i}. {r['title']} — {r['company'] or '?'} ({r['score']:.2f})", "", f"{r['location'] or '?'} · {r['url']}", "", r["notes"], ""]
        lines += [f"- {p['component']}: {p['value']:.3f}" for p in r["parts"] if p["value"]] + [""]
    return "\n".join(lines)


def write_run(result: SearchResult, path: str, run_id: str) -> None:
    """One folder a run under each table, so that a run can be rewritten or dropped by itself."""
    for name in ("deduped", "merges", "scored", "shortlist", "dropped"):
        getattr(result, name).write.mode("overwrite").json(f"{path}/{name}/run_id={run_id}")


def read_runs(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """A table of all runs; rows that can't be read are dropped."""
    return spark.read.schema(f"{schema}, run_id string").option("mode", "DROPMALFORMED").json(f"{path}/{name}")


def run_counts(result: SearchResult) -> DataFrame:
    """One row: how many rows each step left, and the best score."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    out = n(result.deduped, "deduped_count")
    best = result.shortlist.agg(F.count("*").alias("shortlist_count"), F.coalesce(F.max("score"), F.lit(0.0)).alias("top_score"))
    for other in (n(result.scored, "scored_count"), best, n(result.dropped, "dropped_count")):
        out = out.join(F.broadcast(other))  # one row each
    return out
