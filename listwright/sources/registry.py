"""The connectors by type, and a run over a catalogue: listings of all sources, and a status row for each of them.

A source's failure costs that source only: an unknown type, a path that isn't there or an answer that can't be read gives
a row with status ``failed`` and the reason, and the other sources go on.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.plans.storage import written
from listwright.sources.cards import html_cards
from listwright.sources.files import feed, manual_csv, manual_json, payload_listings
from listwright.sources.pages import form_positions, json_ld_postings

STATUS = "name string, type string, status string, fetched_count long, error string, duration_ms long"


@dataclass(frozen=True)
class Source:
    """``path``: where the source's answers are stored, as files or, for kinds that read pages, a table (url, html) in
    Parquet. ``settings``: the mapping of an API, the selectors of pages. ``static``: fields that win over the source's."""

    name: str
    type: str
    path: str
    settings: dict = field(default_factory=dict)
    static: dict = field(default_factory=dict)
    enabled: bool = True


def _api(spark: SparkSession, s: Source, now) -> DataFrame:
    answers = spark.read.text(s.path, wholetext=True)
    return payload_listings(answers.select(F.try_parse_json("value").alias("doc"), F.monotonically_increasing_id().alias("page")), s.settings, s.name, now, s.static)


def _manual(spark: SparkSession, s: Source, now) -> DataFrame:
    read = manual_csv if s.settings.get("format") == "csv" else manual_json
    return read(spark, s.path, s.name, now, s.static)


CONNECTORS: dict[str, Callable[[SparkSession, Source, object], DataFrame]] = {
    "api": _api,
    "rss": lambda spark, s, now: feed(spark, s.path, s.name, now, s.static, s.settings.get("format") == "atom"),
    "html": lambda spark, s, now: html_cards(spark.read.parquet(s.path), s.settings, s.name, now, s.static),
    "manual": _manual,
    "teamtailor": lambda spark, s, now: json_ld_postings(spark.read.parquet(s.path), s.name, now, s.static),
    "hrmanager": lambda spark, s, now: form_positions(spark.read.parquet(s.path), s.name, now, s.static),
}


def fetch_sources(spark: SparkSession, sources: Sequence[Source], now, connectors=None) -> tuple[list[DataFrame], DataFrame]:
    """(listings of each source that could be read, in order, for ``gather``; status rows of all enabled ones).

    Each source is one Spark job whose rows are written, so that a failure shows here and later steps read no source
    again. ``connectors`` takes further types beside the known ones; types are known in any case.
    """
    known = CONNECTORS | {k.lower(): v for k, v in (connectors or {}).items()}
    listings, statuses = [], []
    for s in sources:
        if not s.enabled:
            continue
        began, error, n = time.monotonic(), None, 0
        connect = known.get(s.type.lower())
        if connect is None:
            error = f"unsupported source type '{s.type}'"
        else:
            try:
                rows = written(connect(spark, s, now), "fetched")
                n = rows.count()
                listings.append(rows)
            except Exception as e:  # whatever a source does wrong is its own status
                error = (str(e).splitlines() or [type(e).__name__])[0][:500]
        statuses.append((s.name, s.type, "failed" if error else "ok", n, error, int(1000 * (time.monotonic() - began))))
    return listings, spark.createDataFrame(statuses, STATUS)
