"""Durations of a run's phases, attempts, and the fold of progress events into run records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listwright.plans.storage import discard, written

# fixed values: the phases in order
PHASES = ("pending", "fetching", "deduping", "ranking", "llmJudging", "writing", "done")


# fixed values: the phase that an event puts a run into, and the events that end it
PHASE_OF = {
    "running": "fetching",
    "started": "fetching",
    "provider_running": "fetching",
    "provider_done": "fetching",
    "provider_failed": "fetching",
    "dedupe": "deduping",
    "llm_judging": "llmJudging",
    "rank": "ranking",
    "complete": "writing",
    "succeeded": "done",
}
TERMINAL = ("succeeded", "failed", "cancelled")


def phase_order(phase: Column) -> Column:
    """Position of a phase; null for an unknown one."""
    return F.nullif(F.array_position(F.array(*[F.lit(p) for p in PHASES]), phase), F.lit(0))


def reached(phase: Column, target: str) -> Column:
    return F.coalesce(phase_order(phase) >= PHASES.index(target) + 1, F.lit(False))


def attempt_events(events: DataFrame, runs: DataFrame) -> DataFrame:
    """The events of each run's current attempt; all of them where no start of it is known."""
    started = runs.select("run_id", "attempt_started_at")
    return events.join(started, "run_id", "left").where("attempt_started_at is null or ts >= attempt_started_at").drop("attempt_started_at")


def phase_durations(events: DataFrame, runs: DataFrame) -> DataFrame:
    """(``run_id``, ``phase``, ``duration_ms``): from a phase's first event to that of the next phase in order that
    occurred; the last one ends with the run. Negative and open spans are dropped, pending is ignored."""
    first = events.where("phase <> 'pending'").withColumn("order_", phase_order(F.col("phase"))).where("order_ is not null and ts is not null")
    first = first.groupBy("run_id", "phase", "order_").agg(F.min("ts").alias("began"))
    nxt = F.lead("began").over(Window.partitionBy("run_id").orderBy("order_"))
    spans = first.withColumn("next_", nxt).join(runs.select("run_id", "finished_at"), "run_id", "left")
    took = (F.unix_micros(F.coalesce("next_", "finished_at")) - F.unix_micros("began")) / 1000
    return spans.select("run_id", "phase", took.cast("long").alias("duration_ms")).where("duration_ms >= 0")


def take_pages(pages: DataFrame, size: int | None = None, max_pages: int | None = None) -> DataFrame:
    """Of fetched (source, page, item_id) rows those that a page walk keeps: it stops before an empty page and after
    one that adds nothing new or is short, or at the page budget. ``item_id`` is null for an empty page."""
    ids = Window.partitionBy("source", "item_id").orderBy("page")
    rows = pages.withColumn("new_", F.col("item_id").isNotNull() & (F.row_number().over(ids) == 1))
    each = rows.groupBy("source", "page").agg(F.count("item_id").alias("n_"), F.count_if("new_").alias("added_"))
    short = F.col("n_") < size if size else F.lit(False)
    stops = (F.col("n_") == 0) | (F.col("added_") == 0) | short
    before = Window.partitionBy("source").orderBy("page")
    each = each.withColumn("at_", F.row_number().over(before)).withColumn("stopped_", F.coalesce(F.max(stops).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    if max_pages is not None:
        each = each.where(F.col("at_") <= max_pages)
    keep = each.where("not stopped_ and n_ > 0").select("source", "page")
    return rows.join(keep, ["source", "page"], "left_semi").where("new_").drop("new_")


def breaker_state(calls: DataFrame, threshold: int = 3) -> DataFrame:
    """Calls (host, seq, ok) with ``failures``, how many in a row failed up to and including it, and ``skipped``: an
    earlier row of ``threshold`` failures has opened the host's breaker.

    Calls are dealt by ranges of (host, seq), so a host with most of the calls is cut into many. A range is first seen by
    itself; the failures that it ends with are carried into the host's next ranges, which are few, and only then its rows
    are counted. No window spans more than a range of calls, or the ranges of a host. Calls
    without a host are those of one more host.
    """
    # null hosts are one host, which joins would lose
    keyed = calls.withColumn("host_", F.coalesce(F.concat(F.lit("="), "host"), F.lit("")))
    ranges = keyed.repartitionByRange("host_", "seq")
    placed = written(ranges.withColumn("range_", F.spark_partition_id()), "ranges")
    here = Window.partitionBy("host_", "range_").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = placed.withColumn("island_", F.sum(F.col("ok").cast("long")).over(here))
    # what a range leaves to the next: its last failures, and whether these are all of it
    left = placed.groupBy("host_", "range_").agg(F.max(F.when(F.col("ok"), F.col("seq"))).alias("last_ok"), F.count("*").alias("n_"))
    since = placed.join(left, ["host_", "range_"]).where("last_ok is null or seq > last_ok").groupBy("host_", "range_").agg(F.count("*").alias("trailing"))
    left = left.join(since, ["host_", "range_"], "left").select("host_", "range_", F.coalesce("trailing", F.lit(0)).alias("trailing"), F.col("last_ok").isNotNull().cast("int").alias("breaks"))
    upto = Window.partitionBy("host_").orderBy("range_")
    left = left.withColumn("since_", F.sum("breaks").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    run = F.sum("trailing").over(Window.partitionBy("host_", "since_").orderBy("range_").rowsBetween(Window.unboundedPreceding, 0))
    left = left.withColumn("run_", run).select("host_", "range_", F.coalesce(F.lag("run_").over(upto), F.lit(0)).alias("carried"))
    within = Window.partitionBy("host_", "range_", "island_").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    own = F.sum((~F.col("ok")).cast("long")).over(within)
    rows = rows.join(left, ["host_", "range_"]).withColumn("failures", own + F.when(F.col("island_") == 0, F.col("carried")).otherwise(0))
    counted = written(rows.drop("island_", "carried"), "counted")
    opened = counted.groupBy("host_", "range_").agg(F.min(F.when(F.col("failures") >= threshold, F.col("seq"))).alias("first_"))
    opened = opened.select("host_", "range_", F.min("first_").over(upto.rowsBetween(Window.unboundedPreceding, 0)).alias("opened_at"))
    discard(placed)
    return counted.join(opened, ["host_", "range_"]).withColumn("skipped", F.coalesce(F.col("seq") > F.col("opened_at"), F.lit(False))).drop("host_", "range_", "opened_at")


def fold_runs(events: DataFrame) -> DataFrame:
    """Run records from progress events (run_id, seq, ts, type, provider, count, error, duration_ms, score), in batch.

    Latest-of and sum-of aggregates stand for the ordered fold: a run is over at its first terminal event, and later
    events are rejected (``rejected``). A source's last status counts; counts come from the last event of their kind.
    """
    terminal = F.col("type").isin(*TERMINAL)
    order = Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = events.withColumn("over_", F.coalesce(F.max(terminal.cast("int")).over(order) == 1, F.lit(False)))
    live = ~F.col("over_")
    last = lambda value, cond: F.max_by(value, F.when(cond & live, F.col("seq")))
    kind = F.col("type")
    phase = F.try_element_at(F.create_map(*[F.lit(x) for pair in PHASE_OF.items() for x in pair]), kind)
    state = F.when(kind == "running", "running").when(terminal, kind)
    runs = rows.groupBy("run_id").agg(
        F.coalesce(last(state, state.isNotNull()), F.lit("queued")).alias("state"),
        F.coalesce(last(phase, phase.isNotNull()), F.lit("pending")).alias("phase"),
        F.count_if((kind == "running") & live).alias("attempt"),
        F.min(F.when((kind == "running") & live, F.col("ts"))).alias("started_at"),
        F.max(F.when((kind == "running") & live, F.col("ts"))).alias("attempt_started_at"),
        F.min(F.when(terminal & live, F.col("ts"))).alias("finished_at"),
        F.max(F.when(live, F.col("ts"))).alias("last_heartbeat"),
        last(F.col("count"), kind == "dedupe").alias("deduped_count"),
        last(F.col("count"), kind == "rank").alias("ranked_count"),
        last(F.col("count"), kind.isin("rank", "complete", "succeeded")).alias("shortlist_count"),
        last(F.col("score"), kind.isin("rank", "complete", "succeeded")).alias("top_score"),
        last(F.col("error"), kind == "failed").alias("error"),
        F.count_if(live).alias("events"),
        F.count_if(F.col("over_")).alias("rejected"),
    )
    status = F.when(kind == "provider_running", "running").when(kind == "provider_done", "ok").when(kind == "provider_failed", "failed")
    sources = rows.where(status.isNotNull() & live & F.col("provider").isNotNull()).groupBy("run_id", "provider")
    sources = sources.agg(F.max_by(F.struct(status.alias("status"), F.col("count").alias("n")), "seq").alias("s"))
    totals = sources.groupBy("run_id").agg(
        F.sum(F.when(F.col("s.status") == "ok", F.coalesce("s.n", F.lit(0))).otherwise(0)).alias("fetched_count"),
        F.count_if(F.col("s.status") == "ok").alias("providers_ok"),
        F.count_if(F.col("s.status") == "failed").alias("providers_failed"),
        F.count_if(F.col("s.status") == "running").alias("providers_running"),
    )
    counts = ["fetched_count", "providers_ok", "providers_failed", "providers_running"]
    return runs.join(totals, "run_id", "left").fillna(0, counts)
