"""Mixing sources to target weights by weighted fair queueing.

Every document of a source, in a shuffled order, gets a virtual finish time: the source's tokens up to and including
it, divided by the source's target. Documents are then taken in order of finish time until the budget is used up.
Built-in functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listwright.llm.common import materialize, own_columns, word_count


@dataclass(frozen=True)
class MixPlan:
    """``weights`` are dealt to the sources in code-point order, null last, repeating. ``share``: of all tokens, to
    be spent. ``max_copies``: how often a document may be taken. ``rows_per_bucket``: of one sorted run."""

    weights: tuple[float, ...] = (5, 2, 1)
    share: float = 1.5
    max_copies: int = 2
    rows_per_bucket: int = 4096
    seed: int = 7


def source_targets(sized: DataFrame, plan: MixPlan = MixPlan()) -> DataFrame:
    """One row per source: ``lw_source``, ``lw_source_size``, ``lw_source_rows``, ``lw_target``.

    Sharing the excess again and again until no target is above its cap ends where all uncapped sources have one
    level: target = weight x level. Sorted by cap / weight, a source is capped exactly while the level that its
    predecessors leave is at least its own ratio.
    """
    sources = sized.groupBy("lw_source").agg(F.sum("lw_size").alias("lw_source_size"), F.count("*").alias("lw_source_rows"))
    rank = F.row_number().over(Window.orderBy(F.col("lw_source").asc_nulls_last())) - 1
    weights = F.array(*[F.lit(float(w)) for w in plan.weights])
    sources = sources.withColumn("lw_rank", rank).withColumn("lw_weight", weights[F.col("lw_rank") % len(plan.weights)])
    sources = sources.withColumn("lw_cap", F.col("lw_source_size").cast("double") * plan.max_copies)
    sources = sources.withColumn("lw_ratio", F.col("lw_cap") / F.col("lw_weight"))
    everything = Window.partitionBy()
    before = Window.orderBy("lw_ratio", "lw_rank").rowsBetween(Window.unboundedPreceding, -1)
    budget = plan.share * F.sum("lw_source_size").over(everything)
    level = (budget - F.coalesce(F.sum("lw_cap").over(before), F.lit(0.0))) / (
        F.sum("lw_weight").over(everything) - F.coalesce(F.sum("lw_weight").over(before), F.lit(0.0))
    )
    sources = sources.withColumn("lw_level", level).withColumn("lw_capped", F.col("lw_level") >= F.col("lw_ratio"))
    common = F.max(F.when(~F.col("lw_capped"), F.col("lw_level"))).over(everything)
    target = F.when(F.col("lw_capped"), F.col("lw_cap")).otherwise(F.col("lw_weight") * common)
    return sources.select("lw_source", "lw_source_size", "lw_source_rows", target.alias("lw_target"))


def _queued(sized: DataFrame, targets: DataFrame, plan: MixPlan) -> DataFrame:
    """Rows with ``lw_cum``: tokens of the source up to and including the row, in shuffled order.

    A source's order is cut into runs of about ``rows_per_bucket`` rows; a run is summed by itself and starts from
    what the runs before it hold, so a source with a third of all rows is spread like any other.
    """
    digest = F.md5(F.concat(F.lit(f"{plan.seed}:"), F.coalesce(F.col("lw_id").cast("string"), F.lit(""))))
    key = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")  # 60 bits
    rows = sized.join(targets, sized["lw_source"].eqNullSafe(targets["lw_source"])).drop(targets["lw_source"])
    rows = rows.withColumn("lw_key", key).withColumn(
        "lw_run", F.floor(F.shiftright("lw_key", 36) * F.ceil(F.col("lw_source_rows") / plan.rows_per_bucket) / F.lit(1 << 24)).cast("long")
    )
    sums = rows.groupBy("lw_source", "lw_run").agg(F.sum("lw_size").alias("lw_run_size"))
    earlier = Window.partitionBy("lw_source").orderBy("lw_run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(sums.withColumn("lw_offset", F.coalesce(F.sum("lw_run_size").over(earlier), F.lit(0))).drop("lw_run_size"), "offsets")
    rows = rows.join(offsets, rows["lw_source"].eqNullSafe(offsets["lw_source"]) & (rows["lw_run"] == offsets["lw_run"]))
    rows = rows.drop(offsets["lw_source"]).drop(offsets["lw_run"])
    run = Window.partitionBy("lw_source", "lw_run").orderBy("lw_key", "lw_id", "lw_size", "lw_text_hash")
    cum = F.col("lw_offset") + F.sum("lw_size").over(run.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("lw_cum", cum).drop("lw_run", "lw_offset")


def _finish(copy: int):
    """Null where the source has no words: nothing of it is ever taken."""
    return F.try_divide(F.col("lw_source_size") * copy + F.col("lw_cum"), F.col("lw_target"))


def _mix(docs: DataFrame, id: str, source: str, text: str, plan: MixPlan, carry: bool) -> DataFrame:
    """The mix over (``lw_own``, where carried, and the operator's columns)."""
    own = [F.struct(*own_columns(docs)).alias("lw_own")] if carry else []
    names = F.col(id).alias("lw_id"), F.col(source).alias("lw_source"), word_count(F.col(text)).alias("lw_size"), F.xxhash64(text).alias("lw_text_hash")
    sized = docs.select(*own, *names)
    narrow = materialize(sized.select("lw_id", "lw_source", "lw_size", "lw_text_hash"), "sizes")
    targets = materialize(source_targets(narrow, plan), "targets")
    size, rows = targets.agg(F.sum("lw_source_size"), F.sum("lw_source_rows")).first()
    queued = materialize(_queued(narrow, targets, plan), "queued")
    limit = _limit(queued, plan.share * (size or 0), rows or 0, plan)
    full = _queued(sized, targets, plan) if carry else queued
    copies = sum((F.coalesce(_finish(c) <= limit, F.lit(False)) & (F.col("lw_size") > 0)).cast("int") for c in range(plan.max_copies))
    full = full.withColumn("lw_copies", copies).withColumn("lw_taken", F.col("lw_copies") * F.col("lw_size"))
    return full.drop("lw_key", "lw_cum", "lw_source_rows", "lw_text_hash")


def weighted_mix(
    docs: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text", plan: MixPlan = MixPlan(), carry: bool = True
) -> DataFrame:
    """``docs`` with ``lw_id``, ``lw_source``, ``lw_size``, ``lw_source_size``, ``lw_target``, ``lw_copies`` (how often
    the mix takes the row) and ``lw_taken`` (tokens that it takes); without ``carry``, these columns only.

    A null text has no words and is never taken; a source of such texts only has size and target 0, as has every source of a
    table without any words; a null source is a source, the last; rows that repeat an id queue
    one after the other, by size and text. The queue order is a hash of the id, so reruns agree. A column of ``docs``
    with one of these names gives way to the operator's. An empty table gives an empty table.
    """
    mixed = _mix(docs, id, source, text, plan, carry)
    if not carry:
        return mixed
    given = [c for c in mixed.columns if c != "lw_own"]
    return mixed.select(*[F.col("lw_own").getField(c).alias(c) for c in docs.columns if c.lower() not in given], *given)


def mixed_documents(docs: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text", plan: MixPlan = MixPlan()) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its own columns only, whatever their names."""
    mixed = _mix(docs, id, source, text, plan, True)
    times = F.explode(F.array_repeat(F.lit(1), F.col("lw_copies"))).alias("lw_time")
    return mixed.where("lw_copies > 0").select("lw_own", times).select("lw_own.*")


def _limit(queued: DataFrame, budget: float, rows: int, plan: MixPlan) -> float:
    """The last finish time that the budget holds; entries that finish together are taken together.

    Copies are range-bucketed by finish time. Up to 1 every stretch of time holds the same number of tokens; beyond,
    it may be dense, so slices follow the logarithm. Only the slice that crosses the budget is put in order.
    """
    copies = F.explode(F.array(*[_finish(c) for c in range(plan.max_copies)]))
    entries = queued.where("lw_size > 0 and lw_target > 0").select("lw_size", copies.alias("lw_finish"))
    finish = F.col("lw_finish")
    place = F.when(finish <= 1, finish).otherwise(1 + F.log(finish))
    entries = entries.withColumn("lw_slice", F.floor(place * max(1, -(-rows // plan.rows_per_bucket))).cast("long"))
    sums = entries.groupBy("lw_slice").agg(F.sum("lw_size").alias("lw_slice_size"), F.max("lw_finish").alias("lw_last"))
    earlier = Window.orderBy("lw_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(
        "lw_slice",
        F.coalesce(F.sum("lw_slice_size").over(earlier), F.lit(0)).alias("lw_before"),
        F.coalesce(F.max("lw_last").over(earlier), F.lit(0.0)).alias("lw_until"),
    )
    last = before.where(F.col("lw_before") <= budget).agg(F.max(F.struct("lw_slice", "lw_before", "lw_until"))).first()[0]
    if last is None:
        return 0.0
    inside = entries.where(F.col("lw_slice") == last["lw_slice"]).groupBy("lw_finish").agg(F.sum("lw_size").alias("lw_size"))
    upto = Window.orderBy("lw_finish").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("lw_total", last["lw_before"] + F.sum("lw_size").over(upto))
    fits = inside.agg(F.max(F.when(F.col("lw_total") <= budget, F.col("lw_finish")))).first()[0]
    return last["lw_until"] if fits is None else fits
