"""What is dropped and why, the shortlist, and blending with a judge's verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listwright.functions import dates
from listwright.operators.profile import Ranking
from listwright.plans.storage import written

DROP_REASONS = ("above_max_age", "missing_required_primary", "disqualifier", "below_min_score", "beyond_top_n")


def two_decimals(value: Column) -> Column:
    """Rounded as the number that the double stands for, halves to even, as C's ``printf`` does: 0.295 is a little less
    than 295 thousandths and gives 0.29. Java's formatter rounds the shortest decimal instead, to 0.30."""
    size = F.abs(value)
    # in two parts of few bits each, whose products with 100 are exact
    upper = size.cast("float").cast("double")
    cents = F.floor(size * 100).cast("double")
    beyond = (upper * 100 - (cents + 0.5)) + (size - upper) * 100
    up = (beyond > 0) | ((beyond == 0) & (cents % 2 == 1))
    rounded = (cents + F.when(up, 1.0).otherwise(0.0)) / 100
    signed = F.when(value < 0, -rounded).otherwise(rounded)
    return F.format_string("%.2f", F.when(size < float(1 << 20), signed).otherwise(value))


def classify_drops(scored: DataFrame, ranking: Ranking, now, min_score: float | None = None) -> DataFrame:
    """``scored`` with ``drop_reason`` and ``drop_context``, null for what may be shortlisted. The first rule wins; a
    row without a date never ages out."""
    now = now if isinstance(now, Column) else F.lit(now).cast("timestamp")
    least = ranking.min_score if min_score is None else min_score
    rules = []
    if ranking.max_age_days is not None:
        age = dates.age_days(F.col("posted_at"), now)
        said = F.concat(F.lit("posted "), dates.rounded(age).cast("string"), F.lit(f" days ago, max {ranking.max_age_days}"))
        rules.append((F.coalesce(age > ranking.max_age_days, F.lit(False)), "above_max_age", said))
    if ranking.require_primary_hit:
        rules.append((F.size("reasoning.primary_stack_hits") == 0, "missing_required_primary", F.lit("no primary-stack keyword matched in title or description")))
    barred = F.col("reasoning.disqualifier_hits")
    rules.append((F.size(barred) > 0, "disqualifier", F.concat(F.lit("matched disqualifier: "), F.array_join(barred, ", "))))
    rules.append((F.col("score") < least, "below_min_score", F.concat(F.lit("score "), two_decimals(F.col("score")), F.lit(f" below threshold {least:.2f}"))))
    reason, context = F, F
    for rule, name, said in rules:
        reason, context = reason.when(rule, name), context.when(rule, said)
    return scored.withColumn("drop_reason", reason).withColumn("drop_context", context)


def shortlist(classified: DataFrame, top_n: int, seq: str = "seq") -> DataFrame:
    """The best ``top_n`` that nothing drops; ties keep their order. A top-k: no full sort."""
    return classified.where("drop_reason is null").orderBy(F.desc("score"), F.asc(seq)).limit(top_n)


def ranked(classified: DataFrame, seq: str = "seq") -> DataFrame:
    """Rows that pass with ``rank`` from 1 and ``passed``, their number.

    Rows are dealt by ranges of (score, seq), whose bounds Spark takes from the rows themselves, so a score that most rows
    share is cut between its rows like any other stretch. A row's rank is its place within its range after what the
    ranges before hold; no task sees more than its range.
    """
    order = F.desc("score"), F.asc(seq)
    ranges = classified.where("drop_reason is null").repartitionByRange(*order).sortWithinPartitions(*order)
    # the number of a row holds for one evaluation only, so rows are written with it: range in the upper bits, place below
    placed = written(ranges.withColumn("place_", F.monotonically_increasing_id()), "ranges").withColumn("range_", F.shiftright("place_", 33))
    sizes = placed.groupBy("range_").agg(F.count("*").alias("n_"))
    earlier = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("range_", F.coalesce(F.sum("n_").over(earlier), F.lit(0)).alias("before_"), F.sum("n_").over(Window.partitionBy()).alias("passed"))
    # as many rows as there are shuffle partitions at most
    joined = placed.join(F.broadcast(offsets), "range_")
    within = F.col("place_").bitwiseAND(F.lit((1 << 33) - 1))
    return joined.withColumn("rank", F.col("before_") + within + 1).drop("range_", "place_", "before_")


def beyond_top_n(classified: DataFrame, top_n: int, seq: str = "seq") -> DataFrame:
    """Rows that pass but rank below the shortlist, with reason and context."""
    said = F.concat(F.lit("rank "), F.col("rank").cast("string"), F.lit(" of "), F.col("passed").cast("string"), F.lit(f" (top {top_n} taken)"))
    rest = ranked(classified, seq).where(F.col("rank") > top_n)
    return rest.withColumn("drop_reason", F.lit("beyond_top_n")).withColumn("drop_context", said)


def dropped(classified: DataFrame, top_n: int, seq: str = "seq") -> DataFrame:
    """All that isn't shortlisted: seq, title, company, score, reason, context."""
    names = [seq, "title", "company", "score", "drop_reason", "drop_context"]
    by_rule = classified.where("drop_reason is not null").select(*names)
    return by_rule.unionByName(beyond_top_n(classified, top_n, seq).select(*names))


def strict_filter(scored: DataFrame, ranking: Ranking, now, seq: str = "seq") -> DataFrame:
    """The older selection without the disqualifier rule: age, primary hit, least score, best N."""
    now = now if isinstance(now, Column) else F.lit(now).cast("timestamp")
    out = scored
    if ranking.max_age_days is not None:
        out = out.where(F.coalesce(dates.age_days(F.col("posted_at"), now) <= ranking.max_age_days, F.lit(True)))
    if ranking.require_primary_hit:
        out = out.where(F.size("reasoning.primary_stack_hits") > 0)
    return out.where(F.col("score") >= ranking.min_score).orderBy(F.desc("score"), F.asc(seq)).limit(ranking.top_n)


def judge_candidates(scored: DataFrame, top_n: int, seq: str = "seq") -> DataFrame:
    """The best ``top_n``, all for 0 or less."""
    ordered = scored.orderBy(F.desc("score"), F.asc(seq))
    return ordered.limit(top_n) if top_n > 0 else scored


def blend(scored: DataFrame, verdicts: DataFrame, weight: float, key: str = "seq") -> DataFrame:
    """Scores mixed with verdicts (``key``, ``verdict_score``, ``verdict_reason``), clamped to 0 to 1; a reason is added
    to the notes. Rows without a verdict stay as they are."""
    joined = scored.join(verdicts, key, "left")
    mixed = F.least(F.greatest(F.col("verdict_score") * weight + F.col("score") * (1 - weight), F.lit(0.0)), F.lit(1.0))
    has = F.col("verdict_score").isNotNull()
    says = has & (F.trim(F.coalesce("verdict_reason", F.lit(""))) != "")
    added = F.concat(F.col("reasoning.notes"), F.lit(" AI review: "), two_decimals(F.col("verdict_score")), F.lit(" — "), F.col("verdict_reason"))
    joined = joined.withColumn("reasoning", F.when(says, F.col("reasoning").withField("notes", added)).otherwise(F.col("reasoning")))
    return joined.withColumn("score", F.when(has, mixed).otherwise(F.col("score"))).drop("verdict_score", "verdict_reason")
