"""Views over past runs: run list, run detail, applications, examples, provider statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: the statuses of an application, most active first
STATUS_ORDER = ("offer", "interview", "applied", "no-response", "rejected")
POSITIVE_STATUSES = ("interview", "offer")
TERMINAL_STATES = ("succeeded", "failed", "cancelled")
MAX_EXAMPLES = 12
EXAMPLE_CAPS = {"liked": 8, "disliked": 6}
STALE_MINUTES = 5


def status_rank(status: Column) -> Column:
    out = F
    for i, s in enumerate(STATUS_ORDER):
        out = out.when(status == s, i)
    return out.otherwise(len(STATUS_ORDER))


def _resolved(marks: DataFrame, scored: DataFrame, shortlist: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Marks with the fields of their listing in that run, from all scored rows first, else from the shortlist;
    marks on unknown listings go."""
    keys = ["run_id", "listing_id"]
    side = lambda df, p: df.select(*keys, *[F.col(f).alias(f"{p}_{f}") for f in fields], F.lit(True).alias(f"{p}_has"))
    out = marks.join(side(scored, "a"), keys, "left").join(side(shortlist, "b"), keys, "left").where("a_has or b_has")
    return out.select(*[F.col(c) for c in marks.columns], *[F.when(F.col("a_has"), F.col(f"a_{f}")).otherwise(F.col(f"b_{f}")).alias(f) for f in fields])


def newest_first(rows: DataFrame, key: str, run: str = "run_id") -> DataFrame:
    """The row of the newest run for each key."""
    return rows.withColumn("n_", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(run)))).where("n_ = 1").drop("n_")


def applications(marks: DataFrame, scored: DataFrame, shortlist: DataFrame, fields: tuple[str, ...] = ("title", "company", "location", "url", "portal", "score")) -> DataFrame:
    """Listings with a status, once each: the newest run that can resolve the listing wins; most active status first,
    then the newest run."""
    found = _resolved(marks.where("status is not null"), scored, shortlist, fields)
    return newest_first(found, "listing_id").orderBy(status_rank(F.col("status")), F.desc("run_id"), "listing_id")


def marked_examples(marks: DataFrame, scored: DataFrame, shortlist: DataFrame, fields: tuple[str, ...] = ("title", "company", "location", "primary_stack_hits"), limit: int = MAX_EXAMPLES) -> DataFrame:
    """Examples from marks: polarity from the mark, else a positive status; one per title and company, newest first;
    offers before interviews before others; at most ``limit``."""
    found = _resolved(marks, scored, shortlist, fields)
    positive = F.col("status").isin(*POSITIVE_STATUSES)
    polarity = F.when(F.col("mark") == "good", "liked").when(F.col("mark") == "bad", "disliked").when(positive, "liked")
    outcome = F.when(F.col("status") == "offer", "received an offer").otherwise("reached interview")
    note = F.when((polarity == "liked") & positive, F.concat_ws(" — ", F.col("reason"), outcome)).otherwise(F.col("reason"))
    priority = F.when(F.col("mark") == "bad", 0).when(F.col("status") == "offer", 2).when(F.col("status") == "interview", 1).otherwise(0)
    found = found.withColumns({"polarity": polarity, "note": note, "priority": F.coalesce(priority, F.lit(0)), "key_": example_key()})
    one = Window.partitionBy("key_").orderBy(F.desc("run_id"), "listing_id")
    found = found.where("polarity is not null").withColumn("n_", F.row_number().over(one)).where("n_ = 1")
    kept = found.orderBy(F.desc("priority"), F.desc("run_id"), "listing_id").limit(limit)
    return kept.drop("key_", "n_")


def example_key() -> Column:
    return F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit("|"), F.coalesce("company", F.lit(""))))


def combine_examples(curated: DataFrame, marked: DataFrame) -> DataFrame:
    """All curated examples, and marked ones whose title and company no curated one has."""
    keys = curated.select(example_key().alias("key_")).distinct()
    return curated.unionByName(marked.withColumn("key_", example_key()).join(keys, "key_", "left_anti").drop("key_").select(*curated.columns))


def few_shot(examples: DataFrame, seq: str = "seq") -> DataFrame:
    """The examples of each polarity that fit a prompt: those with a note first, then in order."""
    window = Window.partitionBy("polarity").orderBy(F.col("note").isNull(), seq)
    cap = F.element_at(F.create_map(*[F.lit(x) for kv in EXAMPLE_CAPS.items() for x in kv]), F.lower("polarity"))
    return examples.withColumn("place", F.row_number().over(window)).where(F.col("place") <= cap)


def example_line() -> Column:
    """One example as a line of the prompt."""
    place = F.coalesce("location", F.lit("?"))
    line = F.concat(F.lit("  - "), F.col("company"), F.lit(" — "), F.col("title"), F.lit(" ("), place, F.lit("; "), F.array_join("primary_stack", "/"), F.lit(")"))
    return F.when(F.col("note").isNull(), line).otherwise(F.concat(line, F.lit(" — why: "), F.col("note")))


def few_shot_prompt(examples: DataFrame, seq: str = "seq") -> DataFrame:
    """(``polarity``, ``block``): the chosen examples of each polarity, a line each."""
    lines = few_shot(examples, seq).select("polarity", "place", example_line().alias("line"))
    ordered = F.array_sort(F.collect_list(F.struct("place", "line")))
    return lines.groupBy("polarity").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("block"))


def good_marks(marks: DataFrame) -> DataFrame:
    """(``run_id``, ``good_marks``)."""
    return marks.groupBy("run_id").agg(F.count_if(F.lower("mark") == "good").alias("good_marks"))


def run_list(jobs: DataFrame, history: DataFrame, marks: DataFrame) -> DataFrame:
    """Job records, and history runs without one, as succeeded; with good marks; newest start first."""
    old = history.join(jobs.select("run_id"), "run_id", "left_anti").withColumn("state", F.lit("succeeded")).withColumn("phase", F.lit("done"))
    new = jobs.withColumn("started_at", F.coalesce("started_at", "created_at"))
    names = [c for c in history.columns if c in jobs.columns] + ["state", "phase"]
    both = new.select(*dict.fromkeys(names)).unionByName(old.select(*dict.fromkeys(names)))
    out = both.join(good_marks(marks), "run_id", "left").withColumn("good_marks", F.coalesce("good_marks", F.lit(0)))
    return out.orderBy(F.desc("started_at"), F.desc("run_id"))


def mark_maps(marks: DataFrame) -> DataFrame:
    """A row per run: its marks, reasons and statuses by listing, as maps, and the number of good marks."""
    entries = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("listing_id", c)))))
    return marks.groupBy("run_id").agg(
        entries("mark").alias("marks"),
        F.nullif(F.count("reason"), F.lit(0)).alias("n_reasons_"),
        entries("reason").alias("mark_reasons"),
        entries("status").alias("mark_statuses"),
        F.nullif(F.count("status"), F.lit(0)).alias("n_statuses_"),
        F.count_if(F.lower("mark") == "good").alias("good_marks"),
    ).select(
        "run_id",
        "marks",
        F.when(F.col("n_reasons_").isNotNull(), F.col("mark_reasons")).alias("mark_reasons"),
        F.when(F.col("n_statuses_").isNotNull(), F.col("mark_statuses")).alias("mark_statuses"),
        "good_marks",
    )


def run_detail(history: DataFrame, jobs: DataFrame, marks: DataFrame) -> DataFrame:
    """History overlaid with the job's state, phase and timeline; a job without history stands for itself, with an
    empty shortlist; marks as maps."""
    h = history.select("run_id", *[F.col(c).alias(f"h_{c}") for c in history.columns if c != "run_id"], F.lit(True).alias("h_has"))
    j = jobs.withColumn("started_at", F.coalesce("started_at", "created_at"))
    j = j.select("run_id", *[F.col(c).alias(f"j_{c}") for c in j.columns if c != "run_id"], F.lit(True).alias("j_has"))
    both = h.join(j, "run_id", "full_outer")
    shared = [c for c in history.columns if c != "run_id" and c in jobs.columns]
    fields = [F.when(F.col("h_has"), F.col(f"h_{c}")).otherwise(F.col(f"j_{c}")).alias(c) for c in shared]
    only = [F.col(f"h_{c}").alias(c) for c in history.columns if c != "run_id" and c not in jobs.columns]
    state = F.when(F.col("j_has"), F.col("j_state")).otherwise("succeeded").alias("state")
    phase = F.when(F.col("j_has"), F.col("j_phase")).otherwise("done").alias("phase")
    out = both.select("run_id", *[f for f, c in zip(fields, shared) if c not in ("state", "phase")], *only, state, phase)
    return out.join(mark_maps(marks), "run_id", "left").withColumn("good_marks", F.coalesce("good_marks", F.lit(0)))


def delete_runs(runs: DataFrame, marks: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs left, marks left, ids that no run has)."""
    ids = doomed.select("run_id").distinct()
    return runs.join(ids, "run_id", "left_anti"), marks.join(ids, "run_id", "left_anti"), ids.join(runs, "run_id", "left_anti")


def last_completed(runs: DataFrame) -> DataFrame:
    """The newest run that succeeded or has no state."""
    return runs.where("state = 'succeeded' or state is null").orderBy(F.desc("started_at"), F.desc("run_id")).limit(1)


def reconcile(jobs: DataFrame, now) -> DataFrame:
    """Runs that aren't over and whose heartbeat is older than five minutes show as interrupted."""
    now = now if isinstance(now, Column) else F.lit(now).cast("timestamp")
    stale = ~F.col("state").isin(*TERMINAL_STATES, "interrupted") & (F.col("last_heartbeat") < now - F.expr(f"interval {STALE_MINUTES} minutes"))
    return jobs.withColumn("finished_at", F.when(stale, F.coalesce("finished_at", now)).otherwise(F.col("finished_at"))).withColumn("state", F.when(stale, "interrupted").otherwise(F.col("state")))


def provider_last_fetch(fetches: DataFrame) -> DataFrame:
    """(``provider``, lower-case, ``started_at``, ``fetched_count``) of the newest run in which each was fetched."""
    newest = fetches.where("trim(name) <> ''").groupBy(F.lower("name").alias("provider"))
    return newest.agg(F.max_by(F.struct("started_at", "fetched_count"), "run_id").alias("l")).select("provider", "l.*")


def provider_recent(fetches: DataFrame, take: int = 5) -> DataFrame:
    """Each provider's newest runs, ``place`` from 1."""
    window = Window.partitionBy(F.lower("name")).orderBy(F.desc("run_id"))
    return fetches.withColumn("place", F.row_number().over(window)).where(F.col("place") <= take)


def provider_status_counts(fetches: DataFrame) -> DataFrame:
    """Per run: sources ok, failed, running, pending, done, and what the ok ones fetched."""
    c = lambda s: F.count_if(F.col("status") == s)
    return fetches.groupBy("run_id").agg(
        F.count("*").alias("total"),
        c("ok").alias("ok"),
        c("failed").alias("failed"),
        c("running").alias("running"),
        F.count_if(~F.col("status").isin("ok", "failed", "running")).alias("pending"),
        F.count_if(F.col("status").isin("ok", "failed")).alias("done"),
        F.coalesce(F.sum(F.when(F.col("status") == "ok", F.coalesce("fetched_count", F.lit(0)))), F.lit(0)).alias("fetched"),
    )


def seeded_rows(seeded: DataFrame, live: DataFrame) -> DataFrame:
    """Every enabled source, pending until a live status says otherwise, and live ones that weren't seeded."""
    rows = seeded.select("name").distinct().join(live, "name", "full_outer")
    return rows.withColumn("status", F.coalesce("status", F.lit("pending")))
