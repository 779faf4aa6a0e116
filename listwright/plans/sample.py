"""The driver's tables read as listings, runs, marks and fetches, so that every operator has rows to work on.

A document is a listing: its first line the title, its text the description. Equal titles get equal companies and
places, and two documents share a URL, so both dedupe keys collide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.functions import text as T
from listwright.operators.profile import Profile, Ranking

NOW = "2024-01-16 00:00:00"
PROFILE = Profile(
    name="Sample",
    location="NATION_3, AMERICA",
    remote_preference="hybrid",
    seniority="senior",
    primary_stack=("the", "of", "der", "que", "C#", "les"),
    secondary_stack=("and", "thing", "und", "para", "eau"),
    domains=("that", "nicht", "por"),
    disqualifiers=("Junior",),
    country="AFRICA",
    region="ASIA",
    metro=("NATION_5", "NATION_7"),
    preferred_companies=("Supplier#000000042", "Supplier#000000017"),
)
RANKING = Ranking(top_n=25, min_score=0.3, max_age_days=14, require_primary_hit=True, adjacency_credit=0.5, disqualifier_penalty=0.0)
TITLE_HEADS = ("Senior ", "Junior ", "Staff Engineer ", "Product Manager ", "Intermediate ")
COMPANY_TAILS = (" A/S", " GmbH", ", Inc.")
PLACE_TAILS = (" (hybrid)", " (fully remote)", " (onsite)")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """A table whose file has fewer pieces than there are cores, dealt to all of them; larger ones stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def _pick(number, choices):
    out = F
    for i, c in enumerate(choices):
        out = out.when(number == i, c)
    return out.otherwise("")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, portal, title, company, location, remote_mode, description, url, posted_at (no zone)."""
    docs = spread(read(spark, sf_dir, "documents"))
    suppliers = read(spark, sf_dir, "supplier")
    n = suppliers.count()
    line = F.trim(F.substring_index("text", "\n", 1))
    title = F.concat(_pick(F.length(line) % 7, TITLE_HEADS), line)
    rows = docs.select(
        F.col("doc_id").alias("seq"),
        F.col("source").alias("portal"),
        title.alias("title"),
        F.col("text").alias("description"),
        F.concat(F.lit("https://"), "lang", F.lit(".example.com/"), F.expr("doc_id div 2").cast("string")).alias("url"),
        (F.length(line) % n).cast("long").alias("s_suppkey"),
    )
    places = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    homes = suppliers.join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    homes = homes.select(
        "s_suppkey",
        F.concat("s_name", _pick(F.col("s_suppkey") % 4, COMPANY_TAILS)).alias("company"),
        F.concat("n_name", F.lit(", "), "r_name", _pick(F.col("s_suppkey") % 5, PLACE_TAILS)).alias("location"),
    )
    posted = read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("ts").alias("posted_at"))
    rows = rows.join(homes, "s_suppkey", "left").join(posted, "seq", "left")
    corpus = F.concat_ws(" ", "title", "description", "location")
    return rows.select("seq", "portal", "title", "company", "location", T.remote_mode(corpus).alias("remote_mode"), "description", "url", "posted_at")


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, listing_id, mark, reason, status from labels: each labelled document is marked in two runs."""
    labels = read(spark, sf_dir, "labels").withColumn("r", F.explode(F.array(F.col("doc_id") % 3, F.col("doc_id") % 3 + 1)))
    status = _pick((F.col("doc_id") + F.col("r")) % 6, ("applied", "interview", "offer", "rejected"))
    return labels.select(
        F.concat(F.lit("run-"), F.col("r").cast("string")).alias("run_id"),
        F.col("doc_id").alias("listing_id"),
        F.when((F.col("doc_id") + F.col("r")) % 4 > 0, F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad")).alias("mark"),
        F.when(F.col("toxic") == 1, "rude").alias("reason"),
        F.nullif(status, F.lit("")).alias("status"),
    )


def run_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(scored, shortlist) rows of runs 0 to 3: of a run's documents one in four isn't scored, half of which are
    shortlisted."""
    docs = read(spark, sf_dir, "documents").withColumn("r", F.explode(F.array(*[F.lit(k) for k in range(4)])))
    rows = docs.select(
        F.concat(F.lit("run-"), F.col("r").cast("string")).alias("run_id"),
        F.col("doc_id").alias("listing_id"),
        F.concat(F.lit("Listing "), (F.col("doc_id") % 50).cast("string")).alias("title"),
        F.concat(F.lit("Company "), (F.col("doc_id") % 7).cast("string")).alias("company"),
        F.when(F.col("doc_id") % 5 > 0, F.col("lang")).alias("location"),
        F.col("source").alias("portal"),
        ((F.col("n_chars") + F.col("r")) % 1000 / 1000.0).alias("score"),
        F.array(F.col("lang"), F.col("source")).alias("primary_stack_hits"),
        "r",
    )
    scored = rows.where(F.col("listing_id") % 4 != F.col("r"))
    return scored.drop("r"), rows.where((F.col("listing_id") % 4 == F.col("r")) & (F.col("listing_id") % 8 < 4)).drop("r")


def run_events(spark: SparkSession, events: DataFrame) -> DataFrame:
    """Progress events: a user is a run, an event's number its order."""
    kind = (
        F.when((F.col("event_type") == "error") & (F.col("event_id") % 37 == 0), "failed")
        .when((F.col("event_type") == "purchase") & (F.col("event_id") % 41 == 0), "succeeded")
        .when(F.col("event_type") == "error", "provider_failed")
        .when(F.col("event_type") == "signup", "running")
        .when(F.col("event_type") == "view", "provider_done")
        .when(F.col("event_type") == "click", "dedupe")
        .otherwise("rank")
    )
    return events.select(
        F.col("user_id").cast("string").alias("run_id"),
        F.col("event_id").alias("seq"),
        "ts",
        kind.alias("type"),
        F.concat(F.lit("src"), (F.col("event_id") % 5).cast("string")).alias("provider"),
        (F.col("event_id") % 100).alias("count"),
        F.when(kind == "failed", F.concat(F.lit("error "), F.col("event_id").cast("string"))).alias("error"),
        (F.col("event_id") % 1000).alias("duration_ms"),
        (F.col("event_id") % 997 / 1000.0).alias("score"),
    )


def fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, name, status, fetched_count, started_at: a source fetched in a run, once."""
    events = read(spark, sf_dir, "events")
    last = events.groupBy(F.expr("event_id div 20").alias("run"), (F.col("user_id") % 20).alias("source")).agg(F.max_by(F.struct("event_id", "event_type"), "event_id").alias("e"))
    kind, at = F.col("e.event_type"), F.col("e.event_id")
    return last.select(
        F.format_string("run-%08d", "run").alias("run_id"),
        F.concat(F.when(at % 2 == 0, "SRC").otherwise("src"), F.col("source").cast("string")).alias("name"),
        F.when(kind == "error", "failed").when(kind == "signup", "running").when(kind == "view", "pending").otherwise("ok").alias("status"),
        F.when(kind.isin("click", "purchase"), at % 50).alias("fetched_count"),
        at.alias("started_at"),
    )
