"""The listing: what every source yields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from listwright.functions import text as T
from listwright.plans.storage import discard, written

COLUMNS = ("id", "portal", "title", "company", "location", "remote_mode", "description", "url", "posted_at", "fetched_at", "item_ord")
ABSOLUTE_URL = r"^[A-Za-z][A-Za-z0-9+.-]*://[^\s/?#]+"


def stable_id(portal: Column, source_id: Column) -> Column:
    """First half of the SHA-256 of portal and source id, hexadecimal."""
    return F.substring(F.sha2(F.concat(portal, F.lit(":"), source_id), 256), 1, 32)


def absolute(url: Column) -> Column:
    return F.coalesce(url.rlike(ABSOLUTE_URL), F.lit(False))


def item_order(page: Column, at: Column | None = None) -> Column:
    """Order of an item within its source: its file, page or row, then its place there."""
    return F.struct(page.cast("long").alias("page"), (F.lit(0) if at is None else at).cast("long").alias("at"))


def build_listings(rows: DataFrame, portal: str, fetched_at, static: dict[str, str] | None = None) -> DataFrame:
    """Rows (source_id, title, company, location, description, url, posted_at, item_ord) as listings. Static fields that
    aren't blank win over the source's; rows without title or absolute URL go."""
    fixed = {k: v for k, v in (static or {}).items() if v and v.strip()}
    field = lambda name: F.lit(fixed[name]) if name in fixed else F.col(name)
    valid = rows.where(~T.blank(F.col("title")) & absolute(F.col("url")))
    tidy = lambda name: F.nullif(F.trim(field(name)), F.lit(""))
    description = F.coalesce("description", F.lit(""))
    out = valid.select(
        stable_id(F.lit(portal), F.coalesce(F.nullif(F.trim("source_id"), F.lit("")), F.col("url"))).alias("id"),
        F.lit(portal).alias("portal"),
        F.trim(field("title")).alias("title"),
        tidy("company").alias("company"),
        tidy("location").alias("location"),
        description.alias("description"),
        F.col("url"),
        F.col("posted_at").cast("timestamp").alias("posted_at"),
        F.lit(fetched_at).cast("timestamp").alias("fetched_at"),
        F.col("item_ord") if isinstance(rows.schema["item_ord"].dataType, StructType) else item_order(F.col("item_ord")).alias("item_ord"),
    )
    corpus = F.concat("title", F.lit(" "), "description", F.lit(" "), F.coalesce("location", F.lit("")))
    return out.withColumn("remote_mode", T.remote_mode(corpus)).select(*COLUMNS)


def gather(sources: list[DataFrame]) -> DataFrame:
    """All sources in order, written once: ``source_ord`` and ``seq``, which is distinct and sorts by source, then by
    item, whatever finished first and however many partitions a source has. Equal items of a source go by id and URL."""
    out = None
    for k, df in enumerate(sources):
        df = df.withColumn("source_ord", F.lit(k))
        out = df if out is None else out.unionByName(df)
    # items first get their places for good: the numbers of rows and pages hold for one evaluation only
    placed = written(out, "gathered")
    order = [c for c in ("source_ord", "item_ord", "id", "url") if c in placed.columns]
    ranged = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = written(ranged.withColumn("seq", F.monotonically_increasing_id()), "numbered")
    discard(placed)
    return numbered


def enrich(listings: DataFrame, pages: DataFrame) -> DataFrame:
    """Text of the fetched page (url, html) put after the description; rows without a page stay as they are."""
    bodies = pages.where("html is not null").groupBy("url").agg(F.min_by("html", F.xxhash64("html")).alias("html"))
    # each page is stripped once, before listings that share it multiply it
    bodies = bodies.select("url", F.nullif(T.strip_html(F.col("html")), F.lit("")).alias("body_"))
    joined = listings.join(bodies, "url", "left")
    body = F.col("body_")
    merged = F.when(body.isNull(), F.col("description")).when(F.trim("description") == "", body).otherwise(F.concat_ws(" ", "description", body))
    return joined.withColumn("description", merged).select(*listings.columns)
