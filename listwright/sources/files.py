"""Imported JSON and CSV files, feeds, and API payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as t

from listwright.functions import dates
from listwright.functions import json_paths as J
from listwright.functions import text as T
from listwright.sources.listing import build_listings, item_order

FIELDS = ("title", "company", "location", "url", "description", "posted_at")
TRAILING_COMPANY_HOSTS = r"(?i)^[a-z]+://[^/?#]*(jobindex\.dk|it-jobbank\.dk)"


#: Columns of an imported file that are looked at.
MOST_COLUMNS = 256


def manual_json(spark: SparkSession, path: str, portal: str, fetched_at, static: dict | None = None) -> DataFrame:
    """JSON arrays of objects with the fields of a listing, keys of any case.

    Of keys equal but for case, or altogether, the last one counts. An item that is no object, or has no title or
    absolute URL, goes by itself; a file that isn't a JSON array gives no rows. Lists and objects as values are null.
    """
    files = spark.read.text(path, wholetext=True).withColumn("page", F.monotonically_increasing_id())
    # items stay text here: maps read from text keep the order and the repetitions of their keys
    items = files.select("page", F.posexplode(F.from_json("value", "array<string>")).alias("at", "item"))
    entries = F.map_entries(F.from_json("item", "map<string, variant>"))
    rows = items.withColumn("entries", F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), J.scalar(e["value"]).alias("value"))))
    field = lambda name: F.try_element_at(F.filter("entries", lambda e: e["key"] == name), F.lit(-1))["value"]
    return _imported(rows.select("page", "at", *[field(f).alias(f) for f in FIELDS]), portal, fetched_at, static)


def manual_csv(spark: SparkSession, path: str, portal: str, fetched_at, static: dict | None = None) -> DataFrame:
    """CSV files with a header each, in any order and case; quoted commas, quotes and line feeds, short rows and blank
    lines are fine. A file's records find their fields by the places that its own header gives; of columns of one name
    the last that has a value counts; columns of other names, and those after the first 256, aren't looked at."""
    names = [f"c{i}" for i in range(MOST_COLUMNS)]
    raw = spark.read.csv(path, schema=", ".join(f"{n} string" for n in names), header=False, multiLine=True, quote='"', escape='"', mode="PERMISSIVE", ignoreLeadingWhiteSpace=False)
    records = raw.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("page"), F.array(*names).alias("values"))
    # a file of records that may hold line feeds is read by one task as it is
    header = F.first("values").over(Window.partitionBy("file").orderBy("page"))
    tidy = F.transform(header, lambda h: F.lower(F.trim(F.ltrim(h, F.lit("\ufeff")))))
    rows = records.withColumn("header", tidy).withColumn("nth", F.row_number().over(Window.partitionBy("file").orderBy("page"))).where("nth > 1")
    pairs = F.filter(F.arrays_zip("header", "values"), lambda p: p["values"].isNotNull())
    field = lambda name: F.try_element_at(F.filter("pairs", lambda p: p["header"] == name), F.lit(-1))["values"]
    rows = rows.withColumn("pairs", pairs).select("page", F.lit(0).alias("at"), *[field(f).alias(f) for f in FIELDS])
    return _imported(rows, portal, fetched_at, static)


def _imported(rows: DataFrame, portal: str, fetched_at, static: dict | None) -> DataFrame:
    """Rows (page, at, title, company, location, url, description, posted_at), all text, as listings."""
    rows = rows.withColumns({"source_id": F.col("url"), "item_ord": item_order(F.col("page"), F.col("at")), "posted_at": dates.tolerant_timestamp(F.col("posted_at"))})
    return build_listings(rows, portal, fetched_at, static)


def payload_listings(docs: DataFrame, mapping: dict[str, str], portal: str, fetched_at, static: dict | None = None) -> DataFrame:
    """Listings from JSON answers (``doc`` variant, ``page``): the array at ``items_path``, one row an item, fields by
    dotted path, the URL from a path or a template. Anything but an array gives no rows; items without a title or URL go."""
    items = F.try_variant_get(J.walk(F.col("doc"), mapping.get("items_path")), "$", "array<variant>")
    rows = docs.select("page", F.posexplode(items).alias("at", "item"))
    field = lambda name: J.read(F.col("item"), mapping[name]) if name in mapping else F.lit(None).cast("string")
    url = field("url") if "url" in mapping else J.render(mapping["url_template"], F.col("item")) if "url_template" in mapping else F.lit(None).cast("string")
    rows = rows.select(
        F.coalesce(field("id"), url).alias("source_id"),
        field("title").alias("title"),
        field("company").alias("company"),
        field("location").alias("location"),
        T.strip_html(field("description")).alias("description"),
        url.alias("url"),
        dates.tolerant_timestamp(field("posted_at")).alias("posted_at"),
        item_order(F.col("page"), F.col("at")).alias("item_ord"),
    )
    return build_listings(rows, portal, fetched_at, static)


_TEXT = t.StringType()
FEED_SCHEMA = t.StructType([t.StructField(n, _TEXT) for n in ("title", "link", "guid", "id", "description", "content", "content:encoded", "summary", "pubDate", "published", "updated", "dc:date")])
ATOM_SCHEMA = t.StructType([t.StructField("title", _TEXT), t.StructField("id", _TEXT), t.StructField("summary", _TEXT), t.StructField("content", _TEXT), t.StructField("published", _TEXT), t.StructField("updated", _TEXT), t.StructField("link", t.ArrayType(t.StructType([t.StructField("_href", _TEXT), t.StructField("_rel", _TEXT)])))])


def feed(spark: SparkSession, path: str, portal: str, fetched_at, static: dict | None = None, atom: bool = False) -> DataFrame:
    """RSS items, or Atom entries: the content before the description, the guid before the link as source id. On hosts
    known for it, the company is cut off the title's end."""
    if atom:
        raw = spark.read.format("xml").schema(ATOM_SCHEMA).option("rowTag", "entry").load(path)
        link = F.element_at(F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), 1)["_href"]
        rows = raw.select(F.col("title"), link.alias("url"), F.col("id").alias("guid"), F.coalesce("content", "summary").alias("body"), F.coalesce("published", "updated").alias("date"))
    else:
        raw = spark.read.format("xml").schema(FEED_SCHEMA).option("rowTag", "item").load(path)
        rows = raw.select(
            "title",
            F.trim("link").alias("url"),
            F.coalesce("guid", "id").alias("guid"),
            F.coalesce("`content:encoded`", "content", "description", "summary").alias("body"),
            F.coalesce("pubDate", "published", "`dc:date`", "updated").alias("date"),
        )
    title, company = T.split_trailing_company(F.trim("title"))
    split = F.coalesce(F.col("url").rlike(TRAILING_COMPANY_HOSTS), F.lit(False))
    rows = rows.select(
        F.col("guid").alias("source_id"),
        F.when(split, title).otherwise(F.trim("title")).alias("title"),
        F.when(split, company).alias("company"),
        F.lit(None).cast("string").alias("location"),
        T.strip_html(F.col("body")).alias("description"),
        "url",
        dates.tolerant_timestamp(F.col("date")).alias("posted_at"),
        item_order(F.monotonically_increasing_id()).alias("item_ord"),
    )
    return build_listings(rows, portal, fetched_at, static)
