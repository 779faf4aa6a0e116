"""Sources within web pages: JSON-LD postings of a sitemap, JSON in a form field. Cards are in ``cards``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.functions import dates
from listwright.functions import json_paths as J
from listwright.functions import text as T
from listwright.functions.entities import decode_entities
from listwright.sources.listing import build_listings, item_order

# --- fixed values -------------------------------------------------------------------------------------------------
COUNTRY_CODES = {
    "DK": "Denmark", "SE": "Sweden", "NO": "Norway", "FI": "Finland", "IS": "Iceland", "DE": "Germany",
    "NL": "Netherlands", "GB": "United Kingdom", "UK": "United Kingdom", "IE": "Ireland", "FR": "France", "ES": "Spain",
    "IT": "Italy", "PL": "Poland", "BE": "Belgium", "AT": "Austria", "CH": "Switzerland", "US": "United States", "CA": "Canada",
}
COUNTRY_NAMES = {
    "danmark": "Denmark", "norge": "Norway", "sverige": "Sweden", "finland": "Finland", "island": "Iceland",
    "tyskland": "Germany", "holland": "Netherlands", "storbritannien": "United Kingdom",
}
# ------------------------------------------------------------------------------------------------------------------

#: A posting's address ends in a number below its board's folder of jobs.
POSTING_PATH = "/jobs/[0-9]+"
#: Blocks of linked data, and the value of the hidden input that holds a board's positions.
LINKED_DATA = r"(?is)<script\b(?=[^>]*\bld\+json\b)[^>]*>(.*?)</script\s*>"
POSITIONS = r"(?is)<input\b[^>]*?HiddenField_PositionList[^>]*?\svalue\s*=\s*(?:\"([^\"]+)\"|'([^']+)')"

def sitemap_urls(sitemap: Column) -> Column:
    """The distinct locations of a sitemap's text that look like postings."""
    found = F.regexp_extract_all(sitemap, F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda u: u.rlike(POSTING_PATH)))


def country_of(value: Column, names: dict[str, str], fold) -> Column:
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(table, fold(F.trim(value))), value)


def place(city: Column, country: Column) -> Column:
    """"City, country", or whichever is known."""
    known = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.nullif(F.concat_ws(", ", known(city), known(country)), F.lit(""))


def json_ld_postings(pages: DataFrame, portal: str, fetched_at, static: dict | None = None) -> DataFrame:
    """One listing a page (url, html): its first JSON-LD block of type JobPosting."""
    blocks = F.transform(F.regexp_extract_all("html", F.lit(LINKED_DATA), F.lit(1)), lambda b: F.try_parse_json(F.trim(b)))
    posting = F.element_at(F.filter(blocks, lambda b: F.lower(F.try_variant_get(b, "$['@type']", "string")) == "jobposting"), 1)
    rows = pages.select("url", F.when(F.size(F.filter(blocks, lambda b: b.isNotNull())) > 0, posting).alias("p"), item_order(F.monotonically_increasing_id()).alias("item_ord")).where("p is not null")
    string = lambda v, path: F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))
    where = F.coalesce(F.try_variant_get("p", "$.jobLocation[0].address", "variant"), F.try_variant_get("p", "$.jobLocation.address", "variant"))
    country = country_of(string(where, "$.addressCountry"), COUNTRY_CODES, F.upper)
    rows = rows.select(
        F.coalesce(F.nullif(F.trim(string(F.col("p"), "$.identifier.value")), F.lit("")), F.col("url")).alias("source_id"),
        string(F.col("p"), "$.title").alias("title"),
        string(F.col("p"), "$.hiringOrganization.name").alias("company"),
        place(string(where, "$.addressLocality"), country).alias("location"),
        T.strip_html(decode_entities(string(F.col("p"), "$.description"))).alias("description"),
        "url",
        dates.tolerant_timestamp(string(F.col("p"), "$.datePosted")).alias("posted_at"),
        "item_ord",
    )
    return build_listings(rows, portal, fetched_at, static)


def form_positions(pages: DataFrame, portal: str, fetched_at, static: dict | None = None) -> DataFrame:
    """Listings from the JSON in a page's hidden field; the place from the department tree, the department or the
    work place, in this order; the company from the customer, else the department."""
    doc = F.try_parse_json(decode_entities(F.concat(F.regexp_extract("html", POSITIONS, 1), F.regexp_extract("html", POSITIONS, 2))))
    rows = pages.select(doc.alias("doc"), F.monotonically_increasing_id().alias("page")).where("doc is not null")
    items = F.try_variant_get("doc", "$.PositionList.Items", "array<variant>")
    rows = rows.select("doc", "page", F.posexplode(items).alias("at", "p"))
    get = lambda path, of="p": F.when(F.schema_of_variant(F.try_variant_get(of, path, "variant")) == "STRING", F.nullif(F.try_variant_get(of, path, "string"), F.lit("")))
    tree = place(get("$.DepartmentTree.City"), country_of(get("$.DepartmentTree.Country"), COUNTRY_NAMES, F.lower))
    department = place(get("$.Department.City"), get("$.Department.Country"))
    rows = rows.select(
        F.try_variant_get("p", "$.Id", "string").alias("source_id"),
        get("$.Name").alias("title"),
        F.coalesce(get("$.CustomerName", "doc"), get("$.CustomerAlias", "doc"), get("$.Department.Name")).alias("company"),
        F.coalesce(tree, department, get("$.WorkPlace")).alias("location"),
        get("$.ShortDescription").alias("description"),
        F.coalesce(get("$.AdvertisementUrl"), get("$.AdvertisementUrlSecure")).alias("url"),
        dates.epoch_in_slashes(get("$.Published")).alias("posted_at"),
        item_order(F.col("page"), F.col("at")).alias("item_ord"),
    )
    return build_listings(rows, portal, fetched_at, static)
