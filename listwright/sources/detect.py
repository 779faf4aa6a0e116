"""Which kind of source a web address is, and how it is labelled."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from listwright.functions import text as T

# --- fixed values: platforms by host, as (how the host is matched, what with, label), first match wins --------------
PLATFORMS = (
    ("contains", "ashbyhq.com", "Ashby"),
    ("contains", "greenhouse.io", "Greenhouse"),
    ("contains", "myworkday", "Workday"),
    ("contains", "smartrecruiters.com", "SmartRecruiters"),
    ("ends", "teamtailor.com", "Teamtailor"),
    ("ends", "hr-manager.net", "HR Manager"),
    ("contains", "jobindex.dk", "Jobindex"),
    ("contains", "it-jobbank.dk", "IT-Jobbank"),
    ("contains", "lever.co", "Lever"),
    ("contains", "bamboohr.com", "BambooHR"),
    ("contains", "oraclecloud.com", "Oracle"),
    ("contains", "careerjet", "Careerjet"),
    ("contains", "jooble", "Jooble"),
    ("contains", "remotive", "Remotive"),
    ("contains", "thehub.io", "The Hub"),
)
# boards whose first path segment names the company: hosts, kind, endpoint, field paths
BOARDS = (
    (("boards.greenhouse.io", "job-boards.greenhouse.io"), "greenhouse", "https://boards-api.greenhouse.io/v1/boards/{slug}/jobs?content=true",
     {"items_path": "jobs", "id": "id", "title": "title", "location": "location.name", "description": "content", "url": "absolute_url", "posted_at": "updated_at"}),
    (("jobs.ashbyhq.com",), "ashby", "https://api.ashbyhq.com/posting-api/job-board/{slug}",
     {"items_path": "jobs", "id": "id", "title": "title", "location": "location", "description": "descriptionHtml", "url": "jobUrl", "posted_at": "publishedAt"}),
    (("jobs.lever.co",), "lever", "https://api.lever.co/v0/postings/{slug}?mode=json",
     {"id": "id", "title": "text", "location": "categories.location", "description": "descriptionPlain", "url": "hostedUrl"}),
    (("jobs.smartrecruiters.com", "careers.smartrecruiters.com"), "smartrecruiters", "https://api.smartrecruiters.com/v1/companies/{slug}/postings?country=dk&limit=100",
     {"items_path": "content", "id": "id", "title": "name", "location": "location.fullLocation", "url_template": "https://jobs.smartrecruiters.com/{slug}/{id}", "posted_at": "releasedDate"}),
)
SAME_BACKEND = {"www.it-jobbank.dk": "jobindex.dk", "it-jobbank.dk": "jobindex.dk", "www.jobindex.dk": "jobindex.dk"}
# ------------------------------------------------------------------------------------------------------------------

_URL = r"^(?i)([a-z][a-z0-9+.-]*)://(?:[^@/?#]*@)?(\[[^\]/?#]*\]|[^/?#:]*)(:\d+)?([^?#]*)(\?[^#]*)?(?:#.*)?$"


def host(url: Column) -> Column:
    """Lower-case host, empty for no address."""
    return F.lower(F.coalesce(F.regexp_extract(F.trim(url), _URL, 2), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.trim(url), _URL, 4), F.lit(""))


def platform_label(url: Column) -> Column:
    """The platform's name, else the host without ``www.``; empty for no address."""
    h = F.regexp_replace(host(url), r"^www\.", "")
    out = F.when(h == "", F.lit(""))
    for how, needle, label in PLATFORMS:
        out = out.when(F.contains(h, F.lit(needle)) if how == "contains" else F.endswith(h, F.lit(needle)), label)
    return out.otherwise(h)


def endpoint_key(url: Column) -> Column:
    """Two endpoints with one key serve the same board: host, with known aliases, and path without trailing slashes."""
    h = host(url)
    for alias, name in SAME_BACKEND.items():
        h = F.when(h == alias, name).otherwise(h)
    return F.concat(h, F.lower(F.regexp_replace(path(url), "/+$", "")))


def detect_source(url: Column) -> Column:
    """struct(kind, name, display, endpoint) of the first rule that matches, null for an unknown address."""
    h, p = host(url), path(url)
    first = F.regexp_extract(p, "^/+([^/]+)", 1)
    pretty = lambda s: T.pretty(F.coalesce(F.nullif(F.regexp_replace(s, r"\d+$", ""), F.lit("")), s))
    draft = lambda kind, name, display, endpoint: F.struct(F.lit(kind).alias("kind"), name.alias("name"), display.alias("display"), endpoint.alias("endpoint"))
    out = F
    for hosts, kind, endpoint, _ in BOARDS:
        before, after = endpoint.split("{slug}")
        made = draft(kind, F.concat(F.lit(f"{kind}-"), F.lower(first)), pretty(first), F.concat(F.lit(before), first, F.lit(after)))
        out = out.when(h.isin(*hosts) & (first != ""), made)
    sub = F.regexp_extract(h, r"^(.+)\.teamtailor\.com$", 1)
    out = out.when((sub != "") & (sub != "www"), draft("teamtailor", F.concat(F.lit("teamtailor-"), sub), pretty(sub), F.concat(F.lit("https://"), h, F.lit("/sitemap.xml"))))
    key = F.coalesce(F.nullif(F.regexp_extract(url, r"[?&](?:cid|customer)=([^&#]+)", 1), F.lit("")), F.lit("source"))
    out = out.when((h == "candidate.hr-manager.net") & F.contains(F.lower(p), F.lit("list.aspx")) & F.contains(url, F.lit("?")), draft("hrmanager", F.concat(F.lit("hr-manager-"), F.lower(key)), pretty(key), url))
    looks = F.lower(p).rlike(r"(\.(rss|atom|xml)$)|/rss|/feed") & (h != "")
    site = F.regexp_extract(F.regexp_replace(h, r"^www\.", ""), r"^([^.]+)", 1)
    return out.when(looks, draft("rss", F.concat(F.lit("rss-"), T.slug(h)), F.concat(pretty(site), F.lit(" (feed)")), url)).otherwise(None)


def possibly_capped(limit: Column, paginated: Column, fetched: Column) -> Column:
    """A source without paging that returned exactly its numeric limit was probably cut."""
    n = F.regexp_extract(limit, r"^\s*(\d{1,9})\s*$", 1).try_cast("int")
    return F.coalesce(~paginated & (n > 0) & (fetched == n), F.lit(False))
