"""The address that a source is asked at: its endpoint, a template perhaps, and its query parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PLACEHOLDER = r"\{(\w+)\}"


def escaped(text: Column) -> Column:
    """Percent-escaped but for letters, digits and ``- . _ ~``."""
    out = F.url_encode(text)
    for form, data in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(form), F.lit(data))
    return out


def request_url(endpoint: Column, params: Column) -> Column:
    """``endpoint`` with each ``{key}`` in it filled from ``params``, a map of strings; parameters that fill a place leave the
    query, those that are null are passed over, the others follow the query that the endpoint has. A key that isn't among
    the parameters, or null there, fails the job. Without parameters the endpoint stays as it is."""
    keys = F.array_distinct(F.regexp_extract_all(endpoint, F.lit(_PLACEHOLDER), F.lit(1)))
    missing = lambda key: F.raise_error(F.concat(F.lit("endpoint template references '{"), key, F.lit("}' but no query parameter has that name"))).cast("string")
    fill = lambda url, key: F.replace(url, F.concat(F.lit("{"), key, F.lit("}")), F.coalesce(escaped(F.try_element_at(params, key)), missing(key)))
    filled = F.reduce(keys, endpoint, fill)
    rest = F.filter(F.map_entries(params), lambda e: e["value"].isNotNull() & ~F.array_contains(keys, e["key"]))
    added = F.array_join(F.transform(rest, lambda e: F.concat(escaped(e["key"]), F.lit("="), escaped(e["value"]))), "&")
    base, part = F.regexp_extract(filled, r"^[^?#]*", 0), F.regexp_extract(filled, r"#.*$", 0)
    query = F.concat_ws("&", F.nullif(F.regexp_extract(filled, r"^[^?#]*\?+([^#]*)", 1), F.lit("")), F.nullif(added, F.lit("")))
    whole = F.concat(base, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)), part)
    return F.when(F.coalesce(added, F.lit("")) == "", filled).otherwise(whole)
