"""Marks, reasons and statuses on listings, as upserts over a table keyed by run and listing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.functions.text import blank
from listwright.operators.history import STATUS_ORDER

MARKS = ("good", "bad")
MAX_REASON = 500
KEYS = ["run_id", "listing_id"]


def upsert_marks(marks: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes``: (run_id, listing_id, mark, reason, status, sets_mark, sets_status), one a key. A change sets the mark
    half (mark and reason), the status half, or both; clearing the mark drops its reason and keeps the status. Rows
    without mark and status go. Unknown marks or statuses and long reasons fail the job."""
    valid_mark = F.col("mark").isNull() | F.lower("mark").isin(*MARKS)
    valid_status = F.col("status").isNull() | F.lower("status").isin(*STATUS_ORDER)
    reason = F.nullif(F.trim("reason"), F.lit(""))
    checked = changes.select(
        *KEYS,
        F.when(~valid_mark, F.raise_error(F.lit("mark must be 'good', 'bad', or null")).cast("string")).otherwise(F.lower("mark")).alias("new_mark"),
        F.when(F.length(reason) > MAX_REASON, F.raise_error(F.lit(f"reason must be {MAX_REASON} characters or fewer")).cast("string")).otherwise(reason).alias("new_reason"),
        F.when(~valid_status, F.raise_error(F.lit("unknown status")).cast("string")).otherwise(F.lower("status")).alias("new_status"),
        F.coalesce("sets_mark", F.lit(False)).alias("sets_mark"),
        F.coalesce("sets_status", F.lit(False)).alias("sets_status"),
    )
    both = marks.join(checked, KEYS, "full_outer")
    sets_mark, sets_status = F.coalesce("sets_mark", F.lit(False)), F.coalesce("sets_status", F.lit(False))
    merged = both.select(
        *KEYS,
        F.when(sets_mark, F.col("new_mark")).otherwise(F.col("mark")).alias("mark"),
        F.when(sets_mark, F.when(F.col("new_mark").isNotNull(), F.col("new_reason"))).otherwise(F.col("reason")).alias("reason"),
        F.when(sets_status, F.col("new_status")).otherwise(F.col("status")).alias("status"),
    )
    return merged.where("mark is not null or status is not null")


def read_marks(documents: DataFrame, column: str = "value") -> DataFrame:
    """Marks from JSON documents {run: {listing: "good" | {mark, reason, status}}}, read level by level: a run, a mark or a
    field of another kind costs itself only. Marks and statuses are known in lower case; a listing without either gives
    no row, as does a document that isn't an object."""
    kind, text = F.schema_of_variant, lambda v, path: F.try_variant_get(v, path, "string")
    only = lambda v, wanted: F.when(F.startswith(kind(v), F.lit(wanted)), v)
    inner = lambda v: F.try_variant_get(only(v, "OBJECT"), "$", "map<string, variant>")
    runs = documents.select(F.explode(F.from_json(column, "map<string, variant>")).alias("run_id", "run"))
    rows = runs.select("run_id", F.explode(inner(F.col("run"))).alias("listing_id", "v"))
    v = F.col("v")
    field = lambda name: text(only(F.try_variant_get(v, f"$.{name}", "variant"), "STRING"), "$")
    mark, status, reason = F.coalesce(text(only(v, "STRING"), "$"), field("mark")), field("status"), field("reason")
    out = rows.select(
        "run_id",
        "listing_id",
        F.when(mark.isin(*MARKS), mark).alias("mark"),
        F.when(~blank(reason), reason).alias("reason"),
        F.when(status.isin(*STATUS_ORDER), status).alias("status"),
    )
    return out.where("mark is not null or status is not null")
