"""Run records kept up by a stream of progress events: one state machine a run, with a heartbeat timeout."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from listwright.operators.timeline import PHASE_OF, TERMINAL

STATE = "state string, phase string, attempt int, fetched string, deduped long, shortlist long, top_score double, rejected long, events long"
OUTPUT = "run_id string, state string, phase string, attempt int, fetched_count long, deduped_count long, shortlist_count long, top_score double, rejected long, events long"
TIMEOUT_MS = 5 * 60 * 1000
#: How long the state of a run that is over is kept, to reject late events.
KEEP_MS = 24 * 60 * 60 * 1000

def _number(value):
    return None if value is None or pd.isna(value) else value


def _step(s: dict, kind: str, provider, count, score) -> None:
    """One event: a run that is over rejects it."""
    if s["state"] in TERMINAL:
        s["rejected"] += 1
        return
    s["events"] += 1
    s["phase"] = PHASE_OF.get(kind, s["phase"])
    if kind == "running":
        s["state"] = "running"
        s["attempt"] += 1
    elif kind in TERMINAL:
        s["state"] = kind
    if kind == "provider_done" and provider:
        s["fetched"][provider] = int(count or 0)
    elif kind in ("provider_running", "provider_failed") and provider:
        s["fetched"].pop(provider, None)
    if kind == "dedupe" and count is not None:
        s["deduped"] = int(count)
    if kind in ("rank", "complete", "succeeded"):
        s["shortlist"] = int(count) if count is not None else s["shortlist"]
        s["top_score"] = float(score) if score is not None else s["top_score"]


def _fold(key, batches: Iterator[pd.DataFrame], state: GroupState, timers: bool = True) -> Iterator[pd.DataFrame]:
    import json

    if state.exists:
        names = [x.split()[0] for x in STATE.split(", ")]
        s = dict(zip(names, state.get))
        s["fetched"] = json.loads(s["fetched"])
    else:
        s = dict(state="queued", phase="pending", attempt=0, fetched={}, deduped=0, shortlist=0, top_score=0.0, rejected=0, events=0)
    if state.hasTimedOut:
        if s["state"] not in TERMINAL:
            s["state"] = "interrupted"
        state.remove()
    else:
        rows = pd.concat(list(batches)).sort_values("seq")
        for r in rows.itertuples(index=False):
            _step(s, r.type, r.provider, _number(r.count_), _number(r.score))
        state.update((s["state"], s["phase"], s["attempt"], json.dumps(s["fetched"]), s["deduped"], s["shortlist"], s["top_score"], s["rejected"], s["events"]))
        if timers:
            state.setTimeoutDuration(KEEP_MS if s["state"] in TERMINAL else TIMEOUT_MS)
    yield pd.DataFrame([(key[0], s["state"], s["phase"], s["attempt"], sum(s["fetched"].values()), s["deduped"], s["shortlist"], s["top_score"], s["rejected"], s["events"])], columns=[x.split()[0] for x in OUTPUT.split(", ")])


def run_records(events: DataFrame, timers: bool = True) -> DataFrame:
    """Run records from a stream of (run_id, seq, ts, type, provider, count, error, duration_ms, score), in update mode.
    Within a batch events go by ``seq``. With ``timers``, a run that isn't over and is silent for five minutes becomes
    interrupted; such a query never ends by itself."""
    narrow = events.selectExpr("run_id", "seq", "type", "provider", "count as count_", "score")
    fold = lambda key, batches, state: _fold(key, batches, state, timers)
    timeout = GroupStateTimeout.ProcessingTimeTimeout if timers else GroupStateTimeout.NoTimeout
    return narrow.groupBy("run_id").applyInPandasWithState(fold, OUTPUT, STATE, "update", timeout)


def replay_run_records(events: DataFrame) -> DataFrame:
    """The records after all of a finished table of events went through the stream once: the events are written to the
    shared folder, read as a stream, and each run's last record is kept."""
    import uuid

    from pyspark.sql import functions as F

    from listwright.plans.storage import written

    spark = events.sparkSession
    stored = written(events, "run-events")
    name = f"run_records_{uuid.uuid4().hex}"
    folder = stored.inputFiles()[0].rsplit("/", 1)[0]
    stream = spark.readStream.schema(stored.schema).parquet(folder)
    out = f"{folder}-records"

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    query = run_records(stream, timers=False).writeStream.queryName(name).outputMode("update").trigger(availableNow=True)
    query = query.option("checkpointLocation", f"{folder}-checkpoint").foreachBatch(keep).start()
    query.awaitTermination()
    rows = spark.read.schema(OUTPUT + ", epoch int").parquet(out)
    last = rows.groupBy("run_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("run_id", "epoch")]), "epoch").alias("r"))
    return last.select("run_id", "r.*")
