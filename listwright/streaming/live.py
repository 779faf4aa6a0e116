"""Live run records: one stateful processor a run, with its record, its sources, a silence timer and a time to live.

Every field of the record remembers the number of the event that it comes from, so an event that arrives late, in a later
micro-batch than its successors, changes only what no later event has settled. A run that isn't over and stays silent
becomes interrupted; when it speaks again it goes on, and a new attempt is counted as in the fold.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from listwright.operators.timeline import PHASE_OF, TERMINAL
from listwright.streaming.runs import KEEP_MS, OUTPUT, TIMEOUT_MS

#: Needed by stateful processors; a session that runs ``live_run_records`` sets it when it is built or before it starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

_RECORD = (
    "attempt int, events long, rejected long, over_at long, state string, state_at long, phase string, phase_at long, deduped long, deduped_at long, "
    "shortlist long, shortlist_at long, score double, score_at long, silent boolean"
)
_NAMES = [x.split()[0] for x in _RECORD.split(", ")]
_FRESH = dict(attempt=0, events=0, rejected=0, over_at=None, state="queued", state_at=-1, phase="pending", phase_at=-1, deduped=0, deduped_at=-1, shortlist=0, shortlist_at=-1, score=0.0, score_at=-1, silent=False)
_SOURCE = "at long, ok boolean, n long"


def _settle(s: dict, field: str, seq: int, value) -> None:
    if value is not None and seq > s[f"{field}_at"]:
        s[field], s[f"{field}_at"] = value, seq


class RunProcessor(StatefulProcessor):
    """``silence_ms``: after which a run that isn't over is interrupted. ``keep_ms``: how long a run's state outlives its
    last change, so that the events that come after its end are rejected until then."""

    def __init__(self, silence_ms: int = TIMEOUT_MS, keep_ms: int = KEEP_MS):
        self.silence_ms, self.keep_ms = silence_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.record = handle.getValueState("record", _RECORD, self.keep_ms)
        self.sources = handle.getMapState("sources", "name string", _SOURCE, self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = dict(zip(_NAMES, self.record.get())) if self.record.exists() else dict(_FRESH)
        s["silent"] = False
        for r in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            self._step(s, int(r.seq), r.type, r.provider, None if pd.isna(r.count_) else int(r.count_), None if pd.isna(r.score) else float(r.score))
        self.record.update(tuple(s[n] for n in _NAMES))
        self._wake(s, timerValues)
        yield self._row(key, s)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.record.exists():
            s = dict(zip(_NAMES, self.record.get()))
            if s["state"] not in TERMINAL:
                s["silent"] = True
                self.record.update(tuple(s[n] for n in _NAMES))
                yield self._row(key, s)

    def _wake(self, s: dict, timerValues) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if s["state"] not in TERMINAL:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silence_ms)

    def _step(self, s: dict, seq: int, kind: str, provider, count, score) -> None:
        if s["over_at"] is not None and seq > s["over_at"]:
            s["rejected"] += 1
            return
        s["events"] += 1
        _settle(s, "phase", seq, PHASE_OF.get(kind))
        if kind == "running":
            s["attempt"] += 1
            _settle(s, "state", seq, "running")
        elif kind in TERMINAL:
            s["over_at"] = seq
            _settle(s, "state", seq, kind)
        if kind.startswith("provider_") and provider:
            known = self.sources.getValue((provider,)) if self.sources.containsKey((provider,)) else None
            if known is None or seq > known[0]:
                self.sources.updateValue((provider,), (seq, kind == "provider_done", count or 0))
        if kind == "dedupe":
            _settle(s, "deduped", seq, count)
        if kind in ("rank", "complete", "succeeded"):
            _settle(s, "shortlist", seq, count)
            _settle(s, "score", seq, score)

    def _row(self, key, s: dict) -> pd.DataFrame:
        fetched = sum(n for _, ok, n in self.sources.values() if ok)
        state = "interrupted" if s["silent"] else s["state"]
        row = (key[0], state, s["phase"], s["attempt"], fetched, s["deduped"], s["shortlist"], s["score"], s["rejected"], s["events"])
        return pd.DataFrame([row], columns=[x.split()[0] for x in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def live_run_records(events: DataFrame, silence_ms: int = TIMEOUT_MS, keep_ms: int = KEEP_MS) -> DataFrame:
    """Run records from a stream of (run_id, seq, ts, type, provider, count, error, duration_ms, score), a row whenever a
    run's record changes. The query never ends by itself, as timers may fire at any time.

    An event is rejected if its number is above that of the run's end. The only thing that a late event can't do is to end a
    run before what has already been counted. State that nothing changes for ``keep_ms`` goes.
    """
    narrow = events.select("run_id", "seq", "type", "provider", F.col("count").alias("count_"), "score")
    return narrow.groupBy("run_id").transformWithStateInPandas(RunProcessor(silence_ms, keep_ms), OUTPUT, "Update", "ProcessingTime")
