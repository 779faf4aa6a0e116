"""Live run records over several micro-batches: late events, silence, another attempt, and the fold of all events."""

import time

import duckdb
import pytest

from listwright import oracles as O
from listwright.plans import sample
from listwright.streaming.live import STATE_STORE, live_run_records
from listwright.streaming.runs import OUTPUT

SCHEMA = "run_id string, seq long, ts timestamp, type string, provider string, count long, error string, duration_ms long, score double"


class Live:
    """A running query over a folder of files, whose rows are kept in the order they come."""

    def __init__(self, spark, tmp_path, schema, **how):
        spark.conf.set(*STATE_STORE)
        self.spark, self.folder, self.rows, self.sent, self.progress = spark, f"{tmp_path}/events", [], 0, {}
        spark.createDataFrame([], schema).write.parquet(self.folder)
        stream = spark.readStream.schema(schema).parquet(self.folder)
        keep = lambda batch, epoch: self.rows.extend(map(tuple, batch.collect()))
        out = live_run_records(stream, **how).writeStream.outputMode("update").trigger(processingTime="300 milliseconds")
        self.query = out.option("checkpointLocation", f"{tmp_path}/checkpoint").foreachBatch(keep).start()

    def send(self, df):
        self.sent += df.count()
        df.coalesce(1).write.mode("append").parquet(self.folder)
        self.until(lambda: self.read() >= self.sent, 60)
        assert self.read() == self.sent
        self.until(lambda: False, 0.5)

    def read(self):
        self.progress |= {p["batchId"]: p["numInputRows"] for p in self.query.recentProgress if p["numInputRows"]}
        return sum(self.progress.values())

    def until(self, test, seconds=30):
        end = time.time() + seconds
        while time.time() < end and not test():
            if self.query.exception():
                raise self.query.exception()
            time.sleep(0.1)

    def last(self):
        return {r[0]: r for r in self.rows}

    def stop(self):
        self.query.stop()
        self.spark.conf.unset(STATE_STORE[0])


def test_late_silent_and_resumed(spark, tmp_path):
    row = lambda run, seq, kind, provider=None, count=None, score=None: (run, seq, None, kind, provider, count, None, None, score)
    live = Live(spark, tmp_path, SCHEMA, silence_ms=4000, keep_ms=600_000)
    send = lambda *rows: live.send(spark.createDataFrame(rows, SCHEMA))
    try:
        send(row("a", 1, "running"), row("a", 3, "provider_done", "x", 7), row("b", 1, "running"))
        # a late event of a source that a later one has settled, a late one of another, and one that is new
        send(row("a", 2, "provider_running", "x"), row("a", 4, "dedupe", None, 5), row("b", 2, "provider_done", "y", 3))
        assert live.last()["a"][1:6] == ("running", "deduping", 1, 7, 5)
        live.until(lambda: all(r[1] == "interrupted" for r in live.last().values()))
        assert {k: r[1] for k, r in live.last().items()} == {"a": "interrupted", "b": "interrupted"}
        send(row("a", 5, "running"), row("a", 6, "rank", None, 2, 0.5), row("a", 7, "succeeded", None, 4))
        send(row("a", 9, "dedupe", None, 99), row("a", 8, "rank", None, 99))
        a = live.last()["a"]
        assert a[1:] == ("succeeded", "done", 2, 7, 5, 4, 0.5, 2, 7)
        assert live.last()["b"][1] == "interrupted"
    finally:
        live.stop()


def test_batches_agree_with_the_fold(spark, tmp_path):
    data = "/root/testdata/sf0.001"
    events = sample.run_events(spark, sample.read(spark, data, "events"))
    live = Live(spark, tmp_path, events.schema)
    try:
        # three batches; each third event but the ends of runs comes a batch late
        late = "seq % 3 = 0 and type not in ('failed', 'succeeded')"
        cut = "case when seq < 350 then 0 when seq < 700 then 1 else 2 end"
        for batch in range(4):
            live.send(events.where(f"{cut} + cast({late} as int) = {batch}"))
        got = live.last()
    finally:
        live.stop()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{data}/events.parquet'")
    names = [x.split()[0] for x in OUTPUT.split(", ")]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({O.STREAMED_SQL})").fetchall()
    assert len(want) == len(got)
    for w in want:
        g = got[w[0]]
        assert [x if not isinstance(x, float) else pytest.approx(x) for x in w] == list(g)
