from datetime import datetime, timedelta

import pytest

from listwright.operators import history, longlist, marks, timeline
from listwright.streaming.runs import replay_run_records

T0 = datetime(2026, 7, 1, 10)


def test_phase_durations(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    events = [("r", "pending", at(-5)), ("r", "fetching", at(0)), ("r", "fetching", at(2)), ("r", "deduping", at(3)), ("r", "ranking", at(4)), ("r", "llmJudging", at(16)), ("r", "writing", at(20)), ("r", "odd", at(1)), ("open", "fetching", at(0))]
    runs = [("r", at(21), None), ("open", None, None)]
    e = spark.createDataFrame(events, "run_id string, phase string, ts timestamp")
    r = spark.createDataFrame(runs, "run_id string, finished_at timestamp, attempt_started_at timestamp")
    got = {(x["run_id"], x["phase"]): x["duration_ms"] for x in timeline.phase_durations(e, r).collect()}
    assert got == {("r", "fetching"): 3000, ("r", "deduping"): 1000, ("r", "ranking"): 12000, ("r", "llmJudging"): 4000, ("r", "writing"): 1000}


def test_marks_of_other_kinds_cost_themselves_only(spark):
    docs = spark.createDataFrame([('{"r1": "oops", "r2": {"a": "good", "b": {"mark": ["good"], "status": "offer"}, "c": "GOOD"}, "r3": [{"a": "good"}], "r4": null}',), ("[1]",), ("{broken",), (None,)], "value string")
    assert sorted(tuple(r) for r in marks.read_marks(docs).collect()) == [("r2", "a", "good", None, None), ("r2", "b", None, None, "offer")]


def test_marks(spark):
    docs = spark.createDataFrame([('{"r1": {"a": "good", "b": {"mark": "BAD", "reason": " x ", "status": "offer"}, "c": "odd", "d": {"status": "nope"}, "e": 3}}',)], "value string")
    own = marks.read_marks(docs)
    assert sorted(tuple(r) for r in own.collect()) == [("r1", "a", "good", None, None), ("r1", "b", None, " x ", "offer")]
    change = lambda *rows: spark.createDataFrame(rows, "run_id string, listing_id string, mark string, reason string, status string, sets_mark boolean, sets_status boolean")
    cleared = marks.upsert_marks(own, change(("r1", "b", None, "r", None, True, False), ("r1", "a", None, None, None, True, True), ("r2", "z", "Good", " why ", None, True, False)))
    assert sorted(tuple(r) for r in cleared.collect()) == [("r1", "b", None, None, "offer"), ("r2", "z", "good", "why", None)]
    with pytest.raises(Exception, match="mark must be"):
        marks.upsert_marks(own, change(("r", "l", "great", None, None, True, False))).collect()
    with pytest.raises(Exception, match="500 characters"):
        marks.upsert_marks(own, change(("r", "l", "good", "x" * 501, None, True, False))).collect()


def test_applications(spark):
    m = spark.createDataFrame([("20260601-100000-oldaaa", "x", "good", None, "applied"), ("20260701-100000-newaaa", "x", None, None, "interview"), ("20260701-100000-newaaa", "y", None, None, "offer"), ("20260601-100000-oldaaa", "y", None, None, "rejected")], "run_id string, listing_id string, mark string, reason string, status string")
    scored = spark.createDataFrame([("20260601-100000-oldaaa", "x", "old"), ("20260701-100000-newaaa", "x", "new"), ("20260601-100000-oldaaa", "y", "old y")], "run_id string, listing_id string, title string")
    got = [(r["listing_id"], r["status"], r["title"]) for r in history.applications(m, scored, scored.limit(0), ("title",)).collect()]
    # the newest run can't resolve y, so the older one stands
    assert got == [("x", "interview", "new"), ("y", "rejected", "old y")]


def test_run_views(spark):
    jobs = spark.createDataFrame([("b", None, T0, 3, "running", "fetching", ["t"])], "run_id string, started_at timestamp, created_at timestamp, fetched_count int, state string, phase string, timeline array<string>")
    past = spark.createDataFrame([("a", T0 - timedelta(days=1), 5, ["s"]), ("b", T0, 9, ["s"])], "run_id string, started_at timestamp, fetched_count int, shortlist array<string>")
    m = spark.createDataFrame([("a", "l", "good", "why", None), ("a", "k", None, None, "offer")], "run_id string, listing_id string, mark string, reason string, status string")
    assert [(r["run_id"], r["state"], r["good_marks"]) for r in history.run_list(jobs, past, m).collect()] == [("b", "running", 0), ("a", "succeeded", 1)]
    detail = {r["run_id"]: r for r in history.run_detail(past, jobs, m).collect()}
    assert detail["a"]["state"] == "succeeded" and detail["a"]["marks"] == {"l": "good"} and detail["a"]["mark_statuses"] == {"k": "offer"} and detail["a"]["mark_reasons"] == {"l": "why"}
    assert detail["b"]["state"] == "running" and detail["b"]["fetched_count"] == 9
    runs, kept, missing = history.delete_runs(past, m, spark.createDataFrame([("a",), ("zz",)], "run_id string"))
    assert [r["run_id"] for r in runs.collect()] == ["b"] and kept.count() == 0 and [r["run_id"] for r in missing.collect()] == ["zz"]
    both = spark.createDataFrame([("a", "failed", T0), ("b", None, T0 - timedelta(1)), ("c", "succeeded", T0 - timedelta(2))], "run_id string, state string, started_at timestamp")
    assert history.last_completed(both).first()["run_id"] == "b"
    live = spark.createDataFrame([("a", "failed")], "name string, status string")
    assert sorted(tuple(r) for r in history.seeded_rows(spark.createDataFrame([("a",), ("b",)], "name string"), live).collect()) == [("a", "failed"), ("b", "pending")]


def test_examples(spark):
    c = spark.createDataFrame([("T", "A", "liked")], "title string, company string, polarity string")
    m = spark.createDataFrame([("t", "a", "disliked"), ("U", "A", "liked")], "title string, company string, polarity string")
    assert sorted(r["title"] for r in history.combine_examples(c, m).collect()) == ["T", "U"]


def test_filter_codec():
    f = longlist.LonglistFilter(q="x y", portals=("a", "b"), posted="7d", score_min=0.25, mark="bad", shortlist_only=True, sort="title", descending=False)
    assert longlist.LonglistFilter.from_query(f.to_query()) == f
    assert longlist.LonglistFilter().to_query() == ""
    assert longlist.LonglistFilter.from_query("?min=7&max=x&posted=never&mark=ugly&sort=size") == longlist.LonglistFilter(score_min=1.0)


def test_page_walk(spark):
    rows = [("a", 0, "1"), ("a", 0, "2"), ("a", 1, "3"), ("a", 1, "1"), ("a", 2, "1"), ("a", 2, "2"), ("a", 3, "9"), ("b", 0, None), ("b", 1, "5"), ("c", 0, "1"), ("c", 1, "7"), ("c", 1, "8")]
    df = spark.createDataFrame(rows, "source string, page int, item_id string")
    got = lambda **kw: sorted((r["source"], r["item_id"]) for r in timeline.take_pages(df, **kw).collect())
    assert got() == [("a", "1"), ("a", "2"), ("a", "3"), ("c", "1"), ("c", "7"), ("c", "8")]
    assert got(size=2) == [("a", "1"), ("a", "2"), ("a", "3"), ("c", "1")]
    assert got(max_pages=1) == [("a", "1"), ("a", "2"), ("c", "1")]


def events(spark):
    rows = []
    for r in range(6):
        kinds = ["running", "provider_running", "provider_done", "provider_failed", "dedupe", "rank", "complete"]
        kinds += [["succeeded", "rank"], ["failed"], [], ["cancelled", "running"], ["running", "provider_done"], ["succeeded", "failed"]][r]
        for i, k in enumerate(kinds):
            rows.append((f"r{r}", r * 100 + i, T0 + timedelta(seconds=i), k, f"p{i % 2}", 10 * i, "boom" if k == "failed" else None, 5, 0.1 * i))
    return spark.createDataFrame(rows, "run_id string, seq long, ts timestamp, type string, provider string, count long, error string, duration_ms long, score double")


def test_fold(spark):
    got = {r["run_id"]: r for r in timeline.fold_runs(events(spark)).collect()}
    assert [got[f"r{i}"]["state"] for i in range(6)] == ["succeeded", "failed", "running", "cancelled", "running", "succeeded"]
    assert [got[f"r{i}"]["rejected"] for i in range(6)] == [1, 0, 0, 1, 0, 1]
    assert got["r4"]["attempt"] == 2 and got["r1"]["error"] == "boom" and got["r1"]["phase"] == "writing" and got["r0"]["phase"] == "done"
    assert got["r0"]["deduped_count"] == 40 and got["r0"]["ranked_count"] == 50


def test_stream_agrees_with_the_fold(spark):
    batch = {r["run_id"]: r for r in timeline.fold_runs(events(spark)).collect()}
    stream = {r["run_id"]: r for r in replay_run_records(events(spark)).collect()}
    assert set(batch) == set(stream)
    for k, b in batch.items():
        s = stream[k]
        assert (s["state"], s["phase"], s["attempt"], s["fetched_count"], s["deduped_count"], s["shortlist_count"], s["rejected"], s["events"]) == (
            b["state"], b["phase"], b["attempt"], b["fetched_count"], b["deduped_count"], b["shortlist_count"], b["rejected"], b["events"])
