import random

from listwright.operators.timeline import breaker_state


def plain(calls, threshold):
    run, opened, out = {}, set(), set()
    for host, seq, ok in sorted(calls, key=lambda c: (c[0] or "", c[1])):
        skipped = host in opened
        run[host] = 0 if ok else run.get(host, 0) + 1
        if run[host] >= threshold:
            opened.add(host)
        out.add((host, seq, ok, run[host], skipped))
    return out


def test_one_host_with_most_calls(spark):
    """Ranges cut the long host many times, within failures that span several ranges as well."""
    rng = random.Random(2)
    calls = [("hot", i, rng.random() < 0.9 or i > 9000) for i in range(6000)] + [("hot", i, False) for i in range(6000, 9000)] + [("hot", i, rng.random() < 0.5) for i in range(9000, 9500)]
    calls += [(f"h{rng.randrange(30)}", i, rng.random() < 0.6) for i in range(1500)] + [("late", i, i < 3) for i in range(5)] + [(None, i, i % 4 == 0) for i in range(9)]
    df = spark.createDataFrame(calls, "host string, seq long, ok boolean").repartition(7)
    for threshold in (1, 3, 50):
        assert {tuple(r) for r in breaker_state(df, threshold).select("host", "seq", "ok", "failures", "skipped").collect()} == plain(calls, threshold)
    assert breaker_state(df.where("false")).count() == 0
