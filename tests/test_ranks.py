import random

from pyspark.sql import functions as F

from listwright.operators import rank
from listwright.operators.rank import two_decimals


def test_one_score_for_most_rows(spark):
    """Nine rows in ten share a score: ranks are those of a full sort, and no range holds much more than its share."""
    rows = spark.range(20_000).select(F.col("id").alias("seq"), F.when(F.col("id") % 10 > 0, 0.5).otherwise(F.col("id") % 997 / 1000).alias("score"), F.when(F.col("id") % 7 == 0, "old").alias("drop_reason"))
    got = rank.ranked(rows.repartition(5)).collect()
    want = sorted(((-r["score"], r["seq"]) for r in rows.collect() if r["drop_reason"] is None))
    assert {r["seq"]: r["rank"] for r in got} == {seq: i + 1 for i, (_, seq) in enumerate(want)}
    assert {r["passed"] for r in got} == {len(want)}
    ranges = rows.where("drop_reason is null").repartitionByRange(8, F.desc("score"), F.asc("seq")).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in ranges) < 2 * len(want) / 8
    empty = rank.ranked(rows.where("false"))
    assert empty.count() == 0


def test_plan_has_no_window_over_rows(spark):
    rows = spark.range(100).select(F.col("id").alias("seq"), F.lit(0.5).alias("score"), F.lit(None).cast("string").alias("drop_reason"))
    plan = rank.ranked(rows)._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Window" in line:
            assert "n_" in line and "score" not in line


def test_two_decimals_as_printf(spark):
    rng = random.Random(5)
    values = [k / 1000 for k in range(-1000, 1001)] + [0.125, 0.375, 0.0049999, 0.005, 1e-12, 999999.995, 123456.785, 1e17, -0.0] + [rng.random() for _ in range(500)] + [round(rng.random(), 6) for _ in range(500)]
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").select("v", two_decimals(F.col("v")).alias("t")).collect()
    for r in rows:
        if r["v"] is not None:  # Python formats as C does
            assert float(r["t"]) == float(f"{r['v']:.2f}") and r["t"].lstrip("-") == f"{abs(r['v']):.2f}", r
    assert [r["t"] for r in rows if r["v"] == 0.295] == ["0.29"]
