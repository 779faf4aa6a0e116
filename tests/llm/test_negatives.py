import random

import numpy as np
import pytest

from listwright.llm.negatives import MiningPlan, hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, lw_rank int, score long"
NAMES = ("lw_anchor_id", "lw_positive_id", "lw_rank", "lw_negative_id", "lw_positive_score", "lw_negative_score")


def plain(rows, plan):
    q = [(i, [int(np.floor(plan.scale * float(np.float32(x)))) for x in v], label) for i, v, label, *_ in rows if label is not None and v and None not in v and np.isfinite(v).all()]
    size = max(len(v) for _, v, _ in q)
    q = [r for r in q if len(r[1]) == size]
    by_id = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for at, (a, v, label) in enumerate(q):
        if a is None or a % plan.every:
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), i, own, k) for k, (i, w, own) in enumerate(q)]
        for ps, p, _, _ in sorted((s for s in scored if s[2] == label and s[3] != at), key=by_id)[: plan.positives]:
            fits = [s for s in scored if s[2] != label and plan.low * ps <= 100 * s[0] <= plan.high * ps]
            out += [(a, p, r + 1, n, ps, ns) for r, (ns, n, _, _) in enumerate(sorted(fits, key=by_id)[: plan.negatives])]
    return out


def same(got, want):
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    return len(want)


@pytest.mark.parametrize("block", [8192, 3])
def test_against_plain_version(spark, block):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0.1, 0.3) for _ in range(6)], rng.randrange(4), None, 1) for i in range(0, 400, 1)]
    rows += [(i, rows[3][1], 2, None, None) for i in range(400, 520)]  # one vector many times
    rows += [rows[0], rows[0], rows[100], (None, rows[0][1], 1, None, None), (None, rows[0][1], rows[0][2], None, None)]
    rows += [(600, None, 1, 1, 1), (700, rows[1][1], None, 1, 1), (800, [float("nan")] * 6, 1, 1, 1), (900, [None] * 6, 1, 1, 1), (1000, [1.0], 1, 1, 1), (1100, [0.0] * 6, 1, 1, 1), (-100, [-0.5] * 6, 2, 1, 1)]
    plan = MiningPlan(every=50, block=block)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert same(hard_negatives(df, plan=plan).select(*NAMES).collect(), plain(rows, plan)) > 100


def test_few_rows(spark):
    plan = MiningPlan()
    for rows in ([(0, [1.0, 0.0], 1, 1, 1)], [(0, [1.0, 0.0], 1, 1, 1), (1, [1.0, 0.0], 1, 1, 1)], [(0, [1.0, 0.5], 1, 1, 1), (1, [1.0, 0.5], 1, 1, 1), (2, [0.5, 0.5], 0, 1, 1)], [(1, [1.0], 1, 1, 1)]):
        df = spark.createDataFrame(rows, SCHEMA)
        same(hard_negatives(df, plan=plan).select(*NAMES).collect(), plain(rows, plan))
    assert hard_negatives(spark.createDataFrame([], SCHEMA)).collect() == []
    assert hard_negatives(spark.createDataFrame([(0, None, 1, 1, 1)], SCHEMA)).collect() == []


def test_large_entries_use_longs(spark):
    rows = [(i, [float(x) for x in np.random.default_rng(i).integers(2**15, 2**18, 3)], i // 10 % 2, 1, 1) for i in range(0, 300, 10)]
    plan = MiningPlan(low=1)
    assert same(hard_negatives(spark.createDataFrame(rows, SCHEMA), plan=plan).select(*NAMES).collect(), plain(rows, plan)) > 20


def test_query(spark):
    from listwright.llm.queries import op13_hard_negatives

    df = op13_hard_negatives(spark, "/root/testdata/sf0.001")
    assert df.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
