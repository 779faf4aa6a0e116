import random

import pytest

from listwright.operators.dedupe import first_wins, merge_groups


def greedy(rows):
    one, two, out = {}, {}, {}
    for s, a, b in sorted(rows):
        if a in one:
            out[s] = one[a]
        elif b in two:
            out[s] = two[b]
        else:
            one[a] = two[b] = out[s] = s
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "seq long, a string, b string")
    return {r["seq"]: r["canonical"] for r in first_wins(df, "seq", "a", "b", **kw).collect()}


def test_chain(spark):
    assert run(spark, [(0, "u1", "t1"), (1, "u2", "t1"), (2, "u2", "t3")]) == {0: 0, 1: 0, 2: 2}


@pytest.mark.parametrize("seed", range(4))
def test_random(spark, seed):
    rng = random.Random(seed)
    rows = [(i, f"u{rng.randint(0, 60)}", None if rng.random() < 0.05 else f"t{rng.randint(0, 60)}") for i in range(200)]
    assert run(spark, rows) == greedy(rows)


def test_later_kept_url_does_not_take_earlier_rows(spark):
    # the third row's URL belongs to a row that is kept in a later round, and the other way round
    rows = [(0, "a", "x"), (1, "b", "x"), (2, "b", "y"), (3, "c", "y"), (4, "c", "z"), (5, "b", "z"), (6, "c", "x")]
    assert run(spark, rows) == greedy(rows)


def test_long_chain(spark):
    rows = []
    for k in range(60):  # each row shares a key with the one before it
        rows.append((k, f"u{(k + 1) // 2}", f"t{k // 2}"))
    rows += [(100 + k, "hot", f"h{k}") for k in range(30)]
    assert run(spark, rows) == greedy(rows)


def test_groups(spark):
    rows = [(0, "u", "t"), (1, "u", "s"), (2, "v", "t"), (3, "w", "w")]
    df = spark.createDataFrame(rows, "seq long, a string, b string")
    groups = {r["canonical"]: r["merged"] for r in merge_groups(first_wins(df, "seq", "a", "b")).collect()}
    assert groups == {0: [1, 2]}
    assert first_wins(df.limit(0), "seq", "a", "b").count() == 0
