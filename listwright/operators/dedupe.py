"""First-wins dedupe on either of two keys.

In order, a row goes if an earlier row that stays has its first or its second key; rows that go register nothing. So
this is neither a distinct nor a connected component: in A(u1,t1), B(u2,t1), C(u2,t3) B goes and C stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.plans.storage import discard, written


def first_wins(rows: DataFrame, seq: str, key1: str, key2: str) -> DataFrame:
    """(``seq``, ``canonical``): the row itself where it stays, else the kept row that it merges into, by the first key
    before the second. ``seq`` must be distinct; null keys equal each other.

    Each round keeps the undecided rows that come first for both their keys and drops those that share a key with a
    kept row. Only ``seq`` and 128-bit hashes of the keys are shuffled; what is joined is aggregated by key, so a key
    that many rows share makes no more rows than it has. Rounds go on until nothing is left: one for every two links of
    the longest chain in which each row shares one key with the row before and the other with the next.
    """
    fold = lambda c: F.struct(F.xxhash64(F.col(c).isNull(), c).alias("a"), F.xxhash64(F.lit(1), F.col(c).isNull(), c).alias("b"))
    keyed = written(rows.select(F.col(seq).alias("seq"), fold(key1).alias("k1"), fold(key2).alias("k2")), "keyed")
    left, kept = keyed, None
    k, old = 0, None
    while old is None or not left.isEmpty():
        first1 = left.groupBy("k1").agg(F.min("seq").alias("f1"))
        first2 = left.groupBy("k2").agg(F.min("seq").alias("f2"))
        now = written(left.join(first1, "k1").join(first2, "k2").where("seq = f1 and seq = f2").select("seq", "k1", "k2"), f"kept{k}")
        kept = now if kept is None else kept.unionByName(now)
        old, left = left, left.join(now.select("k1"), "k1", "left_anti").join(now.select("k2"), "k2", "left_anti")
        left = written(left.select("seq", "k1", "k2"), f"left{k}")
        if k:
            discard(old)
        if k % 16 == 15:  # the plan stays short however many rounds there are
            kept = written(kept, "kept")
        k += 1
    by1 = kept.select("k1", F.col("seq").alias("c1"))
    by2 = kept.select("k2", F.col("seq").alias("c2"))
    # one kept row has a key at most; only an earlier one counts
    found = keyed.join(by1, "k1", "left").join(by2, "k2", "left")
    return found.select("seq", F.when(F.col("c1") <= F.col("seq"), F.col("c1")).otherwise(F.col("c2")).alias("canonical"))


def merge_groups(canonical: DataFrame) -> DataFrame:
    """(``canonical``, ``merged``): what each kept row absorbed, in order; only rows that absorbed something."""
    gone = canonical.where("seq <> canonical")
    return gone.groupBy("canonical").agg(F.array_sort(F.collect_list("seq")).alias("merged"))
