"""Sharding by Karmarkar-Karp differencing.

Documents of one group stay together, and shards should be equally large. A partial partition gives each shard a sum;
the two partitions with the largest spread are combined again and again, the fullest shard of one with the emptiest
of the other. Groups are hashed to a fixed number of buckets, which are differenced apart; their partitions, a fixed
number of short vectors, are then differenced among each other.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listwright.llm.common import bucket_of, materialize, own_columns

BUCKETS = 1024
ROWS_PER_SLOT_RUN = 4096


def difference(vectors: list[tuple[int, ...]]) -> list[list[int]]:
    """For each partition (a sum per shard): which shard each of its places goes to, by differencing."""
    if not vectors:
        return []
    n, k = len(vectors), len(vectors[0])
    heap, trees = [], []
    for i, v in enumerate(vectors):
        order = sorted(range(k), key=lambda p: (-v[p], p))
        sums = tuple(v[p] - v[order[-1]] for p in order)
        heap.append((-sums[0], i, sums))
        trees.append((order,))
    heapq.heapify(heap)
    back = range(k - 1, -1, -1)
    while len(heap) > 1:
        _, i, a = heapq.heappop(heap)
        _, j, b = heap[0]
        sums = [x + b[q] for x, q in zip(a, back)]
        order = sorted(range(k), key=lambda p: (-sums[p], p))
        low = sums[order[-1]]
        merged = tuple(sums[p] - low for p in order)
        trees.append((i, j, order))
        heapq.heapreplace(heap, (-merged[0], len(trees) - 1, merged))
    out: list[list[int]] = [[] for _ in range(n)]
    todo = [(heap[0][1], list(range(k)))]  # shard of each sorted place
    while todo:
        node, shards = todo.pop()
        tree = trees[node]
        unsorted = [0] * k
        for rank, place in enumerate(tree[-1]):
            unsorted[place] = shards[rank]
        if len(tree) == 1:
            out[node] = unsorted
        else:
            todo.append((tree[0], unsorted))
            todo.append((tree[1], unsorted[::-1]))
    return out


def _bucket_partition(shards: int):
    def place(groups: pd.DataFrame) -> pd.DataFrame:
        groups = groups.sort_values(["lw_weight", "lw_h1", "lw_h2"], ascending=[False, True, True], kind="stable")
        weights = groups["lw_weight"].tolist()
        zeros = (0,) * (shards - 1)
        groups["lw_place"] = [p[0] for p in difference([(w, *zeros) for w in weights])]
        return groups[["lw_h1", "lw_h2", "lw_bucket", "lw_place", "lw_weight"]]

    return place


def group_shards(groups: DataFrame, shards: int, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """For groups (``lw_h1``, ``lw_h2``, ``lw_weight``): their bucket and place, and the shard of each (bucket, place)."""
    dealt = groups.withColumn("lw_bucket", F.pmod(F.col("lw_h1"), F.lit(buckets)).cast("int"))
    schema = "lw_h1 bigint, lw_h2 bigint, lw_bucket int, lw_place int, lw_weight bigint"
    placed = materialize(dealt.groupBy("lw_bucket").applyInPandas(_bucket_partition(shards), schema), "placed")
    sums: dict[int, list[int]] = {}
    for b, p, w in placed.groupBy("lw_bucket", "lw_place").agg(F.sum("lw_weight")).collect():  # buckets x shards rows at most
        sums.setdefault(b, [0] * shards)[p] = w
    order = sorted(sums)
    found = difference([tuple(sums[b]) for b in order])
    rows = [(b, p, s) for b, to in zip(order, found) for p, s in enumerate(to)]
    spark = groups.sparkSession
    return placed.drop("lw_weight"), spark.createDataFrame(rows, "lw_b int, lw_p int, lw_shard int")


def balanced_shards(docs: DataFrame, text: str = "text", shards: int = 8, id: str = "doc_id", buckets: int = BUCKETS) -> DataFrame:
    """``docs`` with ``lw_size`` (UTF-8 bytes of the text, null none, plus 1), ``lw_shard`` from 0 and ``lw_slot``,
    gapless from 0 in each shard. Equal texts share a shard; null texts are one group, empty ones another.

    Sums of sizes are as near as groups allow: a group larger than a fair share fills its shard alone. Rows that
    repeat get slots of their own. A column of ``docs`` with one of these names gives way to the operator's. An empty
    table gives an empty table.
    """
    sharded = shard_rows(docs, text, shards, id, buckets)
    given = ["lw_size", "lw_shard", "lw_slot"]
    return sharded.select(*[F.col("lw_own").getField(c).alias(c) for c in docs.columns if c.lower() not in given], *given)


def shard_rows(docs: DataFrame, text: str, shards: int, id: str, buckets: int = BUCKETS) -> DataFrame:
    """(``lw_own``, ``lw_size``, ``lw_shard``, ``lw_slot``): each row whole, so that its columns may have any names."""
    rows = docs.select(
        F.struct(*own_columns(docs)).alias("lw_own"),
        F.col(id).alias("lw_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("lw_size"),
        F.xxhash64(F.col(text).isNull(), text).alias("lw_h1"),
        F.xxhash64(F.lit(1), F.col(text).isNull(), text).alias("lw_h2"),
    )
    # texts are read twice: here, and in the join that gives each row its shard
    sizes = materialize(rows.groupBy("lw_h1", "lw_h2").agg(F.sum("lw_size").alias("lw_weight"), F.count("*").alias("lw_n")), "groups")
    placed, where = group_shards(sizes.drop("lw_n"), shards, buckets)
    # at most buckets x shards rows
    where = F.broadcast(where)
    placed = placed.join(where, (F.col("lw_bucket") == F.col("lw_b")) & (F.col("lw_place") == F.col("lw_p"))).select("lw_h1", "lw_h2", "lw_shard")
    groups = materialize(placed.join(sizes, ["lw_h1", "lw_h2"]), "shards")
    return add_slots(rows, groups).select("lw_own", "lw_size", "lw_shard", "lw_slot")


def add_slots(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Row numbers within shards. A shard's order is cut into runs: groups of up to ``ROWS_PER_SLOT_RUN`` rows lie in a
    run of hashed groups, a larger one has runs of its own, which its rows are dealt to by their hashed id. Runs are
    numbered apart and start where the runs before them end.

    Null and repeated ids, ties and equal rows are numbered in any order, each once."""
    counts = groups.groupBy("lw_shard").agg(F.sum("lw_n").alias("lw_rows"))
    # one row a shard
    groups = groups.join(F.broadcast(counts), "lw_shard")
    run = bucket_of(F.col("lw_h1"), F.ceil(F.col("lw_rows") / ROWS_PER_SLOT_RUN))
    parts = F.when(F.col("lw_n") > ROWS_PER_SLOT_RUN, F.ceil(F.col("lw_n") / ROWS_PER_SLOT_RUN)).otherwise(1).cast("long")
    groups = groups.select("lw_h1", "lw_h2", "lw_shard", run.alias("lw_run"), parts.alias("lw_parts"))
    rows = rows.join(groups, ["lw_h1", "lw_h2"])
    own = F.when(F.col("lw_parts") > 1, F.pmod(F.xxhash64("lw_id", F.lit(3)), F.col("lw_parts")) + 1).otherwise(0)
    group = F.when(F.col("lw_parts") > 1, F.col("lw_h1")).otherwise(0)
    rows = rows.withColumns({"lw_own_part": own, "lw_own_group": group})
    keys = ["lw_shard", "lw_run", "lw_own_group", "lw_own_part"]
    sums = rows.groupBy(*keys).agg(F.count("*").alias("lw_n"))
    earlier = Window.partitionBy("lw_shard").orderBy(*keys[1:]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(sums.select(*keys, F.coalesce(F.sum("lw_n").over(earlier), F.lit(0)).alias("lw_offset")), "slots")
    within = Window.partitionBy(*keys).orderBy("lw_h1", "lw_h2", "lw_id")
    return rows.join(offsets, keys).withColumn("lw_slot", F.col("lw_offset") + F.row_number().over(within) - 1)
