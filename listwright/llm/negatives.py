"""Hard negatives: for an anchor and a row of its label, the rows of other labels that score highest below a limit.

Anchors are taken in blocks of bounded size. For a block every task scores its rows, sorts each anchor's scores and keeps
what can still be among the first; what tasks keep is ranked by Spark. A first pass over the rows finds the positives, a
second one searches each positive's upper limit in the sorted scores and reads on from there.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listwright.llm.common import Shared, materialize
from listwright.llm.vectors import as_doubles, dimension_of, matrix

_POSITION_BITS = 14
_CHUNK = 1 << _POSITION_BITS
_SLICE = 128  # anchors whose scores are sorted at once
_NONE = np.iinfo(np.int64).max


@dataclass(frozen=True)
class MiningPlan:
    """``positives`` of an anchor, ``negatives`` of a positive; a negative's score lies between ``low`` and ``high`` percent
    of the positive's. ``every``: rows whose id this divides are anchors. ``block``: anchors broadcast at a time."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    every: int = 100
    scale: float = 256.0
    block: int = 8192


def _codes(column: pa.Array, dimension: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable vectors, and floor(scale * entry), held within what keeps 100 times an inner product in a long."""
    at, x = matrix(column, dimension)
    bound = float(isqrt((1 << 55) // dimension))
    return at, np.clip(np.floor(scale * x), -bound, bound)


def _scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products, as longs: by doubles where these hold every sum exactly, else by longs."""
    most = float(np.abs(anchors).max(initial=0)) * float(np.abs(rows).max(initial=0)) * rows.shape[1]
    if most < 2**52:
        return (anchors @ rows.T).astype(np.int64)
    return anchors.astype(np.int64) @ rows.astype(np.int64).T


def _order(scores: np.ndarray) -> np.ndarray:
    """For each anchor the places of its rows by falling score, equal ones as they come (by id): a plain sort of score
    and place in one number, or of two where scores are too large for that."""
    n = scores.shape[1]
    if np.abs(scores).max(initial=0) < 1 << (62 - _POSITION_BITS):
        keys = -scores * _CHUNK + np.arange(n)
        keys.sort(axis=1)
        return keys & (_CHUNK - 1)
    return np.lexsort((np.broadcast_to(np.arange(n), scores.shape), -scores), axis=1)


def _chunks(batches, dimension: int, scale: float):
    """(ids with null as the largest, labels, vectors), sorted by id, of the rows that take part."""
    for batch in batches:
        for start in range(0, batch.num_rows, _CHUNK):
            part = batch.slice(start, _CHUNK)
            at, codes = _codes(part.column(2), dimension, scale)
            ids = part.column(0).fill_null(_NONE).to_numpy(zero_copy_only=False)[at]
            order = np.argsort(ids, kind="stable")
            yield ids[order], part.column(1).to_numpy(zero_copy_only=False)[at][order], codes[order]


class _Best:
    """The first ``width`` of all (score, id) that were put in, for each of ``rows`` keys."""

    def __init__(self, rows: int, width: int):
        self.score = np.full((rows, width), np.iinfo(np.int64).min + 1)
        self.id = np.full((rows, width), _NONE)
        self.has = np.zeros((rows, width), bool)

    def put(self, at: slice | int, score: np.ndarray, id: np.ndarray, has: np.ndarray) -> None:
        score, id, has = np.concatenate((self.score[at], score), -1), np.concatenate((self.id[at], id), -1), np.concatenate((self.has[at], has), -1)
        first = np.lexsort((id, -score, ~has), axis=-1)[..., : self.score.shape[-1]]
        self.score[at], self.id[at], self.has[at] = (np.take_along_axis(x, first, -1) for x in (score, id, has))

    def batch(self, names: list[str]) -> pa.RecordBatch:
        key, place = np.nonzero(self.has)
        ids = self.id[key, place]
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(ids, pa.int64(), mask=ids == _NONE), pa.array(self.score[key, place], pa.int64())], names=names)


def _first(rows: DataFrame, key: str, count: int, id: str, score: str) -> DataFrame:
    """The first ``count`` rows of each key; Spark keeps no more of a task's rows, before and after it deals them out."""
    order = Window.partitionBy(key).orderBy(F.desc(score), F.col(id).asc_nulls_last())
    return rows.withColumn("lw_rank", F.row_number().over(order)).where(F.col("lw_rank") <= count)


def _mine_block(rows: DataFrame, anchors: pa.Table, dimension: int, plan: MiningPlan) -> DataFrame:
    spark = rows.sparkSession
    ids, labels, codes = (np.concatenate(x) for x in zip(*_chunks(anchors.to_batches(), dimension, plan.scale)))
    asked = Shared(spark, (ids, labels, codes))

    def positives(batches):
        ids, labels, codes = asked.value
        best = _Best(len(ids), plan.positives + 1)  # one of them may be the anchor itself
        for row_ids, row_labels, row_codes in _chunks(batches, dimension, plan.scale):
            for at in (slice(i, i + _SLICE) for i in range(0, len(ids), _SLICE)):
                scores = _scores(codes[at], row_codes)
                same = row_labels[None, :] == labels[at][:, None]
                order = _order(np.where(same, scores, np.int64(-(1 << 46)) if np.abs(scores).max(initial=0) < 1 << 46 else np.iinfo(np.int64).min + 1))[:, : plan.positives + 1]
                best.put(at, np.take_along_axis(scores, order, 1), row_ids[order], np.take_along_axis(same, order, 1))
        yield best.batch(["lw_anchor", "lw_id", "lw_score"])

    found = _first(rows.mapInArrow(positives, "lw_anchor long, lw_id long, lw_score long"), "lw_anchor", plan.positives + 1, "lw_id", "lw_score")
    table = found.orderBy("lw_anchor", "lw_rank").select("lw_anchor", "lw_id", "lw_score").toArrow()
    of, found_id, score = (table.column(c).fill_null(_NONE).to_numpy() for c in table.column_names)
    own = np.flatnonzero((found_id == ids[of]) & (found_id != _NONE) & (score == np.einsum("ij,ij->i", codes.astype(np.int64), codes.astype(np.int64))[of]))
    others = np.delete(np.arange(len(of)), own[np.unique(of[own], return_index=True)[1]])  # of those like the anchor one is the anchor
    of, found_id, score = of[others], found_id[others], score[others]
    first = np.arange(len(of)) - np.searchsorted(of, of) < plan.positives
    of, found_id, score = of[first], found_id[first], score[first]
    wanted = Shared(spark, (of, score))

    def negatives(batches):
        ids, labels, codes = asked.value
        of, score = wanted.value
        upper, lower = plan.high * score // 100, -(-plan.low * score // 100)
        starts = np.searchsorted(of, np.arange(len(ids) + 1))
        best = _Best(len(of), plan.negatives)
        for row_ids, row_labels, row_codes in _chunks(batches, dimension, plan.scale):
            for begin in range(0, len(ids), _SLICE):
                scores = _scores(codes[begin : begin + _SLICE], row_codes)
                order = _order(scores)
                for i in range(len(scores)):
                    a = begin + i
                    mine = slice(starts[a], starts[a + 1])
                    others = order[i][row_labels[order[i]] != labels[a]]
                    if mine.start == mine.stop or not len(others):
                        continue
                    ranked = scores[i][others]
                    first = np.searchsorted(-ranked, -upper[mine])
                    at = first[:, None] + np.arange(plan.negatives)
                    inside = at < len(ranked)
                    at = np.minimum(at, len(ranked) - 1)
                    best.put(mine, ranked[at], row_ids[others[at]], inside & (ranked[at] >= lower[mine][:, None]))
        yield best.batch(["lw_positive", "lw_negative_id", "lw_negative_score"])

    kept = _first(rows.mapInArrow(negatives, "lw_positive long, lw_negative_id long, lw_negative_score long"), "lw_positive", plan.negatives, "lw_negative_id", "lw_negative_score")
    pairs = spark.createDataFrame(
        pa.table({
            "lw_positive": pa.array(np.arange(len(of)), pa.int64()),
            "lw_anchor_id": pa.array(ids[of], pa.int64()),
            "lw_positive_id": pa.array(found_id, pa.int64(), mask=found_id == _NONE),
            "lw_positive_score": pa.array(score, pa.int64()),
        })
    )
    return kept.join(pairs, "lw_positive").drop("lw_positive")


def hard_negatives(vectors: DataFrame, label: str | Column = "label", id: str = "vec_id", column: str = "embedding", plan: MiningPlan = MiningPlan()) -> DataFrame:
    """``lw_anchor_id``, ``lw_positive_id``, ``lw_rank``, ``lw_negative_id``, ``lw_positive_score``, ``lw_negative_score``.

    Rows with a null label, a null vector, null or non-finite entries, or another number of entries than most take no
    part. Scores are inner products of floor(scale * entry); entries beyond sqrt(2^55 / their number) are
    held at that bound, so that limits fit a long. Higher scores come first, ties by smaller id, null ids last; a row with a null id is no anchor. Rows that
    repeat are rows of their own: each of two equal anchors is asked for, and is the other's positive. An anchor without
    positives, or a positive without negatives between the limits, gives no row. Other columns aren't looked at. An
    empty table gives an empty table.
    """
    schema = "lw_anchor_id long, lw_positive_id long, lw_rank int, lw_negative_id long, lw_positive_score long, lw_negative_score long"
    names = [x.split()[0] for x in schema.split(", ")]
    label = F.col(label) if isinstance(label, str) else label
    rows = vectors.select(F.col(id).cast("long").alias("lw_id"), label.cast("long").alias("lw_label"), as_doubles(column)).where("lw_label is not null and lw_vector is not null")
    dimension = dimension_of(rows, "lw_vector")
    spark = vectors.sparkSession
    if dimension is None:
        return spark.createDataFrame([], schema)

    def only_usable(batches):
        for batch in batches:
            yield batch.take(pa.array(matrix(batch.column(2), dimension)[0]))

    asked = rows.where(F.col("lw_id") % plan.every == 0).mapInArrow(only_usable, rows.schema)
    anchors = materialize(asked.withColumn("lw_row", F.monotonically_increasing_id()), "anchors")
    blocks = -(-anchors.count() // plan.block)
    # a hash of the row's number deals anchors evenly, whatever ids repeat
    block = F.pmod(F.xxhash64("lw_row"), F.lit(max(1, blocks)))
    done = []
    for b in range(blocks):
        asked = anchors.where(block == b).drop("lw_row").toArrow()
        if asked.num_rows:
            done.append(materialize(_mine_block(rows, asked, dimension, plan).select(*names), "negatives"))
    return reduce(DataFrame.unionAll, done) if done else spark.createDataFrame([], schema)
