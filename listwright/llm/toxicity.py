"""Toxicity by a counterfactual-regularised classifier.

A logistic model over words and word beginnings is trained on a bounded sample of labelled documents. In each of them
that names a group, the name is swapped for others of its category, and the change of score is penalised, so the model
doesn't learn that naming a group is toxic.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.llm.common import materialize, small_batches, texts

# fixed values: group names by category, as swapped for each other
IDENTITY_TERMS = {
    "gender": ("woman", "women", "man", "men", "female", "male", "transgender", "frau", "mann", "femme", "homme", "mujer", "hombre"),
    "religion": ("muslim", "muslims", "jew", "jews", "jewish", "christian", "christians", "hindu", "buddhist", "atheist"),
    "origin": ("american", "mexican", "african", "asian", "european", "immigrant", "immigrants", "refugee", "refugees", "black", "white", "latino"),
    "orientation": ("gay", "lesbian", "bisexual", "straight", "queer"),
}


@dataclass(frozen=True)
class ToxicityPlan:
    """``positives`` and ``negatives`` bound the labelled documents that are fitted; ``features`` the model's size;
    ``min_z``: how clearly a feature must go with either label; ``swap_penalty`` weighs the counterfactual term. Training
    ends when the gradient is ``tolerance`` times what it was at first, after ``rounds`` Newton steps at most."""

    positives: int = 6000
    negatives: int = 10000
    features: int = 4000
    min_z: float = 4.0
    min_documents: int = 5
    swap_penalty: float = 10.0
    l2: float = 1e-3
    rounds: int = 100
    tolerance: float = 1e-5
    identity: dict = field(default_factory=lambda: IDENTITY_TERMS)


_EDGE = b".,;:!?\"'()[]{}*#|&%$<>-"


def features_of(word: bytes) -> tuple[int, ...]:
    """Hashes of the word and of its beginnings of 4, 5 and 6 letters."""
    w = word.strip(_EDGE)
    try:
        s = w.decode()
    except UnicodeDecodeError:
        return (zlib.crc32(w),)
    return (zlib.crc32(w), *(zlib.crc32(b"^" + s[:n].encode()) for n in (4, 5, 6) if len(s) >= n))


#: Values are whole numbers of this part, so that their sums don't depend on the order of adding.
UNIT = 1000


def value_of(count: int, words: int) -> int:
    """Of a feature that occurs ``count`` times: logarithmic, and less in texts of over 300 words."""
    return round(UNIT * math.log2(1 + count) * math.sqrt(min(1.0, 300 / max(words, 1))))


def count_features(words: Counter, known=None, memo=None) -> Counter:
    """Occurrences of each feature (of ``known`` ones, if given)."""
    out: Counter = Counter()
    memo = {} if memo is None else memo
    for w, n in words.items():
        own = memo.get(w)
        if own is None:
            if len(memo) > 300_000:
                memo.clear()
            own = features_of(w)
            memo[w] = own = own if known is None else tuple(f for f in own if f in known)
        for f in own:
            out[f] += n
    return out


def values(words: Counter, known=None, memo=None) -> dict[int, int]:
    n = sum(words.values())
    return {f: value_of(k, n) for f, k in count_features(words, known, memo).items()}


def words_of(text: bytes) -> Counter:
    return Counter(text.lower().split())


def _sample(docs: DataFrame, labels: DataFrame, id: str, text: str, label: str, modulus: int, held: int, plan: ToxicityPlan) -> DataFrame:
    learn = F.coalesce(F.crc32(F.col(id).cast("string")) % modulus != held, F.lit(False))
    one = labels.where(F.col(label).isNotNull() & learn).groupBy(F.col(id).alias("lw_id")).agg(F.max(label).alias("lw_label"))
    order = [F.xxhash64("lw_id"), F.col("lw_id")]
    chosen = [one.where(F.col("lw_label") == v).orderBy(*order).limit(n) for v, n in ((1, plan.positives), (0, plan.negatives))]
    chosen = materialize(chosen[0].unionByName(chosen[1]), "sample")
    # at most positives + negatives rows
    rows = docs.select(F.col(id).alias("lw_id"), F.col(text).alias("lw_text")).join(F.broadcast(chosen), "lw_id")
    return materialize(rows.select("lw_id", "lw_label", "lw_text"), "labelled")


_COUNTS = "f bigint, n bigint, s0 bigint, q0 bigint, s1 bigint, q1 bigint"


def _count(batches):
    sums: dict[int, list[int]] = {}
    documents, memo = [0, 0], {}

    def rows():
        columns = [list(sums), *zip(*sums.values())] if sums else [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["f", "n", "s0", "q0", "s1", "q1"])

    for batch in batches:
        for y, t in zip(batch.column("lw_label").to_pylist(), texts(batch.column("lw_text"))):
            documents[y] += 1
            for f, v in values(words_of(t), memo=memo).items():
                own = sums.setdefault(f, [0] * 5)
                own[0] += 1
                own[1 + 2 * y] += v
                own[2 + 2 * y] += v * v
        if len(sums) > 300_000:
            yield rows()
            sums = {}
    yield rows()
    # how many documents there are of either label
    yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (-1, 0, documents[0], 0, documents[1], 0)], names=["f", "n", "s0", "q0", "s1", "q1"])


def _rows_of(chosen: dict, identity: dict):
    """For each labelled document: label, feature values, and how they change when its group names are swapped."""
    category = {w.encode(): (c, i) for c, own in identity.items() for i, w in enumerate(own)}

    def swapped(words: Counter, shift: int) -> Counter:
        out: Counter = Counter()
        for w, n in words.items():
            found = category.get(w.strip(_EDGE))
            out[identity[found[0]][(found[1] + shift) % len(identity[found[0]])].encode() if found else w] += n
        return out

    def extract(batches):
        memo: dict = {}
        for batch in batches:
            y, f, v, swaps = [], [], [], []
            for label, t in zip(batch.column("lw_label").to_pylist(), texts(batch.column("lw_text"))):
                words = words_of(t)
                own = values(words, chosen, memo)
                y.append(label)
                f.append([chosen[x] for x in sorted(own)])
                v.append([own[x] for x in sorted(own)])
                changes = []
                if any(w.strip(_EDGE) in category for w in words):
                    for shift in (1, 2):
                        other = values(swapped(words, shift), chosen, memo)
                        changes.append([(chosen[x], other.get(x, 0) - own.get(x, 0)) for x in sorted(own.keys() | other.keys()) if other.get(x, 0) != own.get(x, 0)])
                swaps.append([[{"f": a, "v": b} for a, b in c] for c in changes if c])
            ints = pa.list_(pa.int32())
            pair = pa.list_(pa.list_(pa.struct([("f", pa.int32()), ("v", pa.int32())])))
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(f, ints), pa.array(v, ints), pa.array(swaps, pair)], names=["y", "f", "v", "swaps"])

    return extract


class Loss:
    """Log loss, both labels weighing the same, plus ``swap_penalty`` times the mean squared change of score under
    swaps and a ridge on all weights but the bias, which is the last. It is strictly convex but for the bias."""

    def __init__(self, rows: list[tuple], size: int, plan: ToxicityPlan):
        self.size, self.rows, self.plan = size, len(rows), plan
        self.y = np.array([r[0] for r in rows], float)
        self.of = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
        self.f = np.array([x for r in rows for x in r[1]], np.int64)
        self.v = np.array([x for r in rows for x in r[2]], float) / UNIT
        changes = [c for r in rows for c in r[3]]
        self.changes = len(changes)
        self.c_of = np.repeat(np.arange(len(changes)), [len(c) for c in changes])
        self.c_f = np.array([x[0] for c in changes for x in c], np.int64)
        self.c_v = np.array([x[1] for c in changes for x in c], float) / UNIT
        self.share = np.where(self.y == 1, 0.5 / max(1, (self.y == 1).sum()), 0.5 / max(1, (self.y == 0).sum()))
        self.ridge = np.append(np.full(size, plan.l2), 1e-9)

    def scores(self, w):
        return np.bincount(self.of, w[self.f] * self.v, self.rows) + w[-1]

    def back(self, r):
        out = np.bincount(self.f, r[self.of] * self.v, self.size + 1)
        out[-1] = r.sum()
        return out

    def swapped(self, w):
        """The penalty's gradient, linear in w."""
        if not self.changes:
            return 0.0
        moved = np.bincount(self.c_of, w[self.c_f] * self.c_v, self.changes)
        return 2 * self.plan.swap_penalty / self.changes * np.bincount(self.c_f, moved[self.c_of] * self.c_v, self.size + 1)

    def value(self, w):
        z = self.scores(w)
        return self.share @ (np.logaddexp(0, z) - self.y * z) + 0.5 * (w @ (self.ridge * w) + np.sum(w * self.swapped(w)))

    def gradient(self, w):
        p = 1 / (1 + np.exp(-np.clip(self.scores(w), -500, 500)))
        return self.back(self.share * (p - self.y)) + self.ridge * w + self.swapped(w), self.share * p * (1 - p)

    def curved(self, d, curvature):
        return self.back(curvature * self.scores(d)) + self.ridge * d + self.swapped(d)

    def diagonal(self, curvature):
        out = np.bincount(self.f, curvature[self.of] * self.v * self.v, self.size + 1) + self.ridge
        out[-1] += curvature.sum()
        if self.changes:
            out += 2 * self.plan.swap_penalty / self.changes * np.bincount(self.c_f, self.c_v * self.c_v, self.size + 1)
        return out


def _newton_step(loss: Loss, gradient, curvature, enough: float):
    """Solve for the step by conjugate gradients, scaled by the diagonal, until the rest is below ``enough``."""
    scale = loss.diagonal(curvature)
    step, rest = np.zeros_like(gradient), -gradient
    scaled = rest / scale
    way, product = scaled, rest @ scaled
    for _ in range(10 * len(gradient)):
        if math.sqrt(rest @ rest) <= enough:
            break
        bent = loss.curved(way, curvature)
        far = product / (way @ bent)
        step, rest = step + far * way, rest - far * bent
        scaled = rest / scale
        product, before = rest @ scaled, product
        way = scaled + product / before * way
    return step


def train(rows: list[tuple], size: int, plan: ToxicityPlan) -> np.ndarray:
    """Weights, the bias last, from rows (label, features, values, changes): the least ``Loss``, by Newton steps that
    are halved until they descend."""
    loss = Loss(rows, size, plan)
    w = np.zeros(size + 1)
    gradient, curvature = loss.gradient(w)
    first = norm = math.sqrt(gradient @ gradient)
    for _ in range(plan.rounds):
        if norm <= plan.tolerance * first:
            break
        step = _newton_step(loss, gradient, curvature, min(0.1, math.sqrt(norm / first)) * norm)
        now, slope, far = loss.value(w), gradient @ step, 1.0
        while far > 1e-9 and loss.value(w + far * step) > now + 1e-4 * far * slope + 1e-15:
            far /= 2
        w = w + far * step
        gradient, curvature = loss.gradient(w)
        norm = math.sqrt(gradient @ gradient)
    return w


def toxicity_scores(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", modulus: int = 3, held: int = 1, plan: ToxicityPlan = ToxicityPlan()) -> DataFrame:
    """id, ``lw_held``, ``lw_score`` (0 to 1) for every row; the text alone decides the score.

    Labels count only for ids whose crc32 as text hasn't the held remainder; null labels and null ids are ignored, of
    several labels of a document the highest counts. Null and empty texts have the score of no feature. Without
    labelled documents every score is 0.5. Rows that repeat are scored each; other columns are left aside; an empty
    table gives an empty table.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sample = _sample(docs, labels, id, text, label, modulus, held, plan)
    names = [x.split()[0] for x in _COUNTS.split(", ")]
    counts = sample.select("lw_label", "lw_text").mapInArrow(_count, _COUNTS).groupBy("f").agg(*[F.sum(x).alias(x) for x in names[1:]])
    counts = materialize(counts, "counts")
    total = counts.where("f = -1").first()
    n0, n1 = (total["s0"], total["s1"]) if total else (0, 0)
    mean = lambda k, n: F.col(f"s{k}") / float(max(n, 1) * UNIT)
    spread = lambda k, n: (F.col(f"q{k}") / float(max(n, 1) * UNIT * UNIT) - mean(k, n) * mean(k, n)) / float(max(n, 1))
    z = (mean(1, n1) - mean(0, n0)) / F.sqrt(F.greatest(spread(0, n0) + spread(1, n1), F.lit(0.0)) + 1e-6)
    identity = sorted({zlib.crc32(w.encode()) for own in plan.identity.values() for w in own})
    seen = counts.where((F.col("f") >= 0) & (F.col("n") >= plan.min_documents)).withColumn("z", z)
    clear = seen.where(F.abs("z") >= plan.min_z)
    best = [r[0] for r in clear.orderBy(F.desc(F.abs("z")), "f").limit(plan.features).select("f").collect()]
    named = [r[0] for r in counts.where(F.col("f").isin(identity)).orderBy("f").select("f").collect()]
    chosen = {f: i for i, f in enumerate(dict.fromkeys([*best, *named]))}
    schema = "y int, f array<int>, v array<int>, swaps array<array<struct<f:int,v:int>>>"
    fitted = sorted(tuple(r) for r in sample.mapInArrow(_rows_of(chosen, plan.identity), schema).collect())  # bounded by the sample
    w = train(fitted, len(chosen), plan) if fitted else np.zeros(1)
    model = spark.sparkContext.broadcast((float(w[-1]), {f: float(w[i]) for f, i in chosen.items()}))
    kind = docs.schema[id].dataType.simpleString()

    def score(batches):
        bias, weights = model.value
        memo: dict = {}
        for batch in batches:
            out = []
            for t in texts(batch.column("lw_text")):
                own = values(words_of(t), weights, memo)
                logit = bias + sum(weights[f] * own[f] for f in sorted(own)) / UNIT
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, logit)))))
            yield pa.RecordBatch.from_arrays([batch.column("lw_id"), batch.column("lw_held"), pa.array(out, pa.float64())], names=["lw_id", "lw_held", "lw_score"])

    is_held = F.coalesce(F.crc32(F.col(id).cast("string")) % modulus == held, F.lit(False))
    rows = docs.select(F.col(id).alias("lw_id"), is_held.alias("lw_held"), F.col(text).alias("lw_text"))
    return rows.mapInArrow(score, f"lw_id {kind}, lw_held boolean, lw_score double").withColumnRenamed("lw_id", id)
