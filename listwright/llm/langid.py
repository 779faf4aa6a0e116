"""Language identification in two steps: the family first, then one-versus-one linear support vector machines between
the languages of that family.

Texts are profiles of hashed letter trigrams. All machines are fitted on a bounded sample of documents a language.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.llm.common import Shared, materialize, small_batches

UNDETERMINED = "und"
DIMENSIONS = 2048
#: Documents fitted over all languages, and at least per language; with many languages the latter decides.
SAMPLE = 6000
SAMPLE_LEAST = 50
# fixed values: families of languages by code; others form a family of their own
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "bn", "mr", "ne", "ur", "pa", "gu"),
    "sinitic": ("zh", "yue"),
}
_OTHER = "other"
_FOLD = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def family_of(lang: str) -> str:
    return next((f for f, own in FAMILIES.items() if lang.split("-")[0].lower() in own), _OTHER)


def profile(text: str) -> np.ndarray:
    """Unit vector of the square roots of hashed trigram counts over the bytes of the lower-cased letters."""
    raw = np.frombuffer(b" " + text.lower().encode().translate(_FOLD) + b" ", np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(DIMENSIONS, np.float32)
    h = (raw[:-2] * np.uint32(2654435761) + raw[1:-1] * np.uint32(40503) + raw[2:] * np.uint32(2246822519)) >> np.uint32(7)
    counts = np.sqrt(np.bincount((h & np.uint32(DIMENSIONS - 1)).astype(np.int64), minlength=DIMENSIONS))
    norm = math.sqrt(float(counts @ counts))
    return (counts / norm).astype(np.float32) if norm else counts.astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, rounds: int = 200, l2: float = 1e-4, rate: float = 0.5) -> np.ndarray:
    """Weights, the bias last, of a linear machine under squared hinge loss; both sides weigh the same."""
    w = np.zeros(x.shape[1] + 1)
    speed = np.zeros_like(w)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    for _ in range(rounds):
        slack = np.maximum(0.0, 1 - y * (x @ w[:-1] + w[-1]))
        g = -2 * weight * y * slack
        grad = np.concatenate((x.T @ g + l2 * w[:-1], [g.sum()]))
        speed = 0.9 * speed - rate * grad
        w += speed
    return w


class LanguageModel:
    def __init__(self, langs: list[str], x: np.ndarray, y: list[str]):
        self.langs = sorted(langs)
        members: dict[str, list[str]] = {}
        for lang in self.langs:
            members.setdefault(family_of(lang), []).append(lang)
        self.families = sorted(members)
        self.members = members
        y = np.array(y)
        of = {lang: f for f, own in members.items() for lang in own}
        fam = np.array([of[v] for v in y])
        self.family_w = np.array([fit_svm(x, np.where(fam == f, 1.0, -1.0)) for f in self.families]) if len(self.families) > 1 else None
        self.pairs = {f: list(combinations(own, 2)) for f, own in members.items()}
        self.pair_w = {}
        for f, pairs in self.pairs.items():
            for a, b in pairs:
                own = (y == a) | (y == b)
                self.pair_w[a, b] = fit_svm(x[own], np.where(y[own] == a, 1.0, -1.0))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not any(c.isalpha() for c in text):
            return UNDETERMINED, 0.0
        x = profile(text)
        family, score = self.families[0], 1.0
        if self.family_w is not None:
            z = self.family_w[:, :-1] @ x + self.family_w[:, -1]
            best = int(np.argmax(z))
            family = self.families[best]
            score *= _confidence(z[best])
        votes = dict.fromkeys(self.members[family], 0.0)
        margin = dict.fromkeys(self.members[family], math.inf)
        for a, b in self.pairs[family]:
            w = self.pair_w[a, b]
            z = float(w[:-1] @ x + w[-1])
            win, lose = (a, b) if z >= 0 else (b, a)
            votes[win] += 1 + min(abs(z), 1e3) * 1e-6
            margin[win] = min(margin[win], abs(z))
            margin[lose] = min(margin[lose], -abs(z))
        lang = max(self.members[family], key=lambda v: (votes[v], v))
        return lang, score * (_confidence(margin[lang]) if self.pairs[family] else 1.0)


def _confidence(margin: float) -> float:
    return 1 / (1 + math.exp(-3 * max(-10.0, min(10.0, margin))))


def _profiles(batches):
    for batch in batches:
        rows = [profile(t or "").tobytes() for t in batch.column("lw_text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("lw_lang"), pa.array(rows, pa.binary())], names=["lw_lang", "lw_profile"])


def fit_languages(docs: DataFrame, text: str, lang: str, learn, order) -> LanguageModel:
    """Fit on every language: of each about ``SAMPLE`` divided by their number, ``SAMPLE_LEAST`` or more, or all it has,
    those that ``order`` hashes lowest."""
    rows = docs.where(learn & F.col(lang).isNotNull()).select(F.col(lang).alias("lw_lang"), order.alias("lw_order"), F.col(text).alias("lw_text"))
    rows = rows.where(F.col("lw_text").rlike(r"\p{L}"))
    sizes = materialize(rows.groupBy("lw_lang").count().withColumnRenamed("count", "lw_n"), "languages")
    each = max(SAMPLE_LEAST, SAMPLE // max(1, sizes.count()))
    chosen = F.col("lw_order") < F.least(F.lit(1.0), F.lit(1.0 * each) / F.col("lw_n"))
    sample = rows.join(sizes, "lw_lang").where(chosen).select("lw_lang", "lw_text").mapInArrow(_profiles, "lw_lang string, lw_profile binary")
    found = sorted((r[0], bytes(r[1])) for r in sample.collect())  # bounded by the sample: a fixed number a language
    x = np.frombuffer(b"".join(p for _, p in found), np.float32).reshape(len(found), DIMENSIONS)
    return LanguageModel(sorted({v for v, _ in found}), x.astype(np.float64), [v for v, _ in found])


def identify_languages(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", modulus: int = 4, held: int = 2) -> DataFrame:
    """id, ``lw_held``, ``lw_lang`` and ``lw_score`` (0 to 1) for every row; the text alone decides.

    Learns from rows with a language whose crc32(id as text) hasn't the held remainder; a null id is learnt from.
    ``und`` with score 0 where a text is null or has no letter, or nothing was learnt. Repeated rows are predicted
    each; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    small_batches(spark)
    is_held = F.coalesce(F.crc32(F.col(id).cast("string")) % modulus == held, F.lit(False))
    order = (F.shiftright(F.xxhash64(F.lit(11), id, text), 11) + F.lit(1 << 52)) / F.lit(float(1 << 53))
    model = Shared(spark, fit_languages(docs, text, lang, ~is_held, order))
    kind = docs.schema[id].dataType.simpleString()

    def predict(batches):
        for batch in batches:
            out = [model.value.predict(t) for t in batch.column("lw_text").to_pylist()]
            langs, scores = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("lw_id"), batch.column("lw_held"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=["lw_id", "lw_held", "lw_lang", "lw_score"],
            )

    rows = docs.select(F.col(id).alias("lw_id"), is_held.alias("lw_held"), F.col(text).alias("lw_text"))
    return rows.mapInArrow(predict, f"lw_id {kind}, lw_held boolean, lw_lang string, lw_score double").withColumnRenamed("lw_id", id)
