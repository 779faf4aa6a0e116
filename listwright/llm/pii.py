"""Personal data by weak supervision.

Candidate spans come from strict patterns, whose spans always stay, and from loose ones, among them secrets such as
access tokens. Four labelers (pattern, gazetteer, context words, format) vote on each candidate or abstain.
Expectation-maximisation over the vote patterns of the whole corpus estimates each labeler's reliability without labels.
Its posteriors train the span classifier, which sees the votes, the span's shape and what stands around it, on a bounded
sample of candidates, and decides on all loose ones.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.llm.common import materialize, small_batches

KINDS = ("email", "ip", "card", "phone")
#: Kinds of spans: those with strict patterns, then one that only the method finds.
SPAN_KINDS = (*KINDS, "secret")
EMAIL, IP, CARD, PHONE, SECRET = range(5)
#: Candidates that the classifier is fitted on, at most; those of the lowest hashes.
SAMPLE_SPANS = 20_000
#: Hashed features of a span's shape and surroundings.
HASHED = 512
LABELERS = ("pattern", "gazetteer", "context", "format")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits is tried from its start only, so a long one costs its length once
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_SPELT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?:@| ?[\[(](?:at|AT)[\])] ?)[A-Za-z0-9-]{1,63}(?:(?:\.| ?[\[(](?:dot|DOT)[\])] ?)[A-Za-z0-9-]{1,63}){0,8}")
_LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z.+-])(?:\([0-9]{2,5}\)[ -]?)?[0-9]{2,5}(?:[ .-][0-9]{2,5}){1,4}(?![0-9A-Za-z-])")

_SECRET = re.compile(r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+-]{20,}+={0,2}")

# fixed values: well-known top-level domains, issuer prefixes, country codes and context words
TLDS = frozenset("com org net edu gov int info biz io co uk de fr es it nl be ch at pt pl dk se no fi ie eu us ca au nz jp cn in br mx ru za example test".split())
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "36", "62")
COUNTRY_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 354 358 359 370 371 372 380 420 421".split())
CONTEXT = {
    EMAIL: ("mail", "contact", "write", "kontakt", "correo", "courriel", "adresse", "address", "@"),
    IP: ("ip", "server", "host", "address", "login", "network", "adresse"),
    CARD: ("card", "visa", "credit", "payment", "mastercard", "karte", "carte", "tarjeta"),
    SECRET: ("token", "key", "secret", "password", "passwd", "bearer", "credential", "auth"),
    PHONE: ("phone", "tel", "call", "mobile", "fax", "telefon", "contact", "teléfono", "téléphone"),
}
SECRET_NAMES = re.compile(r"(?i)(?:token|key|secret|passw(?:or)?d|pwd|bearer|credentials?|auth)[\"']?\s{0,3}[:=]{1,2}\s{0,3}[\"']?$")
CONTEXT_CHARS = 40


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(2 * d if d < 5 else 2 * d - 9 for d in map(int, digits[-2::-2]))
    return (odd + even) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str):
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = at = found.end()
        else:
            at += 1


def _octets(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the strict patterns, leftmost and not overlapping within a kind."""
    out = [(EMAIL, s, e) for s, e in _emails(text)]
    if not _ANY.search(text):
        return out
    out += [(IP, *m.span()) for m in _IP.finditer(text) if _octets(m.group())]
    for m in _CARD.finditer(text):
        if 23 <= m.end() - m.start() + 11 and 12 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((CARD, *m.span()))
    if "+" in text:
        out += [(PHONE, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


def loose_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Further candidates, clear of the base spans and of each other, leftmost first: spelt-out mail addresses, local
    phone numbers, card-like numbers, long runs of letters and digits."""
    found = [(EMAIL, *m.span()) for m in _SPELT.finditer(text)] if "@" in text or "at" in text or "AT" in text else []
    if _ANY.search(text):
        found += [(CARD, *m.span()) for m in _CARD.finditer(text) if 12 <= len(_digits(m.group())) <= 19]
        found += [(PHONE, *m.span()) for m in _LOCAL_PHONE.finditer(text) if 7 <= len(_digits(m.group())) <= 15]
        found += [(SECRET, *m.span()) for m in _SECRET.finditer(text) if _mixed(m.group())]
    starts, ends = [], []
    for _, s, e in sorted(base, key=lambda x: x[1:]):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    out, done = [], 0
    for kind, s, e in sorted(found, key=lambda x: (x[1], x[0])):
        at = bisect_right(starts, s)
        if s >= done and not (at and ends[at - 1] > s) and not (at < len(starts) and starts[at] < e):
            out.append((kind, s, e))
            done = e
    return out


def _mixed(run: str) -> bool:
    """Letters and digits both, as words and numbers don't have them."""
    digits = len(_digits(run))
    return 3 <= digits < len(run) - 2


def votes(text: str, kind: int, start: int, end: int, strict: bool) -> tuple[int, ...]:
    """1 for, -1 against, 0 abstains, by ``LABELERS``."""
    span = text[start:end]
    digits = _digits(span)
    before = text[max(0, start - CONTEXT_CHARS) : start].lower()
    context = 1 if any(w in before for w in CONTEXT[kind]) else 0
    if kind == EMAIL:
        last = re.split(r"[^A-Za-z0-9-]", span.rstrip(")]"))[-1].lower()
        return (1 if strict else -1, 1 if last in TLDS else -1, context, 1 if 6 <= len(span) <= 120 else -1)
    if kind == IP:
        first = int(span.split(".")[0].lstrip("0") or 0)
        return (1, 1 if 1 <= first <= 223 else -1, context, 1 if all(len(p) <= 3 for p in span.split(".")) else -1)
    if kind == SECRET:
        kinds_of = len(set(span))
        return (1 if SECRET_NAMES.search(text[max(0, start - 30) : start]) else 0, 1 if any(w in before[-15:] for w in CONTEXT[kind]) else 0, context, 1 if kinds_of >= 10 else -1)
    if kind == CARD:
        return (1 if luhn(digits) else -1, 1 if digits.startswith(ISSUERS) else -1, context, 1 if len(digits) in (15, 16) else 0)
    code = span.startswith("+") and any(digits[:n] in COUNTRY_CODES for n in (1, 2, 3))
    shape = 1 if re.search(r"[ ().-]", span) and 9 <= len(digits) <= 13 else -1
    return (1 if strict else -1, 1 if code else (-1 if span.startswith("+") else 0), context, shape)


_VOTE_FEATURES = len(SPAN_KINDS) * (1 + 2 * len(LABELERS))
FEATURES = _VOTE_FEATURES + HASHED
_RUNS = re.compile(r"[0-9]+|[^\W\d_]+|\s+|.", re.S)


def _shape(s: str) -> str:
    """Runs of digits, letters and white space as one sign each, other characters as they are."""
    return "".join("9" if x[0].isdigit() else "a" if x[0].isalpha() else "_" if x[0].isspace() else x for x in _RUNS.findall(s[:60]))[:12]


def span_features(text: str, kind: int, start: int, end: int, vote: tuple[int, ...]) -> list[int]:
    """Places of the features that hold: the votes, then hashes of the span's shape, its size and what is around it."""
    at = kind * (1 + 2 * len(LABELERS))
    out = [at] + [at + 1 + 2 * k + (v > 0) for k, v in enumerate(vote) if v]
    before, after = text[max(0, start - CONTEXT_CHARS) : start], text[end : end + CONTEXT_CHARS]
    words, span = before.lower().split(), text[start:end]
    around = (
        ("shape", _shape(span)),
        ("size", str(min(40, end - start) // 4)),
        ("digits", str(10 * len(_digits(span)) // max(1, len(span)))),
        ("word", words[-1] if words else ""),
        ("left", _shape(before[-3:])),
        ("right", _shape(after[:3])),
    )
    return out + sorted({_VOTE_FEATURES + zlib.crc32(f"{kind} {name} {value}".encode()) % HASHED for name, value in around})


@dataclass
class SpanModel:
    """Reliabilities by kind and labeler (chance of a vote for, given personal data or not), and the classifier's weights."""

    prior: np.ndarray
    right: np.ndarray
    wrong: np.ndarray
    weights: np.ndarray

    def posterior(self, kinds: np.ndarray, vote: np.ndarray) -> np.ndarray:
        """Chance of personal data given the votes."""
        prior, right, wrong = self.prior[kinds], self.right[kinds], self.wrong[kinds]
        odds = np.log(prior / (1 - prior))
        odds = odds + np.where(vote > 0, np.log(right / wrong), 0).sum(1) + np.where(vote < 0, np.log((1 - right) / (1 - wrong)), 0).sum(1)
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    def probability(self, features: list[int]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[features].sum(), -30, 30))))


def fit_reliabilities(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = 60) -> SpanModel:
    """EM over (kind, votes, count)."""
    n_kinds, m = len(SPAN_KINDS), len(LABELERS)
    model = SpanModel(np.full(n_kinds, 0.5), np.full((n_kinds, m), 0.8), np.full((n_kinds, m), 0.3), np.zeros(FEATURES))
    if not patterns:
        return model
    kinds = np.array([p[0] for p in patterns], int)
    vote = np.array([p[1] for p in patterns], int).reshape(-1, m)
    count = np.array([p[2] for p in patterns], float)
    for _ in range(rounds):
        posterior = model.posterior(kinds, vote)
        for k in set(kinds.tolist()):
            own = kinds == k
            n, p = count[own], posterior[own]
            model.prior[k] = np.clip((n @ p + 1) / (n.sum() + 2), 0.01, 0.99)
            for j in range(m):
                yes, no = vote[own, j] > 0, vote[own, j] < 0
                model.right[k, j] = np.clip((n @ (p * yes) + 4) / (n @ (p * (yes | no)) + 5), 0.02, 0.98)
                model.wrong[k, j] = np.clip((n @ ((1 - p) * yes) + 1.5) / (n @ ((1 - p) * (yes | no)) + 5), 0.02, 0.98)
    return model


def fit_classifier(model: SpanModel, sample: list[tuple[int, tuple[int, ...], tuple[int, ...]]], l2: float = 1e-3, rounds: int = 25) -> None:
    """Logistic regression of the posteriors on (kind, votes, features), by Newton steps; equal rows count together."""
    seen: dict[tuple, int] = {}
    for row in sample:
        seen[row] = seen.get(row, 0) + 1
    rows = sorted(seen)
    if not rows:
        return
    share = np.array([seen[r] for r in rows], float) ** 0.5  # rare candidates count for something, too
    share /= share.sum()
    aim = model.posterior(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]).reshape(-1, len(LABELERS)))
    x = np.zeros((len(rows), FEATURES))
    for i, r in enumerate(rows):
        x[i, list(r[2])] = 1
    used = np.flatnonzero(x.any(0))
    x, w = x[:, used], np.zeros(len(used))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (share * (p - aim)) + l2 * w
        step = np.linalg.solve((x.T * (share * p * (1 - p))) @ x + l2 * np.eye(len(used)), gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    model.weights[used] = w


_SPAN = "struct<kind:int,start:int,end:int,base:boolean,votes:array<int>,features:array<int>>"


def _candidates(batches):
    for batch in batches:
        spans, digests, counts = [], [], []
        for text in batch.column("lw_text").to_pylist():
            base = sorted(base_spans(text), key=lambda x: (x[1], x[0])) if text else []
            loose = loose_spans(text, base) if text else []
            digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            counts.append([sum(k == kind for k, _, _ in base) for kind in range(4)])
            found = [(k, s, e, strict, votes(text, k, s, e, strict)) for own, strict in ((base, True), (loose, False)) for k, s, e in own]
            spans.append([{"kind": k, "start": s, "end": e, "base": strict, "votes": list(v), "features": span_features(text, k, s, e, v)} for k, s, e, strict, v in found])
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.list_(pa.int32())), ("features", pa.list_(pa.int32()))]))
        columns = list(zip(*counts)) if counts else [()] * 4
        yield pa.RecordBatch.from_arrays(
            [batch.column("lw_id"), *(pa.array(c, pa.int64()) for c in columns), pa.array(digests, pa.string()), pa.array(spans, kind)],
            names=["lw_id", *(f"lw_n_{k}" for k in KINDS), "lw_base_sha256", "lw_spans"],
        )


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find_personal_data(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """For every row: id, ``lw_n_<kind>`` and ``lw_base_sha256`` of the base spans, ``lw_spans``: array of (kind name,
    start, end, base, probability) of all spans, by start and kind. Offsets are code points, the end exclusive.

    A null or empty text has no spans; rows that repeat are searched each; other columns are left aside; an empty table
    gives an empty table. Ties between candidates go to the leftmost, then by kind.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id].dataType.simpleString()
    schema = f"lw_id {kind}, " + ", ".join(f"lw_n_{k} bigint" for k in KINDS) + f", lw_base_sha256 string, lw_spans array<{_SPAN}>"
    found = materialize(docs.select(F.col(id).alias("lw_id"), F.col(text).alias("lw_text")).mapInArrow(_candidates, schema), "candidates")
    spans = found.select("lw_id", F.explode("lw_spans").alias("s"))
    patterns = sorted((k, tuple(v), n) for k, v, n in spans.groupBy("s.kind", "s.votes").count().collect())  # kinds x 3^labelers rows at most
    model = fit_reliabilities(patterns)
    order = F.xxhash64("lw_id", "s.start", "s.kind", "s.features")
    sample = spans.orderBy(order).limit(SAMPLE_SPANS).select("s.kind", "s.votes", "s.features").collect()
    fit_classifier(model, [(k, tuple(v), tuple(f)) for k, v, f in sample])
    weights = F.array(*[F.lit(float(w)) for w in model.weights])
    names = F.array(*[F.lit(k) for k in SPAN_KINDS])
    score = lambda s: F.aggregate(s["features"], F.lit(0.0), lambda acc, f: acc + F.element_at(weights, f + 1))
    p = lambda s: 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), score(s)))))
    scored = F.transform("lw_spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("k"), s["end"].alias("end"), s["base"].alias("base"), p(s).alias("probability")))
    kept = F.array_sort(F.filter(scored, lambda s: s["base"] | (s["probability"] >= threshold)))
    final = F.transform(kept, lambda s: F.struct(F.element_at(names, s["k"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"), s["probability"].alias("probability")))
    return found.withColumn("lw_spans", final).withColumnRenamed("lw_id", id)


def span_list(spans):
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
