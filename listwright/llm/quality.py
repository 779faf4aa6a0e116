"""Quality rules with host-level verdicts.

Each document is measured once; a host's rate of failing documents is shrunk towards an empirical beta prior, so
that a host with few documents isn't judged by chance, and the host's verdict is joined back to its documents.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from listwright.llm.common import materialize, own_columns, small_batches, texts

_SPACE = b" \t\n\r\x0b\x0c"
_NOT_STARTS = _SPACE + bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


@dataclass(frozen=True)
class QualityRules:
    """Limits of the rules. ``max_host_rate``: shrunk share of failing documents beyond which a host is rejected."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbols_per_word: float = 0.5
    max_dup_line_share: float = 0.5
    max_capital_share: float = 0.5
    max_host_rate: float = 0.5
    default_strength: float = 50.0


def measure(text: bytes) -> tuple[int, ...]:
    """``MEASURES`` of one text."""
    words = text.split()
    lines, seen, dup = 0, set(), 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeated = 0
    if len(words) > 3:
        windows = list(zip(words, words[1:], words[2:]))
        counts = Counter(windows)
        if len(counts) < len(windows):
            covered_to = 0
            for i, w in enumerate(windows):
                if counts[w] > 1:
                    repeated += i + 3 - max(i, covered_to)
                    covered_to = i + 3
    return (
        len(words),
        len(text.translate(None, _NOT_STARTS)),
        len(text) - len(text.translate(None, _SYMBOLS)),
        dup,
        repeated,
        lines,
        sum(w.isupper() and len(w) > 2 for w in words),
    )


def _measured(batches):
    for batch in batches:
        rows = [measure(t) for t in texts(batch.column("lw_text"))]
        columns = list(zip(*rows)) if rows else [()] * len(MEASURES)
        keep = [i for i, name in enumerate(batch.schema.names) if name != "lw_text"]
        yield pa.RecordBatch.from_arrays(
            [batch.column(i) for i in keep] + [pa.array(c, pa.int64()) for c in columns],
            names=[batch.schema.names[i] for i in keep] + [f"lw_{m}" for m in MEASURES],
        )


def add_measures(docs: DataFrame, text: str = "text", drop_text: bool = False) -> DataFrame:
    """``docs`` with a long column ``lw_<measure>`` for each of ``MEASURES``; a null text counts as empty."""
    small_batches(docs.sparkSession)
    schema = StructType([f for f in docs.schema if not (drop_text and f.name == text)] + [StructField(f"lw_{m}", LongType()) for m in MEASURES])
    source = docs.withColumn("lw_text", F.col(text))
    return (source.drop(text) if drop_text else source).mapInArrow(_measured, schema)


def base_failed(rules: QualityRules):
    return (F.col("lw_n_words") < rules.min_words) | (
        100 * F.col("lw_n_repeat_words") > rules.max_repeat_percent * F.col("lw_n_words")
    )


def document_failed(rules: QualityRules):
    """The rules on a document alone: the base rules, symbols, repeated lines and capitals."""
    return (
        base_failed(rules)
        | (F.col("lw_n_symbols") > rules.max_symbols_per_word * F.col("lw_n_words"))
        | (F.col("lw_n_dup_lines") > rules.max_dup_line_share * F.col("lw_n_lines"))
        | (F.col("lw_n_capitals") > rules.max_capital_share * F.col("lw_n_words"))
    )


def host_verdicts(measured: DataFrame, host: str, rules: QualityRules) -> DataFrame:
    """One row per non-null host: ``lw_host``, documents, failures, shrunk rate, ``lw_host_rejected``.

    The beta prior comes from all hosts by moments: its mean is the overall failure rate, its strength what the
    spread of the hosts' rates leaves once binomial noise is taken off (``default_strength`` with no such spread).
    """
    hosts = (
        measured.where(F.col(host).isNotNull())
        .groupBy(F.col(host).alias("lw_host"))
        .agg(F.count("*").alias("lw_docs"), F.count_if(document_failed(rules)).alias("lw_failures"))
    )
    hosts = materialize(hosts, "hosts")
    total = hosts.agg(F.sum("lw_docs"), F.sum("lw_failures"), F.count("*")).first()
    docs, failures, n_hosts = (x or 0 for x in total)
    mean = failures / docs if docs else 0.0
    strength = rules.default_strength
    if n_hosts > 1 and 0 < mean < 1:
        rate = F.col("lw_failures") / F.col("lw_docs")
        spread, squares = hosts.agg(
            F.sum(F.col("lw_docs") * (rate - mean) * (rate - mean)), F.sum(F.col("lw_docs").cast("double") * F.col("lw_docs"))
        ).first()
        between = (spread - (n_hosts - 1) * mean * (1 - mean)) / max(docs - squares / docs, 1e-9)
        if between > 0:
            strength = min(max(mean * (1 - mean) / between - 1, 1.0), 1e6)
    shrunk = (F.col("lw_failures") + mean * strength) / (F.col("lw_docs") + strength)
    return hosts.withColumn("lw_host_rate", shrunk).withColumn(
        "lw_host_rejected", F.col("lw_host_rate") > rules.max_host_rate
    )


def judge(measured: DataFrame, host: str, rules: QualityRules = QualityRules()) -> DataFrame:
    """Measured documents with ``lw_base_failed``, ``lw_host_rate`` (null without a host) and ``lw_kept``.

    A document is kept unless it fails a rule itself or its host is rejected. A null host has no verdict. Empty
    texts fail ``min_words``. Repeated rows are judged alike; an empty table gives an empty table.
    """
    verdicts = materialize(host_verdicts(measured, host, rules).select("lw_host", "lw_host_rate", "lw_host_rejected"), "verdicts")
    return (
        measured.join(verdicts, F.col(host) == F.col("lw_host"), "left")
        .withColumn("lw_base_failed", base_failed(rules))
        .withColumn("lw_kept", ~document_failed(rules) & ~F.coalesce("lw_host_rejected", F.lit(False)))
        .drop("lw_host", "lw_host_rejected")
    )


def quality_report(docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source", rules: QualityRules = QualityRules()) -> DataFrame:
    """Measures and verdict of every document, without its text."""
    narrow = docs.select(F.col(id).alias("doc_id"), F.col(host).alias("lw_source"), F.col(text).alias("lw_body"))
    measured = materialize(add_measures(narrow, "lw_body", drop_text=True), "measured")
    return judge(measured, "lw_source", rules)


def quality_filter(docs: DataFrame, text: str = "text", host: str = "source", rules: QualityRules = QualityRules()) -> DataFrame:
    """The documents that are kept, with their own columns only, whatever their names; texts are measured once."""
    rows = docs.select(F.col(host).alias("lw_host_of"), F.col(text).alias("lw_body"), F.struct(*own_columns(docs)).alias("lw_own"))
    measured = add_measures(rows, "lw_body", drop_text=True)
    failed = document_failed(rules)
    slim = measured.select("lw_host_of", *[f"lw_{m}" for m in MEASURES], F.when(~failed, F.col("lw_own")).alias("lw_own"))
    measured = materialize(slim, "measured")
    rejected = materialize(host_verdicts(measured, "lw_host_of", rules).where("lw_host_rejected").select("lw_host"), "rejected")
    kept = measured.where(~failed).join(rejected, F.col("lw_host_of") == F.col("lw_host"), "left_anti")
    return kept.select("lw_own.*")
