"""URL filters: rules by host and path, and for the rest a naive Bayes model over the words that hosts and paths hold.

Names of hosts run words together, so each distinct run of letters of a host is cut by a unigram Viterbi search. The words
are counted in the pages' own texts and in what hyphens part in hosts. The model is multinomial naive Bayes over the words
of the host and those of the path, each in its own name space, in a table of fixed size. It learns from all pages; those
whose host has one of the seed words are its examples of what to block, the others of what to allow.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.llm.common import Shared, materialize, own_columns

ALLOW, BLOCK = "allow", "block"
# fixed values: words that name what is to be blocked
SEED_WORDS = (
    "adult", "ads", "adserver", "bet", "bets", "betting", "casino", "cheap", "escort", "gambling", "jackpot", "lottery", "malware", "payday",
    "phishing", "pills", "poker", "porn", "replica", "sex", "slots", "spam", "viagra", "warez", "xxx",
)


@dataclass(frozen=True)
class UrlRule:
    """Fits ``host`` and all its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str


@dataclass(frozen=True)
class UrlPlan:
    """``longest``: letters a word may have. ``slots``: of the table of words. ``seed_count``: how often a seed word counts
    as seen, so that the search knows it. ``threshold``: probability from which a URL is blocked."""

    rules: tuple[UrlRule, ...] = ()
    seeds: tuple[str, ...] = SEED_WORDS
    seed_count: int = 50
    longest: int = 20
    slots: int = 1 << 18
    threshold: float = 0.5


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` and for null."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[UrlRule]) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null without one. Rules are looked up by the host's last
    labels, so their number costs no more than a look for each number of labels that rules have."""
    if not rules:
        return F.lit(None).cast("struct<rule: string, verdict: string>")
    by_host: dict[str, list[UrlRule]] = {}
    for rule in sorted(rules, key=lambda r: -len(r.path)):
        by_host.setdefault(rule.host, []).append(rule)
    entry = lambda r: F.struct(F.lit(r.path).alias("path"), F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))
    table = F.create_map(*[x for h, own in by_host.items() for x in (F.lit(h), F.array(*map(entry, own)))])
    found = []
    # a rule of more labels has the longer host, and among those of one host the longer path is first
    for labels in sorted({h.count(".") + 1 for h in by_host}, reverse=True):
        own = F.try_element_at(table, F.substring_index(host, ".", -labels))
        found.append(F.get(F.filter(own, lambda r: F.startswith(path, r["path"])), F.lit(0)))
    best = F.array_compact(F.array(*found))
    longest = F.reduce(best, F.get(best, F.lit(0)), lambda a, b: F.when(F.length(b["rule"]) > F.length(a["rule"]), b).otherwise(a))
    return F.when(longest.isNotNull(), F.struct(longest["rule"].alias("rule"), longest["verdict"].alias("verdict")))


def word_counts(texts: DataFrame, text: str, hosts: DataFrame, plan: UrlPlan) -> DataFrame:
    """(``lw_word``, ``lw_n``): the words of all texts without their tags and what hyphens part in ``hosts.lw_host``, each
    of at most ``longest`` letters, and the seed words."""
    plain = F.regexp_replace(F.col(text), "<[^>]*(>|$)", " ")
    words = texts.select(F.explode(F.regexp_extract_all(F.lower(plain), F.lit(r"\p{L}+"), F.lit(0))).alias("lw_word"))
    parted = hosts.select(F.explode(F.regexp_extract_all("lw_host", F.lit(r"(?<=-)\p{L}+|\p{L}+(?=-)"), F.lit(0))).alias("lw_word"))
    counted = words.unionAll(parted).groupBy("lw_word").agg(F.count("*").alias("lw_n"))
    seeds = texts.sparkSession.range(1).select(F.explode(F.array(*[F.lit(s) for s in plan.seeds])).alias("lw_word"), F.lit(plan.seed_count).cast("long").alias("lw_n")) if plan.seeds else None
    every = counted.where((F.length("lw_word") <= plan.longest) & (F.length("lw_word") > 0))
    return (every if seeds is None else every.unionAll(seeds)).groupBy("lw_word").agg(F.sum("lw_n").alias("lw_n"))


def best_split(run: str, hits: dict[tuple[int, int], int], total: int, longest: int) -> list[str]:
    """The cut of ``run`` with the largest product of word probabilities. ``hits``: counts of the words at (start, length).
    What no word covers counts ``10 / (total 10^length)``, of at most ``longest`` letters. Of equal cuts the one whose last
    word is longest."""
    unknown = math.log(10) - math.log(total or 1)
    best, back = [0.0] + [-math.inf] * len(run), [0] * (len(run) + 1)
    for end in range(1, len(run) + 1):
        for start in range(max(0, end - longest), end):
            n = hits.get((start, end - start))
            score = best[start] + (math.log(n / total) if n else unknown - (end - start) * math.log(10))
            if score > best[end]:
                best[end], back[end] = score, start
    words, end = [], len(run)
    while end:
        words.append(run[back[end] : end])
        end = back[end]
    return words[::-1]


def segmented_runs(hosts: DataFrame, words: DataFrame, plan: UrlPlan) -> DataFrame:
    """(``lw_run``, ``lw_words``) of every distinct run of letters in ``hosts.lw_host``. The places where a word stands in
    a run come from a join of the run's pieces with the words, which Spark splits where a piece is common."""
    runs = materialize(hosts.select(F.explode(F.regexp_extract_all("lw_host", F.lit(r"\p{L}+"), F.lit(0))).alias("lw_run")).where("lw_run != ''").distinct(), "runs")
    total = words.agg(F.sum("lw_n")).first()[0] or 0
    at = runs.select("lw_run", F.explode(F.sequence(F.lit(1), F.length("lw_run"))).alias("lw_at"))
    pieces = at.select("lw_run", "lw_at", F.explode(F.sequence(F.lit(1), F.least(F.lit(plan.longest), F.length("lw_run") - F.col("lw_at") + 1))).alias("lw_length"))
    pieces = pieces.withColumn("lw_word", F.substring("lw_run", F.col("lw_at"), F.col("lw_length")))
    hits = pieces.join(words, "lw_word").groupBy("lw_run").agg(F.collect_list(F.struct("lw_at", "lw_length", "lw_n")).alias("lw_hits"))

    def split(batches):
        for batch in batches:
            names = batch.column(0).to_pylist()
            found = batch.column(1).to_pylist()
            cut = [best_split(r, {(h["lw_at"] - 1, h["lw_length"]): h["lw_n"] for h in hs or ()}, total, plan.longest) for r, hs in zip(names, found)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(cut, pa.list_(pa.string()))], names=["lw_run", "lw_words"])

    return runs.join(hits, "lw_run", "left").select("lw_run", "lw_hits").mapInArrow(split, "lw_run string, lw_words array<string>")


def _slots(words: Column, space: str, plan: UrlPlan) -> Column:
    return F.transform(words, lambda w: F.pmod(F.xxhash64(F.concat(F.lit(space), w)), F.lit(plan.slots)).cast("int"))


def judge_urls(pages: DataFrame, texts: DataFrame, url: str = "url", text: str = "html", plan: UrlPlan = UrlPlan()) -> DataFrame:
    """Words are learned from ``texts``, which need not be of these pages. Every row of ``pages``, under ``lw_own``, with ``lw_host``, ``lw_path``, ``lw_rule`` (null without one),
    ``lw_verdict``, ``lw_words`` (of the host) and ``lw_score`` (probability of the model that the URL is to be blocked).

    A URL that is null or has no ``://`` has an empty host and path, fits no rule, and its score is the share of blocked
    examples; so is that of a host without letters and an empty path. Runs of digits in a path are one word. Rows that repeat
    are judged alike, and learned from as often as they stand. Null texts have no words. Where no host has a seed word, or
    every host has one, nothing is to be told apart: the score is that share for all. Other columns may be null and have any
    names. An empty table gives an empty table.
    """
    spark = pages.sparkSession
    parts = pages.select(F.struct(*own_columns(pages)).alias("lw_own"), host_of(F.col(url)).alias("lw_host"), path_of(F.col(url)).alias("lw_path"))
    hosts = materialize(parts.groupBy("lw_host").agg(F.count("*").alias("lw_pages")), "hosts")
    words = materialize(word_counts(texts, text, hosts, plan), "words")
    runs = materialize(segmented_runs(hosts, words, plan), "runs")
    placed = hosts.select("lw_host", F.posexplode(F.regexp_extract_all("lw_host", F.lit(r"\p{L}+"), F.lit(0))).alias("lw_at", "lw_run"))
    told = placed.join(runs, "lw_run").groupBy("lw_host").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("lw_at", "lw_words"))), lambda r: r["lw_words"])).alias("lw_words"))
    told = materialize(told.withColumn("lw_seeded", F.arrays_overlap("lw_words", F.array(*[F.lit(s) for s in plan.seeds]).cast("array<string>"))), "told")

    path_words = F.regexp_extract_all(F.lower("lw_path"), F.lit(r"\p{L}+|\p{Nd}+"), F.lit(0))
    path_words = F.transform(F.filter(path_words, lambda w: w != ""), lambda w: F.regexp_replace(w, r"^\p{Nd}+$", "#"))
    # the join is an inner or left one on the host, so Spark splits a host that has a third of the pages
    known = parts.join(told, "lw_host", "left")
    known = known.withColumn("lw_words", F.coalesce("lw_words", F.array().cast("array<string>"))).withColumn("lw_seeded", F.coalesce("lw_seeded", F.lit(False)))
    known = materialize(known.withColumn("lw_slots", F.concat(_slots(F.col("lw_words"), "host:", plan), _slots(path_words, "path:", plan))), "known")

    # at most two rows a slot come here
    counts = known.select("lw_seeded", F.explode("lw_slots").alias("lw_slot")).groupBy("lw_seeded", "lw_slot").agg(F.count("*").alias("lw_n")).toPandas()
    shares = dict(known.groupBy("lw_seeded").agg(F.count("*")).collect())
    blocked, allowed = shares.get(True, 0), shares.get(False, 0)
    weights, prior = np.zeros(plan.slots), -math.inf if not blocked else math.inf if not allowed else math.log(blocked / allowed)
    if blocked and allowed:
        by_class = np.zeros((2, plan.slots))
        by_class[counts["lw_seeded"].to_numpy(int), counts["lw_slot"].to_numpy(int)] = counts["lw_n"].to_numpy(float)
        used = int((by_class.sum(0) > 0).sum())
        logs = np.log(by_class + 1) - np.log(by_class.sum(1, keepdims=True) + used)
        weights = np.where(by_class.sum(0) > 0, logs[1] - logs[0], 0.0)
    shared = Shared(spark, (weights, prior))

    def scored(batches):
        table, start = shared.value
        for batch in batches:
            slots = batch.column("lw_slots").combine_chunks() if isinstance(batch.column("lw_slots"), pa.ChunkedArray) else batch.column("lw_slots")
            sizes = slots.value_lengths().to_numpy(zero_copy_only=False)
            own = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=table[slots.flatten().to_numpy(zero_copy_only=False)], minlength=len(sizes))
            p = 1 / (1 + np.exp(-np.clip(own + start, -700, 700))) if math.isfinite(start) else np.full(len(sizes), float(start > 0))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("lw_own", "lw_host", "lw_path", "lw_words")], pa.array(p)], names=["lw_own", "lw_host", "lw_path", "lw_words", "lw_score"])

    narrow = known.select("lw_own", "lw_host", "lw_path", "lw_words", "lw_slots")
    schema = type(known.schema)([f for f in narrow.schema.fields if f.name != "lw_slots"]).add("lw_score", "double")
    rule = rule_of(F.col("lw_host"), F.col("lw_path"), plan.rules)
    out = narrow.mapInArrow(scored, schema).withColumn("lw_fits", rule)
    verdict = F.coalesce(F.col("lw_fits.verdict"), F.when(F.col("lw_score") >= plan.threshold, BLOCK).otherwise(ALLOW))
    return out.select("lw_own", "lw_host", "lw_path", F.col("lw_fits.rule").alias("lw_rule"), verdict.alias("lw_verdict"), "lw_words", "lw_score")
