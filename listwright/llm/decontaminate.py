"""Benchmark decontamination: BM25 over an inverted index of test items, searched by block-max WAND.

Every passage of every document is a query. An item's threshold is its own score less the most that a copy may lose
and still share 80% of the item's five-word shingles, so the search misses no such copy. Retrieved items are verified
on their shingles and on the words of their question and their answer.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.llm.common import Shared, materialize, own_columns, small_batches


@dataclass(frozen=True)
class LeakRules:
    """``similarity``: share of an item's shingles that a passage must hold. ``parts``: share of the words of the
    question and of the answer. ``block_words``: words of items indexed, and broadcast, at once."""

    k1: float = 1.2
    b: float = 0.75
    shingle: int = 5
    similarity: float = 0.8
    parts: float = 0.5
    block_words: int = 500_000
    items_per_block: int = 4


#: Lower-case ASCII, white space for ASCII punctuation and controls; other bytes stay.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def tokens(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_FOLD).split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The answer is an item's last line, or its last sentence where it has one line, or its last quarter."""
    lines = [x for x in (text or "").split("\n") if tokens(x)]
    if len(lines) < 2:
        lines = [x for x in re.split(r"(?<=[.?!])\s+", text or "") if tokens(x)]
    if len(lines) > 1:
        return [w for x in lines[:-1] for w in tokens(x)], tokens(lines[-1])
    words = tokens(text)
    cut = max(1, len(words) - max(1, len(words) // 4))
    return words[:cut], words[cut:]


def shingles(words: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    """Distinct runs of n words; all words as one run where there are fewer."""
    return set(zip(*(words[i:] for i in range(n)))) if len(words) >= n else ({tuple(words)} if words else set())


class Index:
    """Inverted index of one block of items. Impacts are divided by their item's threshold, so that 1 is enough."""

    def __init__(self, items: list[tuple[int, str]], frequency: dict[bytes, int], n_items: int, mean_words: float, rules: LeakRules):
        self.rules = rules
        self.items = []  # (item id, words, shingles, question words, answer words)
        self.longest = 1
        self.blocks: list[dict[bytes, list[tuple[int, float]]]] = []  # of few items each: postings by term
        gate = defaultdict(set)
        for item, text in sorted(items, key=lambda x: (x[0] is None, x[0], x[1] or "")):
            words = tokens(text)
            grams = shingles(words, rules.shingle)
            if not words:
                continue
            norm = rules.k1 * (1 - rules.b + rules.b * len(words) / mean_words)
            impact = {}
            for t, tf in Counter(words).items():
                df = frequency[t]
                impact[t] = math.log(1 + (n_items - df + 0.5) / (df + 0.5)) * tf * (rules.k1 + 1) / (tf + norm)
            may_lose = len(grams) - math.ceil(rules.similarity * len(grams) - 1e-9)
            spare = sum(sorted(impact.values(), reverse=True)[:may_lose])
            threshold = max(sum(impact.values()) - spare, 1e-6)
            slot = len(self.items)
            question, answer = question_and_answer(text)
            self.items.append((item, grams, set(question), set(answer)))
            self.longest = max(self.longest, len(words))
            mass, own_essential = 0.0, []
            # the commonest terms that are together below the threshold can't retrieve the item; the others gate it
            for t in sorted(impact, key=lambda t: (-frequency[t], len(t), t)):
                mass += impact[t] / threshold
                if mass >= 1 - 1e-9:
                    own_essential.append(t)
            block = slot // rules.items_per_block
            if block == len(self.blocks):
                self.blocks.append(defaultdict(list))
            for t, x in impact.items():
                self.blocks[block][t].append((slot, x / threshold))
            for t in own_essential:
                gate[t].add(block)
        self.gate = {t: tuple(sorted(b)) for t, b in gate.items()}
        self.essential = frozenset(self.gate)
        self.block_max = [{t: max(x for _, x in own) for t, own in block.items()} for block in self.blocks]
        self.block_terms = [frozenset(block) for block in self.blocks]

    def search(self, words: set[bytes]) -> list[tuple[int, float]]:
        """Block-max WAND: all (slot, score) with a score of 1 or more for the query ``words``.

        Items are in small blocks with each term's largest impact there. Only blocks that hold an essential term of the
        query are looked at, and only those whose largest impacts reach the threshold are opened."""
        hits = self.essential & words
        found = []
        if hits:
            for b in sorted({b for t in hits for b in self.gate[t]}):
                terms = self.block_terms[b] & words
                most = self.block_max[b]
                if sum(map(most.__getitem__, terms)) >= 1 - 1e-9:
                    found += self._pivot(b, terms)
        return found

    def _pivot(self, b: int, terms) -> list[tuple[int, float]]:
        """WAND within a block: the pivot is the first item that the terms up to it can lift to the threshold."""
        most, lists = self.block_max[b], self.blocks[b]
        cursors = sorted([lists[t][0][0], t, 0] for t in terms)
        done = len(self.items)
        found = []
        while cursors:
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += most[c[1]]
                if bound >= 1 - 1e-9:
                    pivot = k
                    break
            if pivot < 0:
                break
            slot = target = cursors[pivot][0]
            if cursors[0][0] == slot:
                score = sum(lists[t][at][1] for at_slot, t, at in cursors if at_slot == slot)
                if score >= 1 - 1e-9:
                    found.append((slot, score))
                target = slot + 1
            for c in cursors:
                own = lists[c[1]]
                while c[0] < target:
                    c[2] += 1
                    c[0] = own[c[2]][0] if c[2] < len(own) else done
            cursors = sorted(c for c in cursors if c[0] < done)
        return found

    def leaks(self, text: str | None) -> list[tuple[int, float, float, float, float]]:
        """(item id, score, shingle, question and answer share) of each item that a passage of ``text`` repeats, at its best.

        Passages are twice as long as the longest item and overlap by half, so one holds any copy whole."""
        words = tokens(text)
        step = self.longest + self.rules.shingle
        best: dict[int, tuple] = {}
        for at in range(0, max(1, len(words) - step), step):
            passage = words[at : at + 2 * step]
            present = set(passage)
            hits = self.search(present)
            if not hits:
                continue
            grams = shingles(passage, self.rules.shingle)
            for slot, score in hits:
                item, own, question, answer = self.items[slot]
                share = len(own & grams) / len(own) if len(passage) >= self.rules.shingle and len(next(iter(own))) == self.rules.shingle else float(
                    _holds(passage, next(iter(own)))
                )
                q = len(question & present) / len(question) if question else 1.0
                a = len(answer & present) / len(answer) if answer else 1.0
                if share >= self.rules.similarity - 1e-9 and min(q, a) >= self.rules.parts:
                    if slot not in best or best[slot][1:] < (score, share, q, a):
                        best[slot] = (item, score, share, q, a)
        return [best[s] for s in sorted(best)]


def _holds(words: list[bytes], run: tuple[bytes, ...]) -> bool:
    n = len(run)
    return any(tuple(words[i : i + n]) == run for i in range(len(words) - n + 1))


def build_indexes(benchmark: DataFrame, item: str = "item_id", text: str = "text", rules: LeakRules = LeakRules()):
    """Indexes of the items, block by block; BM25's statistics are over all items. Null and empty items match nothing."""
    rows = benchmark.select(F.col(item).alias("lw_item"), F.col(text).alias("lw_text")).where("lw_text is not null").distinct()
    fold = F.udf(lambda t: [w.decode("utf-8", "replace") for w in tokens(t)], "array<string>")
    rows = materialize(rows.withColumn("lw_words", fold("lw_text")), "items")
    n_items, n_words = rows.agg(F.count("*"), F.sum(F.size("lw_words"))).first()
    if not n_items or not n_words:
        return
    blocks = -(-n_words // rules.block_words)
    frequency = rows.select("lw_item", "lw_text", F.explode(F.array_distinct("lw_words")).alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    frequency = materialize(frequency, "frequency")
    rows = rows.withColumn("lw_block", F.pmod(F.xxhash64("lw_item", "lw_text"), F.lit(blocks)))
    for k in range(blocks):
        block = rows.where(F.col("lw_block") == k)
        terms = block.select(F.explode("lw_words").alias("w")).distinct()
        df = {w.encode(): n for w, n in frequency.join(terms, "w").collect()}
        items = [(i, t) for i, t in block.select("lw_item", "lw_text").collect()]
        yield Index(items, df, n_items, n_words / n_items, rules)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", rules: LeakRules = LeakRules()) -> DataFrame:
    """One row per document and item that it repeats: id, ``item_id``, ``score`` (BM25 over the item's threshold),
    ``shingle_share``, ``question_share``, ``answer_share``.

    Null and empty texts repeat nothing; rows that repeat an id each give their rows. An empty table on either side
    gives an empty table. Items are taken in blocks of ``block_words`` words, each with a pass over ``docs``: benchmarks
    are small, and no block grows with them.
    """
    spark = docs.sparkSession
    small_batches(spark)
    id_type = docs.schema[id].dataType.simpleString()
    item_type = benchmark.schema[item].dataType.simpleString()
    schema = f"`{id}` {id_type}, item_id {item_type}, score double, shingle_share double, question_share double, answer_share double"
    item_arrow = benchmark.select(item).limit(0).toArrow().schema.field(0).type
    narrow = docs.select(F.col(id).alias("lw_id"), F.col(text).alias("lw_text"))
    found = spark.createDataFrame([], schema)
    for index in build_indexes(benchmark, item, "text", rules):
        held = Shared(spark, index)

        def search(batches, held=held):
            for batch in batches:
                index, rows, out = held.value, [], []
                for k, t in enumerate(batch.column("lw_text").to_pylist()):
                    for hit in index.leaks(t):
                        rows.append(k)
                        out.append(hit)
                columns = list(zip(*out)) if out else [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [batch.column("lw_id").take(pa.array(rows, pa.int64())), pa.array(columns[0], item_arrow)]
                    + [pa.array(c, pa.float64()) for c in columns[1:]],
                    names=[id, "item_id", "score", "shingle_share", "question_share", "answer_share"],
                )

        found = found.unionByName(narrow.mapInArrow(search, schema))
    return found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", rules: LeakRules = LeakRules()) -> DataFrame:
    """The documents that repeat no item, with their own columns only, whatever their names."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(text).alias("lw_text"), F.struct(*own_columns(docs)).alias("lw_own"))
    for index in build_indexes(benchmark, item, "text", rules):
        held = Shared(docs.sparkSession, index)

        def clean(batches, held=held):
            for batch in batches:
                index = held.value
                yield batch.filter(pa.array([not index.leaks(t) for t in batch.column("lw_text").to_pylist()], pa.bool_()))

        rows = rows.mapInArrow(clean, rows.schema)
    return rows.select("lw_own.*")
