"""Language-model scoring by context-tree weighting over bytes.

A text is its lower-cased words joined by one space, then an end byte, coded byte by byte, each byte as eight binary
decisions. Every decision has a tree of contexts, the preceding bytes of the running text across its words, nearest
first, up to ``DEPTH`` of them. A node's Krichevsky-Trofimov estimate is mixed with what its children make of the same
data, half and half, over all depths.

A gram is a byte with the ``DEPTH`` bytes before it. Grams are counted over all training texts, the trees are weighted
by nearest contexts in parallel, and each distinct gram is scored once. Texts add up the scores of their grams: those of
the most frequent ones from a table of fixed size, all others by a join.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.llm.common import materialize, small_batches, texts, whole_groups

#: Bytes of context; with the byte itself they make one 64-bit number.
DEPTH = 6
#: Trees are cut at this depth: what lies below is weighted apart for each context of so many bytes.
NEAR = 3
#: The end of a text is a token of its own; no word contains a line feed. Texts begin as if after an end.
END = b"\n"
_LN_HALF = math.log(0.5)
#: Tokens that make up at least one in so many of all tokens are looked up in memory, so there are at most so many.
HOT_TOKENS = 1 << 20
#: Slots of the table of frequent grams that each task holds.
HOT_GRAMS = 1 << 22
#: Bytes of text whose grams are made at once, grams counted at once, and distinct ones held before they are passed on.
WINDOW, _FLUSH_GRAMS, _HELD_GRAMS = 1 << 20, 2 << 20, 5 << 19
_FLUSH = 300_000
_SMALL = 1 << 16
#: Rows of a tree's level at once, about, and rows of a batch that goes to Spark.
_ROWS, _BATCH = 25_000, 1 << 15


def running_text(text: bytes) -> bytes:
    return b" ".join(text.lower().split()) + END


def grams_of(bodies: list[bytes]):
    """(grams, owners): for each byte of ``bodies`` the ``DEPTH`` bytes before it, nearest first, then the byte, as one
    number; and which body it is of. In windows, so that a long body needs no more memory than a short one."""
    pad = END * DEPTH
    pieces, owners, held = [], [], 0

    def made():
        buffer = np.frombuffer(b"".join(pieces), np.uint8)
        keys = np.zeros(len(buffer) - DEPTH, np.uint64)
        for back in range(1, DEPTH + 1):
            keys <<= np.uint64(8)
            keys |= buffer[DEPTH - back : len(buffer) - back]
        keys <<= np.uint64(8)
        keys |= buffer[DEPTH:]
        sizes = np.array([len(p) - DEPTH for p in pieces])
        at = np.cumsum(sizes + DEPTH) - DEPTH
        keep = np.ones(len(keys), bool)
        for k in range(DEPTH):  # bytes that are only context
            keep[at[:-1] + k] = False
        return keys[keep].view(np.int64), np.repeat(np.array(owners), sizes)

    for owner, body in enumerate(bodies):
        for start in range(0, len(body), WINDOW):
            before = body[start - DEPTH : start] if start else pad
            pieces.append(before + body[start : start + WINDOW])
            owners.append(owner)
            held += len(pieces[-1])
            if held >= WINDOW:
                yield made()
                pieces, owners, held = [], [], 0
    if held:
        yield made()


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after shifting the argument by 8."""
    shift = np.ones_like(x)
    for k in range(8):
        shift *= x + k
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


_LOG_GAMMA_HALF = math.lgamma(0.5) + np.concatenate(([0.0], np.cumsum(np.log(np.arange(_SMALL - 1) + 0.5))))
_LOG_FACTORIAL = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1.0, _SMALL)))))


def log_kt(own: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov block probability of ``own`` ones among ``total`` bits."""
    out = np.empty(own.shape)
    small = total < _SMALL
    a, n = own[small], total[small]
    out[small] = _LOG_GAMMA_HALF[a] + _LOG_GAMMA_HALF[n - a] - _LOG_FACTORIAL[n]
    if not small.all():
        a, n = own[~small].astype(np.float64), total[~small].astype(np.float64)
        out[~small] = log_gamma(a + 0.5) + log_gamma(n - a + 0.5) - log_gamma(n + 1)
    return out - math.log(math.pi)


class Level:
    """One depth of the trees, over sorted rows of a context and a byte.

    The k-th decision's node of a row is its context with the byte's first k bits: a run of rows. For each decision
    and row: ``total`` of the node, that of its next bit (the following entry), ``estimate`` and ``weighted``."""

    def __init__(self, rows: np.ndarray, n: np.ndarray):
        self.rows, self.n = rows, n
        self.total = np.empty((9, len(rows)), np.int64)
        self.first = np.ones((9, len(rows)), bool)
        self.runs = []
        for k in range(9):
            prefix = rows >> (8 - k)
            self.first[k, 1:] = prefix[1:] != prefix[:-1]
            run = np.cumsum(self.first[k]) - 1, np.flatnonzero(self.first[k])
            self.runs.append(run)
            self.total[k] = np.add.reduceat(n, run[1])[run[0]]
        self.estimate = log_kt(self.total[1:], self.total[:-1])
        self.weighted = self.estimate
        self.up = None

    def node_sums(self, values: np.ndarray) -> np.ndarray:
        """Sums over each decision's nodes."""
        return np.stack([np.add.reduceat(v, at)[of] for v, (of, at) in zip(values, self.runs)])

    def parent(self) -> Level:
        """The level above; this one's ``up`` says which of its rows each row belongs to."""
        rows, self.up = np.unique(((self.rows >> 16) << 8) | (self.rows & 255), return_inverse=True)
        level = Level(rows, np.bincount(self.up, self.n, len(rows)).astype(np.int64))
        level.take_children(self.passed_up(len(rows)))
        return level

    def passed_up(self, size: int) -> np.ndarray:
        """Weighted probabilities of this level's nodes, each counted once, by row of the level above."""
        return np.stack([np.bincount(self.up, np.where(f, w, 0.0), size) for f, w in zip(self.first, self.weighted)])

    def take_children(self, sums: np.ndarray):
        self.weighted = np.logaddexp(self.estimate, self.node_sums(sums)) + _LN_HALF

    def chance(self) -> np.ndarray:
        """Of each row's bit at each decision, by the node's own estimate."""
        return (self.total[1:] + 0.5) / (self.total[:-1] + 1)

    def mix(self, known: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Going down: the probability mixed so far and the weight left for what is deeper."""
        stop = np.exp(_LN_HALF + self.estimate - self.weighted)
        return known + left * stop * self.chance(), left * (1 - stop)


def _below(grams: np.ndarray, n: np.ndarray, until: int = NEAR) -> list[Level]:
    """Levels from the leaves up to depth ``until``."""
    levels = [Level(grams, n)]
    for _ in range(DEPTH - until):
        levels.append(levels[-1].parent())
    return levels


def _weights(table) -> np.ndarray:
    return table.combine_chunks().flatten().to_numpy().reshape(-1, 8).T


def _lists(values: np.ndarray) -> pa.Array:
    width = len(values)
    return pa.ListArray.from_arrays(pa.array(np.arange(values.shape[1] + 1, dtype=np.int32) * width), pa.array(values.T.ravel()))


def _near_roots(batches):
    """Rows of depth ``NEAR`` with their counts and weighted probabilities."""
    for table in whole_groups(batches, _ROWS):
        order = np.argsort(table["lw_gram"].to_numpy())
        root = _below(table["lw_gram"].to_numpy()[order], table["lw_n"].to_numpy()[order])[-1]
        yield pa.RecordBatch.from_arrays([pa.array(root.rows >> 16), pa.array(root.rows), pa.array(root.n), _lists(root.weighted)], names=["lw_two", "lw_row", "lw_n", "lw_w"])


def _middle(table) -> list[Level]:
    """Levels from depth ``NEAR`` up to 1, from the roots below."""
    order = np.argsort(table["lw_row"].to_numpy())
    level = Level(table["lw_row"].to_numpy()[order], table["lw_n"].to_numpy()[order])
    level.weighted = _weights(table["lw_w"])[:, order]
    levels = [level]
    for _ in range(NEAR - 2):
        levels.append(levels[-1].parent())
    return levels


def _to_crown(batches):
    """What the nodes of depth 2 pass to each context of one byte."""
    for table in whole_groups(batches, _ROWS):
        level = _middle(table)[-1]
        rows, level.up = np.unique(((level.rows >> 16) << 8) | (level.rows & 255), return_inverse=True)
        sums = level.passed_up(len(rows))
        n = np.bincount(level.up, level.n, len(rows)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(n), *(pa.array(s) for s in sums)], names=["lw_row", "lw_n", *(f"lw_w{k}" for k in range(8))])


class Crown:
    """Depths 1 and 0 of all trees: at most 256 x 256 rows, whatever the corpus."""

    def __init__(self, rows: list[tuple]):
        rows = sorted(rows)
        self.rows = np.array([r[0] for r in rows], np.int64)
        if not rows:
            return
        one = Level(self.rows, np.array([r[1] for r in rows], np.int64))
        one.take_children(np.array([r[2:] for r in rows]).T)
        zero = one.parent()
        known, left = zero.mix(np.zeros((8, len(zero.rows))), np.ones((8, len(zero.rows))))
        self.known, self.left = one.mix(known[:, one.up], left[:, one.up])


def _down(crown: Crown):
    """Rows of depth ``NEAR`` with the probability mixed above them and the weight left."""

    def mix(batches):
        for table in whole_groups(batches, _ROWS):
            levels = _middle(table)
            top = levels[-1].rows
            at = np.searchsorted(crown.rows, ((top >> 16) << 8) | (top & 255))
            known, left = crown.known[:, at], crown.left[:, at]
            for level, lower in zip(levels[:0:-1], levels[-2::-1]):
                known, left = level.mix(known, left)
                known, left = known[:, lower.up], left[:, lower.up]
            rows = levels[0].rows
            yield pa.RecordBatch.from_arrays([pa.array(rows >> 8), pa.array(rows), _lists(np.concatenate((known, left)))], names=["lw_near", "lw_row", "lw_mixed"])

    return mix


def _scores(batches):
    """log10 of each gram's weighted probability; its rows come with those of depth ``NEAR`` (which have ``lw_mixed``)."""
    for table in whole_groups(batches, _ROWS):
        above = table["lw_mixed"].is_valid().combine_chunks().to_numpy(zero_copy_only=False)
        keys, n = table["lw_gram"].to_numpy(), table["lw_n"].to_numpy()
        order = np.argsort(keys[~above])
        levels = _below(keys[~above][order], n[~above][order])
        mixed = table.filter(pa.array(above))["lw_mixed"].combine_chunks().flatten().to_numpy().reshape(-1, 16).T
        mixed = mixed[:, np.argsort(keys[above])]
        known, left = mixed[:8], mixed[8:]
        for level, lower in zip(levels[:0:-1], levels[-2::-1]):
            known, left = level.mix(known, left)
            known, left = known[:, lower.up], left[:, lower.up]
        score = np.log10(known + left * levels[0].chance()).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(levels[0].rows), pa.array(score), table.filter(pa.array(~above))["lw_all"].combine_chunks().take(pa.array(order))], names=["lw_gram", "lw_score", "lw_all"])


def _count_tokens(batches):
    train, other = Counter(), Counter()

    def rows():
        words = list(train.keys() | other.keys())
        return pa.RecordBatch.from_arrays(
            [pa.array(words, pa.binary())] + [pa.array([c[w] for w in words], pa.int64()) for c in (train, other)], names=["lw_word", "lw_train", "lw_other"]
        )

    for batch in batches:
        for held, text in zip(batch.column("lw_held").to_pylist(), texts(batch.column("lw_text"))):
            counts = other if held else train
            counts.update(text.lower().split())
            counts[END] += 1
        if len(train) + len(other) > _FLUSH:
            yield rows()
            train.clear()
            other.clear()
    yield rows()


def token_counts(docs: DataFrame) -> DataFrame:
    """Over (``lw_held``, ``lw_text``): each distinct token with its count in training texts and in all texts."""
    small_batches(docs.sparkSession)
    counted = docs.select("lw_held", "lw_text").mapInArrow(_count_tokens, "lw_word binary, lw_train bigint, lw_other bigint")
    return counted.groupBy("lw_word").agg(F.sum("lw_train").alias("lw_c"), F.sum(F.col("lw_train") + F.col("lw_other")).alias("lw_all"))


def _counted(pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct grams of ``pieces``, twice the gram and one more where it isn't learnt from, with their counts in
    training texts and in all."""
    marked = np.concatenate(pieces)
    pieces.clear()  # what is counted isn't held twice
    marked.sort()
    unseen = marked & 1
    marked >>= 1
    first = np.flatnonzero(np.concatenate(([True], marked[1:] != marked[:-1])))
    total = np.diff(np.concatenate((first, [len(marked)])))
    return marked[first], total - np.add.reduceat(unseen, first), total


def _count_grams(batches):
    """Counts of a task's grams, added up while no more than ``_HELD_GRAMS`` are distinct."""
    pieces, held, sums = [], 0, None

    def add():
        nonlocal held, sums
        held, new = 0, _counted(pieces)
        if sums is None:
            sums = new
            return
        at = np.searchsorted(sums[0], new[0])
        known = sums[0][np.minimum(at, len(sums[0]) - 1)] == new[0]
        for own, more in zip(sums[1:], new[1:]):
            own[at[known]] += more[known]
        at = at[~known]
        sums = tuple(np.insert(own, at, more[~known]) for own, more in zip(sums, new))

    def rows():
        nonlocal sums
        for i in range(0, len(sums[0]), _BATCH):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + _BATCH]) for x in sums], names=["lw_gram", "lw_n", "lw_all"])
        sums = None

    for batch in batches:
        out = batch.column("lw_held").to_numpy(zero_copy_only=False).astype(np.int64)
        bodies = [running_text(t) for t in texts(batch.column("lw_text"))]
        for keys, of in grams_of(bodies):
            pieces.append(keys << 1 | out[of])
            held += len(keys)
            if held >= _FLUSH_GRAMS:
                add()
                if len(sums[0]) >= _HELD_GRAMS:
                    yield from rows()
    if held:
        add()
    if sums is not None:
        yield from rows()


def gram_counts(docs: DataFrame) -> DataFrame:
    """Over (``lw_held``, ``lw_text``): each distinct gram with its count in training texts and in all texts."""
    counted = docs.select("lw_held", "lw_text").mapInArrow(_count_grams, "lw_gram bigint, lw_n bigint, lw_all bigint")
    # a task's counts are added up as they come, so they are dealt as they are
    return counted.repartition("lw_gram").groupBy("lw_gram").agg(F.sum("lw_n").alias("lw_n"), F.sum("lw_all").alias("lw_all"))


def gram_scores(counts: DataFrame) -> DataFrame:
    """(``lw_gram``, ``lw_score``, ``lw_all``): log10 of the weighted probability of each gram's byte in its context.

    What lies below a context of ``NEAR`` bytes is weighted in one place, many contexts at a time; then the depths
    above are mixed and handed down again."""
    grams = materialize(counts.select(F.shiftright("lw_gram", 8 * (DEPTH + 1 - NEAR)).alias("lw_near"), "lw_gram", "lw_n", "lw_all"), "grams")
    dealt = lambda df, key: df.repartition(key).sortWithinPartitions(key)
    roots = materialize(dealt(grams, "lw_near").mapInArrow(_near_roots, "lw_two bigint, lw_row bigint, lw_n bigint, lw_w array<double>"), "roots")
    sums = dealt(roots, "lw_two").mapInArrow(_to_crown, "lw_row bigint, lw_n bigint, " + ", ".join(f"lw_w{k} double" for k in range(8)))
    crown = Crown([tuple(r) for r in sums.groupBy("lw_row").agg(*[F.sum(c) for c in sums.columns[1:]]).collect()])  # at most 256 x 256 rows
    mixed = dealt(roots, "lw_two").mapInArrow(_down(crown), "lw_near bigint, lw_row bigint, lw_mixed array<double>")
    none = F.lit(None)
    both = grams.withColumn("lw_mixed", none.cast("array<double>")).unionByName(
        mixed.select("lw_near", F.col("lw_row").alias("lw_gram"), none.cast("bigint").alias("lw_n"), none.cast("bigint").alias("lw_all"), "lw_mixed")
    )
    return dealt(both, "lw_near").mapInArrow(_scores, "lw_gram bigint, lw_score double, lw_all bigint")


class HotGrams:
    """The most frequent grams in a table of fixed size with two places for each; which ones are in it changes only
    where a gram is looked up."""

    def __init__(self, grams: np.ndarray, scores: np.ndarray, slots: int = HOT_GRAMS):
        """``grams`` come by rising frequency: of those that share a place the last keeps it."""
        self._take(np.full(slots, -1, np.int64), np.zeros(slots))
        for turn in (0, 1):
            at = self._place(grams, turn)
            if turn:
                free = self.keys[at] < 0
                grams, scores, at = grams[free], scores[free], at[free]
            self.keys[at], self.scores[at] = grams, scores
            lost = self.keys[at] != grams
            grams, scores = grams[lost], scores[lost]

    def _take(self, keys: np.ndarray, scores: np.ndarray):
        self.keys, self.scores, self.bits = keys, scores, len(keys).bit_length() - 1

    @classmethod
    def of(cls, keys: np.ndarray, scores: np.ndarray) -> HotGrams:
        """Around the arrays of a table made before."""
        table = cls.__new__(cls)
        table._take(keys, scores)
        return table

    def _place(self, grams: np.ndarray, turn: int) -> np.ndarray:
        mixed = grams.view(np.uint64) * np.uint64((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)[turn])
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(scores, which aren't here)."""
        at = self._place(grams, 0)
        missed = np.flatnonzero(self.keys[at] != grams)
        score = self.scores[at]
        other = self._place(grams[missed], 1)
        found = self.keys[other] == grams[missed]
        score[missed] = np.where(found, self.scores[other], 0.0)
        return score, missed[~found]


def _hot_grams(scores: DataFrame) -> HotGrams:
    """The grams of the highest counts, no more than half as many as there are slots."""
    step = F.floor(F.log2("lw_all") * 8).cast("int")
    sizes = sorted(scores.groupBy(step.alias("s")).count().collect(), reverse=True)  # a row for each eighth of a power of two
    least, taken = 1 << 30, 0
    for s, n in sizes:
        if taken + n > HOT_GRAMS // 2:
            break
        least, taken = s, taken + n
    held = scores.where(step >= least).toArrow().sort_by([("lw_all", "ascending"), ("lw_gram", "ascending")])
    return HotGrams(held["lw_gram"].to_numpy(), held["lw_score"].to_numpy())


_PARTS = "lw_row bigint, lw_word binary, lw_gram bigint, lw_n bigint, lw_id {id}, lw_held boolean, lw_tokens bigint, lw_bytes bigint, lw_known bigint, lw_base double, lw_score double"


def score_texts(docs: DataFrame, id: str = "doc_id", text: str = "text", modulus: int = 7, held_remainder: int = 2) -> DataFrame:
    """For every row: id, ``lw_held``, ``lw_tokens``, ``lw_known``, ``lw_train_tokens``, ``lw_base`` (log10 under an
    add-one unigram model), ``lw_score`` (log10 under context-tree weighting) and ``lw_bits_per_byte``.

    Rows whose crc32(id as text) has the held remainder aren't learnt from; a null id is. A null text is empty: one
    end token. Rows that repeat are scored each. Other columns are left aside. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = F.coalesce(F.crc32(F.col(id).cast("string")) % modulus == held_remainder, F.lit(False))
    rows = docs.select(F.col(id).alias("lw_id"), held.alias("lw_held"), F.col(text).alias("lw_text"))
    words = materialize(token_counts(rows), "tokens")
    grams = materialize(gram_scores(gram_counts(rows)), "scores")
    total, train, distinct = words.agg(F.sum("lw_all"), F.sum("lw_c"), F.count_if(F.col("lw_c") > 0)).first()
    total, train = total or 0, train or 0
    hot = words.where(F.col("lw_all") >= max(2, -(-total // HOT_TOKENS))).select("lw_word", "lw_c").toArrow()
    table = dict(zip(hot["lw_word"].to_pylist(), np.log10(hot["lw_c"].to_numpy() + 1.0).tolist()))  # zero: not learnt
    # plain values, so that a worker holds them once and for all its tasks
    share = spark.sparkContext.broadcast
    frequent = _hot_grams(grams)
    lookup, hot_grams = share(table), share((frequent.keys, frequent.scores))
    del table, hot, frequent
    schema = _PARTS.format(id=docs.schema[id].dataType.simpleString())
    names = [x.split()[0] for x in schema.split(", ")]

    def parts(batches):
        known_tokens, known_grams = lookup.value, HotGrams.of(*hot_grams.value)
        for batch in batches:
            kinds = (batch.column("lw_id").type, pa.bool_(), *[pa.int64()] * 3, pa.float64(), pa.float64())
            row_ids = batch.column("lw_row").to_numpy(zero_copy_only=False)
            own, rare, bodies = [], [], []
            for row, text in zip(row_ids.tolist(), texts(batch.column("lw_text"))):
                body = running_text(text)
                bodies.append(body)
                counts = Counter(body[:-1].split(b" ")) if len(body) > 1 else Counter()
                n_words = counts.total()
                counts[END] = 1
                known, base = 0, 0.0
                for w, n in counts.items():
                    found = known_tokens.get(w)
                    if found is None:
                        rare.append((row, w, n))
                    else:
                        known += n * (found > 0)
                        base += n * found
                own.append((n_words + 1, len(body), known, base))
            score = np.zeros(len(own))
            for keys, of in grams_of(bodies):
                found, missed = known_grams.find(keys)
                score += np.bincount(of, found, len(own))
                for i in range(0, len(missed), _BATCH):
                    r, k = row_ids[of[missed[i : i + _BATCH]]], keys[missed[i : i + _BATCH]]
                    gone = [pa.nulls(len(r), kind) for kind in (pa.binary(), pa.int64(), *kinds)]
                    yield pa.RecordBatch.from_arrays([pa.array(r), gone[0], pa.array(k), *gone[1:]], names=names)
            none = lambda kind: pa.nulls(batch.num_rows, kind)
            cols = [pa.array(x, kind) for x, kind in zip(zip(*own) if own else [()] * 4, kinds[2:6])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("lw_row"), none(pa.binary()), none(pa.int64()), none(pa.int64()), batch.column("lw_id"), batch.column("lw_held"), *cols, pa.array(score)], names=names
            )
            if rare:
                r, w, k = zip(*rare)
                gone = [pa.nulls(len(r), kind) for kind in kinds]
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(w, pa.binary()), pa.nulls(len(r), pa.int64()), pa.array(k, pa.int64())] + gone, names=names)

    split = materialize(rows.withColumn("lw_row", F.monotonically_increasing_id()).mapInArrow(parts, schema), "parts")
    rare = split.where("lw_word is not null").select("lw_row", "lw_word", "lw_n").join(words.select("lw_word", "lw_c"), "lw_word")
    rare = rare.select(
        "lw_row",
        F.when(F.col("lw_c") > 0, F.col("lw_n")).otherwise(0).alias("known"),
        (F.col("lw_n") * F.log10(F.col("lw_c") + 1.0)).alias("base"),
        F.lit(0.0).alias("score"),
    )
    seldom = split.where("lw_gram is not null").select("lw_row", "lw_gram").join(grams.select("lw_gram", "lw_score"), "lw_gram")
    seldom = seldom.select("lw_row", F.lit(0).cast("bigint").alias("known"), F.lit(0.0).alias("base"), F.col("lw_score").alias("score"))
    rare = rare.unionByName(seldom).groupBy("lw_row").agg(*[F.sum(x).alias(f"lw_rare_{x}") for x in ("known", "base", "score")])
    own = split.where("lw_word is null and lw_gram is null").select("lw_row", "lw_id", "lw_held", "lw_tokens", "lw_bytes", "lw_known", "lw_base", "lw_score")
    both = own.join(rare, "lw_row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    score = plus("lw_score", "lw_rare_score")
    return both.select(
        F.col("lw_id").alias(id),
        "lw_held",
        "lw_tokens",
        plus("lw_known", "lw_rare_known").alias("lw_known"),
        F.lit(train).cast("long").alias("lw_train_tokens"),
        (plus("lw_base", "lw_rare_base") - F.col("lw_tokens") * math.log10(train + (distinct or 0) + 1)).alias("lw_base"),
        score.alias("lw_score"),
        (-score * math.log2(10) / F.col("lw_bytes")).alias("lw_bits_per_byte"),
    )
