"""Near copies: SimHash signatures find most of them, an exact completion the rest, shingles decide.

SimHash distance and similarity go together only loosely: at a Jaccard similarity of 0.8 fingerprints differ in 15 % of
their bits on average, so signatures of any width that is affordable miss a part of such pairs. Signatures with one
wildcard bit a segment (see ``simhash``) link what is close, in the first round. What they can't reach is completed by
prefix filtering: shingles are put in one order over the corpus, frequent ones last, and two sets as
similar as ``SIMILAR`` share one of the first few of each; what follows their first common one must be enough for that
similarity, so texts of their own that end in the same common passage make no pairs. Either way wide fingerprints, then the shingles themselves
verify a pair. A large group of a key is searched from a few random pivots at a time, in rounds: members that a round
has linked aren't compared with each other again, and a group's largest class gives no pivots. After the first round
texts carry their shingles' hashes into the search, so pairs that are nearly similar, of which a large group may have a
square of its size, are settled where they meet and no row is made for them. Rows of a group are
dealt to tasks in blocks of bounded size, the round's pivots to each of them.
"""

from __future__ import annotations

import math
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.llm.common import Shared, discard, materialize, own_columns, small_batches, texts, whole_groups
from listwright.llm.simhash import bit_counts, components, rows_kept, wildcard_masks

SHINGLE_WORDS = 5
#: The least similarity of a near copy, as a fraction.
SIMILAR = (4, 5)
#: Shingles from which on fingerprints sift pairs.
SIFTED = 40
#: Multipliers that make a hash a lane of 64 bits of the wide fingerprint each.
LANES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
#: Documents that tell which shingles are frequent, and how many of these are put last; the order changes the cost only.
ORDER_SAMPLE, ORDER_FREQUENT, ORDER_LEAST = 4000, 1 << 17, 3
#: The first round of either search takes one pivot a group. Then groups with up to so many rows outside their largest
#: class are compared at once, others from about that many pivots, 16 times as many each round up to the third number.
SMALL_GROUP, PIVOTS, MOST_PIVOTS = 64, 64, 1 << 14
#: Rows of a group that one task gets, about, beside the pivots.
BLOCK = 20_000
#: Shingles up to which a text carries its hashes into the search of later rounds, and other texts compared by them at once.
CARRIED, COMPARED = 1024, 1000
#: Partners of a text that one task verifies.
PARTNERS = 256


def shingles(text: bytes, words: int = SHINGLE_WORDS) -> set[bytes]:
    """Distinct shingles of the lower-cased words; a shorter text is one shingle, a text without words none."""
    tokens = text.lower().split()
    if len(tokens) <= words:
        return {b" ".join(tokens)} if tokens else set()
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-words] + 1)).tolist()
    return {joined[s:e] for s, e in zip(starts, ends[words - 1 :].tolist())}


def hashed(text: bytes) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(s) for s in shingles(text)], np.uint64))


def similar(a: set, b: set) -> bool:
    both = len(a & b)
    return both * SIMILAR[1] >= SIMILAR[0] * (len(a) + len(b) - both)


def prefix(hashes: np.ndarray, frequent: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """As many first shingles in the corpus's order as any similar set must share one of."""
    n = len(hashes)
    if len(frequent) and n:
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        hashes = hashes[np.argsort(np.where(frequent[at] == hashes, ranks[at], 0), kind="stable")]
    return hashes[: n + 1 - -(-SIMILAR[0] * n // SIMILAR[1])] if n else hashes


def wide_print(hashes: np.ndarray) -> bytes:
    """SimHash of the shingles' hashes, 64 bits a lane."""
    lanes = []
    for by in LANES:
        x = hashes * np.uint64(by)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        lanes.append(np.packbits(2 * bit_counts(x.astype(">u8")) > len(x)).tobytes())
    return b"".join(lanes)


def most_bits(size_a, size_b):
    """Beyond so many differing bits a pair is apart. Sets at similarity ``SIMILAR`` differ in a bit with chance
    angle / pi; the limit is six standard deviations above the mean, which one such pair in 10^9 exceeds."""
    num, den = SIMILAR
    least, most = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
    both = num * (size_a + size_b) / (num + den)
    chance = np.arccos(np.minimum(1.0, both / np.sqrt(np.maximum(1, least * most)))) / math.pi
    bits = 64 * len(LANES)
    return bits * chance + 6 * np.sqrt(bits * chance * (1 - chance)) + 6


def _maybe(size_a, sketch_a, size_b, sketch_b):
    """False where sizes or wide fingerprints show the similarity too small. Fingerprints of few shingles say too little:
    sets of fewer than ``SIFTED`` are left to the shingles themselves."""
    num, den = SIMILAR
    least = np.minimum(size_a, size_b)
    apart = np.bitwise_count(sketch_a ^ sketch_b).sum(axis=-1, dtype=np.int64)
    return (den * least >= num * np.maximum(size_a, size_b)) & ((least < SIFTED) | (apart <= most_bits(size_a, size_b)))


def _enough(size_a, reach_a, size_b, reach_b):
    """False where two sets can't be similar if the key at hand is their first common one: each has ``reach`` shingles
    from there on. A similar pair passes at its first common key, so each pair need only pass at one of its keys."""
    num, den = SIMILAR
    return (num + den) * np.minimum(reach_a, reach_b) >= num * (size_a + size_b)


class Carried:
    """The hashes that rows carry, sorted, as 16 bits each; none where a text has too many."""

    def __init__(self, column):
        raw = [x or b"" for x in column.to_pylist()]
        self.values = np.frombuffer(b"".join(raw), np.uint16)
        self.at = np.concatenate(([0], np.cumsum([len(x) // 2 for x in raw])))

    def similar(self, i: int, others: np.ndarray) -> np.ndarray:
        """Of rows ``others`` those that may be similar to row ``i``: hashes of 16 bits can only have more in common than
        the shingles do, so no similar one is lost. A row without hashes may be."""
        num, den = SIMILAR
        own = self.values[self.at[i] : self.at[i + 1]]
        if not len(own):
            return others
        kept = []
        for k in range(0, len(others), COMPARED):
            some = others[k : k + COMPARED]
            flat = np.concatenate([self.values[a:b] for a, b in zip(self.at[some].tolist(), self.at[some + 1].tolist())])
            found = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
            sizes = self.at[some + 1] - self.at[some]
            ends = np.cumsum(sizes)
            sums = np.concatenate(([0], np.cumsum(found)))
            both = sums[ends] - sums[ends - sizes]
            kept.append(some[(sizes == 0) | ((num + den) * both >= num * (sizes + len(own)))])
        return np.concatenate(kept) if kept else others


_MASKS = np.array(wildcard_masks(), np.int64).view(np.uint64)


def signatures(wide: bytes) -> np.ndarray:
    """One key for each bit of the first lane as a wildcard of its segment."""
    x = (_MASKS & np.uint64(int.from_bytes(wide[:8], "big"))) + np.arange(64, dtype=np.uint64) * np.uint64(LANES[0])
    x ^= x >> np.uint64(31)
    x *= np.uint64(LANES[1])
    return x ^ (x >> np.uint64(29))


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    n = docs.count()
    sample = docs.where(F.pmod(F.xxhash64(F.lit(5), "lw_body"), F.lit(1 << 20)) < F.lit(max(1, (ORDER_SAMPLE << 20) // max(n, 1)))).select("lw_body")

    def rows(batches):
        for batch in batches:
            found = [hashed(t) for t in texts(batch.column("lw_body"))]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["lw_key"])

    counts = sample.mapInArrow(rows, "lw_key bigint").groupBy("lw_key").count().where(F.col("count") >= ORDER_LEAST)
    found = counts.orderBy(F.desc("count"), "lw_key").limit(ORDER_FREQUENT).collect()  # bounded by the limit
    keys = np.array([r[0] for r in found], np.int64).view(np.uint64)
    ranks = np.arange(len(keys), 0, -1)
    order = np.argsort(keys)
    return keys[order], ranks[order]


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
    return starts, np.diff(np.concatenate((starts, [len(keys)])))


def _shared(batches):
    """Keys that more than one text has: rows sorted by key, each held until the next one is seen."""
    last, held, shown = None, None, False
    for batch in batches:
        keys = batch.column(0).to_numpy()
        if not len(keys):
            continue
        before = np.concatenate(([False if last is None else keys[0] == last], keys[1:] == keys[:-1]))
        if before[0] and not shown:
            yield held
        keep = before | np.concatenate((before[1:], [False]))
        yield batch.filter(pa.array(keep))
        last, held, shown = keys[-1], batch.slice(len(keys) - 1), bool(keep[-1])


def _candidates(batches):
    """Pairs (a, b) to verify: pivots and the block's own rows, of different classes."""
    for table in whole_groups(batches, 20_000):
        deals, nodes, roots, size = (table.column(c).to_numpy() for c in ("lw_deal", "lw_node", "lw_root", "lw_size"))
        home, pivot, reach = (table.column(c).to_numpy() for c in ("lw_home", "lw_pivot", "lw_reach"))
        marks = np.frombuffer(b"".join(table.column("lw_wide").to_pylist()), np.uint64).reshape(len(deals), -1)
        sets = Carried(table.column("lw_set"))
        starts, sizes = _runs(deals)
        two = starts[sizes == 2]
        two = two[(roots[two] != roots[two + 1]) & (pivot[two] | pivot[two + 1])]
        two = two[_enough(size[two], reach[two], size[two + 1], reach[two + 1])]
        near = two[_maybe(size[two], marks[two], size[two + 1], marks[two + 1])]
        if len(sets.values):
            near = near[[len(sets.similar(i, np.array([i + 1]))) > 0 for i in near.tolist()]] if len(near) else near
        out = [(nodes[near], nodes[near + 1])]
        for s, m in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            own = s + np.flatnonzero(home[s : s + m])
            own_roots, own_size, own_reach, own_marks = roots[own], size[own], reach[own], marks[own]
            for i in (s + np.flatnonzero(pivot[s : s + m])).tolist():
                some = np.flatnonzero((own_roots != roots[i]) & _enough(size[i], reach[i], own_size, own_reach))
                found = nodes[sets.similar(i, own[some[_maybe(size[i], marks[i], own_size[some], own_marks[some])]])]
                out.append((np.full(len(found), nodes[i]), found))
        a, b = (np.concatenate(x) for x in zip(*out))
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _verified(batches):
    """Rows (lw_deal, b, lw_body) sorted by their deal, the text of ``a`` first in it (with ``b`` null): similar pairs."""
    last, sets = None, None
    for batch in batches:
        keep = []
        for deal, b, body in zip(batch.column("lw_deal").to_pylist(), batch.column("b").to_pylist(), texts(batch.column("lw_body"))):
            if deal != last:
                last, sets = deal, shingles(body)
            keep.append(b is not None and similar(sets, shingles(body)))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _with_text(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``nodes`` of ``wanted``, each with one text."""
    own = nodes.join(wanted.select("lw_node").distinct(), "lw_node", "left_semi")
    return docs.select(F.xxhash64("lw_body").alias("lw_text_hash"), "lw_body").join(own, "lw_text_hash").dropDuplicates(["lw_text_hash", "lw_node"])  # dealt by hash already


def _carrying(batches):
    """Rows with the hashes of their texts, for texts of up to ``CARRIED`` shingles."""
    for batch in batches:
        sets = [hashed(t) for t in texts(batch.column("lw_body"))]
        sets = [(h >> np.uint64(48)).astype(np.uint16).tobytes() if len(h) <= CARRIED else None for h in sets]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sets, pa.binary())], names=[*batch.schema.names, "lw_set"])


def _verify(docs: DataFrame | None, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) of nodes that are similar, by the texts of ``docs``, or of ``nodes`` if these have them. A text with many partners is dealt to several tasks with some
    of them each; a pair takes one text along, not two."""
    small_batches(nodes.sparkSession)
    counts = pairs.groupBy("a").agg(F.floor(F.count("*") / PARTNERS).alias("lw_more"))
    part = F.pmod(F.xxhash64("b"), F.col("lw_more") + 1)
    dealt = materialize(pairs.join(counts, "a").select("a", "b", F.xxhash64("a", part).alias("lw_deal")), "dealt")
    wanted = dealt.select("a", F.lit(None).cast("bigint").alias("b"), "lw_deal").distinct().unionByName(dealt)
    wanted = wanted.withColumn("lw_node", F.coalesce("b", "a"))
    bodies = nodes if docs is None else _with_text(docs, nodes.select("lw_node", "lw_text_hash"), wanted)
    rows = wanted.join(bodies.select("lw_node", "lw_body"), "lw_node").select("lw_deal", "a", "b", "lw_body")
    found = rows.repartition("lw_deal").sortWithinPartitions("lw_deal", F.col("b").asc_nulls_first()).mapInArrow(_verified, "a bigint, b bigint")
    found = materialize(found, "similar")
    discard(dealt)
    return found


def _turn(postings: DataFrame, roots: DataFrame | None, turn: int) -> DataFrame:
    """Rows (lw_key, lw_node, lw_reach, lw_root) of the groups of ``postings`` that still hold several classes, with the group's
    size, whether the row is a pivot of this turn and whether the group has to be looked at again after it."""
    rows = postings.withColumn("lw_root", F.col("lw_node"))
    if roots is not None:
        known = roots.select(F.col("node").alias("lw_node"), "root")
        rows = postings.join(known, "lw_node", "left").select("lw_key", "lw_node", "lw_reach", F.coalesce("root", "lw_node").alias("lw_root"))
    classes = rows.groupBy("lw_key", "lw_root").agg(F.count("*").alias("n"), F.min("lw_node").alias("least"))
    groups = classes.groupBy("lw_key").agg(F.sum("n").alias("lw_rows"), F.max(F.struct("n", "lw_root")).alias("top"), F.min("least").alias("lw_least"))
    others = F.col("lw_rows") - F.col("top.n")
    groups = groups.where(others > 0).select("lw_key", "lw_rows", "lw_least", others.alias("lw_others"), F.col("top.lw_root").alias("lw_top"))
    if turn == 0:
        pivot, more = F.col("lw_node") == F.col("lw_least"), F.col("lw_rows") > 2
    else:
        most = min(PIVOTS << 4 * (turn - 1), MOST_PIVOTS)
        more = F.col("lw_others") > max(SMALL_GROUP, most)
        drawn = F.pmod(F.xxhash64("lw_node", "lw_key", F.lit(turn)), F.ceil(F.col("lw_others") / F.lit(most))) == 0
        pivot = (F.col("lw_root") != F.col("lw_top")) & (~more | drawn)
    sized = rows.join(groups, "lw_key").select("lw_key", "lw_node", "lw_reach", "lw_root", "lw_rows", pivot.alias("lw_pivot"), more.alias("lw_more"))
    return materialize(sized, "turn")


def _pairs(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Distinct pairs to verify of a turn's ``rows``, a group's rows dealt in blocks and its pivots to every block."""
    blocks = F.ceil(F.col("lw_rows") / F.lit(BLOCK))
    own = F.pmod(F.xxhash64("lw_node"), blocks)
    marked = rows.join(nodes.select("lw_node", "lw_size", "lw_wide", "lw_set"), "lw_node").withColumn("lw_own", own)
    dealt = marked.withColumn("lw_block", F.explode(F.when(F.col("lw_pivot"), F.sequence(F.lit(0).cast("long"), blocks - 1)).otherwise(F.array("lw_own"))))
    dealt = dealt.select(
        F.xxhash64("lw_key", "lw_block").alias("lw_deal"), "lw_node", "lw_reach", "lw_root", "lw_size", "lw_wide", "lw_set", (F.col("lw_block") == F.col("lw_own")).alias("lw_home"), "lw_pivot"
    )
    found = dealt.repartition("lw_deal").sortWithinPartitions("lw_deal").mapInArrow(_candidates, "a bigint, b bigint")
    return materialize(found.distinct(), "pairs")


def _joined(links: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(node, root) after more ``links``. Only classes that a link joins are gone through again."""
    if roots is None:
        return materialize(components(links), "roots")
    side = roots.select("node", "root")
    links = links.join(side.toDF("a", "root_a"), "a", "left").join(side.toDF("b", "root_b"), "b", "left")
    new = components(links.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")))
    # a node of ``new`` was a root or had no link, so it is no node of ``roots``
    moved = roots.join(new.select(F.col("node").alias("root"), F.col("root").alias("now")), "root", "left")
    return materialize(moved.select("node", F.coalesce("now", "root").alias("root")).unionByName(new), "roots")


def _round(docs: DataFrame | None, nodes: DataFrame, postings: DataFrame, roots: DataFrame | None, turn: int):
    """One round over the groups of ``postings`` (lw_key, lw_node, lw_reach): roots so far and what later rounds have to look at."""
    rows = _turn(postings, roots, turn)
    pairs = _pairs(nodes, rows)
    left = materialize(rows.where("lw_more and not lw_pivot and lw_key % 2 <> 0").select("lw_key", "lw_node", "lw_reach"), "left")
    links = _verify(docs, nodes, pairs)
    now = _joined(links, roots)
    discard(postings, rows, pairs, links, *([] if roots is None else [roots]))
    return now, left


def similar_links(docs: DataFrame, nodes: DataFrame, shared: DataFrame) -> DataFrame:
    """(node, root) over all pairs of ``nodes`` that are similar and share a completing key; ``docs`` has their texts.
    One round over all keys of ``shared``, then rounds over the completing ones until no group is left."""
    roots, left = _round(docs, nodes.withColumn("lw_set", F.lit(None).cast("binary")), shared, None, 0)
    if left.isEmpty():
        return roots
    # later rounds are about these nodes only, so their texts are looked up once
    schema = "lw_node bigint, lw_size bigint, lw_wide binary, lw_body string"
    found = _with_text(docs, nodes, left).select(*[x.split()[0] for x in schema.split(", ")])
    carrying = materialize(found.mapInArrow(_carrying, f"{schema}, lw_set binary"), "carrying")
    for turn in count(1):
        roots, left = _round(None, carrying, left, roots, turn)
        if left.isEmpty():
            discard(carrying)
            return roots


def drop_near_copies(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, the one with the smallest id (of equal ids, the least text hash), with its own columns.

    Classes are the components of all pairs at similarity ``SIMILAR`` or more. Texts without words, null ones among
    them, are copies of each other; null ids never stay where a class has another; repeated rows are copies. Rows are
    carried whole, so their columns may have any names. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id).alias("lw_id"), F.col(text).alias("lw_body"), F.struct(*own_columns(docs)).alias("lw_own"))
    hashes = rows.select("lw_id", F.xxhash64("lw_body").alias("lw_text_hash"), "lw_body")
    order = Shared(spark, _frequent(hashes))
    kind = docs.schema[id].dataType.simpleString()

    def keyed(batches):
        for batch in batches:
            sets = [hashed(t) for t in texts(batch.column("lw_body"))]
            node = np.array([xxhash.xxh64_intdigest(h.tobytes()) for h in sets], np.uint64).view(np.int64)
            wide = [wide_print(h) for h in sets]
            cols = [pa.array(node), pa.array([len(h) for h in sets], pa.int64()), pa.array(wide, pa.binary())]
            # signatures are even, the completing keys odd
            keys = [np.concatenate((signatures(w) & ~np.uint64(1), prefix(h, *order.value) | np.uint64(1))).view(np.int64) for w, h in zip(wide, sets)]
            ends = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
            cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *keys]))))
            yield pa.RecordBatch.from_arrays([batch.column("lw_id"), batch.column("lw_text_hash"), *cols], names=["lw_id", "lw_text_hash", "lw_node", "lw_size", "lw_wide", "lw_keys"])

    schema = f"lw_id {kind}, lw_text_hash bigint, lw_node bigint, lw_size bigint, lw_wide binary, lw_keys array<bigint>"
    keys = materialize(hashes.mapInArrow(keyed, schema), "keys")
    prints = materialize(keys.drop("lw_keys"), "prints")
    own = materialize(keys.dropDuplicates(["lw_node"]).select("lw_text_hash", "lw_node", "lw_size", "lw_wide", "lw_keys"), "own")
    discard(keys)
    postings = own.select(F.posexplode("lw_keys").alias("lw_at", "lw_key"), "lw_node", "lw_size")
    # a signature says nothing on where two sets begin to agree, so all of a set is in reach there
    postings = postings.select("lw_key", "lw_node", (F.col("lw_size") - F.greatest(F.lit(0), F.col("lw_at") - len(_MASKS))).cast("int").alias("lw_reach"))
    postings = postings.repartition("lw_key").sortWithinPartitions("lw_key")
    shared = materialize(postings.mapInArrow(_shared, "lw_key bigint, lw_node bigint, lw_reach int"), "shared")
    nodes = materialize(own.drop("lw_keys"), "nodes")
    discard(own)
    roots = similar_links(hashes, nodes, shared)
    classes = prints.select("lw_id", "lw_text_hash", "lw_node").join(roots, F.col("lw_node") == F.col("node"), "left")
    first = classes.groupBy(F.coalesce("root", "lw_node")).agg(F.min(F.struct(F.col("lw_id").isNull(), "lw_id", "lw_text_hash")).alias("k"))
    keep = materialize(first.select(F.col("k.lw_id").alias("lw_kept"), F.col("k.lw_text_hash").alias("lw_kept_hash")).distinct(), "kept")
    discard(prints, nodes)
    return rows_kept(rows, keep)
