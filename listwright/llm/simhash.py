"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into so few segments that, of two fingerprints within the allowed distance, one segment
differs by one bit at most. Each segment is indexed once for each of its bits with that bit as a wildcard; such
fingerprints then share a signature. Rows of a signature are verified together, and only enough links to span its
classes are passed on, never all pairs.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from listwright.llm.common import discard, materialize, own_columns, small_batches, texts, whole_groups

SHINGLE_WORDS = 4
HASH_SEED = 42
MAX_BITS = 4
SEGMENTS = MAX_BITS // 2 + 1
#: Links that one task contracts at once before the stars.
CONTRACTED = 1 << 18


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """SimHash of one text: a bit is set where over half of the shingles' XXH64 have it; 0 without words."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(joined, HASH_SEED)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-words] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], HASH_SEED) for s, e in zip(starts, ends[words - 1 :].tolist())], dtype=">u8")
    return int.from_bytes(np.packbits(2 * bit_counts(hashes) > len(hashes)).tobytes(), "big")


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the big-endian ``hashes`` have each bit, the highest first."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 255):  # so many fit a byte
        ones += np.unpackbits(hashes[i : i + 255].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint8)
    return ones


def _fingerprints(batches):
    for batch in batches:
        prints = np.array([fingerprint(t) for t in texts(batch.column("lw_text"))], dtype=np.uint64).view(np.int64)
        keep = [i for i, name in enumerate(batch.schema.names) if name != "lw_text"]
        yield pa.RecordBatch.from_arrays(
            [batch.column(i) for i in keep] + [pa.array(prints, pa.int64())], names=[batch.schema.names[i] for i in keep] + ["lw_print"]
        )


def add_fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with the long column ``lw_print``."""
    small_batches(docs.sparkSession)
    schema = StructType([f for f in docs.schema if f.name != text] + [StructField("lw_print", LongType())])
    return docs.withColumnRenamed(text, "lw_text").mapInArrow(_fingerprints, schema)


def wildcard_masks(segments: int = SEGMENTS) -> list[int]:
    """For each of the 64 bits: its segment's bits but itself, as a signed long."""
    cuts = [round(64 * k / segments) for k in range(segments + 1)]
    masks = []
    for low, high in zip(cuts, cuts[1:]):
        whole = ((1 << high) - 1) ^ ((1 << low) - 1)
        masks += [whole ^ (1 << bit) for bit in range(low, high)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def spanning_links(prints: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, least member) that span the classes of distinct ``prints`` under distance ``max_bits``.

    Search from one print at a time over those not yet reached: in a dense group the first few reach nearly all, so
    the work stays near linear there.
    """
    left = np.sort(prints)
    members, roots = [], []
    while len(left) > 1:
        root, frontier, left = left[0], left[:1], left[1:]
        while len(frontier) and len(left):
            near = np.bitwise_count(left ^ frontier[0]) <= max_bits
            found, left = left[near], left[~near]
            members.append(found)
            roots.append(np.full(len(found), root, prints.dtype))
            frontier = np.concatenate((frontier[1:], found))
    empty = prints[:0]
    return np.concatenate([empty, *members]), np.concatenate([empty, *roots])


def _links_of(keys: np.ndarray, prints: np.ndarray):
    """Links of rows sorted by signature."""
    starts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
    sizes = np.diff(np.concatenate((starts, [len(keys)])))
    pairs = starts[sizes == 2]
    a, b = prints[pairs], prints[pairs + 1]
    near = np.bitwise_count(a ^ b) <= MAX_BITS
    members, roots = [np.maximum(a, b)[near]], [np.minimum(a, b)[near]]
    for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        m, r = spanning_links(prints[s : s + n])
        members.append(m)
        roots.append(r)
    return np.concatenate(members), np.concatenate(roots)


def _linked(batches):
    for table in whole_groups(batches, 50_000):
        yield _link_batch(table["lw_key"].to_numpy(), table["lw_print"].to_numpy().view(np.uint64))


def _link_batch(keys, prints):
    members, roots = _links_of(keys, prints)
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64), pa.int64()) for x in (members, roots)], names=["a", "b"])


def near_links(prints: DataFrame) -> DataFrame:
    """Spanning links (a, b) between distinct fingerprints ``lw_print`` within ``MAX_BITS``."""
    masks = F.array(*[F.lit(m).cast("long") for m in wildcard_masks()])
    variants = prints.select("lw_print", F.posexplode(masks).alias("lw_bit", "lw_mask"))
    # a hash of bit and masked print: two signatures that meet in it cost a comparison more
    variants = variants.select(F.xxhash64("lw_bit", F.col("lw_mask").bitwiseAND(F.col("lw_print"))).alias("lw_key"), "lw_print")
    dealt = variants.repartition("lw_key").sortWithinPartitions("lw_key")
    return dealt.mapInArrow(_linked, "a bigint, b bigint").distinct()


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, least node reachable over the links given) of all nodes but the least ones themselves."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    least = np.arange(len(nodes))
    while len(a):
        np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
        while (least[least] != least).any():
            least = least[least]
        a, b = least[a], least[b]
        a, b = a[a != b], b[a != b]
    moved = np.flatnonzero(least != np.arange(len(nodes)))
    return nodes[moved], nodes[least[moved]]


def _contracted(batches):
    """A task's links contracted to stars, ``CONTRACTED`` of them at a time."""
    held, rows = [], 0

    def stars():
        a, b = least_reachable(*(np.concatenate([h.column(c).to_numpy() for h in held]) for c in ("a", "b")))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= CONTRACTED:
            yield stars()
            held, rows = [], 0
    if rows:
        yield stars()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link, root being the least node reachable. Tasks contract bounded runs of
    links to stars; large and small stars then join these in turn, each round a written table, until every class is
    one star."""
    given = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "given")
    runs = given.coalesce(1 + given.count() // CONTRACTED)
    links = materialize(runs.mapInArrow(_contracted, "a bigint, b bigint").distinct(), "links")
    discard(given)
    for k in count():
        if _are_stars(links):
            break
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        last, links = links, materialize(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct(), f"round{k}")
        discard(last)
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _are_stars(links: DataFrame) -> bool:
    """Whether no node of (a, b), b being the lesser, links to two others or is both linked to and linking."""
    ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(2).alias("n")), F.struct(F.col("b").alias("node"), F.lit(0).alias("n")))).alias("e"))
    roles = ends.groupBy("e.node").agg(F.sum("e.n").alias("up"), F.min("e.n").alias("least"))
    return roles.where("up > 2 or (up > 0 and least = 0)").isEmpty()


def near_duplicate_classes(docs: DataFrame, id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, ``keep``..., ``lw_print``, ``lw_class``) for every row; the class is the smallest id reachable over links
    of fingerprints at ``MAX_BITS`` or fewer differing bits, the row itself included.

    Null and empty texts have fingerprint zero and are linked like any other; null ids never name a class unless it
    has no other; repeated rows share their class. An empty table gives an empty table.
    """
    prints = materialize(add_fingerprints(docs.select(id, *keep, text), text), "prints")
    distinct = materialize(prints.groupBy("lw_print").agg(F.min(id).alias("lw_least")), "distinct")
    roots = components(near_links(distinct))
    rooted = distinct.join(roots, distinct["lw_print"] == roots["node"], "left").select(
        "lw_print", "lw_least", F.coalesce("root", "lw_print").alias("root")
    )
    rooted = materialize(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("lw_least").alias("lw_class"))
    classes = materialize(rooted.join(least, "root").select("lw_print", "lw_class", "root"), "classes")
    return prints.join(classes, "lw_print").withColumnRenamed("root", "lw_root")


def drop_near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, the one with the smallest id (of equal ids, the least text hash), with its own columns.

    Rows are carried whole, so their columns may have any names."""
    rows = docs.select(F.col(id).alias("lw_id"), F.col(text).alias("lw_body"), F.struct(*own_columns(docs)).alias("lw_own"))
    hashed = rows.select("lw_id", F.xxhash64("lw_body").alias("lw_hash"), "lw_body")
    classes = near_duplicate_classes(hashed, "lw_id", "lw_body", ("lw_hash",))
    first = classes.groupBy("lw_root").agg(F.min(F.struct(F.col("lw_id").isNull(), "lw_id", "lw_hash")).alias("k"))
    keep = materialize(first.select(F.col("k.lw_id").alias("lw_kept"), F.col("k.lw_hash").alias("lw_kept_hash")).distinct(), "kept")
    return rows_kept(rows, keep)


def rows_kept(rows: DataFrame, keep: DataFrame) -> DataFrame:
    """Of (``lw_id``, ``lw_body``, ``lw_own``) one row for each (``lw_kept``, ``lw_kept_hash``), its own columns."""
    rows = rows.withColumn("lw_hash", F.xxhash64("lw_body"))
    kept = rows.join(keep, F.col("lw_id").eqNullSafe(F.col("lw_kept")) & (F.col("lw_hash") == F.col("lw_kept_hash")), "left_semi")
    return kept.dropDuplicates(["lw_id", "lw_hash"]).select("lw_own.*")
