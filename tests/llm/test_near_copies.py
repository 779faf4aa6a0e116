import random

import numpy as np
import pytest

import corpus_pipeline
from listwright.llm import near_copies as N
from listwright.llm.simhash import fingerprint
from tests.llm.conftest import SCHEMA, prose


def brute_sets(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(rows):
    """Least id of each component of all pairs at Jaccard 0.8 or more."""
    sets = [brute_sets(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, r in enumerate(rows):
        g = find(i)
        least[g] = min(least.get(g, r), r, key=lambda x: (x[0] is None, x[0] or 0))
    return sorted(str(r[0]) for r in least.values())


def changed(rng, text, n):
    words = text.split()
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(41)
    passage = prose(rng, 30)
    rows = [(i, prose(rng, rng.randint(50, 300)), "en", "a", 0) for i in range(60)]
    rows += [(100 + i, changed(rng, rows[i % 40][1], rng.randint(1, 6)), "en", "b", 0) for i in range(160)]
    rows += [(300 + i, f"{prose(rng, 25)} {passage} {prose(rng, 25)}", "en", "c", 0) for i in range(60)]
    base = prose(rng, 200)
    rows += [(400 + i, changed(rng, base, rng.randint(1, 6)), "en", "hot", 0) for i in range(120)]
    return rows


def test_stage_matches_all_pairs(spark, copies, tmp_path):
    df = spark.createDataFrame(copies, SCHEMA)
    got = sorted(str(r["doc_id"]) for r in corpus_pipeline.near_dedup(spark, df, str(tmp_path)).collect())
    assert got == brute_kept(copies)


def test_far_fingerprints_are_copies(spark, tmp_path):
    rng = random.Random(42)
    while True:
        text = prose(rng, 120)
        other = changed(rng, text, 2)
        if (fingerprint(text.encode()) ^ fingerprint(other.encode())).bit_count() > 4:
            break
    df = spark.createDataFrame([(1, text, "en", "a", 0), (2, other, "en", "a", 0)], SCHEMA)
    assert [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, str(tmp_path)).collect()] == [1]


def test_group_size_and_order_do_not_matter(spark, copies, monkeypatch):
    monkeypatch.setattr(N, "SMALL_GROUP", 2)
    monkeypatch.setattr(N, "PIVOTS", 1)
    monkeypatch.setattr(N, "ORDER_SAMPLE", 1)
    got = sorted(str(r["doc_id"]) for r in N.drop_near_copies(spark.createDataFrame(copies, SCHEMA)).collect())
    assert got == brute_kept(copies)


def test_similar_sets_have_enough_after_their_first_common_shingle():
    rng = random.Random(43)
    passed = 0
    frequent, ranks = np.arange(100, dtype=np.uint64), np.arange(100, 0, -1)
    for _ in range(3000):
        both = set(rng.sample(range(1000), rng.randint(1, 60)))
        a, b = (np.array(sorted(both | set(rng.sample(range(1000), rng.randint(0, 12)))), np.uint64) for _ in range(2))
        p, q = N.prefix(a, frequent, ranks).tolist(), N.prefix(b, frequent, ranks).tolist()
        common = [x for x in p if x in q]
        if N.similar(set(a.tolist()), set(b.tolist())):
            passed += 1
            assert common and N._enough(len(a), len(a) - p.index(common[0]), len(b), len(b) - q.index(common[0]))
    assert passed > 300
    # four fifths of one passage at the end of texts of their own: the first common shingle comes too late
    assert not N._enough(100, 80, 100, 80) and N._enough(100, 89, 100, 89)


def test_odd_rows(docs, corpus, clashing, nothing):
    assert sorted(str(r["doc_id"]) for r in N.drop_near_copies(docs).collect()) == brute_kept(corpus)
    assert N.drop_near_copies(clashing).columns == clashing.columns
    assert N.drop_near_copies(nothing).count() == 0


def test_groups_in_blocks(spark, copies, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 3)
    monkeypatch.setattr(N, "SMALL_GROUP", 1)
    monkeypatch.setattr(N, "PIVOTS", 2)
    got = sorted(str(r["doc_id"]) for r in N.drop_near_copies(spark.createDataFrame(copies, SCHEMA)).collect())
    assert got == brute_kept(copies)


def test_no_short_pair_is_missed(spark):
    """Texts of 8 and 9 words: 4 of 5 shingles are common, the least similarity there is, and fingerprints tell nothing."""
    rng = random.Random(44)
    rows = []
    for i in range(10_000):
        text = " ".join(f"w{rng.randrange(10**9)}" for _ in range(8))
        rows += [(2 * i, text, "en", "a", 0), (2 * i + 1, f"{text} last{i}", "en", "a", 0)]
    kept = N.drop_near_copies(spark.createDataFrame(rows, SCHEMA)).select("doc_id").collect()
    assert sorted(r[0] for r in kept) == [2 * i for i in range(10_000)]


def test_nearly_similar_pairs_make_no_rows(spark, monkeypatch):
    """A group of texts whose pairs are all below the similarity, but not far: fingerprints can't tell, hashes do."""
    rng = random.Random(45)
    base = prose(rng, 200)
    rows = [(i, changed(rng, base, 6), "en", "hot", 0) for i in range(150)]
    rows += [(1000 + i, changed(rng, rows[i][1], 1), "en", "hot", 0) for i in range(0, 150, 3)]
    verify, counts = N._verify, []

    def counted(docs, nodes, pairs):
        counts.append(pairs.count())
        return verify(docs, nodes, pairs)

    monkeypatch.setattr(N, "_verify", counted)
    monkeypatch.setattr(N, "ORDER_SAMPLE", 1)  # else what all texts share comes last and no pair is looked at
    monkeypatch.setattr(N, "COMPARED", 7)
    got = sorted(str(r["doc_id"]) for r in N.drop_near_copies(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == brute_kept(rows)
    assert len(counts) > 1 and sum(counts[1:]) < 100, counts
