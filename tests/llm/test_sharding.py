import random
from collections import defaultdict

from listwright.llm.sharding import balanced_shards, difference


def test_difference_places_each_part_once():
    rng = random.Random(1)
    vectors = [tuple(rng.randint(0, 500) for _ in range(5)) for _ in range(60)]
    places = difference(vectors)
    assert all(sorted(p) == list(range(5)) for p in places)
    sums = [0] * 5
    for v, p in zip(vectors, places):
        for x, s in zip(v, p):
            sums[s] += x
    assert max(sums) - min(sums) < 0.01 * sum(sums)
    assert difference([]) == []


def test_difference_beats_largest_first_on_the_textbook_case():
    # 8 7 6 5 4 in two: differencing leaves 2, putting the largest on the lighter side leaves 4
    places = difference([(w, 0) for w in (8, 7, 6, 5, 4)])
    sums = [0, 0]
    for w, p in zip((8, 7, 6, 5, 4), places):
        sums[p[0]] += w
    assert abs(sums[0] - sums[1]) == 2


def test_shards(docs, corpus):
    rows = balanced_shards(docs, shards=4, buckets=3).collect()
    assert len(rows) == len(corpus)
    shard_of, slots, sizes = defaultdict(set), defaultdict(list), defaultdict(int)
    for r in rows:
        assert r["lw_size"] == len((r["text"] or "").encode()) + 1
        shard_of[r["text"]].add(r["lw_shard"])
        slots[r["lw_shard"]].append(r["lw_slot"])
        sizes[r["lw_shard"]] += r["lw_size"]
    assert all(len(s) == 1 for s in shard_of.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    others = sorted(sizes.values())[:-1]  # one text is larger than a fair share
    assert max(others) - min(others) < 0.02 * sum(others)


def test_edges(nothing, clashing):
    assert balanced_shards(nothing).count() == 0
    assert balanced_shards(clashing).columns[: len(clashing.columns)] == clashing.columns or set(clashing.columns) <= set(balanced_shards(clashing).columns)


def test_repeated_ids_and_equal_texts(spark, monkeypatch):
    from listwright.llm import sharding

    monkeypatch.setattr(sharding, "ROWS_PER_SLOT_RUN", 10)
    rows = [(i % 7 if i % 3 else None, "same text") for i in range(200)] + [(1, None)] * 30 + [(2, "")] * 5 + [(i, f"text {i}") for i in range(60)]
    got = balanced_shards(spark.createDataFrame(rows, "doc_id long, text string"), shards=3).collect()
    assert len(got) == len(rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["lw_shard"]].append(r["lw_slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r["lw_shard"] for r in got if r["text"] == "same text"}) == 1


def test_one_bucket_is_plain_differencing(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 400))) + str(i) for i in range(90)]
    got = balanced_shards(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shards=4, buckets=1).collect()
    sums = [0] * 4
    for r in got:
        sums[r["lw_shard"]] += r["lw_size"]
    # combine the two partitions of largest spread, oppositely ordered, comparing all each time
    parts = [[len(t) + 1, 0, 0, 0] for t in texts]
    while len(parts) > 1:
        parts.sort(key=lambda p: max(p) - min(p))
        a, b = sorted(parts.pop(), reverse=True), sorted(parts.pop())
        parts.append([x + y for x, y in zip(a, b)])
    assert max(sums) - min(sums) <= max(2, 2 * (max(parts[0]) - min(parts[0])))
