import random
import re

import numpy as np
import xxhash

from listwright.llm import simhash as S


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def classes(prints):
    """Least member of each print's component, by comparing all pairs."""
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    own = sorted(root)
    for i, a in enumerate(own):
        for b in own[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {p: find(p) for p in own}


def test_fingerprints():
    for text in ("", "one", "a b c", "A B C D", "É Ü a b", "a b c d e f g", "x " * 50, None):
        assert S.fingerprint((text or "").encode()) == brute_print(text)


def test_masks_find_any_near_pair():
    masks = [m & (1 << 64) - 1 for m in S.wildcard_masks()]
    rng = random.Random(1)
    for _ in range(2000):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 4):
            b ^= 1 << bit
        assert any(a & m == b & m for m in masks)


def test_spanning_links_span_the_classes():
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    prints = {centre}
    for _ in range(300):
        p = centre
        for bit in rng.sample(range(40), rng.randint(0, 9)):
            p ^= 1 << bit
        prints.add(p)
    want = classes(prints)
    members, roots = S.spanning_links(np.array(sorted(prints), np.uint64))
    assert len(members) < len(prints), "links span, they don't pair"
    got = {p: p for p in prints} | {int(m): int(r) for m, r in zip(members, roots)}
    assert got == want


def test_classes(docs, corpus, spark):
    prints = [(i, brute_print(t)) for i, t, *_ in corpus]
    of = classes({p for _, p in prints})
    least = {}
    for i, p in prints:
        if i is not None:
            least[of[p]] = min(i, least.get(of[p], i))
    want = sorted((str(i), p, str(least.get(of[p]))) for i, p in prints)
    got = sorted((str(r["doc_id"]), r["lw_print"] & (1 << 64) - 1, str(r["lw_class"])) for r in S.near_duplicate_classes(docs).collect())
    assert got == want


def test_chains_are_followed(spark):
    rng = random.Random(3)
    p, rows = rng.getrandbits(63), []
    for k in range(40):
        rows.append((k, p))
        for bit in rng.sample(range(63), 4):
            p ^= 1 << bit
    rows += [(100 + k, rng.getrandbits(63)) for k in range(200)]
    links = S.near_links(spark.createDataFrame([(r[1],) for r in rows], "lw_print long"))
    found = {r["node"]: r["root"] for r in S.components(links).collect()}
    of = classes({r[1] for r in rows})
    for _, a in rows:
        assert found.get(a, a) == of[a]


def test_components_over_several_runs_of_links(spark, monkeypatch):
    rng = random.Random(4)
    chain = rng.sample(range(10**6), 300)
    links = list(zip(chain, chain[1:])) + [(rng.randrange(2 * 10**6, 2 * 10**6 + 400), rng.randrange(2 * 10**6, 2 * 10**6 + 400)) for _ in range(150)]
    links += [(3 * 10**6 + k, 3 * 10**6) for k in range(100)] + links[:20] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {x: find(x) for x in root if find(x) != x}
    df = spark.createDataFrame(links, "a long, b long")
    for run in (1 << 18, 60):  # all links in one run; ten runs and rounds of stars after them
        monkeypatch.setattr(S, "CONTRACTED", run)
        found = [(r["node"], r["root"]) for r in S.components(df).collect()]
        assert len(found) == len(dict(found)) and dict(found) == want
    assert S.components(df.limit(0)).count() == 0


def test_drop(docs, corpus, clashing, nothing):
    prints = {i: brute_print(t) for i, t, *_ in corpus}
    of = classes(set(map(brute_print, [r[1] for r in corpus])))
    out = S.drop_near_duplicates(docs).collect()
    assert len(out) == len({of[brute_print(r[1])] for r in corpus})
    assert len({of[brute_print(r["text"])] for r in out}) == len(out)
    assert all(r["doc_id"] is None or r["doc_id"] == min(i for i in prints if i is not None and of[prints[i]] == of[prints[r["doc_id"]]]) for r in out)
    assert S.drop_near_duplicates(clashing).columns == clashing.columns
    assert S.drop_near_duplicates(nothing).count() == 0 and S.near_duplicate_classes(nothing).count() == 0
