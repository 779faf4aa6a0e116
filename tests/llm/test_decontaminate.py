import random
from collections import Counter

from tests.llm.conftest import prose

from listwright.llm import decontaminate as D


def items():
    rng = random.Random(11)
    out = [(i, prose(rng, rng.randint(12, 60)) + rng.choice(["", "\n" + prose(rng, 6), ". " + prose(rng, 8)])) for i in range(80)]
    return out + [(80, ""), (81, None), (82, "two words"), (83, out[3][1])]


def index(own, rules=D.LeakRules()):
    words = [D.tokens(t) for _, t in own]
    df = Counter(w for own_words in words for w in set(own_words))
    return D.Index(own, df, len(own), sum(map(len, words)) / len(own), rules)


def brute(text, own):
    """Items with 80% of their distinct five-word runs in the text, wherever they stand."""
    grams = D.shingles(D.tokens(text), 5)
    out = set()
    for i, t in own:
        mine = D.shingles(D.tokens(t), 5)
        if mine and len(D.tokens(t)) >= 5 and len(mine & grams) >= 0.8 * len(mine):
            out.add(i)
    return out


def test_search_finds_all_above_threshold():
    own = [x for x in items() if D.tokens(x[1])]
    ix = index(own)
    rng = random.Random(12)
    everything = Counter(w for _, t in own for w in D.tokens(t))
    for _ in range(400):
        words = set(rng.sample(sorted(everything), 60)) | set(rng.choice([t for _, t in own if t]).encode().lower().split()[: rng.randint(0, 60)])
        want = set()
        for slot in range(len(ix.items)):
            block = ix.blocks[slot // ix.rules.items_per_block]
            score = sum(x for t in block if t in words for s, x in block[t] if s == slot)
            if score >= 1:
                want.add((slot, round(score, 9)))
        assert {(s, round(x, 9)) for s, x in ix.search(words)} == want


def test_leaks():
    own = items()
    ix = index([x for x in own if D.tokens(x[1])])
    rng = random.Random(13)
    long_items = [x for x in own if len(D.tokens(x[1])) >= 12]
    for k in range(200):
        item, text = long_items[k % len(long_items)]
        words = text.split(" ")
        if k % 3 == 1:
            words[-1] = words[-1] + "x" if len(words) > 30 else words[-1]
        if k % 3 == 2:
            words = [w.upper() + "," for w in words]
        body = f"{prose(rng, rng.randint(0, 300))} {' '.join(words)} {prose(rng, rng.randint(0, 300))}"
        got = {x[0] for x in ix.leaks(body)}
        assert brute(body, own) <= got | {82}
        assert item in got
    assert not any(ix.leaks(prose(rng, 400)) for _ in range(50))
    assert ix.leaks(None) == ix.leaks("") == []


def test_table(spark, docs, corpus, clashing, nothing):
    rng = random.Random(14)
    own = items()
    bench = spark.createDataFrame(own, "item_id long, text string")
    planted = [(1000 + i, f"{prose(rng, 150)} {t} {prose(rng, 150)}", "en", "a", 0) for i, t in own[:20]]
    both = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    want = {(1000 + i, i) for i, _ in own[:20]} | {(1003, 83)}
    assert {(r["doc_id"], r["item_id"]) for r in D.find_leaks(both, bench).collect()} == want
    small_blocks = D.LeakRules(block_words=300)
    assert {(r["doc_id"], r["item_id"]) for r in D.find_leaks(both, bench, rules=small_blocks).collect()} == want
    left = D.drop_leaks(both, bench)
    assert left.columns == docs.columns
    assert left.count() == len(corpus) and left.where("doc_id >= 1000").count() == 0
    assert D.drop_leaks(clashing, bench).columns == clashing.columns
    assert D.find_leaks(nothing, bench).count() == 0 and D.find_leaks(docs, bench.limit(0)).count() == 0
    assert D.drop_leaks(docs, bench.limit(0)).count() == len(corpus)


def test_items_of_any_type(spark, docs):
    rng = random.Random(15)
    text = prose(rng, 40)
    one = spark.createDataFrame([(7, f"{prose(rng, 50)} {text} {prose(rng, 50)}")], "doc_id long, text string")
    for kind in ("int", "smallint", "string", "bigint"):
        bench = spark.createDataFrame([(5, text)], "item_id long, text string").selectExpr(f"cast(item_id as {kind}) item_id", "text")
        found = D.find_leaks(one, bench)
        assert found.schema["item_id"].dataType == bench.schema["item_id"].dataType and [str(r["item_id"]) for r in found.collect()] == ["5"]
