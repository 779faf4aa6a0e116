import random
from collections import Counter

import corpus_pipeline
from listwright.llm import quality as Q
from listwright.llm.decontaminate import shingles, tokens
from tests.llm.conftest import SCHEMA, prose
from tests.llm.test_near_copies import brute_kept
from tests.llm.test_mixing import brute_targets, sizes_of
from tests.llm.test_quality import brute as measures


def test_stages(spark, corpus, tmp_path):
    rng = random.Random(31)
    items = [(i, prose(rng, 40)) for i in range(12)]
    rows = list(corpus)  # a very long text, nulls and repeated rows among them
    rows += [(900 + i, f"{prose(rng, 60)} {t} {prose(rng, 60)}", "en", "b", 0) for i, t in items]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    rules = Q.QualityRules()

    def good(text):
        n, _, symbols, dup, repeated = measures(text) if len(text or "") < 20_000 else (len(text.split()), 0, 0, 0, 0)
        lines = [x for x in (text or "").split("\n") if x.split()]
        capitals = sum(w.isupper() and len(w) > 2 for w in (text or "").split())
        return n >= 50 and repeated * 2 <= n and symbols <= 0.5 * n and dup <= 0.5 * len(lines) and capitals <= 0.5 * n

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = [r for r in rows if good(r[1])]
    hosts = Counter(r[3] for r in rows)
    assert all(sum(not good(r[1]) for r in rows if r[3] == h) < 0.5 * n for h, n in hosts.items() if h), rules
    stage = corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path))
    assert sorted(map(str, stage.collect())) == sorted(str(r) for r in docs.collect() if good(r["text"]))

    stays = set(brute_kept(kept))
    one = list({str(r[0]): r for r in kept if str(r[0]) in stays}.values())
    held = [shingles(tokens(t), 5) for _, t in items]
    clean = [r for r in one if not any(len(h & shingles(tokens(r[1]), 5)) >= 0.8 * len(h) for h in held)]
    assert len(clean) < len(one)

    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*docs.columns, "shard", "slot"]
    got = out.collect()
    copies = Counter((r["doc_id"], r["text"]) for r in got)
    assert set(copies) <= {(r[0], r[1]) for r in clean} and max(copies.values()) <= 2
    sizes = sizes_of(clean)
    target = brute_targets(sizes)
    largest = {s: max(len(r[1].split()) for r in clean if r[3] == s) for s in sizes}
    taken = Counter()
    for r in got:
        taken[r["source"]] += len(r["text"].split())
    for s in sizes:
        assert abs(taken[s] - target[s]) <= sum(largest.values())
    shard_of, slots = {}, {}
    for r in got:
        assert shard_of.setdefault(r["text"], r["shard"]) == r["shard"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


NAMES = [
    "lw_text", "LW_TEXT", "lw_n_words", "lw_shard", "lw_size", "lw_h1", "lw_id", "lw_source", "lw_doc", "lw_own", "lw_body", "LW_OWN", "lw_host", "lw_hash",
    "lw_key", "lw_run", "lw_slot", "lw_kept", "lw_copies", "lw_target", "lw_failed", "shingle", "item_id", "k", "node", "root", "a b.c",
]


def test_columns_may_have_any_names(spark, corpus, tmp_path):
    rng = random.Random(32)
    docs = spark.createDataFrame([r for r in corpus[:40]] + [(None, None, None, None, None), (50, "", "en", "a", 0)], SCHEMA)
    taken: set = set()
    for name in NAMES:
        if name.lower() not in taken:
            docs = docs.withColumn(name, docs["doc_id"] * 2)
            taken.add(name.lower())
    spark.createDataFrame([(1, prose(rng, 40))], "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns[: len(docs.columns)] == docs.columns
        rows = out.collect()
        assert rows and all(r[name] == (None if r["doc_id"] is None else 2 * r["doc_id"]) for r in rows for name in docs.columns[5:])


def test_an_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
