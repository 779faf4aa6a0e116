import re
from collections import defaultdict

import pytest

from listwright.llm.mixing import MixPlan, mixed_documents, weighted_mix


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target = dict.fromkeys(order, 0.0)
    left, open_ = 1.5 * sum(sizes.values()), {s for s in order if sizes[s]}
    while open_ and left > 1e-6:
        each = left / sum(weight[s] for s in open_)
        left = 0.0
        for s in list(open_):
            target[s] += each * weight[s]
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


def sizes_of(corpus):
    out = defaultdict(int)
    for _, text, _, source, _ in corpus:
        out[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    return out


@pytest.mark.parametrize("rows", [7, 64, 4096])
def test_mix(docs, corpus, rows):
    sizes = sizes_of(corpus)
    want = brute_targets(sizes)
    got = weighted_mix(docs, plan=MixPlan(rows_per_bucket=rows), carry=False).collect()
    assert len(got) == len(corpus)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r["lw_source_size"] == sizes[r["lw_source"]]
        assert r["lw_target"] == pytest.approx(want[r["lw_source"]], rel=1e-9)
        assert r["lw_taken"] in (0, r["lw_size"], 2 * r["lw_size"])
        taken[r["lw_source"]] += r["lw_taken"]
        largest[r["lw_source"]] = max(largest[r["lw_source"]], r["lw_size"])
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())
    for s in sizes:
        assert abs(taken[s] - want[s]) <= sum(largest.values())
        assert taken[s] >= want[s] - largest[s] - 1


def test_runs_do_not_change_the_mix(docs):
    one, other = (sorted((str(r["lw_id"]), r["lw_size"], r["lw_taken"]) for r in weighted_mix(docs, plan=MixPlan(rows_per_bucket=n), carry=False).collect()) for n in (5, 100_000))
    assert one == other


def test_documents(docs, clashing, nothing):
    copies = {}
    for r in weighted_mix(docs).collect():
        copies[str(r["doc_id"]), r["text"]] = copies.get((str(r["doc_id"]), r["text"]), 0) + r["lw_copies"]
    out = mixed_documents(docs)
    assert out.columns == docs.columns and mixed_documents(clashing).columns == clashing.columns
    got = {}
    for r in out.collect():
        got[str(r["doc_id"]), r["text"]] = got.get((str(r["doc_id"]), r["text"]), 0) + 1
    assert got == {k: n for k, n in copies.items() if n}
    assert mixed_documents(nothing).count() == 0


def test_sources_without_words(spark):
    schema = "doc_id long, source string, text string"
    rows = [(1, "a", None), (2, "a", ""), (3, "a", " \n\t "), (4, "b", "one two"), (5, "b", "three"), (6, None, ""), (7, "c", None)]
    got = {r["lw_id"]: r for r in weighted_mix(spark.createDataFrame(rows, schema), carry=False).collect()}
    assert len(got) == len(rows)
    for i in (1, 2, 3, 6, 7):
        assert (got[i]["lw_size"], got[i]["lw_source_size"], got[i]["lw_target"], got[i]["lw_copies"], got[i]["lw_taken"]) == (0, 0, 0.0, 0, 0)
    assert got[4]["lw_target"] == 4.5 and got[4]["lw_taken"] + got[5]["lw_taken"] > 2
    assert {r["doc_id"] for r in mixed_documents(spark.createDataFrame(rows, schema)).collect()} <= {4, 5}
    empty = spark.createDataFrame(rows[:3] + rows[5:], schema)
    assert [(r["lw_target"], r["lw_taken"]) for r in weighted_mix(empty, carry=False).collect()] == [(0.0, 0)] * 5
    assert mixed_documents(empty).count() == 0


def test_sql_on_sources_without_words(spark, tmp_path):
    import duckdb

    from listwright.llm.oracles import mix_sql
    from listwright.llm.queries import op2_source_mix

    for k, rows in enumerate(([(1, "a", None), (2, "a", ""), (4, "b", "one two"), (5, "b", "three"), (6, None, " ")], [(1, "a", None), (2, None, "")])):
        spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/{k}/documents.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/{k}/documents.parquet/*.parquet'")
        df = op2_source_mix(spark, f"{tmp_path}/{k}")
        assert sorted(map(tuple, df.collect())) == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({mix_sql()})").fetchall())
