import pytest

from listwright.llm import quality as Q


def brute(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            covered |= {i, i + 1, i + 2}
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


@pytest.mark.parametrize(
    "text",
    ["", "a b c a b c", "x x x x", "x x x", "é ü ñ\n\né ü ñ\n", "a\nb\na\na", "### |<>| 50%", "a b c d a b c e a b", "one\ttwo\x0bthree\rfour", "a b c\n \n \na b c"],
)
def test_measures(text):
    assert Q.measure(text.encode())[:5] == brute(text)


def test_report(docs, corpus):
    rows = {(r["doc_id"], r["lw_n_words"]): r for r in Q.quality_report(docs).collect()}
    assert len(Q.quality_report(docs).collect()) == len(corpus)
    for i, text, *_ in corpus:
        if text and len(text) > 20_000:
            continue  # counting windows by brute force is quadratic
        want = brute(text)
        got = rows[i, want[0]]
        assert tuple(got[f"lw_{m}"] for m in Q.MEASURES[:5]) == want
        assert got["lw_base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (got["lw_base_failed"] and got["lw_kept"])


def test_hosts_are_shrunk_and_rejected(spark):
    bad = "x x x x x"
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(80)), "good") for i in range(200)]
    rows += [(1000 + i, bad, "bad") for i in range(90)] + [(2000 + i, rows[i][1], "bad") for i in range(10)]
    rows += [(3000, bad, "small"), (3001, rows[0][1], None), (3002, bad, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in Q.quality_report(df).collect()}
    assert all(got[i]["lw_kept"] for i in range(200))
    assert not any(got[2000 + i]["lw_kept"] for i in range(10)), "a rejected host takes its clean documents along"
    assert 0 < got[3000]["lw_host_rate"] < 1, "one failure of one document is not a rate of 1"
    assert got[3001]["lw_kept"] and not got[3002]["lw_kept"] and got[3001]["lw_host_rate"] is None


def test_filter(docs, nothing, clashing):
    kept = {(r["doc_id"], r["lw_n_words"]) for r in Q.quality_report(docs).where("lw_kept").collect()}
    out = Q.quality_filter(docs)
    assert out.columns == docs.columns
    assert {(r["doc_id"], len((r["text"] or "").split())) for r in out.collect()} == kept
    assert Q.quality_filter(clashing).columns == clashing.columns
    assert Q.quality_filter(nothing).count() == 0 and Q.quality_report(nothing).count() == 0
