import math
import random
import re
from collections import Counter

import pytest

from listwright.llm.urls import SEED_WORDS, UrlPlan, UrlRule, best_split, judge_urls

RULES = (UrlRule("allow", "org", "/"), UrlRule("block", "example.org", "/es/"), UrlRule("block", "example.org", "/en/1"), UrlRule("allow", "com", "/fr/"), UrlRule("block", "com", "/de/"))
PLAN = UrlPlan(rules=RULES)
WORDS = "river stone garden music letter winter summer paper".split()


def rows_of(rng, n=300):
    urls = []
    for i in range(n):
        name = "".join(rng.sample(WORDS, 2)) if rng.random() < 0.8 else rng.choice(["cheap-pills", "casinoriver", "xxxpaper"])
        urls.append(f"http{rng.choice(['', 's'])}://{rng.choice(['', 'www.', 'M.'])}{name}.example.{rng.choice(['org', 'com', 'net'])}/{rng.choice(['en', 'de', 'fr', 'es'])}/{rng.choice([str(i), '1', 'free/9', ''])}{rng.choice(['', '?q=://x', '#top'])}")
    urls += [None, "", "no url", "://", "http://", "http://a.org", "http://org/x", "http://Xorg/x", "ftp://EXAMPLE.org/es/?a", "x://é.example.org/en/1/2", "http://a.com/de", "http://h?x://y/de/", "x" * 50_000, "http://" + "river" * 300 + ".net/" + "a/" * 3000]
    urls += [urls[0]] * 4
    return [(i, u, " ".join(rng.choice(WORDS) for _ in range(20)) if i % 5 else None) for i, u in enumerate(urls)]


@pytest.fixture(scope="module")
def rows():
    return rows_of(random.Random(3))


def reference(rows, plan):
    """Plain Python, one page at a time."""
    parts = []
    for _, url, _ in rows:
        host, path = "", ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in host)
        parts.append((host, path))
    letters = lambda s: re.findall(r"[^\W\d_]+", s)
    counts = Counter(w for _, _, t in rows if t for w in letters(t.lower()))
    for host in {h for h, _ in parts}:
        counts.update(m[0] for m in re.finditer(r"(?<=-)[^\W\d_]+|[^\W\d_]+(?=-)", host))
    counts = Counter({w: n for w, n in counts.items() if len(w) <= plan.longest})
    for s in plan.seeds:
        counts[s] += plan.seed_count
    total = sum(counts.values())

    def split(run):
        best = {0: (0.0, [])}
        for end in range(1, len(run) + 1):
            options = []
            for start in range(max(0, end - plan.longest), end):
                w = run[start:end]
                p = counts[w] / total if counts[w] else 10 / (total * 10 ** len(w))
                options.append((best[start][0] + math.log(p), start))
            score, start = max(options, key=lambda o: o[0])
            best[end] = (score, [*best[start][1], run[start:end]])
        return best[len(run)][1]

    cuts = {}
    feats = []
    for host, path in parts:
        words = [w for r in letters(host) for w in (cuts.get(r) or cuts.setdefault(r, split(r)))]
        own = [("h", w) for w in words] + [("p", "#" if w.isdigit() else w) for w in re.findall(r"[^\W\d_]+|\d+", path.lower())]
        feats.append((words, own, bool(set(words) & set(plan.seeds))))
    seen = {c: Counter(x for _, own, s in feats if s == c for x in own) for c in (True, False)}
    used = len(set(seen[True]) | set(seen[False]))
    n = Counter(s for _, _, s in feats)
    out = []
    for (host, path), (words, own, _) in zip(parts, feats):
        logs = {c: math.log(n[c] / len(rows)) + sum(math.log((seen[c][x] + 1) / (seen[c].total() + used)) for x in own) for c in seen}
        fits = [r for r in plan.rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fits, key=lambda r: len(r.host + r.path), default=None)
        p = 1 / (1 + math.exp(min(700, logs[False] - logs[True])))
        out.append((host, path, rule and rule.host + rule.path, rule.verdict if rule else "block" if p >= plan.threshold else "allow", words, p))
    return out


def test_against_plain_version(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r["lw_own"]["page_id"]: r for r in judge_urls(df.select("page_id", "url"), df, plan=PLAN).collect()}
    assert len(got) == len(rows)
    blocked = 0
    for (i, _, _), (host, path, rule, verdict, words, p) in zip(rows, reference(rows, PLAN)):
        r = got[i]
        assert (r["lw_host"], r["lw_path"], r["lw_rule"], r["lw_verdict"], r["lw_words"]) == (host, path, rule, verdict, words)
        assert r["lw_score"] == pytest.approx(p, abs=1e-9)
        blocked += rule is None and verdict == "block"
    assert blocked > 20


def test_run_together_names_are_blocked(spark, rows):
    df = spark.createDataFrame([*rows, (-1, "http://cheappills.net/en/5", None), (-2, "http://gardenletter.net/en/5", None)], "page_id long, url string, html string")
    got = {r["lw_own"]["page_id"]: r for r in judge_urls(df.select("page_id", "url"), df, plan=PLAN).where("lw_own.page_id < 0").collect()}
    assert (got[-1]["lw_words"], got[-1]["lw_verdict"]) == (["cheap", "pills", "net"], "block")
    assert (got[-2]["lw_words"], got[-2]["lw_verdict"]) == (["garden", "letter", "net"], "allow")


def test_best_split_prefers_longer_words():
    hits = {(0, 4): 9, (4, 4): 9, (0, 8): 9}
    assert best_split("fishtail", hits, 100, 20) == ["fishtail"]
    assert best_split("", {}, 100, 20) == []
    assert best_split("qqq", {}, 0, 2) == ["q", "qq"] or "".join(best_split("qqq", {}, 0, 2)) == "qqq"


def test_odd_tables(spark, rows):
    schema = "page_id long, url string, html string, lw_host string, host string, n long"
    empty = spark.createDataFrame([], schema)
    assert judge_urls(empty, empty, plan=PLAN).collect() == []
    one = spark.createDataFrame([(1, None, None, "a", "b", None)], schema)
    got = judge_urls(one, one, plan=PLAN).collect()[0]
    assert (got["lw_host"], got["lw_path"], got["lw_rule"], got["lw_verdict"], got["lw_score"]) == ("", "", None, "allow", 0.0)
    assert got["lw_own"]["lw_host"] == "a"
    every = spark.createDataFrame([(1, "http://spam.net/", None, None, None, None)], schema)
    assert [r["lw_verdict"] for r in judge_urls(every, every, plan=UrlPlan()).collect()] == ["block"]
    assert [r["lw_verdict"] for r in judge_urls(every, every, plan=UrlPlan(seeds=())).collect()] == ["allow"]


def test_query(spark):
    from listwright.llm.queries import op11_url_filter

    df = op11_url_filter(spark, "/root/testdata/sf0.001")
    assert df.dtypes[:5] == [("page_id", "bigint"), ("host", "string"), ("path", "string"), ("rule", "string"), ("verdict", "string")]
    rows = df.collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.001/pages.parquet").count()
    for r in rows:
        if r["rule"] is None and r["verdict"] == "block":
            assert set(r["host_words"].split()) & set(SEED_WORDS)
