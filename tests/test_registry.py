import json

from listwright.sources.listing import gather
from listwright.sources.registry import CONNECTORS, Source, fetch_sources

NOW = "2024-01-16 00:00:00"


def test_a_source_that_fails_costs_itself_only(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"title": "Dev", "url": "https://x.example/1"}, {"title": "No url"}]))
    (tmp_path / "a.json").write_text(json.dumps({"jobs": [{"id": 1, "t": "Lead", "u": "https://y.example/1"}]}))
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>Ops</title><link>https://z.example/1</link></item></channel></rss>")
    spark.createDataFrame([("https://h.example/", "<ul><li class=j><a href='/1'>Cook</a></li></ul>")], "url string, html string").write.parquet(f"{tmp_path}/pages")
    broken = lambda spark, s, now: 1 / 0
    sources = [
        Source("m", "Manual", f"{tmp_path}/m.json"),
        Source("gone", "manual", f"{tmp_path}/gone.json"),
        Source("odd", "carrier pigeon", ""),
        Source("a", "api", f"{tmp_path}/a.json", {"items_path": "jobs", "title": "t", "url": "u", "id": "id"}, {"company": "Fixed"}),
        Source("broken", "Own", ""),
        Source("r", "rss", f"{tmp_path}/f.xml"),
        Source("off", "manual", f"{tmp_path}/m.json", enabled=False),
        Source("h", "html", f"{tmp_path}/pages", {"list": "li.j", "title": "a", "link": "a"}),
    ]
    found, statuses = fetch_sources(spark, sources, NOW, {"own": broken})
    got = [tuple(r)[:5] for r in statuses.collect()]
    assert [(n, s, c) for n, _, s, c, _ in got] == [("m", "ok", 1), ("gone", "failed", 0), ("odd", "failed", 0), ("a", "ok", 1), ("broken", "failed", 0), ("r", "ok", 1), ("h", "ok", 1)]
    errors = {n: e for n, *_, e in got}
    assert errors["odd"] == "unsupported source type 'carrier pigeon'" and "division" in errors["broken"] and errors["gone"] and errors["m"] is None
    rows = gather(found).orderBy("seq").collect()
    assert [(r["portal"], r["title"], r["url"], r["company"]) for r in rows] == [
        ("m", "Dev", "https://x.example/1", None), ("a", "Lead", "https://y.example/1", "Fixed"), ("r", "Ops", "https://z.example/1", None), ("h", "Cook", "https://h.example/1", None),
    ]
    assert set(CONNECTORS) == {"api", "rss", "html", "manual", "teamtailor", "hrmanager"}


def test_an_empty_catalogue(spark):
    found, statuses = fetch_sources(spark, [], NOW)
    assert found == [] and statuses.count() == 0


def test_request_addresses(spark):
    from pyspark.sql import functions as F

    from listwright.sources.detect import host
    from listwright.sources.requests import request_url

    rows = [
        ("https://a.example/{x}", {"x": "1 2", "y": "z"}, "https://a.example/1%202?y=z"),
        ("https://a.example/?q=1#f", {"y": "\u00e9", "n": None}, "https://a.example/?q=1&y=%C3%A9#f"),
        ("https://a.example/p", {}, "https://a.example/p"),
        ("https://a.example/p", None, "https://a.example/p"),
        ("https://a.example/{x}/{x}", {"x": "{y}"}, "https://a.example/%7By%7D/%7By%7D"),
        (None, {"x": "1"}, None),
    ]
    df = spark.createDataFrame(rows, "e string, p map<string, string>, want string")
    for r in df.select("want", request_url(F.col("e"), F.col("p")).alias("got")).collect():
        assert r["got"] == r["want"]
    bad = spark.createDataFrame([("https://a.example/{z}", {"x": "1"})], "e string, p map<string, string>")
    try:
        bad.select(request_url(F.col("e"), F.col("p"))).collect()
        raise AssertionError("an unknown placeholder passed")
    except Exception as e:
        assert "'{z}'" in str(e)
    hosts = spark.createDataFrame([("http://[::1]:80/a",), ("http://u@h.example:1/a",)], "u string").select(host(F.col("u"))).collect()
    assert [r[0] for r in hosts] == ["[::1]", "h.example"]
