import pytest
from pyspark.sql import functions as F

from listwright.functions import dates, text as T
from listwright.functions import json_paths as J


def one(spark, make, *values):
    """``make`` of each value, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", make(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_company(spark):
    got = one(spark, T.normalise_company, "Sopra Steria A/S", "Sopra Steria ApS", "Danske Spil A/S", "ACME GmbH", "Acme, Inc.", None, "", "DR", "dr", "DR A/S")
    assert got == ["sopra steria", "sopra steria", "danske spil", "acme", "acme", "", "", "danmarks radio", "danmarks radio", "danmarks radio"]


def test_location(spark):
    got = one(spark, T.normalise_location, "København K og mulighed for hjemmearbejde", "Herlev og mulighed for fjernarbejde", "København, , Denmark", "København Ø", "New York, NY", None)
    assert got == ["københavn", "herlev", "københavn", "københavn", "new york", ""]


def test_url(spark):
    got = one(spark, T.normalise_url, "https://Example.com/Job/1/#top", "https://example.com/job/1", "https://example.com", "https://example.com:443/a//?Q=1/", "http://example.com:80", "http://example.com:8080/")
    assert got == ["https://example.com/job/1", "https://example.com/job/1", "https://example.com/", "https://example.com/a?q=1/", "http://example.com/", "http://example.com:8080/"]


def test_html(spark):
    got = one(spark, T.strip_html, "We need <b>C#</b> skills &amp; cloud experience.", "<p>foo</p><ul><li>bar</li></ul>", "a > b <unclosed", None, "&lt;b&gt;")
    assert got == ["We need C# skills & cloud experience.", "foo bar", "a b", "", "<b>"]


@pytest.mark.parametrize("keyword,text,hit", [("C", "C# and C++", False), ("C", "plain C.", True), ("c#", "C# dev", True), ("C", "øC dev", False), ("Go", "Django", False), (".NET", "use .net core", True), ("SQL Server", "sql server", True), ("C++", "C++", True), ("R", "R_2", False)])
def test_keyword(spark, keyword, text, hit):
    assert one(spark, lambda v: T.keyword_hits([keyword], v), text) == [[keyword] if hit else []]


def test_keyword_list(spark):
    assert one(spark, lambda v: T.keyword_hits(["Azure", "c#", "C#", " ", "azure"], v), "C# on Azure", None) == [["Azure", "c#"], []]


def test_levels_and_modes(spark):
    df = spark.createDataFrame([("Senior Dev", "junior team"), ("Developer", "for a jr. person"), ("Staff Engineer", ""), ("Dev", None), ("Sr Dev", None), ("Mid-level dev", None)], "t string, d string")
    assert [r[0] for r in df.select(T.seniority(F.col("t"), F.col("d"))).collect()] == ["senior", "junior", "lead", None, "senior", "mid"]
    got = one(spark, T.remote_mode, "Hybrid, fully remote", "100% Remote", "on-site", "remote", "mulighed for hjemmearbejde", "office", None, "remote, in-office")
    assert got == ["hybrid", "remote", "onsite", "remote", "hybrid", "unknown", "unknown", "onsite"]


def test_titles(spark):
    titles = ["Product Manager", "Software Engineering Manager", "QA Lead", "QA Engineer", "HR Partner", "Controller", "Recruitment Lead", "Developer Advocate", None, "Business Developer", "Customer Success", "Threat analyst"]
    assert one(spark, T.non_engineering_title, *titles) == [True, False, True, False, True, True, True, False, False, False, True, False]


def test_trailing_company(spark):
    pair = lambda v: F.struct(*T.split_trailing_company(v))
    got = one(spark, pair, "Senior .Net udvikler til afdeling i vækst, Sopra Steria A/S", "no comma", "a, b, c")
    assert [tuple(x) for x in got] == [("Senior .Net udvikler til afdeling i vækst", "Sopra Steria A/S"), ("no comma", None), ("a, b", "c")]


def test_dates(spark):
    got = one(spark, lambda v: dates.tolerant_timestamp(v).cast("string"), "2024-01-05T10:00:00Z", "2024-01-05", "Fri, 05 Jan 2024 10:00:00 GMT", "05 Jan 2024 10:00:00 +0200", "soon", None)
    assert got == ["2024-01-05 10:00:00", "2024-01-05 00:00:00", "2024-01-05 10:00:00", "2024-01-05 08:00:00", None, None]
    assert one(spark, lambda v: dates.epoch_in_slashes(v).cast("string"), "/Date(1700000000000)/", "/Date(-62135596800000)/", "x", None) == ["2023-11-14 22:13:20", None, None, None]
    assert one(spark, lambda v: dates.rounded(v.cast("double")), "2.5", "3.5", "-0.5") == [2, 4, 0]
    assert one(spark, lambda v: dates.step_duration(v.cast("long")), "420", "4200", "75000") == ["420 ms", "4.2 s", "1:15"]


def test_json_paths(spark):
    doc = lambda v: F.try_parse_json(v)
    assert one(spark, lambda v: J.read(doc(v), "a.b.c"), '{"a":{"b":{"c":"x"}}}', '{"a":{"b":1}}', "{") == ["x", None, None]
    assert one(spark, lambda v: J.read(doc(v), "items.0.id"), '{"items":[{"id":7}]}', '{"items":{"0":{"id":true}}}', '{"items":[]}') == ["7", "True", None]
    assert one(spark, lambda v: J.read(doc(v), "a"), '{"a":[1]}', '{"a":{}}', '{"a":null}', '{"a":1.5}') == [None, None, None, "1.5"]
    assert one(spark, lambda v: J.render("https://x/{a.id}/{b}", doc(v)), '{"a":{"id":3}}') == ["https://x/3/"]


def test_small_helpers(spark):
    assert one(spark, T.slug, "Hello, World! 2") == ["hello-world-2"]
    assert one(spark, T.pretty, "acme-labs_x") == ["Acme Labs X"]
    assert one(spark, lambda v: T.truncate(v, 3), "abcdef", "abc") == ["abc…", "abc"]
    assert one(spark, T.squeeze_document, "a  b\r\n\n\n\nc ") == ["a b\n\nc"]
    assert one(spark, T.fenced, "```json\n{}\n```", "plain") == ["{}", "plain"]
    assert one(spark, T.braces, "x {a} y", "none") == ["{a}", None]
