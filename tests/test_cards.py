"""Cards by windows over tags, against a tree of the page."""

import random
from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import functions as F

from listwright.sources.cards import card_fields, resolved

VOID = {"br", "img", "hr"}


class Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = {"tag": "", "attrs": {}, "up": None, "in": []}

    def handle_starttag(self, tag, attrs):
        node = {"tag": tag, "attrs": {k: v or "" for k, v in attrs}, "up": self.at, "in": []}
        self.at["in"].append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        if tag not in VOID:
            assert self.at["tag"] == tag
            self.at = self.at["up"]

    def handle_data(self, data):
        self.at["in"].append(data)


def below(node):
    for x in node["in"]:
        if not isinstance(x, str):
            yield x
            yield from below(x)


def text_of(node):
    return "".join(x if isinstance(x, str) else text_of(x) for x in node["in"] if isinstance(x, str) or x["tag"] != "script")


def up(node):
    while node["up"]:
        node = node["up"]
        yield node


def plain_cards(html):
    """li.card in a div#jobs; title: its h2 or h3; link: a[href^=/]; location: b right below an element of class loc."""
    tree = Tree()
    tree.feed(html)
    out = []
    for li in below(tree.root):
        if li["tag"] == "li" and "card" in li["attrs"].get("class", "").split() and any(u["tag"] == "div" and u["attrs"].get("id") == "jobs" for u in up(li)):
            first = lambda test: next((x for x in below(li) if test(x)), None)
            title = first(lambda x: x["tag"] in ("h2", "h3"))
            link = first(lambda x: x["tag"] == "a" and x["attrs"].get("href", "").startswith("/"))
            loc = first(lambda x: x["tag"] == "b" and "loc" in x["up"]["attrs"].get("class", "").split())
            shown = lambda n: n and " ".join(text_of(n).split())
            out.append((shown(title), shown(loc), (link and link["attrs"]["href"].strip()) or None))
    return out


def random_page(rng, deep=0):
    out = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.random()
        if deep > 4 or kind < 0.25:
            out.append(rng.choice(["word ", "a &amp; b", " &oslash; ", "<br>", "<img src='x'>", "<!-- <li class=card> -->", "<script>if (a<b) '</li>'</script>", "2 > 1 "]))
        else:
            tag = rng.choice(["div", "ul", "p", "li", "h2", "h3", "a", "b", "span"])
            attrs = rng.choice(["", ' class="card big"', " class='loc'", ' id="jobs"', ' href="/x?a=1&amp;b=2"', ' HREF="http://y"', ' title="href=/no" class=card', ' data-x="class=loc"'])
            # cards aren't nested deeper than in one other
            inner = random_page(rng, deep + 1)
            out.append(f"<{tag}{attrs}>{inner}</{tag}>")
    return "".join(out)


SELECTORS = {"list": "div#jobs li.card", "title": "h2, h3", "link": "a[href^='/']", "location": ".loc > b"}


def test_random_pages(spark):
    rng = random.Random(6)
    pages = [(i, f"<html><div id='jobs'>{random_page(rng)}{random_page(rng)}</div>{random_page(rng)}</html>") for i in range(400)]
    got = {}
    for r in card_fields(spark.createDataFrame(pages, "page long, html string"), SELECTORS).orderBy("page", "at").collect():
        got.setdefault(r["page"], []).append((r["title"], r["location"], r["href"]))
    seen = nested = 0
    for i, html in pages:
        tree = Tree()
        tree.feed(html)
        depth = max((sum(u["tag"] == "li" and "card" in u["attrs"].get("class", "").split() for u in up(x)) for x in below(tree.root)), default=0)
        if depth > 2:
            continue
        want = plain_cards(html)
        assert got.get(i, []) == want, html
        seen += len(want)
        nested += depth == 2
    assert seen > 60 and nested


def test_odd_pages(spark):
    pages = [(1, None), (2, ""), (3, "no tags"), (4, "<ul id=u><li class=c>one<li class=c>two</ul>"), (5, "<li class=c><p>x</li>"), (6, "</li></ul><li class=c>y</li>"), (7, "<li class=c")]
    got = sorted((r["page"], r["title"]) for r in card_fields(spark.createDataFrame(pages, "page long, html string"), {"list": "li.c", "title": ":scope"}).collect())
    assert got == [(4, "one"), (4, "two"), (5, "x"), (6, "y")]


def test_links_as_a_browser_takes_them(spark):
    bases = ["https://a.example/x/y/z.html?q=1#f", "http://a.example", "http://a.example/", "https://a.example/d/"]
    links = ["p", "/p/q", "../p", "../../../p", "./p", "?r=2", "//b.example/c", "https://c.example/", "p/../q?x=../y", "a/b/../../c", "mailto:x", "..", "../"]
    rows = [(b, x) for b in bases for x in links]
    got = {(r["b"], r["x"]): r["u"] for r in spark.createDataFrame(rows, "b string, x string").select("b", "x", resolved(F.col("b"), F.col("x")).alias("u")).collect()}
    odd = [(k, v, urljoin(*k)) for k, v in got.items() if v != urljoin(*k)]
    assert not odd
