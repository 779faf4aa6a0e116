"""Listings from the cards of web pages.

A page is cut into tags and texts, and its tags are events in their order. A running sum of the opening and closing tags
of one name gives the level of each, and the next event of the same level is the closing tag that belongs to an opening
one: so elements are spans of the page. Being inside an element is a matter of counting, too: the spans that begin before
a place less those that have ended. Nothing is joined but a page's spans with the page, and no page is parsed by a task
as a whole but in windows over its events.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listwright.functions import text as T
from listwright.functions.entities import decode_entities
from listwright.sources.listing import build_listings, item_order

#: Cards that an element may be in beside the innermost one.
NESTED = 1
FIELDS = ("title", "link", "company", "location", "description")
#: A comment, a script or style with what it holds, a tag, or text up to the next of these.
_PIECE = r"(?is)<!--.*?(?:-->|$)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|$)|<[^>]*(?:>|$)|[^<]+"
_VOID = "area base br col embed hr img input link meta param source track wbr".split()


@dataclass(frozen=True)
class Step:
    """One part of a selector: the name of the tag, id, classes and attributes it asks for; ``child``: of a direct child."""

    child: bool
    tests: tuple[tuple[str, str, str], ...]


def parse_selector(selector: str) -> list[list[Step]]:
    """The alternatives of a selector, each a list of steps from the outermost in. Known are tags, ``*``, ``.class``,
    ``#id``, ``[name]`` and ``[name=value]`` with ``^ $ * ~`` before the sign, descent and ``>``."""
    out = []
    for one in selector.split(","):
        steps = []
        for child, simple in re.findall(r"(>)?\s*((?:[^\s>\[]|\[[^\]]*\])+)", one):
            tests = []
            for part in re.findall(r"[#.]?[\w-]+|\*|\[[^\]]+\]", simple):
                if part[0] in "#.":
                    tests.append(("id" if part[0] == "#" else "class", "=" if part[0] == "#" else "~", part[1:]))
                elif part[0] == "[":
                    name, sign, value = re.fullmatch(r"\[\s*([\w-]+)\s*(?:([\^$*~]?)=\s*[\"']?(.*?)[\"']?\s*)?\]", part).groups()
                    tests.append((name.lower(), "" if value is None else sign or "=", value or ""))
                elif part != "*":
                    tests.append(("", "=", part.lower()))
            steps.append(Step(bool(child), tuple(tests)))
        out.append(steps)
    return out


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute within a tag's text, decoded; empty where it has none, null where it isn't there."""
    pattern = r"(?s)\s([^\s>\"'=/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?"
    each = lambda i: F.regexp_extract_all(tag, F.lit(pattern), F.lit(i))
    pairs = F.arrays_zip(each(1).alias("name"), each(2).alias("a"), each(3).alias("b"), each(4).alias("c"))
    own = F.get(F.filter(pairs, lambda p: F.lower(p["name"]) == name.lower()), F.lit(0))
    return decode_entities(F.concat(own["a"], own["b"], own["c"]))


def _fits(step: Step) -> Column:
    held = F.lit(True)
    for name, sign, value in step.tests:
        if not name:
            held = held & (F.col("name") == value)
            continue
        own = attribute(F.col("piece"), name)
        words = F.split(own, r"\s+")
        test = {"": own.isNotNull(), "=": own == value, "^": F.startswith(own, F.lit(value)), "$": F.endswith(own, F.lit(value)), "*": F.contains(own, F.lit(value)), "~": F.array_contains(words, value)}[sign]
        held = held & F.coalesce(test, F.lit(False))
    return held


def page_elements(pages: DataFrame) -> DataFrame:
    """(``page``, ``at``, ``until``, ``name``, ``piece``): every element of ``pages`` (page, pieces), from its opening tag
    to the place of its closing one. One that is never closed ends before the next opening tag of its name, or with its
    page; void ones hold nothing."""
    events = pages.select("page", F.posexplode("pieces").alias("at", "piece"), F.size("pieces").alias("n")).where(F.col("piece").rlike(r"(?s)^</?[A-Za-z].*>$"))
    name = F.lower(F.regexp_extract("piece", r"^</?([^\s>/]+)", 1))
    ends = F.startswith(F.col("piece"), F.lit("</"))
    single = name.isin(*_VOID, "script", "style") | F.endswith(F.col("piece"), F.lit("/>"))
    events = events.select("*", name.alias("name"), F.when(single & ~ends, 0).when(ends, -1).otherwise(1).alias("step")).where(~(single & ends))
    order = Window.partitionBy("page", "name").orderBy("at")
    depth = F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0))
    events = events.withColumn("level", F.when(F.col("step") == -1, depth + 1).when(F.col("step") == 1, depth))
    # the next event of an opening tag's level is its end; another opening tag there means that there is none
    pair = Window.partitionBy("page", "name", "level").orderBy("at")
    follows = F.when(F.lead("step").over(pair) == -1, F.lead("at").over(pair))
    until = F.when(F.col("step") == 0, F.col("at")).otherwise(F.coalesce(follows, F.lead("at").over(order) - 1, F.col("n") - 1))
    return events.withColumn("until", until).where("step >= 0").select("page", "at", "until", "name", "piece")


def _holder(elements: DataFrame, mark: str, out: str) -> DataFrame:
    """``elements`` with ``out``: the place of the innermost other element that holds it and for which column ``mark`` is
    true. A place's depth is the number of marked spans around it; the innermost is the last one to begin at that depth."""
    marked = F.coalesce(F.col(mark), F.lit(False))
    begin, end = F.struct(F.col("at").alias("place"), F.when(marked, 1).otherwise(0).alias("step")), F.struct(F.col("until").alias("place"), F.lit(-1).alias("step"))
    events = elements.select("*", F.explode(F.when(marked, F.array(begin, end)).otherwise(F.array(begin))).alias("event"))
    order = Window.partitionBy("page").orderBy("event.place", F.desc("event.step")).rowsBetween(Window.unboundedPreceding, 0)
    events = events.withColumn("depth", F.sum("event.step").over(order)).where("event.step >= 0")
    # an element asks at the depth around it; a marked one begins at the depth that it adds
    starts = F.struct(F.col("depth").alias("depth"), F.lit(True).alias("starts"))
    asks = F.struct((F.col("depth") - F.col("event.step")).alias("depth"), F.lit(False).alias("starts"))
    rows = events.select("*", F.explode(F.when(F.col("event.step") == 1, F.array(starts, asks)).otherwise(F.array(asks))).alias("role"))
    earlier = Window.partitionBy("page", "role.depth").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("role.starts"), F.col("at")), ignorenulls=True).over(earlier)
    return rows.withColumn(out, F.when(F.col("role.depth") > 0, last)).where("not role.starts").select(*elements.columns, out)


def selected(elements: DataFrame, selector: str, name: str) -> DataFrame:
    """``elements`` with a Boolean column ``name``: whether the selector picks them."""
    columns = elements.columns
    rows, picks = elements, []
    for i, steps in enumerate(parse_selector(selector)):
        before = None
        for j, step in enumerate(steps):
            fits = _fits(step)
            if before is None:
                held = fits
            elif step.child:
                rows = _holder(rows.withColumn("every_", F.lit(True)), "every_", "parent_").drop("every_")
                parents = rows.where(F.col(before)).select("page", F.col("at").alias("parent_"), F.lit(True).alias("has_"))
                rows = rows.join(parents, ["page", "parent_"], "left")
                held = fits & F.col("has_").isNotNull()
            else:
                rows = _holder(rows, before, "around_")
                held = fits & F.col("around_").isNotNull()
            mark = f"{name}_{i}_{j}"
            rows = rows.withColumn(mark, held).drop("parent_", "has_", "around_")
            before = mark
        picks.append(F.col(before))
    picked = picks[0]
    for p in picks[1:]:
        picked = picked | p
    return rows.withColumn(name, picked).select(*columns, name)


def card_fields(pages: DataFrame, selectors: dict[str, str]) -> DataFrame:
    """(``page``, ``at``, and a string each of title, company, location, description and href) for every card of ``pages``
    (page, html); ``selectors`` has list, title, link, url_attribute, company, location and description. A field is that of
    the first element in the card which its selector picks, without what scripts and styles hold; ``:scope`` is the card
    itself. Cards may stand in another card; of deeper ones the outer cards miss what the inner ones hold."""
    cut = pages.select("page", F.regexp_extract_all("html", F.lit(_PIECE), F.lit(0)).alias("pieces"))
    elements = selected(page_elements(cut), selectors["list"], "card_")
    wanted = [f for f in FIELDS if selectors.get(f)]
    for f in wanted:
        elements = elements.withColumn(f"is_{f}", F.col("card_")) if selectors[f] == ":scope" else selected(elements, selectors[f], f"is_{f}")
    rows = _holder(elements, "card_", "in_")
    # a card within a card is part of both, so every element goes to all cards around it, one level a turn
    own = rows.where("card_").select("page", F.col("at").alias("card"), "until", "piece")
    outer = rows.where("card_ and in_ is not null").select("page", F.col("at").alias("in_"), F.col("in_").alias("out_"))
    spans, level = rows.where("in_ is not null"), rows.where("in_ is not null")
    for _ in range(NESTED):
        level = level.join(outer, ["page", "in_"]).drop("in_").withColumnRenamed("out_", "in_")
        spans = spans.unionByName(level)
    spans = spans.select("page", F.col("in_").alias("card"), "at", "until", "piece", *[f"is_{f}" for f in wanted])
    chosen = spans.groupBy("page", "card").agg(*[F.min(F.when(F.col(f"is_{f}"), F.struct("at", "until", "piece"))).alias(f) for f in wanted]) if wanted else spans.select("page", "card").distinct()
    found = own.join(chosen, ["page", "card"], "left")
    span = lambda f: F.struct(F.col("card").alias("at"), F.col("until"), F.col("piece")) if selectors[f] == ":scope" else F.col(f)
    found = found.select("page", "card", *[span(f).alias(f) for f in wanted])
    rows = found.join(cut, "page")

    def shown(f: str) -> Column:
        if f not in wanted:
            return F.lit(None).cast("string")
        inner = F.slice("pieces", F.col(f)["at"] + 1, F.col(f)["until"] - F.col(f)["at"] + 1)
        texts = F.filter(inner, lambda p: ~F.startswith(p, F.lit("<")))
        return F.when(F.col(f).isNotNull(), T.collapse(decode_entities(F.array_join(texts, ""))))

    href = attribute(F.col("link")["piece"], selectors.get("url_attribute") or "href") if "link" in wanted else F.lit(None).cast("string")
    return rows.select("page", F.col("card").alias("at"), *[shown(f).alias(f) for f in FIELDS if f != "link"], F.nullif(F.trim(href), F.lit("")).alias("href"))


def resolved(base: Column, link: Column) -> Column:
    """``link`` as a browser takes it on the page ``base``: absolute ones stay, ``//host``, ``/path``, ``?query``, ``#part``
    and relative paths are completed, steps up (``..``) taken out, ten deep at most."""
    site = F.regexp_extract(base, r"^[A-Za-z][\w+.-]*://[^/?#]*", 0)
    plain = F.regexp_extract(base, r"^[^?#]*", 0)
    folder = F.regexp_extract(F.substr(plain, F.length(site) + 1), r"(?s)^.*/", 0)
    path = F.regexp_replace(F.concat(F.when(folder == "", "/").otherwise(folder), link), r"/(?:\./)+", "/")
    path = F.regexp_replace(path, r"(/\.\.?)$", "$1/")
    for _ in range(10):
        path = F.regexp_replace(path, r"^((?:/(?!\.\.(?:/|$))[^/?#]*)*?)/(?!\.\.(?:/|$))[^/?#]*/\.\.(?=/|$)", "$1")
    path = F.regexp_replace(F.regexp_replace(path, r"^(?:/\.\.)+(?=/|$)", ""), r"^$", "/")
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(F.regexp_extract(base, r"^[A-Za-z][\w+.-]*:", 0), link))
        .when(F.startswith(link, F.lit("/")), F.concat(site, link))
        .when(F.startswith(link, F.lit("?")), F.concat(plain, link))
        .when(F.startswith(link, F.lit("#")), F.concat(F.regexp_extract(base, r"^[^#]*", 0), link))
        .otherwise(F.concat(site, path))
    )


def html_cards(pages: DataFrame, selectors: dict[str, str], portal: str, fetched_at, static: dict | None = None) -> DataFrame:
    """Listings from the cards of pages (url, html); links are resolved against the page's URL; no dates. Quotes that
    hold ``>`` end a tag early; elements that overlap others count by their own tags."""
    numbered = pages.select(F.xxhash64("url", "html").alias("page"), "url", "html").dropDuplicates(["page"])
    rows = card_fields(numbered.select("page", "html"), selectors).join(numbered.select("page", F.col("url").alias("base")), "page")
    rows = rows.withColumn("url", resolved(F.col("base"), F.col("href")))
    rows = rows.select(F.col("url").alias("source_id"), "title", "company", "location", "description", "url", F.lit(None).cast("timestamp").alias("posted_at"), item_order(F.col("page"), F.col("at")).alias("item_ord"))
    return build_listings(rows, portal, fetched_at, static)
