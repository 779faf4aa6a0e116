"""Text functions, Column to Column."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from listwright.functions.entities import decode_entities

# Letters, marks, digits and connectors, and the two signs that end names such as C# and C++.
NAME_CHARS = r"\p{L}\p{Mn}\p{Nd}\p{Pc}+#"

# --- fixed values -------------------------------------------------------------------------------------------------
LEGAL_FORMS = ("A/S", "ApS", "AS", "IVS", "K/S", "P/S", "GmbH", "AG", "SARL", "SAS", "SA", "NV", "BV", "Ltd", "LLC", "Inc", "Corp", "Oy", "AB", "Plc")
COMPANY_ALIASES = {"dr": "danmarks radio"}
REMOTE_OFFERS = ("og mulighed for hjemmearbejde", "og mulighed for fjernarbejde")
HYBRID_WORDS = ("hybrid",)
FULLY_REMOTE_WORDS = ("fully remote", "100% remote", "remote-only", "remote only", "work from home", "wfh", "fjernarbejde")
ONSITE_WORDS = ("onsite", "on-site", "in-office")
REMOTE_WORDS = ("remote",)
HYBRID_HINTS = ("hjemmearbejde", "hjemmefra")
SENIORITY_WORDS = {
    "junior": ("jr", "junior", "graduate", "intern"),
    "senior": ("sr", "senior"),
    "lead": ("lead", "principal", "staff"),
    "mid": ("mid", "intermediate"),
}
ENGINEERING_WORDS = ("engineer", "engineering", "developer", "architect", "programmer", "coder", "sre", "devops")
# titles outside engineering
OTHER_TITLES = (
    "product manager", "product owner", "product director", "product lead", "project manager", "account manager", "account executive",
    "account director", "account representative", "sales manager", "sales representative", "sales executive", "sales director", "sales lead",
    "sales specialist", "marketing manager", "marketing specialist", "marketing lead", "marketing analyst", "marketing director",
    "marketing coordinator", "marketing operations", "growth lead", "growth manager", "growth specialist", "growth hacker", "growth director",
    "content operations", "content specialist", "content writer", "content strategist", "content manager", "technical writer", "strategy lead",
    "strategy manager", "strategy director", "operations manager", "operations specialist", "operations analyst", "operations coordinator",
    "operations lead", "business analyst", "business consultant", "business partner", "business developer", "financial analyst",
    "financial controller", "financial specialist", "financial manager", "financial director", "financial advisor", "central finance",
    "data analyst", "fraud analyst", "fraud detection", "customer success", "customer support", "customer service", "customer experience",
    "talent acquisition", "human resources", "people operations", "people partner", "people manager", "people director", "qa manager", "qa lead",
    "qa analyst", "qa director", "quality manager", "quality lead", "quality analyst", "quality director", "executive assistant",
    "graphic designer", "compliance officer", "copywriter", "strategist", "controller", "accountant", "bookkeeper", "recruiter", "recruiting",
    "recruitment", "hr", "counsel", "attorney", "paralegal",
)
# ------------------------------------------------------------------------------------------------------------------


def blank(text: Column) -> Column:
    """Null, empty or white space only."""
    return text.isNull() | (F.trim(text) == "") | ~text.rlike(r"(?U)\S")


def collapse(text: Column) -> Column:
    """White space runs to one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalise(text: Column) -> Column:
    """Trimmed, lower-cased, white space collapsed; null to empty."""
    return F.coalesce(F.lower(collapse(text)), F.lit(""))


def _words(text: Column) -> Column:
    return F.split(normalise(text), " ")


def _without_last(words: Column) -> Column:
    return F.array_join(F.slice(words, 1, F.size(words) - 1), " ")


def normalise_company(company: Column) -> Column:
    """Normalised words without the last one if it is a legal form, known aliases replaced. A full stop after the form and
    a comma before it go with it."""
    words = _words(company)
    form = F.rtrim(F.element_at(words, -1), F.lit("."))
    is_form = (F.size(words) > 1) & form.isin(*[f.lower() for f in LEGAL_FORMS])
    plain = F.when(is_form, F.rtrim(_without_last(words), F.lit(", "))).otherwise(normalise(company))
    aliases = F.create_map(*[F.lit(x) for pair in COMPANY_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(aliases, plain), plain)


def normalise_location(location: Column) -> Column:
    """Normalised: without a closing phrase that offers work from home, up to the first comma, without a last word of one
    or two capitals, which names a district."""
    place = collapse(location)
    for offer in REMOTE_OFFERS:
        ends = F.endswith(F.lower(place), F.lit(f" {offer}"))
        place = F.when(ends, F.rtrim(F.substr(place, F.lit(1), F.length(place) - len(offer)))).otherwise(place)
    head = F.substring_index(place, ",", 1)
    place = collapse(F.when(head == "", place).otherwise(head))
    words = F.split(place, " ")
    last = F.element_at(words, -1)
    district = (F.size(words) > 1) & (F.length(last) <= 2) & last.rlike(r"^\p{Lu}+$")
    return normalise(F.when(district, _without_last(words)).otherwise(place))


def normalise_url(url: Column) -> Column:
    """Without fragment and trailing slashes of the path, lower-cased; the query stays. Default ports go."""
    plain = F.regexp_replace(F.lower(F.trim(url)), "#.*$", "")
    plain = F.regexp_replace(plain, r"^(http://[^/?]+):80(?=[/?]|$)", "$1")
    plain = F.regexp_replace(plain, r"^(https://[^/?]+):443(?=[/?]|$)", "$1")
    head = F.regexp_extract(plain, r"^([a-z][a-z0-9+.-]*://[^/?]*)([^?]*)(.*)$", 1)
    path = F.regexp_replace(F.regexp_extract(plain, r"^([a-z][a-z0-9+.-]*://[^/?]*)([^?]*)(.*)$", 2), "/+$", "")
    query = F.regexp_extract(plain, r"^([a-z][a-z0-9+.-]*://[^/?]*)([^?]*)(.*)$", 3)
    return F.when(head == "", plain).otherwise(F.concat(head, F.when(path == "", "/").otherwise(path), query))


def listing_key(title: Column, company: Column, location: Column) -> Column:
    return F.concat(normalise(title), F.lit("|"), normalise_company(company), F.lit("|"), normalise_location(location))


def strip_html(html: Column) -> Column:
    """Each tag to a space, stray ``>`` dropped, an unclosed ``<`` swallows the rest; character references decoded once;
    white space collapsed. Null to empty."""
    text = F.regexp_replace(F.regexp_replace(html, "<[^>]*(>|$)", " "), ">", "")
    return F.coalesce(collapse(decode_entities(text)), F.lit(""))


def keyword_pattern(keyword: str) -> str:
    """``keyword`` neither preceded nor followed by a letter, digit, connector, plus or hash."""
    return rf"(?i)(^|[^{NAME_CHARS}]){_quoted(keyword)}($|[^{NAME_CHARS}])"


def _quoted(keyword: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", keyword)


def spellings(keywords: Sequence[str]) -> dict[str, str]:
    """Lower-case terms and how they are spelled: of keywords equal but for case the first; blank ones go."""
    out: dict[str, str] = {}
    for k in keywords:
        if k and k.strip():
            out.setdefault(k.lower(), k)
    return out


def found_terms(keywords: Sequence[str], corpus: Column) -> Column:
    """The terms of ``keywords`` that ``corpus`` holds. It is cut into runs of name characters once, and terms of one run
    are looked up among them; of other terms a plain search goes before the pattern, which settles what stands around."""
    terms = list(spellings(keywords))
    if not terms:
        return F.array().cast("array<string>")
    single = re.compile(r"[\w+#]+")
    low = F.lower(corpus)
    runs = F.regexp_extract_all(low, F.lit(f"[{NAME_CHARS}]+"), F.lit(0))
    others = [k for k in terms if not single.fullmatch(k)]
    if others:
        runs = F.concat(runs, F.array(*[F.when(F.contains(low, F.lit(k)) & low.rlike(keyword_pattern(k)), F.lit(k)) for k in others]))
    return F.array_intersect(F.array(*map(F.lit, terms)), runs)


def spelled(keywords: Sequence[str], found: Column) -> Column:
    """Those of ``keywords`` whose terms are among ``found``, in order, as they are spelled."""
    known = spellings(keywords)
    if not known:
        return F.array().cast("array<string>")
    hits = F.array_intersect(F.array(*map(F.lit, known)), found)
    if all(term == k for term, k in known.items()):
        return hits
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.transform(hits, lambda t: F.element_at(table, t))


def keyword_hits(keywords: Sequence[str], corpus: Column) -> Column:
    """The keywords that ``corpus`` holds, in order; of those equal but for case, the first."""
    return F.coalesce(spelled(keywords, found_terms(keywords, corpus)), F.array().cast("array<string>"))


def contains_any(text: Column, words: Sequence[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def remote_mode(text: Column) -> Column:
    """onsite, hybrid, remote or unknown; the first rule that matches wins."""
    low = F.lower(F.coalesce(text, F.lit("")))
    rules = ((HYBRID_WORDS, "hybrid"), (FULLY_REMOTE_WORDS, "remote"), (ONSITE_WORDS, "onsite"), (REMOTE_WORDS, "remote"), (HYBRID_HINTS, "hybrid"))
    out = F
    for words, mode in rules:
        out = out.when(contains_any(low, words), mode)
    return out.otherwise("unknown")


def _seniority_in(text: Column) -> Column:
    low = F.lower(text)
    any_of = lambda words: low.rlike(rf"(?U)\b({'|'.join(words)})\b")
    # most texts name no level, which one look tells
    out = F.when(~any_of([w for words in SENIORITY_WORDS.values() for w in words]), None)
    for level, words in SENIORITY_WORDS.items():
        out = out.when(any_of(words), level)
    return out.otherwise(None)


def seniority(title: Column, description: Column) -> Column:
    """The level that the title names, else the description; null if neither does."""
    return F.coalesce(_seniority_in(title), _seniority_in(description))


def non_engineering_title(title: Column) -> Column:
    """The title names a post outside engineering and nothing within it. Its words, and pairs of words with nothing but
    white space between, are looked up; a sign between two words is a word of its own."""
    words = F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit(r"(?U)\w+|[^\w\s]"), F.lit(0))
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    among = lambda found, named: F.arrays_overlap(found, F.array(*[F.lit(x) for x in named]))
    return ~among(words, ENGINEERING_WORDS) & among(F.concat(words, pairs), OTHER_TITLES)


def contains_token(text: Column, token: str) -> Column:
    """``token`` with no letter or digit on either side; both lower-case."""
    if not token:
        return F.lit(False)
    return text.rlike(rf"(^|[^\p{{L}}\p{{Nd}}]){_quoted(token)}($|[^\p{{L}}\p{{Nd}}])")


def truncate(text: Column, length: int, mark: str = "…") -> Column:
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit(mark))).otherwise(text)


def slug(text: Column) -> Column:
    """Lower-case words joined by hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), "^-+|-+$", "")


def pretty(text: Column) -> Column:
    """A slug as a name."""
    return F.initcap(F.trim(F.regexp_replace(text, r"[-_]+", " ")))


def squeeze_document(text: Column, limit: int = 10_000) -> Column:
    """Blanks in a line to one, at most one empty line in a row, at most ``limit`` characters."""
    plain = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"[\t\f\x0B  ]+", " ")
    plain = F.trim(F.regexp_replace(F.regexp_replace(plain, " ?\n ?", "\n"), "\n{3,}", "\n\n"))
    return truncate(plain, limit, "\n[truncated]")


def fenced(text: Column) -> Column:
    """What a model's answer holds within a code fence, else all of it."""
    inner = F.regexp_extract(text, r"(?s)```[A-Za-z]*\s*(.*?)```", 1)
    return F.regexp_replace(F.when(inner == "", text).otherwise(inner), r"^\s+|\s+$", "")


def braces(text: Column) -> Column:
    """From the first opening to the last closing brace; null without."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.nullif(found, F.lit(""))


def split_trailing_company(title: Column) -> tuple[Column, Column]:
    """A title of the form "post, company", cut at the last comma; without one, the title and null."""
    pattern = r"(?s)^(.+), (.+)$"
    has = title.rlike(pattern)
    return (
        F.when(has, F.trim(F.regexp_extract(title, pattern, 1))).otherwise(title),
        F.when(has, F.trim(F.regexp_extract(title, pattern, 2))),
    )
