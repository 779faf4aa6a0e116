"""SQL for DuckDB that gives the rows of the queries, and the fixtures that both sides read."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from listwright.functions import text as T
from listwright.functions.entities import NAMED
from listwright.operators import score as S
from listwright.operators.history import EXAMPLE_CAPS
from listwright.operators.profile import Profile, Ranking
from listwright.plans.sample import COMPANY_TAILS, PLACE_TAILS, TITLE_HEADS
from listwright.sources.detect import BOARDS, PLATFORMS, SAME_BACKEND
from listwright.sources.pages import COUNTRY_CODES

NOW = "TIMESTAMP '2024-01-16 00:00:00'"


def q(s) -> str:
    return "NULL" if s is None else "'" + str(s).replace("'", "''") + "'" if isinstance(s, str) else str(s).lower() if isinstance(s, bool) else str(s)


def num(x) -> str:
    return f"{float(x)!r}::DOUBLE"


def values(rows, names: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(q(x) for x in r) + ')' for r in rows)}) v({names})"


def _case(number: str, choices) -> str:
    return f"CASE {number} " + " ".join(f"WHEN {i} THEN {q(c)}" for i, c in enumerate(choices)) + " ELSE '' END"


def collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def normalise(x: str) -> str:
    return f"coalesce(lower({collapse(x)}), '')"


def company_key(x: str) -> str:
    n, forms = normalise(x), ", ".join(q(f.lower()) for f in T.LEGAL_FORMS)
    last = f"rtrim(string_split({n}, ' ')[-1], '.')"
    plain = f"CASE WHEN contains({n}, ' ') AND {last} IN ({forms}) THEN rtrim(left({n}, length({n}) - length(string_split({n}, ' ')[-1])), ', ') ELSE {n} END"
    for alias, name in T.COMPANY_ALIASES.items():
        plain = f"CASE WHEN {plain} = {q(alias)} THEN {q(name)} ELSE {plain} END"
    return plain


def location_key(x: str) -> str:
    place = collapse(x)
    for offer in T.REMOTE_OFFERS:
        place = f"list_transform([{place}], lambda o: CASE WHEN suffix(lower(o), {q(' ' + offer)}) THEN rtrim(left(o, length(o) - {len(offer)})) ELSE o END)[1]"
    place = f"list_transform([{place}], lambda o: trim(CASE WHEN o[1] = ',' THEN o ELSE split_part(o, ',', 1) END))[1]"
    return normalise(rf"regexp_replace({place}, ' \p{{Lu}}{{1,2}}$', '')")


def remote_mode(x: str) -> str:
    rules = ((T.HYBRID_WORDS, "hybrid"), (T.FULLY_REMOTE_WORDS, "remote"), (T.ONSITE_WORDS, "onsite"), (T.REMOTE_WORDS, "remote"), (T.HYBRID_HINTS, "hybrid"))
    has = lambda words: " OR ".join(f"contains(lower({x}), {q(w)})" for w in words)
    return "CASE " + " ".join(f"WHEN {has(w)} THEN {q(m)}" for w, m in rules) + " ELSE 'unknown' END"


def seniority(title: str, description: str) -> str:
    one = lambda x: "CASE " + " ".join(rf"WHEN regexp_matches(lower({x}), '\b({"|".join(w)})\b') THEN {q(k)}" for k, w in T.SENIORITY_WORDS.items()) + " END"
    return f"coalesce({one(title)}, {one(description)})"


def off_title(x: str) -> str:
    engineering, other = "|".join(T.ENGINEERING_WORDS), "|".join(t.replace(" ", r"\s+") for t in T.OTHER_TITLES)
    return rf"(NOT regexp_matches({x}, '(?i)\b({engineering})\b') AND regexp_matches({x}, '(?i)\b({other})\b'))"


def hits(keywords, corpus: str) -> str:
    cases = ", ".join(f"CASE WHEN regexp_matches({corpus}, {q(T.keyword_pattern(k))}) THEN {q(k)} END" for k in keywords)
    return f"list_filter([{cases}]::VARCHAR[], lambda x: x IS NOT NULL)"


LISTINGS = f"""l0 AS MATERIALIZED (SELECT doc_id AS seq, source AS portal, text AS description, lang, trim(split_part(text, chr(10), 1)) AS line FROM documents),
l AS MATERIALIZED (SELECT l0.seq, portal, {_case("length(line) % 7", TITLE_HEADS)} || line AS title,
  s_name || {_case("s_suppkey % 4", COMPANY_TAILS)} AS company,
  n_name || ', ' || r_name || {_case("s_suppkey % 5", PLACE_TAILS)} AS location,
  description, 'https://' || lang || '.example.com/' || (l0.seq // 2) AS url, ts AS posted_at
 FROM l0 LEFT JOIN supplier ON s_suppkey = length(line) % (SELECT count(*) FROM supplier)
 LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN events ON event_id = l0.seq)"""
CORPUS = "coalesce(title, '') || chr(10) || coalesce(description, '')"
AGE = f"((epoch_us({NOW}) - epoch_us(posted_at)) / 864e8::DOUBLE)"


def keyword_hits_sql(p: Profile) -> str:
    return f"""WITH {LISTINGS}, h AS (SELECT seq, {hits(p.primary_stack, CORPUS)} AS a, {hits(p.secondary_stack, CORPUS)} AS b FROM l)
SELECT seq, array_to_string(a, '|') AS primary_hits, array_to_string(b, '|') AS secondary_hits, round(len(a) / {num(len(p.primary_stack))}, 6) AS primary_share FROM h"""


_words = "string_split(trim(split_part(text, chr(10), 1)), ' ')"
_capitals = f"translate({{}}, '{ascii_lowercase}', '{ascii_uppercase}')"
_declared = ", ".join(
    f"{{'kind': {q(kind)}, 'position': {i}, 'keyword': {k}}}"
    for kind, keywords in (("primary", ["w[1]", "w[2]", "f[3]", _capitals.format("w[5]"), _capitals.format("w[1]"), "' '"]), ("secondary", ["lower(c_mktsegment)", "w[6]"]))
    for i, k in enumerate(keywords)
)
# runs of name characters stand between two signs, so that a plain search finds whole runs only; every keyword here starts with one
_marked = lambda x: f"regexp_replace(lower({x}), '([{T.NAME_CHARS}]+)', chr(2) || '\\1' || chr(3), 'g')"
PROFILES_SQL = f"""WITH k AS MATERIALIZED (SELECT c_custkey AS profile_id, unnest([{_declared}], recursive := true) FROM (SELECT c_custkey, c_mktsegment, list_filter({_words}, lambda x: length(x) >= 8) AS w,
 list_filter(list_transform(list_zip({_words}, ({_words})[2:]), lambda z: z[1] || ' ' || z[2]), lambda x: length(split_part(x, ' ', 1)) >= 8) AS f FROM customer JOIN documents ON c_custkey = doc_id)),
n AS (SELECT profile_id, kind, count(*) AS declared FROM k GROUP BY ALL),
u AS (SELECT * FROM k WHERE trim(keyword) <> '' QUALIFY row_number() OVER (PARTITION BY profile_id, kind, lower(keyword) ORDER BY position) = 1),
t AS MATERIALIZED (SELECT doc_id, {_marked("text")} AS low FROM documents),
x AS MATERIALIZED (SELECT DISTINCT lower(keyword) AS term, {_marked("keyword")} AS mark FROM u),
f AS MATERIALIZED (SELECT doc_id, term FROM t, x WHERE contains(low, mark) AND (mark[-1] = chr(3) OR (length(low) - length(replace(low, mark, ''))) / length(mark) > (length(low) - length(replace(low, mark || chr(2), ''))) / (length(mark) + 1))),
m AS (SELECT doc_id, profile_id, kind, list(keyword ORDER BY position) AS hits FROM f JOIN u ON lower(keyword) = term GROUP BY ALL)
SELECT profile_id, kind, count(*) AS listings, sum(len(hits))::BIGINT AS hits, round(max(len(hits) / declared), 6) AS best, sum(doc_id * len(hits))::BIGINT AS checksum,
 md5(array_to_string(arg_max(hits, {{'n': len(hits), 'd': -doc_id}}), '|')) AS best_hits FROM m JOIN n USING (profile_id, kind) GROUP BY 1, 2"""
TITLES = [
    ("Senior Software Engineer", "hybrid role in Copenhagen"), ("Jr. Developer", "100% remote"), ("Product Manager", "on-site, three days"),
    ("Software Engineering Manager", ""), ("QA Lead", "junior and senior colleagues"), ("HR partner", "mulighed for hjemmearbejde"),
    ("Data Analyst", "work from home"), ("Principal Architect", "Remote"), ("Customer Success", "intermediate level"), ("Talent acquisition", "fjernarbejde"),
    ("Internal tools", "leading teams"), ("Compliance Officer", "mid-level"), ("financial analyst", "in-office"), ("Graphic Designer", ""),
]
TITLES_SQL = f"""WITH {LISTINGS}, b AS (SELECT seq, title, description FROM l UNION ALL SELECT * FROM {values([(-1 - i, t, x) for i, (t, x) in enumerate(TITLES)], "seq, title, description")})
SELECT seq, {seniority("title", "description")} AS seniority, {off_title("title")} AS off_title, {remote_mode("concat_ws(' ', title, description)")} AS remote_mode FROM b"""

MARKUP = [
    "K&oslash;benhavn &#248; &#xF8; &#XF8; &bogus; &oslash &;", "a&amp;lt;b &amp;amp; &lt;i&gt; &#38;amp;", "&#0065;&#x00041; &#1114112; &#xD800; &#x1F600;|&#128512;", "<p>R&D</p> A&&amp;B &#; &#x; &#12a;",
    "&Eacute;t&eacute;&nbsp;&nbsp;&euro;5 &AElig;&aelig;", "&apos;&quot;&#39; &Amp; &EACUTE;", None, "", "&", "x &copy", "<b>&lt;</b>b&gt", "&#9;&#10;&#160;&#8232;end", "&thetasym;&Dagger;&sup2;&frac12;",
]
_names = "MAP {" + ", ".join(f"{q(k)}: chr({ord(v)})" for k, v in NAMED.items()) + "}"
_number = "CASE WHEN regexp_matches(r, '^#[xX]') THEN ('0x' || r[3:])::BIGINT WHEN r[1] = '#' THEN r[2:]::BIGINT END"


def decoded(x: str) -> str:
    return f"""array_to_string(list_transform(string_split({x}, '&'), lambda p, i: CASE WHEN i = 1 THEN p ELSE list_transform([regexp_extract(p, '^(#0*[0-9]{{1,7}}|#[xX]0*[0-9a-fA-F]{{1,6}}|[A-Za-z][A-Za-z0-9]*);', 1)], lambda r:
 coalesce(CASE WHEN r = '' THEN NULL WHEN r[1] = '#' THEN CASE WHEN {_number} BETWEEN 55296 AND 57343 OR {_number} > 1114111 THEN NULL ELSE chr(({_number})::INTEGER) END ELSE ({_names})[r] END || p[length(r) + 2:], '&' || p))[1] END), '')"""


def shown(x: str) -> str:
    """The text of markup, white space of any kind collapsed."""
    plain = f"regexp_replace(regexp_replace({x}, '<[^>]*(>|$)', ' ', 'g'), '>', '', 'g')"
    return rf"trim(regexp_replace({decoded(plain)}, '[\s\x0B\x{{85}}\p{{Z}}]+', ' ', 'g'))"


HTML_SQL = f"""WITH b AS (SELECT page_id, html FROM pages UNION ALL SELECT * FROM {values([(-1 - i, m) for i, m in enumerate(MARKUP)], "page_id, html")})
SELECT page_id, coalesce({shown("html")}, '') AS text FROM b"""

URLS = ["HTTPS://Example.com/A/b/?Q=1#frag", "http://example.com:80/x//", "https://example.com:443", "https://example.com/", "https://example.com:8443/a/", "https://example.com?x=/"]
_u = "regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '#.*$', ''), '^(http://[^/?]+):80([/?]|$)', '\\1\\2'), '^(https://[^/?]+):443([/?]|$)', '\\1\\2')"
_parts = "'^([a-z][a-z0-9+.-]*://[^/?]*)([^?]*)(.*)$'"
URL_SQL = f"""WITH b AS (SELECT page_id, url FROM pages UNION ALL SELECT * FROM {values([(-1 - i, u) for i, u in enumerate(URLS)], "page_id, url")}),
u AS (SELECT page_id, {_u} AS u FROM b), s AS (SELECT page_id, u, regexp_extract(u, {_parts}, 1) AS head, rtrim(regexp_extract(u, {_parts}, 2), '/') AS path, regexp_extract(u, {_parts}, 3) AS query FROM u)
SELECT page_id, CASE WHEN head = '' THEN u ELSE head || CASE WHEN path = '' THEN '/' ELSE path END || query END AS url_key FROM s"""

ENDPOINTS = [
    "https://jobs.ashbyhq.com/acme", "https://boards.greenhouse.io/acme", "https://acme.wd3.myworkdayjobs.com/x", "https://careers.smartrecruiters.com/Acme",
    "https://acme.teamtailor.com/jobs", "https://candidate.hr-manager.net/list.aspx?cid=1", "https://www.jobindex.dk/jobsoegning/", "https://it-jobbank.dk/jobsoegning",
    "https://jobs.lever.co/acme", "https://www.example.org/feed", "not a url", "", "https://jobindex.dk/jobsoegning",
]
_host = r"lower(coalesce(regexp_extract(trim(url), '^(?i)([a-z][a-z0-9+.-]*)://([^@/?#]*@)?([^/?#:]*)', 3), ''))"
_bare = f"regexp_replace({_host}, '^www\\.', '')"
_path = r"coalesce(regexp_extract(trim(url), '^(?i)([a-z][a-z0-9+.-]*)://([^@/?#]*@)?([^/?#:]*)(:\d+)?([^?#]*)', 5), '')"
_backend = "CASE h " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in SAME_BACKEND.items()) + " ELSE h END"
_label = "CASE WHEN b = '' THEN '' " + " ".join(f"WHEN {'contains' if how == 'contains' else 'ends_with'}(b, {q(n)}) THEN {q(lab)}" for how, n, lab in PLATFORMS) + " ELSE b END"
PLATFORM_SQL = f"""WITH a AS (SELECT page_id, url FROM pages UNION ALL SELECT * FROM {values([(-1 - i, u) for i, u in enumerate(ENDPOINTS)], "page_id, url")}),
k AS (SELECT page_id, {_host} AS h, {_bare} AS b, {_path} AS p FROM a)
SELECT page_id, {_label} AS label, {_backend} || lower(rtrim(p, '/')) AS endpoint_key FROM k"""

COMPANIES = [
    ("Sopra Steria A/S", "København K og mulighed for hjemmearbejde"), ("Sopra Steria ApS", "Herlev og mulighed for fjernarbejde"), ("Danske Spil A/S", "København, , Denmark"),
    ("ACME GmbH", "København Ø"), ("Acme, Inc.", "New York, NY"), ("DR", ""), ("DR A/S", None), (None, ", Denmark"), ("", "  Aarhus   C "),
]
COMPANY_SQL = f"""WITH {LISTINGS}, b AS (SELECT DISTINCT company, location FROM l UNION ALL SELECT * FROM {values(COMPANIES, "company, location")})
SELECT company, location, {company_key("company")} AS company_key, {location_key("location")} AS location_key FROM b"""

FRESHNESS_SQL = f"""WITH {LISTINGS}, a AS (SELECT seq, {AGE} AS age FROM l)
SELECT seq, round(age, 6) AS age_days, round(coalesce(exp(-greatest(age, 0::DOUBLE) / {num(14)}), 0.5::DOUBLE), 6) AS freshness, round_even(age, 0)::BIGINT AS age_rounded, coalesce(age <= 14, false) AS fresh FROM a"""

VERDICTS = [
    '{"score": 0.8, "reason": "fits"}', '```json\n{"score": 0.25, "reason": "far"}\n```', '{"score": 1.7, "reason": "great"}', '{"score": -1}',
    'I think {"score": 0.5, "reason": "so so"} is fair', "no idea", "", '{"reason": "none"}', '{"score": 0.4, "reason": 7}',
]


def verdict_sql() -> str:
    doc = "to_json({'score': (doc_id % 13) / 8.0::DOUBLE - 0.25, 'reason': text})::VARCHAR"
    plain = """'{"score": 0.' || (doc_id % 10) || ', "reason": "' || translate(text, '"}', '') || '"}'"""
    shapes = [doc, f"'```json' || chr(10) || {doc} || chr(10) || '```'", f"'I think ' || {plain} || ' is fair'", "text", "to_json({'reason': text})::VARCHAR", """'{"score": ' || (doc_id % 3) || ', "reason": 7}'"""]
    cases = " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(shapes))
    loose = r"""'(?s)\{[^}]*"score"\s*:\s*([0-9.]+)[^}]*"reason"\s*:\s*"([^"]*)"[^}]*\}'"""
    return rf"""WITH a AS (SELECT doc_id AS id, CASE doc_id % {len(shapes)} {cases} END AS raw FROM documents UNION ALL SELECT * FROM {values([(-1 - i, v) for i, v in enumerate(VERDICTS)], "id, raw")}),
b AS (SELECT id, regexp_replace(coalesce(nullif(regexp_extract(trim(raw), '(?s)```[A-Za-z]*\s*(.*?)```', 1), ''), trim(raw)), '^\s+|\s+$', '', 'g') AS body FROM a),
j AS (SELECT *, CASE WHEN json_valid(body) THEN body END AS doc FROM b),
s AS (SELECT *, TRY_CAST(json_extract_string(doc, '$.score') AS DOUBLE) AS strict, TRY_CAST(nullif(regexp_extract(body, {loose}, 1), '') AS DOUBLE) AS found FROM j)
SELECT id, CASE WHEN coalesce(strict, found) IS NOT NULL THEN round(greatest(0, least(1, coalesce(strict, found))), 6) END AS score, md5(CASE WHEN strict IS NOT NULL THEN CASE WHEN json_type(doc, '$.reason') = 'VARCHAR' THEN json_extract_string(doc, '$.reason') ELSE '' END WHEN found IS NOT NULL THEN regexp_extract(body, {loose}, 2) END) AS reason FROM s"""


ANSWERS = [
    '{"name": " Ann ", "location": "Berlin", "experienceYears": 7.5, "seniority": "Senior", "primaryStack": ["C#", " ", "Go"], "languages": "English"}',
    'Here: ```json\n{"name": "", "experienceYears": 99, "seniority": "boss", "primaryStack": "Rust", "languages": [1, "da"]}\n```',
    'text {"location": "Oslo", "experienceYears": "5"} text', "[1]", "", "{broken",
]
def profile_answer_sql() -> str:
    doc = "to_json({'name': split_part(text, chr(10), 1), 'location': ' ' || lang, 'experienceYears': (doc_id % 130) / 2.0::DOUBLE, 'seniority': ['Senior', 'lead', 'boss'][doc_id % 3 + 1], 'primaryStack': [source, ' ', lang], 'languages': lang})::VARCHAR"
    shapes = [doc, f"'Here:' || chr(10) || '```json' || chr(10) || {doc} || chr(10) || '```' || chr(10)", f"'It says ' || {doc} || ' so far'", f"'[' || {doc} || ']'", "text", "to_json({'experienceYears': doc_id::VARCHAR, 'name': 7, 'languages': [doc_id]})::VARCHAR"]
    cases = " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(shapes))
    text = lambda n: f"nullif(trim(CASE WHEN json_type(doc, '$.{n}') = 'VARCHAR' THEN json_extract_string(doc, '$.{n}') END), '')"
    many = lambda n: f"CASE WHEN doc IS NOT NULL THEN array_to_string(list_filter(CASE json_type(doc, '$.{n}') WHEN 'ARRAY' THEN list_transform(json_extract(doc, '$.{n}[*]'), lambda v: CASE WHEN json_type(v) = 'VARCHAR' THEN trim(v->>'$') END) WHEN 'VARCHAR' THEN [{text(n)}] END, lambda v: v <> ''), '|') END"
    years = "TRY_CAST(json_extract(doc, '$.experienceYears') AS DOUBLE)"
    return rf"""WITH a AS (SELECT doc_id AS id, CASE doc_id % {len(shapes)} {cases} END AS raw FROM documents UNION ALL SELECT * FROM {values([(-1 - i, v) for i, v in enumerate(ANSWERS)], "id, raw")}),
b AS (SELECT id, regexp_replace(coalesce(nullif(regexp_extract(trim(raw), '(?s)```[A-Za-z]*\s*(.*?)```', 1), ''), trim(raw)), '^\s+|\s+$', '', 'g') AS body FROM a),
c AS (SELECT id, CASE WHEN json_valid(body) THEN body WHEN json_valid(regexp_extract(body, '(?s)\{{.*\}}', 0)) THEN regexp_extract(body, '(?s)\{{.*\}}', 0) END AS found FROM b),
p AS (SELECT id, CASE WHEN json_type(found) = 'OBJECT' THEN found END AS doc FROM c)
SELECT id, md5({text("name")}) AS name, {text("location")} AS location, CASE WHEN json_type(doc, '$.experienceYears') NOT IN ('VARCHAR', 'BOOLEAN') AND {years} BETWEEN 0 AND 60 THEN round_even({years}, 0)::BIGINT END AS years,
 CASE WHEN lower({text("seniority")}) IN ('junior', 'mid', 'senior', 'lead', 'any') THEN lower({text("seniority")}) END AS seniority, coalesce({many("primaryStack")}, CASE WHEN doc IS NOT NULL THEN '' END) AS primary_stack, coalesce({many("languages")}, CASE WHEN doc IS NOT NULL THEN '' END) AS languages FROM p"""


DETECT = [
    "https://boards.greenhouse.io/acme-labs", "https://jobs.ashbyhq.com/Acme", "https://jobs.lever.co/acme2", "https://careers.smartrecruiters.com/AcmeCorp", "https://acme.teamtailor.com/",
    "https://candidate.hr-manager.net/vacancies/list.aspx?cid=1234", "https://www.example.org/feed/jobs", "https://example.org/", "https://example.org/jobs.rss",
]
ADDRESSES = (
    "https://boards.greenhouse.io/NAME", "https://jobs.ashbyhq.com/NAME/x", "https://jobs.lever.co//NAME?a=b", "https://careers.smartrecruiters.com/NAME", "https://NAME.teamtailor.com/jobs",
    "https://candidate.hr-manager.net/vacancies/list.aspx?customer=NAME", "https://NAME.example.org/feed/jobs", "http://www.NAME.example/jobs.RSS?x", "https://jobs.lever.co/", "NAME", "https://NAME.example/",
)
_host, _path = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1))", "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_boards = " ".join(f"WHEN h IN ({', '.join(map(q, hosts))}) AND f <> '' THEN [{q(kind)}, {q(kind)} || '-' || lower(f), {q(endpoint.split('{slug}')[0])} || f || {q(endpoint.split('{slug}')[1])}]" for hosts, kind, endpoint, _ in BOARDS)
DETECT_SQL = rf"""WITH p AS (SELECT page_id AS id, url FROM pages UNION ALL SELECT page_id + 1000000000000, replace(CASE page_id % {len(ADDRESSES)} {" ".join(f"WHEN {i} THEN {q(a)}" for i, a in enumerate(ADDRESSES))} END, 'NAME', regexp_extract(url, '^[a-z]+://(?:[a-z]+\.)?([a-z-]+)\.example', 1) || '-' || to_hex(page_id)) FROM pages
 UNION ALL SELECT * FROM {values([(-1 - i, u) for i, u in enumerate(DETECT)], "id, url")}),
h AS (SELECT id, url, {_host} AS h, {_path} AS p, regexp_extract({_path}, '^/+([^/]+)', 1) AS f FROM p),
d AS (SELECT id, CASE {_boards} WHEN suffix(h, '.teamtailor.com') AND h <> 'www.teamtailor.com' THEN ['teamtailor', 'teamtailor-' || left(h, length(h) - 15), 'https://' || h || '/sitemap.xml']
 WHEN h = 'candidate.hr-manager.net' AND contains(lower(p), 'list.aspx') AND contains(url, '?') THEN ['hrmanager', 'hr-manager-' || lower(coalesce(nullif(regexp_extract(url, '[?&](?:cid|customer)=([^&#]+)', 1), ''), 'source')), url]
 WHEN regexp_matches(lower(p), '(\.(rss|atom|xml)$)|/rss|/feed') AND h <> '' THEN ['rss', 'rss-' || trim(regexp_replace(h, '[^a-z0-9]+', '-', 'g'), '-'), url] END AS s FROM h)
SELECT id, s[1] AS kind, s[2] AS name, s[3] AS endpoint FROM d"""

_codes = [*COUNTRY_CODES, "zz", "dk "]
_expand = "CASE upper(trim(code)) " + " ".join(f"WHEN {q(c)} THEN {q(n)}" for c, n in COUNTRY_CODES.items()) + " ELSE code END"
COUNTRY_SQL = f"WITH k AS (SELECT n_nationkey, [{', '.join(q(c) for c in _codes)}][n_nationkey % {len(_codes)} + 1] AS code FROM nation) SELECT n_nationkey, code, {_expand} AS country FROM k"


# --- scoring ------------------------------------------------------------------------------------------------------
def token(x: str, t: str) -> str:
    return rf"regexp_matches({x}, {q(rf'(^|[^\p{{L}}\p{{Nd}}]){T._quoted(t)}($|[^\p{{L}}\p{{Nd}}])')})"


def _any_token(x: str, names) -> str:
    return "(" + " OR ".join(token(x, n) for n in names) + ")"


def _tiers(p: Profile, r: Ranking) -> list[tuple[str, float, bool]]:
    low = "lower(location)"
    city, last = p.city_and_country()
    rules = [("(" + " OR ".join(f"contains({low}, {q(w)})" for w in S.WORLDWIDE) + ")", r.tiers.city, True)]
    rules += [(_any_token(low, S.place_names(city)), r.tiers.city, True)] if city else []
    rules += [(_any_token(low, S.place_names(m)), r.tiers.metro, True) for m in p.metro]
    country = p.country or last
    rules += [(token(low, country.lower()), r.tiers.country, False)] if country else []
    rules += [(token(low, p.region.lower()), r.tiers.region, False)] if p.region else []
    return rules


def tier(p: Profile, r: Ranking) -> str:
    return "CASE WHEN location IS NULL OR trim(location) = '' THEN NULL " + " ".join(f"WHEN {c} THEN {num(w)}" for c, w, _ in _tiers(p, r)) + f" ELSE {num(r.tiers.other)} END"


def place_match(p: Profile, r: Ranking) -> str:
    return "CASE WHEN location IS NULL OR trim(location) = '' THEN NULL " + " ".join(f"WHEN {c} THEN {q(m)}" for c, _, m in _tiers(p, r)) + " ELSE false END"


def fit(p: Profile) -> str:
    half = {"hybrid": "remote", "remote": "hybrid", "onsite": "hybrid"}[p.remote_preference]
    return f"CASE WHEN remote_mode = {q(p.remote_preference)} THEN {num(1)} WHEN remote_mode = {q(half)} THEN {num(0.5)} ELSE {num(0)} END"


def _both(r: Ranking) -> str:
    return f"CASE WHEN tier IS NULL THEN fit WHEN remote_mode = 'unknown' THEN tier WHEN remote_mode = 'remote' THEN fit * CASE WHEN tier >= {num(r.tiers.region)} THEN {num(1)} ELSE tier END ELSE fit * tier END"


def scored(p: Profile, r: Ranking) -> str:
    """CTEs down to ``sc``: a row a listing with all parts of its score."""
    at = S.LEVELS.index(p.seniority)
    near = ", ".join(q(S.LEVELS[i]) for i in (at - 1, at + 1) if 0 <= i < len(S.LEVELS))
    head = "coalesce(title, '') || chr(10) || coalesce(company, '')"
    w = r.weights
    share = lambda h, n: f"len({h}) / {num(n)}"
    listed = lambda start, h: f"{q(start)} || array_to_string({h}, ', ') || '.'"
    return f"""{LISTINGS},
f AS MATERIALIZED (SELECT *, {remote_mode("concat_ws(' ', title, description, location)")} AS remote_mode, {hits(p.primary_stack, CORPUS)} AS ph, {hits(p.secondary_stack, CORPUS)} AS sh,
  {hits(p.domains, CORPUS)} AS dh, {hits(p.disqualifiers, head)} AS bh, {hits(p.preferred_companies, "coalesce(company, '')")} AS ch,
  {seniority("title", "description")} AS level, {off_title("coalesce(title, '')")} AS off_title, {AGE} AS age FROM l),
g AS (SELECT *, {tier(p, r)} AS tier, {place_match(p, r)} AS place_match, {fit(p)} AS fit,
  CASE WHEN remote_mode <> 'unknown' THEN remote_mode = {q(p.remote_preference)} END AS remote_match,
  coalesce(level IN ({near}), false) AS adjacent FROM f),
h AS (SELECT *, {share("ph", len(p.primary_stack))} * {num(w.primary_stack)} AS primary_stack, {share("sh", len(p.secondary_stack))} * {num(w.secondary_stack)} AS secondary_stack,
  (CASE WHEN level IS NULL THEN {num(0.5)} WHEN level = {q(p.seniority)} THEN {num(1)} WHEN adjacent THEN {num(r.adjacency_credit)} ELSE {num(0)} END) * {num(w.seniority)} AS seniority,
  ({_both(r)}) AS place_score, ({_both(r)}) * {num(w.location_remote)} AS location_remote, {share("dh", len(p.domains))} * {num(w.domain)} AS domain,
  coalesce(exp(-greatest(age, 0::DOUBLE) / {num(r.freshness_days)}), 0.5::DOUBLE) * {num(w.freshness)} AS freshness,
  CASE WHEN level IS NOT NULL THEN level = {q(p.seniority)} OR adjacent END AS level_match FROM g),
i AS (SELECT *, primary_stack + secondary_stack + seniority + location_remote + domain + freshness AS s0 FROM h),
j AS (SELECT *, CASE WHEN len(bh) > 0 THEN s0 * {num(r.disqualifier_penalty)} ELSE s0 END AS s1 FROM i),
k AS (SELECT *, CASE WHEN off_title THEN s1 * {num(r.non_engineering_multiplier)} ELSE s1 END AS s2 FROM j),
m AS (SELECT *, CASE WHEN len(ch) > 0 THEN least(s2 * {num(r.preferred_boost)}, {num(1)}) ELSE s2 END AS s3 FROM k),
sc AS MATERIALIZED (SELECT *, s1 - s0 + 0.0::DOUBLE AS disqualifier_penalty, s2 - s1 + 0.0::DOUBLE AS non_engineering_title_penalty, s3 - s2 + 0.0::DOUBLE AS preferred_company_bonus,
  round(least(greatest(s3, {num(0)}), {num(1)}), 6) AS score,
  CASE WHEN len(bh) > 0 THEN {listed("Removed because of: ", "bh")} ELSE concat_ws(' ',
    CASE WHEN len(ph) > 0 THEN {listed("Must-have skill match: ", "ph")} ELSE 'None of your must-have skills mentioned.' END,
    CASE WHEN len(sh) > 0 THEN {listed("Also matches: ", "sh")} END, CASE WHEN len(dh) > 0 THEN {listed("Industry: ", "dh")} END,
    CASE WHEN level_match IS NULL THEN 'Experience level not stated.' WHEN NOT level_match THEN 'Experience level doesn''t match.' WHEN adjacent THEN 'Experience level close fit.' ELSE 'Experience level matches.' END,
    CASE WHEN off_title AND {q(r.non_engineering_multiplier < 1)} THEN 'Title doesn''t look like a developer role — rating reduced.' END,
    CASE WHEN place_match THEN 'Location: ' || location || '.' WHEN remote_match THEN 'Remote work OK (' || remote_mode || ').'
      WHEN place_match IS NULL AND remote_match IS NULL THEN 'Location and remote setup not stated.' WHEN remote_match IS NULL THEN 'Location doesn''t match; remote setup not stated.'
      WHEN place_match IS NULL THEN 'Location not stated; remote setup doesn''t match.' ELSE 'Neither location nor remote setup matches.' END,
    CASE WHEN greatest(age, 0::DOUBLE) > {num(2 * r.freshness_days)} THEN 'Posted ' || round_even(greatest(age, 0::DOUBLE), 0)::BIGINT || ' days ago — rating reduced for age.' END) END AS notes FROM m)"""


def location_sql(p: Profile, r: Ranking) -> str:
    return f"WITH {scored(p, r)} SELECT seq, remote_mode, round(tier, 6) AS tier, place_match, round(fit, 6) AS fit, remote_match, round(place_score, 6) AS location_remote FROM sc"


def breakdown_sql(p: Profile, r: Ranking) -> str:
    return f"WITH {scored(p, r)} SELECT seq, score, {', '.join(f'round({c} + 0.0::DOUBLE, 6) AS {c}' for c in S.COMPONENTS)}, notes FROM sc"


def unpivot_sql(p: Profile, r: Ranking) -> str:
    parts = " UNION ALL ".join(f"SELECT seq, {i}::BIGINT AS position, {q(c)} AS component, round({c} + 0.0::DOUBLE, 6) AS value FROM sc" for i, c in enumerate(S.COMPONENTS))
    return f"WITH {scored(p, r)} {parts}"


def shares_sql(p: Profile, r: Ranking) -> str:
    total = "greatest(" + " + ".join(f"greatest({c}, 0::DOUBLE)" for c in S.COMPONENTS) + ", 0.001::DOUBLE)"
    parts = " UNION ALL ".join(f"SELECT seq, {q(c)} AS component, round(greatest({c}, 0::DOUBLE) / {total} * 100 + 0.0::DOUBLE, 4) AS percent FROM sc" for c in S.COMPONENTS)
    return f"WITH {scored(p, r)} {parts}"


# --- dedupe, drops, shortlist -------------------------------------------------------------------------------------
def _dedupe(rounds: int = 9) -> str:
    out = f"{LISTINGS}, keyed AS MATERIALIZED (SELECT seq, lower(url) AS k1, {normalise('title')} || '|' || {company_key('company')} || '|' || {location_key('location')} AS k2 FROM l), u0 AS MATERIALIZED (SELECT * FROM keyed)"
    for i in range(rounds):
        out += f""",
a{i} AS MATERIALIZED (SELECT seq, k1, k2 FROM (SELECT *, min(seq) OVER (PARTITION BY k1) AS f1, min(seq) OVER (PARTITION BY k2) AS f2 FROM u{i}) WHERE seq = f1 AND seq = f2),
u{i + 1} AS MATERIALIZED (SELECT * FROM u{i} WHERE k1 NOT IN (SELECT k1 FROM a{i}) AND k2 NOT IN (SELECT k2 FROM a{i}))"""
    kept = " UNION ALL ".join(f"SELECT * FROM a{i}" for i in range(rounds))
    return out + f""", kept AS MATERIALIZED ({kept}),
canon AS (SELECT keyed.seq, CASE WHEN x.seq <= keyed.seq THEN x.seq ELSE y.seq END AS canonical FROM keyed LEFT JOIN kept x ON keyed.k1 = x.k1 LEFT JOIN kept y ON keyed.k2 = y.k2)"""


DEDUPE_SQL = f"WITH {_dedupe()} SELECT seq, canonical FROM canon"
MERGES_SQL = f"WITH {_dedupe()} SELECT canonical, string_agg(seq::VARCHAR, ',' ORDER BY seq) AS merged FROM canon WHERE seq <> canonical GROUP BY 1"


def classified(p: Profile, r: Ranking) -> str:
    rules = [
        (f"coalesce(age > {r.max_age_days}, false)", "above_max_age", f"'posted ' || round_even(age, 0)::BIGINT || ' days ago, max {r.max_age_days}'"),
        ("len(ph) = 0", "missing_required_primary", "'no primary-stack keyword matched in title or description'"),
        ("len(bh) > 0", "disqualifier", "'matched disqualifier: ' || array_to_string(bh, ', ')"),
        (f"score < {num(r.min_score)}", "below_min_score", f"printf('score %.2f below threshold {r.min_score:.2f}', score)"),
    ]
    reason = " ".join(f"WHEN {c} THEN {q(n)}" for c, n, _ in rules)
    context = " ".join(f"WHEN {c} THEN {t}" for c, _, t in rules)
    return f"{scored(p, r)}, cl AS MATERIALIZED (SELECT *, CASE {reason} END AS drop_reason, CASE {context} END AS drop_context FROM sc), rk AS (SELECT *, row_number() OVER (ORDER BY score DESC, seq) AS rank, count(*) OVER () AS passed FROM cl WHERE drop_reason IS NULL)"


def drops_sql(p: Profile, r: Ranking) -> str:
    return f"WITH {classified(p, r)} SELECT seq, score, drop_reason, drop_context FROM cl"


def drop_counts_sql(p: Profile, r: Ranking) -> str:
    return f"WITH {classified(p, r)} SELECT drop_reason, count(*) AS n FROM (SELECT drop_reason FROM cl WHERE drop_reason IS NOT NULL UNION ALL SELECT 'beyond_top_n' FROM rk WHERE rank > {r.top_n}) GROUP BY 1"


def shortlist_sql(p: Profile, r: Ranking) -> str:
    return f"WITH {classified(p, r)} SELECT seq, title, company, location, score FROM rk WHERE rank <= {r.top_n}"


def beyond_sql(p: Profile, r: Ranking) -> str:
    return f"WITH {classified(p, r)} SELECT seq, rank, 'beyond_top_n' AS drop_reason, 'rank ' || rank || ' of ' || passed || ' (top {r.top_n} taken)' AS drop_context FROM rk WHERE rank > {r.top_n}"


def strict_sql(p: Profile, r: Ranking) -> str:
    return f"WITH {scored(p, r)} SELECT seq, score FROM sc WHERE coalesce(age <= {r.max_age_days}, true) AND len(ph) > 0 AND score >= {num(r.min_score)} ORDER BY score DESC, seq LIMIT {r.top_n}"


def blend_sql(p: Profile, r: Ranking) -> str:
    v = "quality * 0.9::DOUBLE - toxic * 0.3::DOUBLE"
    return f"""WITH {scored(p, r)}, b AS (SELECT seq, score, notes, {v} AS v, toxic FROM sc LEFT JOIN labels ON doc_id = seq)
SELECT seq, round(CASE WHEN v IS NULL THEN score ELSE least(greatest(v * {num(0.4)} + score * (1 - {num(0.4)}), {num(0)}), {num(1)}) END, 6) AS score,
 CASE WHEN v IS NOT NULL AND toxic = 1 THEN notes || ' AI review: ' || printf('%.2f', v) || ' — rude' ELSE notes END AS notes FROM b"""


def longlist_sql(p: Profile, r: Ranking) -> str:
    return f"""WITH {scored(p, r)} SELECT seq AS listing_id, title, company, score FROM sc WHERE contains(lower(title || ' ' || coalesce(company, '')), 'supplier')
AND len(list_filter(list_concat(ph, sh), lambda x: lower(x) IN ('the', 'der'))) > 0 AND coalesce(age <= 14, false) AND score BETWEEN {num(0.2)} AND {num(0.9)} AND seq NOT IN (SELECT doc_id FROM labels)"""


def longlist_marked_sql(p: Profile, r: Ranking) -> str:
    return f"WITH {scored(p, r)} SELECT seq AS listing_id, portal, score FROM sc WHERE portal IN ('src0', 'src1', 'src2') AND seq IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0)"


def stack_facet_sql(p: Profile) -> str:
    return f"WITH {LISTINGS}, h AS (SELECT unnest(list_concat({hits(p.primary_stack, CORPUS)}, {hits(p.secondary_stack, CORPUS)})) AS hit FROM l) SELECT hit, count(*) AS n FROM h GROUP BY 1"


# --- marks, history, sources --------------------------------------------------------------------------------------
MARKS = """mk AS MATERIALIZED (SELECT 'run-' || r AS run_id, doc_id AS listing_id, CASE WHEN (doc_id + r) % 4 > 0 THEN CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'bad' END END AS mark,
 CASE WHEN toxic = 1 THEN 'rude' END AS reason, CASE (doc_id + r) % 6 WHEN 0 THEN 'applied' WHEN 1 THEN 'interview' WHEN 2 THEN 'offer' WHEN 3 THEN 'rejected' END AS status
 FROM (SELECT *, unnest([doc_id % 3, doc_id % 3 + 1]) AS r FROM labels))"""
RUN_ROWS = """rr AS MATERIALIZED (SELECT 'run-' || r AS run_id, doc_id AS listing_id, 'Listing ' || (doc_id % 50) AS title, 'Company ' || (doc_id % 7) AS company, CASE WHEN doc_id % 5 > 0 THEN lang END AS location,
 source AS portal, ((n_chars + r) % 1000) / 1000.0::DOUBLE AS score, doc_id % 4 <> r OR doc_id % 8 < 4 AS has FROM documents, (VALUES (0), (1), (2), (3)) v(r)),
res AS MATERIALIZED (SELECT mk.*, title, company, location, portal, score FROM mk JOIN rr USING (run_id, listing_id) WHERE has)"""

MARKS_SQL = f"""WITH {MARKS}, ch AS (SELECT 'run-' || (doc_id % 3) AS run_id, doc_id AS listing_id, CASE WHEN doc_id % 5 = 0 THEN 'bad' END AS mark, CASE WHEN doc_id % 2 = 0 THEN 'changed' END AS reason,
 CASE WHEN doc_id % 7 = 0 THEN 'offer' END AS status, doc_id % 3 < 2 AS sets_mark, doc_id % 4 < 2 AS sets_status FROM labels),
m AS (SELECT run_id, listing_id, CASE WHEN sets_mark THEN ch.mark ELSE mk.mark END AS mark, CASE WHEN sets_mark THEN CASE WHEN ch.mark IS NOT NULL THEN ch.reason END ELSE mk.reason END AS reason,
 CASE WHEN sets_status THEN ch.status ELSE mk.status END AS status FROM mk FULL OUTER JOIN ch USING (run_id, listing_id)) SELECT * FROM m WHERE mark IS NOT NULL OR status IS NOT NULL"""

_newest = "row_number() OVER (PARTITION BY listing_id ORDER BY run_id DESC)"
APPLICATIONS_SQL = f"WITH {MARKS}, {RUN_ROWS} SELECT run_id, listing_id, mark, status, title, company, location, portal, score FROM (SELECT *, {_newest} AS n FROM res WHERE status IS NOT NULL) WHERE n = 1"

EXAMPLES_SQL = f"""WITH {MARKS}, {RUN_ROWS}, p AS (SELECT *, CASE WHEN mark = 'good' THEN 'liked' WHEN mark = 'bad' THEN 'disliked' WHEN status IN ('interview', 'offer') THEN 'liked' END AS polarity FROM res),
e AS (SELECT *, CASE WHEN polarity = 'liked' AND status IN ('interview', 'offer') THEN concat_ws(' — ', reason, CASE WHEN status = 'offer' THEN 'received an offer' ELSE 'reached interview' END) ELSE reason END AS note,
 CASE WHEN mark = 'bad' THEN 0 WHEN status = 'offer' THEN 2 WHEN status = 'interview' THEN 1 ELSE 0 END AS priority,
 row_number() OVER (PARTITION BY lower(title || '|' || company) ORDER BY run_id DESC, listing_id) AS n FROM p WHERE polarity IS NOT NULL)
SELECT run_id, listing_id, polarity, title, company, note, priority::BIGINT AS priority FROM e WHERE n = 1 ORDER BY priority DESC, run_id DESC, listing_id LIMIT 12"""

_caps = "CASE polarity " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in EXAMPLE_CAPS.items()) + " END"
FEW_SHOT_SQL = f"""WITH e AS (SELECT doc_id AS seq, CASE WHEN quality = 1 THEN 'liked' ELSE 'disliked' END AS polarity, '  - ' || source || ' — T' || doc_id || ' (' || coalesce(nullif(lang, 'en'), '?') || '; ' || lang || '/' || source || ')' AS line,
 CASE WHEN toxic = 1 THEN 'rude' END AS note FROM labels JOIN documents USING (doc_id)),
p AS (SELECT *, row_number() OVER (PARTITION BY polarity ORDER BY note IS NULL, seq) AS place FROM e)
SELECT polarity, string_agg(line || coalesce(' — why: ' || note, ''), chr(10) ORDER BY place) AS block FROM p WHERE place <= {_caps} GROUP BY 1"""

RUN_LIST_SQL = f"""WITH {MARKS}, r AS (SELECT 'run-' || o_orderkey AS run_id, o_orderdate AS started_at, o_custkey % 100 AS fetched_count, o_orderkey AS k, o_orderstatus AS s FROM orders),
u AS (SELECT run_id, started_at, fetched_count, CASE WHEN s = 'F' THEN 'succeeded' ELSE 'failed' END AS state FROM r WHERE s <> 'O' UNION ALL SELECT run_id, started_at, fetched_count, 'succeeded' FROM r WHERE s = 'O')
SELECT run_id, strftime(started_at, '%Y-%m-%d') AS day, fetched_count, state, 'done' AS phase, coalesce(g, 0) AS good_marks FROM u LEFT JOIN (SELECT run_id, count(*) FILTER (WHERE mark = 'good') AS g FROM mk GROUP BY 1) USING (run_id)"""

FETCHES = """fe AS MATERIALIZED (SELECT printf('run-%08d', run) AS run_id, CASE WHEN idx % 2 = 0 THEN 'SRC' ELSE 'src' END || source AS name,
 CASE kind WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'running' WHEN 'view' THEN 'pending' ELSE 'ok' END AS status, CASE WHEN kind IN ('click', 'purchase') THEN idx % 50 END AS fetched_count, idx AS started_at
 FROM (SELECT event_id // 20 AS run, user_id % 20 AS source, max(event_id) AS idx, arg_max(event_type, event_id) AS kind FROM events GROUP BY 1, 2))"""
_last = f"{FETCHES}, la AS (SELECT provider, started_at, fetched_count FROM (SELECT *, lower(name) AS provider, row_number() OVER (PARTITION BY lower(name) ORDER BY run_id DESC) AS n FROM fe) WHERE n = 1)"
LAST_FETCH_SQL = f"WITH {_last} SELECT provider, started_at, fetched_count FROM la"
RECENT_SQL = f"WITH {FETCHES} SELECT provider, run_id, status, fetched_count, place FROM (SELECT *, lower(name) AS provider, row_number() OVER (PARTITION BY lower(name) ORDER BY run_id DESC) AS place FROM fe) WHERE place <= 5"
STATUS_SQL = f"""WITH {FETCHES} SELECT run_id, count(*) AS total, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'running') AS running,
 count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status IN ('ok', 'failed')) AS done, coalesce(sum(fetched_count) FILTER (WHERE status = 'ok'), 0)::BIGINT AS fetched FROM fe GROUP BY 1"""
OVERRIDE_SQL = """WITH c AS (SELECT p_partkey AS id, p_partkey % 3 > 0 AS enabled, p_partkey % 5 = 0 AS requires_secret, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS max_pages, CASE WHEN p_partkey % 2 = 0 THEN 20 END AS page_size, p_partkey % 2 = 0 AS enrich_body FROM part),
s AS (SELECT p_partkey AS id, p_partkey % 8 = 0 AS opted_in, p_partkey % 12 = 4 AS opted_out, p_partkey % 10 = 0 AS has_secret, CASE WHEN p_partkey % 16 = 0 THEN 9 END AS max_pages, 50 AS page_size, CASE WHEN p_partkey % 3 = 0 THEN 2.0::DOUBLE END AS rate_limit FROM part WHERE p_type IN ('ECONOMY', 'PROMO'))
SELECT c.id, requires_secret, (coalesce(opted_in, false) OR (enabled AND NOT coalesce(opted_out, false))) AND (NOT requires_secret OR coalesce(has_secret, false)) AS enabled,
 CASE WHEN c.max_pages IS NOT NULL THEN coalesce(s.max_pages, c.max_pages) END AS max_pages, CASE WHEN c.max_pages IS NOT NULL THEN coalesce(s.page_size, c.page_size) ELSE c.page_size END AS page_size,
 coalesce(s.rate_limit, 0.5::DOUBLE) AS rate_limit, enrich_body FROM c LEFT JOIN s USING (id)"""
HEALTH_SQL = f"""WITH {_last}, k AS (SELECT *, substr(provider, 4)::INT AS k FROM la)
SELECT provider, fetched_count, CASE WHEN k % 7 = 0 THEN CASE WHEN k % 2 = 0 THEN 'working' ELSE 'failing' END WHEN k % 5 = 0 AND k % 10 <> 0 THEN 'blocked' WHEN k % 6 = 0 THEN 'untested' WHEN k > 14 THEN 'stale' WHEN coalesce(fetched_count, 0) > 0 THEN 'working' ELSE 'failing' END AS health FROM k"""
DUPLICATES_SQL = f"""WITH a AS (SELECT 'rss' AS type, 'p' || page_id AS name, regexp_replace(url, '/\\d+.*$', '') AS url FROM pages UNION ALL SELECT * FROM {values([("rss", f"v{i}", u) for i, u in enumerate(ENDPOINTS) if u], "type, name, url")}),
k AS (SELECT type, name, {_host} AS h, {_path} AS p FROM a), e AS (SELECT type, name, {_backend} || lower(rtrim(p, '/')) AS endpoint_key FROM k)
SELECT type, endpoint_key, count(*) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM e GROUP BY 1, 2 HAVING count(*) > 1"""
DIFF_SQL = """SELECT c_custkey AS id, 'name' AS field, c_name AS current, 'New' AS suggested FROM customer WHERE c_custkey % 3 = 2 AND c_name <> 'New'
UNION ALL SELECT c_custkey, 'segment', c_mktsegment, 'BUILDING' FROM customer WHERE c_custkey % 2 = 0 AND c_mktsegment <> 'BUILDING'"""

# --- events -------------------------------------------------------------------------------------------------------
_phase_names = "['pending', 'fetching', 'deduping', 'ranking', 'llmJudging', 'writing', 'done']"
PHASED = f"""ev AS MATERIALIZED (SELECT user_id AS run_id, event_id, ts, event_id % 7 AS o, {_phase_names}[event_id % 7 + 1] AS phase FROM events),
ru AS (SELECT run_id, max(ts) AS finished_at, min(ts) FILTER (WHERE event_id % 11 = 0) AS started FROM ev GROUP BY 1)"""
PHASES_SQL = f"""WITH {PHASED}, f AS (SELECT run_id, phase, o, min(ts) AS began FROM ev WHERE o > 0 GROUP BY 1, 2, 3), n AS (SELECT *, lead(began) OVER (PARTITION BY run_id ORDER BY o) AS nx FROM f),
d AS (SELECT run_id, phase, (epoch_us(coalesce(nx, finished_at)) - epoch_us(began)) / 1000.0::DOUBLE AS ms FROM n LEFT JOIN ru USING (run_id)) SELECT run_id, phase, trunc(ms)::BIGINT AS duration_ms FROM d WHERE trunc(ms) >= 0"""
ATTEMPT_SQL = f"WITH {PHASED} SELECT run_id, count(*) AS n, min(event_id) AS first_event FROM ev LEFT JOIN ru USING (run_id) WHERE started IS NULL OR ts >= started GROUP BY 1"
RUN_EVENTS = """re AS MATERIALIZED (SELECT user_id::VARCHAR AS run_id, event_id AS seq, CASE WHEN event_type = 'error' AND event_id % 37 = 0 THEN 'failed' WHEN event_type = 'purchase' AND event_id % 41 = 0 THEN 'succeeded'
 WHEN event_type = 'error' THEN 'provider_failed' WHEN event_type = 'signup' THEN 'running' WHEN event_type = 'view' THEN 'provider_done' WHEN event_type = 'click' THEN 'dedupe' ELSE 'rank' END AS type,
 'src' || (event_id % 5) AS provider, event_id % 100 AS count, (event_id % 997) / 1000.0::DOUBLE AS score FROM events)"""
FOLD_SQL = f"""WITH {RUN_EVENTS}, o AS (SELECT *, coalesce(max((type IN ('succeeded', 'failed'))::INT) OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1, false) AS past FROM re),
v AS (SELECT * FROM o WHERE NOT past),
r AS (SELECT run_id, coalesce(arg_max(CASE WHEN type = 'running' THEN 'running' ELSE type END, seq) FILTER (WHERE type IN ('running', 'succeeded', 'failed')), 'queued') AS state,
 coalesce(arg_max(CASE WHEN type = 'dedupe' THEN 'deduping' WHEN type = 'rank' THEN 'ranking' WHEN type = 'succeeded' THEN 'done' ELSE 'fetching' END, seq) FILTER (WHERE type <> 'failed'), 'pending') AS phase,
 count(*) FILTER (WHERE type = 'running') AS attempt, arg_max(count, seq) FILTER (WHERE type = 'dedupe') AS deduped_count, arg_max(count, seq) FILTER (WHERE type = 'rank') AS ranked_count,
 arg_max(count, seq) FILTER (WHERE type IN ('rank', 'succeeded')) AS shortlist_count, round(arg_max(score, seq) FILTER (WHERE type IN ('rank', 'succeeded')), 6) AS top_score,
 max('error ' || seq) FILTER (WHERE type = 'failed') AS error, count(*) AS events FROM v GROUP BY 1),
p AS (SELECT run_id, provider, arg_max(type, seq) AS t, arg_max(count, seq) AS n FROM v WHERE type IN ('provider_done', 'provider_failed') GROUP BY 1, 2),
t AS (SELECT run_id, coalesce(sum(n) FILTER (WHERE t = 'provider_done'), 0)::BIGINT AS fetched_count, count(*) FILTER (WHERE t = 'provider_done') AS providers_ok, count(*) FILTER (WHERE t = 'provider_failed') AS providers_failed FROM p GROUP BY 1)
SELECT run_id, state, phase, attempt, deduped_count, ranked_count, shortlist_count, top_score, error, events, coalesce(rejected, 0) AS rejected, coalesce(fetched_count, 0) AS fetched_count, coalesce(providers_ok, 0) AS providers_ok, coalesce(providers_failed, 0) AS providers_failed
FROM r LEFT JOIN t USING (run_id) LEFT JOIN (SELECT run_id, count(*) AS rejected FROM o WHERE past GROUP BY 1) USING (run_id)"""
STALE_SQL = """WITH j AS (SELECT user_id AS run_id, max(ts) AS hb FROM events GROUP BY 1), k AS (SELECT *, run_id % 4 <> 0 AND hb < TIMESTAMP '2024-01-30 19:55:00' AS stale FROM j)
SELECT run_id, CASE WHEN stale THEN 'interrupted' WHEN run_id % 4 = 0 THEN 'succeeded' ELSE 'running' END AS state, stale AS finished FROM k"""
PAGES_SQL = """WITH p AS MATERIALIZED (SELECT DISTINCT user_id % 10 AS source, event_id // 500 AS page, CASE WHEN event_id // 500 % 20 < 18 THEN event_id % (300 + user_id % 10 * 137) END AS item_id FROM events),
n AS MATERIALIZED (SELECT *, item_id IS NOT NULL AND row_number() OVER (PARTITION BY source, item_id ORDER BY page) = 1 AS fresh FROM p),
e AS (SELECT source, page, count(item_id) AS n, count(*) FILTER (WHERE fresh) AS added FROM n GROUP BY 1, 2),
w AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY page) AS nth, coalesce(max((n = 0 OR added = 0 OR n < 20)::INT) OVER (PARTITION BY source ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM e)
SELECT source, page, item_id FROM n JOIN (SELECT source, page FROM w WHERE nth <= 15 AND stopped = 0 AND n > 0) USING (source, page) WHERE fresh"""
BREAKER_SQL = """WITH c AS (SELECT (user_id % 50)::VARCHAR AS host, event_id AS seq, event_type NOT IN ('error', 'view', 'click') AS ok FROM events),
i AS (SELECT *, sum(ok::INT) OVER (PARTITION BY host ORDER BY seq) AS island FROM c), f AS (SELECT *, (sum((NOT ok)::INT) OVER (PARTITION BY host, island ORDER BY seq))::BIGINT AS failures FROM i)
SELECT host, seq, ok, failures, coalesce(max((failures >= 3)::INT) OVER (PARTITION BY host ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1, false) AS skipped FROM f"""
ENRICH_WHOLE_SQL = f"""WITH d AS (SELECT doc_id AS id, doc_id % (SELECT greatest(1, count(*)) FROM pages) AS page_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE text END AS description FROM documents),
b AS (SELECT page_id, nullif({shown('html')}, '') AS body FROM pages WHERE page_id % 9 > 0),
m AS (SELECT id, CASE WHEN body IS NULL THEN description WHEN trim(description) = '' THEN body ELSE description || ' ' || body END AS t FROM d LEFT JOIN b USING (page_id)) SELECT id, length(t) AS chars, md5(t) AS digest FROM m"""
CAP_SQL = "SELECT p_partkey, p_partkey % 2 <> 0 AND CASE p_partkey % 3 WHEN 0 THEN p_size > 0 WHEN 1 THEN p_size = 10 ELSE false END AS capped FROM part"
STREAMED_SQL = f"""SELECT run_id, state, phase, attempt::INT AS attempt, fetched_count, coalesce(deduped_count, 0) AS deduped_count, coalesce(shortlist_count, 0) AS shortlist_count,
 coalesce(top_score, 0) AS top_score, rejected, events FROM ({FOLD_SQL})"""
API_SQL = f"""WITH t AS (SELECT doc_id, source, {shown("coalesce(text, '')")} AS body FROM documents WHERE doc_id % 7 > 0 AND doc_id % 11 > 0)
SELECT substr(sha256('api:' || doc_id::VARCHAR), 1, 32) AS id, 'Post ' || doc_id AS title, nullif(trim(source), '') AS company, 'https://jobs.example/' || doc_id AS url, doc_id // 50 AS page, length(body) AS chars, md5(body) AS digest FROM t"""
_gathered = " UNION ALL ".join(
    f"SELECT {k} AS source_ord, '{t}/' || {key} AS url, row_number() OVER (ORDER BY 70000 - {key} % 9, {key}) AS place FROM {t}"
    for k, (t, key) in enumerate((("customer", "c_custkey"), ("orders", "o_orderkey"), ("part", "p_partkey")))
)
GATHER_SQL = f"SELECT *, true AS after_the_one_before FROM ({_gathered})"

CSV_HEADERS = (
    ("Title", " URL ", "COMPANY", "Description", "posted_at", "Location"),
    ("posted_at", "extra", "Description", "COMPANY", " URL ", "Title"),
    ("Location", "Title", "location", " URL ", "Description"),
    (" URL ", "Title"),
)
_has = lambda column: " OR ".join(f"f % {len(CSV_HEADERS)} = {i}" for i, h in enumerate(CSV_HEADERS) if column in h)
CSV_SQL = f"""WITH c AS (SELECT *, c_custkey // 50 AS f FROM customer WHERE c_custkey % 7 > 0)
SELECT substr(sha256('csv:https://c.example/' || c_custkey), 1, 32) AS id, 'Post "' || c_custkey || '", ' || c_mktsegment AS title, CASE WHEN ({_has("COMPANY")}) AND c_custkey % 3 > 0 THEN c_name END AS company,
 CASE WHEN ({_has("location")}) AND c_custkey % 5 = 0 THEN 'second' WHEN {_has("Location")} THEN c_nationkey::VARCHAR END AS location,
 CASE WHEN {_has("Description")} THEN 'first, line' || chr(10) || chr(10) || 'second ' || c_acctbal::DECIMAL(12,2) ELSE '' END AS description, 'https://c.example/' || c_custkey AS url, CASE WHEN ({_has("posted_at")}) AND c_custkey % 2 = 0 THEN '2024-01-15' END AS day FROM c"""
JSON_SQL = """SELECT substr(sha256('json:https://p.example/' || p_partkey), 1, 32) AS id, p_name || ' "' || p_brand || '"' AS title, CASE WHEN p_partkey % 4 = 0 THEN 'last' WHEN p_partkey % 3 = 0 THEN p_size::VARCHAR WHEN p_partkey % 3 = 1 THEN 'True' END AS company,
 NULL::VARCHAR AS location, p_type AS description, 'https://p.example/' || p_partkey AS url FROM part WHERE p_partkey % 11 > 0 AND p_partkey % 13 > 0"""
MARK_VALUES = (
    '"good"', '"bad"', '"GOOD"', "3", "null", '["good"]', '{"mark": "good", "reason": " why ", "status": "applied"}', '{"mark": "Bad", "status": "offer"}', '{"mark": 1, "reason": 2, "status": "interview"}',
    '{"mark": "bad", "reason": " "}', '{"status": "moon"}', '{"reason": "alone"}', "{}",
)
_marks = [("good", None, None), ("bad", None, None), *[(None,) * 3] * 4, ("good", " why ", "applied"), (None, None, "offer"), (None, None, "interview"), ("bad", None, None), *[(None,) * 3] * 3]
MARK_DOCUMENTS_SQL = f"""SELECT 'run-' || (doc_id // 20) AS run_id, doc_id::VARCHAR AS listing_id, mark, reason, status FROM labels JOIN {values([(i, *m) for i, m in enumerate(_marks)], "i, mark, reason, status")} ON doc_id % {len(_marks)} = i
WHERE mark IS NOT NULL OR status IS NOT NULL"""
CATALOGUE_SQL = "SELECT s_suppkey AS id, s_name || ' // no, comment ,]' AS name, 'https://s.example/' || s_nationkey AS endpoint, s_suppkey % 2 <> 0 AS enabled FROM supplier"
_text = lambda x: decoded(f"regexp_replace({x}, '<[^>]*>', '', 'g')")
CARDS_SQL = rf"""WITH m AS (SELECT page_id, unnest(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '(?s)<li>.*?</li>')) AS li FROM pages),
a AS (SELECT page_id, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS body FROM pages WHERE contains(html, '<article>')),
r AS (SELECT page_id AS page, 'menu' AS kind, regexp_extract(li, '(?s)<a [^>]*>(.*?)</a>', 1) AS title, regexp_extract(li, '<a href="([^"]*)"', 1) AS href FROM m
UNION ALL SELECT page_id, 'article', nullif(regexp_extract(body, '(?s)<h1>(.*?)</h1>', 1), ''), NULL FROM a)
SELECT page, kind, trim(regexp_replace({_text("title")}, '\s+', ' ', 'g')) AS title, {decoded("href")} AS href FROM r"""

_fetched = lambda name, sql, place: f"SELECT '{name}' AS name, 'ok' AS status, count(*) AS fetched_count, NULL::VARCHAR AS error, count(*) AS listings, count(DISTINCT id) AS ids, {place} AS place FROM ({sql})"
SOURCES_SQL = f"""{_fetched("docs", API_SQL, 0)} UNION ALL {_fetched("parts", JSON_SQL, 1)} UNION ALL {_fetched("customers", CSV_SQL, 2)}
UNION ALL SELECT 'mystery', 'failed', 0, 'unsupported source type ' || chr(39) || 'gopher' || chr(39), NULL, NULL, NULL UNION ALL SELECT 'lost', 'failed', 0, 'unreadable', NULL, NULL, NULL"""
_query_of = lambda *keys: "array_to_string(list_filter([" + ", ".join(keys) + "], lambda x: x IS NOT NULL), '&')"
_id, _name, _q = "'id=' || page_id", "'name=' || url_encode('a b*~+/é&' || page_id)", "CASE WHEN page_id % 2 = 0 THEN 'q%20q=' || url_encode(url) END"
_own = "nullif(regexp_extract(url, '[?]([^#]*)', 1), '')"
REQUESTS_SQL = rf"""SELECT page_id, CASE page_id % 3 WHEN 0 THEN regexp_extract(url, '^[^?#]*') || '?' || {_query_of(_own, _id, _name, _q)} || regexp_extract(url, '#.*$')
 WHEN 1 THEN 'https://api.example/' || page_id || '/v/' || url_encode('a b*~+/é&' || page_id) || '?' || {_query_of("'a=1&id=' || page_id", _q)} ELSE 'https://api.example/all?' || {_query_of(_id, _name, _q)} || '#top' END AS request FROM pages"""
