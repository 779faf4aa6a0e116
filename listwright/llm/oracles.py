"""SQL for DuckDB that gives the rows of those queries that SQL can express."""

from __future__ import annotations

from listwright.llm.chat import ChatTemplate, _by_first
from listwright.llm.mixing import MixPlan
from listwright.llm.negatives import MiningPlan
from listwright.llm.quality import QualityRules

_WORD = r"'[^\x20\x09-\x0D]+'"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def mix_sql(plan: MixPlan = MixPlan()) -> str:
    weights = f"[{', '.join(map(str, plan.weights))}]"
    copies = " UNION ALL ".join(f"SELECT size, (source_size * {c} + cum) / target AS finish FROM c WHERE size > 0 AND target > 0" for c in range(plan.max_copies))
    taken = " + ".join(f"coalesce(((source_size * {c} + cum) / target <= lim)::INT, 0)" for c in range(plan.max_copies))
    return f"""WITH z AS MATERIALIZED (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, {_WORD})), 0)::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM z GROUP BY 1),
s1 AS (SELECT *, {weights}[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(plan.weights)} + 1]::DOUBLE AS w, row_number() OVER (ORDER BY source NULLS LAST) AS r, source_size * {float(plan.max_copies)}::DOUBLE AS cap FROM s0),
s2 AS (SELECT *, cap / w AS ratio, ({plan.share}::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0::DOUBLE)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0::DOUBLE)) AS level FROM s1
 WINDOW o AS (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS MATERIALIZED (SELECT source, source_size, CASE WHEN level >= ratio THEN cap ELSE w * max(CASE WHEN level < ratio THEN level END) OVER () END AS target FROM s2),
c AS MATERIALIZED (SELECT doc_id, size, source_size, target, sum(size) OVER (PARTITION BY z.source ORDER BY substr(md5('{plan.seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 15), doc_id, size ROWS UNBOUNDED PRECEDING)::DOUBLE AS cum FROM z JOIN s ON z.source IS NOT DISTINCT FROM s.source),
e AS (SELECT finish, sum(size) AS size FROM ({copies}) GROUP BY 1), t AS (SELECT finish, sum(size) OVER (ORDER BY finish) AS total FROM e),
l AS (SELECT coalesce(max(finish), 0) AS lim FROM t WHERE total <= (SELECT {plan.share}::DOUBLE * sum(size) FROM z))
SELECT doc_id, size, source_size, target, CASE WHEN size > 0 THEN size * ({taken}) ELSE 0 END::BIGINT AS taken FROM c, l"""


def chat_sql(template: ChatTemplate = ChatTemplate()) -> str:
    def escaped(x: str) -> str:
        for first, rest in _by_first(template):
            x = f"regexp_replace({x}, {_q(f'({first})(' + chr(92) * 2 + f'*)({rest})')}, '{chr(92)}1{chr(92) * 3}2{chr(92)}3', 'g')"
        return x

    around = " ".join(f"WHEN {_q(r)} THEN {len(t.open) + len(t.close)}" for r, t in template.turns.items())
    other = len(template.other_open) + len(template.other_name_end) + len(template.other_close)
    loss = ", ".join(_q(r) for r, t in template.turns.items() if t.loss)
    allowed = ", ".join(_q(f"{a}>{b}") for a, to in template.follows.items() for b in to)
    finals = ", ".join(map(_q, template.finals))
    says = "'</s>[INST] ok [/INST]'"
    return f"""WITH c AS (SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role, text FROM conversations UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', {says}), (-7, 1, 'assistant', {says})) v),
n AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c),
e AS (SELECT *, length({escaped("text")}) + CASE role {around} ELSE {other} + length({escaped("role")}) END AS chars, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY i), '') || '>' || role IN ({allowed}) AS ok FROM n)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256, coalesce(sum(length(text)) FILTER (WHERE role IN ({loss})), 0)::BIGINT AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role IN ({loss})), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars, bool_and(ok) AND arg_max(role, i) IN ({finals}) AS valid FROM e GROUP BY 1"""


def quality_sql(rules: QualityRules = QualityRules()) -> str:
    base = f"(n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words)"
    own = f"({base} OR n_symbols > {rules.max_symbols_per_word}::DOUBLE * n_words OR n_dup_lines > {rules.max_dup_line_share}::DOUBLE * n_lines OR n_capitals > {rules.max_capital_share}::DOUBLE * n_words)"
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (SELECT rid, unnest(regexp_extract_all(text, {_WORD})) AS word, generate_subscripts(regexp_extract_all(text, {_WORD}), 1) AS i FROM d),
g AS (SELECT rid, i, word, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
h AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, word, b, c) AS n FROM g WHERE c IS NOT NULL),
r AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM h WHERE n > 1) GROUP BY 1),
t AS (SELECT rid, count(*) AS n_words, sum(length(word)) AS word_chars, count(*) FILTER (WHERE regexp_matches(word, '[A-Z]') AND NOT regexp_matches(word, '[a-z]') AND strlen(word) > 2) AS n_capitals FROM w GROUP BY 1),
l AS (SELECT rid, line, count(*) AS n FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, {_WORD}) GROUP BY 1, 2),
u AS (SELECT rid, sum(n - 1) AS n_dup_lines, sum(n) AS n_lines FROM l GROUP BY 1),
m AS MATERIALIZED (SELECT doc_id, source, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
 coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_capitals, 0) AS n_capitals FROM d LEFT JOIN t USING (rid) LEFT JOIN r USING (rid) LEFT JOIN u USING (rid)),
v AS MATERIALIZED (SELECT *, {base} AS base_failed, {own} AS own_failed FROM m),
hosts AS (SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (WHERE own_failed) AS f FROM v WHERE source IS NOT NULL GROUP BY 1),
a AS (SELECT sum(f) / sum(n) AS mean, count(*) AS k, sum(n) AS n, sum(n * n) AS squares FROM hosts),
b AS (SELECT mean, k, (sum(hosts.n * (f / hosts.n - mean) * (f / hosts.n - mean)) - (k - 1) * mean * (1 - mean)) / greatest(any_value(a.n) - any_value(squares) / any_value(a.n), 1e-9) AS between_hosts FROM hosts, a GROUP BY mean, k),
p AS (SELECT mean, CASE WHEN k > 1 AND mean > 0 AND mean < 1 AND between_hosts > 0 THEN least(greatest(mean * (1 - mean) / between_hosts - 1, 1), 1e6) ELSE {rules.default_strength} END AS strength FROM b),
x AS (SELECT source, (f + mean * strength) / (n + strength) > {rules.max_host_rate} AS rejected FROM hosts, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT own_failed AND NOT coalesce(rejected, false) AS kept FROM v LEFT JOIN x ON v.source = x.source"""


def negatives_sql(plan: MiningPlan = MiningPlan()) -> str:
    best = "ORDER BY score DESC, vec_id NULLS LAST"
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor({plan.scale} * c::DOUBLE)) AS q FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS MATERIALIZED (SELECT a.rid, a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, a.rid = r.rid AS own, list_inner_product(a.q, r.q)::BIGINT AS score FROM v a, v r WHERE a.vec_id % {plan.every} = 0),
p AS (SELECT rid, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER o AS place FROM s WHERE same AND NOT own WINDOW o AS (PARTITION BY rid {best}) QUALIFY place <= {plan.positives})
SELECT p.anchor_id, positive_id, (row_number() OVER o)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (rid)
 WHERE NOT same AND {plan.low} * positive_score <= 100 * score AND 100 * score <= {plan.high} * positive_score WINDOW o AS (PARTITION BY rid, place {best}) QUALIFY rank <= {plan.negatives}"""


ORACLES = {"op2_source_mix": mix_sql(), "op4_chat_format": chat_sql(), "op10_host_quality": quality_sql(), "op13_hard_negatives": negatives_sql()}
