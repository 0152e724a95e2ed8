"""The core queries in SQL."""

from .functions.text import AFTER_BREAK, BEFORE_BREAK, SPACE, WORD
from .queries import CENTER, NOISE, RULES

_FIRST = "SELECT * FROM {t} WHERE {k} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY loaded_at NULLS FIRST) = 1"
S = f"s AS ({_FIRST.format(t='sentences', k='sentence_id')})"
M = f"m AS ({_FIRST.format(t='mentions', k='mention_id')})"
T = f"t0 AS ({_FIRST.format(t='triples', k='triple_id')}), f AS (SELECT *, subject_entity_id AS subject, object_entity_id AS object, evidence_sentence AS evidence FROM t0)"
A = """names AS (SELECT id, entity_type, unnest(list_concat([name], coalesce(aliases, []))) AS alias FROM entities),
 a AS (SELECT row_number() OVER (ORDER BY length(alias) DESC, alias, entity_id) AS alias_rank, alias, entity_id, entity_type FROM (SELECT DISTINCT alias, id AS entity_id, entity_type FROM names WHERE alias IS NOT NULL AND alias <> ''))"""
KNOWN = "known AS (SELECT DISTINCT lower(alias) AS name FROM a)"
STOP = "stop AS (SELECT DISTINCT word FROM common_words WHERE word IS NOT NULL)"
W = "w AS (SELECT sentence_id AS doc_id, pos - 1 AS pos, tk.text AS word FROM (SELECT sentence_id, unnest(tokens) AS tk, generate_subscripts(tokens, 1) AS pos FROM s) WHERE tk.text IS NOT NULL)"


def _sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_RE2 = WORD.replace(r"\p{IsHan}", r"\p{Han}")
_NORM = "replace(replace(replace(text, '﻿', ''), '　', ' '), ' ', ' ')"
_NORM = f"regexp_replace({_NORM}, '\\r\\n|\\r', chr(10), 'g')"
for _ in range(2):
    _NORM = f"regexp_replace({_NORM}, {_sq(f'({BEFORE_BREAK})\\n({AFTER_BREAK})')}, '\\1\\2', 'g')"
_NORM = f"regexp_replace({_NORM}, '[ \\t\\r\\f\\x0B]+', ' ', 'g')"
_NORM = f"regexp_replace(regexp_replace({_NORM}, '\\n +', chr(10), 'g'), ' +\\n', chr(10), 'g')"
_NORM = f"regexp_replace({_NORM}, '\\n{{3,}}', chr(10) || chr(10), 'g')"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, {_sq(f'^{SPACE}+|{SPACE}+$')}, '', 'g')"


_GREEDY = "list_reduce(list_transform(l, lambda x: [x]), lambda acc, x: CASE WHEN {bad} THEN acc ELSE list_concat(acc, x) END)"

_FOUND = """found AS (SELECT sentence_id, p - 1 AS start, p - 1 + length(alias) AS "end", substring(text, p, length(alias)) AS text, alias_rank, entity_id, entity_type FROM
 (SELECT s.sentence_id, s.text, a.*, unnest(generate_series(1, length(s.text) - length(a.alias) + 1)) AS p FROM s JOIN a ON length(s.text) >= length(a.alias) AND contains(lower(s.text), lower(a.alias)))
 WHERE CASE WHEN regexp_full_match(alias, '[\\x00-\\x7F]+') THEN lower(substring(text, p, length(alias))) = lower(alias) ELSE substring(text, p, length(alias)) = alias END)"""

_COVER = """c0 AS (SELECT m.mention_id, m.sentence_id, m.start, m."end", m.entity_type, list_filter(list_transform(s.tokens, lambda t, i: {'i': i - 1, 's': t.start, 'e': t."end"}), lambda t: t.s < m."end" AND t.e > m.start) AS covered FROM m JOIN s USING (sentence_id)),
 c AS (SELECT * FROM c0 WHERE len(covered) > 0)"""
_LABEL = _COVER + """, hits AS (SELECT sentence_id, start, "end", mention_id, entity_type, unnest(covered) AS t, generate_subscripts(covered, 1) AS k FROM c),
 last AS (SELECT sentence_id, t.i AS token_index, (CASE WHEN k = 1 THEN 'B-' ELSE 'I-' END) || entity_type AS label FROM hits QUALIFY row_number() OVER (PARTITION BY sentence_id, t.i ORDER BY start DESC, "end" DESC, mention_id DESC) = 1),
 toks AS (SELECT sentence_id, unnest(tokens) AS tk, generate_subscripts(tokens, 1) - 1 AS token_index FROM s),
 lab AS (SELECT toks.sentence_id, toks.token_index, tk.text AS token, tk.start AS start, tk."end" AS "end", coalesce(label, 'O') AS label FROM toks LEFT JOIN last USING (sentence_id, token_index))"""

_GRAMS = """CASE WHEN length(p) > {n} THEN list_transform(generate_series(1, length(p) - {n} + 1), lambda i: substring(p, i, {n})) WHEN length(p) <= {n} AND ({n} = {lo} OR length(p) > {n} - 1) THEN [p] ELSE [] END"""


def _grams(table: str, key: str, text: str, lo: int, hi: int) -> str:
    parts = ", ".join(_GRAMS.format(n=n, lo=lo) for n in range(lo, hi + 1))
    return f"(SELECT id, unnest(flatten([{parts}])) AS term FROM (SELECT {key} AS id, ' ' || unnest(list_filter(regexp_split_to_array(lower({text}), '\\s+'), lambda w: w <> '')) || ' ' AS p FROM {table}))"


def _fit(name: str, terms: str, where: str = "", limit: str = "") -> str:
    """CTEs {name}_tf, {name}_v, {name}_w."""
    return f"""{name}_tf AS (SELECT id, term, count(*) AS tf FROM {terms} WHERE term IS NOT NULL GROUP BY id, term), {name}_n AS (SELECT count(DISTINCT id) AS n FROM {name}_tf),
 {name}_v AS (SELECT term, ln((1.0 + n) / (1.0 + df)) + 1 AS idf FROM (SELECT term, count(*) AS df, sum(tf) AS cf FROM {name}_tf GROUP BY term), {name}_n {where} {limit}),
 {name}_w AS ({_weights(name + '_tf', name + '_v')})"""


def _weights(tf: str, v: str) -> str:
    return f"SELECT id, term, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS weight FROM (SELECT id, term, tf * idf AS x FROM {tf} JOIN {v} USING (term))"


_SIM = f"""keys AS (SELECT DISTINCT lower({_strip('text')}) AS key FROM m WHERE {_strip('text')} <> ''), {_fit('al', _grams('a', 'alias_rank', 'alias', 2, 4))},
 q_tf AS (SELECT id, term, count(*) AS tf FROM {_grams('keys', 'key', 'key', 2, 4)} GROUP BY id, term), q_w AS ({_weights('q_tf', 'al_v')}),
 sim AS (SELECT q_w.id AS key, al_w.id AS alias_rank, round(sum(q_w.weight * al_w.weight), 9) AS cosine FROM q_w JOIN al_w USING (term) GROUP BY 1, 2),
 top15 AS (SELECT key, alias_rank, entity_id, cosine FROM (SELECT * FROM sim QUALIFY row_number() OVER (PARTITION BY key ORDER BY cosine DESC, alias_rank) <= 15) JOIN a USING (alias_rank) WHERE cosine > 0.1)"""

_LINKED = """lm AS (SELECT sentence_id, mention_id, start, "end", m.entity_type, coalesce(link_score, 0) AS score, linked_entity_id AS e, coalesce(en.tags, []) AS tags FROM m JOIN entities en ON en.id = linked_entity_id WHERE NOT coalesce(is_nil, false))"""
_TRIG = """tr AS (SELECT sentence_id, relation_id, pattern, p - 1 AS t_start, p - 1 + length(pattern) AS t_end FROM (SELECT s.sentence_id, s.text, r.relation_id, r.pattern, unnest(generate_series(1, length(s.text) - length(pattern) + 1)) AS p FROM s JOIN (SELECT DISTINCT id AS relation_id, unnest(patterns) AS pattern FROM relations) r ON contains(s.text, r.pattern)) WHERE substring(text, p, length(pattern)) = pattern)"""


def _role(role: str) -> str:
    d = f"r.{role}_direction"
    before, after = 'CASE WHEN lm."end" <= tr.t_start THEN tr.t_start - lm."end" END', 'CASE WHEN lm.start >= tr.t_end THEN lm.start - tr.t_end END'
    return f"""(SELECT tr.sentence_id, tr.relation_id, tr.pattern, tr.t_start, tr.t_end, coalesce(r.symmetric, false) AS sym, r.negative_patterns AS neg, lm.e, lm.score, lm.start, lm."end", row_number() OVER (PARTITION BY tr.sentence_id, tr.relation_id, tr.pattern, tr.t_start, tr.t_end ORDER BY gap, lm.score DESC, lm.start, lm.mention_id) AS rk
 FROM tr JOIN relations r ON r.id = tr.relation_id JOIN lm ON lm.sentence_id = tr.sentence_id, LATERAL (SELECT CASE {d} WHEN 'before' THEN {before} WHEN 'after' THEN {after} ELSE coalesce({before}, {after}, 0) END AS gap)
 WHERE list_contains(r.{role}_types, lm.entity_type) AND (len(coalesce(r.{role}_tags, [])) = 0 OR list_has_any(r.{role}_tags, lm.tags)) AND gap IS NOT NULL AND gap <= r.max_distance)"""


_KEY = "sentence_id, relation_id, pattern, t_start, t_end"


def _rule_sql(name: str) -> str:
    (rule,) = RULES[name]
    hr, hx, hy = rule.head
    rel, x, y = rule.body[0]
    if len(rule.body) == 1:
        body = f"SELECT subject AS v_{x}, object AS v_{y}, coalesce(confidence, 0) AS c, [triple_id] AS ids FROM g WHERE relation_id = '{rel}'"
    else:
        rel2, x2, y2 = rule.body[1]
        cols = {x: "p.subject", y: "p.object"}
        on = " AND ".join(f"{cols[v]} = q.{c}" for v, c in ((x2, "subject"), (y2, "object")) if v in cols)
        cols |= {v: f"q.{c}" for v, c in ((x2, "subject"), (y2, "object")) if v not in cols}
        body = f"SELECT {', '.join(f'{c} AS v_{v}' for v, c in cols.items())}, least(coalesce(p.confidence, 0), coalesce(q.confidence, 0)) AS c, [p.triple_id, q.triple_id] AS ids FROM g p JOIN g q ON {on} WHERE p.relation_id = '{rel}' AND q.relation_id = '{rel2}'"
    return f"""WITH {T}, g AS (SELECT * FROM f WHERE source <> 'inferred'), d AS ({body}),
 x AS (SELECT v_{hx} AS subject, v_{hy} AS object, max(round(round(c * {rule.weight}, 9), 4)) AS confidence, list_sort(list_distinct(flatten(list(ids)))) AS ids FROM d WHERE v_{hx} <> v_{hy} GROUP BY 1, 2)
 SELECT '{hr}' AS relation_id, subject, object, confidence, array_to_string(ids, '|') AS support_ids, len(ids)::BIGINT AS supports FROM x WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.relation_id = '{hr}' AND g.subject = x.subject AND g.object = x.object)"""


_REACH = f"""e2 AS (SELECT subject AS a, object AS b FROM f WHERE subject <> object UNION SELECT object, subject FROM f WHERE subject <> object),
 reach(id) AS (SELECT '{CENTER}' UNION SELECT e2.b FROM reach JOIN e2 ON e2.a = reach.id)"""
_DEG = "deg AS (SELECT id, count(*) AS degree FROM (SELECT unnest([subject, object]) AS id FROM f) WHERE id IS NOT NULL GROUP BY id), mc AS (SELECT linked_entity_id AS id, count(*) AS mentions FROM m WHERE linked_entity_id IS NOT NULL GROUP BY 1)"
_NODES = "SELECT e.id, e.name AS label, e.entity_type AS \"group\", greatest(coalesce(mc.mentions, 0), 1)::BIGINT AS value, deg.degree IS NOT NULL AS in_triples FROM entities e LEFT JOIN mc ON mc.id = e.id LEFT JOIN deg ON deg.id = e.id WHERE e.id IN "
_FREQ = f"fr AS (SELECT word, count(*) AS freq FROM w WHERE length(word) >= 2 AND word NOT IN (SELECT word FROM stop) AND lower(word) NOT IN (SELECT name FROM known) GROUP BY word)"
_BOOST = "bo AS (SELECT x.word, sum(9 - abs(x.pos - k.pos))::BIGINT AS boost FROM w x JOIN (SELECT doc_id, pos FROM w WHERE lower(word) IN (SELECT name FROM known)) k ON x.doc_id = k.doc_id AND x.pos BETWEEN k.pos - 8 AND k.pos + 8 AND x.pos <> k.pos WHERE length(x.word) >= 2 AND x.word NOT IN (SELECT word FROM stop) AND lower(x.word) NOT IN (SELECT name FROM known) GROUP BY 1)"
_PT = f"""pw AS (SELECT doc_id AS id, word AS term FROM w WHERE length(word) >= 2 AND word NOT IN (SELECT word FROM stop)), {_fit('pt', 'pw', 'WHERE df >= 2 AND df <= 0.6 * n', 'ORDER BY cf DESC, term LIMIT 600')},
 sc AS (SELECT term AS word, round(sum(weight) / any_value(n), 9) AS score FROM pt_w, pt_n GROUP BY term ORDER BY score DESC, word LIMIT 300)"""
_CAND = f"""cand AS (SELECT fr.word, fr.freq, round(coalesce(score, 0), 6) AS tfidf, coalesce(boost, 0)::BIGINT AS boost, round(round(0.3 * least(coalesce(score, 0) * 8, 1.0) + 0.2 * least(coalesce(boost, 0) / 100, 1.0) + 0.1 * least(freq / 300, 1.0), 9), 4) AS confidence FROM fr LEFT JOIN sc USING (word) LEFT JOIN bo USING (word) WHERE freq >= 5 AND (score IS NOT NULL OR boost IS NOT NULL))"""


def _json_list(x: str, depth: int = 1) -> str:
    """Any way of writing a list in JSON, as a list of JSON values."""
    text = _json_list(f"try_cast(({x} ->> '$') AS JSON)", 0) if depth else "[]"
    return f"CASE json_type({x}) WHEN 'ARRAY' THEN ({x})::JSON[] WHEN 'OBJECT' THEN CASE WHEN json_type({x} -> 'items') = 'ARRAY' THEN ({x} -> 'items')::JSON[] ELSE [{x}] END WHEN 'VARCHAR' THEN {text} ELSE [] END"


def _json_rows(source: str, keep: str, value: str) -> str:
    """``source`` with one row (keep, i, v) for each element of a list."""
    return f"(SELECT {keep}, unnest(l) AS v, generate_subscripts(l, 1) AS i FROM (SELECT {keep}, {value} AS l FROM {source}))"


_LINKS = f"""WITH p AS (SELECT raw_id, payload::JSON AS j FROM raw_records WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'),
 d AS (SELECT raw_id, v ->> 'document_id' AS id, v AS d FROM {_json_rows('p', 'raw_id', f"list_concat({_json_list("(j -> 'batch' -> 'documents')")}, {_json_list("(j -> 'document')")}, CASE WHEN (j ->> 'document_id') IS NOT NULL THEN [j] ELSE [] END)")} WHERE json_type(v) = 'OBJECT'),
 s AS (SELECT raw_id, id, i, v ->> 'sentence_id' AS sid, v AS s FROM {_json_rows('d', 'raw_id, id', _json_list("(d -> 'sentences')"))} WHERE json_type(v) = 'OBJECT'),
 m AS (SELECT raw_id, sid, i, v FROM {_json_rows('s', 'raw_id, sid', _json_list("(s -> 'mentions')"))} UNION ALL SELECT raw_id, v ->> 'sentence_id', i, v FROM {_json_rows('d', 'raw_id', _json_list("(d -> 'mentions')"))}),
 c AS (SELECT raw_id, v ->> 'mention_id' AS mid, v -> 'candidates' AS c FROM m WHERE json_type(v) = 'OBJECT'), keyed AS (SELECT raw_id, mid, c, json_keys(c) AS l FROM c WHERE json_type(c) = 'OBJECT' AND (c ->> 'entity_id') IS NULL AND (c -> 'items') IS NULL),
 k AS (SELECT raw_id, mid, c, unnest(l) AS key, generate_subscripts(l, 1) AS i FROM keyed),
 lists AS (SELECT raw_id, mid, c FROM c WHERE NOT (json_type(c) = 'OBJECT' AND (c ->> 'entity_id') IS NULL AND (c -> 'items') IS NULL)),
 t AS (SELECT raw_id, id, i, v ->> 'triple_id' AS tid, v -> 'support_triple_ids' AS u FROM {_json_rows('d', 'raw_id, id', _json_list("(d -> 'triples')"))} WHERE json_type(v) = 'OBJECT'),
 u AS (SELECT raw_id, tid, i, coalesce(v ->> 'triple_id', CASE WHEN json_type(v) = 'VARCHAR' THEN v ->> '$' END) AS x FROM {_json_rows("(SELECT * FROM t WHERE NOT (json_type(u) = 'VARCHAR' AND NOT starts_with(trim(u ->> '$'), '[')))", 'raw_id, tid', _json_list('u'))}
  UNION ALL SELECT raw_id, tid, generate_subscripts(l, 1), unnest(l) FROM (SELECT raw_id, tid, list_filter(list_transform(string_split(u ->> '$', '|'), lambda y: trim(y)), lambda y: y <> '') AS l FROM t WHERE json_type(u) = 'VARCHAR' AND NOT starts_with(trim(u ->> '$'), '['))),
 x AS (SELECT raw_id, 'sentence' AS child_kind, id AS parent_id, i, sid AS child_id FROM s UNION ALL SELECT raw_id, 'triple', id, i, tid FROM t UNION ALL SELECT raw_id, 'support', tid, i, x FROM u UNION ALL SELECT raw_id, 'mention', sid, i, v ->> 'mention_id' FROM m
  UNION ALL SELECT raw_id, 'token', sid, i, coalesce(v ->> 'text', v ->> 0, CASE WHEN json_type(v) = 'VARCHAR' THEN v ->> '$' END) FROM {_json_rows('s', 'raw_id, sid', _json_list("(s -> 'tokens')"))}
  UNION ALL SELECT raw_id, 'candidate', mid, i, v ->> 'entity_id' FROM {_json_rows('lists', 'raw_id, mid', _json_list('c'))} UNION ALL SELECT raw_id, 'candidate', mid, i, CASE WHEN json_type(c -> ('/' || key)) <> 'NULL' THEN key END FROM k)
 SELECT DISTINCT raw_id, child_kind, parent_id, i::BIGINT AS child_no, child_id FROM x WHERE parent_id IS NOT NULL AND child_id IS NOT NULL"""


def oracle_sql() -> dict[str, str]:
    q = {
        "p2_found": _LINKS,
        "normalize_documents": f"SELECT doc_id, {_strip(_NORM)} AS text FROM documents",
        "split_sentences": f"""WITH n AS (SELECT doc_id, {_strip(_NORM)} AS t FROM documents), p AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) - 1 AS paragraph_index FROM (SELECT doc_id, list_filter(list_transform(string_split(t, chr(10) || chr(10)), lambda x: {_strip('x')}), lambda x: x <> '') AS ps FROM n)),
 x AS (SELECT doc_id, paragraph_index, unnest(ss) AS text, generate_subscripts(ss, 1) AS k FROM (SELECT doc_id, paragraph_index, list_filter(list_transform(string_split(regexp_replace(p, '([。！？!?])\\s*', '\\1' || chr(1), 'g'), chr(1)), lambda x: {_strip('x')}), lambda x: x <> '' AND x NOT IN ('。', '！', '？')) AS ss FROM p))
 SELECT doc_id, paragraph_index::BIGINT AS paragraph_index, row_number() OVER (PARTITION BY doc_id ORDER BY paragraph_index, k) AS sentence_index, text FROM x WHERE length(text) >= 6""",
        "slug_titles": """SELECT doc_id, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(title, '[^\\p{L}\\p{N}_\\x{4e00}-\\x{9fff}-]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'document') AS slug,
 coalesce(title, '') <> '' AND NOT regexp_matches(regexp_replace(coalesce(title, ''), '[\\x00-\\x7F\\x{4e00}-\\x{9fff}]', '', 'g'), '\\p{L}') AS zh_or_en FROM documents""",
        "tokenize_offsets": f"""WITH {S}, x AS (SELECT sentence_id, regexp_extract_all(text, {_sq(_RE2)}) AS ps FROM s WHERE text IS NOT NULL), y AS (SELECT sentence_id, unnest(ps) AS token, generate_subscripts(ps, 1) AS k FROM x),
 z AS (SELECT *, sum(length(token)) OVER (PARTITION BY sentence_id ORDER BY k) AS e, regexp_matches(token, '^\\s') AS blank FROM y)
 SELECT sentence_id, (row_number() OVER (PARTITION BY sentence_id ORDER BY k) - 1) AS token_index, token, (e - length(token))::BIGINT AS start, e::BIGINT AS "end" FROM z WHERE NOT blank""",
        "token_features": f"""WITH {S}, x AS (SELECT sentence_id, unnest(tokens).text AS token, generate_subscripts(tokens, 1) - 1 AS token_index FROM s), y AS (SELECT *, lag(token) OVER w AS p, lead(token) OVER w AS n FROM x WINDOW w AS (PARTITION BY sentence_id ORDER BY token_index))
 SELECT sentence_id, token_index::BIGINT AS token_index, token, lower(token) AS lower, substring(token, 1, 1) AS first1, substring(token, 1, 2) AS first2, right(token, 1) AS last1, right(token, 2) AS last2, regexp_full_match(token, '\\p{{Nd}}+') AS is_digit, regexp_full_match(token, '[\\x00-\\x7F]*') AS is_ascii, length(token) AS len, regexp_matches(token, '[\\x{{4e00}}-\\x{{9fff}}]') AS has_han,
 p AS prev_token, regexp_full_match(p, '\\p{{Nd}}+') AS prev_is_digit, n AS next_token, regexp_full_match(n, '\\p{{Nd}}+') AS next_is_digit, p IS NULL AS bos, n IS NULL AS eos FROM y WHERE token IS NOT NULL""",
        "feature_buckets": f"""WITH {S}, {W}, x AS (SELECT {_strip('word')} AS t FROM w) SELECT (CASE WHEN t = '' THEN 0 WHEN NOT regexp_matches(t, '[\\p{{L}}\\p{{N}}]') THEN 1 WHEN regexp_matches(t, '\\p{{Nd}}') AND NOT regexp_matches(t, '[\\x{{4e00}}-\\x{{9fff}}]') THEN 2 + least(length(t), 10)
 WHEN regexp_matches(t, '[A-Za-z]') AND NOT regexp_matches(t, '[\\x{{4e00}}-\\x{{9fff}}]') THEN 13 + least(length(t), 10) WHEN regexp_matches(t, '[A-Za-z]') THEN 24 + least(length(t), 10) ELSE 35 + (unicode(t) // 500) % 10 END)::BIGINT AS bucket, count(*) AS tokens FROM x GROUP BY 1""",
        "mention_contexts": f"""WITH {S}, {M} SELECT mention_id, substring(s.text, greatest(start - 30, 0) + 1, "end" + 30 - greatest(start - 30, 0)) AS context FROM m JOIN s USING (sentence_id) WHERE s.text IS NOT NULL AND start IS NOT NULL AND "end" IS NOT NULL""",
        "text_chunks": """SELECT doc_id, i AS chunk_no, length(substring(text, i * 5000 + 1, 5000)) AS chars, md5(substring(text, i * 5000 + 1, 5000)) AS digest FROM (SELECT doc_id, text, unnest(generate_series(0, (length(text) - 1) // 5000)) AS i FROM documents WHERE length(text) > 0)""",
        "alias_index": f"WITH {A} SELECT * FROM a",
        "gazetteer_candidates": f'WITH {S}, {A}, {_FOUND} SELECT sentence_id, start, "end", text, entity_id, entity_type FROM found',
        "gazetteer_mentions": f"""WITH {S}, {A}, {_FOUND}, g AS (SELECT sentence_id, list_sort(list({{'s': start, 'n': -"end", 'r': alias_rank, 't': text, 'e': entity_id, 'k': entity_type}})) AS l FROM found GROUP BY sentence_id),
 k AS (SELECT sentence_id, {_GREEDY.format(bad='x[1].s < -acc[len(acc)].n')} AS kept FROM g), u AS (SELECT sentence_id, unnest(kept) AS x, generate_subscripts(kept, 1) AS no FROM k)
 SELECT printf('%s-g%03d', sentence_id, no) AS mention_id, sentence_id, x.s AS start, -x.n AS "end", x.t AS text, x.e AS entity_id, x.k AS entity_type FROM u""",
        "merge_mentions": f"""WITH {M}, g AS (SELECT sentence_id, list_sort(list({{'l': source <> 'gazetteer', 'n': start - "end", 's': start, 'r': CASE source WHEN 'gazetteer' THEN 1 WHEN 'crf' THEN 2 WHEN 'hmm' THEN 3 ELSE 4 END, 'm': mention_id, 'e': "end", 'src': source}})) AS l FROM m WHERE sentence_id IS NOT NULL AND start IS NOT NULL AND "end" IS NOT NULL AND source IS NOT NULL GROUP BY sentence_id),
 k AS (SELECT sentence_id, {_GREEDY.format(bad='len(list_filter(acc, lambda y: x[1].s < y.e AND x[1].e > y.s)) > 0')} AS kept FROM g), u AS (SELECT sentence_id, unnest(kept) AS x FROM k)
 SELECT sentence_id, row_number() OVER (PARTITION BY sentence_id ORDER BY x.s, x.e) AS merged_no, x.m AS mention_id, x.s::BIGINT AS start, x.e::BIGINT AS "end", x.src AS source FROM u""",
        "bio_labels": f'WITH {S}, {M}, {_LABEL} SELECT sentence_id, token_index::BIGINT AS token_index, token, start::BIGINT AS start, "end"::BIGINT AS "end", label FROM lab WHERE token IS NOT NULL',
        "bio_decode": f"""WITH {S}, {M}, {_LABEL}, k AS (SELECT *, CASE WHEN label <> 'O' THEN substring(label, 3) END AS kind FROM lab), b AS (SELECT *, lag(kind) OVER (PARTITION BY sentence_id ORDER BY token_index) AS before FROM k),
 i AS (SELECT *, sum(CASE WHEN kind IS NOT NULL AND (label LIKE 'B-%' OR kind IS DISTINCT FROM before) THEN 1 ELSE 0 END) OVER (PARTITION BY sentence_id ORDER BY token_index) AS island FROM b),
 g AS (SELECT sentence_id, island, any_value(kind) AS entity_type, min(start) AS start, max("end") AS "end" FROM i WHERE kind IS NOT NULL GROUP BY 1, 2)
 SELECT sentence_id, row_number() OVER (PARTITION BY sentence_id ORDER BY island) AS span_no, entity_type, start::BIGINT AS start, "end"::BIGINT AS "end" FROM g""",
        "ner_method_stats": f"WITH {M} SELECT source, CASE WHEN grouping(entity_type) = 1 THEN '*' ELSE coalesce(entity_type, '?') END AS entity_type, count(*) AS mentions, count(DISTINCT text) AS texts FROM m GROUP BY GROUPING SETS ((source), (source, entity_type))",
        "ner_overlap_matrix": f'WITH {M}, x AS (SELECT DISTINCT sentence_id, start, "end", source FROM m WHERE sentence_id IS NOT NULL AND source IS NOT NULL) SELECT p.source AS a, q.source AS b, count(*) AS spans FROM x p JOIN x q ON p.sentence_id = q.sentence_id AND p.start = q.start AND p."end" = q."end" GROUP BY 1, 2',
        "boundary_metrics": f"""WITH {S}, m0 AS ({_FIRST.format(t='mentions', k='mention_id')}), m AS (SELECT * FROM m0 WHERE linked_entity_id IS NOT NULL), {_COVER} SELECT count(*) AS mentions, coalesce(round(avg(CASE WHEN covered[1].s = start AND covered[len(covered)].e = "end" THEN 1.0 ELSE 0.0 END), 4), 0) AS aligned_rate, coalesce(round(avg(len(covered)), 4), 0) AS mean_tokens, coalesce(round(avg(CASE WHEN len(covered) = 1 THEN 1.0 ELSE 0.0 END), 4), 0) AS single_rate FROM c""",
        "tfidf_terms": f"WITH {S}, dt AS (SELECT document_id AS id, lower(unnest(tokens).text) AS term FROM s), {_fit('x', 'dt')} SELECT id, term, round(weight, 6) AS weight FROM x_w",
        "tfidf_top_terms": f"WITH {S}, {W}, {STOP}, {_PT} SELECT word, round(score, 6) AS score FROM sc",
        "alias_cosine_top15": f"WITH {M}, {A}, {_SIM} SELECT key, alias_rank, entity_id, round(cosine, 6) AS cosine FROM top15",
        "link_mentions": f"""WITH {S}, {M}, {A}, {_SIM}, cand AS (SELECT key, entity_id, max(sc) AS alias_score, min(place) AS place FROM (SELECT key, entity_id, 1.0::DOUBLE AS sc, 0 AS place FROM keys JOIN a ON lower(alias) = key UNION ALL SELECT key, entity_id, cosine, alias_rank FROM top15) GROUP BY 1, 2),
 prof AS (SELECT id, lower(unnest(list_filter(regexp_extract_all(array_to_string(list_concat([name], coalesce(aliases, []), [coalesce(description, '')]), ' '), {_sq(_RE2)}), lambda w: NOT regexp_matches(w, '^\\s')))) AS term FROM entities), {_fit('pr', 'prof')},
 sw AS (SELECT sentence_id AS id, lower(unnest(tokens).text) AS term FROM s), sw_tf AS (SELECT id, term, count(*) AS tf FROM sw WHERE term IS NOT NULL GROUP BY 1, 2), sw_w AS ({_weights('sw_tf', 'pr_v')}), ctx AS (SELECT sw_w.id AS sentence_id, pr_w.id AS entity_id, sum(sw_w.weight * pr_w.weight) AS c FROM sw_w JOIN pr_w USING (term) GROUP BY 1, 2),
 j AS (SELECT m.mention_id, cand.entity_id, place, round(round(0.4 * alias_score + 0.2 * least(coalesce(c, 0), 1) + CASE WHEN m.entity_type = e.entity_type THEN 0.3 ELSE 0 END, 9), 4) AS final FROM m JOIN cand ON cand.key = lower({_strip('m.text')}) JOIN entities e ON e.id = cand.entity_id LEFT JOIN ctx ON ctx.sentence_id = m.sentence_id AND ctx.entity_id = cand.entity_id WHERE m.sentence_id IS NOT NULL),
 r AS (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY final DESC, place, entity_id) AS rk FROM j), g AS (SELECT mention_id, count(*) AS n, max(CASE WHEN rk = 1 THEN final END) AS top, max(CASE WHEN rk = 1 THEN entity_id END) AS best, avg(CASE WHEN rk <= 3 THEN final END) AS m3 FROM r GROUP BY 1),
 d AS (SELECT m.mention_id, top, best, coalesce(top >= CASE WHEN n >= 2 THEN greatest(0.3, round(0.55 * m3, 9)) ELSE 0.4 END, false) AS ok FROM m LEFT JOIN g USING (mention_id))
 SELECT mention_id, CASE WHEN ok THEN best END AS linked_entity_id, CASE WHEN ok THEN top ELSE 0 END AS link_score, NOT ok AS is_nil FROM d""",
        "self_link_removal": f"WITH {M} SELECT e.id, count(*) AS mentions, count(*) FILTER (trim(m.text) = e.name) AS same FROM m JOIN entities e ON e.id = m.linked_entity_id GROUP BY e.id HAVING count(*) >= 5 AND count(*) FILTER (trim(m.text) = e.name) > 0.95 * count(*)",
        "trigger_matches": f"WITH {S}, {_TRIG} SELECT * FROM tr",
        "pattern_triples": f"""WITH {S}, {M}, {_LINKED}, {_TRIG}, su AS {_role('subject')}, ob AS {_role('object')},
 p AS (SELECT su.sentence_id, su.relation_id, su.pattern, su.t_start, su.t_end, su.rk AS sr, ob.rk AS orr, su.e AS se, ob.e AS oe, su.score AS ss, ob.score AS os, false AS sym FROM su JOIN ob USING ({_KEY}) JOIN s ON s.sentence_id = su.sentence_id WHERE NOT su.sym AND su.e <> ob.e AND len(list_filter(coalesce(su.neg, []), lambda x: contains(substring(s.text, least(su.t_start, ob.start) + 1, greatest(su.t_end, ob."end") - least(su.t_start, ob.start)), x))) = 0
 UNION ALL SELECT su.sentence_id, su.relation_id, su.pattern, su.t_start, su.t_end, su.rk, o.rk, su.e, o.e, su.score, o.score, true FROM su JOIN su o USING ({_KEY}) WHERE su.sym AND su.rk < o.rk AND su.e <> o.e),
 one AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY sr, orr) = 1), made AS (SELECT {_KEY}, CASE WHEN sym AND se > oe THEN oe ELSE se END AS subject, CASE WHEN sym AND se > oe THEN se ELSE oe END AS object, round((ss + os) / 2, 6) AS confidence FROM one)
 SELECT sentence_id, relation_id, subject, object, pattern, confidence FROM made QUALIFY row_number() OVER (PARTITION BY sentence_id, relation_id, subject, object ORDER BY t_start, t_end, pattern) = 1""",
        "cooccurrence_pairs": f"WITH {M}, x AS (SELECT DISTINCT sentence_id, linked_entity_id AS e FROM m WHERE NOT coalesce(is_nil, false) AND linked_entity_id IS NOT NULL AND sentence_id IS NOT NULL) SELECT p.e AS a, q.e AS b, count(*) AS sentences FROM x p JOIN x q ON p.sentence_id = q.sentence_id AND p.e < q.e GROUP BY 1, 2 HAVING count(*) >= 2",
        "cooccurrence_triples": f"""WITH {S}, {M}, x AS (SELECT sentence_id, linked_entity_id AS e, start, "end" FROM m WHERE NOT coalesce(is_nil, false) AND linked_entity_id IS NOT NULL AND sentence_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sentence_id, linked_entity_id ORDER BY mention_id DESC) = 1),
 p AS (SELECT x.sentence_id, x.e AS a, y.e AS b, least(x.start, y.start) AS lo, greatest(x."end", y."end") AS hi FROM x JOIN x y ON x.sentence_id = y.sentence_id AND x.e < y.e), often AS (SELECT a, b FROM p GROUP BY 1, 2 HAVING count(*) >= 2),
 c AS (SELECT o.a, o.b, r.id AS relation_id, r.patterns, list_contains(r.subject_types, ea.entity_type) AND list_contains(r.object_types, eb.entity_type) AS fwd, list_contains(r.subject_types, eb.entity_type) AND list_contains(r.object_types, ea.entity_type) AS bwd FROM often o JOIN entities ea ON ea.id = o.a JOIN entities eb ON eb.id = o.b, relations r),
 j AS (SELECT c.relation_id, CASE WHEN fwd THEN c.a ELSE c.b END AS subject, CASE WHEN fwd THEN c.b ELSE c.a END AS object, p.sentence_id, list_filter(c.patterns, lambda z: contains(substring(s.text, lo + 1, hi - lo), z))[1] AS pattern, left(s.text, 150) AS ev FROM c JOIN p ON p.a = c.a AND p.b = c.b JOIN s USING (sentence_id) WHERE fwd OR bwd)
 SELECT 'cooccur:' || subject || ':' || relation_id || ':' || object AS triple_id, arg_min(sentence_id, sentence_id) AS sentence_id, relation_id, subject, object, arg_min(pattern, sentence_id) AS pattern, count(*) AS matched, least(round(0.5 + 0.05 * count(*), 4), 0.9) AS confidence, arg_min(ev, sentence_id) AS evidence FROM j WHERE pattern IS NOT NULL GROUP BY relation_id, subject, object""",
        "triple_argmax": f"WITH {T} SELECT triple_id, subject, relation_id, object, confidence, source FROM f QUALIFY row_number() OVER (PARTITION BY subject, relation_id, object ORDER BY confidence DESC NULLS LAST, triple_id) = 1",
        "relation_conflicts": f"WITH {T}, x AS (SELECT *, min(relation_id) OVER p <> max(relation_id) OVER p AS many, row_number() OVER (PARTITION BY subject, object ORDER BY confidence DESC NULLS LAST, relation_id, triple_id) AS rn FROM f WINDOW p AS (PARTITION BY subject, object)) SELECT triple_id, subject, relation_id, object, confidence, source FROM x WHERE NOT many OR rn = 1",
        "pair_conflicts": f"WITH {T}, x AS (SELECT *, min(relation_id) OVER p <> max(relation_id) OVER p AS many, row_number() OVER (PARTITION BY least(subject, object), greatest(subject, object) ORDER BY CASE source WHEN 'extracted' THEN 3 WHEN 'dependency_path' THEN 2 WHEN 'cooccurrence' THEN 1 ELSE 0 END DESC, confidence DESC NULLS LAST, triple_id) AS rn FROM f WINDOW p AS (PARTITION BY least(subject, object), greatest(subject, object))) SELECT triple_id, subject, relation_id, object, confidence, source FROM x WHERE NOT many OR rn = 1",
        "fragment_filter": f"WITH {T}, bad AS (SELECT s.id FROM entities s WHERE starts_with(s.id, 'concept_') AND length(s.name) <= 3 AND EXISTS (SELECT 1 FROM entities l WHERE length(l.name) > length(s.name) AND contains(l.name, s.name))) SELECT triple_id, subject, object, subject IN (SELECT id FROM bad) OR object IN (SELECT id FROM bad) AS is_fragment FROM f",
        "edge_aggregate": f"""WITH {T}, r AS (SELECT *, row_number() OVER (PARTITION BY subject, object, relation_id ORDER BY triple_id) AS rn FROM f WHERE subject IS NOT NULL AND object IS NOT NULL AND relation_id IS NOT NULL)
 SELECT subject AS "from", object AS "to", arg_min(relation_label, triple_id) AS label, relation_id, count(*) AS value, round(avg(confidence), 6) AS avg_confidence, array_to_string(list_sort(list_distinct(list(source))), '+') AS source, array_to_string(list(coalesce(evidence, '') ORDER BY rn) FILTER (rn <= 3), chr(10)) AS evidence FROM r GROUP BY subject, object, relation_id""",
        "center_component": f"WITH RECURSIVE {T}, {_REACH} SELECT id FROM reach",
        "component_ratio": f"WITH RECURSIVE {T}, {M}, {_DEG}, {_REACH}, n AS (SELECT id FROM mc UNION SELECT id FROM deg) SELECT count(*) AS nodes, count(*) FILTER (id IN (SELECT id FROM reach)) AS reached, round(count(*) FILTER (id IN (SELECT id FROM reach)) / count(*), 4) AS ratio FROM n",
        "graph_nodes_full": f"WITH {T}, {M}, {_DEG} {_NODES} (SELECT id FROM mc UNION SELECT id FROM deg)",
        "graph_nodes_focused": f"WITH RECURSIVE {T}, {M}, {_DEG}, {_REACH} {_NODES} (SELECT id FROM reach)",
        "projection_stats": f"""WITH RECURSIVE {T}, {M}, {_DEG}, {_REACH}, e AS (SELECT DISTINCT subject, object, relation_id FROM f) SELECT 'full_nodes' AS metric, count(*) AS value FROM (SELECT id FROM mc UNION SELECT id FROM deg) UNION ALL SELECT 'full_edges', count(*) FROM e UNION ALL SELECT 'focused_nodes', count(*) FROM reach
 UNION ALL SELECT 'focused_edges', count(*) FROM e WHERE subject IN (SELECT id FROM reach) AND object IN (SELECT id FROM reach) UNION ALL SELECT 'isolated_nodes', count(*) FROM mc WHERE id NOT IN (SELECT id FROM deg)""",
        "node_search": f"WITH {T}, {M}, {_DEG}, x AS ({_NODES} (SELECT id FROM mc UNION SELECT id FROM deg)) SELECT * FROM x WHERE contains(lower(label), 'irene') OR contains(lower(id), 'irene')",
        "budgeted_graph": f"""WITH {T}, w AS (SELECT subject AS "from", object AS "to", count(*) AS value FROM f WHERE object <> '{CENTER}' GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (ORDER BY value DESC, "from", "to") AS rk FROM w), n AS (SELECT *, rk = min(rk) OVER (PARTITION BY "to") AS first FROM o), c AS (SELECT *, sum(CASE WHEN first THEN 1 ELSE 0 END) OVER (ORDER BY rk) AS seen FROM n)
 SELECT "from", "to", value FROM c WHERE seen <= 49""",
        "confidence_histogram": f"""WITH {T}, b(bucket, lo, hi) AS (VALUES ('0.0-0.5', -1e9, 0.5), ('0.5-0.6', 0.5, 0.6), ('0.6-0.7', 0.6, 0.7), ('0.7-0.8', 0.7, 0.8), ('0.8-0.9', 0.8, 0.9), ('0.9+', 0.9, 1e9)) SELECT bucket, count(f.triple_id) AS facts FROM b LEFT JOIN f ON f.confidence >= b.lo::DOUBLE AND f.confidence < b.hi::DOUBLE GROUP BY 1""",
        "entity_rows": f"WITH {T}, {M}, {_DEG} SELECT e.id AS entity_id, name, entity_type AS type, coalesce(array_to_string(aliases, '|'), '') AS aliases, description, coalesce(mentions, 0) AS mention_count, coalesce(degree, 0) AS degree FROM entities e LEFT JOIN mc ON mc.id = e.id LEFT JOIN deg ON deg.id = e.id",
        "relation_rows": f"WITH {T}, n AS (SELECT relation_id, count(*) AS c, min(relation_label) AS l FROM f WHERE relation_id IS NOT NULL GROUP BY 1) SELECT coalesce(r.id, n.relation_id) AS relation_id, coalesce(r.label, n.l) AS label, coalesce(array_to_string(subject_types, '|'), '') AS subject_types, coalesce(array_to_string(object_types, '|'), '') AS object_types, CASE WHEN r.id IS NULL THEN 'reasoning' ELSE 'schema' END AS source, coalesce(n.c, 0) AS triple_count FROM relations r FULL JOIN n ON n.relation_id = r.id",
        "fact_rows": f"WITH {T} SELECT triple_id, subject AS subject_id, subject_name, relation_id, relation_label, object AS object_id, object_name, confidence, source, document_id, sentence_id, evidence, coalesce(array_to_string(support_triple_ids, '|'), '') AS support_triple_ids FROM f",
        "rdf_lines": f"WITH {T} SELECT DISTINCT '<urn:kg:entity/' || subject || '> <urn:kg:relation/' || relation_id || '> <urn:kg:entity/' || object || '> .' AS line FROM f WHERE subject IS NOT NULL AND object IS NOT NULL AND relation_id IS NOT NULL",
        "center_neighborhood": f"WITH {T}, x AS (SELECT triple_id, subject, relation_id, object, source, confidence, row_number() OVER (ORDER BY triple_id) AS rank, count(*) OVER () AS total FROM f WHERE subject = '{CENTER}' OR object = '{CENTER}') SELECT * FROM x WHERE rank <= 20",
        "relation_distribution": f"WITH {T} SELECT relation_id, count(*) AS facts FROM f GROUP BY 1",
        "inferred_facts": f"WITH {T} SELECT triple_id, subject, relation_id, object, confidence, coalesce(len(support_triple_ids), 0) AS support_count, coalesce(array_to_string(support_triple_ids[1:5], '|'), '') AS first_supports FROM f WHERE source = 'inferred' ORDER BY triple_id LIMIT 20",
        "evidence_samples": f"WITH {T} SELECT relation_id, triple_id, evidence, row_number() OVER (PARTITION BY relation_id ORDER BY triple_id) AS rank FROM f WHERE relation_id IS NOT NULL QUALIFY rank <= 3",
        "pipeline_metrics": f"""WITH {S}, {M}, {T}, {_DEG}, p AS (SELECT min(relation_id) <> max(relation_id) AS conflict FROM f GROUP BY subject, object), x AS (
 SELECT 'mentions' AS metric, count(*)::DOUBLE AS value FROM m UNION ALL SELECT 'nil_rate', coalesce(round(round(avg(coalesce(is_nil, false)::INT::DOUBLE), 9), 4), 0) FROM m UNION ALL SELECT 'average_link_score', coalesce(round(round(avg(link_score) FILTER (NOT coalesce(is_nil, false)), 9), 4), 0) FROM m UNION ALL SELECT 'linked_entities', count(DISTINCT linked_entity_id) FROM m
 UNION ALL SELECT 'sentences', count(*) FROM s UNION ALL SELECT 'tokens', coalesce(sum(len(tokens)), 0) FROM s UNION ALL SELECT 'triples', count(*) FROM f UNION ALL SELECT 'triples_extracted', count(*) FILTER (source = 'extracted') FROM f UNION ALL SELECT 'triples_cooccurrence', count(*) FILTER (source = 'cooccurrence') FROM f UNION ALL SELECT 'triples_inferred', count(*) FILTER (source = 'inferred') FROM f
 UNION ALL SELECT 'orphan_ratio', coalesce(round(round(avg((id NOT IN (SELECT id FROM deg))::INT::DOUBLE), 9), 4), 0) FROM mc UNION ALL SELECT 'conflict_pair_ratio', coalesce(round(round(avg(coalesce(conflict, false)::INT::DOUBLE), 9), 4), 0) FROM p UNION ALL SELECT 'triple_nodes', count(*) FROM deg) SELECT metric, value::DOUBLE AS value FROM x""",
        "quality_metrics": f"""WITH RECURSIVE {S}, {M}, {T}, {_DEG}, {_REACH}, e3 AS (SELECT subject AS a, object AS b FROM f WHERE subject IN (SELECT id FROM mc) AND object IN (SELECT id FROM mc) AND subject <> object UNION SELECT object, subject FROM f WHERE subject IN (SELECT id FROM mc) AND object IN (SELECT id FROM mc) AND subject <> object),
 r3(id) AS (SELECT '{CENTER}' UNION SELECT e3.b FROM r3 JOIN e3 ON e3.a = r3.id), fe AS (SELECT subject, object, relation_id, count(*) AS v FROM f WHERE subject IN (SELECT id FROM reach) AND object IN (SELECT id FROM reach) GROUP BY ALL),
 cov AS (SELECT m.mention_id, m.source, coalesce(m.is_nil, false) AS nil, m.start, m."end", list_filter(list_transform(s.tokens, lambda t, i: {{'i': i - 1, 's': t.start, 'e': t."end"}}), lambda t: t.s < m."end" AND t.e > m.start) AS covered FROM m JOIN s USING (sentence_id)),
 k(name) AS (VALUES ('linked'), ('gazetteer')), c AS (SELECT k.name, cov.* FROM k LEFT JOIN cov ON len(covered) > 0 AND CASE k.name WHEN 'linked' THEN NOT nil ELSE source = 'gazetteer' END)
 SELECT 'raw_center_component_ratio' AS metric, (SELECT coalesce(round(count(*) FILTER (id IN (SELECT id FROM r3)) / nullif(count(*), 0), 4), 0) FROM mc)::DOUBLE AS value
 UNION ALL SELECT 'projected_center_component_ratio', 1.0 UNION ALL SELECT 'projected_orphan_node_ratio', 0.0
 UNION ALL SELECT 'single_support_edge_ratio', coalesce(round(avg((v = 1)::INT::DOUBLE), 4), 0) FROM fe UNION ALL SELECT 'average_edge_support', coalesce(round(avg(v), 4), 0) FROM fe
 UNION ALL SELECT name || '_token_mentions', count(mention_id) FROM c GROUP BY name UNION ALL SELECT name || '_boundary_alignment_rate', coalesce(round(avg(CASE WHEN covered[1].s = start AND covered[len(covered)].e = "end" THEN 1.0 ELSE 0.0 END) FILTER (mention_id IS NOT NULL), 4), 0) FROM c GROUP BY name
 UNION ALL SELECT name || '_fragmentation_mean', coalesce(round(avg(len(covered)), 4), 0) FROM c GROUP BY name UNION ALL SELECT name || '_single_token_rate', coalesce(round(avg(CASE WHEN len(covered) = 1 THEN 1.0 ELSE 0.0 END) FILTER (mention_id IS NOT NULL), 4), 0) FROM c GROUP BY name
 UNION ALL SELECT 'average_sentence_tokens', coalesce(round(avg(coalesce(len(tokens), 0)), 4), 0) FROM s
 UNION ALL SELECT 'projection_full_nodes', count(*) FROM (SELECT id FROM mc UNION SELECT id FROM deg) UNION ALL SELECT 'projection_full_edges', count(*) FROM (SELECT DISTINCT subject, object, relation_id FROM f) UNION ALL SELECT 'projection_focused_nodes', count(*) FROM reach
 UNION ALL SELECT 'projection_focused_edges', count(*) FROM fe UNION ALL SELECT 'projection_isolated_nodes', count(*) FROM mc WHERE id NOT IN (SELECT id FROM deg)""",
        "conflicting_pairs": f"WITH {T}, g AS (SELECT subject, object, list_sort(list(DISTINCT relation_id)) AS r FROM f WHERE subject IS NOT NULL AND object IS NOT NULL AND relation_id IS NOT NULL GROUP BY 1, 2) SELECT subject || '->' || object AS pair, array_to_string(r, '|') AS relations FROM g WHERE len(r) > 1",
        "run_summary": f"""WITH {S}, {M}, {T} SELECT 'document_count' AS metric, count(*)::DOUBLE AS value FROM documents WHERE doc_id IS NOT NULL UNION ALL SELECT 'sentence_count', count(*) FROM s UNION ALL SELECT 'entity_mention_count', count(*) FROM m WHERE source IN ('gazetteer', 'crf') UNION ALL SELECT 'linked_mention_count', count(*) FROM m WHERE NOT coalesce(is_nil, false)
 UNION ALL SELECT 'triple_count', count(*) FROM f UNION ALL SELECT 'asserted_triple_count', count(*) FROM f WHERE source = 'extracted' UNION ALL SELECT 'inferred_triple_count', count(*) FROM f WHERE source = 'inferred'""",
        "graph_tables": f"""WITH {T}, w AS (SELECT subject AS "from", object AS "to", count(*) AS value FROM f WHERE object <> '{CENTER}' GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (ORDER BY value DESC, "from", "to") AS rk FROM w), n AS (SELECT *, rk = min(rk) OVER (PARTITION BY "to") AS first FROM o), c AS (SELECT *, sum(CASE WHEN first THEN 1 ELSE 0 END) OVER (ORDER BY rk) AS seen FROM n),
 b AS (SELECT "from", "to", value FROM c WHERE seen <= 49) SELECT 'node' AS kind, x.id, coalesce(e.name, x.id) AS label, NULL::VARCHAR AS "to", NULL::BIGINT AS value FROM (SELECT "from" AS id FROM b UNION SELECT "to" FROM b) x LEFT JOIN entities e ON e.id = x.id UNION ALL SELECT 'edge', "from", NULL, "to", value FROM b""",
        "node_neighborhood": f"""WITH {T}, {M}, {_DEG}, x AS ({_NODES} (SELECT id FROM mc UNION SELECT id FROM deg)), q AS (SELECT id FROM x WHERE contains(lower(label), 'irene') OR contains(lower(id), 'irene')), nb AS (SELECT object AS id FROM f WHERE subject IN (SELECT id FROM q) UNION SELECT subject FROM f WHERE object IN (SELECT id FROM q))
 SELECT id, label, CASE WHEN id IN (SELECT id FROM q) THEN 'found' ELSE 'neighbour' END AS role FROM x WHERE id IN (SELECT id FROM q UNION SELECT id FROM nb)""",
        "rule_self_join": f"""WITH {T}, g AS (SELECT object AS class_id, subject AS member, max(coalesce(confidence, 0)) AS c, arg_max(triple_id, {{'c': coalesce(confidence, 0), 't': triple_id}}) AS support FROM f WHERE source <> 'inferred' AND relation_id = 'employed_at' AND subject IS NOT NULL AND object IS NOT NULL GROUP BY 1, 2)
 SELECT 'colleague_of' AS relation_id, class_id, min(member) OVER (PARTITION BY class_id) AS representative, member, round(round(c * 0.6, 9), 4) AS confidence, support FROM g QUALIFY count(*) OVER (PARTITION BY class_id) > 1""",
        "word_freq": f"WITH {S}, {W}, {A}, {KNOWN}, {STOP}, {_FREQ} SELECT * FROM fr",
        "neighbour_boost": f"WITH {S}, {W}, {A}, {KNOWN}, {STOP}, {_BOOST} SELECT * FROM bo",
        "context_windows": f"""WITH {S}, {W}, c AS (SELECT word, doc_id, pos, array_to_string(list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), '') AS context FROM w), g AS (SELECT word, context, min({{'d': doc_id, 'p': pos}}) AS place FROM c WHERE length(word) >= 2 GROUP BY 1, 2) SELECT word, row_number() OVER (PARTITION BY word ORDER BY place) AS rank, context FROM g QUALIFY rank <= 3""",
        "discover_candidates": f"WITH {S}, {W}, {A}, {KNOWN}, {STOP}, {_FREQ}, {_BOOST}, {_PT}, {_CAND} SELECT * FROM cand",
        "jsonl_sentences": f"WITH {S} SELECT sentence_id, document_id, paragraph_index::BIGINT AS paragraph_index, sentence_index::BIGINT AS sentence_index, text, coalesce(len(tokens), 0) AS tokens FROM s",
        "exported_facts": f"WITH {T} SELECT triple_id, subject AS subject_id, relation_id, object AS object_id, confidence, source FROM f",
        "exported_lines": f"WITH {T} SELECT DISTINCT '<urn:kg:entity/' || subject || '> <urn:kg:relation/' || relation_id || '> <urn:kg:entity/' || object || '> .' AS line FROM f WHERE subject IS NOT NULL AND object IS NOT NULL AND relation_id IS NOT NULL",
        "document_texts": "SELECT doc_id, length(text) AS chars, md5(text) AS digest FROM documents WHERE doc_id IS NOT NULL",
        "validate_candidates": f"""WITH {S}, {W}, {A}, {KNOWN}, {STOP}, {_FREQ}, {_BOOST}, {_PT}, {_CAND}, top AS (SELECT word AS name FROM cand WHERE confidence >= 0.2 ORDER BY confidence DESC, freq DESC, word LIMIT 80),
 nm AS (SELECT name FROM top WHERE length(name) >= 2 AND NOT regexp_full_match(name, '\p{{Nd}}+') AND NOT (regexp_full_match(name, '[\x00-\x7F]{{1,3}}') AND lower(name) IN ({', '.join(map(_sq, NOISE))})) AND lower(name) NOT IN (SELECT name FROM known)),
 hit AS (SELECT doc_id, name, text, unnest(ps[1:len(ps) - 1]) AS piece, generate_subscripts(ps[1:len(ps) - 1], 1) AS k FROM (SELECT doc_id, name, text, string_split(text, name) AS ps FROM documents JOIN nm ON contains(text, name) WHERE doc_id IS NOT NULL)),
 pos AS (SELECT name, text, sum(length(piece)) OVER (PARTITION BY doc_id, name ORDER BY k) + (k - 1) * length(name) AS place FROM hit), ci AS (SELECT name, substring(text, (greatest(place - 20, 0) + 1)::BIGINT, (place - greatest(place - 20, 0))::BIGINT) AS before FROM pos),
 g AS (SELECT name, count(*) AS occurrences, count(*) FILTER (regexp_matches(before, '[①-⑩0-9]+[．.]') OR contains(right(before, 5), '，')) AS citations FROM ci GROUP BY name)
 SELECT name, occurrences, citations, NOT (occurrences >= 5 AND citations > 0.7 * occurrences) AND occurrences >= 3 AS valid FROM g""",
        "fragment_clusters": f"""WITH {S}, {M}, ctx AS (SELECT linked_entity_id AS e, mention_id, substring(s.text, greatest(start - 40, 0) + 1, "end" + 40 - greatest(start - 40, 0)) AS c FROM m JOIN s USING (sentence_id) JOIN entities en ON en.id = linked_entity_id), n2 AS (SELECT e, count(*) AS n FROM ctx GROUP BY e HAVING count(*) >= 2),
 pr AS (SELECT DISTINCT a.id AS fragment, b.id AS canonical FROM entities a JOIN entities b ON length(a.name) BETWEEN 1 AND 6 AND length(b.name) > 6 AND contains(b.name, a.name) WHERE starts_with(a.id, 'place_') AND a.id <> b.id AND a.id IN (SELECT e FROM n2) AND b.id IN (SELECT e FROM n2)),
 uctx AS (SELECT * FROM ctx WHERE e IN (SELECT fragment FROM pr UNION SELECT canonical FROM pr)), {_fit('fr', _grams('uctx', 'mention_id', 'c', 2, 3))},
 mean AS (SELECT e, term, sum(weight) / any_value(n) AS v FROM fr_w JOIN uctx ON uctx.mention_id = fr_w.id JOIN n2 USING (e) GROUP BY e, term),
 sim AS (SELECT fragment, canonical, round(sum(x.v * y.v), 9) AS similarity FROM pr JOIN mean x ON x.e = fragment JOIN mean y ON y.e = canonical AND y.term = x.term GROUP BY 1, 2)
 SELECT fragment, canonical, round(similarity, 6) AS similarity FROM sim WHERE similarity >= 0.05 QUALIFY row_number() OVER (PARTITION BY fragment ORDER BY similarity DESC, canonical) = 1""",
        "hmm_init": f"WITH {S}, {M}, {_LABEL} SELECT label, count(*) AS n FROM lab WHERE token_index = 0 AND token IS NOT NULL GROUP BY 1",
        "hmm_transition": f'WITH {S}, {M}, {_LABEL}, x AS (SELECT label, lead(label) OVER (PARTITION BY sentence_id ORDER BY token_index) AS next FROM lab WHERE token IS NOT NULL) SELECT label, next, count(*) AS n FROM x WHERE next IS NOT NULL GROUP BY 1, 2',
        "hmm_emission": f"WITH {S}, {M}, {_LABEL} SELECT label, token, count(*) AS n FROM lab WHERE token IS NOT NULL GROUP BY 1, 2",
    }
    return {name: _rule_sql(name) for name in RULES} | q
