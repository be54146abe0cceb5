"""SQL for DuckDB of the queries that SQL can express, over the same tables."""

from __future__ import annotations

from . import quality

_COMPONENTS = """reach(id, other) AS (SELECT id, id FROM node UNION SELECT reach.id, link.b FROM reach JOIN link ON link.a = reach.other),
component AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)"""

OP3 = f"""WITH RECURSIVE node AS (SELECT vec_id AS id FROM embeddings),
sound AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
AND len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
link AS (SELECT s.vec_id AS a, t.vec_id AS b FROM sound s JOIN sound t ON s.label = t.label AND s.vec_id <> t.vec_id AND len(s.x) = len(t.x) WHERE list_cosine_similarity(s.x, t.x) >= 0.98),
{_COMPONENTS}
SELECT id AS vec_id, (SELECT count(*) FROM link WHERE a = id) AS n_links, component_id, id = component_id AS kept FROM component"""

_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"

OP10 = f"""WITH RECURSIVE node AS (SELECT doc_id AS id FROM documents),
word AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
shingle AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM word WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
pair AS (SELECT s.doc_id AS a, t.doc_id AS b, count(*) AS k FROM shingle s JOIN shingle t ON s.s = t.s AND s.doc_id <> t.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
{_COMPONENTS}
SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, component_id FROM component LEFT JOIN size ON doc_id = id"""


def op8(rules: quality.Rules = quality.Rules()) -> str:
    """The quality verdict. The distances may differ in their last digits, which matters only exactly at a limit."""
    words = quality.WORDS
    common = ", ".join(f"len(list_filter(w, lambda x: x IN ('{c}', '{c.capitalize()}', '{c.upper()}')))" for c in words)
    langs = ", ".join(f"'{x}'" for x in rules.languages)

    def distance(hist: str, ref: str) -> str:
        term = lambda p: f"CASE WHEN {p} > 0 THEN {p} * log2({p} / ((c / t + r / u) / 2)) ELSE 0 END"
        return f"(SELECT CASE WHEN max(t) > 0 THEN sqrt(greatest(sum({term('(c / t)')} + {term('(r / u)')}) / 2, 0)) ELSE 0.0 END FROM (SELECT unnest({hist}) AS c, unnest({ref}) AS r, CAST(greatest(list_sum({hist}), 0) AS DOUBLE) AS t, CAST(list_sum({ref}) AS DOUBLE) AS u))"

    sums = lambda name, n: "[" + ", ".join(f"sum({name}[{i}])" for i in range(1, n + 1)) + "]"
    n = len(words) + 1
    return f"""WITH word AS (SELECT doc_id, CASE WHEN lang IN ({langs}) THEN lang ELSE '' END AS lang, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
joined AS (SELECT *, array_to_string(w, '') AS j, len(w) AS n FROM word),
measured AS (SELECT *, length(j) AS m, length(j) - length(regexp_replace(j, '\\p{{L}}', '', 'g')) AS letters, length(j) - length(regexp_replace(j, '\\p{{Lu}}', '', 'g')) AS upper_, length(j) - length(regexp_replace(j, '\\p{{N}}', '', 'g')) AS digits,
length(j) - length(regexp_replace(j, '[#*$%&|<>]', '', 'g')) AS symbols, [{common}] AS found,
list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
list_transform(range(1, greatest(n - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS windows FROM joined),
hist AS (SELECT *, [letters - upper_, upper_, digits, symbols, m - letters - digits - symbols] AS chars, list_append(found, n - coalesce(list_sum(found), 0)) AS common FROM measured),
place AS (SELECT doc_id, unnest(windows) AS x, unnest(range(1, len(windows) + 1)) AS i FROM hist),
again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS k FROM place),
covered AS (SELECT doc_id, count(DISTINCT p) AS r FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again WHERE k > 1) GROUP BY doc_id),
tested AS (SELECT hist.*, coalesce(r, 0) AS r, n < {rules.min_words} OR 100 * coalesce(r, 0) > {rules.max_repeat_percent} * n AS failed FROM hist LEFT JOIN covered USING (doc_id)),
ref AS (SELECT lang, {sums('chars', 5)} AS rc, {sums('common', n)} AS rw FROM tested WHERE NOT failed GROUP BY lang),
every AS (SELECT {sums('chars', 5)} AS ec, {sums('common', n)} AS ew FROM tested WHERE NOT failed),
known AS (SELECT lang, list_transform(rw, lambda x: x / list_sum(rw)) AS q FROM ref WHERE lang <> ''),
typical AS (SELECT lang, i, coalesce(a / sum(a) OVER (PARTITION BY i) / (1 - q[{n}]), 0) AS t FROM (SELECT lang, q, unnest(range(1, {n})) AS i, unnest(list_slice(q, 1, {n - 1})) AS a FROM known)),
share AS (SELECT doc_id, lang, sum(c * t) AS w FROM (SELECT doc_id, unnest(found) AS c, unnest(range(1, {n})) AS i FROM tested) JOIN typical USING (i) GROUP BY doc_id, lang),
mixed AS (SELECT doc_id, list(x ORDER BY i) AS rm FROM (SELECT doc_id, i, sum(w * p) / sum(w) AS x FROM share JOIN (SELECT lang, unnest(range(1, {n + 1})) AS i, unnest(q) AS p FROM known) USING (lang) GROUP BY doc_id, i HAVING sum(w) > 0) GROUP BY doc_id),
ready AS (SELECT tested.*, CASE WHEN tested.lang = '' THEN ec ELSE rc END AS rc, CASE WHEN tested.lang = '' THEN ew ELSE rw END AS rw, rm FROM tested LEFT JOIN ref ON ref.lang = tested.lang LEFT JOIN mixed USING (doc_id), every),
judged AS (SELECT doc_id, n, m, symbols, len(lines) - len(list_distinct(lines)) AS dup, r, failed,
{distance('chars', 'rc')} AS dc, least({distance('common', 'rw')}, CASE WHEN rm IS NOT NULL THEN {distance('common', 'rm')} END) AS dw FROM ready)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(m AS BIGINT) AS word_chars, CAST(symbols AS BIGINT) AS n_symbols, CAST(dup AS BIGINT) AS n_dup_lines, CAST(r AS BIGINT) AS n_repeat_words, failed AS base_failed,
NOT failed AND NOT (m >= {rules.char_guard} AND dc > {rules.char_floor} + {rules.char_spread} / sqrt(m)) AND NOT (n >= {rules.word_guard} AND dw > {rules.word_floor} + {rules.word_spread} / sqrt(n)) AS kept FROM judged"""
