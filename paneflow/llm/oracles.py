"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

_LOWER = r"translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

OP1 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
"""

OP7 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, {_WORDS} AS w FROM documents),
t AS (SELECT k, generate_subscripts(w, 1) AS i, unnest(w) AS w FROM d),
u AS (SELECT w, count(*) AS n FROM t GROUP BY w),
total AS (SELECT count(*)::DOUBLE AS n FROM t),
b AS (SELECT k, i, lag(w) OVER (PARTITION BY k ORDER BY i) AS v, w FROM t),
c AS (SELECT v, w, count(*) AS n FROM b WHERE v IS NOT NULL GROUP BY v, w),
s AS (SELECT b.k, sum(CASE WHEN b.v IS NULL THEN ln(uw.n / total.n) WHEN c.n >= 2 THEN ln(c.n::DOUBLE / uv.n) ELSE ln(0.4::DOUBLE * uw.n / total.n) END) AS log_score
      FROM b CROSS JOIN total JOIN u uw ON uw.w = b.w LEFT JOIN u uv ON uv.w = b.v LEFT JOIN c ON c.v = b.v AND c.w = b.w GROUP BY b.k)
SELECT doc_id, len(w)::BIGINT AS n_words, round(coalesce(log_score, 0), 4) + 0.0 AS log_score, round(log_score / nullif(len(w), 0), 6) + 0.0 AS mean_log_score
FROM d LEFT JOIN s USING (k)
"""

OP10 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(w) >= 2 THEN w[i] || ' ' || w[i + 1] ELSE w[1] END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * same >= 80 * (x.n + y.n - same)),
r AS (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT r.a, x.b FROM r JOIN (SELECT a, b FROM e UNION ALL SELECT b, a FROM e) x ON x.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS low FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c.low, d.doc_id)) AS component_id, least(d.doc_id, coalesce(c.low, d.doc_id)) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"

OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_TERMS} AS w FROM documents),
t AS (SELECT k, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
cells AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
p AS (SELECT *, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS p FROM cells),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q FROM (SELECT lang, term, sum(n) AS n FROM cells GROUP BY lang, term)),
g AS (SELECT DISTINCT lang, source FROM d),
pairs AS (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value FROM pairs LEFT JOIN far USING (lang, source, item)
      UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r) WHERE part = 'pair' OR rank <= 50
"""

OP13 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM (SELECT unnest([0, 1]) AS i)),
x AS (SELECT *, regexp_replace(text, '([<\[])(\\*)(s>|/s>|ROLE\]|/ROLE\]|IMG\]|AUDIO\]|DOC\]|INST\]|/INST\]|SYS\]|/SYS\]|\|im_start\|>|\|im_end\|>|\|endoftext\|>)', '\1\\\2\3', 'g') AS written FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
sum(20 + length(role) + length(written))::BIGINT AS formatted_chars, 0::BIGINT AS n_attachments, 0::BIGINT AS placeholder_tokens
FROM x GROUP BY conv_id
"""

ORACLES = {"op1_warc": OP1, "op7_lm_score": OP7, "op10_near_dedup": OP10, "op11_divergence": OP11, "op13_chat": OP13}
