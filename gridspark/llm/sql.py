"""The same results in DuckDB SQL, for the operators that SQL can express."""

from __future__ import annotations

from gridspark.llm.rules import ERROR, RISK, RULES

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"

TOKEN_ROLLUP = r"""
SELECT source, lang, 'words/2' AS tokenizer, CAST(count(*) AS BIGINT) AS docs,
       CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]'))) AS BIGINT) AS tokens
FROM documents GROUP BY source, lang
"""

_values = ", ".join(f"('{r}', {x})" for r, (_, cuts) in RULES.items() for x in cuts)
_rule = " ".join(f"WHEN '{r}' THEN CASE WHEN {e.split(' / ')[1]} > 0 THEN CAST({e.split(' / ')[0]} AS DOUBLE) / {e.split(' / ')[1]} END" for r, (e, _) in RULES.items())

QUALITY_RULES = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
m AS (
  SELECT r, doc_id, lang, regexp_extract_all(t, '{WORD}') AS w,
         CAST(length(regexp_replace(t, '{SPACE}', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(length(t) - length(translate(t, '!?', '')) AS BIGINT) AS n_marks,
         CAST(len(regexp_extract_all(t, '\\p{{Lu}}')) AS BIGINT) AS n_upper,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls
  FROM t),
win AS (SELECT r, s, array_to_string(w[s:s + 7], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS s FROM m)),
dup AS (SELECT r, s FROM (SELECT r, s, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(s, s + 8)) AS p FROM dup) GROUP BY r),
f AS (
  SELECT m.r, doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, word_chars, n_symbols, n_marks, n_upper,
         CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM m LEFT JOIN cov ON m.r = cov.r),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f),
cuts(rule, cutoff) AS (VALUES {_values}),
v AS (SELECT b.r, lang, doc_id, base_failed, rule, CASE rule {_rule} END AS x FROM b, (SELECT DISTINCT rule FROM cuts)),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
held AS (SELECT v.* FROM v WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good)),
counts AS (
  SELECT lang, h.rule, cutoff, count(*) AS n, count(*) FILTER (x > cutoff) AS k
  FROM held h JOIN cuts ON h.rule = cuts.rule GROUP BY lang, h.rule, cutoff),
tested AS (
  SELECT *, CASE WHEN k < n * ({RISK} / {len(RULES)}) THEN list_sum(list_transform(range(0, k + 1), lambda i:
           exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RISK} / {len(RULES)}) + (n - i) * ln(1 - {RISK} / {len(RULES)})))) ELSE 1 END AS p,
         {ERROR} / ((SELECT count(*) FROM (SELECT DISTINCT lang FROM held)) * {len(RULES)}) AS level
  FROM counts),
chosen AS (SELECT lang, rule, min(cutoff) AS cutoff FROM tested WHERE p <= level GROUP BY lang, rule),
bad AS (SELECT DISTINCT v.r FROM v JOIN chosen c ON v.lang IS NOT DISTINCT FROM c.lang AND v.rule = c.rule AND v.x > c.cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND r NOT IN (SELECT r FROM bad) AS kept
FROM b
"""

SOURCE_MIX = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s),
o AS (
  SELECT *, CAST(source_size AS DOUBLE) / weight AS ratio, sum(source_size) OVER () AS al,
         sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wl,
         coalesce(sum(source_size) OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sl
  FROM w),
c AS (SELECT *, source_size * 200 * wl <= (al * 150 - sl * 200) * weight AS capped FROM o),
f AS (SELECT sl AS fs, wl AS fw FROM c WHERE NOT capped ORDER BY ratio, sl LIMIT 1),
t AS (
  SELECT source, source_size,
         CASE WHEN capped OR fs IS NULL THEN CAST(source_size * 2 AS DOUBLE)
              ELSE CAST(weight * (al * 150 - fs * 200) AS DOUBLE) / CAST(fw * 100 AS DOUBLE) END AS target
  FROM c LEFT JOIN f ON true),
p AS (SELECT *, CASE WHEN source_size > 0 THEN least(2, floor(target / source_size)) ELSE 0 END AS whole FROM t),
k AS (SELECT source, key, sum(size) AS n FROM d GROUP BY source, key),
u AS (SELECT k.source, key, n, sum(n) OVER (PARTITION BY k.source ORDER BY key) AS upto, whole, target - whole * source_size AS budget
      FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source WHERE whole < 2),
e AS (SELECT source, min(key) AS edge FROM u WHERE upto > budget GROUP BY source),
x AS (SELECT u.source, u.key FROM u LEFT JOIN e ON u.source IS NOT DISTINCT FROM e.source
      WHERE edge IS NULL OR key < edge OR (key = edge AND budget - (upto - n) >= n / 2.0))
SELECT d.doc_id, d.size, p.source_size, p.target,
       CAST(d.size * (p.whole + CASE WHEN x.key IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
LEFT JOIN x ON d.source IS NOT DISTINCT FROM x.source AND d.key = x.key
"""

CHAT = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')) p(a, b, d, e)),
e AS (
  SELECT *, replace(replace(replace(t, '\', '\\'), '</turn>', '\</turn>'), '###', '\###') AS et,
         replace(replace(replace(replace(r, '\', '\\'), '</turn>', '\</turn>'), '###', '\###'), ':', '\:') AS er
  FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r, t)) AS turns_sha256,
       CAST(coalesce(sum(length(t)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, r, t) FILTER (r = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(et) + length(er) + 14) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

ORACLES = {"op6_chat_trees": CHAT, "op2_token_rollup": TOKEN_ROLLUP, "op4_quality_rules": QUALITY_RULES, "op5_source_mix": SOURCE_MIX}
