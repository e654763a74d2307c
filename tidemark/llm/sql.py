"""SQL for DuckDB that gives the same rows as the queries that SQL can express."""

from __future__ import annotations

from . import decontamination, quality_rules

#: Lengths: the markers of each turn, and a character for each backslash, `<|` and bar in front.
CHAT = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, n, CASE n WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0), (1)) v(n)
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(length('<|im_start|>') + length(role) + 1 + length(replace(replace(text, '\', '\-'), '<|', '<\|')) + (starts_with(text, '|'))::INT + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""


def quality() -> str:
    """References, learned anew, and the verdicts by them."""
    r = quality_rules
    kinds = {"lower": "[^a-z]", "upper": "[^A-Z]", "digit": "[^0-9]", "symbol": "[^#*$%&|<>]", "high": r"[\x00-\x7F]"}
    classes = {**{k: f"c_{k}" for k in kinds}, "space": "(chars - word_chars)"}
    classes["other"] = "(word_chars" + "".join(f" - c_{k}" for k in kinds) + ")"
    space = r"[\x20\x09-\x0D]+"
    js = "CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END"
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, lang, t, list_filter(string_split_regex(t, '{space}'), lambda x: x <> '') AS ws FROM d),
windows AS (SELECT doc_id, unnest(range(1, len(ws) - {r.WINDOW} + 2)) AS i, ws FROM w WHERE len(ws) > {r.WINDOW}),
grams AS (SELECT doc_id, i, array_to_string(ws[i:i + {r.WINDOW - 1}], ' ') AS g FROM windows),
again AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM again, range({r.WINDOW}) o(k) GROUP BY 1),
lines AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
m AS (SELECT doc_id, lang, ws, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, length(t) AS chars,
    {', '.join(f"length(regexp_replace(t, '{p}', '', 'g')) AS c_{k}" for k, p in kinds.items())} FROM lines),
j AS (SELECT m.*, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM m LEFT JOIN covered USING (doc_id)),
c AS (SELECT doc_id, lang, n_words, chars, unnest([{", ".join(f"{{'i': {i}, 'n': {classes[k]}}}" for i, k in enumerate(r.CLASSES))}], recursive := true) FROM j),
fit AS (SELECT m.* FROM m, (SELECT count(*) AS docs FROM documents) WHERE lang IS NOT NULL AND n_words >= {r.MIN_WORDS} AND ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT::DOUBLE * docs < {float(r.FIT_DOCS) * 2.0**32!r}),
langs AS (SELECT lang, sum(n_words) AS words FROM fit GROUP BY lang HAVING count(*) >= {r.LEAST_DOCS} ORDER BY count(*) DESC, lang LIMIT {r.MOST_LANGS}),
seen AS (SELECT lang, lower(word) AS word, count(*) AS n FROM (SELECT lang, unnest(ws) AS word FROM fit) JOIN langs USING (lang) WHERE regexp_matches(lower(word), '^\p{{L}}+$') GROUP BY ALL),
common AS (SELECT lang, word, n / words::DOUBLE AS q FROM seen JOIN langs USING (lang) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= {r.COMMON}),
parts AS (SELECT c.lang, i, floor({r.PARTS} * n / c.chars::DOUBLE) AS part, count(*) AS k FROM c SEMI JOIN fit USING (doc_id) JOIN langs ON langs.lang = c.lang GROUP BY ALL),
halves AS (SELECT lang, i, min(part) AS middle FROM (SELECT *, sum(k) OVER (PARTITION BY lang, i ORDER BY part) AS so_far, sum(k) OVER (PARTITION BY lang, i) AS every FROM parts) WHERE 2 * so_far >= every GROUP BY ALL),
shares AS (SELECT lang, i, middle / sum(middle) OVER (PARTITION BY lang) AS q FROM halves),
by_class AS (SELECT doc_id, min(d) AS d FROM (SELECT doc_id, shares.lang, sqrt(greatest(sum({js}) / 2, 0)) AS d
    FROM (SELECT doc_id, i, n / chars::DOUBLE AS p FROM c WHERE n_words > 0) JOIN shares USING (i) GROUP BY ALL) GROUP BY doc_id),
own AS (SELECT doc_id, common.lang, word, q, n_words, len(list_filter(ws, lambda x: lower(x) = word)) AS k FROM m, common WHERE n_words > 0),
per AS (SELECT doc_id, lang, k / n_words::DOUBLE AS p, q FROM own UNION ALL SELECT doc_id, lang, (any_value(n_words) - sum(k)) / any_value(n_words)::DOUBLE, 1 - sum(q) FROM own GROUP BY ALL),
by_word AS (SELECT doc_id, min(d) AS d FROM (
    SELECT doc_id, lang, d, known FROM (SELECT doc_id, lang, sqrt(greatest(sum({js}) / 2, 0)) AS d FROM per GROUP BY ALL) JOIN (SELECT doc_id, lang, sum(k) / any_value(n_words)::DOUBLE / sum(q) AS known FROM own GROUP BY ALL) USING (doc_id, lang)) WHERE known >= {r.KNOWN} GROUP BY doc_id),
v AS (SELECT j.*, n_words < {r.MIN_WORDS} OR 100 * n_repeat_words > {r.MAX_REPEATED_PERCENT} * n_words AS base_failed,
    coalesce(c_high <= {r.SCRIPT} * chars AND by_class.d > {r.CLASS_LIMIT[0]} + {r.CLASS_LIMIT[1]} / sqrt(n_words), false) OR coalesce(n_words >= {r.WORD_WORDS} AND by_word.d > {r.WORD_LIMIT[0]} + {r.WORD_LIMIT[1]} / sqrt(n_words), false) AS far
    FROM j LEFT JOIN by_class USING (doc_id) LEFT JOIN by_word USING (doc_id))
SELECT doc_id, n_words, word_chars, c_symbol::BIGINT AS n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT far AS kept FROM v
"""


def overlaps() -> str:
    """All words of all items laid over all documents: what the seeds have to find."""
    split = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    return rf"""
WITH b AS (SELECT item_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM (SELECT item_id, {split} AS ws FROM benchmark)),
d AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, {split} AS ws FROM documents)),
o AS (SELECT doc_id, item_id, d.i - b.i AS start, n, count(*) AS matched FROM d JOIN b USING (w) GROUP BY ALL HAVING count(*) >= n * {decontamination.OVERLAP}),
best AS (SELECT doc_id, item_id, n, max(matched) AS matched, arg_min(start, (-matched, start)) AS start FROM o GROUP BY ALL)
SELECT doc_id, item_id, start::BIGINT AS start, matched::BIGINT AS matched, n::BIGINT AS item_words, matched / n::DOUBLE AS overlap FROM best
"""
